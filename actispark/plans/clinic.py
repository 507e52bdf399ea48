"""Queries over clinical tables, scores and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from actispark.functions import scalars as S
from actispark.operators import clinical as C
from actispark.operators import datasets as D
from actispark.operators import evaluate as V
from actispark.operators import model as M
from actispark.plans.base import CLINICAL, FEATURES, NIGHTS, SCORES, SUBJECTS, clinical, clinical_long, nights, query, rounded, scores, subjects, table

ROC_BINS = "ROWS UNBOUNDED PRECEDING"


@query("p14_prepare_clinical", """SELECT CAST(c_custkey AS VARCHAR) AS "#Subject", CAST(CASE upper(trim(g)) WHEN 'F' THEN 1 WHEN 'M' THEN 2 END AS DOUBLE) AS "#Gender", TRY_CAST(v AS DOUBLE) AS value
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' f' WHEN c_custkey % 3 = 1 THEN 'M ' ELSE 'x' END g, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END v FROM customer)""")
def prepare_clinical(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(k.cast("string").alias("#Subject"), F.when(k % 3 == 0, " f").when(k % 3 == 1, "M ").otherwise("x").alias("#Gender"), F.when(k % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("value"))
    return S.prepare_clinical(raw)


@query("p15_decode_diary", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END sleep_quality, year(current_date) - year(o_orderdate) age FROM orders""")
def decode_diary(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in ("very poor", "poor", "fair", "good", "very good", "?", "")])
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(texts, (F.col("o_orderkey") % 7).cast("int") + 1).alias("sleep_quality"), F.to_date("o_orderdate").alias("date_of_birth"))
    return S.decode_diary(raw).drop("date_of_birth").withColumn("age", F.col("age").cast("long"))


@query("p16_clean_scored", """SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) score FROM lineitem WHERE l_linenumber IN (0, 1) AND l_discount <> 0""")
def clean_scored(spark, sf_dir):
    score = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.nullif(F.col("l_discount"), F.lit(0.0)))
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))
    return S.clean_scored(raw, "l_linenumber", "score")


@query("p16_inf_to_null", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 6) END AS value FROM lineitem""")
def inf_to_null(spark, sf_dir):
    value = F.when(F.col("l_discount") == 0, F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(float("inf"))).otherwise(F.col("l_quantity") / F.nullif(F.col("l_discount"), F.lit(0.0)))
    return rounded(S.inf_to_null(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value")), ["value"]))


@query("p17_display_feature", """SELECT p_partkey, p_brand || ' (' || ['SD', 'MAD', 'Range', 'IQR', 'CV'][CAST(p_partkey % 5 AS INT) + 1] || ')' AS name FROM part""")
def display_feature(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("SD", "MAD", "Range", "IQR", "CV")]), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", S.display_feature(F.concat(kind, F.lit("."), F.col("p_brand"))).alias("name"))


@query("j10_attach_diagnosis", f"WITH {SUBJECTS} SELECT o_orderkey, diagnosis_code FROM orders JOIN subjects ON code = CAST(o_custkey AS VARCHAR) WHERE diagnosis_code IS NOT NULL")
def attach_diagnosis(spark, sf_dir):
    at = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("subject"))
    return C.attach_diagnosis(at, subjects(spark, sf_dir))[0].select("o_orderkey", "diagnosis_code")


@query("j10_without_diagnosis", f"WITH {SUBJECTS} SELECT DISTINCT code subject FROM orders JOIN subjects ON code = CAST(o_custkey AS VARCHAR) WHERE diagnosis_code IS NULL")
def without_diagnosis(spark, sf_dir):
    at = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("subject"))
    return C.attach_diagnosis(at, subjects(spark, sf_dir))[1]


def _sheet(spark, sf_dir):
    """Orders as rows of a diagnosis sheet, some codes invalid and some subjects unknown."""
    k = F.col("o_orderkey")
    code = F.when(k % 11 == 0, "x").when(k % 13 == 0, "9").when(k % 17 != 0, (k % 4).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("row"), F.concat(F.lit(" "), (F.col("o_custkey") + F.when(k % 10 == 0, 1_000_000).otherwise(0)).cast("string")).alias("subject"), code.alias("code"))


SHEET = f"""{SUBJECTS}, sheet AS (SELECT o_orderkey AS "row", CAST(o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) subject, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 4 END code FROM orders),
last AS (SELECT subject, CAST(arg_max(code, "row") AS INT) new_code FROM sheet WHERE code >= 0 GROUP BY 1),
upd AS (SELECT l.subject, new_code, s.diagnosis_code old_code, CASE WHEN s.code IS NULL THEN 'missing' WHEN s.diagnosis_code IS NOT DISTINCT FROM new_code THEN 'same' ELSE 'update' END AS action FROM last l LEFT JOIN subjects s ON s.code = l.subject)"""


@query("j11_diagnosis_updates", f"WITH {SHEET} SELECT * FROM upd")
def diagnosis_updates(spark, sf_dir):
    return C.diagnosis_updates(subjects(spark, sf_dir), _sheet(spark, sf_dir))


@query("j11_diagnosis_summary", f"WITH {SHEET} SELECT (SELECT count(code) FROM sheet) AS rows, (SELECT count(*) FROM sheet WHERE code < 0) invalid_rows, count(*) unique_subjects, count(*) FILTER (action = 'update') updated, count(*) FILTER (action = 'missing') missing_subjects FROM upd")
def diagnosis_summary(spark, sf_dir):
    return C.diagnosis_summary(subjects(spark, sf_dir), _sheet(spark, sf_dir))


@query("a13_day_statistics", f"""WITH {CLINICAL}, q AS (SELECT subject, feature, stddev_pop(value) sd, mad(value) mad, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) iqr, avg(value) m FROM long GROUP BY ALL)
SELECT subject, feature, round(sd, 6) sd, round(mad, 6) mad, round(range, 6) AS range, round(iqr, 6) iqr, round(CASE WHEN m <> 0 THEN sd / m END, 6) cv FROM q""")
def day_statistics(spark, sf_dir):
    return rounded(C.day_statistics(clinical_long(spark, sf_dir)))


@query("a14_inconsistent_identity", """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) subject, l_returnflag flag, l_linestatus status, l_suppkey % 3 same FROM lineitem) SELECT subject, 'flag' AS column, count(DISTINCT flag) n FROM t GROUP BY 1 HAVING count(DISTINCT flag) > 1
UNION ALL SELECT subject, 'status', count(DISTINCT status) FROM t GROUP BY 1 HAVING count(DISTINCT status) > 1 UNION ALL SELECT subject, 'same', count(DISTINCT same) FROM t GROUP BY 1 HAVING count(DISTINCT same) > 1""")
def inconsistent_identity(spark, sf_dir):
    at = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("subject"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_suppkey") % 3).alias("same"))
    return C.inconsistent_identity(at, ["flag", "status", "same"])


@query("a15_class_overview", f"""WITH {SUBJECTS} SELECT c.code, c.label, count(s.code) n FROM (VALUES (0, 'HC'), (1, 'NonHC'), (2, 'MCI-AD'), (3, 'preDLB'), (NULL, 'missing')) c(code, label) LEFT JOIN (SELECT *, 1 one FROM subjects) s ON s.diagnosis_code IS NOT DISTINCT FROM c.code GROUP BY ALL""")
def class_overview(spark, sf_dir):
    return C.class_overview(subjects(spark, sf_dir))


@query("m7_scenarios", f"""WITH {SUBJECTS} SELECT s.name AS scenario, code, CAST(list_contains(s.p, diagnosis_code) AS INT) target FROM subjects, (VALUES ('scenario-preDLB_vs_HC', [3], [0]), ('scenario-preDLB+MCI-AD_vs_HC', [3, 2], [0]), ('scenario-MCI-AD_vs_HC', [2], [0]),
 ('scenario-preDLB+MCI-AD+NonHC_vs_HC', [3, 2, 1], [0]), ('scenario-HC_vs_NonHC', [0], [1])) s(name, p, n) WHERE list_contains(p, diagnosis_code) OR list_contains(n, diagnosis_code)""")
def scenarios(spark, sf_dir):
    from functools import reduce

    parts = [C.scenario_dataset(subjects(spark, sf_dir), p, n).select(F.lit(S.scenario_label(p, n)).alias("scenario"), "code", "target") for p, n in C.SCENARIOS]
    return reduce(lambda a, b: a.unionByName(b), parts)


COVER = "cover AS (SELECT feature, CASE WHEN feature = 'l_tax' AND \"row\" % 5 = 0 THEN NULL WHEN feature = 'l_discount' THEN 0 ELSE value END AS value FROM long)"


@query("a16_feature_coverage", f"""WITH {CLINICAL}, {COVER}, c AS (SELECT feature, avg(CAST(value IS NOT NULL AS INT)) r, coalesce(sum(abs(value)), 0) s FROM cover GROUP BY 1)
SELECT feature, round(r, 6) non_missing_ratio, r >= 0.9 AND s <> 0 kept, CASE WHEN r < 0.9 THEN 'coverage' WHEN s = 0 THEN 'all_zero' ELSE '' END drop_reason FROM c""")
def feature_coverage(spark, sf_dir):
    f, v = F.col("feature"), F.col("value")
    at = clinical_long(spark, sf_dir).withColumn("value", F.when((f == "l_tax") & (F.col("row") % 5 == 0), None).when(f == "l_discount", 0.0).otherwise(v))
    return rounded(C.feature_coverage(at))


@query("a23_control_covariates", f"""WITH {CLINICAL}, d AS (SELECT *, gender - avg(gender) OVER p dg, age - avg(age) OVER p da, value - avg(value) OVER p dv FROM long WINDOW p AS (PARTITION BY feature)),
s AS (SELECT feature, sum(dg*dg) gg, sum(da*da) aa, sum(dg*da) ga, sum(dg*dv) gv, sum(da*dv) av FROM d GROUP BY 1)
SELECT "row", feature, round(dv - (gv*aa - av*ga) / (gg*aa - ga*ga) * dg - (av*gg - gv*ga) / (gg*aa - ga*ga) * da, 4) residual FROM d JOIN s USING (feature)""")
def control_covariates(spark, sf_dir):
    return rounded(C.control_covariates(clinical(spark, sf_dir), "row", list(FEATURES)), 4)


@query("a24_pearson", f"WITH {CLINICAL} SELECT feature, count(*) n, round(corr(value, age), 4) r FROM long GROUP BY 1")
def pearson(spark, sf_dir):
    return C.covariate_correlations(clinical_long(spark, sf_dir).withColumn("covariate", F.col("age"))).select("feature", "n", "r")


@query("a25_spearman", f"""WITH {CLINICAL}, r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 x, rank() OVER (PARTITION BY feature ORDER BY age) + (count(*) OVER (PARTITION BY feature, age) - 1) / 2 y FROM long)
SELECT feature, count(*) n, round(corr(x, y), 4) r FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    return C.covariate_correlations(clinical_long(spark, sf_dir).withColumn("covariate", F.col("age")), "spearman").select("feature", "n", "r")


@query("a26_kendall", f"""WITH {CLINICAL}, c AS (SELECT feature, value x, age y, count(*) c FROM long GROUP BY ALL), xs AS (SELECT DISTINCT feature, x FROM c), ys AS (SELECT DISTINCT feature, y FROM c),
grid AS (SELECT feature, x, y, coalesce(c, 0) c FROM xs JOIN ys USING (feature) LEFT JOIN c USING (feature, x, y)),
under AS (SELECT *, sum(c) OVER (PARTITION BY feature, y ORDER BY x) - c AS less FROM grid), over AS (SELECT feature, c, sum(less) OVER (PARTITION BY feature, x ORDER BY y DESC) - less AS crossed FROM under),
d AS (SELECT feature, sum(c) n, sum(c * crossed)::DOUBLE crossed, (sum(c * (c - 1)) / 2)::DOUBLE b FROM over GROUP BY 1),
tx AS (SELECT feature, (sum(t * (t - 1)) / 2)::DOUBLE tx FROM (SELECT feature, x, sum(c) t FROM c GROUP BY ALL) GROUP BY 1), ty AS (SELECT feature, (sum(t * (t - 1)) / 2)::DOUBLE ty FROM (SELECT feature, y, sum(c) t FROM c GROUP BY ALL) GROUP BY 1)
SELECT feature, CAST(n AS BIGINT) n, round((n * (n - 1) / 2 - tx - ty + b - 2 * crossed) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 4) r FROM d JOIN tx USING (feature) JOIN ty USING (feature)""")
def kendall(spark, sf_dir):
    return C.covariate_correlations(clinical_long(spark, sf_dir).withColumn("covariate", F.col("age")), "kendall").select("feature", "n", "r")


_PAIRED = " UNION ALL ".join(f"SELECT '{c}' covariate, feature, \"row\", value AS v, {c} x FROM long" for c in ("gender", "age"))


@query("a24_pearson_all", f"""WITH {CLINICAL}, w AS ({_PAIRED}), c AS (SELECT covariate, feature, CASE WHEN feature <> 'l_tax' OR "row" % 5 <> 0 THEN v END v, x FROM w) SELECT covariate, feature, count(v) n, round(corr(v, x), 4) r FROM c GROUP BY ALL""")
def pearson_all(spark, sf_dir):
    """Every feature with both covariates, where every fifth tax is missing."""
    at = clinical(spark, sf_dir).withColumn("l_tax", F.when(F.col("row") % 5 != 0, F.col("l_tax")))
    return C.all_correlations(at, list(FEATURES), ["gender", "age"]).drop("p")


@query("a25_spearman_all", f"""WITH {CLINICAL}, w AS ({_PAIRED}),
r AS (SELECT covariate, feature, rank() OVER (PARTITION BY covariate, feature ORDER BY v) + (count(*) OVER (PARTITION BY covariate, feature, v) - 1) / 2 a, rank() OVER (PARTITION BY covariate, feature ORDER BY x) + (count(*) OVER (PARTITION BY covariate, feature, x) - 1) / 2 b FROM w) SELECT covariate, feature, count(*) n, round(corr(a, b), 4) r FROM r GROUP BY ALL""")
def spearman_all(spark, sf_dir):
    return C.all_correlations(clinical(spark, sf_dir), list(FEATURES), ["gender", "age"], "spearman").drop("p")


@query("w16_number_days", f'WITH {CLINICAL} SELECT "row", subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY date, "row") AS INT) day_no FROM clinical')
def number_days(spark, sf_dir):
    return D.number_days(clinical(spark, sf_dir)).select("row", "subject", "day_no")


_NIGHTLY = ("tib", "sol", "waso", "wasf")


R4 = f"""WITH {NIGHTS}, n AS (SELECT *, CAST(row_number() OVER w AS INT) d, first_value(recording_id) OVER w r FROM nights WINDOW w AS (PARTITION BY subject ORDER BY date, night_id)),
long AS ({" UNION ALL ".join(f"SELECT subject, r AS recording_id, '{f}' feature, d AS day, CAST({f} AS DOUBLE) v FROM n" for f in _NIGHTLY)})"""


def _subject_days(spark, sf_dir):
    return D.subject_days(nights(spark, sf_dir), list(_NIGHTLY), ["recording_id"], row="night_id")


@query("r4_subject_matrix", f"{R4} SELECT subject, recording_id, feature, day, v AS value FROM long")
def subject_matrix(spark, sf_dir):
    """The matrix as rows, since its width would follow from the data."""
    return D.melted_days(_subject_days(spark, sf_dir), ["recording_id"])


@query("r4_subject_statistics", f"""{R4} SELECT subject, recording_id, feature, count(*) AS n_days, round(stddev_pop(v), 6) sd, round(mad(v), 6) mad, round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) iqr, round(CASE WHEN avg(v) <> 0 THEN stddev_pop(v) / avg(v) END, 6) cv FROM long GROUP BY ALL""")
def subject_statistics(spark, sf_dir):
    return rounded(_subject_days(spark, sf_dir).withColumn("n_days", F.size("days").cast("long")).drop("days"))


AUC = """cnt AS (SELECT file, {s} s, sum(SLEEP) p, sum(1 - SLEEP) n FROM scores GROUP BY 1, 2), run AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY s) - n b FROM cnt),
auc AS (SELECT file, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (b + n / 2.0)) / (sum(p)::DOUBLE * sum(n)) END auc FROM run GROUP BY 1)"""


@query("a12_roc_auc", f"WITH {SCORES}, {AUC.format(s='tie')} SELECT file, round(auc, 6) auc FROM auc")
def roc_auc(spark, sf_dir):
    return rounded(V.roc_auc(scores(spark, sf_dir), ["file"], score="tie"))


@query("a11_score_report", f"""WITH {SCORES}, allscores AS (SELECT * FROM scores UNION ALL SELECT NULL, SLEEP, SLEEP_PREDICTION, tie FROM scores), {AUC.format(s="SLEEP_PREDICTION").replace("FROM scores", "FROM allscores")},
c AS (SELECT file, count(*) n, count(*) FILTER (SLEEP = 1 AND SLEEP_PREDICTION >= 0.5)::DOUBLE tp, count(*) FILTER (SLEEP = 0 AND SLEEP_PREDICTION < 0.5)::DOUBLE tn, count(*) FILTER (SLEEP = 0 AND SLEEP_PREDICTION >= 0.5)::DOUBLE fp, count(*) FILTER (SLEEP = 1 AND SLEEP_PREDICTION < 0.5)::DOUBLE fn FROM allscores GROUP BY 1)
SELECT c.file, CAST(c.file IS NULL AS INT) overall, n n_samples, round((tp + tn) / n, 6) accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1, round(auc, 6) auc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) balanced_accuracy, round(tn / (tn + fp), 6) specificity,
 CAST(tp AS BIGINT) tp, CAST(tn AS BIGINT) tn, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn, 'ok' status FROM c JOIN auc ON c.file IS NOT DISTINCT FROM auc.file""")
def score_report(spark, sf_dir):
    return rounded(V.score_report(scores(spark, sf_dir)))


def _subject_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("file", F.col("SLEEP").alias("y_true"), F.col("SLEEP_PREDICTION").alias("y_prob"), (F.col("SLEEP_PREDICTION") >= 0.5).cast("int").alias("y_pred"))


MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END"


@query("a17_tune_threshold", f"""WITH {SCORES}, t AS (SELECT i / 10000 t, i FROM range(0, 10000) r(i)), b AS (SELECT file, CAST(floor(SLEEP_PREDICTION * 10000 + 1e-9) AS INT) k, sum(SLEEP) p, sum(1 - SLEEP) n FROM scores GROUP BY 1, 2),
g AS (SELECT f.file, t.i, coalesce(p, 0) p, coalesce(n, 0) n FROM (SELECT DISTINCT file FROM b) f CROSS JOIN t LEFT JOIN b ON b.file = f.file AND b.k = t.i),
c AS (SELECT file, i, sum(p) OVER d::DOUBLE tp, sum(n) OVER d::DOUBLE fp, sum(p) OVER (PARTITION BY file) - sum(p) OVER d::DOUBLE fn, sum(n) OVER (PARTITION BY file) - sum(n) OVER d::DOUBLE tn FROM g WINDOW d AS (PARTITION BY file ORDER BY i DESC)),
m AS (SELECT file, i, round({MCC}, 12) mcc FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY mcc DESC, i) k FROM m) SELECT file, round(i / 10000, 6) threshold, round(mcc, 6) mcc FROM r WHERE k = 1""")
def tune_threshold(spark, sf_dir):
    return rounded(V.tune_threshold(_subject_scores(spark, sf_dir), ["file"]))


@query("a17_fold_thresholds", f"""WITH {SCORES}, o AS (SELECT f.fold, SLEEP, SLEEP_PREDICTION FROM scores, range(0, 5) f(fold) WHERE CAST(file AS INT) % 5 <> f.fold),
b AS (SELECT fold, CAST(floor(SLEEP_PREDICTION * 10000 + 1e-9) AS INT) k, sum(SLEEP) p, sum(1 - SLEEP) n FROM o GROUP BY 1, 2), g AS (SELECT f.fold, t.i, coalesce(p, 0) p, coalesce(n, 0) n FROM range(0, 5) f(fold) CROSS JOIN range(0, 10000) t(i) LEFT JOIN b ON b.fold = f.fold AND b.k = t.i),
c AS (SELECT fold, i, sum(p) OVER d::DOUBLE tp, sum(n) OVER d::DOUBLE fp, sum(p) OVER (PARTITION BY fold) - sum(p) OVER d::DOUBLE fn, sum(n) OVER (PARTITION BY fold) - sum(n) OVER d::DOUBLE tn FROM g WINDOW d AS (PARTITION BY fold ORDER BY i DESC)),
m AS (SELECT fold, i, round({MCC}, 12) mcc FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mcc DESC, i) k FROM m), t AS (SELECT CAST(fold AS INT) fold, i / 10000 threshold FROM r WHERE k = 1)
SELECT fold, round(threshold, 6) threshold, round(avg(threshold) OVER (), 6) mean_threshold, round(median(threshold) OVER (), 6) median_threshold FROM t""")
def fold_thresholds(spark, sf_dir):
    return rounded(V.fold_thresholds(_subject_scores(spark, sf_dir).withColumn("fold", F.col("file").cast("int") % 5), 5))


@query("a18_binary_metrics", f"""WITH {SCORES}, c AS (SELECT file, count(*) FILTER (SLEEP = 1 AND SLEEP_PREDICTION >= 0.5)::DOUBLE tp, count(*) FILTER (SLEEP = 0 AND SLEEP_PREDICTION >= 0.5)::DOUBLE fp, count(*) FILTER (SLEEP = 0 AND SLEEP_PREDICTION < 0.5)::DOUBLE tn, count(*) FILTER (SLEEP = 1 AND SLEEP_PREDICTION < 0.5)::DOUBLE fn FROM scores GROUP BY 1)
SELECT file, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(tn AS BIGINT) tn, CAST(fn AS BIGINT) fn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS "BACC", round({MCC}, 4) AS "MCC", round(tp / (tp + fn), 4) AS "SEN", round(tn / (tn + fp), 4) AS "SPE", round(tp / (tp + fp), 4) AS "PRE", round(2 * tp / (2 * tp + fp + fn), 4) AS "F1", round((tp + tn) / (tp + tn + fp + fn), 4) AS "ACC" FROM c""")
def binary_metrics(spark, sf_dir):
    return V.binary_metrics(_subject_scores(spark, sf_dir), ["file"])


@query("a18_classification_report", f"""WITH {SCORES}, c AS (SELECT file, count(*) FILTER (SLEEP = 1 AND SLEEP_PREDICTION >= 0.5)::DOUBLE tp, count(*) FILTER (SLEEP = 0 AND SLEEP_PREDICTION >= 0.5)::DOUBLE fp, count(*) FILTER (SLEEP = 0 AND SLEEP_PREDICTION < 0.5)::DOUBLE tn, count(*) FILTER (SLEEP = 1 AND SLEEP_PREDICTION < 0.5)::DOUBLE fn FROM scores GROUP BY 1),
s AS (SELECT file, '1' AS class, tp / (tp + fp) AS precision, tp / (tp + fn) recall, 2 * tp / (2 * tp + fp + fn) f1, tp + fn support FROM c UNION ALL SELECT file, '0', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fp + fn), tn + fp FROM c)
SELECT file, class, round(precision, 6) AS precision, round(recall, 6) recall, round(f1, 6) f1, CAST(support AS BIGINT) support FROM s UNION ALL SELECT file, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s GROUP BY file
UNION ALL SELECT file, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s GROUP BY file""")
def classification_report(spark, sf_dir):
    return rounded(V.classification_report(_subject_scores(spark, sf_dir), ["file"]))


CURVE = f"{SCORES}, k AS (SELECT file, SLEEP_PREDICTION s, sum(SLEEP) p, sum(1 - SLEEP) n FROM scores GROUP BY 1, 2), run AS (SELECT file, s, p, sum(p) OVER d::DOUBLE tp, sum(n) OVER d::DOUBLE fp, sum(p) OVER a ap, sum(n) OVER a an FROM k WINDOW d AS (PARTITION BY file ORDER BY s DESC), a AS (PARTITION BY file))"


@query("a19_roc_points", f"WITH {CURVE} SELECT file, round(s, 6) threshold, round(fp / an, 6) fpr, round(tp / ap, 6) tpr FROM run")
def roc_points(spark, sf_dir):
    return rounded(V.roc_points(_subject_scores(spark, sf_dir), ["file"]))


@query("a19_pr_points", f"WITH {CURVE} SELECT file, round(s, 6) threshold, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) recall FROM run")
def pr_points(spark, sf_dir):
    return rounded(V.pr_points(_subject_scores(spark, sf_dir), ["file"]))


@query("a19_average_precision", f"WITH {CURVE} SELECT file, round(sum(tp / (tp + fp) * p / ap), 6) ap FROM run GROUP BY 1")
def average_precision(spark, sf_dir):
    return rounded(V.average_precision(_subject_scores(spark, sf_dir), ["file"]))


@query("a20_subject_vote", f"""WITH {SUBJECTS}, v AS (SELECT CAST(o_custkey AS VARCHAR) subject, count(*) nights, count(*) FILTER (o_orderkey % 3 <> 0) positive FROM orders GROUP BY 1)
SELECT subject, nights, positive, CAST(positive * 2 > nights AS INT) vote, CAST(pPD OR pMCI AS INT) truth, CAST(positive * 2 > nights AS INT) <> CAST(pPD OR pMCI AS INT) differs FROM v JOIN subjects ON code = subject""")
def subject_vote(spark, sf_dir):
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject"), (F.col("o_orderkey") % 3 != 0).cast("int").alias("y_pred"))
    return V.subject_vote(at, subjects(spark, sf_dir))


@query("a21_class_weight", f"WITH {SCORES}, c AS (SELECT count(*) FILTER (SLEEP = 1) pos, count(*) FILTER (SLEEP = 0) neg FROM scores) SELECT pos, neg, round(neg / pos, 6) scale_pos_weight, round(100 * pos / (pos + neg), 6) pos_percent, round(100 * neg / (pos + neg), 6) neg_percent FROM c")
def class_weight(spark, sf_dir):
    return rounded(V.class_weight(scores(spark, sf_dir)))


@query("a22_cv_summary", f"""WITH {SCORES}, a AS (SELECT file, round(avg(CAST((SLEEP_PREDICTION >= 0.5) = (SLEEP = 1) AS INT)), 4) v FROM scores GROUP BY 1) SELECT 'ACC' metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) sd FROM a""")
def cv_summary(spark, sf_dir):
    return V.cv_summary(V.binary_metrics(_subject_scores(spark, sf_dir), ["file"]), ["ACC"])


@query("t1_top_features", "SELECT p_name AS feature, p_retailprice importance FROM part ORDER BY importance DESC, feature LIMIT 10")
def top_features(spark, sf_dir):
    return V.top_features(table(spark, sf_dir, "part").select(F.col("p_name").alias("feature"), F.col("p_retailprice").alias("importance")))


@query("u1_training_dataset", """SELECT 'a' AS "group", l_orderkey, l_linenumber, l_quantity, NULL l_tax FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT 'b', l_orderkey, l_linenumber, NULL, l_tax FROM lineitem WHERE l_linenumber % 2 = 0""")
def training_dataset(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1  # the two frames together hold all lines
    return M.training_dataset({"a": li.where(odd).select("l_orderkey", "l_linenumber", "l_quantity"), "b": li.where(~odd).select("l_orderkey", "l_linenumber", "l_tax")})


@query("m1_m2_impute_scale", """WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END q FROM lineitem), m AS (SELECT median(q) d FROM f), i AS (SELECT l_orderkey, l_linenumber, coalesce(q, d) q FROM f, m), s AS (SELECT min(q) a, max(q) b FROM i) SELECT l_orderkey, l_linenumber, round((q - a) / (b - a), 6) q FROM i, s""")
def impute_scale(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
    filled = M.impute(raw, M.fit_imputer(raw, ["q"]))
    return rounded(M.scale(filled, M.fit_scaler(filled, ["q"])))


def _epochs(spark, sf_dir):
    """Lineitems as labelled epochs of some eighty groups; the label follows two features."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    label = ((q + 200 * d) > 35).cast("int")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 83).cast("string").alias("group"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", label.alias("SLEEP"))


@query("w17_group_folds", """WITH RECURSIVE g AS (SELECT CAST(l_suppkey % 83 AS VARCHAR) g, count(*) n FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) i FROM g),
r AS (SELECT CAST(0 AS BIGINT) i, [CAST(0 AS BIGINT), 0, 0, 0] load, CAST(NULL AS BIGINT) fold UNION ALL
 SELECT o.i, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + o.n ELSE x END), list_position(load, list_min(load)) - 1 FROM r JOIN o ON o.i = r.i + 1)
SELECT CAST(fold AS INT) fold, CAST(sum(n) AS BIGINT) n, count(*) AS groups FROM r JOIN o USING (i) GROUP BY 1""")
def group_folds(spark, sf_dir):
    return M.group_folds(_epochs(spark, sf_dir), "group", 4).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups"))


@query("w17_group_split", """WITH e AS (SELECT CAST(l_suppkey % 83 AS VARCHAR) g FROM lineitem) SELECT CAST('0x' || md5('17:' || g)[1:8] AS BIGINT) / 4294967296 < 0.4 AS test, count(*) n, count(DISTINCT g) AS groups FROM e GROUP BY 1""")
def group_split(spark, sf_dir):
    return M.group_split(_epochs(spark, sf_dir), "group").groupBy("test").agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups"))


@query("m3_m6_sleep_model")
def sleep_model(spark, sf_dir):
    at = M.group_split(_epochs(spark, sf_dir), "group")
    model = M.train_sleep_model(at.where(~F.col("test")), ["l_quantity", "l_discount", "l_tax"], maxIter=10, maxDepth=3)
    scored = M.score_epochs(model, at.where("test"))
    return V.binary_metrics(scored.select("group", F.col("SLEEP").alias("y_true"), (F.col("SLEEP_PREDICTION") >= 0.5).cast("int").alias("y_pred")), ["group"])


@query("m4_cross_validate")
def cross_validate(spark, sf_dir):
    return M.cross_validate(_epochs(spark, sf_dir), ["l_quantity", "l_discount"], "group", 2, maxIter=3, maxDepth=2)


@query("m5_random_search")
def random_search(spark, sf_dir):
    best = M.random_search(_epochs(spark, sf_dir), ["l_quantity", "l_discount"], {"maxIter": [2, 4], "maxDepth": [1, 2]}, 2, "group", 2)
    return spark.createDataFrame([(str(p), float(m)) for p, m in best], "params string, mcc double")
