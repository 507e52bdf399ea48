"""Queries over nights, diaries and their datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from actispark.functions import scalars as S
from actispark.operators import datasets as D
from actispark.operators import epochs as E
from actispark.operators import evaluate as V
from actispark.operators import match as M
from actispark.operators import nights as N
from actispark.plans.base import DIARY, EPOCHS, INTERVALS, NIGHTS, SAMPLES, SUBJECTS, diary, intervals, nights, query, rounded, samples, scored_epochs, subjects, table

OLD, TEEN = "age >= 65", "(age >= 14 AND age < 18)"
NORMS = f"""CASE WHEN sol / 60 <= 30 THEN 1 WHEN sol / 60 <= CASE WHEN {OLD} THEN 60 ELSE 45 END THEN 0 ELSE -1 END sol_norm,
 CASE WHEN waso <= CASE WHEN {OLD} THEN 30 ELSE 20 END THEN 1 WHEN {OLD} OR waso <= CASE WHEN age < 6 OR {TEEN} THEN 50 ELSE 40 END THEN 0 ELSE -1 END waso_norm,
 CASE WHEN awk5plus < CASE WHEN {OLD} THEN 3 ELSE 2 END THEN 1 WHEN awk5plus < CASE WHEN {TEEN} THEN 3 ELSE 4 END THEN 0 ELSE -1 END awk5plus_norm,
 CASE WHEN se >= 85 THEN 1 WHEN se >= CASE WHEN age >= 18 AND age < 26 THEN 65 ELSE 75 END THEN 0 ELSE -1 END se_norm"""
RATIOS = "tib - (sol + waso + wasf) tst, CASE WHEN tib <> 0 THEN 100 * (tib - (sol + waso + wasf)) / tib::DOUBLE END se, CASE WHEN tib - (sol + waso + wasf) <> 0 THEN wb / ((tib - (sol + waso + wasf)) / 3600::DOUBLE) END sf"
NIGHT_ROWS = f"{NIGHTS}, {SUBJECTS}, n1 AS (SELECT n.*, {RATIOS}, age, pPD, pMCI, HC, SA FROM nights n JOIN subjects s ON n.subject = s.code), night_rows AS (SELECT *, {NORMS} FROM n1)"
DIARY_ROWS = f"""{DIARY}, {INTERVALS}, agg AS (SELECT day_id, CAST(sum(duration) AS BIGINT) waso, count(*) wb, count(*) FILTER (duration >= 300) awk5plus, CAST(sum(epoch(end_ts - start_ts) % 86400) AS BIGINT) span FROM wakes GROUP BY 1),
d1 AS (SELECT t.day_id, t.subject, t.date, CAST(CAST(epoch(t4 - t1) AS BIGINT) % 86400 AS INT) tib, CAST(CAST(epoch(t2 - t1) AS BIGINT) % 86400 AS INT) sol, coalesce(waso, 0) waso, CAST(CAST(epoch(t4 - t3) AS BIGINT) % 86400 AS INT) wasf, coalesce(wb, 0) wb, coalesce(awk5plus, 0) awk5plus,
 CAST(epoch(t3 - t2) AS BIGINT) % 86400 - coalesce(span, 0) dtst FROM timeline t LEFT JOIN agg USING (day_id)),
d2 AS (SELECT d.*, {RATIOS}, age, pPD, pMCI, HC, SA FROM d1 d JOIN subjects s ON d.subject = s.code), diary_rows AS (SELECT *, {NORMS} FROM d2)"""
R = lambda *cols: ", ".join(f"round({c}, 6) {c.split('.')[-1]}" if c.split(".")[-1].split("_")[-1] in ("se", "sf") and not c.endswith("norm") else c for c in cols)


@query("p7_p13_norms", f"WITH {NIGHT_ROWS} SELECT night_id, tst, round(se, 6) se, round(sf, 6) sf, sol_norm, waso_norm, awk5plus_norm, se_norm FROM night_rows")
def norms(spark, sf_dir):
    return rounded(D.night_rows(nights(spark, sf_dir), subjects(spark, sf_dir)).select("night_id", "tst", "se", "sf", "sol_norm", "waso_norm", "awk5plus_norm", "se_norm"))


@query("p8_norm_reference", f"""WITH {SUBJECTS} SELECT code, metric, CASE metric WHEN 'sol' THEN '0-30 mins' WHEN 'awk5plus' THEN CASE WHEN {OLD} THEN '0-2' ELSE '0-1' END WHEN 'waso' THEN CASE WHEN {OLD} THEN '0-30 mins' ELSE '0-20 mins' END ELSE '100-85%' END appropriate,
 CASE metric WHEN 'sol' THEN CASE WHEN {OLD} THEN '31-60 mins' ELSE '31-45 mins' END WHEN 'awk5plus' THEN CASE WHEN {OLD} THEN '3' WHEN {TEEN} THEN '2' ELSE '2-3' END WHEN 'waso' THEN CASE WHEN {OLD} THEN '31+ mins' WHEN age < 6 OR {TEEN} THEN '21-50 mins' ELSE '21-40 mins' END
  ELSE CASE WHEN age >= 18 AND age < 26 THEN '84-65%' ELSE '84-75%' END END uncertain,
 CASE metric WHEN 'sol' THEN CASE WHEN {OLD} THEN '61+ mins' ELSE '46+ mins' END WHEN 'awk5plus' THEN CASE WHEN {TEEN} THEN '3+' ELSE '4+' END WHEN 'waso' THEN CASE WHEN {OLD} THEN '-' WHEN age < 6 OR {TEEN} THEN '51+ mins' ELSE '41+ mins' END
  ELSE CASE WHEN age >= 18 AND age < 26 THEN '64-0%' ELSE '74-0%' END END inappropriate FROM subjects, (SELECT unnest(['sol', 'awk5plus', 'waso', 'se']) metric)""")  # fmt: skip
def norm_reference(spark, sf_dir):
    return S.norm_reference(subjects(spark, sf_dir)).select("code", "metric", "appropriate", "uncertain", "inappropriate")


@query("p5_binarize_scores", f"""WITH {EPOCHS}, b AS (SELECT *, bool_and(score IN (0, 1)) OVER (PARTITION BY recording_id) b FROM epochs) SELECT recording_id, line_no, CASE WHEN b THEN CAST(score AS INT) ELSE CAST(score >= 0.5 AS INT) END score FROM b""")
def binarize(spark, sf_dir):
    return S.binarize_scores(scored_epochs(spark, sf_dir), ["recording_id"]).select("recording_id", "line_no", "score")


@query("p9_diary_timeline", f"WITH {DIARY} SELECT day_id, t1, t2, t3, t4 FROM timeline")
def diary_timeline(spark, sf_dir):
    return N.diary_timeline(diary(spark, sf_dir)).select("day_id", "t1", "t2", "t3", "t4")


@query("p10_wake_intervals", f'WITH {DIARY}, {INTERVALS} SELECT day_id, "start", "end", start_ts, end_ts, duration FROM wakes')
def wake_intervals(spark, sf_dir):
    return N.wake_interval_times(diary(spark, sf_dir), intervals(spark, sf_dir)).select("day_id", "start", "end", "start_ts", "end_ts", "duration")


@query("p11_night_bounds", f"WITH {DIARY} SELECT subject, day_id, t1 - INTERVAL 30 MINUTE lo, t4 + INTERVAL 30 MINUTE hi FROM timeline")
def night_bounds(spark, sf_dir):
    return N.night_bounds(diary(spark, sf_dir))


@query("p12_rbdsq", """WITH f AS (SELECT CAST(o_custkey AS VARCHAR) subject, CAST(o_orderdate AS DATE) creation_date, o_orderkey k, CAST((o_orderkey * 7919 % 8192) AS BIGINT) b FROM orders),
s AS (SELECT *, bit_count(b) score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY creation_date DESC, score DESC) i FROM s) SELECT subject, creation_date, CAST(score AS INT) score FROM r WHERE i = 1""")
def rbdsq(spark, sf_dir):
    bits = F.col("o_orderkey") * 7919 % 8192
    forms = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.to_date("o_orderdate").alias("creation_date"), *[(F.shiftright(bits, i) % 2 == 1).alias(q) for i, q in enumerate(S.RBDSQ)])
    return S.rbdsq_scores(forms).select("subject", "creation_date", "score")


@query("p3_p19_stages", """WITH e AS (SELECT event_id, ['W', 'N1', 'N2', 'N3', 'R', 'P'][CAST(event_id % 6 AS INT) + 1] stage FROM events) SELECT event_id, stage, CAST(stage IN ('R', 'N1', 'N2', 'N3') AS INT) sleep, CASE WHEN stage IN ('R', 'N1', 'N2', 'N3') THEN 'Sleep' ELSE 'Wake' END state FROM e""")
def stages(spark, sf_dir):
    stage = F.element_at(F.array(*[F.lit(x) for x in ("W", "N1", "N2", "N3", "R", "P")]), (F.col("event_id") % 6).cast("int") + 1)
    at = table(spark, sf_dir, "events").select("event_id", stage.alias("stage")).withColumn("sleep", S.stage_to_sleep())
    return S.hypnogram(at)


@query("p4_psg_timestamps", """WITH p AS (SELECT user_id % 150 rec, event_id, strftime(ts, '%H:%M:%S') clock, DATE '2024-01-01' d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i, user_id FROM events),
l AS (SELECT *, CASE WHEN clock LIKE '00%' OR (i = 1 AND CAST(clock[1:2] AS INT) BETWEEN 1 AND 11) THEN 1 ELSE 0 END late FROM p)
SELECT CAST(user_id AS VARCHAR) recording_id, event_id row_no, CAST(d + CAST(max(late) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INT) AS TIMESTAMP) + CAST(clock AS INTERVAL) ts FROM l""")
def psg_timestamps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), F.col("event_id").alias("row_no"), F.date_format("ts", "HH:mm:ss").alias("clock"), F.lit("2024-01-01").cast("date").alias("recording_date"))
    return S.psg_timestamps(rows).select("recording_id", "row_no", "ts")


def _days(spark, sf_dir):
    """A diary day per recording and date of its samples, in bed from 22:00 to 08:00."""
    at = samples(spark, sf_dir).select("recording_id", F.to_date("ts").alias("date")).distinct()
    day_id = F.datediff("date", F.lit("2023-01-01").cast("date")).cast("long") * 10 + F.col("recording_id").cast("long")
    clocks = {"sleep_time": 79_200, "sleep_duration": 81_000, "wake_time": 25_200, "get_up_time": 28_800}
    return at.select(day_id.alias("day_id"), F.col("recording_id").alias("subject"), "date", *[F.lit(v).alias(k) for k, v in clocks.items()])


def _recordings(spark, sf_dir):
    return samples(spark, sf_dir).select("recording_id", F.col("recording_id").alias("subject")).distinct()


BED = f"""{SAMPLES}, bed AS (SELECT DISTINCT date_diff('day', DATE '2023-01-01', CAST(ts AS DATE)) * 10 + CAST(recording_id AS BIGINT) day_id, recording_id, CAST(ts AS DATE) date, date_trunc('day', ts) + INTERVAL 22 HOUR t1,
 date_trunc('day', ts) + INTERVAL 22 HOUR + INTERVAL 30 MINUTE t2, date_trunc('day', ts) + INTERVAL 31 HOUR t3, date_trunc('day', ts) + INTERVAL 32 HOUR t4 FROM samples)"""


@query("j1_filter_in_bed", f"WITH {BED} SELECT s.recording_id, s.line_no FROM samples s WHERE EXISTS (SELECT 1 FROM bed b WHERE b.recording_id = s.recording_id AND s.ts > t1 - INTERVAL 30 MINUTE AND s.ts < t4 + INTERVAL 30 MINUTE)")
def filter_in_bed(spark, sf_dir):
    at = samples(spark, sf_dir).withColumn("subject", F.col("recording_id"))
    return E.filter_in_bed(at, N.night_bounds(_days(spark, sf_dir))).select("recording_id", "line_no")


@query("j2_psg_epochs", f"""WITH {SAMPLES}, p AS (SELECT recording_id, ts, CAST(line_no % 2 AS INT) sleep FROM samples)
SELECT s.recording_id, s.line_no, p.ts epoch, p.sleep FROM samples s JOIN p ON s.recording_id = p.recording_id AND s.ts >= p.ts AND s.ts < p.ts + INTERVAL 900 SECOND""")
def psg_epochs(spark, sf_dir):
    at = samples(spark, sf_dir)
    psg = at.select("recording_id", "ts", (F.col("line_no") % 2).cast("int").alias("sleep"))
    return E.psg_epochs(at, psg, 900).select("recording_id", "line_no", "epoch", "sleep")


@query("j3_match_days", f"WITH {BED} SELECT day_id, recording_id FROM bed")
def match_days(spark, sf_dir):
    return N.match_days_to_recordings(_days(spark, sf_dir), _recordings(spark, sf_dir), scored_epochs(spark, sf_dir)).select("day_id", "recording_id")


@query("j3_match_days_several", f"""WITH {BED}, b AS (SELECT *, CAST(CAST(recording_id AS INT) % 2 AS VARCHAR) subject FROM bed), r AS (SELECT DISTINCT recording_id, CAST(CAST(recording_id AS INT) % 2 AS VARCHAR) subject FROM samples)
SELECT day_id, min(r.recording_id) recording_id FROM b JOIN r USING (subject) WHERE EXISTS (SELECT 1 FROM samples s WHERE s.recording_id = r.recording_id AND s.ts BETWEEN t1 AND t4) GROUP BY day_id""")
def match_days_several(spark, sf_dir):
    half = lambda c: (F.col(c).cast("int") % 2).cast("string")
    return N.match_days_to_recordings(_days(spark, sf_dir).withColumn("subject", half("subject")), _recordings(spark, sf_dir).withColumn("subject", half("recording_id")), scored_epochs(spark, sf_dir)).select("day_id", "recording_id")


NIGHTLY = f"""{BED}, {EPOCHS}, e AS (SELECT b.day_id, b.recording_id, b.date, t1, t4, e.ts, CAST(score >= 0.5 AS INT) s FROM epochs e JOIN bed b ON e.recording_id = b.recording_id AND e.ts BETWEEN t1 AND t4),
o AS (SELECT *, min(ts) FILTER (s = 1) OVER (PARTITION BY day_id) a, max(ts) FILTER (s = 1) OVER (PARTITION BY day_id) z FROM e),
f AS (SELECT *, s - lag(s) OVER (PARTITION BY day_id ORDER BY ts) d FROM o WHERE ts BETWEEN a AND z)"""


@query("a6_night_metrics", f"""WITH {NIGHTLY} SELECT day_id, recording_id, any_value(date) date, any_value(a) sleep_onset, any_value(z) sleep_end, CAST(count(*) FILTER (s = 0) * 30 AS INT) waso, CAST(greatest(count(*) FILTER (d = -1) - 1, 0) AS INT) wb,
 CAST(any_value(epoch(t4 - t1)) AS INT) tib, CAST(floor(any_value(epoch(a - t1))) AS INT) sol, CAST(floor(any_value(epoch(t4 - z))) AS INT) wasf FROM f GROUP BY day_id, recording_id""")
def night_metrics(spark, sf_dir):
    days = N.match_days_to_recordings(_days(spark, sf_dir), _recordings(spark, sf_dir), scored_epochs(spark, sf_dir))
    return N.night_metrics(scored_epochs(spark, sf_dir), days).drop("subject", "awk5plus")


@query("w14_awk5plus", f"""WITH RECURSIVE {EPOCHS}, v AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ts) i, CAST(score >= 0.5 AS INT) s FROM epochs),
r AS (SELECT recording_id, 0::BIGINT i, 0 n, 0 wake, 0 sleep FROM (SELECT DISTINCT recording_id FROM v) UNION ALL
 SELECT r.recording_id, v.i, r.n + CASE WHEN s = 0 AND r.wake + 1 = 2 AND r.sleep >= 2 THEN 1 ELSE 0 END, CASE WHEN s = 0 THEN r.wake + 1 ELSE 0 END, CASE WHEN s = 0 AND r.wake + 1 = 2 AND r.sleep >= 2 THEN 0 ELSE r.sleep + CASE WHEN s = 0 THEN 0 ELSE 1 END END
 FROM r JOIN v ON v.recording_id = r.recording_id AND v.i = r.i + 1)
SELECT recording_id, CAST(arg_max(n, i) AS INT) awk5plus FROM r GROUP BY 1""")
def awk5plus(spark, sf_dir):
    return N.awk5plus(S.binarize_scores(scored_epochs(spark, sf_dir), ["recording_id"]), ["recording_id"], 2)


@query("a7_diary_metrics", f"WITH {SUBJECTS}, {DIARY_ROWS} SELECT day_id, tib, sol, waso, wasf, tst, wb, awk5plus, round(se, 6) se, round(sf, 6) sf, sol_norm, waso_norm, awk5plus_norm, se_norm, dtst FROM diary_rows")
def diary_metrics(spark, sf_dir):
    at = N.diary_metrics(diary(spark, sf_dir), intervals(spark, sf_dir), subjects(spark, sf_dir))
    return rounded(at.select("day_id", "tib", "sol", "waso", "wasf", "tst", "wb", "awk5plus", "se", "sf", "sol_norm", "waso_norm", "awk5plus_norm", "se_norm", "dtst"))


_M = list(D.METRICS)


@query("j7_night_dataset", f"""WITH {NIGHT_ROWS}, {DIARY_ROWS} SELECT n.night_id, n.subject, n.date, n.pPD, n.pMCI, n.HC, n.SA, {", ".join(f"round(n.{m}, 6) {m}" if m in ("se", "sf") else f"n.{m}" for m in _M)},
 {", ".join(f"round(d.{m}, 6) diary_{m}" if m in ("se", "sf") else f"d.{m} diary_{m}" for m in _M)} FROM night_rows n JOIN diary_rows d USING (day_id)""")
def night_dataset(spark, sf_dir):
    return rounded(D.night_dataset(nights(spark, sf_dir), diary(spark, sf_dir), intervals(spark, sf_dir), subjects(spark, sf_dir)))


@query("j7_diary_dataset", f"""WITH {SUBJECTS}, {DIARY_ROWS} SELECT subject, date, pPD, pMCI, HC, SA, {", ".join(f"round({m}, 6) {m}" if m in ("se", "sf") else m for m in _M)} FROM diary_rows""")
def diary_dataset(spark, sf_dir):
    return rounded(D.diary_dataset(diary(spark, sf_dir), intervals(spark, sf_dir), subjects(spark, sf_dir)))


@query("a8_subject_averages", f"""WITH {NIGHT_ROWS} SELECT subject, count(*) n, {", ".join(f"round(avg({m}), 6) avg_{m}" for m in _M)} FROM night_rows GROUP BY subject""")
def subject_averages(spark, sf_dir):
    return rounded(D.subject_averages(D.night_rows(nights(spark, sf_dir), subjects(spark, sf_dir))))


@query("a8_clinic_averages", f"""WITH {NIGHT_ROWS}, {DIARY_ROWS} SELECT n.subject, {", ".join(f"round(avg(n.{m}), 6) avg_{m}, round(avg(d.{m}), 6) avg_diary_{m}" for m in _M)} FROM night_rows n JOIN diary_rows d USING (day_id) GROUP BY n.subject""")
def clinic_averages(spark, sf_dir):
    return rounded(D.clinic_averages(D.night_dataset(nights(spark, sf_dir), diary(spark, sf_dir), intervals(spark, sf_dir), subjects(spark, sf_dir))))


@query("a9_overall_norms", f"""WITH {NIGHT_ROWS} SELECT subject, {", ".join(f"round(avg({m}), 6) avg_{m}, CAST(round_even(avg({m}), 0) AS INT) {m}" for m in _M if m.endswith("_norm"))} FROM night_rows GROUP BY subject""")
def overall_norms(spark, sf_dir):
    return rounded(D.overall_norms(D.night_rows(nights(spark, sf_dir), subjects(spark, sf_dir))))


def _recording_flags(spark, sf_dir):
    return nights(spark, sf_dir).select("recording_id").distinct().withColumn("training_data", F.col("recording_id").cast("int") % 3 == 0)


@query("a27_night_counts", f"WITH {NIGHTS} SELECT subject, count(*) nights, count(*) = 7 complete FROM nights WHERE CAST(recording_id AS INT) % 3 <> 0 GROUP BY subject")
def night_counts(spark, sf_dir):
    return D.night_counts(nights(spark, sf_dir), _recording_flags(spark, sf_dir))


@query("j14_training_subjects", f"WITH {SUBJECTS} SELECT code FROM subjects WHERE CAST(code AS BIGINT) % 50 % 3 = 0")
def training_subjects(spark, sf_dir):
    recordings = subjects(spark, sf_dir).select((F.col("code").cast("long") % 50).cast("string").alias("recording_id"), F.col("code").alias("subject"), (F.col("code").cast("long") % 50 % 3 == 0).alias("training_data"))
    return M.training_subjects(subjects(spark, sf_dir), recordings).select("code")


def _algorithmic(spark, sf_dir):
    """A night of the algorithm for each order, some hours off, so some nights get several of them and some none."""
    n = nights(spark, sf_dir)
    k = F.col("night_id")
    shift = F.make_dt_interval(secs=(k * 977 % 200_000 - 100_000).cast("decimal(18,6)"))
    return n.select(k.alias("algorithmic_id"), "recording_id", "subject", (F.col("sleep_onset") + shift).alias("sleep_onset"), (1 + k % 7).cast("int").alias("day_no"), (k % 24).cast("double").alias("available_hours"), (80 + k % 21).cast("int").alias("se"))


ALGORITHMIC = f"{NIGHTS}, alg AS (SELECT night_id algorithmic_id, recording_id, subject, sleep_onset + to_seconds(night_id * 977 % 200000 - 100000) sleep_onset, CAST(1 + night_id % 7 AS INT) day_no, CAST(night_id % 24 AS DOUBLE) available_hours, CAST(80 + night_id % 21 AS INT) se FROM nights)"
MATCHED = f"""{ALGORITHMIC}, near AS (SELECT a.*, n.night_id, row_number() OVER (PARTITION BY algorithmic_id ORDER BY abs(epoch_us(n.sleep_onset) - epoch_us(a.sleep_onset)), n.sleep_onset DESC, n.night_id) i FROM alg a JOIN nights n ON a.recording_id = n.recording_id),
matched AS (SELECT * EXCLUDE (i) FROM near WHERE i = 1)"""


@query("j4_nearest_night", f"WITH {MATCHED} SELECT algorithmic_id, night_id FROM matched")
def nearest_night(spark, sf_dir):
    return M.match_nearest_night(_algorithmic(spark, sf_dir), nights(spark, sf_dir)).select("algorithmic_id", "night_id")


@query("j5_dedupe_match", f"WITH {MATCHED}, d AS (SELECT *, row_number() OVER (PARTITION BY night_id ORDER BY sleep_onset, day_no) i FROM matched WHERE NOT (day_no = 1 AND available_hours < 12)) SELECT night_id, sleep_onset FROM d WHERE i = 1")
def dedupe_match(spark, sf_dir):
    return M.dedupe_night_match(M.match_nearest_night(_algorithmic(spark, sf_dir), nights(spark, sf_dir))).select("night_id", "sleep_onset")


@query("j12_match_report", f"""WITH {MATCHED} SELECT 'several' issue, night_id, count(*) n FROM matched GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'none', night_id, 0 FROM nights WHERE night_id NOT IN (SELECT night_id FROM matched)
UNION ALL SELECT 'se_100', night_id, count(*) FROM matched WHERE se = 100 GROUP BY night_id""")
def match_report(spark, sf_dir):
    return M.match_report(nights(spark, sf_dir), M.match_nearest_night(_algorithmic(spark, sf_dir), nights(spark, sf_dir)))


def _sleep_nights(spark, sf_dir):
    """One window a recording and date, from 21:00 for 12 hours, and one from 02:00 for 8."""
    at = samples(spark, sf_dir).select("recording_id", F.to_date("ts").cast("timestamp_ntz").alias("d")).distinct()
    both = F.array(*[F.struct(F.lit(i).alias("k"), (F.col("d") + F.expr(f"INTERVAL {a} HOURS")).alias("sleep_onset"), (F.col("d") + F.expr(f"INTERVAL {b} HOURS")).alias("sleep_end")) for i, a, b in ((0, 21, 33), (1, 2, 10))])
    return at.select("recording_id", "d", F.inline(both)).select("recording_id", (F.datediff("d", F.lit("2023-01-01").cast("date")).cast("long") * 20 + F.col("recording_id").cast("long") * 2 + F.col("k")).alias("night_id"), "sleep_onset", "sleep_end")


@query("j6_night_activity", f"""WITH {SAMPLES}, d AS (SELECT DISTINCT recording_id, date_trunc('day', ts) d FROM samples),
n AS (SELECT recording_id, date_diff('day', DATE '2023-01-01', CAST(d AS DATE)) * 20 + CAST(recording_id AS BIGINT) * 2 + k night_id, d + to_hours(a) sleep_onset, d + to_hours(b) sleep_end FROM d, (VALUES (0, 21, 33), (1, 2, 10)) v(k, a, b)),
j AS (SELECT s.recording_id, s.line_no, n.night_id, date_diff('day', DATE '2023-12-31', CAST(s.ts - INTERVAL 12 HOUR AS DATE)) day_no, n.sleep_onset FROM samples s JOIN n ON s.recording_id = n.recording_id AND s.ts BETWEEN n.sleep_onset AND n.sleep_end),
r AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id, day_no ORDER BY sleep_onset, night_id) i FROM j) SELECT recording_id, line_no, night_id, CAST(day_no + 1 AS INT) day_index FROM r WHERE i = 1""")
def night_activity(spark, sf_dir):
    day = F.datediff(F.to_date(F.col("ts") - F.expr("INTERVAL 12 HOURS")), F.lit("2023-12-31").cast("date"))
    return M.night_activity(samples(spark, sf_dir).withColumn("day_no", day), _sleep_nights(spark, sf_dir)).select("recording_id", "line_no", "night_id", "day_index")


@query("j13_algorithmic_nights", f"""WITH {NIGHTS}, r AS (SELECT recording_id, CAST(1 + night_id % 7 AS INT) day_no, min(night_id) k, min(sleep_onset) rest_start, min(sleep_end) rest_end FROM nights GROUP BY ALL)
SELECT recording_id, recording_id subject, day_no, rest_start sleep_onset, rest_end sleep_end, CAST(k % 60 AS INT) sol, CAST(k % 90 AS INT) waso, CAST(k % 400 AS INT) tst, CAST(k % 9 AS INT) wb, CAST(k % 5 AS INT) awk5plus, CAST(k % 100 AS INT) se FROM r""")
def algorithmic_nights(spark, sf_dir):
    n = nights(spark, sf_dir)
    rest = n.groupBy("recording_id", (1 + F.col("night_id") % 7).cast("int").alias("day_no")).agg(F.min("night_id").alias("k"), F.min("sleep_onset").alias("rest_start"), F.min("sleep_end").alias("rest_end")).withColumn("available_hours", F.lit(24.0))
    part = lambda m: (F.col("k") % m).cast("int")
    ends = rest.select("recording_id", "day_no", part(60).alias("sleep_onset_latency"), part(90).alias("waso"), part(400).alias("total_sleep_time"), part(9).alias("number_wake_bouts"), part(5).alias("number_wake_bouts_5min"), part(100).alias("percent_time_asleep"))
    own = n.select("recording_id", F.col("recording_id").alias("subject")).distinct()
    return M.algorithmic_nights(rest.drop("k"), ends, own).select("recording_id", "subject", "day_no", "sleep_onset", "sleep_end", "sol", "waso", "tst", "wb", "awk5plus", "se")


def _features(spark, sf_dir, key):
    """Three feature rows a night."""
    k = F.col("night_id")
    return nights(spark, sf_dir).select(k.alias(key), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("day_index"), k.alias("_k")).select(key, "day_index", (F.col("_k") * 31 % 1000 / 10 + F.col("day_index")).alias("mean"))


@query("j8_night_activity_dataset", f"WITH {NIGHT_ROWS} SELECT night_id, tst, i.day_index, round(night_id * 31 % 1000 / 10 + i.day_index, 6) mean FROM night_rows, (SELECT unnest([1, 2, 3]) day_index) i")
def activity_dataset(spark, sf_dir):
    base = D.night_dataset(nights(spark, sf_dir), diary(spark, sf_dir), intervals(spark, sf_dir), subjects(spark, sf_dir))
    return rounded(D.night_activity_dataset(base, _features(spark, sf_dir, "night_id")).select("night_id", "tst", "day_index", "mean"))


@query("j8_night_algorithmic_dataset", f"WITH {MATCHED} SELECT algorithmic_id, night_id, se algorithmic_se, 1 day_index, round(algorithmic_id * 31 % 1000 / 10 + 1, 6) mean FROM matched WHERE night_id IN (SELECT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders) AND subject IS NOT NULL")
def algorithmic_dataset(spark, sf_dir):
    base = D.night_dataset(nights(spark, sf_dir), diary(spark, sf_dir), intervals(spark, sf_dir), subjects(spark, sf_dir))
    alg = M.match_nearest_night(_algorithmic(spark, sf_dir), nights(spark, sf_dir))
    return rounded(D.night_algorithmic_dataset(base, alg, _features(spark, sf_dir, "algorithmic_id")).select("algorithmic_id", "night_id", "algorithmic_se", "day_index", "mean"))


TRUTH = f"""{BED}, {EPOCHS}, w AS (SELECT day_id, t2 + INTERVAL 2 HOUR a, t2 + INTERVAL 3 HOUR z FROM bed),
truth AS (SELECT b.day_id, e.line_no, e.score, CASE WHEN e.ts BETWEEN t1 AND t2 OR e.ts BETWEEN t3 AND t4 OR (w.day_id IS NOT NULL AND e.ts BETWEEN a AND z) THEN 0 ELSE 1 END truth FROM epochs e JOIN bed b ON e.recording_id = b.recording_id AND e.ts BETWEEN t1 AND t4 LEFT JOIN w ON w.day_id = b.day_id)"""


def _truth(spark, sf_dir):
    days = _days(spark, sf_dir)
    matched = N.match_days_to_recordings(days, _recordings(spark, sf_dir), scored_epochs(spark, sf_dir))
    wakes = days.select("day_id", F.lit(1800).alias("start"), F.lit(5400).alias("end"))
    return V.diary_truth(scored_epochs(spark, sf_dir), matched, days, wakes)


@query("j9_diary_truth", f"WITH {TRUTH} SELECT day_id, line_no, truth FROM truth")
def diary_truth(spark, sf_dir):
    return _truth(spark, sf_dir).select("day_id", "line_no", "truth")


@query("a10_threshold_sweep", f"""WITH {TRUTH}, c AS (SELECT threshold, count(*) FILTER (truth = 1 AND score >= threshold) tp, count(*) FILTER (truth = 0 AND score >= threshold) fp, count(*) FILTER (truth = 0 AND score < threshold) tn, count(*) FILTER (truth = 1 AND score < threshold) fn
 FROM truth, (SELECT i / 10 threshold FROM range(1, 11) t(i)) GROUP BY 1), r AS (SELECT *, 100 * (tp + tn) / (tp + tn + fp + fn)::DOUBLE acc, CASE WHEN tp + fn > 0 THEN 100 * tp / (tp + fn)::DOUBLE END sen, CASE WHEN tn + fp > 0 THEN 100 * tn / (tn + fp)::DOUBLE END spe FROM c)
SELECT threshold, tp, fp, tn, fn, round(acc, 6) acc, round(sen, 6) sen, round(spe, 6) spe, (SELECT count(DISTINCT day_id) FROM truth) nights, row_number() OVER (ORDER BY acc DESC NULLS LAST, threshold) = 1 best FROM r""")
def threshold_sweep(spark, sf_dir):
    return rounded(V.diary_threshold_sweep(_truth(spark, sf_dir)))


# --- reshapes ---------------------------------------------------------------------------------------------------------


def _wide(spark, sf_dir):
    """Each customer's days as wide sheets of texts."""
    d = diary(spark, sf_dir).withColumns({c: (F.col("day_id") % m).cast("int") for c, m in (("day_sleep_count", 3), ("alcohol_count", 4), ("caffeine_count", 5), ("sleep_quality", 5), ("rest_quality", 5), ("wake_count", 6))})
    clocks = {c: F.col("sleep_time") for c in ("day_sleep_time", "alcohol_time", "caffeine_time")}
    return d.withColumns(clocks | {"sleeping_pill": F.col("day_id") % 2 == 0, "note": F.lit("n")})


@query("r3_diary_to_wide", f"""WITH {DIARY}, i AS (SELECT l_orderkey day_id, CAST(l_partkey * 53 % 14400 AS INT) a, CAST((l_partkey * 53 % 14400 + l_linenumber * 200 - 100 + 86400) % 86400 AS INT) b FROM lineitem),
s AS (SELECT day_id, string_agg('; ' || printf('%02d:%02d', a // 3600, a // 60 % 60) || '-' || printf('%02d:%02d', b // 3600, b // 60 % 60), '' ORDER BY a, b) w FROM i GROUP BY 1),
n AS (SELECT t.*, w, row_number() OVER (PARTITION BY subject ORDER BY date, day_id) i FROM timeline t LEFT JOIN s USING (day_id))
SELECT subject AS "#personalID", CAST((i - 1) // 7 AS INT) AS sheet, {", ".join(f'''max(CASE WHEN (i - 1) % 7 = {k - 1} THEN CAST(date AS VARCHAR) END) AS "day{k}-date", max(CASE WHEN (i - 1) % 7 = {k - 1} THEN printf('%02d:%02d', sleep_time // 3600, sleep_time // 60 % 60) END) AS "day{k}-5", max(CASE WHEN (i - 1) % 7 = {k - 1} THEN CAST(day_id % 6 AS VARCHAR) || coalesce(w, '') END) AS "day{k}-7"''' for k in range(1, 8))} FROM n GROUP BY subject, (i - 1) // 7""")
def diary_to_wide(spark, sf_dir):
    wide = D.diary_to_wide(_wide(spark, sf_dir), intervals(spark, sf_dir))
    return wide.select(F.col("`#personalID`"), "sheet", *[F.col(f"`day{i}-{f}`") for i in range(1, 8) for f in ("date", "5", "7")])


@query("r1_diary_from_wide", f"""WITH {DIARY}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY date, day_id) i FROM timeline)
SELECT subject, CAST(i AS INT) AS day, date, CAST(day_id % 3 AS INT) day_sleep_count, CAST(sleep_time // 60 * 60 AS INT) sleep_time, CAST((sleep_time // 60 * 60 + epoch(t2 - t1) % 86400 + 86400) % 86400 AS INT) sleep_duration, CAST(wake_time // 60 * 60 AS INT) wake_time,
 CAST((wake_time // 60 * 60 + epoch(t4 - t3) % 86400) % 86400 AS INT) get_up_time FROM n""")
def diary_from_wide(spark, sf_dir):
    wide = D.diary_to_wide(_wide(spark, sf_dir), intervals(spark, sf_dir))
    return D.diary_from_wide(wide).select("subject", "day", "date", "day_sleep_count", "sleep_time", "sleep_duration", "wake_time", "get_up_time")


@query("r2_wake_strings", """WITH i AS (SELECT l_orderkey day_id, CAST(l_partkey * 53 % 14400 AS INT) // 60 a, CAST((l_partkey * 53 % 14400 + l_linenumber * 200 - 100 + 86400) % 86400 AS INT) // 60 b, l_partkey * 53 % 14400 s, (l_partkey * 53 % 14400 + l_linenumber * 200 - 100 + 86400) % 86400 e FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
r AS (SELECT *, row_number() OVER (PARTITION BY day_id, a ORDER BY s DESC, e DESC) k FROM i) SELECT day_id, CAST(a * 60 AS INT) AS "start", CAST(b * 60 AS INT) AS "end", CAST(day_id % 6 AS INT) wake_count FROM r WHERE k = 1""")
def wake_strings(spark, sf_dir):
    spans = intervals(spark, sf_dir).groupBy("day_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: F.concat(F.lit("; "), D.clock(x["start"]), F.lit("-"), D.clock(x["end"]))), "")
    days = diary(spark, sf_dir).join(spans, "day_id").select("day_id", F.concat((F.col("day_id") % 6).cast("string"), text).alias("wakes"))
    return D.parse_wake_intervals(days, ["day_id"]).join(days.select("day_id", D.wake_count().alias("wake_count")), "day_id")
