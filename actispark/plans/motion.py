"""Queries over samples: scalars, days, epochs, windows, wear, rest, sleep and wake."""

from __future__ import annotations

from pyspark.sql import functions as F

from actispark.functions import scalars as S
from actispark.operators import epochs as E
from actispark.operators import rest, signal, sleepwake, wear
from actispark.plans.base import SAMPLES, query, rounded, samples

NOON = "date_trunc('day', ts - INTERVAL 12 HOUR) + INTERVAL 12 HOUR"
FS = 0.0002  # rows a second: the tables hold some tens of rows a recording and day
DAYS = f"""{SAMPLES}, noons AS (SELECT recording_id, {NOON} noon, count(*) n FROM samples GROUP BY ALL HAVING count(*) / ({FS} * 3600) >= 6),
days AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY noon) day_no FROM noons),
rows AS (SELECT s.*, d.n day_rows, CAST(d.day_no AS INT) day_no FROM samples s JOIN days d ON s.recording_id = d.recording_id AND {NOON} = d.noon)"""


def days(spark, sf_dir):
    return E.noon_days(samples(spark, sf_dir), FS)


@query("noon_day_profile", f"""WITH {SAMPLES}, d AS (SELECT *, {NOON} noon, sqrt(x*x+y*y+z*z) m FROM samples)
SELECT recording_id, noon, count(*) n, round(avg(m), 6) mean_magnitude, round(stddev_samp(m), 6) sd_magnitude, round(min(m), 6) min_magnitude, round(max(m), 6) max_magnitude,
 round(quantile_cont(m, 0.9), 6) p90_magnitude FROM d GROUP BY ALL""")  # fmt: skip
def noon_day_profile(spark, sf_dir):
    m = S.magnitude()
    at = E.with_noon(samples(spark, sf_dir))
    return rounded(at.groupBy("recording_id", "noon").agg(F.count("*").alias("n"), *[e.alias(f"{k}_magnitude") for k, e in (("mean", F.avg(m)), ("sd", F.stddev_samp(m)), ("min", F.min(m)), ("max", F.max(m)), ("p90", F.percentile(m, F.lit(0.9))))]))


@query("p1_p2_motion", f"""WITH {SAMPLES} SELECT recording_id, line_no, round(sqrt(x*x+y*y+z*z), 6) magnitude, round(CASE WHEN sqrt(x*x+y*y) = 0 THEN 0 ELSE degrees(atan(z / sqrt(x*x+y*y))) END, 6) angle FROM samples""")
def motion(spark, sf_dir):
    return rounded(samples(spark, sf_dir).select("recording_id", "line_no", S.magnitude().alias("magnitude"), S.z_angle().alias("angle")))


@query("p18_tkeo", f"""WITH {SAMPLES} SELECT recording_id, line_no, round(coalesce(x*x - abs(lead(x) OVER w * lag(x) OVER w), 0), 9) tkeo FROM samples WINDOW w AS (PARTITION BY recording_id, {NOON} ORDER BY ts, line_no)""")
def tkeo(spark, sf_dir):
    at = S.tkeo(E.with_noon(samples(spark, sf_dir)), ["recording_id", "noon"], ["ts", "line_no"], "x")
    return rounded(at.select("recording_id", "line_no", "tkeo"), 9)


@query("s4_recording_start", f"WITH {SAMPLES} SELECT recording_id, min(ts) AS \"start\" FROM samples GROUP BY 1")
def recording_start(spark, sf_dir):
    from actispark.sources.readers import recording_start as start

    return start(samples(spark, sf_dir))


@query("w1_assign_epochs", f"""WITH {SAMPLES}, s AS (SELECT *, min(ts) OVER (PARTITION BY recording_id) s0 FROM samples)
SELECT recording_id, line_no, s0 + to_microseconds((epoch_us(ts) - epoch_us(s0)) // 21600000000 * 21600000000 + 15000000) epoch FROM s""")  # fmt: skip
def assign_epochs(spark, sf_dir):
    return E.assign_epochs(samples(spark, sf_dir), 21_600, ["recording_id"], 15).select("recording_id", "line_no", "epoch")


@query("w1_reanchored_epochs", f"""WITH RECURSIVE {SAMPLES}, s AS (SELECT recording_id, line_no, ts, row_number() OVER (PARTITION BY recording_id ORDER BY ts, line_no) i FROM samples), a AS (SELECT recording_id, ts, min(i) i FROM s GROUP BY ALL),
e AS (SELECT s.recording_id, s.i, s.ts, a.i + 1 AS nxt FROM s ASOF LEFT JOIN a ON a.recording_id = s.recording_id AND a.ts >= s.ts + INTERVAL 6 HOUR),
r AS (SELECT recording_id, i, ts, nxt FROM e WHERE i = 1 UNION ALL SELECT e.recording_id, e.i, e.ts, e.nxt FROM r JOIN e ON e.recording_id = r.recording_id AND e.i = r.nxt)
SELECT s.recording_id, s.line_no, r.ts + INTERVAL 15 SECOND epoch FROM s ASOF JOIN r ON r.recording_id = s.recording_id AND r.i <= s.i""")
def reanchored_epochs(spark, sf_dir):
    return E.reanchored_epochs(samples(spark, sf_dir), 21_600, "recording_id", 15, chunk_hours=12).select("recording_id", "line_no", "epoch")


@query("w2_decimate", f"""WITH {DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, day_no ORDER BY ts, line_no) - 1 i FROM rows) SELECT recording_id, day_no, line_no FROM r WHERE i % 3 = 0""")
def decimate(spark, sf_dir):
    return E.decimate(days(spark, sf_dir), ["recording_id", "day_no"], 3).select("recording_id", "day_no", "line_no")


@query("w3_noon_days", f"WITH {DAYS} SELECT recording_id, day_no, line_no, day_rows FROM rows")
def noon_days(spark, sf_dir):
    return days(spark, sf_dir).select("recording_id", "day_no", "line_no", "day_rows")


@query("w4_sample_windows", f"""WITH {DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, day_no ORDER BY ts, line_no) - 1 i, count(*) OVER (PARTITION BY recording_id, day_no) c FROM rows)
SELECT recording_id, day_no, CAST(i // 8 AS INT) window_no, count(*) n, round(avg(x), 9) mean_x FROM r WHERE i // 8 * 8 < c - 8 GROUP BY ALL""")  # fmt: skip
def sample_windows(spark, sf_dir):
    at = E.sample_windows(days(spark, sf_dir), 8)
    return rounded(at.groupBy("recording_id", "day_no", "window_no").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x")), 9)  # means of eight values with four digits end before the ninth


@query("a3_majority_label", f"""WITH {SAMPLES} SELECT recording_id, {NOON} noon, CAST(sum(CAST(temp > 25 AS INT)) > count(*) - sum(CAST(temp > 25 AS INT)) AS INT) AS label FROM samples GROUP BY ALL""")
def majority_label(spark, sf_dir):
    at = E.with_noon(samples(spark, sf_dir)).withColumn("sleep", (F.col("temp") > 25).cast("int"))
    return E.majority_label(at, ["recording_id", "noon"])


def _statistics_sql(names: tuple[int, ...], night: bool, prefix: str) -> str:
    """The SQL of a vector's statistics, over v (in order) and s (sorted) and plain aggregates."""
    d = lambda a, b: f"CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / {b} END"
    q = lambda p: f"q[{(*E.PERCENTILES, 50).index(p) + 1}]"
    span = "abs(hi - lo)"
    out = {
        "MAX": "hi", "MIN": "lo", "RELATIVE POSITION OF MAX": d("list_position(v, hi) - 1", "n"), "RELATIVE POSITION OF MIN": d("list_position(v, lo) - 1", "n"), "RANGE": span, "RELATIVE RANGE": d(span, "hi"),
        "RELATIVE VARIATION RANGE": d(span, "mean"), "INTERQUARTILE RANGE": f"{q(75)} - {q(25)}", "RELATIVE INTERQUARTILE RANGE": d(f"({q(75)} - {q(25)})", "hi"), "INTERDECILE RANGE": f"{q(90)} - {q(10)}",
        "RELATIVE INTERDECILE RANGE": d(f"({q(90)} - {q(10)})", "hi"), "INTERPERCENTILE RANGE": f"{q(99)} - {q(1)}", "RELATIVE INTERPERCENTILE RANGE": d(f"({q(99)} - {q(1)})", "hi"), "STUDENTIZED RANGE": d(span, "var"), "MEAN": "mean",
    }
    if night:
        out["HARMONIC MEAN"] = "CASE WHEN list_bool_or(list_transform(v, lambda x: x < 0)) THEN NULL WHEN list_bool_or(list_transform(v, lambda x: x = 0)) THEN 0 ELSE n / list_sum(list_transform(v, lambda x: 1 / x)) END"
    out |= {f"MEAN EXCLUDING OUTLIERS ({p})": f"list_avg(s[CAST(floor(n * ({p} / 100)) AS BIGINT) + 1 : n - CAST(floor(n * ({p} / 100)) AS BIGINT)])" for p in E.TRIMS}
    out |= {
        "MEDIAN": q(50), "MODE": "md", "VARIANCE": "var", "STANDARD DEVIATION": "sd", "MEDIAN ABSOLUTE DEVIATION": "mad", "RELATIVE STANDARD DEVIATION": d("sd", "mean"), "INDEX OF DISPERSION": d("var", "mean"),
        "KURTOSIS": "CASE WHEN var > 0 THEN kurt END", "SKEWNESS": "CASE WHEN var > 0 THEN skew END", "PEARSONS 1ST": d("3 * (mean - md)", "sd"), "PEARSONS 2ND": d(f"3 * (mean - {q(50)})", "sd"),
    }
    out |= {f"PERCENTILE {p}": q(p) for p in names}
    if night:
        out["ENTROPY"] = "-list_sum(list_transform(v, lambda x: CASE WHEN x / list_sum(v) > 0 THEN x / list_sum(v) * ln(x / list_sum(v)) ELSE 0 END))"
        out["MODULATION"] = d(span, "(hi + lo)")
    return ",\n ".join(f'round(CASE WHEN n > 1 THEN {x} END, 6) AS "{prefix} | {k}"' for k, x in out.items())


def _vector_ctes(value: str, night: bool, prefix: str = "V", t: str = "") -> str:
    """CTEs over samples that end in h{t}: the statistics of value by recording and noon-to-noon day."""
    names = E.NIGHT_PERCENTILES if night else E.PERCENTILES
    return f"""a{t} AS (SELECT recording_id, {NOON} noon, ts, line_no, {value} v FROM samples),
ranked{t} AS (SELECT *, count(*) OVER (PARTITION BY recording_id, noon, v) c, min(row_number) OVER (PARTITION BY recording_id, noon, v) f FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, noon ORDER BY ts, line_no) AS row_number FROM a{t})),
g{t} AS (SELECT recording_id, noon, count(v) n, min(v) lo, max(v) hi, avg(v) mean, var_samp(v) var, stddev_samp(v) sd, kurtosis_pop(v) kurt, mad(v) mad, list(v ORDER BY ts, line_no) v, list_sort(list(v)) s, arg_min(v, c * -1000000 + f) md,
 quantile_cont(v, [{", ".join(str(p / 100) for p in (*E.PERCENTILES, 50))}]) q FROM ranked{t} GROUP BY recording_id, noon),
m{t} AS (SELECT *, list_avg(list_transform(v, lambda x: (x - mean) ** 3)) / (list_avg(list_transform(v, lambda x: (x - mean) ** 2)) ** 1.5) skew FROM g{t}),
h{t} AS (SELECT recording_id, noon, {_statistics_sql(names, night, prefix)} FROM m{t})"""


ANGLE = "CASE WHEN sqrt(x*x+y*y) = 0 THEN 0 ELSE degrees(atan(z / sqrt(x*x+y*y))) END"


@query("a1_epoch_features", f"WITH {SAMPLES}, {_vector_ctes('sqrt(x*x+y*y+z*z)', False)} SELECT * FROM h")
def epoch_features(spark, sf_dir):
    at = E.with_noon(samples(spark, sf_dir)).withColumn("m", S.magnitude())
    return rounded(E.vector_features(at, ["recording_id", "noon"], {"V": "m"}))


@query("a1_epoch_features_all", f"""WITH {SAMPLES}, {_vector_ctes("sqrt(x*x+y*y+z*z)", False, "MAGNITUDE", "1")}, {_vector_ctes(ANGLE, False, "Z_ANGLE", "2")}, {_vector_ctes("sqrt(temp)", False, "TEMPERATURE", "3")}
SELECT * FROM h1 JOIN h2 USING (recording_id, noon) JOIN h3 USING (recording_id, noon)""")
def epoch_features_all(spark, sf_dir):
    at = E.with_noon(samples(spark, sf_dir)).withColumn("temp", F.sqrt("temp"))  # means of decimals would end in halves where they are rounded
    return rounded(E.epoch_features(at, ["recording_id", "noon"]))


@query("a2_night_signal_features", f"WITH {SAMPLES}, {_vector_ctes('sqrt(x*x+y*y+z*z)', True)} SELECT * FROM h")
def night_features(spark, sf_dir):
    at = E.with_noon(samples(spark, sf_dir)).withColumn("a", S.magnitude())
    return rounded(E.vector_features(at, ["recording_id", "noon"], {"V": "a"}, night=True))


@query("a2_night_features_with_energy", f"""WITH {SAMPLES}, {_vector_ctes("sqrt(x*x+y*y+z*z)", True, "ACTIVITY")}, tk AS (SELECT recording_id, {NOON} noon, coalesce(v*v - abs(lead(v) OVER w * lag(v) OVER w), 0) t FROM (SELECT *, sqrt(x*x+y*y+z*z) v FROM samples) WINDOW w AS (PARTITION BY recording_id, {NOON} ORDER BY ts, line_no)),
e AS (SELECT recording_id, noon, round(CASE WHEN count(*) > 1 THEN max(t) END, 6) AS "ACTIVITY | TKEO MAX", round(CASE WHEN count(*) > 1 THEN min(t) END, 6) AS "ACTIVITY | TKEO MIN" FROM tk GROUP BY 1, 2) SELECT * FROM h JOIN e USING (recording_id, noon)""")
def night_features_energy(spark, sf_dir):
    at = E.with_noon(samples(spark, sf_dir)).withColumn("v", S.magnitude())
    return rounded(signal.night_signal_features(at, ["recording_id", "noon"], "v", ("ts", "line_no")))


@query("a4_activity_index")
def activity_index(spark, sf_dir):
    return signal.activity_index(days(spark, sf_dir), 25.0, 0.6)


WEAR = f"""{DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, day_no ORDER BY ts, line_no) - 1 i, count(*) OVER (PARTITION BY recording_id, day_no) c FROM rows),
p AS (SELECT *, i // 4 k FROM r), st AS (SELECT DISTINCT recording_id, day_no, k, c FROM p WHERE k * 4 < c - 4), t AS (SELECT recording_id, day_no, k, min(ts) ts FROM p GROUP BY ALL),
h AS (SELECT st.recording_id, st.day_no, st.k, CAST(stddev_samp(x) >= 0.013 AS INT) + CAST(stddev_samp(y) >= 0.013 AS INT) + CAST(stddev_samp(z) >= 0.013 AS INT) sd, CAST(max(x) - min(x) >= 0.15 AS INT) + CAST(max(y) - min(y) >= 0.15 AS INT) + CAST(max(z) - min(z) >= 0.15 AS INT) ra
 FROM st JOIN p ON p.recording_id = st.recording_id AND p.day_no = st.day_no AND p.k BETWEEN st.k AND st.k + 3 GROUP BY ALL),
worn AS (SELECT recording_id, day_no, ts, CAST(sd >= 2 AND ra >= 2 AS INT) wear FROM h JOIN t USING (recording_id, day_no, k))"""


@query("w5_wear_detection", f"WITH {WEAR} SELECT * FROM worn")
def wear_detection(spark, sf_dir):
    return wear.wear_detection(days(spark, sf_dir), 4 / 900)


def _flagged(spark, sf_dir):
    """Samples of a day with a flag that changes now and then."""
    return days(spark, sf_dir).select("recording_id", "day_no", "ts", "line_no", ((F.col("line_no") * 7919 % 101) < 70).cast("int").alias("wear"))


FLAGGED = f"{DAYS}, flagged AS (SELECT recording_id, day_no, ts, line_no, CAST(line_no * 7919 % 101 < 70 AS INT) wear FROM rows)"


@query("w6_islands", f"""WITH {FLAGGED}, c AS (SELECT *, CASE WHEN lag(wear) OVER w IS DISTINCT FROM wear THEN 1 ELSE 0 END ch FROM flagged WINDOW w AS (PARTITION BY recording_id, day_no ORDER BY ts))
SELECT recording_id, day_no, line_no, CAST(sum(ch) OVER (PARTITION BY recording_id, day_no ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM c""")  # fmt: skip
def islands(spark, sf_dir):
    return wear.islands(_flagged(spark, sf_dir), ["recording_id", "day_no"], ["ts"], "wear").select("recording_id", "day_no", "line_no", "block")


_RUNS = """SELECT *, sum(ch) OVER (PARTITION BY recording_id, day_no ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM (SELECT *, CASE WHEN lag(wear) OVER (PARTITION BY recording_id, day_no ORDER BY ts) IS DISTINCT FROM wear THEN 1 ELSE 0 END ch FROM {})"""
INNER, LAST = "(n * 0.25 < 3 AND n / (p + q) < 0.8) OR (n * 0.25 < 6 AND n / (p + q) < 0.3)", "day_no = last_day AND n * 0.25 < 3 AND p * 0.25 >= 1"


def _rescored_sql(source: str, out: str, rule: str = INNER) -> str:
    """CTEs that give out: source with the worn runs that rule picks set to 0."""
    return f"""{out}_r AS ({_RUNS.format(source)}), {out}_k AS (SELECT recording_id, day_no, b, count(*) n, any_value(wear) v FROM {out}_r GROUP BY ALL),
{out}_o AS (SELECT *, lag(n) OVER w p, lead(n) OVER w q, max(day_no) OVER (PARTITION BY recording_id) last_day FROM {out}_k WINDOW w AS (PARTITION BY recording_id, day_no ORDER BY b)),
{out} AS (SELECT r.recording_id, r.day_no, r.ts, CASE WHEN v = 1 AND ({rule}) THEN 0 ELSE wear END wear FROM {out}_r r JOIN {out}_o USING (recording_id, day_no, b))"""


@query("w7_rescore_wear", f"WITH {FLAGGED}, {_rescored_sql('flagged', 'w1')} SELECT * FROM w1")
def rescore_wear(spark, sf_dir):
    return wear.rescore_wear(_flagged(spark, sf_dir), passes=1, last_day=False, order=E.ORDER).select("recording_id", "day_no", "ts", "wear")


@query("w7_rescore_wear_last_day", f"WITH {FLAGGED}, {_rescored_sql('flagged', 'w1')}, {_rescored_sql('w1', 'w2')}, {_rescored_sql('w2', 'w3')}, {_rescored_sql('w3', 'w4', LAST)} SELECT * FROM w4")
def rescore_wear_full(spark, sf_dir):
    return wear.rescore_wear(_flagged(spark, sf_dir), order=E.ORDER).select("recording_id", "day_no", "ts", "wear")


def _bins(spark, sf_dir):
    """Angle and temperature a row, on the grid of the rows."""
    return days(spark, sf_dir).select("recording_id", "day_no", "ts", S.z_angle().alias("angle"), "temp")


BINS = f"{DAYS}, bins AS (SELECT recording_id, day_no, ts, CASE WHEN sqrt(x*x+y*y) = 0 THEN 0 ELSE degrees(atan(z / sqrt(x*x+y*y))) END angle, temp FROM rows)"
MEDIANS = f"""{BINS}, ch AS (SELECT *, abs(angle - lag(angle) OVER w) change, count(*) OVER (PARTITION BY recording_id, day_no) - row_number() OVER w rest FROM bins WINDOW w AS (PARTITION BY recording_id, day_no ORDER BY ts)),
med AS (SELECT recording_id, day_no, ts, rest, CASE WHEN count(change) OVER a = 6 THEN quantile_cont(change, 0.5) OVER a END angle_change, quantile_cont(temp, 0.5) OVER a temp FROM ch WINDOW a AS (PARTITION BY recording_id, day_no ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
medians AS (SELECT recording_id, day_no, ts, angle_change, temp FROM med WHERE rest >= 6)"""


def _medians(spark, sf_dir):
    return rest.rolling_median_bins(_bins(spark, sf_dir), 6)


@query("w9_rolling_median", f"WITH {MEDIANS} SELECT recording_id, day_no, ts, round(angle_change, 6) angle_change, round(temp, 6) temp FROM medians")
def rolling_median(spark, sf_dir):
    return rounded(_medians(spark, sf_dir))


@query("w10_rest_flags", f"""WITH {MEDIANS}, lim AS (SELECT recording_id, day_no, least(greatest(quantile_cont(angle_change, 0.1) * 15, 0.1), 20) lim FROM medians GROUP BY ALL)
SELECT recording_id, day_no, ts, CASE WHEN angle_change < lim AND temp > 24 THEN 0 ELSE 1 END active FROM medians JOIN lim USING (recording_id, day_no)""")  # fmt: skip
def rest_flags(spark, sf_dir):
    return rest.rest_flags(_medians(spark, sf_dir), most=20.0, min_temp=24.0).select("recording_id", "day_no", "ts", "active")


def _absorbed_sql(source: str, value: int, limit: int, tag: str) -> str:
    return f"""r{tag} AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id, day_no ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM (SELECT *, CASE WHEN lag(active) OVER (PARTITION BY recording_id, day_no ORDER BY ts) IS DISTINCT FROM active THEN 1 ELSE 0 END ch FROM {source})),
k{tag} AS (SELECT *, max(b) OVER (PARTITION BY recording_id, day_no) l FROM (SELECT recording_id, day_no, b, count(*) n, any_value(active) v FROM r{tag} GROUP BY ALL)),
f{tag} AS (SELECT recording_id, day_no, ts, CASE WHEN v = {value} AND n < {limit} AND b > 1 AND b < l THEN {1 - value} ELSE active END active FROM r{tag} JOIN k{tag} USING (recording_id, day_no, b))"""


@query("w11_major_rest", f"""WITH {FLAGGED}, flags AS (SELECT recording_id, day_no, ts, 1 - wear active FROM flagged), {_absorbed_sql("flags", 0, 2, "a")}, {_absorbed_sql("fa", 1, 3, "b")},
z AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id, day_no ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM (SELECT *, CASE WHEN lag(active) OVER (PARTITION BY recording_id, day_no ORDER BY ts) IS DISTINCT FROM active THEN 1 ELSE 0 END ch FROM fb)),
y AS (SELECT recording_id, day_no, b, count(*) n, min(ts) rest_start, max(ts) + INTERVAL 5 MINUTE rest_end FROM z WHERE active = 0 GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY recording_id, day_no ORDER BY n DESC, rest_start) i FROM y)
SELECT d.recording_id, d.day_no, rest_start, rest_end FROM (SELECT DISTINCT recording_id, day_no FROM flags) d LEFT JOIN (SELECT * FROM x WHERE i = 1) USING (recording_id, day_no)""")  # fmt: skip
def major_rest(spark, sf_dir):
    flags = _flagged(spark, sf_dir).select("recording_id", "day_no", "ts", (1 - F.col("wear")).alias("active"))
    return rest.major_rest_periods(flags, minimum_rest_block=2, allowed_rest_break=3, bins_a_minute=1)


_FIVE = ", ".join(f"CASE WHEN count({c}) OVER t = 5 THEN quantile_cont({c}, 0.5) OVER t END {c}" for c in ("x", "y", "z", "temp"))


@query("w8_arm_angle_bins", f"""WITH {DAYS}, five AS (SELECT recording_id, day_no, ts, {_FIVE} FROM rows WINDOW t AS (PARTITION BY recording_id, day_no ORDER BY ts, line_no ROWS 4 PRECEDING)),
b AS (SELECT recording_id, day_no, date_trunc('minute', ts) ts, avg(CASE WHEN x*x+y*y > 0 THEN degrees(atan(z / sqrt(x*x+y*y))) WHEN z <> 0 THEN 90 * sign(z) END) angle, avg(temp) temp FROM five GROUP BY ALL),
grid AS (SELECT recording_id, day_no, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) ts FROM b GROUP BY 1, 2) SELECT recording_id, day_no, ts, round(coalesce(angle, 0), 6) angle, round(coalesce(temp, 0), 6) temp FROM grid LEFT JOIN b USING (recording_id, day_no, ts)""")
def arm_angle_bins(spark, sf_dir):
    return rounded(rest.arm_angle_bins(days(spark, sf_dir), 1.0, 60))


def _minutes(spark, sf_dir):
    return days(spark, sf_dir).select("recording_id", "day_no", "ts", (F.abs("x") / 8).alias("activity_index"))


_CK = " + ".join(f"{c} * coalesce({f'lag(a, {4 - i})' if i < 4 else f'lead(a, {i - 4})' if i > 4 else 'first_value(a)'} OVER {'c' if i == 4 else 'w'}, 0)" for i, c in enumerate(sleepwake.WEIGHTS) if c)
COLE = f"""{DAYS}, ai AS (SELECT recording_id, day_no, ts, abs(x) / 8 a FROM rows),
ck AS (SELECT *, {sleepwake.SCALE} * ({_CK}) score FROM ai WINDOW w AS (PARTITION BY recording_id, day_no ORDER BY ts), c AS (PARTITION BY recording_id, day_no ORDER BY ts ROWS BETWEEN CURRENT ROW AND CURRENT ROW))"""


@query("w12_cole_kripke", f"WITH {COLE} SELECT recording_id, day_no, ts, round(score, 6) score, CAST(score >= 0.5 AS INT) wake FROM ck")
def cole_kripke(spark, sf_dir):
    return rounded(sleepwake.cole_kripke(_minutes(spark, sf_dir)).select("recording_id", "day_no", "ts", "score", "wake"))


#: Rules a to c minute by minute (from: where the count of wake began; turned: up to where minutes are turned), then rule d
#: run by run (kept: the end of the last sleep that stays).
WEBSTER = f"""{COLE}, v AS (SELECT recording_id, day_no, ts, row_number() OVER (PARTITION BY recording_id, day_no ORDER BY ts) - 1 i, CAST(score >= 0.5 AS INT) w FROM ck),
abc AS (SELECT recording_id, day_no, CAST(-1 AS BIGINT) i, CAST(0 AS BIGINT) began, CAST(0 AS BIGINT) turned, 1 w FROM (SELECT DISTINCT recording_id, day_no FROM v) UNION ALL
 SELECT recording_id, day_no, v.i, CASE WHEN v.w = 0 AND v.i >= turned THEN v.i + 1 ELSE began END, CASE WHEN v.w = 0 AND v.i >= turned THEN v.i + CASE WHEN v.i - began >= 15 THEN 4 WHEN v.i - began >= 10 THEN 3 WHEN v.i - began >= 4 THEN 1 ELSE 0 END ELSE turned END,
  CASE WHEN v.w = 1 OR v.i < turned OR v.i - began >= 4 THEN 1 ELSE 0 END FROM abc JOIN v USING (recording_id, day_no) WHERE v.i = abc.i + 1),
s AS (SELECT recording_id, day_no, min(i) a, max(i) + 1 z, row_number() OVER (PARTITION BY recording_id, day_no ORDER BY min(i)) k FROM (SELECT *, i - row_number() OVER (PARTITION BY recording_id, day_no ORDER BY i) g FROM abc WHERE w = 0) GROUP BY recording_id, day_no, g),
sn AS (SELECT s.*, coalesce(lead(a) OVER (PARTITION BY recording_id, day_no ORDER BY a), n) nxt, n FROM s JOIN (SELECT recording_id, day_no, count(*) n FROM v GROUP BY 1, 2) USING (recording_id, day_no)),
d AS (SELECT recording_id, day_no, CAST(0 AS BIGINT) k, CAST(0 AS BIGINT) kept, CAST(NULL AS BIGINT) a, CAST(NULL AS BIGINT) z FROM (SELECT DISTINCT recording_id, day_no FROM v) UNION ALL
 SELECT recording_id, day_no, sn.k, CASE WHEN sn.z - sn.a <= 6 AND sn.a - kept >= 10 AND nxt - sn.z >= 10 AND sn.z + 10 < n THEN kept ELSE sn.z END, CASE WHEN sn.z - sn.a <= 6 AND sn.a - kept >= 10 AND nxt - sn.z >= 10 AND sn.z + 10 < n THEN sn.a END, sn.z FROM d JOIN sn USING (recording_id, day_no) WHERE sn.k = d.k + 1),
webster AS (SELECT v.recording_id, v.day_no, v.ts, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.recording_id = v.recording_id AND d.day_no = v.day_no AND v.i >= d.a AND v.i < d.z) THEN 1 ELSE abc.w END wake FROM v JOIN abc USING (recording_id, day_no, i))"""


@query("w13_webster_rescore", f"WITH RECURSIVE {WEBSTER} SELECT * FROM webster")
def webster(spark, sf_dir):
    return sleepwake.webster_rescore(sleepwake.cole_kripke(_minutes(spark, sf_dir))).select("recording_id", "day_no", "ts", "wake")


@query("a5_sleep_endpoints", f"""WITH {COLE}, w AS (SELECT recording_id, day_no, ts, CAST(score >= 0.5 AS INT) wake FROM ck),
r AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id, day_no ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM (SELECT *, CASE WHEN lag(wake) OVER (PARTITION BY recording_id, day_no ORDER BY ts) IS DISTINCT FROM wake THEN 1 ELSE 0 END ch FROM w)),
o AS (SELECT recording_id, day_no, coalesce(min(ts) FILTER (wake = 0), min(ts)) onset, min(ts) t0 FROM w GROUP BY ALL), k AS (SELECT recording_id, day_no, b, sum(wake) s FROM r GROUP BY ALL),
m AS (SELECT recording_id, day_no, count(*) FILTER (s > 0) wb, count(*) FILTER (s > 5) wb5 FROM k GROUP BY ALL)
SELECT recording_id, day_no, CAST(count(*) - sum(wake) AS INT) total_sleep_time, CAST(round_even(100.0 * (count(*) - sum(wake)) / count(*), 0) AS INT) percent_time_asleep, CAST(coalesce(sum(wake) FILTER (ts >= onset), 0) AS INT) waso,
 CAST(floor(epoch(any_value(onset) - any_value(t0)) / 60) AS INT) sleep_onset_latency, CAST(any_value(wb) AS INT) number_wake_bouts, CAST(any_value(wb5) AS INT) number_wake_bouts_5min
FROM w JOIN o USING (recording_id, day_no) JOIN m USING (recording_id, day_no) GROUP BY recording_id, day_no""")  # fmt: skip
def sleep_endpoints(spark, sf_dir):
    wake = sleepwake.cole_kripke(_minutes(spark, sf_dir))
    none = wake.select("recording_id", "day_no").distinct().withColumns({"rest_start": F.lit(None).cast("timestamp_ntz"), "rest_end": F.lit(None).cast("timestamp_ntz")})
    return sleepwake.sleep_endpoints(wake, none)
