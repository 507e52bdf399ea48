"""Queries over whole jobs, the minute report, and readers on texts that the driver's tables are written as."""

from __future__ import annotations

from pyspark.sql import functions as F

from actispark.functions import scalars as S
from actispark.operators import jobs as J
from actispark.operators import sleepwake
from actispark.plans.base import CLINICAL, FEATURES, SUBJECTS, clinical, query, rounded, samples, scored_epochs, subjects, table
from actispark.plans.motion import DAYS, FLAGGED, FS, MEDIANS, NOON, WEBSTER, _absorbed_sql, _bins, _flagged, _minutes, days
from actispark.plans.nightly import NIGHTLY, NORMS, RATIOS, _days, _recordings
from actispark.sources import readers as R

_OWN = "recording_id, day_no"
_FROM_BINS = "bins AS" + MEDIANS.split("bins AS", 1)[1]  # without the days, which come before


@query("job_algorithmic_nights", f"""WITH RECURSIVE {WEBSTER}, {_FROM_BINS},
lim AS (SELECT {_OWN}, least(greatest(quantile_cont(angle_change, 0.1) * 15, 0.1), 20) lim FROM medians GROUP BY ALL), flags AS (SELECT {_OWN}, ts, CASE WHEN angle_change < lim AND temp > 24 THEN 0 ELSE 1 END active FROM medians JOIN lim USING ({_OWN})),
{_absorbed_sql("flags", 0, 2, "a")}, {_absorbed_sql("fa", 1, 3, "b")},
zz AS (SELECT *, sum(ch) OVER (PARTITION BY {_OWN} ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM (SELECT *, CASE WHEN lag(active) OVER (PARTITION BY {_OWN} ORDER BY ts) IS DISTINCT FROM active THEN 1 ELSE 0 END ch FROM fb)),
yy AS (SELECT {_OWN}, b, count(*) n, min(ts) rest_start, max(ts) + INTERVAL 5 MINUTE rest_end FROM zz WHERE active = 0 GROUP BY ALL), xx AS (SELECT *, row_number() OVER (PARTITION BY {_OWN} ORDER BY n DESC, rest_start) i FROM yy),
period AS (SELECT {_OWN}, rest_start, rest_end FROM (SELECT DISTINCT {_OWN} FROM flags) LEFT JOIN (SELECT * FROM xx WHERE i = 1) USING ({_OWN})),
slept AS (SELECT w.* FROM webster w LEFT JOIN period p USING ({_OWN}) WHERE rest_start IS NULL OR ts BETWEEN rest_start AND rest_end),
runs AS (SELECT *, sum(ch) OVER (PARTITION BY {_OWN} ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM (SELECT *, CASE WHEN lag(wake) OVER (PARTITION BY {_OWN} ORDER BY ts) IS DISTINCT FROM wake THEN 1 ELSE 0 END ch FROM slept)),
o AS (SELECT {_OWN}, coalesce(min(ts) FILTER (wake = 0), min(ts)) onset, min(ts) t0 FROM slept GROUP BY ALL), k AS (SELECT {_OWN}, b, sum(wake) s FROM runs GROUP BY ALL), m AS (SELECT {_OWN}, count(*) FILTER (s > 0) wb, count(*) FILTER (s > 5) wb5 FROM k GROUP BY ALL),
ends AS (SELECT {_OWN}, count(*) - sum(wake) tst, round_even(100.0 * (count(*) - sum(wake)) / count(*), 0) se, coalesce(sum(wake) FILTER (ts >= onset), 0) waso, floor(epoch(any_value(onset) - any_value(t0)) / 60) sol, any_value(wb) wb, any_value(wb5) wb5 FROM slept JOIN o USING ({_OWN}) JOIN m USING ({_OWN}) GROUP BY {_OWN}),
hours AS (SELECT {_OWN}, any_value(day_rows) / ({FS} * 3600) available_hours FROM rows GROUP BY {_OWN})
SELECT recording_id, recording_id subject, day_no, round(available_hours, 6) available_hours, rest_start sleep_onset, rest_end sleep_end, CAST(sol AS INT) sol, CAST(waso AS INT) waso, CAST(tst AS INT) tst, CAST(wb AS INT) wb, CAST(wb5 AS INT) awk5plus, CAST(se AS INT) se FROM period JOIN hours USING ({_OWN}) JOIN ends USING ({_OWN})""")
def algorithmic_nights(spark, sf_dir):
    own = samples(spark, sf_dir).select("recording_id", F.col("recording_id").alias("subject")).distinct()
    limits, blocks = {"most": 20.0, "min_temp": 24.0}, {"minimum_rest_block": 2, "allowed_rest_break": 3, "bins_a_minute": 1}
    return rounded(J.nights_of_days(days(spark, sf_dir), _minutes(spark, sf_dir), _bins(spark, sf_dir), own, FS, 6, limits, blocks))


@query("job_night_rows", f"""WITH RECURSIVE {NIGHTLY}, {SUBJECTS}, v AS (SELECT day_id, s, row_number() OVER (PARTITION BY day_id ORDER BY ts) i FROM f),
r AS (SELECT day_id, CAST(0 AS BIGINT) i, 0 n, 0 wake, 0 sleep FROM (SELECT DISTINCT day_id FROM v) UNION ALL
 SELECT r.day_id, v.i, r.n + CASE WHEN s = 0 AND r.wake + 1 = 10 AND r.sleep >= 10 THEN 1 ELSE 0 END, CASE WHEN s = 0 THEN r.wake + 1 ELSE 0 END, CASE WHEN s = 0 AND r.wake + 1 = 10 AND r.sleep >= 10 THEN 0 ELSE r.sleep + CASE WHEN s = 0 THEN 0 ELSE 1 END END FROM r JOIN v ON v.day_id = r.day_id AND v.i = r.i + 1),
awk AS (SELECT day_id, CAST(arg_max(n, i) AS INT) awk5plus FROM r GROUP BY 1),
n0 AS (SELECT day_id, recording_id, any_value(date) date, CAST(count(*) FILTER (s = 0) * 30 AS INT) waso, CAST(greatest(count(*) FILTER (d = -1) - 1, 0) AS INT) wb, CAST(any_value(epoch(t4 - t1)) AS INT) tib, CAST(floor(any_value(epoch(a - t1))) AS INT) sol, CAST(floor(any_value(epoch(t4 - z))) AS INT) wasf FROM f GROUP BY day_id, recording_id),
n1 AS (SELECT n0.*, awk5plus, {RATIOS}, age FROM n0 JOIN awk USING (day_id) JOIN subjects ON recording_id = code), night_rows AS (SELECT *, {NORMS} FROM n1)
SELECT day_id, recording_id, date, tib, sol, waso, wasf, tst, wb, awk5plus, round(se, 6) se, round(sf, 6) sf, sol_norm, waso_norm, awk5plus_norm, se_norm FROM night_rows""")
def night_rows(spark, sf_dir):
    at = J.scored_epochs_to_nights(scored_epochs(spark, sf_dir), _days(spark, sf_dir), _recordings(spark, sf_dir), subjects(spark, sf_dir))
    return rounded(at.select("day_id", "recording_id", "date", "tib", "sol", "waso", "wasf", "tst", "wb", "awk5plus", "se", "sf", "sol_norm", "waso_norm", "awk5plus_norm", "se_norm"))


@query("job_clinical_statistics", f"""WITH {CLINICAL}, {SUBJECTS}, d AS (SELECT *, gender - avg(gender) OVER p dg, age - avg(age) OVER p da, value - avg(value) OVER p dv FROM long WINDOW p AS (PARTITION BY feature)),
s AS (SELECT feature, sum(dg*dg) gg, sum(da*da) aa, sum(dg*da) ga, sum(dg*dv) gv, sum(da*dv) av FROM d GROUP BY 1), r AS (SELECT subject, feature, dv - (gv*aa - av*ga) / (gg*aa - ga*ga) * dg - (av*gg - gv*ga) / (gg*aa - ga*ga) * da AS value FROM d JOIN s USING (feature)),
q AS (SELECT subject, feature, stddev_pop(value) sd, mad(value) mad, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) iqr FROM r GROUP BY ALL)
SELECT subject, feature, round(sd, 4) sd, round(mad, 4) mad, round(range, 4) AS range, round(iqr, 4) iqr, diagnosis_code FROM q JOIN subjects ON code = subject WHERE diagnosis_code IS NOT NULL""")
def clinical_statistics(spark, sf_dir):
    return rounded(J.clinical_statistics(clinical(spark, sf_dir), subjects(spark, sf_dir), list(FEATURES)).drop("cv"), 4)  # a residual's mean is 0 but for rounding


_MINUTE = "date_trunc('minute', ts)"


@query("w15_minute_report", f"""WITH {FLAGGED}, days_ AS (SELECT DISTINCT recording_id, day_no, {NOON} noon FROM rows), grid AS (SELECT recording_id, day_no, unnest(generate_series(noon, noon + INTERVAL 1439 MINUTE, INTERVAL 1 MINUTE)) ts FROM days_),
raw AS (SELECT {_OWN}, {_MINUTE} ts, median(x) x, median(y) y, median(z) z, median(line_no % 7) lux, median(temp) temp, max(CASE WHEN sqrt(x*x+y*y) = 0 THEN 0 ELSE degrees(atan(z / sqrt(x*x+y*y))) END) angle, max(abs(x) / 8) activity_index FROM rows GROUP BY ALL),
flag AS (SELECT {_OWN}, {_MINUTE} ts, max(1 - wear) active, max(wear) wear FROM flagged GROUP BY ALL), awake AS (SELECT {_OWN}, {_MINUTE} ts, max(CAST(line_no % 3 = 0 AS INT)) wake FROM rows GROUP BY ALL)
SELECT {_OWN}, ts, round(x, 9) x, round(y, 9) y, round(z, 9) z, round(lux, 9) lux, round(temp, 9) temp, round(angle, 9) angle, round(activity_index, 9) activity_index, active, wake, last_value(wear IGNORE NULLS) OVER (PARTITION BY {_OWN} ORDER BY ts ROWS UNBOUNDED PRECEDING) wear
 FROM grid LEFT JOIN raw USING ({_OWN}, ts) LEFT JOIN flag USING ({_OWN}, ts) LEFT JOIN awake USING ({_OWN}, ts)""")
def minute_report(spark, sf_dir):
    at = days(spark, sf_dir).withColumn("lux", (F.col("line_no") % 7).cast("double"))
    noons = at.select("recording_id", "day_no", F.window("ts", "24 hours", "24 hours", "12 hours")["start"].alias("noon")).distinct()
    flags = _flagged(spark, sf_dir)
    wake = at.select("recording_id", "day_no", "ts", (F.col("line_no") % 3 == 0).cast("int").alias("wake"))
    return rounded(sleepwake.minute_report(noons, at, _bins(spark, sf_dir), _minutes(spark, sf_dir), flags.withColumn("active", 1 - F.col("wear")), wake, flags), 9)


# --- readers ----------------------------------------------------------------------------------------------------------

_STAMP = "yyyy-MM-dd HH:mm:ss:SSS"


@query("s1_geneactiv_lines", """WITH e AS (SELECT CAST(user_id % 5 AS VARCHAR) recording_id, event_id line_no, date_trunc('millisecond', ts) ts, value / 100 x, (event_id % 21 - 10) / 10 z, event_id % 9 lux, event_id % 2 button, 20 + event_id % 50 / 10 temp FROM events)
SELECT recording_id, line_no, ts, round(x, 4) x, round(-x, 4) y, round(z, 4) z, CAST(lux AS DOUBLE) lux, round(temp, 4) temp, CASE WHEN line_no % 7 <> 0 THEN button = 1 END AS button FROM e WHERE line_no % 10 <> 0""")
def geneactiv_lines(spark, sf_dir):
    """Events as lines of raw text, some without the button, some with a broken stamp, all with NUL bytes."""
    k, x = F.col("event_id"), F.col("value") / 100
    bad = F.when(k % 10 == 0, F.lit("2024-13-01 10:00:00:000")).otherwise(F.date_format("ts", _STAMP))
    number = lambda c: F.format_string("%.4f", c.cast("double"))
    temp = number(20 + k % 50 / 10)
    tail = F.when(k % 7 == 0, temp).otherwise(F.concat_ws(",", (k % 2).cast("string"), temp))
    line = F.concat_ws(",", bad, number(x), number(-x), number((k % 21 - 10) / 10), (k % 9).cast("string"), tail)
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("recording_id"), k.alias("line_no"), F.regexp_replace(line, "-", "-\x00").alias("value"))
    return rounded(R.parse_geneactiv(R.scrub_nul(lines)), 4)


@query("s3_recording_rates", """SELECT CAST(user_id % 6 AS VARCHAR) recording_id, [25, 50, 85.7, 100, 30, 75][CAST(user_id % 6 AS INT) + 1]::DOUBLE rate_hz, [1, 2, 3, 4, NULL, NULL][CAST(user_id % 6 AS INT) + 1] factor FROM events GROUP BY user_id % 6""")
def recording_rates(spark, sf_dir):
    rate = F.element_at(F.array(*[F.lit(x) for x in ("25.0", "50.0", "85.7", "100.0", "30", "75")]), (F.col("user_id") % 6).cast("int") + 1)
    return R.recording_rates(table(spark, sf_dir, "events").select((F.col("user_id") % 6).cast("string").alias("recording_id"), F.concat(F.lit("Measurement Frequency,"), rate, F.lit(" Hz")).alias("value")))


@query("s4_training_start", """SELECT CAST(user_id % 5 AS VARCHAR) recording_id, greatest(min(ts + to_seconds(event_id % 60)) - INTERVAL 15 SECOND, min(ts)) AS "start" FROM events GROUP BY 1""")
def training_start(spark, sf_dir):
    at = samples(spark, sf_dir)
    shift = F.make_dt_interval(secs=(F.col("line_no") % 60).cast("decimal(18,6)"))
    return R.training_start(at, at.select("recording_id", (F.col("ts") + shift).alias("ts")))


@query("s5_psg_text", """WITH p AS (SELECT CAST(user_id AS VARCHAR) recording_id, event_id, strftime(ts, '%H:%M:%S') clock, ['W', 'N1', 'N2', 'N3', 'R'][CAST(event_id % 5 AS INT) + 1] stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events),
l AS (SELECT *, CASE WHEN clock LIKE '00%' OR (i = 1 AND CAST(clock[1:2] AS INT) BETWEEN 1 AND 11) THEN 1 ELSE 0 END late FROM p)
SELECT recording_id, CAST(i + 2 AS INT) row_no, CAST(DATE '2024-02-01' + CAST(max(late) OVER (PARTITION BY recording_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INT) AS TIMESTAMP) + CAST(clock AS INTERVAL) ts, stage, CAST(stage <> 'W' AS INT) sleep FROM l""")
def psg_text(spark, sf_dir):
    """Each user's events as a polysomnography file."""
    stage = F.element_at(F.array(*[F.lit(x) for x in ("W", "N1", "N2", "N3", "R")]), (F.col("event_id") % 5).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), F.struct("event_id", F.concat_ws("\t", stage, F.lit(""), F.date_format("ts", "HH:mm:ss"), F.lit(""), F.lit("15")).alias("line")).alias("r"))
    head = "Recording Date:\t01/02/2024\nSubject:\tx\nSleep Stage\tPosition\tTime [hh:mm:ss]\tEvent\tDuration[s]\n"
    text = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n"), F.lit("\n\n"))
    return R.parse_psg(rows.groupBy("recording_id").agg(text.alias("value")))


@query("s6_binary_pages", """WITH e AS (SELECT CAST(user_id % 5 AS VARCHAR) recording_id, event_id, date_trunc('millisecond', ts) ts FROM events), s AS (SELECT e.*, i, (event_id * 7 + i * 1000) % 4096 w, (event_id + i) % 1024 lux, (event_id + i) % 2 b FROM e, range(0, 3) r(i)),
g AS (SELECT *, CASE WHEN w > 2047 THEN w - 4096 ELSE w END v FROM s)
SELECT recording_id, event_id * 512 + i line_no, ts + to_microseconds(CAST(i * 20000 AS BIGINT)) ts, round((v * 100.0 - 12) / 250, 4) x, round((-1 * 100.0 - 0) / 100, 4) y, round((2047 * 100.0 - -5) / 200, 4) z, round(lux * 4 / 2.0, 4) lux, round(20 + event_id % 50 / 10, 4) temp, b = 1 AS button FROM g""")
def binary_pages(spark, sf_dir):
    """Each event as a page of three samples, after a preamble for each recording."""
    k = F.col("event_id")
    one = lambda i: F.format_string("%03X%03X%03X%03X", ((k * 7 + i * 1000) % 4096).cast("long"), F.lit(4095), F.lit(2047), (((k + i) % 1024) * 4 + (k + i) % 2 * 2).cast("long"))
    value = F.concat(F.date_format("ts", _STAMP), F.lit("\nTemperature:"), F.format_string("%.1f", 20 + k % 50 / 10), F.lit("\nMeasurement Frequency:50.0\n"), one(0), one(1), one(2), F.lit("\nRecorded Data\n"))
    pages = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("recording_id"), k.alias("line_no"), value.alias("value"))
    head = "Device Type:GENEActiv\nMeasurement Frequency:50.0 Hz\nx gain:250\nx offset:12\ny gain:100\ny offset:0\nz gain:200\nz offset:-5\nVolts:2\nLux:4\n"
    heads = pages.select("recording_id").distinct().select("recording_id", F.lit(-1).cast("long").alias("line_no"), F.lit(head).alias("value"))
    return rounded(R.decode_pages(pages.unionByName(heads)), 4)


@query("s7_s8_dreamt", """SELECT CAST(user_id AS VARCHAR) recording_id, TIMESTAMP '2025-03-13 19:00:00' + to_microseconds(event_id * 15625) ts, round(value / 64, 9) x, round(-value / 64, 9) y, round(1 / 64, 9) z, round(30 + event_id % 10 / 10, 9) temp, CAST(event_id % 7 BETWEEN 2 AND 5 AS INT) sleep
 FROM events WHERE event_id % 7 <> 6""")
def dreamt(spark, sf_dir):
    """Events as raw 64 Hz rows, converted, written as text and parsed."""
    k = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(x) for x in ("W", "P", "N1", "N2", "N3", "R", "Missing")]), (k % 7).cast("int") + 1)
    raw = table(spark, sf_dir, "events").select((k / 64).alias("TIMESTAMP"), F.col("value").alias("ACC_X"), (-F.col("value")).alias("ACC_Y"), F.lit(1.0).alias("ACC_Z"), (30 + k % 10 / 10).alias("TEMP"), stage.alias("Sleep_Stage"), F.col("user_id").cast("string").alias("recording_id"))
    done = R.convert_dreamt(raw)
    text = done.select("recording_id", F.date_format("processed_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Processed_Time"), *[F.col(c).cast("string").alias(c) for c in ("ACC_X_g", "ACC_Y_g", "ACC_Z_g", "TEMP", "sleep_binary")])
    return rounded(R.parse_dreamt(text), 9)
