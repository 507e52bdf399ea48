"""Diary days as timelines, and the metrics of a night from the diary and from scored epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actispark.functions.scalars import binarize_scores, norm_awk5plus, norm_se, norm_sol, norm_waso, with_sleep_ratios
from actispark.operators.spans import within
from actispark.operators.wear import islands

DAY = 86_400


def _at(date: Column, seconds: Column) -> Column:
    """date plus seconds as a time stamp without zone."""
    return (F.col("date") if date is None else date).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _evening(date: Column, clock: Column) -> Column:
    """A clock time of a night that began on date: before noon it is the next day's."""
    return _at(date, F.when(clock < DAY // 2, clock + DAY).otherwise(clock))


def _not_before(date: Column, clock: Column, previous: Column) -> Column:
    maybe = _evening(date, clock)
    return F.when(maybe < previous, maybe + F.expr("INTERVAL 1 DAY")).otherwise(maybe)


def diary_timeline(diary: DataFrame) -> DataFrame:
    """diary(date, sleep_time, sleep_duration, wake_time, get_up_time as seconds of day) with t1 to t4: in bed, asleep,
    awake, up; a clock before noon is the next day's, and none is before the one before it."""
    d = F.col("date")
    diary = diary.withColumn("t1", _evening(d, F.col("sleep_time")))
    for out, clock, before in (("t2", "sleep_duration", "t1"), ("t3", "wake_time", "t2"), ("t4", "get_up_time", "t3")):
        diary = diary.withColumn(out, _not_before(d, F.col(clock), F.col(before)))
    return diary


def wake_interval_times(diary: DataFrame, intervals: DataFrame) -> DataFrame:
    """intervals(day_id, start, end as seconds of day) with start_ts, end_ts and duration: the difference of hours and
    minutes modulo a day, one minute at least."""
    days = diary_timeline(diary).select("day_id", "date", "t2")
    at = intervals.join(days, "day_id").withColumn("start_ts", _not_before(F.col("date"), F.col("start"), F.col("t2")))
    minutes = F.pmod(F.floor(F.col("end") / 60) - F.floor(F.col("start") / 60), F.lit(DAY // 60))
    return at.withColumn("end_ts", _not_before(F.col("date"), F.col("end"), F.col("start_ts"))).withColumn("duration", (F.greatest(minutes, F.lit(1)) * 60).cast("int")).drop("date", "t2")


def night_bounds(diary: DataFrame, margin_minutes: int = 30) -> DataFrame:
    """subject, day_id, lo, hi: the time in bed with a margin on both sides."""
    m = F.expr(f"INTERVAL {margin_minutes} MINUTES")
    return diary_timeline(diary).select("subject", "day_id", (F.col("t1") - m).alias("lo"), (F.col("t4") + m).alias("hi"))


def _seconds(a: str, b: str) -> Column:
    """Seconds from a to b modulo a day."""
    return F.pmod(F.timestamp_diff("SECOND", F.col(a), F.col(b)), F.lit(DAY)).cast("int")


def match_days_to_recordings(diary: DataFrame, recordings: DataFrame, epochs: DataFrame) -> DataFrame:
    """Diary days with recording_id: the subject's only recording, else the first that has an epoch in [t1, t4]; days
    with none are dropped."""
    owned = recordings.select("recording_id", "subject").withColumn("_n", F.count("*").over(Window.partitionBy("subject")))
    days = diary_timeline(diary).join(owned, "subject")
    several = days.where(F.col("_n") > 1)
    hits = within(epochs.select("recording_id", "ts"), several.select("recording_id", "day_id", "t1", "t4"), "recording_id", "t1", "t4").select("recording_id", "day_id").distinct()
    seen = several.join(hits, ["recording_id", "day_id"], "left_semi")
    first = F.row_number().over(Window.partitionBy("day_id").orderBy("recording_id"))
    return days.where(F.col("_n") == 1).unionByName(seen).withColumn("_r", first).where(F.col("_r") == 1).drop("_r", "_n")


def awk5plus(df: DataFrame, keys: list[str], epochs: int = 10, flag: str = "score") -> DataFrame:
    """keys, awk5plus: wake runs of epochs rows or more, after epochs rows or more of sleep since the last one counted. Runs
    are made and slept rows summed up by windows; what is left to go through in order is the sums at a night's long wakes."""
    runs = islands(df.withColumn("_w", F.col(flag) == 0), keys, ["ts"], "_w").groupBy(*keys, "block").agg(F.count("*").alias("n"), F.first("_w").alias("awake"))
    slept = F.sum(F.when(F.col("awake"), 0).otherwise(F.col("n"))).over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    long = F.when(F.col("awake") & (F.col("n") >= epochs), slept)
    sums = runs.withColumn("_s", long).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("at"))
    counts = lambda s, x: F.struct((s["n"] + (x - s["at"] >= epochs).cast("int")).alias("n"), F.when(x - s["at"] >= epochs, x).otherwise(s["at"]).alias("at"))
    return sums.select(*keys, F.aggregate("_s", none, counts, lambda s: s["n"]).alias("awk5plus"))


def night_metrics(epochs: DataFrame, matched_days: DataFrame, epoch_s: int = 30, threshold: float = 0.5) -> DataFrame:
    """A row per matched diary day with sleep in it: onset and end (first and last sleep epoch), tib, sol, waso, wasf in
    seconds, wake bouts (falls from sleep to wake, less one) and awk5plus."""
    keys = ["day_id"]
    days = matched_days.select("day_id", "recording_id", "subject", "date", "t1", "t4")
    at = within(epochs.select("recording_id", "ts", "score"), days, "recording_id", "t1", "t4")
    at = binarize_scores(at, keys, "score", threshold)
    w = Window.partitionBy(*keys)
    asleep = F.when(F.col("score") == 1, F.col("ts"))
    at = at.withColumn("onset", F.min(asleep).over(w)).withColumn("offset", F.max(asleep).over(w)).where(F.col("ts").between(F.col("onset"), F.col("offset")))
    fall = (F.col("score") < F.lag("score").over(w.orderBy("ts"))).cast("int")
    metrics = at.withColumn("fall", fall).groupBy(*keys, "recording_id", "subject", "date", "t1", "t4").agg(
        F.first("onset").alias("sleep_onset"), F.first("offset").alias("sleep_end"), (F.count_if(F.col("score") == 0) * epoch_s).cast("int").alias("waso"), F.greatest(F.coalesce(F.sum("fall"), F.lit(0)) - 1, F.lit(0)).cast("int").alias("wb")
    )
    metrics = metrics.withColumn("tib", _seconds("t1", "t4")).withColumn("sol", _seconds("t1", "sleep_onset")).withColumn("wasf", _seconds("sleep_end", "t4"))
    return metrics.drop("t1", "t4").join(awk5plus(at, keys), keys)


def with_norms(df: DataFrame, age: str = "age", sol_divisor: float = 60.0) -> DataFrame:
    return df.withColumns({"sol_norm": norm_sol(age, "sol", sol_divisor), "waso_norm": norm_waso(age, "waso"), "awk5plus_norm": norm_awk5plus(age, "awk5plus"), "se_norm": norm_se(age, "se")})


def diary_metrics(diary: DataFrame, intervals: DataFrame, subjects: DataFrame) -> DataFrame:
    """A row per diary day: tib, sol, waso, wasf, tst, wb, awk5plus (intervals of 300 s or more), se, sf, their norms, and
    dtst (time between sleep and wake less the intervals)."""
    times = wake_interval_times(diary, intervals).withColumn("span", _seconds("start_ts", "end_ts"))
    per = times.groupBy("day_id").agg(F.sum("duration").alias("waso"), F.count("*").alias("wb"), F.count_if(F.col("duration") >= 300).alias("awk5plus"), F.sum("span").alias("_span"))
    days = diary_timeline(diary).join(per, "day_id", "left").fillna(0, ["waso", "wb", "awk5plus", "_span"])
    days = days.withColumns({"tib": _seconds("t1", "t4"), "sol": _seconds("t1", "t2"), "wasf": _seconds("t3", "t4"), "dtst": _seconds("t2", "t3") - F.col("_span")}).drop("_span")
    ages = subjects.select(F.col("code").alias("subject"), "age")
    return with_norms(with_sleep_ratios(days).join(ages, "subject", "left"))
