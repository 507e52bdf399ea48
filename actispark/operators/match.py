"""Matching nights of the algorithm with nights of the diary, and reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actispark.functions.scalars import with_sleep_ratios
from actispark.operators.spans import within


def algorithmic_nights(rest_periods: DataFrame, endpoints: DataFrame, recordings: DataFrame) -> DataFrame:
    """Rest periods with their endpoints as nights: onset, end, sol, waso, tst (minutes), wb, awk5plus, se."""
    at = rest_periods.join(endpoints, ["recording_id", "day_no"]).join(recordings.select("recording_id", "subject"), "recording_id")
    return at.select(
        "recording_id", "subject", "day_no", "available_hours", F.col("rest_start").alias("sleep_onset"), F.col("rest_end").alias("sleep_end"), F.col("sleep_onset_latency").alias("sol"), "waso",
        F.col("total_sleep_time").alias("tst"), F.col("number_wake_bouts").alias("wb"), F.col("number_wake_bouts_5min").alias("awk5plus"), F.col("percent_time_asleep").alias("se"),
    )


def match_nearest_night(algorithmic: DataFrame, nights: DataFrame) -> DataFrame:
    """algorithmic with night_id of the nearest onset in the same recording; of two equally near ones the later. Both tables
    go into one time line a recording, where a window sees the last night before and the first after: no pairs are made."""
    other = nights.where(F.col("sleep_onset").isNotNull()).groupBy("recording_id", F.col("sleep_onset").alias("_at")).agg(F.min("night_id").alias("night_id"))
    line = other.select("recording_id", "_at", F.struct("_at", "night_id").alias("_n"), F.lit(None).cast(algorithmic.schema).alias("_s"))
    line = line.unionByName(algorithmic.select("recording_id", F.col("sleep_onset").alias("_at"), F.lit(None).cast(line.schema["_n"].dataType).alias("_n"), F.struct(*algorithmic.columns).alias("_s")))
    up = Window.partitionBy("recording_id").orderBy(F.col("_at").asc_nulls_first(), F.col("_n").isNull())
    down = Window.partitionBy("recording_id").orderBy(F.col("_at").desc_nulls_last(), F.col("_n").isNotNull())
    before, after = (F.last("_n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (up, down))  # a growing frame each
    at = line.withColumn("_b", before).withColumn("_a", after).where(F.col("_s").isNotNull())
    away = lambda c: F.abs(F.timestamp_diff("MICROSECOND", F.col("_at"), F.col(f"{c}._at")))
    later = F.col("_a").isNotNull() & (F.col("_b").isNull() | (away("_a") <= away("_b")))
    return at.select("_s.*", F.when(F.col("_at").isNotNull(), F.when(later, F.col("_a.night_id")).otherwise(F.col("_b.night_id"))).alias("night_id"))


def dedupe_night_match(matched: DataFrame, minimum_first_hours: float = 12.0) -> DataFrame:
    """The first algorithmic night of each matched night, without days that have no rest period and without a first day of
    under minimum_first_hours."""
    short = (F.col("day_no") == 1) & (F.col("available_hours") < minimum_first_hours)
    first = F.row_number().over(Window.partitionBy("night_id").orderBy("sleep_onset", "day_no"))
    return matched.where(F.col("sleep_onset").isNotNull() & F.col("night_id").isNotNull() & ~short).withColumn("_r", first).where(F.col("_r") == 1).drop("_r")


def night_activity(ai: DataFrame, nights: DataFrame) -> DataFrame:
    """Activity-index rows in a night's [onset, end], both included; a recording's day gets its first matching night only.
    day_index is day_no + 1."""
    at = within(ai, nights.select("recording_id", "night_id", "sleep_onset", "sleep_end"), "recording_id", "sleep_onset", "sleep_end")
    rank = F.dense_rank().over(Window.partitionBy("recording_id", "day_no").orderBy("sleep_onset", "night_id"))
    return at.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r").withColumn("day_index", F.col("day_no") + 1)


def match_report(nights: DataFrame, algorithmic: DataFrame) -> DataFrame:
    """issue, night_id, n: nights with several algorithmic nights, or none; algorithmic nights without one; efficiency of
    100 %."""
    per = algorithmic.where(F.col("night_id").isNotNull()).groupBy("night_id").count()
    several = per.where(F.col("count") > 1).select(F.lit("several").alias("issue"), "night_id", F.col("count").alias("n"))
    none = nights.join(per, "night_id", "left_anti").select(F.lit("none").alias("issue"), "night_id", F.lit(0).cast("long").alias("n"))
    loose = algorithmic.join(nights.select("night_id"), "night_id", "left_anti").groupBy().agg(F.count("*").alias("n")).where(F.col("n") > 0).select(F.lit("unmatched").alias("issue"), F.lit(None).cast("long").alias("night_id"), "n")
    full = algorithmic.where(F.col("se") == 100).groupBy("night_id").agg(F.count("*").alias("n")).select(F.lit("se_100").alias("issue"), "night_id", "n")
    return several.unionByName(none).unionByName(loose).unionByName(full)


def training_subjects(subjects: DataFrame, recordings: DataFrame) -> DataFrame:
    """Subjects that own a training recording."""
    own = recordings.where("training_data").select(F.col("subject").alias("_s"))
    return subjects.join(own, F.col("code") == F.col("_s"), "left_semi")


def with_algorithmic_ratios(algorithmic: DataFrame) -> DataFrame:
    """sf of algorithmic nights, whose sleep time is in minutes."""
    return with_sleep_ratios(algorithmic, "minutes")
