"""Wear detection and its rescoring, on runs of equal values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], col: str, out: str = "block") -> DataFrame:
    """df with the number (1, 2 ...) of the run of equal values of col that a row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (~F.col(col).eqNullSafe(F.lag(col).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_c", change).withColumn(out, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def wear_detection(samples: DataFrame, fs: float, sd_limit: float = 0.013, range_limit: float = 0.15) -> DataFrame:
    """recording_id, day_no, ts, wear for windows of 60 minutes every 15, by sample count: worn where on two axes or more
    the standard deviation and the range reach their limits. Quarters of an hour are summed up first, then four at a time;
    a window starts only where more than a quarter's samples follow."""
    step = int(15 * 60 * fs)
    day = Window.partitionBy("recording_id", "day_no")
    at = samples.withColumn("_i", F.row_number().over(day.orderBy("ts", "line_no")) - 1).withColumn("_n", F.count("*").over(day))
    part = [x for a in "xyz" for x in (F.sum(a).alias(f"s{a}"), F.sum(F.col(a) * F.col(a)).alias(f"q{a}"), F.min(a).alias(f"l{a}"), F.max(a).alias(f"h{a}"))]
    quarters = at.groupBy("recording_id", "day_no", F.floor(F.col("_i") / step).alias("quarter")).agg(F.min("ts").alias("ts"), F.count("*").alias("n"), F.first("_n").alias("_n"), *part)
    hour = day.orderBy("quarter").rowsBetween(0, 3)
    n = F.sum("n").over(hour)
    sd_hits, range_hits = F.lit(0), F.lit(0)
    for a in "xyz":
        s = F.sum(f"s{a}").over(hour)
        var = (F.sum(f"q{a}").over(hour) - s * s / n) / F.nullif(n - 1, F.lit(0))
        sd_hits += F.coalesce((F.sqrt(F.greatest(var, F.lit(0.0))) >= sd_limit).cast("int"), F.lit(0))
        range_hits += F.coalesce((F.max(f"h{a}").over(hour) - F.min(f"l{a}").over(hour) >= range_limit).cast("int"), F.lit(0))
    worn = quarters.withColumn("wear", ((sd_hits >= 2) & (range_hits >= 2)).cast("int"))
    return worn.where(F.col("quarter") * step < F.col("_n") - step).select("recording_id", "day_no", "ts", "wear")


def _rescore(df: DataFrame, rule, order: tuple[str, ...]) -> DataFrame:
    """df(recording_id, day_no, wear and order's columns) with the worn runs that rule picks set to 0; rule sees size, prev
    and post: rows of the run and of its neighbours (null at the ends). Rows are put in order once, to number the runs;
    neighbours go by that number, since rows that order leaves tied may come otherwise in another sort. Windows only, on one
    exchange by recording and day."""
    keys = ["recording_id", "day_no"]
    near = Window.partitionBy(*keys).orderBy("block")
    runs = islands(df, keys, list(order), "wear").withColumn("size", F.count("*").over(Window.partitionBy(*keys, "block")))
    runs = runs.withColumn("prev", F.first("size").over(near.rangeBetween(-1, -1))).withColumn("post", F.first("size").over(near.rangeBetween(1, 1)))
    return runs.withColumn("wear", F.when((F.col("wear") == 1) & rule, 0).otherwise(F.col("wear"))).drop("block", "size", "prev", "post")


def rescore_wear(df: DataFrame, passes: int = 3, last_day: bool = True, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Inner worn runs under 3 h with less than 80 % of both neighbours' length, or under 6 h with less than 30 %, count as
    not worn, passes times; on a recording's last day also runs under 3 h after one of 1 h or more. Where rows of a day share
    a ts, order needs a further column, or which runs there are is open."""
    hours, around = F.col("size") * 0.25, (F.col("prev") + F.col("post")) * 0.25
    inner = (hours < 3) & (hours / around < 0.8) | (hours < 6) & (hours / around < 0.3)
    for _ in range(passes):
        df = _rescore(df, F.coalesce(inner, F.lit(False)), order)
    if not last_day:
        return df
    df = df.withColumn("_d", F.max("day_no").over(Window.partitionBy("recording_id")))
    return _rescore(df, F.coalesce((F.col("day_no") == F.col("_d")) & (hours < 3) & (F.col("prev") * 0.25 >= 1), F.lit(False)), order).drop("_d")
