"""The major rest period of a day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actispark.operators.wear import islands

KEYS = ["recording_id", "day_no"]


def arm_angle_bins(samples: DataFrame, fs: float, seconds: int = 5, hours: int = 1) -> DataFrame:
    """recording_id, day_no, ts, angle, temp per 5-second bin: means after a trailing median over 5 seconds of rows; bins
    without a value are 0. The median needs order, so rows go to numpy in pieces of an hour with the rows before it."""
    size = int(5 * fs)
    w = Window.partitionBy(*KEYS).orderBy("ts", "line_no")
    at = samples.select(*KEYS, "ts", "line_no", *"xyz", "temp").withColumn("_i", F.row_number().over(w) - 1)
    per = int(hours * 3600 * fs)
    piece = F.floor(F.col("_i") / per)
    halo = F.when((F.col("_i") % per >= per - (size - 1)), F.array(piece, piece + 1)).otherwise(F.array(piece))
    at = at.withColumn("_p", F.explode(halo))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i", ignore_index=True)
        med = rows[["x", "y", "z", "temp"]].rolling(size).median()
        with np.errstate(all="ignore"):
            med["angle"] = np.degrees(np.arctan(med["z"] / np.sqrt(med["x"] ** 2 + med["y"] ** 2)))
        own = rows["_i"] // per == rows["_p"]
        out = pd.concat([rows[[*KEYS, "ts"]], med[["angle", "temp"]]], axis=1)[own]
        out["ts"] = out["ts"].dt.floor(f"{seconds}s")
        return out.groupby([*KEYS, "ts"], as_index=False).agg(angle_sum=("angle", "sum"), angle_n=("angle", "count"), temp_sum=("temp", "sum"), temp_n=("temp", "count"))

    parts = at.groupBy(*KEYS, "_p").applyInPandas(run, "recording_id string, day_no int, ts timestamp_ntz, angle_sum double, angle_n long, temp_sum double, temp_n long")
    bins = parts.groupBy(*KEYS, "ts").agg(*[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in ("angle", "temp")])
    return fill_grid(bins, seconds)


def fill_grid(bins: DataFrame, seconds: int = 5) -> DataFrame:
    """bins with a row for each step between a day's first and last, values 0 where there are none."""
    grid = bins.groupBy(*KEYS).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = grid.select(*KEYS, F.explode(F.sequence("a", "b", F.make_dt_interval(secs=F.lit(seconds)))).alias("ts"))
    return grid.join(bins, [*KEYS, "ts"], "left").fillna(0.0, ["angle", "temp"])


def rolling_median_bins(bins: DataFrame, size: int = 60) -> DataFrame:
    """bins with angle_change and temp: medians over the size bins from a row on, of the absolute change of angle and of
    temp. A day's last size bins are never used."""
    w = Window.partitionBy(*KEYS).orderBy("ts")
    ahead = w.rowsBetween(0, size - 1)
    change = bins.withColumn("change", F.abs(F.col("angle") - F.lag("angle").over(w))).withColumn("_left", F.count("*").over(Window.partitionBy(*KEYS)) - F.row_number().over(w))
    out = change.withColumn("angle_change", F.percentile("change", F.lit(0.5)).over(ahead)).withColumn("temp", F.percentile("temp", F.lit(0.5)).over(ahead))
    full = F.count("change").over(ahead) == size  # a window with an empty change has no median
    return out.withColumn("angle_change", F.when(full, F.col("angle_change"))).where(F.col("_left") >= size).select(*KEYS, "ts", "angle_change", "temp")


def rest_flags(medians: DataFrame, least: float = 0.1, most: float = 1000.0, min_temp: float = 25.0) -> DataFrame:
    """medians with active: 0 (rest) where the change is below the day's limit, 15 times its 10th percentile between least
    and most, and temp is above min_temp; else 1."""
    limits = medians.groupBy(*KEYS).agg(F.least(F.greatest(F.percentile("angle_change", F.lit(0.1)) * 15, F.lit(least)), F.lit(most)).alias("limit"))
    rest = (F.col("angle_change") < F.col("limit")) & (F.col("temp") > min_temp)
    return medians.join(limits, KEYS).withColumn("active", F.when(F.coalesce(rest, F.lit(False)), 0).otherwise(1)).drop("limit")


def _absorb(flags: DataFrame, value: int, limit: int) -> DataFrame:
    """flags with inner runs of value shorter than limit rows turned over."""
    runs = islands(flags, KEYS, ["ts"], "active").withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS, "block"))).withColumn("_last", F.max("block").over(Window.partitionBy(*KEYS)))
    turned = (F.col("active") == value) & (F.col("_n") < limit) & (F.col("block") > 1) & (F.col("block") < F.col("_last"))
    return runs.withColumn("active", F.when(turned, 1 - value).otherwise(F.col("active"))).drop("_n", "_last", "block")


def major_rest_periods(flags: DataFrame, minimum_rest_block: int = 30, allowed_rest_break: int = 60, bins_a_minute: int = 12) -> DataFrame:
    """recording_id, day_no, rest_start, rest_end (null without rest) of the longest rest run, the first of equals, after
    short inner rest runs and then short inner active ones are absorbed; the end is 5 minutes after its last bin."""
    flags = _absorb(_absorb(flags, 0, bins_a_minute * minimum_rest_block), 1, bins_a_minute * allowed_rest_break)
    runs = islands(flags, KEYS, ["ts"], "active").groupBy(*KEYS, "block").agg(F.count("*").alias("n"), F.first("active").alias("active"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    rest = F.when(F.col("active") == 0, F.struct((-F.col("n")).alias("n"), "a", "b"))  # the least is the longest, then the first
    best = runs.groupBy(*KEYS).agg(F.min(rest).alias("r"))
    return best.select(*KEYS, F.col("r.a").alias("rest_start"), (F.col("r.b") + F.expr("INTERVAL 5 MINUTES")).alias("rest_end"))
