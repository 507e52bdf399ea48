"""Sleep and wake by minute, its rescoring, a day's endpoints and its minute report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actispark.operators.wear import islands

KEYS = ["recording_id", "day_no"]

#: The weights of the minutes from four before to four after, and the scale for the activity index.
WEIGHTS = (4.64, 6.87, 3.75, 5.07, 16.19, 5.84, 4.024, 0.0, 0.0)
SCALE = 0.193125


def cole_kripke(ai: DataFrame, keys: list[str] = KEYS, value: str = "activity_index", scale: float = SCALE) -> DataFrame:
    """ai with score and wake (1 where score is 0.5 or more): a weighted sum over a row and its neighbours, 0 outside."""
    w = Window.partitionBy(*keys).orderBy("ts")
    near = lambda k: F.lag(value, k, 0.0).over(w) if k > 0 else F.lead(value, -k, 0.0).over(w) if k else F.col(value)
    score = sum((c * near(4 - i) for i, c in enumerate(WEIGHTS) if c), F.lit(0.0))
    return ai.withColumn("score", scale * score).withColumn("wake", (F.col("score") >= 0.5).cast("int"))


#: After so many minutes of wake, so many minutes of sleep count as wake (rules a to c); and rule d's sleep of
#: at most SHORT minutes between AROUND minutes of wake or more.
AFTER, EXTENDED = (4, 10, 15), (0, 1, 3, 4)
SHORT, AROUND = 6, 10


def _sleep_runs(wake: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of each run of sleep."""
    edges = np.flatnonzero(np.diff(np.concatenate(([1], wake, [1]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def webster(wake: np.ndarray) -> np.ndarray:
    """Webster's rules on one day's minutes, run by run. Minutes that rules a to c have turned count as wake for the next
    run, but the first of them doesn't: there the count began anew."""
    out = wake.copy()
    counted_from, turned_to = 0, 0  # wake is counted from here; minutes before the other are turned
    for first, end in _sleep_runs(wake):
        at = max(first, turned_to)
        if at < end:
            turned_to = at + EXTENDED[int(np.searchsorted(AFTER, at - counted_from, "right"))]
            out[at:turned_to] = 1
            counted_from = end if turned_to < end else at + 1
    runs = _sleep_runs(out)
    before = 0  # the end of the last sleep that stays
    for i, (first, end) in enumerate(runs):
        behind = runs[i + 1][0] if i + 1 < len(runs) else len(out)
        if end - first <= SHORT and first - before >= AROUND and behind - end >= AROUND and end + AROUND < len(out):
            out[first:end] = 1
        else:
            before = end
    return out


def webster_rescore(df: DataFrame, keys: list[str] = KEYS, col: str = "wake") -> DataFrame:
    """df with col rescored. What a rule has written is read by the next minute, so a day (at most 1440 rows) is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        return rows.assign(**{col: webster(rows[col].to_numpy())})

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def sleep_endpoints(sleep_wake: DataFrame, rest_periods: DataFrame) -> DataFrame:
    """A row a day, from the minutes in its rest period (all minutes where it has none): total_sleep_time,
    percent_time_asleep, waso, sleep_onset_latency, number_wake_bouts, number_wake_bouts_5min."""
    at = sleep_wake.join(rest_periods.select(*KEYS, "rest_start", "rest_end"), KEYS, "left")
    at = at.where(F.col("rest_start").isNull() | F.col("ts").between(F.col("rest_start"), F.col("rest_end")))
    runs = islands(at, KEYS, ["ts"], "wake")
    blocks = runs.groupBy(*KEYS, "block").agg(F.count("*").alias("n"), F.sum("wake").alias("w"), F.min("ts").alias("first"))
    w = Window.partitionBy(*KEYS)
    blocks = blocks.withColumn("onset", F.coalesce(F.min(F.when(F.col("w") == 0, F.col("first"))).over(w), F.min("first").over(w)))
    n, wake = F.sum("n"), F.sum("w")
    return blocks.groupBy(*KEYS).agg(
        (n - wake).cast("int").alias("total_sleep_time"), F.bround(100.0 * (n - wake) / n).cast("int").alias("percent_time_asleep"),
        F.coalesce(F.sum(F.when(F.col("first") >= F.col("onset"), F.col("w"))), F.lit(0)).cast("int").alias("waso"),
        F.floor(F.timestamp_diff("SECOND", F.min("first"), F.min("onset")) / 60).cast("int").alias("sleep_onset_latency"),
        F.count_if(F.col("w") > 0).cast("int").alias("number_wake_bouts"), F.count_if(F.col("w") > 5).cast("int").alias("number_wake_bouts_5min"),
    )


def minute_report(days: DataFrame, samples: DataFrame, angle_bins: DataFrame, ai: DataFrame, rest: DataFrame, wake: DataFrame, wear: DataFrame) -> DataFrame:
    """1440 rows from noon for each of days(recording_id, day_no, noon): medians of raw values, the greatest angle, index,
    rest and wake flags, and wear carried forward."""
    grid = days.select(*KEYS, F.explode(F.sequence("noon", F.col("noon") + F.expr("INTERVAL 1439 MINUTES"), F.expr("INTERVAL 1 MINUTE"))).alias("ts"))
    by = lambda d, *a: d.groupBy(*KEYS, F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(*a)
    parts = [
        by(samples, *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("x", "y", "z", "lux", "temp")]), by(angle_bins, F.max("angle").alias("angle")), by(ai, F.max("activity_index").alias("activity_index")),
        by(rest, F.max("active").alias("active")), by(wake, F.max("wake").alias("wake")), by(wear, F.max("wear").alias("wear")),
    ]
    for p in parts:
        grid = grid.join(p, [*KEYS, "ts"], "left")
    forward = Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("wear", F.last("wear", ignorenulls=True).over(forward))
