"""What the join of samples and polysomnography moves, and what it gives for equal rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actispark.operators import epochs

T0 = datetime(2024, 1, 1, 12)


@pytest.fixture
def written(spark):
    """A function that tells how many rows a table's shuffles write."""

    def count(df):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where both sides are large
        tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
        spark.sparkContext.setJobGroup(group := f"written {id(df)}", group)
        try:
            df.write.format("noop").mode("overwrite").save()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    return count


def test_few_rows_are_moved_twice(spark, written):
    """An epoch a row: a quarter of them reaches over a bucket's end, the others are in one bucket."""
    rows = spark.range(4000).select((F.col("id") % 3).cast("string").alias("recording_id"), F.col("id").alias("line_no"), F.timestamp_seconds(F.col("id") * 15 + 1_700_000_007).cast("timestamp_ntz").alias("ts"))
    psg = rows.select("recording_id", "ts", (F.col("line_no") % 2).cast("int").alias("sleep"))
    got = epochs.psg_epochs(rows, psg)
    assert got.count() == 4000 and got.where(F.col("ts") != F.col("epoch")).count() == 0
    assert written(got) <= 2.3 * 4000  # 3 rows a row with all psg rows in two buckets


def test_equal_psg_rows_are_repeated(spark):
    """Rows that are equal, differ in sleep only, have no sleep or lie on a bucket's end give a row for each pair."""
    rows = [("r", i, T0 + timedelta(seconds=i * 1.7)) for i in range(150)]
    psg = [("r", T0 + timedelta(seconds=s), sleep) for s in (0, 14, 45.5, 59.999999, 60, 119, 180) for sleep in (0, 0, 0, 1, None, None)] + [("q", T0, 1)]
    got = epochs.psg_epochs(spark.createDataFrame(rows, "recording_id string, line_no long, ts timestamp_ntz"), spark.createDataFrame(psg, "recording_id string, ts timestamp_ntz, sleep int"))
    expected = sorted(((i, p[1], p[2]) for _, i, t in rows for p in psg if p[0] == "r" and p[1] <= t < p[1] + timedelta(seconds=15)), key=str)
    assert sorted(((r["line_no"], r["epoch"], r["sleep"]) for r in got.collect()), key=str) == expected
    joined = got._jdf.queryExecution().executedPlan().toString().split("Join", 1)[1]
    assert got.columns == ["recording_id", "line_no", "ts", "epoch", "sleep"] and "HashAggregate" in joined  # one of equal rows meets the samples
