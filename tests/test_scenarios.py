"""How often the scenario reports read what they come from."""

import os
import random

import pytest
from pyspark.sql import functions as F

from actispark.operators import clinical, datasets, jobs
from actispark.sources import scratch


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(4)
    rows = [(f"s{i}" if i else None, d, draw.gauss(0, 5 if i % 2 else 1), None if d == 2 else draw.gauss(0, 1)) for i in range(30) for d in range(5)]
    days = spark.createDataFrame(rows, "subject string, row int, a double, b double").withColumn("date", F.lit("2024-01-01").cast("date"))
    return days, spark.createDataFrame([(f"s{i}", 3 if i % 2 else 0) for i in range(29)], "code string, diagnosis_code int")


def test_days_are_read_once(made):
    """The statistics are those of the days' table, from one scan without windows."""
    days, subjects = made
    got = jobs.scenario_features(days, subjects, ["a", "b"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # days and subjects
    stats = {(r["subject"], r["feature"]): r for r in datasets.subject_days(days, ["a", "b"], []).collect()}
    rows = got.collect()
    assert len(rows) == 28 and set(got.columns) == {"subject", "diagnosis_code", *(f"{f}.{s}" for f in ("a", "b") for s in jobs.STATISTICS)}
    for r in rows:
        assert all(r[f"{f}.{s}"] == pytest.approx(stats[r["subject"], f][s]) for f in ("a", "b") for s in jobs.STATISTICS)


def test_written_rows_cut_their_lineage(spark):
    """What is written is read as a table and goes with the block, if that fails too."""
    folder = f"{scratch.shared_dir(spark)}/actispark".removeprefix("file://")
    with pytest.raises(ValueError, match="stop"), scratch.written(spark.range(3).withColumn("x", F.rand()), "once") as rows:
        assert rows.collect() == rows.collect() and "Range" not in rows._jdf.queryExecution().executedPlan().toString()
        assert any(x.startswith("once-") for x in os.listdir(folder))
        raise ValueError("stop")
    assert not any(x.startswith("once-") for x in os.listdir(folder))


def test_reports_compute_their_table_once(spark, made):
    """Each row of the table is made once, however many jobs there are."""
    days, subjects = made
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    table = clinical.attach_diagnosis(days.groupBy("subject").agg(F.stddev("a").alias("sd")), subjects)[0]
    table = table.mapInArrow(count, table.schema)
    got = jobs.scenario_reports(table, {"maxIter": [1], "maxDepth": [1]}, 1, outer=2, inner=2, scenarios=(((3,), (0,)),)).collect()
    assert len(got) == 2 and all(r["tp"] + r["tn"] + r["fp"] + r["fn"] == 28 for r in got) and seen.value == 28
