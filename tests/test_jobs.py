"""Whole jobs on made recordings and subjects."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actispark.operators import jobs, model

START = datetime.datetime(2024, 3, 1, 22)


@pytest.fixture(scope="module")
def night(spark):
    """Eight recordings of 40 minutes at half a Hertz: still while asleep, with gaps, and a scoring every 15 s."""
    rng = np.random.default_rng(8)
    rows, psg = [], []
    for r in range(8):
        asleep = np.repeat(rng.integers(0, 2, 16), 10)
        for e, s in enumerate(asleep):
            psg.append((f"r{r}", START + datetime.timedelta(seconds=15 * e), int(s)))
            if rng.random() < 0.03:
                continue  # a gap
            for i in range(0, 15, 2):
                x, y, z = rng.normal(size=3) * (0.05 if s else 0.6)
                rows.append((f"r{r}", 1000 * e + i, START + datetime.timedelta(seconds=15 * e + i), float(x), float(y), float(1 + z), 25.0 + float(s)))
    samples = spark.createDataFrame(rows, "recording_id string, line_no int, ts timestamp_ntz, x double, y double, z double, temp double").repartition(4)
    return samples, spark.createDataFrame(psg, "recording_id string, ts timestamp_ntz, sleep int")


def test_train_store_validate(spark, night, tmp_path):
    samples, psg = night
    done = jobs.train_and_validate(samples, psg, f"file://{tmp_path}/job", folds=2, most=12, least_gain=0.05, maxDepth=2)
    report = {r["file"]: r for r in done["report"].collect()}
    test, seen = ({r["group"] for r in done["training"].where(c).select("group").distinct().collect()} for c in ("test", "not test"))
    assert test and seen and not test & seen and set(report) == {*test, None}
    assert report[None]["accuracy"] > 0.9 and report[None]["overall"] == 1 and all(report[f]["accuracy"] > 0.8 for f in test)
    assert done["curve"].count() < 12
    # the stored model scores recordings without a scoring, epoch by epoch in bed
    fitted = model.SleepModel.load(f"file://{tmp_path}/job/model")
    bed = spark.createDataFrame([("r1", START, START + datetime.timedelta(minutes=20)), ("r2", START, START + datetime.timedelta(minutes=5))], "subject string, lo timestamp_ntz, hi timestamp_ntz")
    scores = jobs.recordings_to_scores(fitted, samples, bed).collect()
    assert {r["recording_id"] for r in scores} == {"r1", "r2"} and all(0 <= r["score"] <= 1 for r in scores)
    truth = {(r["recording_id"], r["ts"]): r["sleep"] for r in psg.collect()}
    near = [(r["score"] >= 0.5) == truth[r["recording_id"], START + datetime.timedelta(seconds=15 * ((r["ts"] - START).seconds // 15))] for r in scores]
    assert sum(near) > 0.8 * len(near)


def test_scenarios(spark):
    """Two diagnoses differ in how much one feature varies from day to day."""
    draw = random.Random(3)
    rows = [(f"s{i}", d, draw.gauss(0, 5 if i % 2 else 1), draw.gauss(0, 1), 0.0, None if d else 1.0) for i in range(48) for d in range(6)]
    days = spark.createDataFrame(rows, "subject string, row int, a double, b double, zero double, rare double").withColumn("date", F.lit("2024-01-01").cast("date"))
    subjects = spark.createDataFrame([(f"s{i}", 3 if i % 2 else 0) for i in range(47)], "code string, diagnosis_code int")
    table = jobs.scenario_features(days, subjects, ["a", "b", "zero", "rare"])
    assert table.count() == 47 and "a.sd" in table.columns
    got = jobs.scenario_reports(table, {"maxIter": [2], "maxDepth": [1]}, 1, outer=2, inner=2, scenarios=(((3,), (0,)), ((2,), (0,)))).collect()
    by = {(r["scenario"], r["kind"]): r for r in got}
    tuned = by["scenario-preDLB_vs_HC", "tuned"]
    assert tuned["n_features"] == 10 and tuned["ACC"] > 0.85 and tuned["tp"] + tuned["tn"] + tuned["fp"] + tuned["fn"] == 47
    assert ("scenario-MCI-AD_vs_HC", "default") in by  # one class only: nothing to fit, and no failure
