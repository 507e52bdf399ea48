"""Training: folds, stopping, storing, nested validation, importances."""

import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from actispark.operators import evaluate, model

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def epochs(spark):
    """Twelve groups; the label follows a, with one label in fifteen turned round; b is noise, c partly null."""
    rng = np.random.default_rng(5)
    a, b, c, t = rng.random((4, 1200))
    rows = [(f"g{i % 12}", float(a[i]), float(b[i]), float(c[i]) if c[i] > 0.2 else None, int((a[i] > 0.55) != (t[i] < 1 / 15)), int(t[i] > 0.5)) for i in range(1200)]
    return spark.createDataFrame(rows, "group string, `a|x.1` double, b double, c double, SLEEP int, noise int").repartition(3).cache()


NAMES = ["a|x.1", "b", "c"]


@pytest.mark.parametrize(("groups", "most"), [(40_000, 500), (3, 10_000), (50, 8)])
def test_folds_keep_one_law(spark, groups, most):
    """Many tiny groups and one that is larger than a fold; few groups; fewer buckets than groups."""
    df = spark.range(groups).select(F.col("id").cast("string").alias("g")).union(spark.range(max(1, groups // 5)).select(F.lit("big").alias("g")))
    got = model.group_folds(df, "g", 4, most)
    assert got.count() == df.count() and got.select("g", "fold").distinct().count() == groups + 1
    n = sorted(r["count"] for r in got.groupBy("fold").count().collect())
    if groups == 40_000:
        assert n[0] > 0.9 * n[-1]
    elif groups == 50:
        assert len(n) == 4


def test_null_groups_have_folds(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    for most in (1, 10_000):
        got = {(r["g"], r["v"]): r["fold"] for r in model.group_folds(df, "g", 2, most).collect()}
        assert len(got) == 3 and None not in got.values() and got[None, 1] == got[None, 2]


def test_rounds_stop_by_themselves(epochs):
    rounds, curve = model.best_rounds(epochs, NAMES, k=3, most=60, least_gain=0.02, maxDepth=2)
    curve = {r["round"]: r["loss"] for r in curve.collect()}
    assert 1 < rounds < 60 and len(curve) < 60 and curve[rounds] == min(curve.values()) < curve[1]
    noise, flat = model.best_rounds(epochs, NAMES, k=3, most=60, label="noise", maxDepth=2)
    assert noise <= 5 and flat.count() < 20


def test_stopped_model(epochs):
    fitted, rounds = model.train_stopped(epochs, ["a|x.1"], k=2, most=8, least_gain=0.05, maxDepth=1)
    assert fitted.pipeline.stages[-1].getNumTrees == rounds


def test_stored_model_in_another_session(spark, epochs, tmp_path):
    fitted = model.train_sleep_model(epochs, NAMES, maxIter=3, maxDepth=2)
    path, rows, out = (f"file://{tmp_path}/{x}" for x in ("model", "rows", "out"))
    fitted.save(path)
    epochs.write.parquet(rows)
    code = f"""
from pyspark.sql import SparkSession
from actispark.operators.model import SleepModel
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
m = SleepModel.load({path!r})
assert set(m.medians) == {set(NAMES)!r}
m.transform(spark.read.parquet({rows!r})).write.parquet({out!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, cwd=ROOT, timeout=300)
    columns = ["group", "b", "SLEEP", "SLEEP_PREDICTION"]
    again = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    assert again == sorted(map(tuple, fitted.transform(epochs).select(columns).collect()))
    fitted.save(path)  # over an older one
    assert model.SleepModel.load(path).medians == fitted.medians


def test_fits_overlap_and_fail_together(spark):
    spans = {}

    def work(name):
        began = time.time()
        spark.range(3).mapInPandas(lambda batches: (b for b in batches if time.sleep(0.4) is None), "id long").count()
        spans[name] = began, time.time()
        return name

    assert model.at_once(spark, {n: lambda n=n: work(n) for n in "abcd"}, most=2) == {n: n for n in "abcd"}
    assert sum(s1 < e2 and s2 < e1 for k1, (s1, e1) in spans.items() for k2, (s2, e2) in spans.items() if k1 < k2) >= 2
    with pytest.raises(ZeroDivisionError):
        model.at_once(spark, {"good": lambda: 1, "bad": lambda: 1 // 0})


def test_cross_validation_and_search(epochs):
    got = model.cross_validate(epochs, NAMES, k=3, maxIter=4, maxDepth=2).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2] and all(r["ACC"] > 0.85 for r in got)
    best = model.random_search(epochs, NAMES, {"maxIter": [1, 4], "maxDepth": [1]}, 2, k=2)
    assert len(best) == 2 and best[0][1] >= best[1][1] > 0.5


def test_no_outer_row_reaches_its_threshold(epochs):
    """Other labels in an outer fold change neither its parameters nor its threshold nor its rows' scores."""
    grid = {"maxIter": [2], "maxDepth": [1, 2]}
    folds, rows = model.nested_validation(epochs, NAMES, grid, 2, outer=2, inner=2)
    turned = model.nested_folds(epochs, "group", 2, 2).withColumn("SLEEP", F.when(F.col("outer") == 0, 1 - F.col("SLEEP")).otherwise(F.col("SLEEP"))).drop("outer", "inner")
    folds2, rows2 = model.nested_validation(turned, NAMES, grid, 2, outer=2, inner=2)
    first = [[tuple(r) for r in f.where("outer = 0").collect()] for f in (folds, folds2)]
    assert first[0] == first[1]
    assert [tuple(r) for r in folds.where("outer = 1").collect()] != [tuple(r) for r in folds2.where("outer = 1").collect()]
    scores = [sorted((r["group"], r["y_prob"]) for r in f.where("outer = 0").collect()) for f in (rows, rows2)]
    assert scores[0] == scores[1]
    assert rows.count() == epochs.count()
    assert evaluate.binary_metrics(rows, ["outer"]).agg(F.min("ACC")).first()[0] > 0.85
    per = {r["group"] for r in rows.where("outer = 0").collect()}, {r["group"] for r in rows.where("outer = 1").collect()}
    assert not per[0] & per[1]


def test_planted_feature_is_most_important(epochs):
    got = model.fold_importances(epochs, NAMES, k=2, maxIter=3, maxDepth=2).collect()
    assert len(got) == 6
    for fold in (0, 1):
        best = max((r for r in got if r["fold"] == fold), key=lambda r: r["importance"])
        assert best["feature"] == "a|x.1" and best["importance"] > 0.1
    alone = model.permuted_importances(model.train_sleep_model(epochs, NAMES, maxIter=2, maxDepth=2), epochs).collect()
    assert max(alone, key=lambda r: r["importance"])["feature"] == "a|x.1"
    assert evaluate.top_features(model.permuted_importances(model.train_sleep_model(epochs, NAMES, maxIter=2, maxDepth=2), epochs), 1).first()["feature"] == "a|x.1"
