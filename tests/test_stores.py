"""Tables that are kept up to date, re-anchored epochs, subject days and correlations of all pairs."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actispark.operators import clinical, datasets, epochs
from actispark.sources import store

SCHEMA = "group string, x double, SLEEP int"


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_only_changed_groups_are_rebuilt(spark, tmp_path):
    rows = [(g, float(i), i % 2) for g in ("a", "b", "c", None, "d/1=é") for i in range(5)] + [("e", 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = tmp_path / "set"
    got = {r["group"]: (r["action"], r["rows"]) for r in store.update_dataset(df, f"file://{path}").collect()}
    assert got == {g: ("new", 5) for g in ("a", "b", "c", None, "d/1=é")}  # e has no label
    before = {f: t for f, t in files_of(path).items() if not f.startswith("_")}
    changed = df.withColumn("x", F.when((F.col("group") == "b") & (F.col("x") == 3), 9.0).otherwise(F.col("x"))).where("group is null or group not in ('c', 'd/1=é')").union(spark.createDataFrame([("f", 1.0, 1)], SCHEMA))
    got = {r["group"]: r["action"] for r in store.update_dataset(changed, f"file://{path}").collect()}
    assert got == {"a": "same", None: "same", "b": "changed", "c": "gone", "d/1=é": "gone", "f": "new"}
    after = {f: t for f, t in files_of(path).items() if not f.startswith("_")}
    same = [f for f in before if f.startswith(("group=a/", "group=__HIVE_DEFAULT_PARTITION__/"))]
    assert same and all(after[f] == before[f] for f in same)
    assert {f.split("/")[0] for f in after} == {"group=a", "group=b", "group=f", "group=__HIVE_DEFAULT_PARTITION__"}
    read = store.dataset_at(spark, f"file://{path}")
    assert sorted(map(str, read.select("group", "x", "SLEEP").collect())) == sorted(map(str, changed.where("SLEEP is not null").collect()))
    assert {r["action"] for r in store.update_dataset(changed, f"file://{path}").collect()} == {"same"}


def test_a_failed_update_is_done_again(spark, tmp_path, monkeypatch):
    path, df = f"file://{tmp_path}/set", spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0)], SCHEMA)
    store.update_dataset(df, path)
    later = df.withColumn("x", F.col("x") + 1)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "put_version", fail)
        with pytest.raises(OSError):
            store.update_dataset(later, path)
    assert {r["action"] for r in store.update_dataset(later, path).collect()} == {"changed"}
    assert {r["x"] for r in store.dataset_at(spark, path).collect()} == {2.0, 3.0}


def test_dataset_is_built_once(spark, tmp_path):
    path, built = f"file://{tmp_path}/set", []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1.0, 1)], SCHEMA)

    with pytest.raises(FileNotFoundError):
        store.dataset_at(spark, path)
    assert store.dataset_at(spark, path, build).count() == store.dataset_at(spark, path, build).count() == 1
    assert built == [1]


def test_repeated_rows_change_a_groups_mark(spark):
    mark = lambda n: store.group_marks(spark.createDataFrame([("a", 1.0, 1)] * n, SCHEMA), "group").first()["mark"]
    assert len({mark(n) for n in (1, 2, 3, 4)}) == 4


def test_diagnoses_are_imported_once(spark, tmp_path):
    path = f"file://{tmp_path}/subjects"
    sheet = spark.createDataFrame([(1, " a ", "2"), (2, "b", "0"), (3, "zz", "1"), (4, "c", "x"), (5, "a", "3")], "row int, subject string, code string")
    with pytest.raises(FileNotFoundError):
        clinical.import_diagnoses(path, sheet)
    store.put_version(spark.createDataFrame([("a", 1, None), ("b", 2, 0), ("c", 3, 1)], "code string, age int, diagnosis_code int"), path)
    first = clinical.import_diagnoses(path, sheet).first().asDict()
    assert first == {"rows": 5, "invalid_rows": 1, "unique_subjects": 3, "updated": 1, "missing_subjects": 1}
    assert sorted(map(tuple, store.current(spark, path).collect())) == [("a", 1, 3), ("b", 2, 0), ("c", 3, 1)]
    assert clinical.import_diagnoses(path, sheet).first()["updated"] == 0 and store.versions(spark, path) == [1, 2]
    (tmp_path / "subjects/version=3").mkdir()  # what a failed run leaves isn't read, and is written over
    assert store.versions(spark, path) == [1, 2]
    assert store.put_version(store.current(spark, path).cache(), path) == 3 and store.versions(spark, path) == [2, 3]


def plain_epochs(times, size):
    out, start, ended = [], None, True
    for t in times:
        if ended:
            start, ended = t, False
        out.append(start)
        ended = t >= start + size
    return out


@pytest.mark.parametrize("seed", range(3))
def test_epochs_start_anew_after_gaps(spark, seed):
    draw = random.Random(seed)
    rows = []
    for rec in ("a", "b", None):
        t = draw.randrange(10_000_000)
        for i in range(900):
            t += draw.choice([0, 1, 1, 1, 2, 3]) if draw.random() > 0.02 else draw.choice([29, 30, 31, 600, 4000, 90_000])
            rows.append((rec, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)))
    df = spark.createDataFrame([*rows, ("a", -1, None)], "recording_id string, line_no int, ts timestamp_ntz").repartition(5)
    got = {(r["recording_id"], r["line_no"]): r["epoch"] for r in epochs.reanchored_epochs(df, 30, label_offset=15, chunk_hours=0.05).collect()}
    assert len(got) == len(rows)
    for rec in ("a", "b", None):
        own = [(i, t) for k, i, t in rows if k == rec]
        starts = plain_epochs([t.timestamp() for _, t in own], 30)
        for (i, t), s in zip(own, starts, strict=True):
            assert got[rec, i] == datetime.datetime.fromtimestamp(s) + datetime.timedelta(seconds=15)


def test_subject_days_and_sheet(spark):
    d = datetime.date(2024, 1, 1)
    rows = [("s", d, 2, "r1", 4.0, 1), ("s", None, 3, "r2", 6.0, 5), ("s", d, 1, "r0", None, 3), ("t", d, 9, "r9", 0.0, 0), (None, d, 8, "r8", 1.0, 1)]
    df = spark.createDataFrame(rows, "subject string, date date, row int, recording_id string, f double, g int")
    table = datasets.subject_days(df, ["f", "g"], ["recording_id"])
    got = {(r["subject"], r["feature"]): r for r in table.collect()}
    assert set(got) == {(s, f) for s in "st" for f in "fg"}
    assert got["s", "f"]["days"] == [None, 4.0, 6.0] and got["s", "f"]["recording_id"] == "r0" and got["s", "f"]["sd"] == 1.0 and got["s", "f"]["iqr"] == 1.0
    assert got["t", "g"]["cv"] is None and got["t", "g"]["range"] == 0
    sheet = datasets.widen_days(table, ["f", "g"], ["recording_id"], 3)
    assert sheet.columns[:4] == ["subject", "recording_id", "day1.f", "day1.g"] and sheet.columns[-5:] == ["SD.g", "MAD.g", "Range.g", "IQR.g", "CV.g"]
    row = sheet.where("subject = 't'").first().asDict()
    assert row["day1.f"] == 0.0 and row["day2.f"] is None and row["SD.f"] == 0.0
    assert datasets.melted_days(table, ["recording_id"]).count() == 8
    with pytest.raises(ValueError):
        datasets.widen_days(table, ["f", "g"], ["recording_id"], 2)


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_all_pairs_are_each_pair(spark, method):
    rng = np.random.default_rng(1)
    rows = [tuple(None if rng.random() < 0.15 else float(v) for v in (1e6 + rng.normal(), i % 7, i + rng.normal() * 20, 3.0, rng.integers(4))) for i in range(200)]
    df = spark.createDataFrame(rows, "`a.1` double, b double, c double, k double, t double")
    got = {(r["covariate"], r["feature"]): (r["n"], r["r"], r["p"]) for r in clinical.all_correlations(df, ["a.1", "c", "k", "t"], ["b", "c"], method, 6).collect()}
    for x in ("b", "c"):
        for f in ("a.1", "c", "k", "t"):
            one = clinical.covariate_correlations(df.select(F.lit("f").alias("feature"), F.col(f"`{f}`").alias("value"), F.col(x).alias("covariate")), method, 6).first()
            assert got[x, f] == (one["n"], pytest.approx(one["r"], abs=2e-6), pytest.approx(one["p"], abs=2e-6)), (x, f)


@pytest.mark.parametrize(("rows_a_bin", "most"), [(7, 40), (3, 15), (200_000, 1_000_000)])
def test_bins_within_bins(spark, monkeypatch, rows_a_bin, most):
    """Kendall's and Spearman's figures don't depend on how values are cut, nor on one value that half of the rows have."""
    monkeypatch.setattr(clinical, "BIN_ROWS", rows_a_bin)
    monkeypatch.setattr(clinical, "BIN_MOST", most)
    draw = random.Random(9)
    x = [draw.choice([5.0, 5.0, draw.randrange(40), draw.random() * 40]) for _ in range(300)]
    y = [float(draw.choice([a, a + draw.gauss(0, 9), draw.randrange(12)])) for a in x]
    long = spark.createDataFrame([("f", float(a), b) for a, b in zip(x, y, strict=True)] + [("g", b, float(a)) for a, b in zip(x, y, strict=True)], "feature string, value double, covariate double")
    tau, p = clinical.kendall(np.array(x, float), np.array(y))
    got = {r["feature"]: (r["n"], r["r"], r["p"]) for r in clinical.covariate_correlations(long, "kendall", 9).collect()}
    assert got == {f: (300, pytest.approx(tau, abs=1e-8), pytest.approx(p, abs=1e-8)) for f in "fg"}
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    rho = np.corrcoef(rank(x), rank(y))[0, 1]
    got = {r["feature"]: r["r"] for r in clinical.covariate_correlations(long, "spearman", 9).collect()}
    assert got == {f: pytest.approx(rho, abs=1e-8) for f in "fg"}
