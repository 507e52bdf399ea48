from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from actispark.functions import scalars as S


def one(spark, expr, schema="a double, b double, c double", row=(0.0, 0.0, 0.0)):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()[0]


def test_magnitude_and_angle(spark):
    assert one(spark, S.magnitude("a", "b", "c"), row=(2.0, 3.0, 6.0)) == 7.0
    assert one(spark, S.z_angle("a", "b", "c"), row=(0.0, 0.0, 1.0)) == 0.0
    assert one(spark, S.z_angle("a", "b", "c"), row=(1.0, 0.0, 1.0)) == pytest.approx(45.0)


def test_safe_div(spark):
    assert one(spark, S.safe_div("a", "b"), row=(1.0, 0.0, 0.0)) is None
    assert one(spark, S.safe_div("a", "b"), row=(1.0, 4.0, 0.0)) == 0.25


@pytest.mark.parametrize(
    "norm,age,value,code",
    [
        (S.norm_sol, 30, 1800, 1), (S.norm_sol, 30, 1801, 0), (S.norm_sol, 30, 2701, -1), (S.norm_sol, 65, 3600, 0), (S.norm_sol, 65, 3601, -1),
        (S.norm_awk5plus, 30, 1, 1), (S.norm_awk5plus, 30, 2, 0), (S.norm_awk5plus, 65, 2, 1), (S.norm_awk5plus, 65, 3, 0), (S.norm_awk5plus, 15, 3, -1), (S.norm_awk5plus, 30, 4, -1),
        (S.norm_waso, 30, 20, 1), (S.norm_waso, 30, 21, 0), (S.norm_waso, 30, 41, -1), (S.norm_waso, 65, 30, 1), (S.norm_waso, 65, 999, 0), (S.norm_waso, 15, 50, 0), (S.norm_waso, 5, 51, -1),
        (S.norm_se, 30, 85, 1), (S.norm_se, 30, 75, 0), (S.norm_se, 30, 74, -1), (S.norm_se, 20, 65, 0), (S.norm_se, 20, 64, -1),
    ],
)
def test_norms(spark, norm, age, value, code):
    assert one(spark, norm("a", "b"), "a int, b int", (age, value)) == code


def test_norm_of_null(spark):
    assert one(spark, S.norm_se("a", "b"), "a int, b int", (30, None)) is None


def test_binarize(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", None), ("b", 0.5), ("b", 0.49)], "k string, score double")
    rows = sorted(map(tuple, S.binarize_scores(df, ["k"]).collect()), key=str)
    assert rows == sorted([("a", 0), ("a", 1), ("a", None), ("b", 1), ("b", 0)], key=str)


def test_psg_midnight(spark):
    d = date(2024, 1, 1)
    rows = [("r", 0, d, "23:59:45"), ("r", 1, d, "00:00:00"), ("r", 2, d, "01:00:00"), ("s", 0, d, "03:00:00"), ("s", 1, d, "04:00:00"), ("t", 0, d, "12:00:00")]
    out = {(r["recording_id"], r["row_no"]): r["ts"] for r in S.psg_timestamps(spark.createDataFrame(rows, "recording_id string, row_no int, recording_date date, clock string")).collect()}
    assert out == {
        ("r", 0): datetime(2024, 1, 1, 23, 59, 45), ("r", 1): datetime(2024, 1, 2), ("r", 2): datetime(2024, 1, 2, 1), ("s", 0): datetime(2024, 1, 2, 3), ("s", 1): datetime(2024, 1, 2, 4), ("t", 0): datetime(2024, 1, 1, 12),
    }


def test_tkeo_ends(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 4.0])] + [("b", 0, 5.0)], "k string, ts int, v double")
    assert [r["tkeo"] for r in S.tkeo(df, ["k"], ["ts"], "v").orderBy("k", "ts").collect()] == [0.0, 0.0, 0.0, 0.0]


def test_clean_scored(spark):
    df = spark.createDataFrame([(0, 0.5), (1, float("nan")), (1, float("inf")), (2, 0.5), (None, 0.5), (1, 0.0)], "SLEEP int, SLEEP_PREDICTION double")
    assert sorted(map(tuple, S.clean_scored(df).collect())) == [(0, 0.5), (1, 0.0)]
    assert [r[1] for r in S.inf_to_null(df, ["SLEEP_PREDICTION"]).collect()] == [0.5, None, None, 0.5, 0.5, 0.0]


def test_ratios(spark):
    df = spark.createDataFrame([(1000, 100, 50, 50, 4), (0, 0, 0, 0, 1)], "tib int, sol int, waso int, wasf int, wb int")
    first, second = S.with_sleep_ratios(df).collect()
    assert (first["tst"], first["se"], round(first["sf"], 6)) == (800, 80.0, 18.0)
    assert second["se"] is None and second["sf"] is None


def test_texts(spark):
    assert one(spark, S.display_feature("a"), "a string", ("SD.x.y",)) == "x.y (SD)"
    assert one(spark, S.display_feature("a"), "a string", ("x",)) == "x"
    assert S.scenario_label((3, 2), (0,)) == "scenario-preDLB+MCI-AD_vs_HC"
    assert one(spark, S.seconds_of("a"), "a string", (" 07:05 ",)) == 25_500
    assert one(spark, S.seconds_of("a"), "a string", ("soon",)) == S.INVALID_TIME


def test_prepare_clinical(spark):
    df = spark.createDataFrame([("s", "d", " f", "1.5"), ("s", "d", "x", "n/a")], "`#Subject` string, `#Date` string, `#Gender` string, `a.b` string")
    assert [tuple(r) for r in S.prepare_clinical(df).collect()] == [("s", "d", 1.0, 1.5), ("s", "d", None, None)]


def test_rbdsq_latest(spark):
    cols = ", ".join(f"{q} boolean" for q in S.RBDSQ)
    rows = [("s", date(2024, 1, i), *([True] * i + [None] * (13 - i))) for i in (1, 2)]
    df = spark.createDataFrame(rows, f"subject string, creation_date date, {cols}")
    assert [r["score"] for r in S.rbdsq_scores(df).collect()] == [2]
    assert S.rbdsq_scores(df, latest=False).select(F.sum("score")).first()[0] == 3
