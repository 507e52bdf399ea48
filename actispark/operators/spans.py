"""Rows in spans of time: an equal join on key and date, then the range, so a row meets its own days' spans only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(rows: DataFrame, spans: DataFrame, key: str, lo: str, hi: str, how: str = "inner", ts: str = "ts") -> DataFrame:
    """rows joined with the spans of their key with lo <= ts <= hi. A row has one date, so a pair comes up once."""
    dated = spans.withColumnRenamed(key, "_key").withColumn("_date", F.explode(F.sequence(F.to_date(lo), F.to_date(hi))))
    on = (F.col(key) == F.col("_key")) & (F.to_date(ts) == F.col("_date")) & F.col(ts).between(F.col(lo), F.col(hi))
    joined = rows.join(dated, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_key", "_date")
