"""The registry of queries, and views that make sleep tables of the driver's tables, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of five recordings."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("recording_id"), F.col("event_id").alias("line_no"), "ts",
        (F.col("value") / 100).alias("x"), ((k - 50) / 50).alias("y"), ((F.col("event_id") % 21 - 10) / 10).alias("z"), (20 + k / 10).alias("temp"),
    )


SAMPLES = """samples AS (SELECT CAST(user_id % 5 AS VARCHAR) recording_id, event_id line_no, ts, value / 100 x,
 (CAST(json_extract_string(props, '$.k') AS INT) - 50) / 50 y, (event_id % 21 - 10) / 10 z,
 20 + CAST(json_extract_string(props, '$.k') AS INT) / 10 temp FROM events)"""


def scored_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as epochs of five recordings with a sleep score in 0..0.99."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("recording_id"), "ts", (F.get_json_object("props", "$.k").cast("int") / 100).alias("score"), F.col("event_id").alias("line_no"))


EPOCHS = "epochs AS (SELECT CAST(user_id % 5 AS VARCHAR) recording_id, ts, CAST(json_extract_string(props, '$.k') AS INT) / 100 score, event_id line_no FROM events)"


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subjects."""
    k, c = F.col("c_custkey"), F.col("c_nationkey") % 5
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("code"), (18 + k % 70).cast("int").alias("age"), F.when(k % 2 == 0, "M").otherwise("F").alias("sex"), F.when(c < 4, c).cast("int").alias("diagnosis_code"),
        (c == 3).alias("pPD"), (c == 2).alias("pMCI"), (c == 0).alias("HC"), (k % 7 == 0).alias("SA"),
    )


SUBJECTS = """subjects AS (SELECT CAST(c_custkey AS VARCHAR) code, CAST(18 + c_custkey % 70 AS INT) age, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END sex,
 CASE WHEN c_nationkey % 5 < 4 THEN c_nationkey % 5 END diagnosis_code, c_nationkey % 5 = 3 pPD, c_nationkey % 5 = 2 pMCI, c_nationkey % 5 = 0 HC, c_custkey % 7 = 0 SA FROM customer)"""


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nights."""
    k = F.col("o_orderkey")
    whole = lambda c: c.cast("int")
    return table(spark, sf_dir, "orders").select(
        k.alias("night_id"), k.alias("day_id"), F.col("o_custkey").cast("string").alias("subject"), (F.col("o_custkey") % 50).cast("string").alias("recording_id"), F.to_date("o_orderdate").alias("date"),
        whole(20000 + k * 37 % 20000).alias("tib"), whole(k * 13 % 5400).alias("sol"), whole(k * 7 % 90).alias("waso"), whole(k * 11 % 1800).alias("wasf"), whole(k % 40).alias("wb"), whole(k % 6).alias("awk5plus"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(22), secs=(k * 101 % 14400).cast("decimal(18,6)"))).alias("sleep_onset"),
    ).withColumn("sleep_end", F.col("sleep_onset") + F.expr("INTERVAL 7 HOURS"))


NIGHTS = """nights AS (SELECT *, sleep_onset + INTERVAL 7 HOUR sleep_end FROM (SELECT o_orderkey night_id, o_orderkey day_id, CAST(o_custkey AS VARCHAR) subject, CAST(o_custkey % 50 AS VARCHAR) recording_id, CAST(o_orderdate AS DATE) date,
 CAST(20000 + o_orderkey * 37 % 20000 AS INT) tib, CAST(o_orderkey * 13 % 5400 AS INT) sol, CAST(o_orderkey * 7 % 90 AS INT) waso, CAST(o_orderkey * 11 % 1800 AS INT) wasf, CAST(o_orderkey % 40 AS INT) wb, CAST(o_orderkey % 6 AS INT) awk5plus,
 o_orderdate + INTERVAL 22 HOUR + to_seconds(o_orderkey * 101 % 14400) sleep_onset FROM orders))"""


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diary days, clock times as seconds of day."""
    k = F.col("o_orderkey")
    day = table(spark, sf_dir, "orders").select(k.alias("day_id"), F.col("o_custkey").cast("string").alias("subject"), F.to_date("o_orderdate").alias("date"), ((75600 + k * 61 % 21600) % 86400).cast("int").alias("sleep_time"), (18000 + k * 29 % 14400).cast("int").alias("wake_time"), k)
    return day.withColumn("sleep_duration", ((F.col("sleep_time") + k * 17 % 3600) % 86400).cast("int")).withColumn("get_up_time", (F.col("wake_time") + k * 31 % 3600).cast("int")).drop("o_orderkey")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as wake intervals of diary days."""
    start = (F.col("l_partkey") * 53 % 14400).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("day_id"), start.alias("start"), (start + F.col("l_linenumber") * 200 - 100).cast("int").alias("end")).withColumn("end", F.pmod("end", F.lit(86400)))


DIARY = """diary AS (SELECT *, CAST((sleep_time + day_id * 17 % 3600) % 86400 AS INT) sleep_duration, CAST(wake_time + day_id * 31 % 3600 AS INT) get_up_time FROM
 (SELECT o_orderkey day_id, CAST(o_custkey AS VARCHAR) subject, CAST(o_orderdate AS DATE) date, CAST((75600 + o_orderkey * 61 % 21600) % 86400 AS INT) sleep_time, CAST(18000 + o_orderkey * 29 % 14400 AS INT) wake_time FROM orders)),
e1 AS (SELECT *, CAST(date AS TIMESTAMP) + to_seconds(sleep_time + CASE WHEN sleep_time < 43200 THEN 86400 ELSE 0 END) t1 FROM diary),
m2 AS (SELECT *, CAST(date AS TIMESTAMP) + to_seconds(sleep_duration + CASE WHEN sleep_duration < 43200 THEN 86400 ELSE 0 END) m FROM e1),
e2 AS (SELECT * EXCLUDE (m), CASE WHEN m < t1 THEN m + INTERVAL 1 DAY ELSE m END t2 FROM m2),
m3 AS (SELECT *, CAST(date AS TIMESTAMP) + to_seconds(wake_time + CASE WHEN wake_time < 43200 THEN 86400 ELSE 0 END) m FROM e2),
e3 AS (SELECT * EXCLUDE (m), CASE WHEN m < t2 THEN m + INTERVAL 1 DAY ELSE m END t3 FROM m3),
m4 AS (SELECT *, CAST(date AS TIMESTAMP) + to_seconds(get_up_time + CASE WHEN get_up_time < 43200 THEN 86400 ELSE 0 END) m FROM e3),
timeline AS (SELECT * EXCLUDE (m), CASE WHEN m < t3 THEN m + INTERVAL 1 DAY ELSE m END t4 FROM m4)"""
INTERVALS = """intervals AS (SELECT l_orderkey day_id, CAST(l_partkey * 53 % 14400 AS INT) AS "start", CAST((l_partkey * 53 % 14400 + l_linenumber * 200 - 100 + 86400) % 86400 AS INT) AS "end" FROM lineitem),
i1 AS (SELECT i.*, t.date, CAST(t.date AS TIMESTAMP) + to_seconds("start" + CASE WHEN "start" < 43200 THEN 86400 ELSE 0 END) m, t2 FROM intervals i JOIN timeline t USING (day_id)),
i2 AS (SELECT * EXCLUDE (m), CASE WHEN m < t2 THEN m + INTERVAL 1 DAY ELSE m END start_ts, CAST(date AS TIMESTAMP) + to_seconds("end" + CASE WHEN "end" < 43200 THEN 86400 ELSE 0 END) m FROM i1),
wakes AS (SELECT day_id, "start", "end", start_ts, CASE WHEN m < start_ts THEN m + INTERVAL 1 DAY ELSE m END end_ts,
 CAST(greatest((("end" // 60) - ("start" // 60) + 1440) % 1440, 1) * 60 AS INT) duration FROM i2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as scored epochs of twenty files; tie is a score with many ties."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("file"), (F.col("l_returnflag") == "R").cast("int").alias("SLEEP"), (cents % 9973 / 9973.0).alias("SLEEP_PREDICTION"), (F.col("l_discount") * 10).alias("tie"))


SCORES = "scores AS (SELECT CAST(l_suppkey % 20 AS VARCHAR) file, CAST(l_returnflag = 'R' AS INT) SLEEP, CAST(round(l_extendedprice * 100) AS BIGINT) % 9973 / 9973.0::DOUBLE SLEEP_PREDICTION, l_discount * 10 tie FROM lineitem)"


FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as clinical nights of suppliers: four features, gender and age."""
    s = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(s.cast("string").alias("subject"), F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), (1 + s % 2).cast("double").alias("gender"), (40 + s % 37).cast("double").alias("age"), *FEATURES)


def clinical_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical(spark, sf_dir).unpivot(["subject", "date", "row", "gender", "age"], list(FEATURES), "feature", "value")


CLINICAL = """clinical AS (SELECT CAST(l_suppkey AS VARCHAR) subject, CAST(l_shipdate AS DATE) date, l_orderkey * 10 + l_linenumber AS "row", CAST(1 + l_suppkey % 2 AS DOUBLE) gender, CAST(40 + l_suppkey % 37 AS DOUBLE) age, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
long AS (UNPIVOT clinical ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"""
