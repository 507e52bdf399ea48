"""Readers and writers: raw accelerometer text and binary files, polysomnography, 64 Hz recordings, tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.functions.scalars import psg_timestamps, stage_to_sleep

STAMP = "yyyy-MM-dd HH:mm:ss:SSS"


def recording_of(path: str = "_metadata.file_path") -> Column:
    """The file's name without its ending."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")


def scrub_nul(df: DataFrame, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.translate(col, "\x00", ""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, line_no (increasing within a file), value of text files, without NUL bytes. Files are split."""
    # A split's lines are far fewer than 1024 times its bytes, so numbers grow from split to split without a shuffle.
    line_no = F.col("_metadata.file_block_start") * 1024 + F.monotonically_increasing_id() % (1 << 33)
    return scrub_nul(spark.read.text(path).select(recording_of().alias("recording_id"), line_no.alias("line_no"), "value"))


def parse_geneactiv(lines: DataFrame) -> DataFrame:
    """Samples of lines(recording_id, line_no, value): rows whose first field starts with 20 and is a time stamp, with
    seven fields (button before temperature) or six (no button)."""
    f = F.split("value", ",")
    n = F.size(f)
    number = lambda i: F.trim(F.get(f, F.lit(i))).try_cast("float").cast("double")
    ts = F.try_to_timestamp(F.trim(F.get(f, F.lit(0))), F.lit(STAMP)).cast("timestamp_ntz")
    button = F.when(n == 7, F.trim(F.get(f, F.lit(5))))
    return (
        lines.where(F.col("value").startswith("20") & n.isin(6, 7))
        .select(
            "recording_id", "line_no", ts.alias("ts"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"), number(4).alias("lux"),
            F.when(n == 7, number(6)).otherwise(number(5)).alias("temp"), F.when(button.isNotNull(), button.isin("1", "1.0", "True", "true")).alias("button"),
        )
        .where(F.col("ts").isNotNull())
    )


def read_geneactiv_csv(spark: SparkSession, path: str, start_buffer: timedelta | None = None, start_time: datetime | None = None, stop_time: datetime | None = None) -> DataFrame:
    """Samples of the files at path between start_time and stop_time (both included), less start_buffer of each start."""
    samples = parse_geneactiv(read_lines(spark, path))
    if start_time is not None:
        samples = samples.where(F.col("ts") >= F.lit(start_time).cast("timestamp_ntz"))
    if stop_time is not None:
        samples = samples.where(F.col("ts") <= F.lit(stop_time).cast("timestamp_ntz"))
    if start_buffer:
        starts = recording_start(samples).select("recording_id", (F.col("start") + F.lit(start_buffer)).alias("_from"))
        samples = samples.join(starts, "recording_id").where(F.col("ts") >= F.col("_from")).drop("_from")
    return samples


def stop_at_end_dates(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """samples up to their recording's end_date, where it has one."""
    ends = recordings.select("recording_id", "end_date")
    return samples.join(ends, "recording_id", "left").where(F.col("end_date").isNull() | (F.col("ts") <= F.col("end_date"))).drop("end_date")


def recording_rates(lines: DataFrame) -> DataFrame:
    """recording_id, rate_hz, factor (keep each factor-th row for 25 Hz) from the preamble; null factor: not usable."""
    rate = F.regexp_extract("value", r"Measurement Frequency[,:]\s*([0-9.]+)", 1).try_cast("double")
    factor = F.when(F.col("rate_hz") == 25, 1).when(F.col("rate_hz") == 50, 2).when(F.col("rate_hz") == 85.7, 3).when(F.col("rate_hz") == 100, 4)
    return lines.where(F.col("value").startswith("Measurement Frequency")).groupBy("recording_id").agg(F.max(rate).alias("rate_hz")).withColumn("factor", factor)


def recording_start(samples: DataFrame) -> DataFrame:
    return samples.groupBy("recording_id").agg(F.min("ts").alias("start"))


def training_start(samples: DataFrame, psg: DataFrame) -> DataFrame:
    """recording_id, start: 15 s before the first PSG row, but not before the first sample."""
    first = psg.groupBy("recording_id").agg(F.min("ts").alias("psg_start"))
    return recording_start(samples).join(first, "recording_id").select("recording_id", F.greatest(F.col("psg_start") - F.expr("INTERVAL 15 SECONDS"), F.col("start")).alias("start"))


def parse_psg(files: DataFrame) -> DataFrame:
    """recording_id, row_no, ts, stage, sleep of files(recording_id, value), each value a whole tab-separated text."""
    rows = files.select("recording_id", F.posexplode(F.split("value", r"\r?\n")).alias("row_no", "line"), F.to_date(F.regexp_extract("value", r"Recording Date:\s*(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy").alias("recording_date"),
                        F.size(F.split(F.regexp_extract("value", r"(?s)^(.*?)Sleep Stage[^\n]*", 1), "\n")).alias("header"))
    f = F.split("line", "\t")
    table = rows.where((F.col("row_no") >= F.col("header")) & (F.size(f) >= 3)).select("recording_id", "row_no", "recording_date", F.trim(f[0]).alias("stage"), F.trim(f[2]).alias("clock"))
    stamped = psg_timestamps(table.where(F.col("clock").rlike(r"^\d{2}:\d{2}:\d{2}")))
    return stamped.select("recording_id", "row_no", "ts", "stage", stage_to_sleep("stage").alias("sleep"))


def read_psg_txt(spark: SparkSession, path: str) -> DataFrame:
    """PSG files are a few thousand rows each and their order counts, so each is read whole."""
    return parse_psg(scrub_nul(spark.read.text(path, wholetext=True).select(recording_of().alias("recording_id"), "value")))


#: What a binary recording calls the constants of its preamble.
CONSTANTS = ("x gain", "x offset", "y gain", "y offset", "z gain", "z offset", "Volts", "Lux", "Measurement Frequency")
PAGE = "Page Time:"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, line_no, value: a row for each page of binary recordings (text from its time on), and one for what comes
    before the first. Files are split between pages."""
    line_no = F.col("_metadata.file_block_start") * 1024 + F.monotonically_increasing_id() % (1 << 33)
    return scrub_nul(spark.read.text(path, lineSep=PAGE).select(recording_of().alias("recording_id"), line_no.alias("line_no"), "value"))


def page_constants(pages: DataFrame) -> DataFrame:
    """A row per recording with the constants of its preamble, the only part with gains."""
    found = {c: F.regexp_extract("value", rf"(?m)^\s*{c}:\s*([-+0-9.eE]+)", 1).try_cast("double") for c in CONSTANTS}
    return pages.where(F.col("value").contains("x gain:")).groupBy("recording_id").agg(*[F.max(v).alias(c) for c, v in found.items()])


def decode_pages(pages: DataFrame) -> DataFrame:
    """Samples of pages(recording_id, line_no, value): hexadecimal samples of 12 characters - three axes of 12 bits with sign,
    ten bits of light, the button - after the page's time and temperature."""
    time = F.try_to_timestamp(F.regexp_extract("value", r"^\s*([0-9: -]+[0-9])", 1), F.lit("yyyy-MM-dd HH:mm:ss:SSS")).cast("timestamp_ntz")
    data = F.regexp_extract("value", r"(?m)^\s*((?:[0-9A-Fa-f]{12})+)\s*$", 1)
    rows = pages.select("recording_id", "line_no", time.alias("stamp"), F.regexp_extract("value", r"(?m)^\s*Temperature:\s*([-0-9.]+)", 1).try_cast("double").alias("temp"), data.alias("data"))
    rows = rows.where(F.col("stamp").isNotNull() & (F.col("data") != "")).join(page_constants(pages), "recording_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                b = batch.iloc[at : at + 200]
                digits = np.frombuffer("".join(b["data"]).encode(), np.uint8).astype(np.int64)
                nibble = np.where(digits >= 97, digits - 87, np.where(digits >= 65, digits - 55, digits - 48)).reshape(-1, 4, 3)
                word = (nibble[:, :, 0] << 8) + (nibble[:, :, 1] << 4) + nibble[:, :, 2]
                n = b["data"].str.len().to_numpy() // 12
                of, i = np.repeat(np.arange(len(b)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                one = lambda c: b[c].to_numpy(float)[of]  # noqa: B023, E731
                signed = word - 4096 * (word > 2047)
                ts = b["stamp"].to_numpy("datetime64[us]")[of] + (i * 1e6 / one("Measurement Frequency")).astype("timedelta64[us]")
                axes = {c: np.round((signed[:, k] * 100.0 - one(f"{c} offset")) / one(f"{c} gain"), 4) for k, c in enumerate("xyz")}
                yield pd.DataFrame({"recording_id": b["recording_id"].to_numpy()[of], "line_no": b["line_no"].to_numpy()[of] * 512 + i, "ts": ts, **axes, "lux": (word[:, 3] >> 2) * one("Lux") / one("Volts"), "temp": one("temp"), "button": (word[:, 3] >> 1 & 1).astype(bool)})

    return rows.mapInPandas(run, "recording_id string, line_no long, ts timestamp_ntz, x double, y double, z double, lux double, temp double, button boolean")


def read_geneactiv_bin(spark: SparkSession, path: str, start_buffer: timedelta | None = None, stop_buffer: timedelta | None = None) -> DataFrame:
    """Samples of binary recordings; line_no grows with time in a recording; buffers are cut from a recording's ends."""
    samples = decode_pages(read_pages(spark, path))
    if not start_buffer and not stop_buffer:
        return samples
    ends = samples.groupBy("recording_id").agg((F.min("ts") + F.lit(start_buffer or timedelta())).alias("_a"), (F.max("ts") - F.lit(stop_buffer or timedelta())).alias("_b"))
    return samples.join(ends, "recording_id").where(F.col("ts").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def convert_dreamt(df: DataFrame, epoch0: datetime = datetime(2025, 3, 13, 19)) -> DataFrame:
    """Raw 64 Hz rows as processed ones: stamps from epoch0 on, axes in g, stages as 0 (W, P), 1 (N1, N2, N3, R) or null."""
    stage = F.col("Sleep_Stage")
    keep = [c for c in ("recording_id",) if c in df.columns]
    ts = F.timestamp_micros((F.unix_micros(F.lit(epoch0).cast("timestamp")) + F.round(F.col("TIMESTAMP") * 1e6)).cast("long")).cast("timestamp_ntz")
    return df.select(
        *keep, ts.alias("processed_time"), *[(F.col(f"ACC_{a}") / 64).alias(f"ACC_{a}_g") for a in "XYZ"], "TEMP",
        F.when(stage.isin("W", "P"), 0.0).when(stage.isin("N1", "N2", "N3", "R"), 1.0).alias("sleep_binary"),
    )


def parse_dreamt(df: DataFrame) -> DataFrame:
    """Processed rows (strings, columns in any case) as samples with a label; rows that don't parse are dropped."""
    names = {c.lower(): c for c in df.columns}
    col = lambda n: F.trim(F.col(f"`{names[n]}`"))
    ts = F.coalesce(*[F.try_to_timestamp(col("processed_time"), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")]).cast("timestamp_ntz")
    keep = [names.get("recording_id")] if "recording_id" in names else []
    label = col("sleep_binary").try_cast("double")
    return df.select(*keep, ts.alias("ts"), *[col(f"acc_{a}_g").try_cast("double").alias(a) for a in "xyz"], col("temp").try_cast("double").alias("temp"), F.when(label >= 1, 1).when(label.isNotNull(), 0).alias("sleep")).dropna()


def read_dreamt(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True).select(recording_of().alias("recording_id"), "*")
    return parse_dreamt(raw)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet folder or a CSV file with a header, by the path's ending."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", order: list[str] | None = None) -> None:
    """df as a table of files, sorted by order from file to file if it is given."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("header", True).format(fmt).save(path)


def write_dataset(df: DataFrame, path: str, group: str = "group", label: str = "SLEEP") -> None:
    """The training table by group; groups without any label are left out."""
    labelled = df.where(F.col(label).isNotNull()).select(group).distinct()
    df.join(labelled, group, "left_semi").write.mode("overwrite").partitionBy(group).parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
