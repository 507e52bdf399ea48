"""What the training-data operators share: table access, scratch tables, joins that take hot keys, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fixed-width columns that may be broadcast (some tens of MB); beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000

#: Rows that go to Python at once. Texts are long and a few are very long, so the default of 10,000 takes much memory.
ARROW_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Jobs run after their functions have returned, so this stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (as in tests)
    gets a folder of its own; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage is cut, the rows are fixed,
    and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/actispark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path  # what forget() deletes
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes tables that materialise gave, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver's garbage collected, so that Spark's cleaner deletes the shuffle files of jobs that are over. Between
    steps that each write a table, disk then holds one step's shuffles instead of all. Twice, as a plan is let go in the
    first round and its shuffles in the second."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where its counted rows are within limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, salt: list[str], how: str = "inner", rows: int = 2_000) -> DataFrame:
    """left joined with right, which has a row a key. counts(*keys, n) tells how many rows of left a key has: a key with more
    than rows of them is dealt over several by a hash of left's columns in salt, and its row of right is repeated for each,
    so no task gets all of a key and no table is broadcast but the numbers of the keys that are dealt (their count is checked)."""
    hot = counts.where(F.col("n") > rows).select(*keys, F.ceil(F.col("n") / rows).cast("int").alias("deals"))
    n = hot.count()
    if not n:
        return left.join(right, keys, how)
    hot = broadcast_if_small(hot, n)
    deals = F.coalesce("deals", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("deal", F.pmod(F.xxhash64(*salt), deals).cast("int")).drop("deals")
    each = right.join(hot, keys, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return dealt.join(each, [*keys, "deal"], how).drop("deal")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key() -> list[Column]:
    """96 bits that stand for a text (null: the empty one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("text_hash"), F.crc32(text.cast("binary")).alias("text_crc")]


def give_back() -> None:
    """Returns a worker's freed memory to the system, as the executor's next stage may need it."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
