"""Tables that jobs keep up to date: a training set by group, of which only changed groups are rebuilt, and tables whose
versions are swapped. A version counts once it has its _SUCCESS file, so a job that fails may simply run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_groups"  # Spark passes over folders that begin with an underscore when it reads a table


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions in path, rising."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where) if files.exists(_files(spark, f"{path}/{s.getPath().getName()}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def put_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """df as the next version of path; the last keep stay, since readers may still be at the one before."""
    spark = df.sparkSession
    found = versions(spark, path)
    new = (found[-1] if found else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={new}")
    for old in [v for v in found if v <= new - keep]:
        files, where = _files(spark, f"{path}/version={old}")
        files.delete(where, True)
    return new


def group_marks(df: DataFrame, group: str) -> DataFrame:
    """group, rows, mark: what a group's rows come to, in any order; one aggregation."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    both = F.struct(F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(2**31))).alias("s"))  # equal rows cancel out in x alone
    return df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("rows"), both.alias("mark"))


def update_dataset(df: DataFrame, path: str, group: str = "group", label: str = "SLEEP") -> DataFrame:
    """Brings the training set in path, a folder a group, to df; groups without any label are left out. Returns group, action
    (new, changed, same, gone), rows. Only new and changed groups are written, and gone ones deleted; the manifest with each
    group's mark follows last, so after a failure the same groups are done again. Null groups are one group."""
    spark = df.sparkSession
    labelled = df.where(F.col(label).isNotNull()).select(F.col(group).alias("_g")).distinct()
    rows = df.join(labelled, F.col(group).eqNullSafe(F.col("_g")), "left_semi").persist(StorageLevel.MEMORY_AND_DISK)  # marked, then written
    was = current(spark, f"{path}/{MANIFEST}")
    now = group_marks(rows, group)
    if was is None:
        was = now.limit(0)
    else:
        was = was.where("action <> 'gone'").select("group", "rows", "mark")
    old = was.select(F.col("group").alias("_was"), F.col("mark").alias("_mark"), F.lit(True).alias("_old"))
    both = now.withColumn("_new", F.lit(True)).join(old, F.col("group").eqNullSafe(F.col("_was")), "full")
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("mark") == F.col("_mark"), "same").otherwise("changed")
    name = F.when(F.col("_new").isNull(), F.col("_was")).otherwise(F.col("group"))
    plan = both.select(name.alias("group"), action.alias("action"), F.coalesce("rows", F.lit(0)).alias("rows"), "mark")
    staged = f"{path}/{MANIFEST}_next"
    plan.write.mode("overwrite").parquet(staged)  # fixed before the groups change
    plan = spark.read.schema(plan.schema).parquet(staged)
    todo = plan.where(F.col("action").isin("new", "changed")).select(F.col("group").alias("_g"))
    fresh = rows.join(todo, F.col(group).cast("string").eqNullSafe(F.col("_g")), "left_semi")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
    for r in plan.where("action = 'gone'").select("group").toLocalIterator():
        files, where = _files(spark, f"{path}/{_folder(spark, group, r['group'])}")
        files.delete(where, True)
    put_version(plan, f"{path}/{MANIFEST}")
    rows.unpersist()
    return current(spark, f"{path}/{MANIFEST}").select("group", "action", "rows")


def _folder(spark: SparkSession, column: str, value: str | None) -> str:
    """The folder of a partition, as Spark names it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)


def dataset_at(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None = None, group: str = "group", label: str = "SLEEP") -> DataFrame:
    """The training set in path; if there is none yet, build() makes it."""
    if not versions(spark, f"{path}/{MANIFEST}"):
        if build is None:
            raise FileNotFoundError(path)
        update_dataset(build(), path, group, label)
    return spark.read.parquet(path)
