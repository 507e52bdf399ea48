"""Queries over tables that jobs keep up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from actispark.operators import clinical as C
from actispark.plans.base import query, rounded, subjects, table
from actispark.plans.clinic import SHEET, _epochs, _sheet
from actispark.sources import readers as R
from actispark.sources import store
from actispark.sources.scratch import shared_dir


def _place(spark, name):
    return f"{shared_dir(spark)}/actispark/{name}-{uuid.uuid4().hex}"


_GROUPED = "e AS (SELECT l_suppkey % 83 g, count(*) n FROM lineitem GROUP BY 1)"


@query("s10_update_dataset", f"""WITH {_GROUPED} SELECT CAST(g AS VARCHAR) AS "group", CASE WHEN g % 7 = 0 THEN 'gone' WHEN g % 7 = 1 THEN 'new' WHEN g % 5 = 0 THEN 'changed' ELSE 'same' END AS action, CASE WHEN g % 7 = 0 THEN 0 ELSE n END AS rows FROM e""")
def update_dataset(spark, sf_dir):
    """A training set of lineitems by supplier, then the update to later data, in which some groups are new, some changed in a
    value, some gone."""
    path, at, g = _place(spark, "dataset"), _epochs(spark, sf_dir), F.col("group").cast("int")
    store.update_dataset(at.where(g % 7 != 1), path)
    later = at.where(g % 7 != 0).withColumn("l_tax", F.when(g % 5 == 0, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return store.update_dataset(later, path)


@query("s10_dataset_rows", f"""SELECT CAST(l_suppkey % 83 AS INT) AS "group", l_orderkey, l_linenumber, round(l_tax + CASE WHEN l_suppkey % 83 % 5 = 0 THEN 1 ELSE 0 END, 6) l_tax FROM lineitem WHERE l_suppkey % 83 % 7 <> 0""")
def dataset_rows(spark, sf_dir):
    """What the training set of s10_update_dataset then holds, read where it was left."""
    path, at, g = _place(spark, "dataset"), _epochs(spark, sf_dir), F.col("group").cast("int")
    later = at.where(g % 7 != 0).withColumn("l_tax", F.when(g % 5 == 0, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    store.update_dataset(at.where(g % 7 != 1), path)
    store.update_dataset(later, path)
    return store.dataset_at(spark, path).select("group", "l_orderkey", "l_linenumber", F.round("l_tax", 6).alias("l_tax"))


@query("j11_import_diagnoses", f"WITH {SHEET} SELECT s.* EXCLUDE (diagnosis_code), CAST(CASE WHEN u.action = 'update' THEN u.new_code ELSE s.diagnosis_code END AS INT) diagnosis_code, 2 AS version FROM subjects s LEFT JOIN upd u ON u.subject = s.code")
def import_diagnoses(spark, sf_dir):
    """Subjects as a stored table, the sheet imported twice: the second time nothing changes, so the version is the second."""
    path, sheet = _place(spark, "subjects"), _sheet(spark, sf_dir)
    store.put_version(subjects(spark, sf_dir), path)
    for _ in range(2):
        C.import_diagnoses(path, sheet)
    return store.current(spark, path).withColumn("version", F.lit(store.versions(spark, path)[-1]))


@query("s9_s11_tables", """SELECT f.fmt, o_orderkey, o_orderpriority, round(o_totalprice, 6) o_totalprice FROM orders, (VALUES ('csv'), ('parquet')) f(fmt)""")
def tables(spark, sf_dir):
    """Orders written as sorted CSV and Parquet, and read again."""
    orders, out = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), []
    for fmt in ("csv", "parquet"):
        path = f"{_place(spark, 'table')}.{fmt}"
        R.write_table(orders, path, fmt, order=["o_orderpriority", "o_orderkey"])
        out.append(R.read_table(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double").withColumn("fmt", F.lit(fmt)))
    return rounded(out[0].unionByName(out[1]))
