"""The corpus pipeline: quality rules, toxicity, near-duplicates, secrets, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents; the last returns the packed pieces. ORACLE_SQL is None: SQL can express neither the trained chain nor the
tokenizer; tests/llm/test_pipeline.py holds every stage against a brute-force version.

Defined results: documents with null, empty or blank texts, or fewer than ten words, fail the quality rules and go, so later
stages meet texts only; null hosts are one host; a null doc_id passes all stages and is nobody's near-duplicate; rows that
repeat a doc_id pass together; very long texts are one document like others until packing cuts them; further columns pass
through unchanged, whatever their names; without labels no document is toxic; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actispark.llm import neardup, packing, quality, secrets, toxicity
from actispark.llm.common import documents, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and frequent lines go from the others' texts."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the chain is fitted on those of docs that have labels."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, at 0.8 of their word shingles or more, the document with the smallest doc_id stays."""
    return neardup.keep_first(docs, threshold=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; no document goes."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_documents), ("near_dedup", near_duplicates), ("secret_scan", secret_scan), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
