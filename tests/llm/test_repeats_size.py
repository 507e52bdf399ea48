"""What op13 holds and leaves behind as its input grows."""

import numpy as np
from pyspark.sql import functions as F

from actispark.llm import common
from actispark.llm import repeats as r


def test_the_filter_grows_with_its_keys(spark, monkeypatch, tmp_path):
    """With 16 times the keys as many others are let through; every key passes, whatever the size."""
    assert [r.filter_power(n) for n in (0, 7_300_000, 86_000_000, 10**9)] == [26, 26, 29, 30]
    monkeypatch.setattr(r, "FILTER_BITS", (22, 30))
    other = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 100_000)
    let = []
    for i, n in enumerate((600_000, 9_600_000)):
        spark.range(n).select(F.xxhash64("id").alias("key")).write.parquet(f"file://{tmp_path}/keys{i}")
        keys = spark.read.parquet(f"file://{tmp_path}/keys{i}")
        bits = r.bit_filter(keys, F.col("key")).value
        assert r.passes(bits, keys.limit(50_000).toPandas()["key"].to_numpy()).all()
        let.append(r.passes(bits, other).mean())
    assert max(let) < 1 / 12


def test_marks_are_written_before_texts_are_shuffled(spark):
    """The plan that reads the texts at last has no scan for pieces and no join of them left in it."""
    docs = spark.createDataFrame([(i, "a passage that stands in both of the documents, and is long enough" + str(i) * 9) for i in range(2)], "doc_id long, text string")
    marks = r.earlier_marks(docs)
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" not in plan and marks.count() == 1
    assert [x["n_removed"] > 0 for x in r.repeat_digests(docs).orderBy("doc_id").collect()] == [False, True]
    assert common.shared_dir(spark)
