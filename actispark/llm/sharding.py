"""Shards by a k-d tree over document metadata.

The dimensions are the logarithm of a document's length, the length of its lines, its language and its source; the last two
are ordinal codes, numbers in the order of the names. A node with n leaves is split along the dimension in which it is widest
(against the whole table) at the weighted median, or the n//2 : n share of its bytes, until each leaf is a shard of
near-equal bytes. Medians are distributed: a level's nodes share one histogram job a round, and each round narrows every
node's interval to the bin that holds its target; the driver sees bins only. Equal values are told apart by a text hash, so
equal texts stay together; only a group of equal texts that would push a cut too far off is cut between rows. How far is a
budget for the whole path from the root to a leaf: a shard ends within ``slack`` of the mean, besides the size of a row.

A level's cuts are a few numbers, so giving rows their child node needs no join. Slots come from a window over (shard, bucket)
with the number of buckets following the rows, plus the bucket's offset.

Defined results: null text counts no bytes (size 8, crc of nothing); nulls in metadata are 0, below all values; equal rows
are told apart by a row number; a text larger than a shard's share fills one alone; a null doc_id keeps its row; further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actispark.llm.common import documents, forget, materialise

BINS = 512


class Cut:
    """The search for one node's cut: keys are looked at in turn (dimension, text hash, row hash)."""

    def __init__(self, node: int, span: tuple[float, float], target: float, close: float, slack: float):
        self.node, self.target, self.close, self.slack = node, target, close, slack
        self.equal: list[float] = []  # values of the keys already fixed
        self.lo, self.hi = span
        self.before, self.at, self.inclusive = 0.0, None, False

    def narrow(self, bins: list[tuple[float, float, float]]) -> None:
        """bins: (least value, greatest value, weight) of those that have rows, in order."""
        sums = list(itertools.accumulate((w for _, _, w in bins), initial=self.before))
        i = min(max(bisect.bisect_left(sums, self.target) - 1, 0), len(bins) - 1)
        lo, hi, _ = bins[i]
        level = len(self.equal)
        near = self.slack if level == 1 and lo == hi else self.close
        left, right = abs(sums[i] - self.target), abs(sums[i + 1] - self.target)
        if min(left, right) <= near or level == 2 and lo == hi:
            self.at, self.inclusive = (lo, False) if left <= right else (hi, True)
        elif lo == hi:  # a tie: the next key decides among these rows
            self.equal.append(lo)
            self.before, self.lo, self.hi = sums[i], 0.0, 2.0**52
        else:
            self.before, self.lo, self.hi = sums[i], lo, hi

    def values(self) -> list[float]:
        """What each key is compared with; keys not reached compare with anything."""
        return [*self.equal, *([self.at] if self.at is not None else []), 0.0, 0.0, 0.0][:3]


def _of_node(values: dict[int, object]) -> Column:
    """A number per node (at most as many as shards) as a column; null for other nodes."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("node"))


def _bins(at: DataFrame, cuts: list[Cut]) -> list:
    """node, bin, least and greatest value, bytes over the rows that each cut still looks at; at most BINS a node."""
    depth = _of_node({c.node: len(c.equal) for c in cuts})
    value = F.when(depth == 0, F.col("k0")).when(depth == 1, F.col("text_key")).otherwise(F.col("row_key"))
    v0, v1 = (_of_node({c.node: c.values()[i] for c in cuts}) for i in (0, 1))
    lo, hi = _of_node({c.node: float(c.lo) for c in cuts}), _of_node({c.node: float(c.hi) for c in cuts})
    rows = at.select("node", "size", "k0", "text_key", depth.alias("depth"), value.alias("value"), v0.alias("v0"), v1.alias("v1"), lo.alias("lo"), hi.alias("hi"))
    rows = rows.where(F.col("depth").isNotNull() & F.col("value").between(F.col("lo"), F.col("hi")) & ((F.col("depth") < 1) | (F.col("k0") == F.col("v0"))) & ((F.col("depth") < 2) | (F.col("text_key") == F.col("v1"))))
    width = (F.col("hi") - F.col("lo")) / BINS
    bin_ = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(BINS - 1))).otherwise(0).cast("int")
    return rows.groupBy("node", bin_.alias("bin")).agg(F.min("value"), F.max("value"), F.sum("size")).collect()


def _children(cuts: list[Cut]) -> Column:
    """The node a row belongs to after the cuts."""
    depth, inclusive = _of_node({c.node: len(c.equal) for c in cuts}), _of_node({c.node: c.inclusive for c in cuts})
    v = [_of_node({c.node: float(c.values()[i]) for c in cuts}) for i in range(3)]
    left = F.lit(False)
    for level, key in reversed(list(enumerate(("k0", "text_key", "row_key")))):
        k = F.col(key)
        left = F.when(depth == level, (k < v[level]) | inclusive & (k == v[level])).otherwise((k < v[level]) | (k == v[level]) & left)
    return F.when(depth.isNull(), F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2).cast("int")


def kd_shards(rows: DataFrame, dims: list[str], shards: int, slack: float = 0.02, close: float = 0.001) -> DataFrame:
    """rows(size, text_key, row_key, *dims) with shard; text_key and row_key are whole numbers in [0, 2^52).
    A shard's bytes are within close of the mean where rows are small enough; to keep equal texts together it may be slack.
    A cut above two shards may use half of both, and each level above half of what is left, for each shard of its smaller
    side. A level's nodes are written down, so a level reads the last one's table and no tree grows in the plan."""
    ends = lambda: [f(d) for d in dims for f in (F.min, F.max)]
    whole = rows.agg(F.sum("size"), *ends()).first()
    share, last = (whole[0] or 0) / shards, None
    widths = [(b - a) or 1.0 for a, b in itertools.batched(whole[1:], 2)] if whole[0] else []
    rows = rows.withColumn("node", F.lit(0))
    inner: set[int] = set()
    leaves = {0: shards}  # node -> number of shards below it
    while wide := [k for k, n in leaves.items() if n > 1]:
        seen = {r[0]: r[1:] for r in rows.where(F.col("node").isin(wide)).groupBy("node").agg(F.sum("size"), *ends()).collect()}
        cuts, chosen = [], {}
        for k in wide:
            if k not in seen:  # no rows: its shards stay empty
                leaves[k] = 1
                continue
            spans = list(itertools.batched(seen[k][1:], 2))
            chosen[k] = d = max(range(len(dims)), key=lambda i: (spans[i][1] - spans[i][0]) / widths[i])
            bear = share * (leaves[k] // 2) / 2 ** (leaves[k] - 1).bit_length()
            cuts.append(Cut(k, spans[d], seen[k][0] * (leaves[k] // 2) / leaves[k], bear * close, bear * slack))
        if not cuts:
            break
        at = rows.withColumn("k0", F.element_at(F.array(*dims), _of_node({k: d + 1 for k, d in chosen.items()})))
        while searching := [c for c in cuts if c.at is None]:
            found = _bins(at, searching)
            for c in searching:
                c.narrow([tuple(r)[2:] for r in sorted(r for r in found if r[0] == c.node)])
        rows = materialise(at.withColumn("node", _children(cuts)).drop("k0"), "kd-level")
        if last:
            forget(last)
        last = rows
        for c in cuts:
            inner.add(c.node)
            n = leaves.pop(c.node)
            leaves |= {2 * c.node + 1: n // 2, 2 * c.node + 2: n - n // 2}

    def in_order(node: int = 0) -> list[int]:
        return [node] if node not in inner else in_order(2 * node + 1) + in_order(2 * node + 2)

    return rows.withColumn("shard", _of_node({k: i for i, k in enumerate(in_order())})).drop("node")


def slots(rows: DataFrame, shards: int, count: int, order: list[str], rows_a_bucket: int = 20_000) -> DataFrame:
    """rows with slot: 0, 1, ... within each shard, without bringing a shard's rows together."""
    buckets = max(16, -(-count // (shards * rows_a_bucket)))
    rows = rows.withColumn("bucket", F.pmod(F.col("row_key").cast("long"), F.lit(buckets)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order)))
    return numbered.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.col("i") - 1).drop("bucket", "offset", "i")


def ordinals(rows: DataFrame, columns: list[str]) -> list[Column]:
    """A number for each string column, in the order of its values: the six bytes behind what all values begin with."""
    ends = rows.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    out = []
    for c, (a, b) in zip(columns, itertools.batched(ends, 2), strict=True):
        common = len(os.path.commonprefix([(a or "").encode(), (b or "").encode()]))
        six = F.hex(F.substring(F.col(c).cast("binary"), common + 1, 6))
        out.append(F.coalesce(F.conv(F.rpad(six, 12, "0"), 16, 10).cast("double"), F.lit(0.0)).alias(c))
    return out


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source, n_chars): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fold = lambda h: F.pmod(h, F.lit(2**52)).cast("double")
    length = F.char_length(text).cast("double")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        fold(F.xxhash64(text)).alias("text_key"), F.monotonically_increasing_id().alias("row_id"), F.log2(1 + F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("chars"),
        (length / (1 + length - F.char_length(F.translate(text, "\n", "")))).alias("line"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    rows = materialise(rows.withColumn("row_key", fold(F.xxhash64("doc_id", "row_id"))), "shard-rows")
    coded = rows.select(*[c for c in rows.columns if c not in ("lang", "source")], *ordinals(rows, ["lang", "source"]))
    return slots(kd_shards(coded, ["chars", "line", "lang", "source"], shards), shards, rows.count(), ["text_key", "doc_id", "row_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
