"""Quality rules: cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted. Lines above the limit
are boilerplate: they are cut out of the texts, and a document that keeps too few words without them is rejected. Exact
copies of a text are one document: if each counted, every line of a text copied often enough would be boilerplate, and all
copies would be rejected before near-duplicate removal could keep one.

The limit is one law for hosts of all sizes: a line is boilerplate in more than one in ``one_in`` of a host's n documents,
and in more than ``base + per_doubling * log2(1 + n)`` of them. The first is a share that doesn't change as a host grows, so
ordinary short lines stay in a host of millions; the second is the floor, which a host of ten documents reaches and which
grows as the greatest count of chance repeats does, so a rare line of a middling host isn't taken for boilerplate.

Documents are scanned once into a table of counts and line hashes.
A common line of a large host is one key for a third of all rows: its documents are made distinct by (host, line, text)
first, then counted by partial sums. The lines above limits are broadcast if their counted number is small, else joined by
a shuffle that Spark splits where it is skewed.

Defined results: null text has no words and fails the base; an empty or blank line is no line; null source is a host of
its own; repeated rows each give a row; a null doc_id stays null; very long texts are one row like others; further columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from actispark.llm.common import broadcast_if_small, documents, forget, fresh, give_back, materialise, text_key

#: Fixed values.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"000000000abcdefghijklmnopqrstuvwxyz")

_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, host string, text_hash long, text_crc long, row_id long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", lines array<struct<line:long,words:int>>"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of size words which is found twice or more, its first place included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    w = np.zeros(n, np.uint64)
    for i in range(size):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def line_hash(parts: list[bytes]) -> int:
    """The hash of a normalised line of these words."""
    return xxhash.xxh3_64_intdigest(b" ".join(parts)) - 2**63


def measures(text: str) -> tuple[tuple[int, ...], dict[int, int]]:
    """The numbers of a text, and the words of each of its normalised lines by the line's hash."""
    data = text.encode(errors="surrogatepass")
    words, full, lines = data.split(), 0, {}
    rows = [r for r in data.split(b"\n") if r.strip()]  # bytes know the six ASCII blanks only
    for r in rows:
        parts = r.translate(_DIGITS).split()
        h = line_hash(parts)
        lines[h] = lines.get(h, 0) + len(parts)
    full = len(text) - sum(map(text.count, SPACE))
    return (len(words), full, sum(map(text.count, SYMBOLS)), len(rows) - len(set(rows)), repeated_words(words)), lines


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
    names = ["doc_id", "host", "text_hash", "text_crc", "row_id", *_NUMBERS, "lines"]
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            numbers, offsets, line, n = [], [0], [], []
            for text in batch.column(5):
                x, lines = measures(text.as_py() or "")
                numbers.append(x)
                line += lines.keys()
                n += lines.values()
                offsets.append(len(line))
            cols = np.array(numbers, np.int64).reshape(-1, len(_NUMBERS)).T
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(line, pa.int64()), pa.array(n, pa.int32())], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *(pa.array(c) for c in cols), listed], names)
    give_back()


def frequent_lines(scanned: DataFrame, base: float, per_doubling: float, one_in: float) -> DataFrame:
    """(f_host, f_line) of lines in more documents of their host than its limit."""
    n = F.count_distinct("text_hash")
    of_host = materialise(scanned.groupBy(F.col("host").alias("of_host")).agg(F.greatest(base + per_doubling * F.log2(1 + n), n / one_in).alias("limit")), "host-limits")
    of_line = scanned.select("host", "text_hash", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(n.alias("texts")).where(F.col("texts") > base)
    of_line = of_line.join(broadcast_if_small(of_host, of_host.count()), F.col("host").eqNullSafe(F.col("of_host")))
    return of_line.where(F.col("texts") > F.col("limit")).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))


LIMITS = {"base": 1.0, "per_doubling": 1.0, "one_in": 1000.0, "keep_share": 0.3, "keep_words": 10}


def _scanned(docs: DataFrame, limits: dict) -> tuple[DataFrame, DataFrame]:
    """The numbers and line hashes of every row, and the lines above their host's limit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), *text_key(), F.monotonically_increasing_id().alias("row_id"), text.alias("text"))
    scanned = materialise(inner.mapInArrow(_scan, _SCHEMA), "quality")
    return scanned, materialise(frequent_lines(scanned, limits["base"], limits["per_doubling"], limits["one_in"]), "frequent-lines")


def _judged(scanned: DataFrame, frequent: DataFrame, limits: dict) -> DataFrame:
    """judge's rows, and as cut the hashes of the frequent lines in the text (null: none)."""
    lines = scanned.select("row_id", "host", F.inline("lines"))
    hit = lines.join(broadcast_if_small(frequent, frequent.count()), (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
    removed = hit.groupBy("row_id").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("cut"))
    rest = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        scanned.drop("lines").join(removed, "row_id", "left").drop("row_id")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (rest >= limits["keep_words"]) & (rest >= limits["keep_share"] * F.col("n_words")))
    )


def judge(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of docs(doc_id, text, source): its numbers, base_failed, n_removed_words, kept, and the keys host,
    text_hash and text_crc. Depleted, and so rejected, is what has fewer than keep_words words, or less than keep_share of
    its words, outside of frequent lines."""
    limits = LIMITS | limits
    return _judged(*_scanned(docs, limits), limits).drop("cut")


def without_lines(text: str, cut: set[int]) -> str:
    """text without the lines, line breaks included, whose hash is in cut; the others as they are and in their order."""
    rows = text.encode(errors="surrogatepass").split(b"\n")
    return b"\n".join(r for r in rows if not r.strip() or line_hash(r.translate(_DIGITS).split()) not in cut).decode(errors="surrogatepass")


@F.arrow_udf(StringType())
def _without_lines(text: pa.Array, cut: pa.Array) -> pa.Array:
    return pa.array([None if c is None else without_lines(t.as_py(), set(c)) for t, c in zip(text, cut.to_pylist(), strict=True)], pa.string())


def _verdicts(of_host: Broadcast, limits: dict):
    """A column function of (text, host): whether the document stays, and its text if lines are cut from it. of_host holds
    the frequent lines of each host."""

    @F.arrow_udf(StructType([StructField("kept", BooleanType()), StructField("text", StringType())]))
    def verdict(texts: pa.Array, hosts: pa.Array) -> pa.Array:
        kept, new = [], []
        for t, host in zip(texts, hosts.to_pylist(), strict=True):
            text = t.as_py() or ""
            (n_words, _, _, _, n_repeat), lines = measures(text)
            cut = lines.keys() & of_host.value.get(host, set())
            rest = n_words - sum(lines[h] for h in cut)
            stays = n_words >= 10 and 100 * n_repeat <= 20 * n_words and rest >= limits["keep_words"] and rest >= limits["keep_share"] * n_words
            kept.append(stays)
            new.append(without_lines(text, cut) if stays and cut else None)
        return pa.StructArray.from_arrays([pa.array(kept, pa.bool_()), pa.array(new, pa.string())], ["kept", "text"])

    return verdict.asNondeterministic()  # or it would run once for the filter and once for the text


def keep_good(docs: DataFrame, small: int = 200_000, **limits) -> DataFrame:
    """The rows of docs that judge keeps, without the frequent lines in text, and n_chars renewed where it exists. If the
    frequent lines are at most small (16 bytes each), they go to all tasks and each text is judged where it is read, so no
    text is shuffled; else rejected and cut texts are looked up by host and text, on which verdict and lines depend."""
    limits = LIMITS | limits
    scanned, frequent = _scanned(docs, limits)
    host, hash_, crc, kept, cut, new = fresh(docs, "host", "text_hash", "text_crc", "kept", "cut", "new")
    if frequent.count() <= small:
        of_host: dict[str | None, set[int]] = {}
        for r in frequent.toLocalIterator():
            of_host.setdefault(r["f_host"], set()).add(r["f_line"])
        forget(scanned, frequent)
        verdict = _verdicts(docs.sparkSession.sparkContext.broadcast(of_host), limits)
        joined = docs.withColumn(new, verdict(F.col("text"), F.col("source").cast("string"))).where(F.col(f"{new}.kept"))
        whole, text = F.col(f"{new}.text").isNull(), F.col(f"{new}.text")
    else:
        judged = _judged(scanned, frequent, limits).where(~F.col("kept") | F.col("cut").isNotNull())
        changed = judged.groupBy("host", "text_hash", "text_crc").agg(F.first("kept").alias("kept"), F.first(F.when(F.col("kept"), F.col("cut"))).alias("cut"))
        changed = materialise(changed.toDF(host, hash_, crc, kept, cut), "rejected-and-cut")
        forget(scanned, frequent)
        h, c = text_key()
        on = (h == F.col(hash_)) & (c == F.col(crc)) & F.col("source").cast("string").eqNullSafe(F.col(host))
        held = changed.agg(F.count("*") + F.coalesce(F.sum(F.size(F.coalesce(cut, F.array()))), F.lit(0))).first()[0]  # rows and what their lists hold
        joined = docs.join(broadcast_if_small(changed, held, 100_000), on, "left").where(F.coalesce(kept, F.lit(True)))
        whole = F.col(cut).isNull()
        # Texts that stay whole don't go to Python.
        joined, text = joined.withColumn(new, _without_lines(F.when(~whole, F.col("text")), F.col(cut))), F.col(new)
    out = {"text": F.when(whole, F.col("text")).otherwise(text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[out.get(x, F.col(f"`{x}`")).alias(x) for x in docs.columns])


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *_NUMBERS, "base_failed", "kept", "n_removed_words")


_NORMAL = "array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\\x20\\x09-\\x0D]+'), ' ')"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, regexp_extract_all(text, '[^ 	-
]+') AS w, text FROM d),
five AS (SELECT id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM five) WHERE n > 1),
repeated AS (SELECT id, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS r(k) GROUP BY id),
lines AS (SELECT id, l, {_NORMAL} AS line FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ 	-
]')),
dup AS (SELECT id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY id),
hosts AS (SELECT host, greatest(1 + log2(1 + count(DISTINCT text)), count(DISTINCT text) / 1000) AS most FROM d GROUP BY host),
per_line AS (SELECT host, line, count(DISTINCT text) AS n FROM lines JOIN d USING (id) GROUP BY host, line),
frequent AS (SELECT p.host, p.line FROM per_line p JOIN hosts h ON p.host IS NOT DISTINCT FROM h.host WHERE p.n > h.most),
cut AS (SELECT l.id, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN d USING (id) JOIN frequent f ON f.line = l.line AND f.host IS NOT DISTINCT FROM d.host GROUP BY l.id),
m AS (SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed_words
 FROM d JOIN w USING (id) LEFT JOIN dup USING (id) LEFT JOIN repeated USING (id) LEFT JOIN cut USING (id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.3 * n_words AS kept, n_removed_words FROM b"""
