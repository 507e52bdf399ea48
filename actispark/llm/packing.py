"""Best-fit packing of tokenised documents into sequences under several capacities.

Every piece is a vector (tokens, one document, attention cost = length squared); a sequence has a capacity for each. Pieces
are taken longest first, and each goes to the open sequence that can hold it in every dimension and scores best: the least
weighted norm of what is left, or the greatest weighted dot product of the piece and what is left. Pieces are dealt by a
hash into groups of bounded size, each packed by itself; the sequences that a group leaves open are emptied, and their
pieces packed again in groups of their own, so the loss is a few sequences in a group of groups.

With capacities (t tokens, t documents, t^2 attention) only the tokens bind: each of at most t tokens' pieces has one token
or more, and the sum of squares is at most the square of the sum. That is what op5's contract asks for, whose only limit is
4096 tokens; the other dimensions then only choose among sequences that fit. Smaller capacities bind (most_documents for
the loss mask, most_attention for the cost of long documents) and are kept in every sequence, at the price of more of them.

Texts are tokenised once; what is packed is a table of lengths.

Defined results: null text is empty; an empty text is one piece of the end token; a text longer than a sequence is cut into
whole ones and a rest; a piece whose attention cost is over its capacity has a sequence of its own; repeated rows are packed
each; a null doc_id stays null; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.llm.bpe import batches_of, encoder, tokenizer_path
from actispark.llm.common import documents, forget, give_back, materialise

END = 1


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.02, 0.02), score: str = "norm") -> np.ndarray:
    """The bin of each piece: longest first into the best-scoring open bin that holds it in every dimension."""
    cap = np.array(capacity, float)
    w = np.array(weights)
    bins = np.full(len(lengths), -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = lengths[order[-1]] if len(order) else 0
    left, names, n, made = np.empty((3, 1024)), np.empty(1024, np.int64), 0, 0
    for at in order.tolist():
        size = float(lengths[at])
        item = np.array((size, 1.0, size * size))
        if 2 * size <= capacity[0] or n and size <= left[0, :n].max():
            open_ = left[:, :n]
            fits = np.flatnonzero((open_ >= item[:, None]).all(0))
        else:
            fits = ()
        if len(fits):
            r = left[:, fits] / cap[:, None]
            v = (item / cap)[:, None]
            best = np.argmin(w @ (r - v) ** 2) if score == "norm" else np.argmax(w @ (r * v))
            b = int(fits[best])
        else:
            if n == left.shape[1]:
                left, names = np.hstack([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            b, n = n, n + 1
            left[:, b], names[b] = cap, made
            made += 1
        left[:, b] -= item
        bins[at] = names[b]
        if left[0, b] < least or left[1, b] < 1 or left[2, b] < least * least:  # full: nothing to come fits
            n -= 1
            left[:, b], names[b] = left[:, n], names[n]
    return bins


def pieces_of(docs: DataFrame, most: int, path: str | None = None) -> DataFrame:
    """doc_id, row_id, piece, start, length, ids_crc32 of docs(doc_id, text): ids and an end token, cut into pieces."""
    path = tokenizer_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(path), END.to_bytes(4, "little")
        for whole in batches:
            for batch, texts in batches_of(whole, 2):
                row, piece, start, length, crc = [], [], [], [], []
                for i, words in enumerate(e.encode(texts)):
                    words.append(end)
                    ids = b"".join(words)
                    for k, a in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[a : a + 4 * most]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), "text")
    return rows.mapInArrow(run, "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, count: int, capacity: tuple[int, int, int], group: int = 8192, full: float = 0.95, **how) -> DataFrame:
    """pieces(row_id, piece, length, ...) with sequence_id and offset. Sequences with less than full of any capacity used
    are packed in a second round, those of many groups together."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def deal(rows: DataFrame, n: int, seed: int) -> DataFrame:
        groups = max(1, -(-n // group))
        first = seed << 52

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], ignore_index=True)
            bins = best_fit(part["length"].to_numpy(), capacity, **how)
            part["sequence_id"] = first + key[0] * 2**24 + bins
            part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
            square = part["length"].astype(float) ** 2
            used = [part["length"].groupby(bins).transform("sum"), part["length"].groupby(bins).transform("size"), square.groupby(bins).transform("sum")]
            part["open"] = np.max([u / c for u, c in zip(used, capacity, strict=True)], axis=0) < full
            return part.drop(columns="pack_group")

        dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("row_id", "piece", F.lit(seed)), F.lit(groups)))
        return dealt.groupBy("pack_group").applyInPandas(run, columns + ", sequence_id long, offset long, open boolean")

    if count <= group:
        return deal(pieces, count, 0).drop("open")
    once = materialise(deal(pieces, count, 0), "packed-once")
    left = once.where("open").drop("sequence_id", "offset", "open")
    return once.where("not open").drop("open").unionByName(deal(left, once.where("open").count(), 1).drop("open"))


def pack_documents(docs: DataFrame, tokens: int = 4096, most_documents: int = 4096, most_attention: int = 4096**2, path: str | None = None, **how) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(pieces_of(docs, tokens, path), "pieces")
    count, group = pieces.count(), how.pop("group", 8192)
    packed = pack(pieces, count, (tokens, most_documents, most_attention), group, **how)
    if count > group:  # what pack gives reads its own table then
        forget(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
