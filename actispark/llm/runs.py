"""Periodic runs of words: stretches that repeat with a period, found by seeds on diagonals.

A run of period q and length l >= max(12, 2q) matches itself at lag q over l - q >= max(12 - q, q) words, so a k-gram with
2k - 1 <= that overlap (for lags below 8: a 4-gram at every third word, for 2k <= lag < 4k a k-gram at every k-th) is found in
it twice, q words apart. Grams of 1, 2, 4, ... words get numbers by doubling, the same for equal grams of one document and
one of their own for grams that occur once in it. Seeds take the occurrences of their gram that lie at the lags of their
level only, at most 2k each, so there are at most some 2n pairs a level, never all pairs of a gram's occurrences. Pairs are
taken by lag and place; each is extended by halving steps over the gram numbers, exactly, and a table of how far each lag is
covered drops the pairs that would be extended to the same stretch. A stretch that several lags give has the smallest as its
period.

Documents are independent, so nothing is shuffled; slices of some MB of text are worked on at once in numpy. Memory is a few
numbers a word, and as many more as doubling goes on, the logarithm of the longest repeat within a document.

Defined results: a null text has no words; with a null doc_id nothing is planted; repeated rows are each their own document;
further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.llm.bpe import batches_of
from actispark.llm.common import documents, give_back, small_batches

SHORT, GRAM, STEP = 8, 4, 3  # lags below SHORT have seeds of GRAM words at every STEP-th word
LEAST = 12  # words of a run


def doubled(rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of 2k-grams from those of k-grams, and the grams that occur again: their numbers, rising, and places."""
    n = len(rank) - 1
    at = np.flatnonzero((rank[: n - k] >= 0) & (rank[k:n] >= 0)) if n > k else np.empty(0, np.int64)
    key = rank[at].astype(np.int64) << 32 | rank[at + k]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    again = ~(new & np.append(new[1:], True)[: len(key)])
    at, number = at[again], (np.cumsum(new[again]) - 1).astype(np.int64)
    out = alone(n)
    out[at] = number
    return out, number, at


def alone(n: int) -> np.ndarray:
    """Numbers below 0 that equal nothing, for n places and the one after the last."""
    return -1 - np.arange(n + 1, dtype=np.int32)


def gram_numbers(words: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """By doubling, till nothing occurs again: gram numbers of each place, and the occurrences of repeated grams."""
    ranks, seen = [alone(len(words))], [(np.empty(0, np.int64), np.empty(0, np.int64))]
    ranks[0][:-1] = words
    while True:
        rank, number, at = doubled(ranks[-1], 1 << len(ranks) - 1)
        if not len(at):
            return ranks, seen
        ranks.append(rank)
        seen.append((number, at))


def pairs(ranks: list[np.ndarray], seen: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of seeds that occur again at a lag of their level, by lag and place."""
    n, places, lags = len(ranks[0]) - 1, [], []
    if len(ranks) > 2:
        grams, seeds = ranks[2], np.arange(0, n, STEP)
        seeds = seeds[grams[seeds] >= 0]
        for q in range(1, SHORT):
            i = seeds[seeds + q < n]
            i = i[grams[i] == grams[i + q]]
            places.append(i)
            lags.append(np.full(len(i), q))
    for t in range(2, len(ranks)):
        k, (number, at) = 1 << t, seen[t]
        stride = n + 4 * k
        key, seed = number * stride + at, at % k == 0
        low, high = (np.searchsorted(key, key[seed] + d) for d in (2 * k, 4 * k))
        many = high - low
        i = np.repeat(at[seed], many)
        j = at[np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)]
        places.append(i)
        lags.append(j - i)
    i, q = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, lags))
    order = np.lexsort((i, q))
    return i[order], q[order]


def extended(ranks: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the stretch of words around i that equal those q later."""
    n, right, left = len(ranks[0]) - 1, i.copy(), i.copy()
    for t in range(len(ranks) - 1, -1, -1):
        right += (ranks[t][right] == ranks[t][right + q]).astype(np.int64) << t
    for t in range(len(ranks) - 1, -1, -1):
        before = left - (1 << t)
        left -= (ranks[t][np.where(before < 0, n, before)] == ranks[t][np.maximum(before + q, 0)]).astype(np.int64) << t
    return left, right


def runs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of every run in words, whose numbers differ between documents; by start, then period."""
    ranks, seen = gram_numbers(words)
    i, q = pairs(ranks, seen)
    found = [np.empty((3, 0), np.int64)]
    sweep = True
    while len(i):
        head = np.concatenate(([True], q[1:] != q[:-1])) if sweep else np.ones(len(i), bool)
        low, high = extended(ranks, i[head], q[head])
        lag = q[head]
        good = high - low >= np.maximum(LEAST - lag, lag)
        found.append(np.stack((low, high + lag - low, lag))[:, good])
        covered = np.repeat(high, np.diff(np.append(np.flatnonzero(head), len(i))))  # of each lag, as far as known
        left = i >= covered
        sweep = 2 * left.sum() < len(i)  # else few pairs share a stretch: the rest is extended at once
        i, q = (i[left], q[left]) if head.sum() < len(i) else (i[:0], q[:0])
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[: len(start)]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, which word stands at each place once their end is made to repeat."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % (1 + (n - a) // (3 + g % 8)), at)


class Slice:
    """Words of some texts, as they stand or with repeats planted by doc_id, and their runs."""

    def __init__(self, texts: list[str], doc_ids: list[int | None] | None = None) -> None:
        self.words = [t.encode().split() for t in texts]  # splits at what the contract calls blanks, as no other byte is one
        self.source = [planted(d, len(w)) for d, w in zip(doc_ids, self.words, strict=True)] if doc_ids else [None] * len(texts)
        numbers, taken = [], 0
        for words, source in zip(self.words, self.source, strict=True):
            known: dict[bytes, int] = {}
            mine = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)) + np.int32(taken)
            taken += len(known)
            numbers.append(mine if source is None else mine[source])
        self.edges = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)
        self.start, self.length, self.period = runs_of(np.concatenate(numbers) if numbers else np.empty(0, np.int32))
        self.of = np.searchsorted(self.start, self.edges)  # where each document's runs begin
        gone = np.zeros(self.edges[-1] + 1, np.int32)
        np.add.at(gone, self.start + self.period, 1)
        np.add.at(gone, self.start + self.length, -1)
        self.kept = np.cumsum(gone)[:-1] == 0

    def runs(self, i: int) -> list[tuple[int, int, int]]:
        a, b = self.of[i], self.of[i + 1]
        return list(zip((self.start[a:b] - self.edges[i]).tolist(), self.length[a:b].tolist(), self.period[a:b].tolist(), strict=True))

    def collapsed(self, i: int) -> bytes:
        words, source, kept = self.words[i], self.source[i], self.kept[self.edges[i] : self.edges[i + 1]]
        if source is None and kept.all():
            return b" ".join(words)
        return b" ".join([words[k] for k in (np.arange(len(words)) if source is None else source)[kept].tolist()])


def _mapped(docs: DataFrame, make: Callable[[pa.RecordBatch, Slice], pa.RecordBatch], schema: str, plant: bool = False) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in batches_of(whole, 1):
                yield make(batch, Slice(texts, batch.column(0).to_pylist() if plant else None))
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def find_runs(docs: DataFrame) -> DataFrame:
    """Every run in the texts of docs(doc_id, text), a row each: doc_id, start, length, period, in words."""

    def make(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        doc = np.repeat(np.arange(batch.num_rows), np.diff(s.of))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(s.start - s.edges[doc]), pa.array(s.length), pa.array(s.period)], ["doc_id", "start", "length", "period"])

    return _mapped(docs, make, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs(doc_id, text), each run cut to its first period; words are joined by one space."""

    def make(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.collapsed(i).decode() for i in range(batch.num_rows)], pa.string())], ["doc_id", "text"])

    return _mapped(docs, make, "doc_id long, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, text) with planted repeats: number of runs, the longest, hashes of all and of the rest."""

    def make(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        out = []
        for i in range(batch.num_rows):
            runs = s.runs(i)
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
            out.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(s.collapsed(i)).hexdigest()))
        columns = zip(*out, strict=True)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return _mapped(docs, make, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", plant=True)


def op12_seed_extend_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir))
