"""Removes what stood before: bytes of strings of 50 that also start in a document of a smaller doc_id.

Anchors bring equal strings together. The anchor of a string is its 24-gram of the least hash, so equal strings have equal
anchors; neighbouring strings that share one are a piece (at most 62 strings, 111 bytes). A piece is named by its anchor and
a second hash. Anchors met in two documents or more are found by one count that combines on the map side, and a bit filter
that grows with their number lets only them through when the texts are read again. A named piece that stands in an earlier document goes as
a whole, in every other. Only where an anchor has several pieces must their bytes be compared.

That is done by a run-length index, a bucket of some thousand pieces at a time. Pieces that can be a source are sorted by
suffix, and what stays is their Burrows-Wheeler transform in runs of equal bytes, text places sampled at both ends of each
run, and for each interval of suffixes that share 50 bytes the smallest doc_id. The other pieces are streamed from their ends
to their beginnings, all of a bucket in step: where the next byte is that of the current run the match grows by one
LF-mapping; elsewhere it goes on at the nearest run end of that byte above or below, whichever sample shares more with the
match so far. Where a matching statistic reaches 50, its row's interval tells whether an earlier document has the string.

An anchor with more pieces than a bucket may hold (the edge of a passage in a third of all documents) is split into its
single strings, which are counted by their bytes; no bucket grows with an anchor, and the pieces of a string that many have
are dealt over several tasks. Joins of pieces that many documents share are split by Spark's handling of skew.

Defined results: null texts are empty; texts below 50 bytes, and rows with a null doc_id, lose nothing and take nothing from
others; rows that repeat a doc_id take nothing from each other; further columns are ignored; an empty table gives an empty
result. Rows are told apart by doc_id and the crc32 of the text, so two different texts of one doc_id with one crc32 would
share their marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.llm.common import documents, drop_shuffles, forget, give_back, materialise, salted_join

LENGTH = 50  # bytes of a string
ANCHOR = 24  # bytes of an anchor; 32 of the second hash's parts
MOST = 62  # strings of a piece, a bit each
WHOLE = -1  # all strings of a piece
FILTER_BITS = 26, 30  # of a filter by the power of two: 8 MB at least, 128 MB at most
KEY_BITS = 6  # a key has this many bits of a filter or more, which lets one other key in twelve through at most
PIECES = 16_384  # of a bucket, about
HOT = 4_096  # pieces of an anchor beyond which it is split into strings
DEALT = 2_000  # pieces of a string that are looked up in one task
SLICE = 65_536  # bytes of text hashed at once, so that arrays of their hashes stay in a core's cache
MARKED = 400_000  # bytes of text that marks are put on at once
ROWS = 16_384  # of small batches that go to Spark together
PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * PRIMES[0]
    x ^= x >> np.uint64(31)
    x *= PRIMES[1]
    x ^= x >> np.uint64(29)
    return x


def word_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all grams of 8 bytes, from which those of longer ones are made."""
    return mixed(np.ndarray((len(b) - 7,), "<u8", b, strides=(1,)))


def least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    span = 1
    while 2 * span <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if span < w else h


class Pieces:
    """Pieces of texts that lie one behind the other in b, with edges: place, number of strings, document, anchor, name.
    Names are made when they are asked for, so those of pieces that were left out before cost nothing."""

    def __init__(self, b: np.ndarray, edges: np.ndarray) -> None:
        self.b, self.place = b, np.empty(0, np.int64)
        self.strings = self.doc = self.anchor = self.place
        self.made, self.words = None, np.empty(0, np.uint64)
        if len(b) < LENGTH:
            return
        self.words = h = word_hashes(b)
        low = least(mixed((h[:-16] * PRIMES[2] + h[8:-8]) * PRIMES[2] + h[16:]), LENGTH - ANCHOR + 1)
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        ends = np.diff(edges) >= LENGTH
        begin, stop = edges[:-1][ends], edges[1:][ends] - LENGTH + 1  # where strings of each text begin
        new[begin] = True
        new[stop[stop < len(new)]] = True
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(low)))
        of = np.searchsorted(begin, at, side="right") - 1
        inside = (of >= 0) & (at < stop[of])
        at, many, of = at[inside], many[inside], of[inside]
        if many.size and many.max() > MOST:  # a repeated anchor goes on and on
            cuts = -(-many // MOST)
            k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            at, many, of = np.repeat(at, cuts) + MOST * k, np.minimum(MOST, np.repeat(many, cuts) - MOST * k), np.repeat(of, cuts)
        self.place, self.strings, self.doc, self.anchor = at, many, np.flatnonzero(ends)[of], low[at].view(np.int64)

    def parts(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the 32 bytes from these places on."""
        h, out = self.words, self.words[at]
        for k in (8, 16, 24):
            out *= PRIMES[2]
            out += h[at + k]
        return mixed(out)

    @property
    def name(self) -> np.ndarray:
        if self.made is None:
            last = self.place + self.strings + LENGTH - 1 - 32
            name = self.parts(self.place) * PRIMES[0] + mixed(self.parts(last)) + self.strings.astype(np.uint64)
            for step in (32, 64):
                name = mixed(name) + self.parts(np.minimum(self.place + step, last))
            self.made = mixed(name).view(np.int64)
        return self.made

    def keep(self, mask: np.ndarray) -> None:
        for k in ("place", "strings", "doc", "anchor", *["made"] * (self.made is not None)):
            setattr(self, k, getattr(self, k)[mask])

    def texts(self) -> pa.Array:
        size = self.strings + LENGTH - 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place - ends + size, size)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(self.b[at])])


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes of their texts, one behind the other, and their edges. most: bytes of a slice, besides a text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows])).tolist()
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            piece = batch.slice(a, z - a)
            text = b"".join(x.as_py().encode() for x in piece.column(column) if x.is_valid)
            yield piece, np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum(size[a:z])))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def filter_power(keys: int) -> int:
    """The filter's bits for so many keys, as a power of two. Beyond the most it lets more through, and nothing is lost."""
    least, most = FILTER_BITS
    return min(max(least, (KEY_BITS * keys - 1).bit_length()), most)


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    out, power = np.ones(len(key), bool), (64 * len(bits)).bit_length() - 1
    for shift in (0, power):
        p = key >> shift & (1 << power) - 1
        out &= (bits[p >> 6] >> (p & 63) & 1).astype(bool)
    return out


def bit_filter(keys: DataFrame, key: Column) -> Broadcast:
    """Two bits a key. keys: a table that is written, so that it is counted and read at no cost. Words of 64 bits are put
    together by aggregation, and 2^16 of them to one value each, which come to the driver a partition at a time."""
    power = filter_power(keys.count())
    p = F.explode(F.array(*(F.shiftright(key, s).bitwiseAND(F.lit((1 << power) - 1)) for s in (0, power))))
    words = keys.select(p.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).withColumn("block", F.shiftright("word", 16))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << 16, np.int64)
        out[part["word"].to_numpy() & 0xFFFF] = part["bits"].to_numpy()
        return pd.DataFrame({"block": part["block"].iloc[:1], "bits": [out.tobytes()]})

    bits = np.zeros((1 << power - 22, 1 << 16), np.int64)
    for r in words.groupBy("block").applyInPandas(pack, "block long, bits binary").toLocalIterator():
        bits[r["block"]] = np.frombuffer(r["bits"], np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(bits.ravel())
    drop_shuffles(keys.sparkSession)
    return shared


def _scan(docs: DataFrame, columns: dict[str, str], allowed: Broadcast | None = None, key: str = "anchor") -> DataFrame:
    """columns of the pieces of docs(doc_id, text) that pass allowed by key: anchor, name, or name and doc_id together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, b, edges in slices(whole, 1, SLICE):
                p = Pieces(b, edges)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                if allowed is not None:
                    p.keep(passes(allowed.value, p.anchor if key == "anchor" else p.name if key == "name" else p.name ^ ids[p.doc]))
                made = {
                    "anchor": lambda p=p: p.anchor, "name": lambda p=p: p.name, "doc_id": lambda p=p, ids=ids: ids[p.doc], "place": lambda p=p, edges=edges: (p.place - edges[p.doc]).astype(np.int32),
                    "strings": lambda p=p: p.strings.astype(np.int32), "piece": lambda p=p: p.texts(), "text_crc": lambda p=p, batch=batch: batch.column(2).to_numpy(zero_copy_only=False)[p.doc],
                }
                yield pa.RecordBatch.from_arrays([pa.array(made[c]()) for c in columns], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(each(batches))
        give_back()

    rows = docs.where("doc_id is not null and octet_length(text) >= 50").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("text").cast("binary")).alias("text_crc"))
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in columns.items()))


class RunIndex:
    """Texts by the runs of their Burrows-Wheeler transform. owner: a number of each text; of a string that several texts
    hold, the least counts."""

    def __init__(self, texts: list[bytes], owner: np.ndarray) -> None:
        n_texts = len(texts)
        # bytes of UTF-8 are below 255, so a step up leaves 0 for the ends; an end sorts by the number of its text
        t = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
        n = len(t)
        ends = np.flatnonzero(t == 0)
        to_end = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)
        order, at50 = self._suffixes(t, to_end)
        text_of = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(np.concatenate(([-1], ends))))[order]
        # intervals of suffixes that share LENGTH bytes
        new = np.concatenate(([True], at50[0][order][1:] != at50[0][order][:-1]))
        new[1:] |= at50[1][order][1:] != at50[1][order][:-1]
        intervals = np.flatnonzero(new)
        self.least_owner = np.minimum.reduceat(owner[text_of], intervals)
        self.interval_of = np.repeat(np.arange(len(intervals), dtype=np.int32), np.diff(np.append(intervals, n)))  # of a row
        before = np.where(order > 0, t[order - 1], 0)
        head = np.concatenate(([True], before[1:] != before[:-1]))
        self.start = np.flatnonzero(head)
        self.run_of = np.cumsum(head, dtype=np.int32) - np.int32(1)  # of a row
        self.byte = before[self.start]
        stop = np.append(self.start[1:], n)
        self.first_place, self.last_place = order[self.start], order[stop - 1]
        # LF: rows of a byte follow the rows of lesser ones, in their order
        length = stop - self.start
        by_byte = np.argsort(self.byte, kind="stable")
        total = np.cumsum(length[by_byte]) - length[by_byte]
        self.lf = np.empty(len(length), np.int64)
        self.lf[by_byte] = total - self.start[by_byte]
        self.sorted_runs, self.run_keys = by_byte, self.byte[by_byte].astype(np.int64) * (n + 1) + self.start[by_byte]
        self.stop, self.n, self.place0 = stop, n, int(order[0])
        padded = np.concatenate((t, np.zeros(64, np.uint8)))
        self.words = np.ndarray((n + 56,), "<u8", padded.tobytes(), strides=(1,))

    @staticmethod
    def _suffixes(t: np.ndarray, to_end: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Suffix order by doubling from 7 bytes, and two numbers that are equal where 50 bytes are."""
        n, span = len(t), 7
        key = np.zeros(n, np.int64)
        for k in range(span):
            key = key * 257 + np.where(k <= to_end, np.append(t[k:], np.zeros(k, np.uint8)).astype(np.int64), 0)
        order = np.argsort(key, kind="stable")  # suffixes that end within stay in the order of their texts
        key = key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (to_end[order][1:] < span)))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        at50 = rank, rank
        while True:
            if span == 28:  # 28 bytes from here and from 22 on are 50
                ahead = np.minimum(np.arange(n) + LENGTH - 28, n - 1)
                at50 = rank.copy(), np.where(to_end >= LENGTH, rank[ahead], -1 - np.arange(n))
            slots = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(slots) and span >= 28:
                return order, at50
            these = order[slots]
            key = rank[these] << 32 | rank[np.minimum(these + span, n - 1)]
            by = np.argsort(key, kind="stable")
            order[slots], key = these[by], key[by]
            new[slots] = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
            heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order[slots]] = heads[slots]
            span *= 2

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the texts share from places a and b on, at most most."""
        out, going = most.copy(), np.arange(len(a))
        for k in range(0, LENGTH, 8):
            x = self.words[np.minimum(a[going] + k, self.n)] ^ self.words[np.minimum(b[going] + k, self.n)]
            differ = x != 0
            low = (x[differ] & (~x[differ] + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
            out[going[differ]] = np.minimum(most[going[differ]], k + (np.log2(low) // 8).astype(np.int64))
            going = going[~differ & (most[going] > k + 8)]
            if not len(going):
                break
        return out

    def earlier(self, texts: list[bytes], owner: np.ndarray) -> np.ndarray:
        """For each text the strings, a bit each by where they begin, that a text of a lesser owner holds."""
        size = np.array([len(x) for x in texts], np.int64)
        last = np.cumsum(size) - 1
        b = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)
        out = np.zeros(len(texts), np.int64)
        row, place, match = np.zeros(len(texts), np.int64), np.full(len(texts), self.place0), np.zeros(len(texts), np.int64)
        for step in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > step)
            c, r, p, m = b[last[on] - step].astype(np.int64), row[on], place[on], match[on]
            run = self.run_of[r]
            miss = np.flatnonzero(self.byte[run] != c)
            if len(miss):
                self._jump(miss, c, r, p, m, run)
            known = self.byte[run] == c
            row[on] = np.where(known, r + self.lf[run], 0)
            place[on] = np.where(known, p - 1, self.place0)
            match[on] = m = np.where(known, np.minimum(m + 1, LENGTH), 0)
            full = on[m >= LENGTH]
            if len(full):
                found = full[self.least_owner[self.interval_of[row[full]]] < owner[full]]
                out[found] |= np.int64(1) << size[found] - 1 - step
        return out

    def _jump(self, miss: np.ndarray, c: np.ndarray, r: np.ndarray, p: np.ndarray, m: np.ndarray, run: np.ndarray) -> None:
        """Sends rows whose run has another byte to the end of a run of theirs, above or below, that shares more."""
        byte, here, near = c[miss], p[miss], np.searchsorted(self.run_keys, c[miss] * (self.n + 1) + r[miss], side="right")
        most = np.minimum(m[miss], LENGTH - 1)
        best = np.full(len(miss), -1, np.int64)
        for k, places, rows in ((near - 1, self.last_place, self.stop - 1), (near, self.first_place, self.start)):
            inside = (k >= 0) & (k < len(self.sorted_runs))
            found = self.sorted_runs[np.where(inside, k, 0)]
            share = np.where(inside & (self.byte[found] == byte), self.common(here, places[found], most), -1)
            better = share > best
            at, found = miss[better], found[better]
            best = np.maximum(best, share)
            run[at], r[at], p[at] = found, rows[found], places[found]
        m[miss] = np.maximum(best, 0)


def _compare(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
    """anchor, name, mask of the pieces of a bucket whose strings partly stand earlier. have: bytes as read, want: names."""
    both = want.merge(have.drop(columns="bucket"), left_on=["anchor", "name", "first"], right_on=["anchor", "name", "doc_id"]).drop_duplicates(["anchor", "name"])
    source, seeker = both[both["first"] < both["highest"]], both[both["first"] > both["lowest"]]
    if source.empty or seeker.empty:
        return pd.DataFrame({"anchor": [], "name": [], "mask": []}, dtype="int64")
    index = RunIndex(source["piece"].tolist(), source["first"].to_numpy(np.int64))
    mask = index.earlier(seeker["piece"].tolist(), seeker["first"].to_numpy(np.int64))
    return seeker[["anchor", "name"]].assign(mask=mask)[mask != 0]


def _strings(have: DataFrame, hot: DataFrame) -> DataFrame:
    """anchor, name, first, at, string of the pieces of hot."""
    pieces = have.withColumnRenamed("doc_id", "first").join(hot.select("anchor", "name", "first"), ["anchor", "name", "first"])
    at = F.explode(F.sequence(F.lit(0), F.octet_length("piece") - LENGTH))
    return pieces.select("anchor", "name", "first", "piece", at.alias("at")).withColumn("string", F.expr(f"substring(piece, at + 1, {LENGTH})")).drop("piece")


def _common_strings(strings: DataFrame) -> DataFrame:
    """anchor, string, earliest, n of the strings that stand more than once; the others have no earlier one."""
    return strings.groupBy("anchor", "string").agg(F.min("first").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _late_strings(strings: DataFrame, common: DataFrame, dealt: int) -> DataFrame:
    """The strings that also stand earlier. A string of more than dealt pieces goes to several tasks: Spark splits no join
    of which one side comes from an aggregate by the same keys."""
    return salted_join(strings, common.drop("n"), ["anchor", "string"], common.select("anchor", "string", "n"), ["name"], rows=dealt).where("earliest < first")


def _split_strings(have: DataFrame, hot: DataFrame, dealt: int) -> DataFrame:
    """anchor, name, mask as _compare gives them, for anchors with more pieces than a bucket takes: string by string."""
    strings = _strings(have, hot)
    common = materialise(_common_strings(strings), "repeats-strings")
    masks = materialise(_late_strings(strings, common, dealt).groupBy("anchor", "name").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")), "repeats-masks")
    forget(common)
    return masks


def _masks(docs: DataFrame, unsure: DataFrame, pieces: int, split: int, dealt: int) -> list[DataFrame]:
    """anchor, name, mask of unsure pieces of which some strings stand earlier, in a table for each way, and what they read."""
    have = materialise(_scan(docs, {"anchor": "long", "name": "long", "doc_id": "long", "piece": "binary"}, bit_filter(unsure, F.col("name").bitwiseXOR(F.col("first"))), "both"), "repeats-pieces")
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(max(1, unsure.count() // pieces))).alias("bucket")
    usual, hot = unsure.where(F.col("n") <= split), unsure.where(F.col("n") > split)
    want = usual.select(bucket, "anchor", "name", "first", "lowest", "highest")
    masks = [materialise(have.select(bucket, "*").groupBy("bucket").cogroup(want.groupBy("bucket")).applyInPandas(_compare, "anchor long, name long, mask long"), "repeats-masks")]
    if not hot.isEmpty():
        masks.append(_split_strings(have, hot, dealt))
    forget(have)
    return masks


def _late(docs: DataFrame, pieces: int, split: int, dealt: int) -> DataFrame:
    """anchor, name, first, mask of the pieces that go from some document: from all but the first as a whole, from the first
    by its mask."""
    spark = docs.sparkSession
    count = _scan(docs, {"anchor": "long", "doc_id": "long"}).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialise(count.where("low < high").select("anchor"), "repeats-anchors")
    del count
    drop_shuffles(spark)
    named = _scan(docs, {"anchor": "long", "name": "long", "doc_id": "long"}, bit_filter(shared, F.col("anchor"))).groupBy("anchor", "name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    named = materialise(named, "repeats-names")
    forget(shared)
    drop_shuffles(spark)
    several = named.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("lowest"), F.max("first").alias("highest")).where("n > 1 and lowest < highest")
    unsure = materialise(named.join(several, "anchor").drop("last"), "repeats-unsure")
    del several
    masks = _masks(docs, unsure, pieces, split, dealt)
    drop_shuffles(spark)
    late = materialise(named.join(reduce(DataFrame.unionByName, masks), ["anchor", "name"], "left").where("first < last or mask is not null").drop("last"), "repeats-late")
    forget(named, unsure, *masks)
    drop_shuffles(spark)
    return late


def earlier_marks(docs: DataFrame, pieces: int = PIECES, split: int = HOT, dealt: int = DEALT) -> DataFrame:
    """doc_id, text_crc, marks of the texts in docs(doc_id, text) that hold strings of earlier documents; marks: an array of
    (place, strings, mask) for pieces, mask WHOLE or a bit for each string that goes. pieces: of a bucket, about; split: pieces of
    an anchor beyond which its strings are counted one by one; dealt: pieces of a string that one task looks up."""
    late = _late(docs, pieces, split, dealt)
    kinds = {"anchor": "long", "name": "long", "doc_id": "long", "text_crc": "long", "place": "int", "strings": "int"}
    hits = _scan(docs, kinds, bit_filter(late, F.col("name")), "name")
    marked = hits.join(late, ["anchor", "name"]).where("doc_id > first or mask is not null")
    mark = F.struct("place", "strings", F.when(F.col("doc_id") > F.col("first"), F.lit(WHOLE)).otherwise(F.col("mask")).cast("long").alias("mask"))
    marks = materialise(marked.groupBy("doc_id", "text_crc").agg(F.collect_list(mark).alias("marks")), "repeats-marks")  # its shuffles go before texts are shuffled
    del hits, marked
    forget(late)
    drop_shuffles(docs.sparkSession)
    return marks


def removed(total: int, place: np.ndarray, strings: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of total bytes the marked strings cover."""
    edge = np.zeros(total + 1, np.int32)
    whole = mask == WHOLE
    np.add.at(edge, place[whole], 1)
    np.add.at(edge, (place + strings)[whole] + LENGTH - 1, -1)
    part, bits = place[~whole], mask[~whole]
    for k in range(MOST if len(part) else 0):
        on = part[(bits >> k & 1).astype(bool)] + k
        np.add.at(edge, on, 1)
        np.add.at(edge, on + LENGTH, -1)
    return np.cumsum(edge)[:-1] > 0


def _marked(docs: DataFrame, make: Callable, schema: str, **how) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, b, edges in slices(whole, 1, MARKED):
                marks = batch.column(2)
                doc = pc.list_parent_indices(marks).to_numpy(zero_copy_only=False)
                place, strings, mask = (pc.struct_field(pc.list_flatten(marks), k).to_numpy(zero_copy_only=False) for k in range(3))
                yield make(batch, b, edges, removed(len(b), place + edges[doc], strings, mask))
        give_back()

    return rows.join(earlier_marks(docs, **how), ["doc_id", "text_crc"], "left").select("doc_id", "text", "marks").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id and rest of docs(doc_id, text): the bytes that stay (a cut may fall within a character)."""

    def make(batch: pa.RecordBatch, b: np.ndarray, edges: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        rest = [b[a:z][~gone[a:z]].tobytes() for a, z in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.binary())], ["doc_id", "rest"])

    return _marked(docs, make, "doc_id long, rest binary", **how)


def repeat_digests(docs: DataFrame, **how) -> DataFrame:
    """A row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(batch: pa.RecordBatch, b: np.ndarray, edges: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        first = gone.copy()  # bytes of each removed run
        first[1:] &= ~gone[:-1]
        begin = edges[:-1][edges[:-1] < len(b)]
        first[begin] = gone[begin]
        before, runs = (np.concatenate(([0], np.cumsum(x)))[edges] for x in (gone, first))
        rest, cuts = memoryview(b[~gone]), (edges - before).tolist()
        digests = [hashlib.sha256(rest[a:z]).hexdigest() for a, z in zip(cuts, cuts[1:], strict=False)]
        numbers = [pa.array(np.diff(x), pa.int64()) for x in (edges, before, runs)]
        return pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **how)


def op13_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))
