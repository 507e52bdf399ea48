"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct 5-word shingles. Each of ``BUCKETS`` buckets has its own hash function and keeps, of the
set's least hash, the count of leading zeros and ``MANTISSA`` further bits (16 bits in all), so short sets fill all buckets
too. ``ROWS`` compressed registers make a band; texts that share a band are candidates, their Jaccard similarity is
estimated from equal registers less the collisions that compression makes, and what may reach the threshold is verified on
full sets. At the threshold of 0.85 a pair misses all 32 bands of 5 with a probability of 7e-9.

Equal sets are one class first (exact copies cost one row). Links are found in two steps, so that no group makes all its
pairs: (1) each class against two pivots of each of its bands, its first class and one by a hash, the same for all bands
they are in; links become components; (2) bands that still hold several components are compared in full, in blocks of
bounded size in rows and shingles, and a block reports a spanning forest of its links only. Members of large bands meet by
their rarest shingles instead of by their bands: of n shingles the rarest 15 % and one (at 0.85), by counts over these
members, of which two similar sets share one for certain. So no link is lost, and a passage that all members share makes no
group, as it isn't rare. What is left to compare in full are members that share a rare shingle and no component.

Components come from alternating large and small stars, each step written to the shared folder. Keys that many rows share
(a band, a pivot, a class of copies) are dealt over several tasks in every join; rows without shingles are kept apart.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer than five words are one
shingle; very long texts are one set like others; rows that repeat a doc_id are one document; a null doc_id has no
component and is kept; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.llm.common import BROADCAST_ROWS, broadcast_if_small, documents, forget, fresh, give_back, materialise, salted_join

BANDS, ROWS, MANTISSA = 32, 5, 10
BUCKETS = BANDS * ROWS
BLOCK = 512  # rows of a band that are compared in one piece, and shingles that they hold together
BLOCK_SHINGLES = 1_000_000
FEW = 16  # shingles of at most so many members are rare alike

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=_U)
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_A, _B = (_RNG.integers(0, 2**32, (BUCKETS, 1), dtype=np.uint32) for _ in range(2))
_A |= np.uint32(1)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i up to n (mod 2^64), grown as needed."""
    if len(_POWERS[0]) <= n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(2 * n + 1, p)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=_U)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words parted by ASCII blanks, A-Z in lower case."""
    data = (text or "").encode(errors="surrogatepass").lower()
    b = np.frombuffer(data, np.uint8)
    blank = (b == 32) | (b - 9 < 5)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, _U)
    up, down = _powers(len(b))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b] * up[:-1], dtype=_U)))
    word = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    n = max(1, len(word) - size + 1)
    h = np.full(n, _U(min(size, len(word))))
    for i in range(min(size, len(word))):
        h = _mix(h) + word[i : i + n]
    return np.unique(_mix(h))


def registers(x: np.ndarray) -> np.ndarray:
    """The compressed registers of a set: leading zeros of each bucket's least hash, then its next bits."""
    x = (x >> _U(32)).astype(np.uint32)[None, :]
    least = np.full(BUCKETS, 2**32 - 1, np.uint32)
    for i in range(0, x.shape[1], 2048):
        np.minimum(least, (((x[:, i : i + 2048] ^ _B) * _A)).min(1), out=least)
    wide = least.astype(np.float64) + 0.5
    zeros = 31 - np.floor(np.log2(wide)).astype(np.int64).clip(0)
    top = (least.astype(np.uint64) << (zeros + 1).astype(_U)) & _U(2**32 - 1)
    return ((zeros << MANTISSA).astype(_U) | top >> _U(32 - MANTISSA)).astype(np.uint16)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often registers of disjoint sets of these sizes are equal: both leading-zero counts agree, then the bits."""
    edges = 0.5 ** np.arange(33)
    hit = lambda n: (1 - edges[None, 1:]) ** n[:, None] - (1 - edges[None, :-1]) ** n[:, None]
    return (hit(a.astype(float)) * hit(b.astype(float))).sum(1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, corrected for collisions."""
    c = collisions(n_a, n_b)
    return ((a == b).mean(1) - c) / (1 - c)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "h1", "h2", "registers"]
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            n, h1, h2, r = [], [], [], []
            for text in b.column(1):
                x = shingles(text.as_py())
                n.append(len(x))
                h1.append(x.sum(dtype=_U))
                h2.append(_mix(x + _P).sum(dtype=_U))
                r.append(registers(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(h, _U).view(np.int64)) for h in (h1, h2)), pa.array(r, pa.binary())], names)
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            x = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in x]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))], ["cid", "set"])
    give_back()


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j = estimate(_rows_of(b["r_a"]), _rows_of(b["r_b"]), b["n_a"].to_numpy(), b["n_b"].to_numpy())
                yield b.select(["a", "b"]).filter(pa.array(j >= least))

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in names, which the rows are sorted by."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        keys = np.stack([t[n].to_numpy() for n in names], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), t.num_rows]
        if held and any(held[-1][n][-1].as_py() != t[n][0].as_py() for n in names):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            held.append(t.slice(x, y - x))
            if y < t.num_rows:
                yield pa.concat_tables(held).combine_chunks()
                held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


_KEYS = ["key", "i", "j"]


def _open_pairs(t: pa.Table, threshold: float) -> np.ndarray:
    """Which rows of a block pair are to be compared: different components, sizes that allow it, across the blocks."""
    comp, n, block = (t[c].to_numpy() for c in ("comp", "n", "block"))
    ok = (comp[:, None] != comp) & (np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n) - 1e-9)
    if t["i"][0].as_py() != t["j"][0].as_py():
        ok &= block[:, None] != block
    return np.triu(ok, 1)


def _with_partner(threshold: float, least: float):
    """Keeps the rows of a block pair that have a likely partner in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, _KEYS):
            a, b = np.nonzero(_open_pairs(t, threshold))
            if not len(a):
                continue
            r, n = _rows_of(t["registers"]), t["n"].to_numpy()
            kept = np.zeros(t.num_rows, bool)
            for s in range(0, len(a), 20_000):
                x, y = a[s : s + 20_000], b[s : s + 20_000]
                near = estimate(r[x], r[y], n[x], n[y]) >= least
                kept[x[near]] = kept[y[near]] = True
            if kept.any():
                yield from t.select([*_KEYS, "block", "cid", "n", "comp"]).filter(pa.array(kept)).to_batches()

    return run


def _forest(threshold: float):
    """Verified links of a block pair, as many as join its components."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, _KEYS):
            open_ = _open_pairs(t, threshold)
            if not open_.any():
                continue
            lists = t["set"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            _, local, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            shared = count[local] > 1
            place = (np.cumsum(count > 1) - 1)[local[shared]]
            owner, common = owner[shared], np.zeros((len(sizes), len(sizes)), np.float32)
            step = 2048
            for s in range(0, int((count > 1).sum()), step):
                own = (place >= s) & (place < s + step)
                m = np.zeros((len(sizes), step), np.float32)
                m[owner[own], place[own] - s] = 1
                common += m @ m.T
            x, y = np.nonzero(open_)
            both = common[x, y].astype(np.int64)
            fits = 100 * both >= percent * (sizes[x] + sizes[y] - both)
            x, y = x[fits], y[fits]
            comp, cid = t["comp"].to_numpy(), t["cid"].to_numpy()
            _, first = np.unique(np.stack([comp[x], comp[y]]), axis=1, return_index=True) if len(x) else (None, np.zeros(0, int))
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.setdefault(c, c)) != c:
                    root[c] = root[up]
                    c = up
                return c

            out = []
            for k in first.tolist():
                p, q = find(int(comp[x[k]])), find(int(comp[y[k]]))
                if p != q:
                    root[p] = q
                    out.append((int(cid[x[k]]), int(cid[y[k]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        give_back()

    return run


def components(edges: DataFrame) -> DataFrame:
    """v, m of every node v of edges(a, b) but the least of its component, m: alternating large and small stars."""
    pairs = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    last = mark(pairs)
    while last[0]:
        # Large star: what is greater than a node goes to the node's least neighbour.
        both = pairs.unionByName(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.least(F.min("m"), F.first("v")).alias("to"), F.count("*").alias("n"))
        least = materialise(least, "least")
        large = salted_join(both.withColumnRenamed("v", "u"), least.drop("n"), ["u"], least.select("u", "n"), ["m"])
        large = materialise(large.where(F.col("m") > F.col("u")).select(F.col("m").alias("v"), F.col("to").alias("m")).distinct(), "large-star")
        # Small star: a node and what is less than it go to the least of these.
        small = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("to"), F.count("*").alias("n"))
        old = pairs, least
        least = materialise(small, "least")
        small = salted_join(large.withColumnRenamed("v", "u"), least.drop("n"), ["u"], least.select("u", "n"), ["m"])
        small = small.where(F.col("m") != F.col("to")).select(F.col("m").alias("v"), F.col("to").alias("m"))
        pairs = materialise(small.unionByName(least.select(F.col("u").alias("v"), F.col("to").alias("m"))).distinct(), "small-star")
        now = mark(pairs)
        forget(*old, least, large)
        if now == last:
            break
        last = now
    return pairs


def _prefix(n: int, percent: int) -> int:
    """How many of its n shingles a set must show: what is as similar as percent shares one of them, whatever the order that
    both are taken in, since it shares percent of n at least."""
    return n - (percent * n + 99) // 100 + 1


def _rarest(percent: int, counted: Broadcast):
    """The first shingles of each set by their count (those that aren't counted first), then by their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = counted.value
        for b in batches:
            keys, n = [np.zeros(0, np.int64)], []
            for row in b["set"]:
                x = row.values.to_numpy()
                at = np.searchsorted(value, x).clip(max=max(len(value) - 1, 0))
                often = np.where(value[at] == x, count[at], 0) if len(value) else np.zeros(len(x), np.int64)
                keys.append(x[np.lexsort((x, often))[: _prefix(len(x), percent)]])
                n.append(len(keys[-1]))
            of = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(b[c].take(of) for c in ("cid", "n", "comp"))], ["key", "cid", "n", "comp"])

    return run


def split_bands(rows: DataFrame, sets: DataFrame, threshold: float, least: int, small: int = BROADCAST_ROWS) -> DataFrame:
    """rows(key, cid, n, comp) with those of bands of more than least rows split by shingles, which loses no link: a member
    of such bands goes to the groups of its rarest shingles, of which all that is similar to it shares one, once for all its
    bands. sets(cid, set) has the members' shingles. Counts of more than FEW are told to all tasks if they are at most small,
    else joined; both ways give the same rows."""
    percent = round(100 * threshold)
    large = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > least).select("key")
    large = materialise(large, "large-bands")
    n = large.count()
    if not n:
        return rows
    large = broadcast_if_small(large, n)
    members = materialise(rows.join(large, "key", "left_semi").select("cid", "n", "comp").distinct(), "members")
    whole = members.join(sets, "cid")
    each = whole.select("cid", "n", "comp", F.explode("set").alias("key"))
    counted = materialise(each.groupBy("key").agg(F.count("*").alias("often")).where(F.col("often") > FEW), "counted")
    n = counted.count()
    if n <= small:
        table = counted.toArrow().sort_by("key")
        told = rows.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["often"].to_numpy()))
        split = whole.select("cid", "n", "comp", "set").mapInArrow(_rarest(percent, told), "key long, cid long, n long, comp long")
    else:
        ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key")))
        taken = F.size("o") - F.floor((percent * F.size("o") + 99) / 100).cast("int") + 1
        split = each.join(counted, "key", "left").groupBy("cid", "n", "comp").agg(ordered.alias("o"))
        split = split.select(F.explode(F.slice("o", F.lit(1), taken)["key"]).alias("key"), "cid", "n", "comp")
    return rows.join(large, "key", "left_anti").unionByName(split)


def open_bands(rows: DataFrame) -> DataFrame:
    """key, rows, shingles of the bands of rows(key, cid, n, comp) that hold several components."""
    per = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    return per.where(F.col("lo") != F.col("hi")).select("key", "rows", "shingles")


def blocked(rows: DataFrame, block: int, shingles_a_block: int) -> DataFrame:
    """rows(key, cid, n, comp) of open bands, each once for every block of its band that it is to meet: key, i, j, block, ..."""
    per = materialise(open_bands(rows), "open-bands")
    rows = salted_join(rows, per, ["key"], per.select("key", F.col("rows").alias("n")), ["cid"])
    blocks = F.ceil(F.greatest(F.col("rows") / block, F.col("shingles") / shingles_a_block)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.select(*_KEYS, "block", "cid", "n", "comp")


def group_documents(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    least = threshold - 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5  # five standard deviations of the estimate
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(docs.mapInArrow(_sign, "doc_id long, n_shingles long, h1 long, h2 long, registers binary"), "signatures")
    classes = materialise(
        signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("cid"), F.first("registers").alias("registers"), F.count("*").alias("copies")), "classes"
    )
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 1 + width * b, width)) for b in range(BANDS)])
    banded = classes.select("cid", "n", F.explode(keys).alias("key"))
    pivot = F.array_distinct(F.array(F.min("cid"), F.min_by("cid", F.xxhash64("cid", F.lit(11)))))
    tops = materialise(banded.groupBy("key").agg(F.count("*").alias("size"), pivot.alias("pivots")).where(F.col("size") > 1), "bands")
    shared = materialise(salted_join(banded, tops, ["key"], tops.select("key", F.col("size").alias("n")), ["cid"]), "shared-bands")

    # Step 1: each class against the pivots of its bands.
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    pairs = shared.select(F.col("cid").alias("a"), F.explode("pivots").alias("b")).where(F.col("a") != F.col("b"))
    pairs = materialise(pairs.distinct(), "pairs")
    hubs = lambda p: p.groupBy("b").agg(F.count("*").alias("n"))
    met = salted_join(pairs.join(side("a"), "a"), side("b"), ["b"], hubs(pairs), ["a"]).where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    likely = materialise(met.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_likely(least), "a long, b long"), "likely")
    wanted = materialise(shared.select("cid").distinct(), "wanted")
    sets = docs.join(broadcast_if_small(wanted, wanted.count()), F.col("doc_id") == F.col("cid")).select("doc_id", "text").mapInArrow(_sets, "cid long, set array<long>")
    sets = materialise(sets, "sets")
    set_of = lambda x: sets.select(F.col("cid").alias(x), F.col("set").alias(f"s_{x}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    verified = salted_join(likely.join(set_of("a"), "a"), set_of("b"), ["b"], hubs(likely), ["a"], rows=500)
    first = components(verified.where(100 * common >= round(100 * threshold) * (F.size("s_a") + F.size("s_b") - common)).select("a", "b"))

    forget(pairs, likely, tops, wanted)

    # Step 2: bands that hold several components, in blocks.
    labelled = shared.select("key", "cid", "n").join(first.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("m", "cid")).drop("m")
    labelled = materialise(labelled, "labelled-bands")
    still = materialise(open_bands(labelled), "still-open")
    opened = materialise(salted_join(labelled, still.select("key"), ["key"], still.select("key", F.col("rows").alias("n")), ["cid"]), "open-rows")
    parted = materialise(split_bands(opened, sets, threshold, 4 * BLOCK), "band-rows")
    rows = blocked(parted, BLOCK, BLOCK_SHINGLES)
    dealt = lambda d: d.repartition(*map(F.col, _KEYS)).sortWithinPartitions(*_KEYS, "cid")
    near = dealt(rows.join(classes.select("cid", "registers"), "cid")).mapInArrow(_with_partner(threshold, least), "key long, i int, j int, block int, cid long, n long, comp long")
    near = materialise(near, "near")
    more = dealt(near.join(sets, "cid").select(*_KEYS, "block", "cid", "n", "comp", "set")).mapInArrow(_forest(threshold), "a long, b long")
    links = materialise(more.distinct(), "links")
    forget(shared, labelled, still, opened, parted, near, sets)
    final = components(first.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(links)) if links.count() else first

    names = ["h1", "h2", "n_shingles"]
    of_class = classes.select("h1", "h2", F.col("n").alias("n_shingles"), "cid").join(final.withColumnRenamed("v", "cid"), "cid", "left").select(*names, F.coalesce("m", "cid").alias("c"))
    copies = classes.select("h1", "h2", F.col("n").alias("n_shingles"), F.col("copies").alias("n"))
    some = signed.where(F.col("n_shingles") > 0).select("doc_id", *names)
    some = salted_join(some, of_class, names, copies, ["doc_id"], "left").select("doc_id", "n_shingles", "c")
    none = signed.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    rows = some.unionByName(none).select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The rows of docs but those that belong to the component of a smaller doc_id."""
    (name,) = fresh(docs, "gone")
    gone = materialise(group_documents(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, gone.count()), F.col("doc_id") == F.col(name), "left_anti")


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(documents(spark, sf_dir))
