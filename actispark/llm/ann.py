"""Nearest neighbours by a block matrix join.

Vectors are quantised once, after their mean is taken off, which leaves distances as they are: int8 codes, a scale, and the
norm of what the codes miss; and twice the same again of what is missed, for tiles whose first bounds leave many pairs. Codes are dealt into blocks by a hash,
and every block of queries meets every block of candidates in one tile, by an equal join on the tile's number; so what is
repeated for each tile is a byte a component. A tile's products come from one matrix product (exact: the sums of int8
products stay below 2^24 a slab of dimensions), and each distance gets bounds from the two quantisation errors. A pair
survives its tile if its lower bound is within the tile's k-th least upper bound of the query, and then all tiles' if it is
within the k-th least of all. Only survivors meet their original vectors: their distances are computed again in double
precision, and heaps keep the k nearest: one for each query and bounded part of its survivors, whose few rows are then merged.
Nothing is approximate in the result: bounds only leave out what cannot
be among the k nearest.

Equal vectors are told by a 128-bit digest, and of each group of them only the 2k rows with the smallest ids are candidates:
ties go to the smaller id, so no others can be among anybody's k nearest. So a vector that a third of all rows share makes
no more survivors than 2k others.

Defined results: null ids, and null, empty or zero vectors or ones with null or non-finite components take no part; only
vectors of equal length are compared; ties go to the smaller id; rows that repeat an id are one item: the one with the
smallest digest asks, none of them is a neighbour of that id, and each is a candidate of others; further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actispark.llm.common import broadcast_if_small, forget, give_back, materialise

LEVELS = 3  # of codes: each stands for what those before it miss
_CODED = "vec_id long, embedding array<double>, digest string, dim int, " + ", ".join(f"codes{i} binary, scale{i} double, miss{i} double, norm{i} double" for i in range(LEVELS))
#: Pairs of a unit and of a group whose distances are computed again together.
UNIT, GROUP = 2_000, 20_000
_PAIR = {"query_id": "int64", "vec_id": "int64", "mark": "int64", "lower": "float64", "upper": "float64"}


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of what the codes miss."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1  # subnormal vectors
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: float32 holds the sums of 1024 of them."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows, summed in the order of the components."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        d = q[:, i] - c[:, i]
        total += d * d
    return np.sqrt(total)


def _centres(usable: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each number of components: distances don't change when it is taken off, and codes of what is left
    tell apart vectors that lie close together far from the origin."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for v in b.column(0):
                x = np.array(v.as_py())
                n, s = total.setdefault(len(x), [0, np.zeros(len(x))])
                total[len(x)] = [n + 1, s + x]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([*total], [n for n, _ in total.values()], [s.tolist() for _, s in total.values()]), kinds, strict=True)], ["dim", "n", "sum"])

    found: dict[int, list] = {}
    for r in usable.select("embedding").mapInArrow(sums, "dim int, n long, sum array<double>").toLocalIterator():  # a row a task and length
        n, s = found.setdefault(r["dim"], [0, np.zeros(r["dim"])])
        found[r["dim"]] = [n + r["n"], s + np.array(r["sum"])]
    with np.errstate(over="ignore", invalid="ignore"):
        return {d: c if np.isfinite(c := s / n).all() else np.zeros(d) for d, (n, s) in found.items()}


def _quantised(centres: dict[int, np.ndarray]):
    """Codes of what lies between a vector and its centre, and codes of what they miss, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out: list[list] = [[] for _ in range(2 + 4 * LEVELS)]
                for v in b.column(1):
                    x = np.array(v.as_py())
                    row = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest(), len(x)]
                    lost = np.linalg.norm(x) * 1e-15  # by taking off the centre
                    rest, level = (x - centres[len(x)])[None], np.zeros(len(x))
                    for _ in range(LEVELS):
                        codes, scale, miss = quantise(rest)
                        level = level + codes[0] * scale[0]
                        rest = rest - codes * scale[:, None]
                        row += [codes.tobytes(), float(scale[0]), float(miss[0] + lost), float(level @ level)]
                    for col, value in zip(out, row, strict=True):
                        col.append(value)
                kinds = (pa.string(), pa.int32(), *[pa.binary(), pa.float64(), pa.float64(), pa.float64()] * LEVELS)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [c.split()[0] for c in _CODED.split(", ")])
        give_back()

    return run


def tile(q: pd.DataFrame, c: pd.DataFrame, k: int, levels: int = LEVELS, rows: int = 128) -> Iterator[pd.DataFrame | None]:
    """Pairs of a block of queries and one of candidates that may be among a query's k nearest, with bounds of their distance.
    Where the bounds leave many, as in a dense cluster, the products of further codes narrow them; None for queries whose
    bounds leave many though the levels end."""
    matrix = lambda d, level: np.frombuffer(b"".join(d[f"codes{level}"]), np.int8).reshape(len(d), -1)
    column = lambda d, name: d[name].to_numpy(float)
    c_ids, marks, c_first = c["vec_id"].to_numpy(), c["mark"].to_numpy(), matrix(c, 0)
    for at in range(0, len(q), rows):
        part = q.iloc[at : at + rows]
        own, product = part["vec_id"].to_numpy()[:, None] == c_ids, np.zeros((len(part), len(c)))
        for level in range(levels):
            for i, j in ((i, j) for i in range(level + 1) for j in range(level + 1) if level in (i, j)):
                product += products(matrix(part, i), matrix(c, j) if j else c_first) * column(part, f"scale{i}")[:, None] * column(c, f"scale{j}")
            norm = column(part, f"norm{level}")[:, None] + column(c, f"norm{level}")
            d = np.sqrt(np.maximum(norm - 2 * product, 0))
            off = (column(part, f"miss{level}")[:, None] + column(c, f"miss{level}")) * (1 + 1e-9) + 1e-6 * np.sqrt(norm)
            upper = np.where(own, np.inf, d + off)
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(c) >= k else np.full(len(part), np.inf)
            near = (d - off <= limit[:, None]) & ~own
            if near.sum() <= 4 * k * len(part):
                break
        if levels < LEVELS and near.sum() > 4 * k * len(part):
            yield None
            continue
        i, j = np.nonzero(near)
        yield pd.DataFrame({"query_id": part["vec_id"].to_numpy()[i], "vec_id": c_ids[j], "mark": marks[j], "lower": (d - off)[i, j], "upper": upper[i, j]})


def _merged(k: int):
    """For the units of a group (a query with some of its candidates), the k nearest: a heap a unit, worst on top."""

    def run(key: tuple, pairs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        vectors = dict(zip(queries["asks"], queries["vector"], strict=True))
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for at in range(0, len(pairs), 5_000):
            part = pairs.iloc[at : at + 5_000]
            for dim in part["dim"].unique():
                own = part[part["dim"] == dim]
                scores = exact(np.stack([vectors[i] for i in own["query_id"]]), np.stack(own["embedding"].to_list()))
                for i, u, s, v in zip(own["query_id"].tolist(), own["unit"].tolist(), scores.tolist(), own["vec_id"].tolist(), strict=True):
                    heap = heaps.setdefault((i, u), [])
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-s, -v))
        out = [(i, -v, -s) for (i, _), heap in heaps.items() for s, v in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, queries_where: Column, k: int = 10, candidate_block: int = 4096, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of vectors(vec_id, embedding) for the rows where queries_where (a
    condition on vec_id) holds."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    coded = materialise(usable.mapInArrow(_quantised(_centres(usable)), _CODED).withColumn("mark", F.xxhash64("digest")), "codes")  # a row's name beside its id
    place = lambda name, keys, order, most, df: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most).drop(name)
    # Rows that repeat id and vector are candidates each, but k of them fill an answer; so k of other ids and k of the own one.
    candidates = place("n", ["digest"], ["vec_id"], 2 * k, place("n", ["digest", "vec_id"], ["scale0"], k, coded.drop("embedding")))
    candidates = materialise(candidates, "candidates")
    queries = materialise(place("n", ["vec_id"], ["digest"], 1, coded.where(queries_where).drop("embedding")), "queries")
    c_blocks, q_blocks = max(1, -(-candidates.count() // candidate_block)), max(1, -(-queries.count() // query_block))
    of = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    keys, further = ["dim", "c_block", "q_block"], [f"{c}{i}" for i in range(1, LEVELS) for c in ("codes", "scale", "miss", "norm")]
    c = candidates.drop("digest").select("*", of(c_blocks, 0).alias("c_block"), each(q_blocks).alias("q_block"))
    q = queries.drop("digest").select("*", each(c_blocks).alias("c_block"), of(q_blocks, 1).alias("q_block"))

    def run(levels: int):
        def tiles(key: tuple, cand: pd.DataFrame, quer: pd.DataFrame) -> pd.DataFrame:
            found = list(tile(quer, cand, k, levels)) if len(cand) and len(quer) else []
            if any(f is None for f in found):  # a row that names the tile
                return pd.DataFrame({n: [0] for n in _PAIR} | dict(zip(keys, ([v] for v in key), strict=True)) | {"dense": [True]})
            pairs = pd.concat(found, ignore_index=True) if found else pd.DataFrame({n: pd.Series(dtype=t) for n, t in _PAIR.items()})
            return pairs.assign(**dict(zip(keys, key, strict=True)), dense=False)

        return tiles

    def met_in_tiles(c: DataFrame, q: DataFrame, levels: int) -> DataFrame:
        schema = "query_id long, vec_id long, mark long, lower double, upper double, dim int, c_block int, q_block int, dense boolean"
        return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run(levels), schema)

    # Only first codes go to all tiles; the few tiles that they leave dense are met again with the others.
    met = [materialise(met_in_tiles(c.drop(*further), q.drop(*further), 1), "tiles")]
    dense = met[0].where("dense").select(*keys)
    if not dense.isEmpty():
        met.append(materialise(met_in_tiles(c.join(dense, keys, "left_semi"), q.join(dense, keys, "left_semi"), LEVELS), "tiles"))
    tiles = reduce(DataFrame.unionByName, met).where("not dense").drop(*keys, "dense")
    kth = tiles.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("upper"))).where(F.col("n") == k).select("query_id", F.col("upper").alias("most"))
    pairs = tiles.join(kth, "query_id", "left").where(F.col("most").isNull() | (F.col("lower") <= F.col("most"))).select("query_id", "vec_id", "mark")
    pairs = materialise(pairs, "survivors")
    # Survivors meet the vectors: the candidates' by id and digest (equal rows once), then the queries' in groups.
    wanted = materialise(pairs.select("vec_id", "mark").unionByName(queries.select("vec_id", "mark")).distinct(), "wanted")
    named = coded.select("vec_id", "mark", "dim", "embedding").join(broadcast_if_small(wanted, wanted.count()), ["vec_id", "mark"], "left_semi")
    named = materialise(named.dropDuplicates(["vec_id", "mark"]), "survivors-vectors")
    forget(candidates, coded, wanted, *met)
    # A unit is a query with at most some UNIT of its candidates; groups are units of some GROUP pairs together.
    asks = pairs.groupBy("query_id").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"), F.count("*").alias("n"))
    groups = max(1, -(-pairs.count() // GROUP))
    group = F.pmod(F.xxhash64("query_id", "unit"), F.lit(groups)).cast("int").alias("group")
    units = asks.select("query_id", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"))
    asked = queries.select("vec_id", "mark").join(named, ["vec_id", "mark"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(units, "query_id").select(group, F.col("query_id").alias("asks"), "vector")
    at = pairs.join(asks, "query_id").withColumn("unit", F.pmod(F.xxhash64("vec_id", "mark"), F.col("units")).cast("int")).join(named, ["vec_id", "mark"])
    best = at.select(group, "query_id", "unit", "vec_id", "dim", "embedding").groupBy("group").cogroup(asked.groupBy("group")).applyInPandas(_merged(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # k rows a unit
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
