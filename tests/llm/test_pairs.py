"""Nearest neighbours and near-duplicates against brute force."""

import collections
import random

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from actispark.llm import ann, neardup
from actispark.llm.common import salted_join


def test_nearest_equals_sql(spark, sf_dir):
    assert_same(ann.op6_block_matrix_join(spark, sf_dir), ann.SQL, sf_dir)


def test_nearest_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # equal ones
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] + [1.0] * 7), (None, [1.0] * 8), (2005, [1.0] * 3), (2100, [2.0] * 3), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("dim", F.lit(0))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, candidate_block=64, query_block=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v in rows if i is not None and i not in (2000, 2001, 2002, 2003, 2004, 2006)}
    for q in (i for i in good if i % 100 == 0):
        near = sorted((float(ann.exact(good[q][None], v[None])[0]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        assert got[q] == [(i, s) for s, i in near[:10]]
    assert set(got) == {i for i in good if i % 100 == 0}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_a_vector_shared_by_many_rows(spark):
    """Equal vectors, some under one id: the survivors of the tiles don't grow with their number, and the answers are right."""
    rng = np.random.default_rng(1)
    hot, rows = [1.0, 2.0, 3.0, 4.0], [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 200)]
    rows += [(1000 + i, hot) for i in range(2000)] + [(1000, hot)] * 30 + [(500, [1.0, 2.0, 3.0, 4.5])] * 15
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, candidate_block=128, query_block=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    of = dict(rows)
    for q in {i for i, _ in rows if i % 100 == 0}:
        near = sorted((float(ann.exact(np.array(of[q])[None], np.array(v)[None])[0]), i) for i, v in rows if i != q)
        assert got[q] == near[:10], q


@pytest.mark.parametrize("centres", [1, 5])
def test_dense_clusters(spark, centres):
    """Thousands of vectors within a thousandth of a point, or of five: few of them survive, and the nearest are right."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(centres, 24))
    x = middle[np.arange(4096) % centres] + rng.normal(size=(4096, 24)) * 2e-4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    coded = df.mapInArrow(ann._quantised(ann._centres(df)), ann._CODED).withColumn("mark", F.lit(0)).toPandas()
    survivors = sum(len(t) for t in ann.tile(coded[coded["vec_id"] % 100 == 0], coded, 10))
    assert survivors < 100 * 41
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, candidate_block=1024).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, 4096, 100):
        d = ann.exact(np.repeat(x[q][None], 4096, 0), x)
        assert got[q] == [i for i in np.lexsort((np.arange(4096), d)) if i != q][:10]


def test_units_of_a_query_are_merged(spark, monkeypatch):
    monkeypatch.setattr(ann, "UNIT", 3)
    monkeypatch.setattr(ann, "GROUP", 20)
    test_nearest_with_ties_and_odd_vectors(spark)


def test_quantisation_bounds():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(20, 33)), rng.normal(size=(30, 33)) * 5
    (ca, sa, ea), (cb, sb, eb) = ann.quantise(a), ann.quantise(b)
    assert (ann.products(ca, cb) == ca.astype(int) @ cb.astype(int).T).all()
    d = np.linalg.norm((ca * sa[:, None])[:, None] - cb * sb[:, None], axis=2)
    true = np.linalg.norm(a[:, None] - b, axis=2)
    assert (np.abs(d - true) <= ea[:, None] + eb + 1e-12).all()


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts, percent=85):
    ids = sorted(texts)
    sets, root = {i: shingle_set(texts[i]) for i in ids}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_of_driver_documents(spark, sf_dir, texts):
    expected = brute_components(texts)
    for r in neardup.op7_hyperminhash(spark, sf_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_groups_of_near_copies(spark):
    """Families of copies with some words changed, many pairs close to the threshold, in one large family."""
    rng = random.Random(4)
    texts = {}
    for family in range(4):
        base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
        for _ in range(120 if family == 0 else 15):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
            texts[len(texts)] = " ".join(t)
    texts |= {500: "only three words", 501: "Only  THREE\nwords", 502: "only three wordz", 503: "", 504: " \n"}
    expected = brute_components(texts)
    assert len({c for _, c in expected.values()}) > 10
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.group_documents(df).collect()}
    assert got == expected


def test_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    texts = {}
    for i in range(60):
        t = list(base)
        for _ in range(1 + i % 3):
            t[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(t)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = {r["doc_id"]: r["component_id"] for r in neardup.group_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()}


def test_split_bands_find_the_same(spark, monkeypatch):
    """Many texts with one long passage in common, which share bands and are not similar, and near copies among them."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        own = [f"o{i}x{k}" for k in range(80)]
        texts[i] = " ".join(passage + own)
        if i % 9 == 0:
            own[rng.randrange(80)] = "changed"
            texts[1000 + i] = " ".join(passage + own)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.group_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()} and sum(i != c for i, c in got.items()) == 10


def test_rows_of_a_large_band_grow_in_proportion(spark):
    """One band with ever more members that share a passage, and some further shingles with some fifty others each."""

    def rows_made(n):
        ids = spark.range(n).select(F.col("id").alias("cid"))
        rows = ids.select(F.lit(1).cast("long").alias("key"), "cid", F.lit(100).cast("long").alias("n"), F.col("cid").alias("comp"))
        passage = F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.xxhash64(i))
        own = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.xxhash64(i, F.when(i <= 20, F.pmod(F.xxhash64(i, "cid"), F.lit(n // 50))).otherwise(F.col("cid") + n)))
        sets = ids.select("cid", F.concat(passage, own).alias("set"))
        return neardup.blocked(neardup.split_bands(rows, sets, 0.85, 256), 64, 10**6).count()

    small, large = rows_made(4_000), rows_made(16_000)
    assert large < 4.5 * small and large < 16_000 * 16_000 / 64


def test_split_bands_lose_nothing(spark):
    """Whatever is similar shares a group, with counts told to all tasks and with counts joined, which give the same rows."""
    rng = random.Random(12)
    common = [rng.randrange(-(2**62), 2**62) for _ in range(60)]
    sets = {}
    for i in range(160):
        own = [rng.randrange(-(2**62), 2**62) for _ in range(rng.randrange(30))]
        sets[i] = set(common[: rng.randrange(40, 61)] + own)
        sets[1000 + i] = set(rng.sample(sorted(sets[i]), len(sets[i]) - rng.randrange(9)))
    sets |= {3000: {5}, 3001: {5, 6}}
    rows = spark.createDataFrame([(k, i, len(s), i) for i, s in sets.items() for k in (1, 2)], "key long, cid long, n long, comp long")
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "cid long, set array<long>")
    for threshold in (0.8, 0.85):
        told, joined = (sorted((r["key"], r["cid"], r["n"], r["comp"]) for r in neardup.split_bands(rows, df, threshold, 50, small).collect()) for small in (10**6, 0))
        assert told == joined and len(told) == len(set(told))
        groups = collections.defaultdict(set)
        for key, cid, *_ in told:
            groups[cid].add(key)
        similar = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= round(100 * threshold) * len(sets[a] | sets[b])]
        assert len(similar) > 150 and all(groups[a] & groups[b] for a, b in similar)
    assert neardup.split_bands(rows, df, 0.85, 1000).count() == rows.count()


def test_hot_keys_are_dealt_and_joins_stay_whole(spark):
    left = spark.range(5_000).select(F.when(F.col("id") < 4_000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(4_990).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = salted_join(left, right, ["k"], counts, ["v"], how, rows=100)
        assert got.count() == left.join(right, ["k"], how).count() and got.exceptAll(left.join(right, ["k"], how)).count() == 0


def test_huge_texts_and_copies(spark, huge_documents):
    got = {r["doc_id"]: r for r in neardup.group_documents(huge_documents).collect()}
    expected = brute_components({r["doc_id"]: r["text"] for r in huge_documents.collect()})
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
    copies = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3_000, "one text of six equal words").when(F.col("id") < 5_000, "").otherwise(F.concat_ws(" ", *[F.concat(F.lit(c), "id") for c in "abcdef"])).alias("text"))
    rows = neardup.group_documents(copies).collect()
    assert all(r["component_id"] == (0 if r["doc_id"] < 3_000 else r["doc_id"]) for r in rows) and len(rows) == 6_000


def test_estimate_is_corrected():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.85):
        x = rng.integers(0, 2**63, 3000).astype(np.uint64)
        n = round(1000 * 2 * share / (1 + share))
        a, b = x[:1000], np.concatenate([x[:n], x[1000 : 2000 - n]])
        j = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([1000]), np.array([1000]))[0]
        assert abs(j - share) < 0.13


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (202, 201), (300, 300)]
    got = {r["v"]: r["m"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 51), 100]}, 201: 200, 202: 200}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(odd_documents, no_documents):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.group_documents(odd_documents).collect())
    assert ("None", 1, None, True) in got and ("9", 9, 8, False) in got and got.count(("5", 1, 5, True)) == 2 and ("1", 0, 1, True) in got
    assert neardup.group_documents(no_documents).count() == 0
    assert neardup.keep_first(odd_documents).count() == 9


@pytest.mark.parametrize("text", ["a b c d e f", "A b\tC\x0bd\x0ce\rf", "é É ü", "x"])
def test_shingles(text):
    assert len(neardup.shingles(text)) == len(shingle_set(text))
