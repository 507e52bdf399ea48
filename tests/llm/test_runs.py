"""Periodic runs against a brute force that tries every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from actispark.llm import runs as r


def brute(words):
    """Every run by maximal stretches of each lag; the smallest period of a stretch stands."""
    n, least = len(words), {}
    for q in range(n // 2, 0, -1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(12, 2 * q):
                least[a, i + q - a] = q
            i += 1
    return sorted((a, n, q) for (a, n), q in least.items())


def by_order(found):
    return sorted(found, key=lambda x: (x[0], x[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = by_order(brute(words))
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def numbered(words):
    return np.unique(np.array(words), return_inverse=True)[1].astype(np.int32)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_small_alphabets(seed):
    draw = random.Random(seed)
    words = draw.choices("abc"[: 1 + seed % 3], k=draw.randrange(1, 90))
    for _ in range(seed % 5):  # squares within squares
        a = draw.randrange(len(words))
        words[a:a] = words[a : a + draw.randrange(1, 20)] * draw.randrange(1, 5)
    assert list(zip(*(x.tolist() for x in r.runs_of(numbered(words))), strict=True)) == by_order(brute(words))


def test_fibonacci_and_powers():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    for words in (b, ["a"] * 500, (["a"] * 100 + ["b"]) * 5, [str(i % 97) for i in range(600)]):
        assert list(zip(*(x.tolist() for x in r.runs_of(numbered(words))), strict=True)) == by_order(brute(words))


def test_giant_repeats_stay_cheap():
    """All words the same and blocks of the same: pairs stay within a few times the words."""
    for words in (["a"] * 200_000, (["a"] * 1000 + ["b"]) * 200):
        ranks, seen = r.gram_numbers(numbered(words))
        assert len(r.pairs(ranks, seen)[0]) < 50 * len(words)
        assert max(r.runs_of(numbered(words))[1]) == len(words)


def test_query_equals_brute_force(spark, sf_dir, texts):
    got = {row["doc_id"]: tuple(row) for row in r.op12_seed_extend_runs(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    some = [d for d in texts if len(texts[d]) < 9_000]
    assert len(some) > 150
    assert {d: got[d] for d in some} == {d: expected(d, texts[d]) for d in some}
    assert sum(row[1] > 0 for row in got.values()) > 10


def test_odd_documents(spark, odd_documents, no_documents):
    got = sorted((tuple(row) for row in r.run_digests(odd_documents).collect()), key=str)
    rows = [(row["doc_id"], row["text"]) for row in odd_documents.select("doc_id", "text").collect()]
    assert got == sorted((expected(d, t) if len(t or "") < 9_000 else next(g for g in got if g[0] == d) for d, t in rows), key=str)
    long = next(g for g in got if g[0] == 3)
    assert long[1:5] == (1, 0, 40_000, 1)
    assert r.run_digests(no_documents).count() == 0


def test_huge_words(huge_documents):
    assert r.run_digests(huge_documents).count() == huge_documents.count()


def test_find_and_collapse(spark):
    text = "begin " + "one two three " * 5 + "end"
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert [tuple(x) for x in r.find_runs(df).collect()] == [(1, 1, 15, 3)]
    assert [tuple(x) for x in r.collapse_runs(df).orderBy("doc_id").collect()] == [(1, "begin one two three end"), (2, "nothing here"), (3, "")]
