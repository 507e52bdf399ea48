"""Bytes that stood before, against a brute force over all strings of 50 bytes."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from actispark.llm import repeats as r

SCHEMA = "doc_id long, text string"


def brute(rows):
    least = {}
    for d, text in rows:
        b = (text or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                k = b[i : i + 50]
                least[k] = min(least.get(k, d), d)
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(seed):
    """Passages copied whole and in part, with edits, repeats of one anchor, short alphabets and hot passages."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé", k=draw.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(draw.randrange(8, 60))) for _ in range(12)] + ["a" * 300, "ab" * 100, "é" * 60]
    rows = []
    for d in range(70):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            parts.append(draw.choice([p, p, p[a:], p[:a], p[:a] + "X" + p[a:], " ".join(word() for _ in range(20))]))
        rows.append((draw.choice([d, d, d, d // 2, None]), draw.choice(["", " "]).join(parts)))
    return [*rows, (900, None), (901, ""), (902, "short"), (903, "x" * 50), (904, "x" * 50), (904, "x" * 51)]


@pytest.mark.parametrize(("seed", "pieces", "split"), [(0, r.PIECES, r.HOT), (1, 40, r.HOT), (2, 40, 2), (3, 1000, 0)])
def test_equals_brute_force(spark, seed, pieces, split):
    """In one bucket and in many, with all anchors compared, some, and all split into strings."""
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(r.repeat_digests(df, pieces=pieces, split=split)) == brute(rows)


def test_query_equals_brute_force(spark, sf_dir, texts):
    assert found(r.op13_run_length_index(spark, sf_dir)) == brute(sorted(texts.items()))


@pytest.mark.parametrize("seed", range(25))
def test_index_equals_brute_force(seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices("ab" if seed % 2 else "abcd", k=draw.randrange(50, 112))) for _ in range(6)]
    for _ in range(14):
        x = draw.choice(texts)
        a, e = draw.randrange(len(x)), draw.randrange(len(x))
        texts.append((x[:e] + draw.choice("abc") + x[e + 1 :])[a:] + "".join(draw.choices("ab", k=112)))
    texts = [x[: max(50, draw.randrange(112))].encode() for x in texts]
    owner = np.array([draw.randrange(9) for _ in texts])
    mask = r.RunIndex(texts[:14], owner[:14]).earlier(texts[5:], owner[5:])
    for x, mine, got in zip(texts[5:], owner[5:], mask.tolist(), strict=True):
        expected = sum(1 << i for i in range(len(x) - 49) if any(x[i : i + 50] in y and o < mine for y, o in zip(texts[:14], owner[:14], strict=True)))
        assert got == expected


def test_index_is_run_compressed():
    x = "".join(random.Random(1).choices("abcdefgh", k=100))
    copies = [(x[: k % 50] + "Z" + x[k % 50 + 1 :]).encode() for k in range(500)]
    assert len(r.RunIndex(copies, np.arange(500)).start) < 0.2 * 500 * 100


def test_odd_documents(spark, odd_documents, no_documents):
    got = found(r.repeat_digests(odd_documents))
    assert len(got) == odd_documents.count()
    assert all(n == 0 for _, _, n, _, _ in got)
    assert r.repeat_digests(no_documents).count() == 0


def test_huge_documents(spark, huge_documents):
    df = huge_documents.union(huge_documents.withColumn("doc_id", huge_documents["doc_id"] + 100))
    got = {d: (n, gone, spans) for d, n, gone, spans, _ in found(r.repeat_digests(df))}
    assert all(got[d][1] == 0 for d in got if d < 7)
    assert all(got[d][0] == got[d][1] for d in got if d >= 100 and got[d][0] >= 50)


def test_rest(spark):
    x = "".join(random.Random(3).choices("abc", k=80))
    got = r.remove_repeats(spark.createDataFrame([(1, x), (2, "pre" + x + "post")], SCHEMA)).orderBy("doc_id").collect()
    assert [bytes(g["rest"]) for g in got] == [x.encode(), b"prepost"]


def test_pieces_hold_each_string_once_and_names_tell_them_apart():
    texts = [(x or "").encode() for _, x in made(5)]
    edges = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    p = r.Pieces(np.frombuffer(b"".join(texts), np.uint8), edges)
    seen, named = {}, {}
    for place, strings, doc, anchor, name in zip(p.place - edges[p.doc], p.strings, p.doc, p.anchor, p.name, strict=True):
        assert place == seen.get(doc, 0) and strings <= r.MOST
        seen[doc] = place + strings
        piece = texts[doc][place : place + strings + r.LENGTH - 1]
        assert named.setdefault((anchor, name), piece) == piece
    assert seen == {d: len(x) - r.LENGTH + 1 for d, x in enumerate(texts) if len(x) >= r.LENGTH}
    assert len(set(named.values())) == len(named)  # and one piece has one name


def test_names_of_pieces_left_out_are_not_made(monkeypatch):
    text = np.frombuffer("".join(random.Random(6).choices("abcdef ", k=20_000)).encode(), np.uint8)
    every, some = (r.Pieces(text, np.array([0, len(text)])) for _ in range(2))
    few = np.arange(len(every.place)) % 100 == 0
    asked, parts = [], r.Pieces.parts
    monkeypatch.setattr(r.Pieces, "parts", lambda p, at: asked.append(len(at)) or parts(p, at))
    some.keep(few)
    assert (some.name == every.name[few]).all()
    assert asked[:4] == [few.sum()] * 4


def test_hashes_stay_in_a_cores_cache():
    """Arrays of some MB each, made anew for every slice, took more than half of the time of a scan."""
    text = "".join(random.Random(7).choices("abcdef ", k=5_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([text] * 400)], ["doc_id", "text"])
    r.Pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    tracemalloc.start()
    for _, b, edges in r.slices(batch, 1, r.SLICE):
        assert len(r.Pieces(b, edges).name)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_small_batches_go_together():
    some = [pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64())], ["x"]) for k in (0, 5, r.ROWS, 3, 0, 9)]
    assert [b.num_rows for b in r.together(iter(some))] == [r.ROWS + 5, 12]
    assert [x for b in r.together(iter(some)) for x in b.column(0).to_pylist()] == [x for b in some for x in b.column(0).to_pylist()]
    assert not list(r.together(iter(some[:1])))


def test_equals_brute_force_where_strings_are_dealt(spark):
    rows = made(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(r.repeat_digests(df, split=0, dealt=2)) == brute(rows)


def test_a_string_of_many_pieces_is_no_single_task(spark):
    rows = [(1, k, k, 0, b"x" * r.LENGTH) for k in range(400)] + [(2, k, k, 3, b"%050d" % k) for k in range(9)]
    strings = spark.createDataFrame(rows, "anchor long, name long, first long, at int, string binary")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        common = r._common_strings(strings)
        assert [(c["anchor"], c["earliest"], c["n"]) for c in common.collect()] == [(1, 0, 400)]
        late = r._late_strings(strings, common, 20).selectExpr("first", "spark_partition_id() as task").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(x["first"] for x in late) == list(range(1, 400))
    assert max(sum(x["task"] == k for x in late) for k in range(16)) < 200
