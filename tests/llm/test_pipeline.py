"""Each stage of the pipeline against a brute-force version on the driver's small tables."""

import collections
import math
import re

import corpus_pipeline
import pytest
from test_pairs import brute_components
from test_sharding_quality import plain

from actispark.llm import secrets, toxicity
from actispark.llm.common import materialise

BLANK = "\x20\x09-\x0d"


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, documents):
    out = [documents]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), name))
    return out


def normal(line):
    return tuple(re.findall(f"[^{BLANK}]+", re.sub("[1-9]", "0", re.sub("[A-Z]+", lambda m: m[0].lower(), line))))


def brute_quality(rows):
    """doc_id -> text without frequent lines, of the documents that stay."""
    texts_of, with_line = collections.defaultdict(set), collections.defaultdict(set)
    for _, host, t in rows:
        texts_of[host].add(t)
        for line in t.split("\n"):
            if normal(line):
                with_line[host, normal(line)].add(t)
    out = {}
    for d, host, t in rows:
        frequent = [bool(normal(x)) and len(with_line[host, normal(x)]) > 1 + math.log2(1 + len(texts_of[host])) for x in t.split("\n")]
        n, rest = plain(t), sum(len(normal(x)) for x, f in zip(t.split("\n"), frequent, strict=True) if not f)
        if not (n[0] < 10 or 100 * n[4] > 20 * n[0]) and rest >= 10 and rest >= 0.3 * n[0]:
            out[d] = "\n".join(x for x, f in zip(t.split("\n"), frequent, strict=True) if not f)
    return out


def test_stages(spark, sf_dir, outputs):
    start, quality, toxic, near, secret, packed = outputs
    assert all(o.columns == start.columns for o in outputs[:-1])
    held = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outputs[:-1]]
    assert held[1] == brute_quality([(r["doc_id"], r["source"], r["text"] or "") for r in start.collect()])
    scored = toxicity.score(quality, toxicity.train(quality, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert held[2] == {r["doc_id"]: held[1][r["doc_id"]] for r in scored.collect() if not r["toxic"]} and len(held[2]) > 0.7 * len(held[1])
    components = brute_components(held[2], 80)  # stages take 0.8, only op7 takes 0.85
    assert held[3] == {d: t for d, t in held[2].items() if components[d][1] == d}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(near).collect()}
    for d, t in held[3].items():
        want, past = "", 0
        for a, z in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[d].split(",") if s):
            if a > past or not want and not past:
                want += t[past:a] + "[SECRET]"
            past = max(past, z)
        assert held[4][d] == want + t[past:]
    assert any(spans.values()) and set(held[4]) == set(held[3])
    assert {r["doc_id"] for r in packed.collect()} == set(held[4])


def test_quality_stage_cuts_lines(spark, sf_dir, documents):
    """All documents on one host, so that common lines are above its limit."""
    rows = [(r["doc_id"], "one", r["text"] or "") for r in documents.collect()]
    want = brute_quality(rows)
    one = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, one, sf_dir).collect()} == want
    of = {d: t for d, _, t in rows}
    assert sum(want[d] != of[d] for d in want) > 5


def test_run_equals_stages(spark, sf_dir, outputs):
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, outputs[-1].select("doc_id", "piece", "ids_crc32").collect()))


def test_empty(spark, sf_dir, no_documents):
    docs = no_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_odd(spark, sf_dir, odd_documents):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert docs.columns == odd_documents.columns and [r["doc_id"] for r in docs.collect()] == [8]


def test_near_duplicates_from_four_fifths(spark, sf_dir):
    """Pairs of 0.8 and more go: those under op7's 0.85 too, and the pair at exactly 0.8, but none below."""
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = []
    for k, changed in enumerate((20, 22, 24, 26, 30, 40)):  # the last words differ, so J = (196 - changed) / (196 + changed)
        a = words(f"w{k}x", 200)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[: 200 - changed] + words(f"v{k}x", changed)))]
    short = words("s", 13)  # 9 shingles each, 8 shared, 10 in all
    rows += [(100, " ".join(short)), (101, " ".join(short[:12] + ["other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    of = dict(rows)
    assert brute_components(of, 80) != brute_components(of, 85)
    assert kept == {d for d, (_, c) in brute_components(of, 80).items() if c == d}
    assert 101 not in kept and 5 in kept
