"""BPE against the tokenizers library; packing."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from actispark.llm import bpe, packing

PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, encoder, text):
    words = encoder.encode([text])[0]
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(words), "<u4").tolist() == ids
    assert encoder.decode_words(words).decode() == library.decode(ids, skip_special_tokens=False)


EDGES = ["", " ", "Hello,  wörld's <|endoftext|>x 12é İ 'S", "a<|startoftext|>b", "x́ ́a é", "ΣΑΣ ςΣ", "a\x85b\x1cc d", "aaaaaaa aaaa'll don't I'VE", "ﬁ K Å ŉ 漢字 テスト 🎉🎉🎉 ½²", "<|ENDOFTEXT|> <|", "\x00\x01", "ß" * 50, "ab" * 3000, "a" * 20_001]


@pytest.mark.parametrize("text", EDGES)
def test_edges(library, text):
    same(library, bpe.Encoder(PATH), text)


def test_random_texts(library):
    rng, e = random.Random(2), bpe.Encoder(PATH, cache=500)  # a small cache turns over often
    for _ in range(1500):
        same(library, e, "".join(rng.choice("abcé'sßΣİ1½ \n\t\x1c🎉<|>.,!漢字ʰ́") for _ in range(rng.randrange(60))))


def test_batches_over_cache(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef ") for _ in range(200)) for _ in range(50)]
    e = bpe.Encoder(PATH, cache=100)
    for _ in range(3):
        for t, w in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(b"".join(w), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_query(spark, sf_dir, texts, library):
    for r in bpe.op10_bpe_rounds(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packed(rows, capacity=4096):
    of = collections.defaultdict(list)
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_packing_query(spark, sf_dir, texts, library):
    rows = packing.op5_vector_best_fit(spark, sf_dir).collect()
    of = collections.defaultdict(dict)
    for r in rows:
        of[r["doc_id"]][r["piece"]] = r
    assert set(of) == set(texts)
    for doc, pieces in of.items():
        ids = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        cut = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        assert [(pieces[k]["start"], pieces[k]["length"], pieces[k]["ids_crc32"]) for k in range(len(cut))] == [(4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]
        assert len(pieces) == len(cut)
    assert check_packed(rows) <= -(-sum(r["length"] for r in rows) // 4096) + 3


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 500, 2000)
    bins = packing.best_fit(lengths, (1000, 7, 300_000), score=score)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 7 and (own**2).sum() <= 300_000


def slow_best_fit(lengths, capacity, weights, score):
    """One open sequence after another, in plain numbers."""
    order, left, bins = sorted(range(len(lengths)), key=lambda i: -lengths[i]), [], [0] * len(lengths)
    for i in order:
        item = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, r in enumerate(left):
            if all(x <= y for x, y in zip(item, r, strict=True)):
                if score == "norm":
                    v = sum(w * ((y - x) / c) ** 2 for w, x, y, c in zip(weights, item, r, capacity, strict=True))
                else:
                    v = -sum(w * x / c * y / c for w, x, y, c in zip(weights, item, r, capacity, strict=True))
                if best is None or v < best[0] - 1e-15:
                    best = (v, b)
        if best is None:
            left.append(list(capacity))
            best = (0, len(left) - 1)
        left[best[1]] = [y - x for x, y in zip(item, left[best[1]], strict=True)]
        bins[i] = best[1]
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(1000, 1000, 10**6), (1000, 6, 10**6), (1000, 1000, 250_000)])
def test_packing_equals_brute_force(score, capacity):
    """The number of sequences, with and without capacities that bind; where only tokens bind, as scalar best fit packs."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 480, 400)
    weights = (1.0, 0.02, 0.02)
    bins = packing.best_fit(lengths, capacity, weights, score)
    slow = slow_best_fit(lengths.tolist(), capacity, weights, score)
    assert len(set(bins.tolist())) <= len(set(slow)) + 1
    if capacity == (1000, 1000, 10**6):
        assert len(set(bins.tolist())) <= -(-lengths.sum() // 1000) + 2
        scalar = packing.best_fit(lengths, capacity, (1.0, 0.0, 0.0), score)
        assert (bins != scalar).any()  # the other dimensions choose among sequences that fit
    else:
        assert len(set(bins.tolist())) > -(-lengths.sum() // 1000)  # these bind


def test_open_sequences_of_groups_are_packed_again(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 0, int(n)) for i, n in enumerate(rng.integers(200, 900, 2000))]
    pieces = spark.createDataFrame(rows, "row_id long, piece int, length long")
    got = packing.pack(pieces, len(rows), (4096, 4096, 4096**2), group=100).collect()
    assert sorted((r["row_id"], r["length"]) for r in got) == [(i, n) for i, _, n in rows]
    assert check_packed(got) <= -(-sum(n for _, _, n in rows) // 4096) + 6  # 20 groups would leave up to 20


def test_huge_texts(huge_documents, library):
    rows = packing.pack_documents(huge_documents).collect()
    check_packed(rows)
    of = collections.Counter()
    for r in rows:
        of[r["doc_id"]] += r["length"]
    for r in bpe.round_trips(huge_documents).collect():
        assert of[r["doc_id"]] == r["n_tokens"] + 1


def test_odd_packing(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents).collect()
    check_packed(rows)
    assert sum(r["length"] == 1 for r in rows) == 3
    assert packing.pack_documents(no_documents).count() == 0
    assert len(bpe.round_trips(odd_documents).collect()) == 10 and bpe.round_trips(no_documents).count() == 0
