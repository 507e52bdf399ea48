"""Byte-pair encoding and decoding in batched numpy merge rounds.

The words of a batch that are not yet known become symbols in one flat array. In each round all neighbouring pairs get
their rank by binary search over the sorted pair keys, every word's lowest pair is merged wherever it stands in the word,
and words with nothing left to merge leave the array. Known words come from a cache of bounded size, so a text costs one
look-up a word. The tokenizer file is a parameter: a BPE with word ends, lower case and dropped blanks.

Defined results: null text is empty; an empty text has no ids and decodes to an empty text; repeated rows each give a row;
a null doc_id stays null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actispark.llm.common import documents, give_back

#: Fixed values of the file's pre-tokenizer: its pattern; blanks for it are those of Unicode without the four separators.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLANKS = regex.compile(r"[^\S\x1c-\x1f]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
NONE = 1 << 30


def tokenizer_path(path: str | None = None) -> str:
    return path or public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return [chr(b) if b in plain else chr(256 + sorted(set(range(256)) - set(plain)).index(b)) for b in range(256)]


class Encoder:
    """ids and decoded texts as the tokenizer file gives them; keeps at most cache words (twice, in two generations)."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        end = spec["model"]["end_of_word_suffix"]
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [b""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t.encode()
        chars = byte_characters()
        kind = np.uint32 if self.size**2 < 2**32 else np.int64  # of symbols and of keys of pairs
        self.inner, self.last = (np.array([vocab[c + e] for c in chars], kind) for e in ("", end))
        pairs = [(vocab[a] * self.size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])]
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*sorted(pairs), strict=True), (kind, np.int64, kind), strict=True))
        self.limit, self.young, self.old = cache, {}, {}
        self.decoded: dict[bytes, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (little-endian 32-bit) of each non-empty piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sym, ends = self.inner[data], np.cumsum(lengths) - 1
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.keys.dtype.type(self.size) + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NONE)
            same = word[1:] == word[:-1]
            ok = (self.keys[at] == key) & same
            rank[:-1][ok] = self.ranks[at[ok]]
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            best_of = np.repeat(best, sizes)
            over = best_of == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = (rank == best_of) & ~over
            places = np.flatnonzero(hit)
            if len(places):  # a pair of equal symbols may overlap itself: every other one of a run is taken
                first = np.concatenate(([True], np.diff(places) != 1))
                run = places - places[first][np.cumsum(first) - 1]
                places = places[run % 2 == 0]
                sym[places] = self.merged[at[places]]
            stays = ~over
            stays[places + 1] = False
            sym, word = sym[stays], word[stays]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(pieces))))) * 4
        out, cuts = sym.astype("<u4").tobytes(), cuts.tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words into the cache."""
        if len(self.young) + len(words) > self.limit:
            self.old, self.young, self.decoded = self.young, {}, {}
        # A word of letters is one piece; another one's pieces are words too, and most are known or learned with them.
        whole, split = [], []
        for w in words:
            if w.isalpha():
                whole.append(w)
            else:
                split.append((w, (w[:-1], w[-1]) if w[:-1].isalpha() else PIECES.findall(w)))
        young, old = self.young, self.old
        new = dict.fromkeys(whole)
        for _, pieces in split:
            for p in pieces:
                if p not in young:
                    if (ids := old.get(p)) is None:
                        new[p] = None
                    else:
                        young[p] = ids
        if new:
            young.update(zip(new, self.merge([p.encode(errors="replace") for p in new]), strict=True))
        for w, pieces in split:
            young[w] = b"".join([young[p] for p in pieces])

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma has one lower form here
        text = text.lower()
        return [w for w in _BLANKS.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its words."""
        parts = []  # (text, words or a special token's ids)
        for i, t in enumerate(texts):
            if "<|" in t and self.split_special.search(t):
                parts += [(i, self.special[s].to_bytes(4, "little") if s in self.special else self.words(s)) for s in self.split_special.split(t)]
            else:
                parts.append((i, self.words(t)))
        seen: set[str] = set()
        for _, p in parts:
            if isinstance(p, list):
                seen.update(p)
        new, young, old = [], self.young, self.old
        for w in seen.difference(young):
            if (ids := old.get(w)) is not None:
                young[w] = ids
            else:
                new.append(w)
        if new:
            self.learn(new)
            if self.young is not young:  # the generations have changed: what this batch needs is still in the old one
                self.young |= {w: old_ids for w in seen if (old_ids := self.old.get(w)) is not None and w not in self.young}
        out: list[list[bytes]] = [[] for _ in texts]
        get = self.young.__getitem__
        for i, p in parts:
            if isinstance(p, list):
                out[i] += map(get, p)
            else:
                out[i].append(p)
        return out

    def text_of(self, ids: bytes) -> bytes:
        """The decoded text of ids: their tokens with a blank between (the file names no decoder)."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_words(self, words: list[bytes]) -> bytes:
        """The decoded text of a text's words, each of whose ids is decoded once."""
        known = self.decoded
        for w in {w for w in words if w not in known}:
            known[w] = self.text_of(w)
        return b" ".join(t for t in map(known.__getitem__, words) if t)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def batches_of(batch: pa.RecordBatch, column: int, most: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of some MB of text each, with their texts."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows])).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            piece = batch.slice(a, b - a)
            yield piece, [t or "" for t in piece.column(column).to_pylist()]


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = tokenizer_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for batch, texts in batches_of(whole, 1):
                n, ids_sha, text_sha = [], [], []
                for words in e.encode(texts):
                    ids = b"".join(words)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(e.decode_words(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir))
