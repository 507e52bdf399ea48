"""Language by a linear-chain conditional random field over the words of code-switched text.

Words get emission scores from hashed features - prefixes, suffixes, character bigrams and trigrams, and membership in the
languages' lexicons - and transitions between languages are learned with them. Training sequences are stitched from pieces
of documents of several languages, so switches occur; gradients come from forward-backward. A text is one chain, however
long: its words are computed in windows of ``WINDOW``, and the windows' transfer matrices carry the messages over their
borders, so the posteriors are those of the whole text. Its languages are weighed by the words' posteriors.

A word is a run of letters. Longer ones than ``LETTERS`` (scripts without blanks) are cut into consecutive pieces with a
mark at the cuts, so every letter's n-grams count and affixes come from the outer pieces.

The field is fitted on at most ``sample`` documents and ``sample_bytes`` of text a language (a documented bound; documents
in the order of a hash, whole ones only). All texts are then labelled whole, in one pass without a shuffle; a word's scores
are computed once and kept in a cache of bounded size.

Defined results: null texts and texts without letters are ``und`` with score 0; without any labelled text to learn from
so is everything; a null doc_id counts as an empty one for the fold; repeated rows each give a row; further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actispark.llm.common import documents, give_back

WINDOW = 64
SIZE = 1 << 14  # places of hashed features; a place for each set of languages that share a lexicon word follows, then zeros
LETTERS = 24
CUT = "-"  # stands where a long run of letters is cut
_WORD = re.compile(r"[^\W\d_]+")


def _pieces(run: str) -> list[str]:
    """A run of letters, cut into pieces of at most LETTERS characters with a mark on each side of a cut."""
    if len(run) <= LETTERS:
        return [run]
    inner = LETTERS - 2
    parts = [run[i : i + inner] for i in range(0, len(run), inner)]
    return [(CUT if i else "") + p + (CUT if i < len(parts) - 1 else "") for i, p in enumerate(parts)]


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters (and of letters only: the pattern passes numerals such as \u2167 and \u00bd)."""
    out: list[str] = []
    for w in _WORD.findall(text.lower()) if text else ():
        if w.isalpha():
            out += (w,) if len(w) <= LETTERS else _pieces(w)
        else:
            for run in "".join(c if c.isalpha() else " " for c in w).split():
                out += _pieces(run)
    return out


def features(words: list[str], lexicon: dict[str, int], zero: int) -> np.ndarray:
    """Places of each word's features in the weights, padded with zero (a row of zeros). lexicon gives the place of the set
    of languages in whose lexicons a word is."""
    width = LETTERS + 2
    c = np.zeros((len(words), width), np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    c[:, 1 : LETTERS + 1] = np.array(words, f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS)
    c[:, 0] = 1
    c[np.arange(len(words)), n + 1] = 2
    tail = np.array([w[-3:][::-1] for w in words], "U3").view(np.uint32).reshape(len(words), 3).astype(np.uint64)
    at = np.arange(width)

    def hashed(parts: list[np.ndarray], kind: int) -> np.ndarray:
        h = np.full(parts[0].shape, kind, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(SIZE)).astype(np.int64)

    bi = np.where(at[None, :-1] <= n[:, None], hashed([c[:, :-1], c[:, 1:]], 1), zero)
    tri = np.where(at[None, :-2] < n[:, None], hashed([c[:, :-2], c[:, 1:-1], c[:, 2:]], 2), zero)
    affix = [np.where(n >= k, hashed([c[:, i] for i in range(1, k + 1)], 2 + k), zero) for k in (1, 2, 3)]
    affix += [np.where(n >= k, hashed([tail[:, i] for i in range(k)], 5 + k), zero) for k in (1, 2, 3)]
    known = np.fromiter((lexicon.get(w, zero) for w in words), np.int64, len(words))
    return np.hstack([bi, tri, np.stack([*affix, known], 1)])


def forward_backward(e: np.ndarray, mask: np.ndarray, a: np.ndarray, start: np.ndarray, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (sequence, place, label), expected transitions summed over all, and log likelihoods' normalisers.
    Sequences end where their mask does; products are scaled to sum to one at each place. start is one vector or one a
    sequence; tail is what the sequence's last place hears from behind it (nothing: ones)."""
    b, t, k = e.shape
    shift = e.max(2, keepdims=True)
    x, trans = np.exp(e - shift), np.exp(a)
    alpha, beta, scale = np.empty_like(x), np.ones_like(x), np.ones((b, t))
    if tail is not None:
        beta[:] = tail[:, None, :]
    alpha[:, 0] = np.exp(start) * x[:, 0]
    for i in range(t):
        if i:
            alpha[:, i] = np.where(mask[:, i, None], (alpha[:, i - 1] @ trans) * x[:, i], alpha[:, i - 1])
        scale[:, i] = alpha[:, i].sum(1)
        alpha[:, i] /= scale[:, i, None]
    counts = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        m = mask[:, i + 1, None]
        right = x[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None] * m
        counts += (alpha[:, i].T @ right) * trans
        beta[:, i] = np.where(m, right @ trans.T, beta[:, i + 1])
    z = np.where(mask, np.log(scale) + shift[:, :, 0], 0).sum(1)
    post = alpha * beta * mask[:, :, None]
    return post if tail is None else post / np.maximum(post.sum(2, keepdims=True), 1e-300), counts, z


def transfers(e: np.ndarray, mask: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What each window does to the message that enters it, up to a factor: (window, label before it, label at its end)."""
    x, trans = np.exp(e - e.max(2, keepdims=True)), np.exp(a)
    out = np.broadcast_to(np.eye(e.shape[2]), (len(e), e.shape[2], e.shape[2])).copy()
    for i in range(e.shape[1]):
        new = (out @ trans) * x[:, i, None, :]
        new /= new.max((1, 2), keepdims=True)
        out = np.where(mask[:, i, None, None], new, out)
    return out


def chained(e: np.ndarray, mask: np.ndarray, first: np.ndarray, windows: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of windows of which text t has windows[t] from first[t] on, each text being one chain."""
    k = e.shape[2]
    begin, tail = np.broadcast_to(start, (len(e), k)).copy(), np.ones((len(e), k))
    many = np.flatnonzero(windows > 1)
    if len(many):
        own = np.concatenate([np.arange(f, f + n) for f, n in zip(first[many], windows[many], strict=True)])
        place = np.full(len(e), -1)
        place[own] = np.arange(len(own))
        step = transfers(e[own], mask[own], a)
        trans, most = np.exp(a), int(windows[many].max())
        # A first window's own message: its transfer without the transition that enters it, which is undone by start.
        heads = first[many]
        x0 = np.exp(e[heads, 0] - e[heads, 0].max(1, keepdims=True)) * np.exp(start)
        rest = mask[heads].copy()
        rest[:, 0] = False
        message = np.einsum("bk,bkl->bl", x0, transfers(e[heads], rest, a))
        for j in range(1, most):  # forth over the windows' borders, all texts at once
            on = windows[many] > j
            message = message / message.sum(1, keepdims=True)
            at = heads[on] + j
            begin[at] = np.log(np.maximum(message[on] @ trans, 1e-300))
            message[on] = np.einsum("bk,bkl->bl", message[on], step[place[at]])
        back = np.ones((len(many), k))
        for j in range(most - 1, 0, -1):  # and back
            on = windows[many] > j
            at = heads[on] + j
            back[on] = np.einsum("bkl,bl->bk", step[place[at]], back[on])
            back[on] /= back[on].sum(1, keepdims=True)
            tail[at - 1] = back[on]
    return forward_backward(e, mask, a, begin, tail)[0]


class Field:
    def __init__(self, langs: list[str], lexicon: dict[str, int], cache: int = 200_000):
        self.langs, self.lexicon, self.cache = langs, lexicon, cache
        k = len(langs)
        self.zero = max([SIZE - 1, *lexicon.values()]) + 1
        self.w, self.a, self.start = np.zeros((self.zero + 1, k), np.float32), np.zeros((k, k)), np.zeros(k)
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": None}

    def fit(self, words: list[str], seq: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.3, l2: float = 1e-5, seed: int = 0) -> Field:
        """seq: places in words of each sequence's words; y: their labels. Adagrad on the log likelihood."""
        f, k = features(words, self.lexicon, self.zero), len(self.langs)
        g_w, g_a, g_s = np.full_like(self.w, 1e-2), np.full_like(self.a, 1e-2), np.full_like(self.start, 1e-2)
        rng, eye = np.random.default_rng(seed), np.eye(k)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(seq)), max(1, len(seq) // batch)):
                places = f[seq[at]]
                post, counts, _ = forward_backward(self.w[places].sum(2).astype(float), np.ones(seq[at].shape, bool), self.a, self.start)
                true = eye[y[at]]
                d = ((true - post) / len(at)).reshape(-1, k)
                flat = places.reshape(len(d), -1)
                for j in range(k):
                    g = np.bincount(flat.ravel(), np.repeat(d[:, j], flat.shape[1]), minlength=self.zero + 1) - l2 * self.w[:, j]
                    g_w[:, j] += g * g
                    self.w[:, j] += rate * g / np.sqrt(g_w[:, j])
                self.w[self.zero] = 0
                g = (np.einsum("btk,btl->kl", true[:, :-1], true[:, 1:]) - counts) / len(at)
                g_a += g * g
                self.a += rate * g / np.sqrt(g_a)
                g = (true[:, 0] - post[:, 0]).mean(0)
                g_s += g * g
                self.start += rate * g / np.sqrt(g_s)
        return self

    def places(self, texts: list[list[str]]) -> np.ndarray:
        """The place of each word of texts in self.scores, which hold the emissions of all words known now."""
        words = [w for t in texts for w in t]
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > self.cache:
            self.known, self.scores = {}, None
            new = list(set(words))
        if new or getattr(self, "scores", None) is None:
            rows = [self.w[features(new[i : i + 5000], self.lexicon, self.zero)].sum(1) for i in range(0, len(new), 5000)]
            old = getattr(self, "scores", None)
            self.scores = np.concatenate([*([old] if old is not None else []), *rows]) if rows or old is not None else np.zeros((0, len(self.langs)), np.float32)
            for w in new:
                self.known[w] = len(self.known)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the sums of its words' posteriors by language."""
        places, n = self.places(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        windows = -(-n // WINDOW)
        of, k = np.repeat(np.arange(len(texts)), windows), len(self.langs)
        out = np.zeros((len(texts), k))
        if not len(of):
            return out
        first = np.cumsum(n) - n
        start = first[of] + WINDOW * (np.arange(len(of)) - (np.cumsum(windows) - windows)[of])
        size = np.minimum(WINDOW, (first + n)[of] - start)
        grid = np.minimum(start[:, None] + np.arange(WINDOW), len(places) - 1)
        post = chained(self.scores[places[grid]].astype(float), np.arange(WINDOW) < size[:, None], np.cumsum(windows) - windows, windows, self.a, self.start)
        np.add.at(out, of, post.sum(1))
        return out


def train(docs: DataFrame, sample: int = 400, sample_bytes: int = 4_000_000, sequences: int = 4_000, length: int = 32, lexicon: int = 300, seed: int = 0) -> Field | None:
    """The field fitted on at most sample documents and sample_bytes of text a language of docs(doc_id, text, lang), or on the
    shortest of its texts where each is larger than that; None where there are none."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    # Of a language's rows those with the least hashes; all but some four times as many are left out before the shuffle.
    near = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * sample / n))]), F.col("lang"))
    # A text beyond the bound is passed over; only a language that has no other gives its shortest one whole.
    size = F.octet_length("text")
    fits = size <= sample_bytes
    order = Window.partitionBy("lang").orderBy(fits.desc(), F.when(fits, F.lit(0)).otherwise(size), "h")
    drawn = rows.where((F.col("h") / 2.0**64 + 0.5) <= near)
    drawn = drawn.withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample)
    drawn = drawn.withColumn("sum", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("sum") <= sample_bytes) | (F.col("i") == 1))
    texts = sorted((r["lang"], words_of(r["text"])) for r in drawn.select("lang", "text").collect())
    texts = [t for t in texts if t[1]]
    langs = sorted(counts)
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    shared: dict[str, list[int]] = {}
    by = {lang: [w for k, w in texts if k == lang] for lang in langs}
    for i, lang in enumerate(langs):
        n: dict[str, int] = {}
        for t in by[lang]:
            for w in t:
                n[w] = n.get(w, 0) + 1
        for w in sorted(n, key=lambda w: (-n[w], w))[:lexicon]:
            shared.setdefault(w, []).append(i)
    sets = {s: SIZE + i for i, s in enumerate(sorted(set(map(tuple, shared.values()))))}
    frequent = {w: sets[tuple(s)] for w, s in shared.items()}
    # Sequences of pieces of 4 to 16 words; each piece is of the last one's language or, as often, of any.
    place: dict[str, int] = {}
    seq, y = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    filled = [i for i, lang in enumerate(langs) if by[lang]]
    for s in range(sequences):
        at, lang = 0, filled[rng.integers(len(filled))]
        while at < length:
            text = by[langs[lang]][rng.integers(len(by[langs[lang]]))]
            n = min(int(rng.integers(4, 17)), length - at, len(text))
            i = int(rng.integers(len(text) - n + 1))
            seq[s, at : at + n] = [place.setdefault(w, len(place)) for w in text[i : i + n]]
            y[s, at : at + n] = lang
            at += n
            if rng.random() < 0.5:
                lang = filled[rng.integers(len(filled))]
    return Field(langs, frequent).fit(list(place), seq, y)


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, lang_pred, score (its share of the words' posteriors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [words_of(t) for t in b.column(2).to_pylist()]
                if field is None:
                    lang, share = ["und"] * len(texts), [0.0] * len(texts)
                else:
                    sums = field.label(texts)
                    best = sums.argmax(1)
                    lang = [field.langs[i] if t else "und" for i, t in zip(best, texts, strict=True)]
                    share = [min(1.0, float(s[i]) / len(t)) if t else 0.0 for s, i, t in zip(sums, best, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(share, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs.where(fold() != 2)))
