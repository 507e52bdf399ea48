"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear model sees the words of the text (and their beginnings) and the
probabilities of the categories before it. In training these are out-of-fold predictions, so a later model learns from what
earlier ones say about texts they haven't seen. The labels know toxic or not, so the categories come from the data: the
words that mark toxic documents are grouped by how they occur together in them (spectral clustering of their correlations),
a toxic document is of each category whose words it has, and the last model of the chain is the label itself.

The models are fitted on at most ``sample`` labelled documents (a documented bound, chosen by a hash of the id) and a
vocabulary of at most ``vocabulary`` words that are at least ``far`` standard deviations from chance; all documents are
then scored, whole, in one pass without a shuffle. Of several texts that have one labelled doc_id the least, by bytes, is the one
that the models are fitted on.

Defined results: null and empty texts have no words (a low, equal score each); a doc_id that has several labels counts with
the largest; null labels are left out; repeated rows each give a row; very long texts are one row like others; further
columns are ignored, whatever their names; with no labels, or of one kind only, all probabilities are 0 and nothing is
toxic; a category without words is never predicted; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from actispark.llm.common import documents, give_back

CATEGORIES = 3
CHAIN = (*(f"category_{i + 1}" for i in range(CATEGORIES)), "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def plain_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def words_of(text: str | None) -> set[str]:
    """The words of a text and, marked by ^, their first four, five and seven letters: inflected words share these."""
    words = plain_words(text)
    return words.union(["^" + w[:n] for n in (4, 5, 7) for w in words if len(w) >= n])


def known_words(text: str | None, known: dict[str, int]) -> set[str]:
    """Those of words_of(text) that are known, without keeping the others."""
    words = plain_words(text)
    return (known.keys() & words).union([p for n in (4, 5, 7) for w in words if len(w) >= n and (p := "^" + w[:n]) in known])


def _labelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 100):  # a text's words take more room than the text
            b = whole.slice(at, 100)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(words_of(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])
    give_back()


def group_words(texts: list[set[str]], words: list[str], groups: int) -> dict[str, int]:
    """Which group each of words is in, by how they occur together in texts: the leading eigenvectors of their correlations,
    then k-means from the most frequent word and those farthest from the ones before. Groups are numbered by size of use."""
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(texts), len(words)))
    for i, t in enumerate(texts):
        x[i, [place[w] for w in place.keys() & t]] = 1
    if len(words) <= groups:
        return place
    d = x - x.mean(0)
    norm = np.sqrt((d * d).sum(0))
    corr = (d.T @ d) / np.maximum(norm[:, None] * norm, 1e-12)
    values, vectors = np.linalg.eigh(corr)
    u = vectors[:, -groups:] * np.sqrt(np.maximum(values[-groups:], 0))
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    centres = [u[x.sum(0).argmax()]]
    while len(centres) < groups:
        centres.append(u[np.min([((u - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    c = np.array(centres)
    for _ in range(50):
        own = ((u[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([u[own == g].mean(0) if (own == g).any() else c[g] for g in range(groups)])
    order = sorted(range(groups), key=lambda g: (-x[:, own == g].sum(), g))
    return {w: order.index(g) for w, g in zip(words, own.tolist(), strict=True)}


def category_labels(texts: list[set[str]], toxic: np.ndarray, group: dict[str, int]) -> np.ndarray:
    """A column a category (toxic, and with a word of its group), then toxic itself."""
    y = np.zeros((len(texts), len(CHAIN)))
    y[:, -1] = toxic
    for i in np.flatnonzero(toxic):
        y[i, [group[w] for w in group.keys() & texts[i]]] = 1
    return y


class Linear:
    """Logistic regression on word indicators (lists of places) and a few dense columns; accelerated gradient steps."""

    def fit(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int, steps: int = 300, l2: float = 0.1) -> Linear:
        n = len(y)
        w, v = np.zeros(size + dense.shape[1]), np.zeros(size + dense.shape[1])
        # For columns without negative values, diag(X'X1) is above X'X, so these steps are safe (a quarter is the sigmoid's).
        total = np.bincount(rows, minlength=n) + dense.sum(1)
        rate = 4 / (np.concatenate([np.bincount(cols, total[rows], minlength=size), dense.T @ total]) + 4 * l2)
        for t in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.raw(v, rows, cols, dense, n), -30, 30)))
            g = p - y
            grad = np.concatenate([np.bincount(cols, g[rows], minlength=size), dense.T @ g]) + l2 * v
            grad[size] -= l2 * v[size]  # the constant is free
            new = v - rate * grad
            v = new + t / (t + 3) * (new - w)
            w = new
        self.w = w
        return self

    @staticmethod
    def raw(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        size = len(w) - dense.shape[1]
        return np.bincount(rows, w[cols], minlength=n) + dense @ w[size:]

    def probability(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.w, rows, cols, dense, len(dense)), -30, 30)))


class Chain:
    def __init__(self, vocabulary: list[str]):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.models: list[Linear] = []
        self.group: dict[str, int] = {}  # the categories' words
        self.clean = 0.0  # what out-of-fold probabilities of clean texts stay below, but for one in a thousand

    def features(self, texts: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        known = self.place.keys()
        found = [[self.place[w] for w in known & t] for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        return rows, np.fromiter((p for f in found for p in f), np.int64, len(rows))

    @staticmethod
    def _dense(before: list[np.ndarray], n: int) -> np.ndarray:
        return np.stack([np.ones(n), *before], 1)

    def fit(self, texts: list[set[str]], y: np.ndarray, folds: np.ndarray) -> Chain:
        rows, cols = self.features(texts)
        n, size, before = len(texts), len(self.place), []
        for k in range(len(CHAIN)):
            dense, out = self._dense(before, n), np.zeros(n)
            for f in np.unique(folds):
                own = folds == f
                train = ~own[rows]
                renumber = np.cumsum(~own) - 1
                model = Linear().fit(renumber[rows[train]], cols[train], dense[~own], y[~own, k], size)
                out[own] = model.probability((np.cumsum(own) - 1)[rows[~train]], cols[~train], dense[own])
            self.models.append(Linear().fit(rows, cols, dense, y[:, k], size))
            before.append(out)
        self.clean = float(np.quantile(before[-1][y[:, -1] == 0], 0.999))
        return self

    def probabilities(self, texts: list[set[str]]) -> list[np.ndarray]:
        rows, cols = self.features(texts)
        before: list[np.ndarray] = []
        for m in self.models:
            before.append(m.probability(rows, cols, self._dense(before, len(texts))))
        return before


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, vocabulary: int = 1_000, far: float = 4.0, folds: int = 5) -> Chain | None:
    """The chain fitted on at most sample of the documents that have labels(doc_id, toxic); None without both kinds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # whichever order the rows come in
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(_labelled_words, "doc_id long, toxic int, words array<string>").persist()
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        rows.unpersist()
        return None
    share = positive / n
    # Words by how far their toxic documents are from what chance would give, in standard deviations.
    over = F.col("bad") - F.col("n") * share
    distance = F.abs(over) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    top = counts.where((F.col("n") >= 5) & (distance >= far)).orderBy(distance.desc(), "word").limit(vocabulary).select("word", (over > 0).alias("marks")).collect()
    words = sorted(r["word"] for r in top)
    kept = rows.select("doc_id", "toxic", F.array_intersect("words", F.array(*[F.lit(w) for w in words]).cast("array<string>")).alias("words")).orderBy("doc_id").collect()  # at most sample rows
    rows.unpersist()
    texts, is_toxic = [set(r["words"]) for r in kept], np.array([r["toxic"] for r in kept])
    group = group_words([t for t, y in zip(texts, is_toxic, strict=True) if y], sorted(r["word"] for r in top if r["marks"] and r["word"][0] != "^"), CATEGORIES)
    folds_of = np.array([(r["doc_id"] * 2654435761 >> 8) % folds for r in kept])
    chain = Chain(words).fit(texts, category_labels(texts, is_toxic, group), folds_of)
    chain.group = group
    return chain


def _limit(chain: Chain | None, threshold: float) -> float:
    """What a probability must exceed: threshold, or more where that would take clean texts."""
    return max(threshold, chain.clean) if chain else 1.0


def _probabilities(chain: Chain | None, batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    if chain is None:
        return [np.zeros(batch.num_rows)] * len(CHAIN)
    parts = [chain.probabilities([known_words(t, chain.place) for t in batch.slice(i, 200).column(column).to_pylist()]) for i in range(0, batch.num_rows, 200)]
    return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(CHAIN)


def score(docs: DataFrame, chain: Chain | None, threshold: float = 0.25) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, p_ of each category, toxic (the last one is above threshold and above
    what clean labelled texts reach out of fold), kept."""
    limit = _limit(chain, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _probabilities(chain, b, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), pa.array(p[-1] > limit), pa.array(p[-1] <= limit)], ["doc_id", *(f"p_{c}" for c in CHAIN), "toxic", "kept"])
        give_back()

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, chain: Chain | None, threshold: float = 0.25) -> DataFrame:
    """The rows of docs whose text is not toxic, with all their columns. Only texts go to Python."""
    limit = _limit(chain, threshold)

    @F.arrow_udf(BooleanType())
    def clean(text: pa.Array) -> pa.Array:
        out = pa.array(_probabilities(chain, pa.RecordBatch.from_arrays([text], ["text"]), 0)[-1] <= limit, pa.bool_())
        give_back()
        return out

    return docs.where(clean(F.col("text")))


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
