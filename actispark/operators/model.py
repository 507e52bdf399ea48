"""Training tables, group-aware folds, and the sleep/wake classifier."""

from __future__ import annotations

import heapq
import itertools
import json
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import QuantileDiscretizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from actispark.operators.evaluate import binary_metrics, class_weight, tune_threshold


def training_dataset(frames: dict[str, DataFrame]) -> DataFrame:
    """Labelled epoch tables under one another by their columns' names, with group, the key of frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("group", F.lit(k)) for k, f in frames.items()])


def _draw(key: str, seed: int) -> Column:
    """A number in [0, 1) for each value of key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def group_split(df: DataFrame, key: str, test_share: float = 0.4, seed: int = 17) -> DataFrame:
    """df with test: whole groups, each with the chance test_share, drawn by a hash of the key; rows need no exchange."""
    return df.withColumn("test", _draw(key, seed) < test_share)


def group_folds(df: DataFrame, key: str, k: int = 10, most: int = 10_000, seed: int = 17, fold: str = "fold") -> DataFrame:
    """df with fold 0 to k - 1: whole groups, the largest first, each into the fold with the fewest rows. A group of at
    least one in most of the rows is dealt by itself; all smaller ones lie in most buckets by a hash of the key, and a
    bucket is dealt like a group. So at most 2 most counts are looked at together, and folds differ by a bucket at most."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bucket = F.least(F.floor(_draw(key, seed) * most), F.lit(most - 1)).cast("int")
    large = F.col("n") * most >= total
    dealt = sizes.groupBy(F.when(large, F.col(key)).alias("_g"), F.when(large, None).otherwise(F.coalesce(bucket, F.lit(0))).alias("_b")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_g", "_b").collect()
    heap = [(0, i) for i in range(k)]
    folds = []
    for r in dealt:
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + r["n"], i))
        folds.append((r["_g"], r["_b"], i))
    table = df.sparkSession.createDataFrame(folds, StructType([StructField("_g", df.schema[key].dataType), StructField("_b", IntegerType()), StructField("_i", IntegerType())]))
    alone, shared = table.where("_b is null"), table.where("_b is not null")
    at = df.join(F.broadcast(alone.select("_g", "_i")), F.col(key).eqNullSafe(F.col("_g")), "left").drop("_g")
    at = at.withColumn("_b", F.when(F.col("_i").isNull(), F.coalesce(bucket, F.lit(0)))).join(F.broadcast(shared.select("_b", F.col("_i").alias("_j"))), "_b", "left")
    return at.withColumn(fold, F.coalesce("_i", "_j")).select(*[F.col(f"`{c}`") for c in df.columns if c != fold], fold)


def medians(df: DataFrame, cols: list[str], bins: int = 4096) -> dict[str, float | None]:
    """The exact median of each column: rounds of histograms narrow the range that holds the middle values until it is one
    value, all columns in one job a round; the driver sees bins."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)])).alias("s")).select("s.i", "s.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = {r["i"]: r for r in values.groupBy("i").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    search = [[i, rank, r["lo"], r["hi"], 0, None] for i, r in ends.items() for rank in {(r["n"] - 1) // 2, r["n"] // 2}]  # column, rank, range, rows before it, value
    while open_ := [t for t in search if t[5] is None]:
        targets = df.sparkSession.createDataFrame([(k, t[0], float(t[2]), float(t[3])) for k, t in enumerate(open_)], "k int, i int, lo double, hi double")
        at = values.join(F.broadcast(targets), "i").where(F.col("v").between(F.col("lo"), F.col("hi")))
        width = (F.col("hi") - F.col("lo")) / bins
        bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
        found = at.groupBy("k", bin_.alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("k", "b").collect()
        for k, t in enumerate(open_):
            for r in (r for r in found if r["k"] == k):
                if t[4] + r["n"] > t[1]:
                    t[2], t[3] = r["lo"], r["hi"]
                    break
                t[4] += r["n"]
            if t[2] == t[3]:
                t[5] = t[2]
    out: dict[str, float | None] = {c: None for c in cols}
    for i in ends:
        own = [t[5] for t in search if t[0] == i]
        out[cols[i]] = sum(own) / len(own)
    return out


def fit_imputer(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """The exact median of each column of train (0 where it has no value), for impute."""
    return {c: m if m is not None else 0.0 for c, m in medians(train, cols).items()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in medians.items()})


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[f(F.col(f"`{c}`")) for c in cols for f in (F.min, F.max)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def scale(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns on 0..1 by the limits of the training rows; constant ones are 0."""
    return df.withColumns({c: (F.col(f"`{c}`") - a) / ((b - a) or 1.0) for c, (a, b) in limits.items()})


# --- the classifier ---------------------------------------------------------------------------------------------------

SCORE, BINS = "SLEEP_PREDICTION", 128


class MediansModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns _f0, _f1 ... of the input columns (whose names may hold dots and bars), nulls by medians."""

    medians = Param(Params._dummy(), "medians", "a number for each input column", TypeConverters.toListFloat)

    def __init__(self, inputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, medians=medians)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers = zip(self.getInputCols(), self.getOrDefault(self.medians), strict=True)
        return dataset.withColumns({f"_f{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for i, (c, m) in enumerate(numbers)})


class Medians(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, dataset: DataFrame) -> MediansModel:
        found = fit_imputer(dataset, self.getInputCols())
        return MediansModel(self.getInputCols(), [found[c] for c in self.getInputCols()])


class Vector(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """_features of the input columns as plain numbers: an assembler would pass bins on as categories without an order."""

    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("_features", array_to_vector(F.array(*self.getInputCols())))


class SleepModel:
    """One writable pipeline (medians, bins, vector, trees); transform gives the probability of class 1."""

    def __init__(self, pipeline: PipelineModel):
        self.pipeline = pipeline

    @property
    def medians(self) -> dict[str, float]:
        first = self.pipeline.stages[0]
        return dict(zip(first.getInputCols(), first.getOrDefault(first.medians), strict=True))

    def transform(self, df: DataFrame, out: str = SCORE) -> DataFrame:
        n = len(self.medians)
        at = self.pipeline.transform(df).withColumn("_p", vector_to_array("probability")[1])
        return at.drop("_features", "rawPrediction", "probability", "prediction", *[f"_{x}{i}" for x in "fb" for i in range(n)]).withColumnRenamed("_p", out)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> SleepModel:
        return cls(PipelineModel.load(path))


def features_of(df: DataFrame, features: list[str], bins: int = BINS) -> PipelineModel:
    """Medians, quantile bins and the vector of features, from df: what all fits on it share."""
    n = range(len(features))
    stages = [Medians(features), QuantileDiscretizer(inputCols=[f"_f{i}" for i in n], outputCols=[f"_b{i}" for i in n], numBuckets=bins, handleInvalid="keep"), Vector([f"_b{i}" for i in n])]
    return Pipeline(stages=stages).fit(df)


def weighted(df: DataFrame, label: str) -> DataFrame:
    """df with the label as a number and _w: the positive class weighted by the classes' ratio."""
    weight = class_weight(df, label).first()["scale_pos_weight"] or 1.0
    return df.withColumn("_w", F.when(F.col(label) == 1, weight).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))


def trees(label: str, **params) -> GBTClassifier:
    return GBTClassifier(featuresCol="_features", labelCol=label, weightCol="_w", seed=17, **({"maxIter": 20, "maxDepth": 4} | params))


def train_sleep_model(df: DataFrame, features: list[str], label: str = "SLEEP", **params) -> SleepModel:
    """Boosted trees with the positive class weighted by the classes' ratio."""
    labelled = df.where(F.col(label).isin(0, 1))
    made = features_of(labelled, features)
    return SleepModel(PipelineModel([*made.stages, trees(label, **params).fit(made.transform(weighted(labelled, label)))]))


def score_epochs(model: SleepModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def at_once(spark: SparkSession, work: dict[str, Callable[[], object]], most: int = 4) -> dict[str, object]:
    """What each function of work gives, most of them at a time, each in a job group of its name. If one fails, the others'
    jobs are cancelled and its error is raised."""

    def run(name: str) -> object:
        spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        return work[name]()

    with ThreadPoolExecutor(most) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in work}
        try:
            return {name: f.result() for name, f in futures.items()}
        except BaseException:
            for name, f in futures.items():
                f.cancel()
                spark.sparkContext.cancelJobGroup(name)
            raise


@contextmanager
def shared_features(df: DataFrame, features: list[str], label: str, keep: list[str]) -> Iterator[tuple[PipelineModel, DataFrame]]:
    """The features' stages, fitted once, and the labelled rows with their vector, kept while fits read them."""
    labelled = df.where(F.col(label).isin(0, 1))
    made = features_of(labelled, features)
    rows = made.transform(weighted(labelled, label)).select(*keep, label, "_w", "_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield made, rows
    finally:
        rows.unpersist()


class Constant:
    """What stands in for a model where there are no rows to fit, or rows of one class only."""

    def __init__(self, p: float):
        self.p = p

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1 - self.p), F.lit(self.p))))


def fitted(rows: DataFrame, label: str, params: dict) -> Model | Constant:
    """Trees of rows; the class itself where they have one only, one half where there are none."""
    n, low, high = rows.agg(F.count("*"), F.min(label), F.max(label)).first()
    return trees(label, **params).fit(rows) if n and low != high else Constant(float(low) if n else 0.5)


def scored(model: Model | Constant, rows: DataFrame) -> DataFrame:
    """rows with y_prob, without what the model adds."""
    return model.transform(rows).withColumn("y_prob", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "_features")


def _fold_metrics(fits: dict[tuple, Model], rows: DataFrame, label: str, threshold: float, names: list[str]) -> list[dict]:
    """Metrics of each fit (keyed by its parameter set and fold) on its fold, all from one job."""
    parts = [scored(m, rows.where(F.col("fold") == i)).select(F.lit(s).alias("_set"), "fold", F.col(label).cast("int").alias("y_true"), (F.col("y_prob") >= threshold).cast("int").alias("y_pred")) for (s, i), m in fits.items()]
    return [r.asDict() for r in binary_metrics(reduce(DataFrame.unionByName, parts), ["_set", "fold"]).select("_set", "fold", *names).collect()]


def cross_validate(df: DataFrame, features: list[str], key: str = "group", k: int = 10, label: str = "SLEEP", threshold: float = 0.5, **params) -> DataFrame:
    """fold, ACC, SEN, SPE, MCC, F1 of models fitted on the other folds, several at a time; medians and bins come from all
    labelled rows, once."""
    names = ["ACC", "SEN", "SPE", "MCC", "F1"]
    with shared_features(group_folds(df, key, k), features, label, ["fold"]) as (_, rows):
        fits = at_once(df.sparkSession, {f"fold {i}": lambda i=i: ((0, i), trees(label, **params).fit(rows.where(F.col("fold") != i))) for i in range(k)})
        got = _fold_metrics(dict(fits.values()), rows, label, threshold, names)
    return df.sparkSession.createDataFrame([(r["fold"], *[r[m] for m in names]) for r in got], "fold int, " + ", ".join(f"{m} double" for m in names))


def drawn_sets(grid: dict[str, list], n: int, seed: int = 17) -> list[dict]:
    sets = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    return random.Random(seed).sample(sets, min(n, len(sets)))


def random_search(df: DataFrame, features: list[str], grid: dict[str, list], n: int, key: str = "group", k: int = 3, seed: int = 17, metric: str = "MCC", label: str = "SLEEP") -> list[tuple[dict, float]]:
    """n parameter sets drawn from the grid with their mean metric over group folds, best first. All n * k fits share the
    features' bins, and several run at a time."""
    sets = drawn_sets(grid, n, seed)
    with shared_features(group_folds(df, key, k), features, label, ["fold"]) as (_, rows):
        work = {f"set {s} fold {i}": lambda s=s, i=i: ((s, i), trees(label, **sets[s]).fit(rows.where(F.col("fold") != i))) for s in range(len(sets)) for i in range(k)}
        got = _fold_metrics(dict(at_once(df.sparkSession, work).values()), rows, label, 0.5, [metric])
    mean = {s: [r[metric] for r in got if r["_set"] == s] for s in range(len(sets))}
    return sorted(((p, sum(mean[s]) / len(mean[s])) for s, p in enumerate(sets)), key=lambda x: -x[1])


def best_rounds(df: DataFrame, features: list[str], key: str = "group", k: int = 10, most: int = 2000, least_gain: float = 0.01, label: str = "SLEEP", **params) -> tuple[int, DataFrame]:
    """How many rounds of boosting serve best, and the curve: round, loss (the mean over folds). Each fold's fit watches the
    rows of its fold and stops by itself when a round gains less than least_gain of their loss; a fold that has stopped keeps
    its last loss. The rounds are those where the mean is least."""
    with shared_features(group_folds(df, key, k), features, label, ["fold"]) as (_, rows):

        def watch(i: int) -> list[float]:
            held = rows.withColumn("_held", F.col("fold") == i)
            model = trees(label, **params | {"maxIter": most, "validationIndicatorCol": "_held", "validationTol": least_gain}).fit(held)
            return model.evaluateEachIteration(rows.where(F.col("fold") == i))

        curves = list(at_once(df.sparkSession, {f"rounds fold {i}": lambda i=i: watch(i) for i in range(k)}).values())
    length = max(map(len, curves))
    mean = [sum(c[min(i, len(c) - 1)] for c in curves) / k for i in range(length)]
    return min(range(length), key=lambda i: mean[i]) + 1, df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(mean)], "round int, loss double")


def train_stopped(df: DataFrame, features: list[str], key: str = "group", k: int = 10, most: int = 2000, least_gain: float = 0.01, label: str = "SLEEP", **params) -> tuple[SleepModel, int]:
    """A model of all rows with the rounds that group folds agree on, and these rounds."""
    rounds, _ = best_rounds(df, features, key, k, most, least_gain, label, **params)
    return train_sleep_model(df, features, label, **params | {"maxIter": rounds}), rounds


# --- nested folds -----------------------------------------------------------------------------------------------------


def nested_folds(df: DataFrame, key: str, outer: int = 5, inner: int = 3) -> DataFrame:
    """df with outer and inner: two fold numbers of a group, dealt as one so that each pair has like numbers of rows. The
    rows of an outer fold are only tested; among the others, inner tells the folds of the search and of the threshold."""
    at = group_folds(df, key, outer * inner, fold="_cell")
    return at.withColumns({"outer": F.floor(F.col("_cell") / inner).cast("int"), "inner": F.col("_cell") % inner}).drop("_cell")


def nested_validation(df: DataFrame, features: list[str], grid: dict[str, list], n: int, key: str = "group", outer: int = 5, inner: int = 3, label: str = "SLEEP", metric: str = "MCC", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two tables. Folds: outer, params, inner_score, threshold. Predictions: outer, key, y_true, y_prob, threshold, y_pred of
    the outer folds' rows. For each outer fold everything, medians and bins too, comes from the other rows: the parameter set
    with the best mean metric over inner folds, the threshold tuned on its scores out of the inner folds, the final fit."""
    spark, sets = df.sparkSession, drawn_sets(grid, n, seed)
    folded = nested_folds(df.where(F.col(label).isin(0, 1)), key, outer, inner).persist(StorageLevel.MEMORY_AND_DISK)

    def one(o: int) -> tuple[tuple, DataFrame]:
        train = folded.where(F.col("outer") != o)
        with shared_features(train, features, label, [key, "inner"]) as (made, rows):
            fits = {(s, i): fitted(rows.where(F.col("inner") != i), label, p) for s, p in enumerate(sets) for i in range(inner)}
            out = reduce(DataFrame.unionByName, [scored(m, rows.where(F.col("inner") == i)).select(F.lit(s).alias("_set"), F.col("inner").alias("fold"), F.col(label).cast("int").alias("y_true"), "y_prob") for (s, i), m in fits.items()])
            got = binary_metrics(out.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")), ["_set", "fold"]).groupBy("_set").agg(F.avg(metric).alias("m")).collect()
            best = min(got, key=lambda r: (-r["m"], r["_set"]))
            tuned = tune_threshold(out.where(F.col("_set") == best["_set"]), ["_set"]).first()
            final = fitted(rows, label, sets[best["_set"]])
        threshold = tuned["threshold"] if tuned else 0.5
        test = scored(final, made.transform(folded.where(F.col("outer") == o).withColumn(label, F.col(label).cast("double"))))
        rows = test.select("outer", key, F.col(label).cast("int").alias("y_true"), "y_prob", F.lit(threshold).alias("threshold"), (F.col("y_prob") >= threshold).cast("int").alias("y_pred"))
        return (o, json.dumps(sets[best["_set"]], sort_keys=True), float(best["m"]), float(threshold)), rows

    done = at_once(spark, {f"outer {o}": lambda o=o: one(o) for o in range(outer)})
    folds = spark.createDataFrame([f for f, _ in done.values()], "outer int, params string, inner_score double, threshold double")
    return folds, reduce(DataFrame.unionByName, [rows for _, rows in done.values()])


# --- importances ------------------------------------------------------------------------------------------------------


def permuted_importances(model: SleepModel, df: DataFrame, label: str = "SLEEP", keys: list[str] | None = None, seed: int = 17) -> DataFrame:
    """keys, feature, importance: by how much the log loss rises when a feature's values are dealt anew among the rows of an
    Arrow batch. One scoring pass: each row goes in as it is, and once for each feature with that one changed."""
    keys, features = keys or [], list(model.medians)
    rows = df.where(F.col(label).isin(0, 1)).select(*keys, F.col(label).cast("int").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(features)])
    names = [f"_v{i}" for i in range(len(features))]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for b in batches:
            yield b.assign(_changed=-1)
            for i, name in enumerate(names):
                yield b.assign(**{name: b[name].to_numpy()[rng.permutation(len(b))], "_changed": i})

    schema = StructType([*rows.schema.fields, StructField("_changed", IntegerType())])
    dealt = rows.mapInPandas(deal, schema).withColumnsRenamed(dict(zip(names, features, strict=True)))
    p = F.greatest(F.least(F.col(SCORE), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = model.transform(dealt).groupBy(*keys, "_changed").agg(F.avg(-F.log(F.when(F.col("_y") == 1, p).otherwise(1 - p))).alias("loss"))
    named = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_changed") + 1)
    base = loss.where("_changed < 0").select(*keys, F.col("loss").alias("_base"))
    changed = loss.where("_changed >= 0").select(*keys, named.alias("feature"), "loss")
    return (changed.join(base, keys) if keys else changed.crossJoin(base)).select(*keys, "feature", (F.col("loss") - F.col("_base")).alias("importance"))  # without keys base is one row


def fold_importances(df: DataFrame, features: list[str], key: str = "group", k: int = 5, label: str = "SLEEP", **params) -> DataFrame:
    """fold, feature, importance on the rows of each fold of the model fitted on the others."""
    folded = group_folds(df.where(F.col(label).isin(0, 1)), key, k)
    models = at_once(df.sparkSession, {str(i): lambda i=i: train_sleep_model(folded.where(F.col("fold") != i), features, label, **params) for i in range(k)})
    return reduce(DataFrame.unionByName, [permuted_importances(m, folded.where(F.col("fold") == int(i)), label, ["fold"]) for i, m in models.items()])
