"""Evaluation of scores: truth from diaries, confusion, curves, thresholds, reports.

Sweeps and curves never window raw rows: rows are counted by distinct score first, and running sums over scores go by
bins of the score, so no task holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actispark.functions.scalars import clean_scored, safe_div
from actispark.operators.nights import wake_interval_times
from actispark.operators.spans import within

BINS = 4096


def diary_truth(epochs: DataFrame, matched_days: DataFrame, diary: DataFrame, intervals: DataFrame) -> DataFrame:
    """Epochs in bed with truth: 0 (awake) in [t1, t2], in a wake interval or in [t3, t4], else 1. Each epoch counts once."""
    days = matched_days.select("day_id", "recording_id", "t1", "t2", "t3", "t4")
    at = within(epochs, days, "recording_id", "t1", "t4")
    spans = wake_interval_times(diary, intervals).select("day_id", "start_ts", "end_ts")
    hit = within(at, spans, "day_id", "start_ts", "end_ts", "left_semi").select("day_id", "recording_id", "ts", F.lit(True).alias("_w")).distinct()
    at = at.join(hit, ["day_id", "recording_id", "ts"], "left")
    awake = F.col("ts").between(F.col("t1"), F.col("t2")) | F.col("ts").between(F.col("t3"), F.col("t4")) | F.coalesce("_w", F.lit(False))
    return at.withColumn("truth", (~awake).cast("int")).drop("_w", "t1", "t2", "t3", "t4")


def diary_threshold_sweep(truth: DataFrame, thresholds: tuple[float, ...] = tuple(i / 10 for i in range(1, 11))) -> DataFrame:
    """threshold, tp, fp, tn, fn, acc, sen, spe (in %), nights and best (the highest acc, the first of equals), in the thresholds' order. Rows are
    counted by truth and the number of thresholds they reach, so the thresholds meet a few counts only."""
    reached = sum((F.coalesce((F.col("score") >= t).cast("int"), F.lit(0)) for t in thresholds), F.lit(0))
    counts = truth.groupBy("truth", reached.alias("reached")).count()
    nights = truth.agg(F.count_distinct("day_id").alias("nights"))
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]))
    at = counts.select("truth", "reached", "count", grid.alias("g")).select("truth", "count", "g.threshold", (F.col("reached") >= F.col("g.i")).alias("hit"))
    n = lambda t, h: F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("hit") == F.lit(h)), F.col("count"))), F.lit(0))
    sums = at.groupBy("threshold").agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(0, False).alias("tn"), n(1, False).alias("fn"))
    rates = sums.withColumns({
        "acc": 100 * safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "sen": 100 * safe_div("tp", F.col("tp") + F.col("fn")), "spe": 100 * safe_div("tn", F.col("tn") + F.col("fp")),
    })
    first = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("acc").desc_nulls_last(), "threshold")) == 1  # a row a threshold
    return rates.crossJoin(nights).withColumn("best", first).orderBy("threshold")  # nights is one row


def _score_counts(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per distinct score: pos, neg, and the bin that orders them."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")).withColumn("bin", F.floor(F.col("score") * BINS))


def running_counts(df: DataFrame, keys: list[str], label: str, score: str, descending: bool = True) -> DataFrame:
    """keys, score, pos, neg and the sums of pos and neg over scores from one end up to and with this one (tp, fp) and over
    all (all_pos, all_neg). Sums are first made within bins of the score, then over the bins."""
    side = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    counts = _score_counts(df, keys, label, score)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.partitionBy(*keys).orderBy(side("bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    bins = bins.select(*keys, "bin", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.sum("p").over(whole).alias("all_pos"), F.sum("n").over(whole).alias("all_neg"))
    inner = Window.partitionBy(*keys, "bin").orderBy(side("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("tp", F.sum("pos").over(inner)).withColumn("fp", F.sum("neg").over(inner)).join(bins, [*keys, "bin"])
    return at.select(*keys, "score", "pos", "neg", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"), "all_pos", "all_neg")


def roc_auc(df: DataFrame, keys: list[str], label: str = "SLEEP", score: str = "SLEEP_PREDICTION") -> DataFrame:
    """keys, auc: the share of (positive, negative) pairs in order, ties by half; null with one class only."""
    runs = running_counts(df, keys, label, score, descending=False)
    won = F.sum(F.col("pos") * ((F.col("fp") - F.col("neg")) + F.col("neg") / 2.0))
    return runs.groupBy(*keys).agg(safe_div(won, F.max("all_pos") * F.max("all_neg")).alias("auc"))


def _confusion(label: str, predicted: Column) -> dict[str, Column]:
    y = F.col(label)
    return {"tp": F.count_if((y == 1) & predicted), "fp": F.count_if((y == 0) & predicted), "tn": F.count_if((y == 0) & ~predicted), "fn": F.count_if((y == 1) & ~predicted)}


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def _mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    return _or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def score_report(df: DataFrame, threshold: float = 0.5, file: str = "file", label: str = "SLEEP", score: str = "SLEEP_PREDICTION") -> DataFrame:
    """Per file, and for all files together in the row without a file: n, accuracy, precision, recall, f1, auc, balanced
    accuracy, specificity, tp, tn, fp, fn, status. Files without a usable row have the status no_valid_rows."""
    good = clean_scored(df, label, score)
    counts = good.rollup(file).agg(F.grouping(file).alias("_all"), F.count("*").alias("n_samples"), *[c.alias(k) for k, c in _confusion(label, F.col(score) >= threshold).items()])
    auc = roc_auc(good, [file], label, score).withColumn("_all", F.lit(0)).unionByName(roc_auc(good, [], label, score).select(F.lit(None).cast("string").alias(file), "auc", F.lit(1).alias("_all")))
    auc = auc.select(F.col(file).alias("_f"), F.col("_all").alias("_a"), "auc")
    names = df.select(F.col(file).alias("_g"), F.lit(0).alias("_b")).distinct()
    at = names.join(counts, F.col(file).eqNullSafe(F.col("_g")) & (F.col("_all") == F.col("_b")), "full").join(auc, F.col(file).eqNullSafe(F.col("_f")) & (F.col("_all") == F.col("_a")), "left")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, spec = _or_zero(tp, tp + fn), safe_div(tn, tn + fp)
    seen = F.coalesce(F.col("n_samples"), F.lit(0)) > 0
    only = lambda c: F.when(seen, c)
    balanced = F.when(tp + fn == 0, spec).when(tn + fp == 0, recall).otherwise((recall + spec) / 2)
    return at.select(
        F.coalesce(F.col(file), F.col("_g")).alias(file), F.coalesce(F.col("_all"), F.lit(0)).alias("overall"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), only(safe_div(tp + tn, F.col("n_samples"))).alias("accuracy"), only(_or_zero(tp, tp + fp)).alias("precision"),
        only(recall).alias("recall"), only(_or_zero(2 * tp, 2 * tp + fp + fn)).alias("f1"), only(F.col("auc")).alias("auc"), only(balanced).alias("balanced_accuracy"), only(spec).alias("specificity"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")], F.when(seen, "ok").otherwise("no_valid_rows").alias("status"),
    )


def tune_threshold(df: DataFrame, keys: list[str], label: str = "y_true", score: str = "y_prob", steps: int = 10_000) -> DataFrame:
    """keys, threshold, mcc: of 0, 1/steps ... the first threshold with the greatest Matthews correlation. A score counts
    at the thresholds it reaches, so rows are counted by the last of these, and sums run over at most steps rows a key."""
    return _best_threshold(_threshold_counts(df, keys, label, score, steps), keys, steps)


def _threshold_counts(df: DataFrame, keys: list[str], label: str, score: str, steps: int) -> DataFrame:
    last = F.least(F.greatest(F.floor(F.col(score) * steps + 1e-9), F.lit(-1)), F.lit(steps - 1)).cast("int")
    return df.groupBy(*keys, last.alias("last")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def _best_threshold(counts: DataFrame, keys: list[str], steps: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    up = w.orderBy(F.col("last").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "p": F.sum("pos").over(w), "n": F.sum("neg").over(w)})
    # All thresholds after the next lower count up to this one give the same prediction; the first of them counts.
    below = F.lead("last").over(w.orderBy(F.col("last").desc()))
    at = at.withColumn("first", F.coalesce(below + 1, F.lit(0))).where(F.col("last") >= 0)
    top = counts.groupBy(*keys).agg(F.max("last").alias("last"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    beyond = top.where(F.col("last") < steps - 1).select(*keys, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "p", "n", (F.col("last") + 1).alias("first"))
    at = at.select(*keys, "tp", "fp", "p", "n", "first").unionByName(beyond)
    mcc = _mcc(F.col("tp"), F.col("fp"), F.col("n") - F.col("fp"), F.col("p") - F.col("tp"))
    best = at.withColumn("mcc", F.round(mcc, 12)).groupBy(*keys).agg(F.min_by(F.struct("first", "mcc"), F.struct(-F.col("mcc"), "first")).alias("b"))
    return best.select(*keys, (F.col("b.first") / F.lit(float(steps))).alias("threshold"), F.col("b.mcc").alias("mcc"))


def fold_thresholds(df: DataFrame, folds: int, fold: str = "fold", label: str = "y_true", score: str = "y_prob", steps: int = 10_000) -> DataFrame:
    """fold, threshold, tuned on the rows of the other folds, with mean and median over the folds. Rows are counted once by
    fold and the last threshold they reach; what the others hold is all counts less the fold's own."""
    counts = _threshold_counts(df, [fold], label, score, steps)
    every = counts.groupBy("last").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    each = every.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))  # at most steps rows a fold
    own = counts.select(F.col(fold).alias("_out"), "last", "pos", "neg")
    less = lambda a, b: (F.col(a) - F.coalesce(F.col(b), F.lit(0))).alias(b)
    others = each.join(own, ["_out", "last"], "left").select("_out", "last", less("_p", "pos"), less("_n", "neg")).where("pos + neg > 0")
    tuned = _best_threshold(others, ["_out"], steps).select(F.col("_out").alias(fold), "threshold")
    return tuned.crossJoin(tuned.agg(F.avg("threshold").alias("mean_threshold"), F.percentile("threshold", F.lit(0.5)).alias("median_threshold")))  # one row


def nested_thresholds(inner: DataFrame, outer: DataFrame, keys: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """outer with threshold and y_pred: each key's threshold is tuned on its rows of inner (scores out of the inner folds,
    which hold no row of the key's own test) and 0.5 where it has none there."""
    tuned = tune_threshold(inner, keys, label, score).select(*keys, "threshold")  # a row a fold
    at = outer.join(F.broadcast(tuned), keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return at.withColumn("y_pred", (F.col(score) >= F.col("threshold")).cast("int"))


def binary_metrics(df: DataFrame, keys: list[str], label: str = "y_true", predicted: str = "y_pred", digits: int = 4) -> DataFrame:
    """keys, tp, fp, tn, fn, BACC, MCC, SEN, SPE, PRE, F1 and ACC."""
    at = df.groupBy(*keys).agg(*[c.alias(k) for k, c in _confusion(label, F.col(predicted) == 1).items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sen, spe = _or_zero(tp, tp + fn), _or_zero(tn, tn + fp)
    bacc = F.when(tp + fn == 0, spe).when(tn + fp == 0, sen).otherwise((sen + spe) / 2)
    rates = {"BACC": bacc, "MCC": _mcc(tp, fp, tn, fn), "SEN": sen, "SPE": spe, "PRE": _or_zero(tp, tp + fp), "F1": _or_zero(2 * tp, 2 * tp + fp + fn), "ACC": _or_zero(tp + tn, tp + tn + fp + fn)}
    return at.select(*keys, "tp", "fp", "tn", "fn", *[F.round(c, digits).alias(k) for k, c in rates.items()])


def classification_report(df: DataFrame, keys: list[str], label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """keys, class (0, 1, macro avg, weighted avg), precision, recall, f1, support."""
    at = df.groupBy(*keys).agg(*[c.alias(k) for k, c in _confusion(label, F.col(predicted) == 1).items()])
    side = lambda name, t, f, m: F.struct(F.lit(name).alias("class"), _or_zero(t, t + f).alias("precision"), _or_zero(t, t + m).alias("recall"), _or_zero(2 * t, 2 * t + f + m).alias("f1"), (t + m).alias("support"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    at = at.withColumn("a", side("0", tn, fn, fp)).withColumn("b", side("1", tp, fp, fn))
    both = F.col("a.support") + F.col("b.support")
    mean = lambda name, wa, wb: F.struct(F.lit(name).alias("class"), *[_or_zero(wa * F.col(f"a.{m}") + wb * F.col(f"b.{m}"), wa + wb).alias(m) for m in ("precision", "recall", "f1")], both.alias("support"))
    rows = F.array("a", "b", mean("macro avg", F.lit(1.0), F.lit(1.0)), mean("weighted avg", F.col("a.support").cast("double"), F.col("b.support").cast("double")))
    return at.select(*keys, F.inline(rows))


def roc_points(df: DataFrame, keys: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """keys, threshold, fpr, tpr: a point per distinct score, highest first."""
    runs = running_counts(df, keys, label, score)
    return runs.select(*keys, F.col("score").alias("threshold"), safe_div("fp", "all_neg").alias("fpr"), safe_div("tp", "all_pos").alias("tpr"))


def pr_points(df: DataFrame, keys: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    runs = running_counts(df, keys, label, score)
    return runs.select(*keys, F.col("score").alias("threshold"), safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"), safe_div("tp", "all_pos").alias("recall"))


def average_precision(df: DataFrame, keys: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """keys, ap: precision weighted by the steps of recall."""
    runs = running_counts(df, keys, label, score)
    return runs.groupBy(*keys).agg(F.sum(safe_div("tp", F.col("tp") + F.col("fp")) * safe_div("pos", "all_pos")).alias("ap"))


def subject_vote(df: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """subject, nights, positive, vote (1 if more than half of the nights are positive); with subjects also truth (pPD or
    pMCI) and whether the vote differs."""
    votes = df.groupBy("subject").agg(F.count("*").alias("nights"), F.count_if(F.col("y_pred") == 1).alias("positive")).withColumn("vote", (F.col("positive") * 2 > F.col("nights")).cast("int"))
    if subjects is None:
        return votes
    truth = subjects.select(F.col("code").alias("subject"), (F.col("pPD") | F.col("pMCI")).cast("int").alias("truth"))
    return votes.join(truth, "subject").withColumn("differs", F.col("vote") != F.col("truth"))


def class_weight(df: DataFrame, label: str = "SLEEP") -> DataFrame:
    """One row: positives, negatives, scale_pos_weight (negatives a positive), shares in %."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    n = F.col("pos") + F.col("neg")
    return counts.select("pos", "neg", safe_div("neg", "pos").alias("scale_pos_weight"), (100 * safe_div("pos", n)).alias("pos_percent"), (100 * safe_div("neg", n)).alias("neg_percent"))


def cv_summary(folds: DataFrame, metrics: list[str], digits: int = 4) -> DataFrame:
    """metric, mean, sd (population) over folds, rounded."""
    return folds.unpivot([], metrics, "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("sd"))


def top_features(df: DataFrame, k: int = 10, importance: str = "importance") -> DataFrame:
    return df.orderBy(F.col(importance).desc(), "feature").limit(k)
