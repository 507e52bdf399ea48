"""Whole jobs: the steps of the other modules put together, from a recording's rows to tables of nights and subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actispark.functions.scalars import scenario_label
from actispark.operators import clinical, datasets, epochs, evaluate, match, model, nights, rest, signal, sleepwake, wear
from actispark.sources import scratch, store

KEYS = ["recording_id", "day_no"]


def nights_of_days(days: DataFrame, index: DataFrame, bins: DataFrame, recordings: DataFrame, fs: float, medians: int = 60, limits: dict | None = None, blocks: dict | None = None) -> DataFrame:
    """A night per day of days, with the hours it has rows for: the rest period from angle bins, sleep and wake from the
    activity index, endpoints of the minutes at rest. limits and blocks go to rest_flags and major_rest_periods."""
    flags = rest.rest_flags(rest.rolling_median_bins(bins, medians), **(limits or {}))
    wake = sleepwake.webster_rescore(sleepwake.cole_kripke(index))
    hours = days.groupBy(*KEYS).agg((F.first("day_rows") / (fs * 3600)).alias("available_hours"))
    periods = rest.major_rest_periods(flags, **(blocks or {})).join(hours, KEYS)
    return match.algorithmic_nights(periods, sleepwake.sleep_endpoints(wake, periods), recordings)


def recordings_to_nights(samples: DataFrame, recordings: DataFrame, fs: float = 25.0) -> dict[str, DataFrame]:
    """Algorithmic nights of raw samples, and the series they come from: days, index, wear, bins, nights."""
    days = epochs.noon_days(samples, fs)
    index, bins = signal.activity_index(days, fs), rest.arm_angle_bins(days, fs)
    return {"days": days, "index": index, "bins": bins, "wear": wear.rescore_wear(wear.wear_detection(days, fs)), "nights": nights_of_days(days, index, bins, recordings, fs)}


def night_features(index: DataFrame, found: DataFrame) -> DataFrame:
    """The statistics of the activity index in each of the nights found(night_id, recording_id, sleep_onset, sleep_end)."""
    at = match.night_activity(index, found)
    return signal.night_signal_features(at, ["night_id", "day_index"])


def scored_epochs_to_nights(scored: DataFrame, diary: DataFrame, recordings: DataFrame, subjects: DataFrame) -> DataFrame:
    """Night rows of scored epochs: diary days matched to recordings, metrics, ratios, norms and the subject's flags."""
    found = nights.night_metrics(scored, nights.match_days_to_recordings(diary, recordings, scored))
    return datasets.night_rows(found, subjects)


def clinical_statistics(df: DataFrame, subjects: DataFrame, features: list[str]) -> DataFrame:
    """A row per subject with a diagnosis and feature: the statistics over its days of what the covariates leave."""
    left = clinical.control_covariates(df, ["subject"], features)
    stats = clinical.day_statistics(left.withColumnRenamed("residual", "value"))
    return clinical.attach_diagnosis(stats, subjects)[0]


# --- training and validation ------------------------------------------------------------------------------------------

SIGNALS = ("magnitude", "z_angle", "temperature")


def training_epochs(samples: DataFrame, psg: DataFrame, seconds: int = 15, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """The training table of recordings with polysomnography: group (the recording), epoch, the signals' statistics over its
    seconds, SLEEP as scored there."""
    at = epochs.psg_epochs(samples, psg, seconds).withColumn("group", F.col("recording_id"))
    labels = psg.select(F.col("recording_id").alias("group"), F.col("ts").alias("epoch"), F.col("sleep").alias("SLEEP")).groupBy("group", "epoch").agg(F.max("SLEEP").alias("SLEEP"))
    return epochs.epoch_features(at, ["group", "epoch"], signals).join(labels, ["group", "epoch"])


def recordings_to_scores(fitted: model.SleepModel, samples: DataFrame, in_bed: DataFrame, seconds: int = 30, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Scored epochs of recordings that have no polysomnography: recording_id, ts (the epoch's middle), score. Rows within
    in_bed(subject, lo, hi) count, and an epoch begins with the row after the last one's end, so each stay in bed begins anew."""
    rows = epochs.filter_in_bed(samples.withColumn("subject", F.col("recording_id")), in_bed).drop("subject")
    at = epochs.reanchored_epochs(rows, seconds, label_offset=seconds / 2)
    scored = fitted.transform(epochs.epoch_features(at, ["recording_id", "epoch"], signals))
    return scored.select("recording_id", F.col("epoch").alias("ts"), F.col(model.SCORE).alias("score"))


def train_and_validate(samples: DataFrame, psg: DataFrame, path: str, seconds: int = 15, signals: tuple[str, ...] = SIGNALS, test_share: float = 0.4, threshold: float = 0.5, folds: int = 5, most: int = 2000, least_gain: float = 0.01, seed: int = 17, **params) -> dict[str, DataFrame]:
    """From recordings and polysomnography to a stored model and its report. In path the training set is brought up to date,
    group by group, and the model left; tests are whole recordings that the model hasn't seen. Returns training, curve
    (round, loss of the stopping), scored (the test epochs) and report."""
    spark = samples.sparkSession
    store.update_dataset(training_epochs(samples, psg, seconds, signals), f"{path}/training")
    training = model.group_split(store.dataset_at(spark, f"{path}/training").withColumn("group", F.col("group").cast("string")), "group", test_share, seed)
    features = [c for c in training.columns if c not in ("group", "epoch", "SLEEP", "test")]
    seen = training.where(~F.col("test"))
    rounds, curve = model.best_rounds(seen, features, k=folds, most=most, least_gain=least_gain, **params)
    model.train_sleep_model(seen, features, **params | {"maxIter": rounds}).save(f"{path}/model")
    scored = model.SleepModel.load(f"{path}/model").transform(training.where("test")).select(F.col("group").alias("file"), "epoch", "SLEEP", model.SCORE)
    return {"training": training, "curve": curve, "scored": scored, "report": evaluate.score_report(scored, threshold)}


# --- scenarios --------------------------------------------------------------------------------------------------------

STATISTICS = ("sd", "mad", "range", "iqr", "cv")


def scenario_features(days: DataFrame, subjects: DataFrame, features: list[str]) -> DataFrame:
    """A row per subject with a diagnosis: subject, diagnosis_code and FEATURE.statistic of its days(subject). The statistics
    don't ask for the days' order, so days are read once and not numbered."""
    long = days.where(F.col("subject").isNotNull()).select("subject", *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    table = clinical.day_statistics(long.unpivot(["subject"], [F.col(f"`{f}`").alias(f) for f in features], "feature", "value"))
    wide = table.groupBy("subject").pivot("feature", features).agg(F.first(F.struct(*STATISTICS)))
    flat = wide.select("subject", *[F.col(f"`{f}`")[s].alias(f"{f}.{s}") for f in features for s in STATISTICS])
    return clinical.attach_diagnosis(flat, subjects)[0]


def scenario_reports(table: DataFrame, grid: dict[str, list], n: int, outer: int = 5, inner: int = 3, coverage: float = 0.9, scenarios: tuple = clinical.SCENARIOS) -> DataFrame:
    """scenario, n_features, threshold kind (default: 0.5, tuned: each outer fold's own) and its metrics, for each comparison of
    diagnoses: features that are known for too few subjects or are all zero go, the others are filled with medians, and
    subjects are tested in outer folds whose model and threshold come from the other subjects."""
    names = [c for c in table.columns if c not in ("subject", "diagnosis_code")]

    def one(table: DataFrame, positive: tuple[int, ...], negative: tuple[int, ...]) -> DataFrame | None:
        at = clinical.scenario_dataset(table, positive, negative)
        long = at.unpivot(["subject"], [F.col(f"`{c}`").alias(c) for c in names], "feature", "value")
        kept = sorted(r["feature"] for r in clinical.feature_coverage(long, coverage).where("kept").collect())  # a row a feature
        if not kept:
            return None
        _, rows = model.nested_validation(at, kept, grid, n, "subject", outer, inner, "target")
        kinds = [rows.select(F.lit("tuned").alias("kind"), "y_true", "y_pred"), rows.select(F.lit("default").alias("kind"), "y_true", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))]
        metrics = evaluate.binary_metrics(reduce(DataFrame.unionByName, kinds), ["kind"]).select(F.lit(scenario_label(positive, negative)).alias("scenario"), F.lit(len(kept)).alias("n_features"), "*")
        return table.sparkSession.createDataFrame(metrics.collect(), metrics.schema)  # two rows

    with scratch.written(table, "scenarios") as rows:  # a row a subject, read by every job of every scenario
        parts = model.at_once(table.sparkSession, {scenario_label(p, m): lambda p=p, m=m: one(rows, p, m) for p, m in scenarios}, 3)
    return reduce(DataFrame.unionByName, [p for p in parts.values() if p is not None])
