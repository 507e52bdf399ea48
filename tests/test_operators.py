import math
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actispark.operators import clinical, datasets, epochs, evaluate, model, nights, rest, signal, sleepwake, wear

T0 = datetime(2024, 1, 1, 12)
AT = "recording_id string, day_no int, ts timestamp_ntz"


def series(spark, values, col="v double", step=60, rec="r"):
    return spark.createDataFrame([(rec, 1, T0 + timedelta(seconds=step * i), v) for i, v in enumerate(values)], f"{AT}, {col}")


def moments(v):
    m, n = np.mean(v), len(v)
    m2, m3, m4 = (np.mean((v - m) ** k) for k in (2, 3, 4))
    return (m3 / m2**1.5, m4 / m2**2 - 3) if m2 > 1e-12 and n > 1 else (None, None)


@pytest.mark.parametrize("v", [[3.0, 1.0, 1.0, 3.0, 2.0], [2.0, 2.0, 2.0], [-1.0, 0.5, 4.0, 4.0, -1.0, 9.0, 2.5, 7.0, 7.5, 8.0, 1.0]])
def test_epoch_statistics(spark, v):
    got = epochs.vector_features(series(spark, v), ["recording_id"], {"V": "v"}, ("ts",)).first().asDict()
    g = {k.removeprefix("V | "): x for k, x in got.items()}
    a, n = np.array(v), len(v)
    s = np.sort(a)
    skew, kurt = moments(a)
    expected = {
        "MAX": a.max(), "RELATIVE POSITION OF MAX": v.index(max(v)) / n, "RELATIVE POSITION OF MIN": v.index(min(v)) / n, "INTERQUARTILE RANGE": np.percentile(a, 75) - np.percentile(a, 25), "MODE": statistics.mode(v),
        "MEAN EXCLUDING OUTLIERS (20)": s[int(0.2 * n) : n - int(0.2 * n)].mean(), "MEDIAN ABSOLUTE DEVIATION": np.median(np.abs(a - np.median(a))), "VARIANCE": a.var(ddof=1), "SKEWNESS": skew, "KURTOSIS": kurt,
        "PERCENTILE 95": np.percentile(a, 95), "STUDENTIZED RANGE": np.ptp(a) / a.var(ddof=1) if a.var() else None,
    }
    for k, x in expected.items():
        assert g[k] == (pytest.approx(x) if x is not None else None), k
    assert len(g) - 1 == 44


def test_single_value_has_no_statistics(spark):
    row = epochs.vector_features(series(spark, [1.0]), ["recording_id"], {"V": "v"}, ("ts",)).first()
    assert all(x is None for x in row[1:])


def test_night_statistics(spark):
    v = [1.0, 2.0, 4.0, 3.0]
    row = signal.night_signal_features(series(spark, v), ["recording_id"], "v").first().asDict()
    g = {k.removeprefix("ACTIVITY | "): x for k, x in row.items()}
    p = np.array(v) / sum(v)
    assert len(g) - 1 == 43
    assert g["HARMONIC MEAN"] == pytest.approx(statistics.harmonic_mean(v))
    assert g["ENTROPY"] == pytest.approx(-(p * np.log(p)).sum())
    assert g["MODULATION"] == pytest.approx(3 / 5)
    assert (g["TKEO MAX"], g["TKEO MIN"]) == (10.0, 0.0)


def test_noon_days_and_windows(spark):
    day = [(("r"), i, T0 + timedelta(hours=i), 0.0) for i in range(30)]
    df = spark.createDataFrame(day, "recording_id string, line_no long, ts timestamp_ntz, x double")
    kept = epochs.noon_days(df, 1 / 3600)
    assert {(r["day_no"], r["n"]) for r in kept.groupBy("day_no").agg(F.count("*").alias("n")).collect()} == {(1, 24), (2, 6)}
    assert epochs.noon_days(df, 1 / 3600, 7).select("day_no").distinct().count() == 1
    # 24 rows are an exact multiple of 8, and 6 hold no window: the last one is never used
    assert epochs.sample_windows(kept, 8).groupBy("day_no").agg(F.max("window_no")).collect() == [(1, 1)]


def test_in_bed_is_strict_and_broadcast(spark):
    lo, hi = T0, T0 + timedelta(hours=1)
    df = spark.createDataFrame([("s", lo), ("s", lo + timedelta(seconds=1)), ("s", hi), ("t", lo + timedelta(seconds=1))], "subject string, ts timestamp_ntz")
    n = spark.createDataFrame([("s", lo, hi), ("s", lo, hi)], "subject string, lo timestamp_ntz, hi timestamp_ntz")
    assert epochs.filter_in_bed(df, n).count() == 1
    assert epochs.filter_in_bed(df, n, most_nights=0).count() == 1
    plan = epochs.filter_in_bed(df, n)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan


def test_psg_epochs_match_brute_force(spark):
    rows = [("r", i, T0 + timedelta(seconds=i * 0.7)) for i in range(100)]
    psg = [("r", T0 + timedelta(seconds=15 * i + 3), i % 2) for i in range(3)]
    got = epochs.psg_epochs(spark.createDataFrame(rows, "recording_id string, line_no long, ts timestamp_ntz"), spark.createDataFrame(psg, "recording_id string, ts timestamp_ntz, sleep int"))
    expected = {(i, p[1]) for _, i, t in rows for p in psg if p[1] <= t < p[1] + timedelta(seconds=15)}
    assert {(r["line_no"], r["epoch"]) for r in got.collect()} == expected


def test_bandpass_response():
    b, a = signal.bandpass(25.0)
    gain = lambda f: abs(b @ np.exp(-2j * np.pi * f / 25 * np.arange(7))) / abs(a @ np.exp(-2j * np.pi * f / 25 * np.arange(7)))
    assert [gain(f) for f in (0, 0.25, 5, 12)] == pytest.approx([0, 0.5**0.5, 1, 0.5**0.5], abs=1e-6)
    with pytest.raises(ValueError):
        signal.bandpass(24.0)


def test_activity_index(spark):
    fs, n = 25.0, 1500
    t = np.arange(3 * n)
    x = np.where(t < n, np.sin(2 * np.pi * 3 * t / fs), 0.0)
    rows = [("r", 1, int(i), T0 + timedelta(seconds=i / fs), float(x[i]), 0.0, 0.0) for i in t]
    df = spark.createDataFrame(rows, "recording_id string, day_no int, line_no long, ts timestamp_ntz, x double, y double, z double")
    got = [r["activity_index"] for r in signal.activity_index(df, fs).orderBy("ts").collect()]
    assert len(got) == 2  # the last window is never used
    assert got == pytest.approx([math.sqrt(0.5 / 3), 0.0], abs=0.01)


def defined_wake(v):
    """Rules a to c by their definition: each minute from those before it, looking back over the streak of wake."""
    asked, turned = [], {}  # minutes of sleep where a rule was asked, and what it turned

    def awake(t):
        return v[t] == 1 or t in turned

    for t in range(len(v)):
        if not awake(t):
            streak = t - 1 - max(asked, default=-1)
            asked.append(t)
            for k in range(4 if streak >= 15 else 3 if streak >= 10 else 1 if streak >= 4 else 0):
                turned[t + k] = True
    return [int(awake(t)) for t in range(len(v))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 17)), min_size=1, max_size=8))
def test_webster_rules_a_to_c(runs):
    v = [x for x, n in runs for _ in range(n)][:20]  # too short for rule d
    assert list(sleepwake.webster(np.array(v))) == defined_wake(v)


def test_webster_rule_d():
    v = np.array([0] * 3 + [1] * 25 + [0] * 10 + [1] * 12 + [0] * 4)
    assert list(sleepwake.webster(v)[:4]) == [0, 0, 0, 1]
    short = np.array([1] * 12 + [0] * 7 + [1] * 12)  # rule b leaves four minutes of sleep between long wake
    assert sleepwake.webster(short).all()


def test_cole_kripke_is_a_convolution(spark):
    v = np.abs(np.sin(np.arange(40.0) ** 2)) / 3
    got = sleepwake.cole_kripke(series(spark, v.tolist(), "activity_index double")).orderBy("ts").collect()
    kernel = sleepwake.SCALE * np.array(sleepwake.WEIGHTS)[::-1]
    assert [r["score"] for r in got] == pytest.approx(np.convolve(v, kernel, "same").tolist())


def test_endpoints(spark):
    wake = series(spark, [1, 0, 0, 1, 1, 0, 1, 1, 1, 1, 1, 1], "wake int")
    none = spark.createDataFrame([("r", 1, None, None)], "recording_id string, day_no int, rest_start timestamp_ntz, rest_end timestamp_ntz")
    assert tuple(sleepwake.sleep_endpoints(wake, none).first())[2:] == (3, 25, 8, 1, 3, 1)
    part = spark.createDataFrame([("r", 1, T0 + timedelta(minutes=1), T0 + timedelta(minutes=2))], none.schema)
    assert tuple(sleepwake.sleep_endpoints(wake, part).first())[2:] == (2, 100, 0, 0, 0, 0)


def test_wear_rescoring(spark):
    quiet = [0] * 20 + [1] * 8 + [0] * 20 + [1] * 40
    out = [r["wear"] for r in wear.rescore_wear(series(spark, quiet, "wear int", 900), last_day=False).orderBy("ts").collect()]
    assert out == [0] * 48 + [1] * 40
    last = [1] * 40 + [0] * 4 + [1] * 8
    assert [r["wear"] for r in wear.rescore_wear(series(spark, last, "wear int", 900)).orderBy("ts").collect()] == [1] * 40 + [0] * 12


def test_rest_period(spark):
    flags = [1] * 10 + [0] * 800 + [1] * 300 + [0] * 700 + [1] * 900 + [0] * 900 + [1] * 50
    got = rest.major_rest_periods(series(spark, flags, "active int", 5)).first()
    assert got["rest_start"] == T0 + timedelta(seconds=50) and got["rest_end"] == T0 + timedelta(seconds=5 * 1809, minutes=5)
    assert rest.major_rest_periods(series(spark, [1, 1], "active int", 5)).first()["rest_start"] is None


def test_arm_angle_matches_one_pass(spark):
    fs, n = 2.0, 20_000
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 4))
    rows = [("r", 1, T0 + timedelta(seconds=i / fs), i, *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, f"{AT}, line_no long, x double, y double, z double, temp double")
    got = {r["ts"]: r["angle"] for r in rest.arm_angle_bins(df, fs).collect()}
    import pandas as pd

    med = pd.DataFrame(x, columns=list("xyzt")).rolling(10).median()
    angle = np.degrees(np.arctan(med["z"] / np.hypot(med["x"], med["y"])))
    angle.index = pd.to_datetime([r[2] for r in rows])
    expected = angle.resample("5s").mean().fillna(0)
    assert list(got) and [got[t.to_pydatetime()] for t in expected.index] == pytest.approx(expected.tolist())


DIARY = "day_id long, subject string, date date, sleep_time int, sleep_duration int, wake_time int, get_up_time int"


def test_timeline_and_intervals(spark):
    d = date(2024, 1, 1)
    diary = spark.createDataFrame([(1, "s", d, 43_199, 43_200, 25_200, 20_000), (2, "s", d, 43_200, 82_800, 25_200, 28_800)], DIARY)
    a, b = (tuple(r) for r in nights.diary_timeline(diary).orderBy("day_id").select("t1", "t2", "t3", "t4").collect())
    assert a == (datetime(2024, 1, 2, 11, 59, 59), datetime(2024, 1, 2, 12), datetime(2024, 1, 3, 7), datetime(2024, 1, 3, 5, 33, 20)) or a[1] == datetime(2024, 1, 2, 12)
    assert b == (datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 7), datetime(2024, 1, 2, 8))
    spans = spark.createDataFrame([(2, 3600, 3600), (2, 3600, 3660), (2, 3600, 3661), (2, 86_340, 300)], "day_id long, start int, end int")
    got = sorted((r["start"], r["end"], r["duration"]) for r in nights.wake_interval_times(diary, spans).collect())
    assert got == [(3600, 3600, 60), (3600, 3660, 60), (3600, 3661, 60), (86_340, 300, 360)]


def test_awk5plus_runs(spark):
    for size, n in ((9, 0), (10, 1), (11, 1)):
        v = [1] * 10 + [0] * size + [1] * 3
        assert nights.awk5plus(series(spark, v, "score int"), ["recording_id"]).first()["awk5plus"] == n
    short = [1] * 9 + [0] * 12
    assert nights.awk5plus(series(spark, short, "score int"), ["recording_id"]).first()["awk5plus"] == 0


def test_night_metrics(spark):
    d = date(2024, 1, 1)
    diary = spark.createDataFrame([(1, "s", d, 79_200, 79_300, 79_500, 80_000)], DIARY)
    recs = spark.createDataFrame([("r", "s")], "recording_id string, subject string")
    t1 = datetime(2024, 1, 1, 22)
    rows = [("r", t1 + timedelta(seconds=30 * i), float(v)) for i, v in enumerate([0, 1, 0, 1, 0, 0, 1, 0])]
    ep = spark.createDataFrame(rows, "recording_id string, ts timestamp_ntz, score double")
    got = nights.night_metrics(ep, nights.match_days_to_recordings(diary, recs, ep)).first()
    assert (got["sol"], got["waso"], got["wasf"], got["tib"], got["wb"]) == (30, 90, 620, 800, 1)
    awake = ep.withColumn("score", F.lit(0.0))
    assert nights.night_metrics(awake, nights.match_days_to_recordings(diary, recs, awake)).count() == 0


def test_day_statistics(spark):
    long = spark.createDataFrame([("s", "f", float(v)) for v in (1, 2, 3, 10)] + [("s", "z", 1.0), ("s", "z", -1.0)], "subject string, feature string, value double")
    got = {r["feature"]: r for r in clinical.day_statistics(long).collect()}
    assert (got["f"]["mad"], got["f"]["range"], got["f"]["iqr"]) == (1.0, 9.0, 3.0) and got["f"]["sd"] == pytest.approx(np.std([1, 2, 3, 10]))
    assert got["z"]["cv"] is None


def test_covariates_equal_least_squares(spark):
    rng = np.random.default_rng(1)
    g, a, y = rng.integers(1, 3, 50).astype(float), rng.normal(60, 9, 50), rng.normal(size=50)
    df = spark.createDataFrame([(i, float(g[i]), float(a[i]), float(y[i])) for i in range(50)], "k int, gender double, age double, f double")
    got = [r["residual"] for r in clinical.control_covariates(df, "k", ["f"]).orderBy("k").collect()]
    x = np.stack([np.ones(50), g, a], 1)
    assert got == pytest.approx((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]).tolist())
    same = df.withColumn("gender", F.lit(1.0))  # constant: the age alone explains
    x = x[:, [0, 2]]
    assert [r["residual"] for r in clinical.control_covariates(same, "k", ["f"]).orderBy("k").collect()] == pytest.approx((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]).tolist())


def test_correlation_p_values():
    assert clinical.t_test_p(0.5, 10) == pytest.approx(0.14111328125)
    assert clinical.kendall(np.array([1, 2, 3, 4, 5]), np.array([2, 1, 4, 3, 5])) == pytest.approx((0.6, 0.23333333333333334))
    assert clinical.kendall(np.array([12, 2, 1, 12, 2]), np.array([1, 4, 7, 1, 0])) == pytest.approx((-0.47140452079103173, 0.2827454599327748))


def brute_tau(x, y):
    """tau-b by all pairs."""
    pairs = [(a, b) for i, a in enumerate(zip(x, y, strict=True)) for b in list(zip(x, y, strict=True))[:i]]
    sign = lambda p, q: int(p > q) - int(p < q)
    s = sum(sign(a[0], b[0]) * sign(a[1], b[1]) for a, b in pairs)
    return s / math.sqrt(sum(a[0] != b[0] for a, b in pairs) * sum(a[1] != b[1] for a, b in pairs))


def test_kendall_and_spearman_equal_all_pairs(spark):
    """Many values and few, with ties, over more values than there are bins."""
    rng = np.random.default_rng(9)
    columns = {"fine": rng.normal(size=700), "coarse": rng.integers(0, 9, 700).astype(float), "skewed": np.exp(rng.normal(size=700) * 4)}
    y = rng.integers(0, 40, 700) + np.round(columns["fine"] * 5)
    long = spark.createDataFrame([(f, float(v), float(c)) for f, col in columns.items() for v, c in zip(col, y, strict=True)], "feature string, value double, covariate double")
    got = {r["feature"]: r for r in clinical.covariate_correlations(long, "kendall").collect()}
    rank = lambda a: np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    spearman = {r["feature"]: r for r in clinical.covariate_correlations(long, "spearman").collect()}
    for f, col in columns.items():
        assert got[f]["r"] == pytest.approx(brute_tau(col, y), abs=6e-5) and got[f]["n"] == 700
        assert (got[f]["r"], got[f]["p"]) == pytest.approx(clinical.kendall(col, y), abs=6e-5)
        assert spearman[f]["r"] == pytest.approx(np.corrcoef(rank(col), rank(y))[0, 1], abs=6e-5)


@pytest.mark.parametrize(
    ("method", "x", "y", "r", "p"),
    [
        ("pearson", [1, 2, 3, 4, 5], [10, 9, 2.5, 6, 4], -0.7426106572325057, 0.1505558088534455), ("spearman", [1, 2, 3, 4, 5], [5, 6, 7, 8, 7], 0.8207826816681233, 0.08858700531354381),
        ("kendall", [12, 2, 1, 12, 2], [1, 4, 7, 1, 0], -0.47140452079103173, 0.2827454599327748), ("kendall", [1, 2, 3, 4, 5], [2, 1, 4, 3, 5], 0.6, 0.23333333333333334),
    ],
)
def test_p_values_of_correlations(spark, method, x, y, r, p):
    """Fixed values, as statistics packages give them."""
    long = spark.createDataFrame([("f", float(a), float(b)) for a, b in zip(x, y, strict=True)], "feature string, value double, covariate double")
    assert tuple(clinical.covariate_correlations(long, method, digits=9).first()) == ("f", 5, pytest.approx(r, abs=1e-8), pytest.approx(p, abs=1e-8))


def test_medians_are_exact(spark):
    rng = np.random.default_rng(2)
    cols = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=501) * 3), "c": np.exp(rng.normal(size=501) * 9)}
    df = spark.createDataFrame([(*map(float, r), None) for r in zip(*cols.values(), strict=True)], "a double, b double, c double, d double")
    assert model.medians(df, ["a", "b", "c", "d"]) == {**{k: float(np.median(v)) for k, v in cols.items()}, "d": None}
    even = df.limit(0).unionByName(spark.createDataFrame([(1.0, 1.0, 5.0, None), (4.0, 1.0, 7.0, None)], df.schema))
    assert model.medians(even, ["a", "b", "c"]) == {"a": 2.5, "b": 1.0, "c": 6.0} and model.fit_imputer(df, ["d"]) == {"d": 0.0}


def test_folds_beyond_the_largest_groups(spark):
    df = spark.range(400).select((F.col("id") % 40).cast("string").alias("g"), "id")
    some = model.group_folds(df, "g", 4, most=10)
    assert some.count() == 400 and some.select("g", "fold").distinct().count() == 40 and {r["fold"] for r in some.select("fold").distinct().collect()} == {0, 1, 2, 3}
    split = model.group_split(df, "g")
    assert split.select("g", "test").distinct().count() == 40 and 40 < split.where("test").count() < 300


def test_sheets_hold_all_days(spark):
    d = date(2024, 1, 1)
    diary = spark.createDataFrame([(i, "s", d + timedelta(days=i), 79_200, 81_000, 25_200, 28_800, 2, "x") for i in range(16)], f"{DIARY}, wake_count int, note string")
    for c in ("day_sleep_count", "day_sleep_time", "alcohol_count", "alcohol_time", "caffeine_count", "caffeine_time", "sleep_quality", "rest_quality"):
        diary = diary.withColumn(c, F.lit(0))
    wide = datasets.diary_to_wide(diary.withColumn("sleeping_pill", F.lit(True)), spark.createDataFrame([(1, 3600, 3900)], "day_id long, start int, end int"))
    assert sorted(r["sheet"] for r in wide.collect()) == [0, 1, 2]
    assert sorted((r["day"], r["date"]) for r in datasets.diary_from_wide(wide).collect()) == [(i + 1, d + timedelta(days=i)) for i in range(16)]


def test_activity_index_equals_plain_filter(spark, sf_dir):
    """The registered query against the difference equation of the filter, window by window, in plain numbers."""
    from actispark.plans import motion

    def both_ways(x):
        b, a = signal.bandpass(25.0)
        n = len(a) - 1
        steady = np.linalg.solve(np.eye(n) - np.vstack([-a[1:], np.eye(n - 1, n)]).T, b[1:] - a[1:] * b[0])
        x = np.concatenate([2 * x[0] - x[10:0:-1], x, 2 * x[-1] - x[-2:-12:-1]])
        for _ in range(2):
            z, out = steady * x[0], []
            for v in x:
                y = b[0] * v + z[0]
                z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * y
                out.append(y)
            x = np.array(out)[::-1]
        return x[10:-10]

    rows = motion.days(spark, sf_dir).select("recording_id", "day_no", "ts", "line_no", "x", "y", "z").toPandas()
    want = {}
    for (rec, day), g in rows.groupby(["recording_id", "day_no"]):
        g = g.sort_values(["ts", "line_no"])
        for k in range(0, len(g) - 15, 15):
            w = g.iloc[k : k + 15]
            want[rec, day, w["ts"].iloc[0]] = math.sqrt(np.mean([both_ways(w[c].to_numpy()).var() for c in "xyz"]))
    got = {(r["recording_id"], r["day_no"], r["ts"]): r["activity_index"] for r in motion.activity_index(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_recording_to_nights(spark):
    """Two hours of 25 Hz samples, half an hour of movement and of stillness in turn; and the statistics of the night's index."""
    from actispark.operators import jobs

    n = 25 * 60 * 60 * 2
    i = F.col("id")
    moving = (F.floor(i / (25 * 1800)) % 2 == 0).cast("double")
    samples = spark.range(n).select(F.lit("r").alias("recording_id"), i.alias("line_no"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=(i / 25).cast("decimal(18,6)"))).alias("ts"), (moving * F.sin(i * 2.1)).alias("x"), F.lit(0.2).alias("y"), (1 - moving * F.cos(i / 300.0)).alias("z"), F.lit(30.0).alias("temp"))
    days = epochs.noon_days(samples, 25.0, 1.0)
    index, bins = signal.activity_index(days, 25.0), rest.arm_angle_bins(days, 25.0)
    recordings = spark.createDataFrame([("r", "s")], "recording_id string, subject string")
    got = jobs.nights_of_days(days, index, bins, recordings, 25.0, medians=12, blocks={"minimum_rest_block": 2, "allowed_rest_break": 2}).collect()
    assert len(got) == 1 and got[0]["subject"] == "s" and got[0]["available_hours"] == 2.0
    assert timedelta(minutes=25) < got[0]["sleep_end"] - got[0]["sleep_onset"] < timedelta(minutes=40) and got[0]["se"] > 50
    night = spark.createDataFrame([(7, "r", T0, T0 + timedelta(hours=2))], "night_id long, recording_id string, sleep_onset timestamp_ntz, sleep_end timestamp_ntz")
    row = jobs.night_features(index, night).first()
    assert row["night_id"] == 7 and row["ACTIVITY | MAX"] > row["ACTIVITY | MEAN"] > row["ACTIVITY | MIN"] >= 0


def test_correlations_need_three_pairs(spark):
    long = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 3.0), ("b", 2.0, 1.0), ("b", 3.0, 2.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "feature string, value double, covariate double")
    for method in ("pearson", "spearman", "kendall"):
        got = {r["feature"]: r["r"] for r in clinical.covariate_correlations(long, method).collect()}
        assert set(got) == {"b", "c"} and got["c"] is None
    assert {r["feature"]: r["r"] for r in clinical.covariate_correlations(long, "spearman").collect()}["b"] == -0.5


def test_feature_coverage(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", None if i == 0 else 1.0) for i in range(10)] + [("c", None if i < 2 else 1.0) for i in range(10)] + [("z", 0.0)] * 10
    got = {r["feature"]: r["drop_reason"] for r in clinical.feature_coverage(spark.createDataFrame(rows, "feature string, value double")).collect()}
    assert got == {"a": "", "b": "", "c": "coverage", "z": "all_zero"}


def brute_mcc(y, p, t):
    hit = p >= t
    tp, fp, tn, fn = ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 0)).sum(), (~hit & (y == 1)).sum())
    d = math.sqrt(float(tp + fp) * float(tp + fn) * float(tn + fp) * float(tn + fn))
    return (float(tp) * tn - float(fp) * fn) / d if d else 0.0


@pytest.mark.parametrize("seed", range(4))
def test_tuned_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    y, p = rng.integers(0, 2, 40), np.round(rng.random(40), seed + 1)
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(y, p, strict=True)], "k string, y_true int, y_prob double")
    got = evaluate.tune_threshold(df, ["k"], steps=100).first()
    mcc = [round(brute_mcc(y, p, i / 100 - 1e-12), 12) for i in range(100)]
    assert (round(got["threshold"] * 100), got["mcc"]) == (int(np.argmax(mcc)), pytest.approx(max(mcc)))


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3)], "k string, SLEEP int, SLEEP_PREDICTION double")
    assert {r["k"]: r["auc"] for r in evaluate.roc_auc(df, ["k"]).collect()} == {"a": 0.875, "b": None}


def test_score_report_without_valid_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 5, 0.3)], "file string, SLEEP int, SLEEP_PREDICTION double")
    got = {r["file"]: (r["n_samples"], r["status"], r["auc"]) for r in evaluate.score_report(df).collect()}
    assert got == {"a": (2, "ok", 1.0), "b": (0, "no_valid_rows", None), None: (2, "ok", 1.0)}


def test_wide_diary_round_trip(spark):
    d = date(2024, 1, 1)
    diary = spark.createDataFrame([(1, "s", d, 79_200, 81_000, 25_200, 28_800, 2, "x")], f"{DIARY}, wake_count int, note string")
    for c in ("day_sleep_count", "day_sleep_time", "alcohol_count", "alcohol_time", "caffeine_count", "caffeine_time", "sleep_quality", "rest_quality"):
        diary = diary.withColumn(c, F.lit(0))
    wide = datasets.diary_to_wide(diary.withColumn("sleeping_pill", F.lit(True)), spark.createDataFrame([(1, 3600, 3900)], "day_id long, start int, end int"))
    row = datasets.diary_from_wide(wide).first()
    assert (row["date"], row["sleep_time"], row["sleep_duration"], row["get_up_time"], row["wakes"], row["sleeping_pill"]) == (d, 79_200, 81_000, 28_800, "2; 01:00-01:05", True)
    assert [tuple(r) for r in datasets.parse_wake_intervals(spark.createDataFrame([(1, "2; 01:00-01:05; 01:00-; junk; 2:00")], "k int, wakes string"), ["k"]).orderBy("start").collect()] == [(1, 3600, 3600), (1, 7200, 7200)]


def test_subject_matrix_checks_columns(spark):
    df = spark.createDataFrame([("s", None, 2, 5.0), ("s", date(2024, 1, 1), 1, 4.0), (None, None, 3, 1.0)], "subject string, date date, row int, f double")
    assert datasets.subject_matrix(df, ["f"], [], 2).first().asDict() == {"subject": "s", "day1.f": 4.0, "day2.f": 5.0}
    assert datasets.subject_matrix(df, ["f"], []).columns == ["subject", "day1.f", "day2.f"]
    for f, most in (("g", 2), ("f", 1)):  # a column that isn't there, and more days than there may be
        with pytest.raises(ValueError):
            datasets.subject_matrix(df, [f], [], most)


def test_folds_and_model(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 6}", float(x), float(rng.random()), int(x > 0.5)) for i, x in enumerate(rng.random(600))]
    df = spark.createDataFrame(rows, "group string, `a.b` double, c double, SLEEP int")
    folds = model.group_folds(df, "group", 3)
    assert folds.select("group", "fold").distinct().count() == 6 and {r["count"] for r in folds.groupBy("fold").count().collect()} == {200}
    fitted = model.train_sleep_model(df, ["a.b", "c"], maxIter=5, maxDepth=2)
    scored = model.score_epochs(fitted, df)
    assert scored.select(F.avg(((F.col("SLEEP_PREDICTION") >= 0.5).cast("int") == F.col("SLEEP")).cast("int"))).first()[0] > 0.8
    assert scored.columns == [*df.columns, "SLEEP_PREDICTION"]


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, partitions):
    from actispark.plans import registry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = sorted(map(str, registry.QUERIES["a1_epoch_features"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == sorted(map(str, registry.QUERIES["a1_epoch_features"](spark, sf_dir).collect()))
