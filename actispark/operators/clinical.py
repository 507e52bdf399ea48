"""Clinical tables: diagnoses, day statistics, feature screening, covariates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actispark.functions.scalars import DIAGNOSES, safe_div
from actispark.sources import store

#: The diagnosis codes on the positive and the negative side of each comparison.
SCENARIOS = (((3,), (0,)), ((3, 2), (0,)), ((2,), (0,)), ((3, 2, 1), (0,)), ((0,), (1,)))


def attach_diagnosis(df: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with its subjects' diagnosis_code, and the subjects of df that have none."""
    codes = subjects.where(F.col("diagnosis_code").isNotNull()).select(F.col("code").alias("subject"), "diagnosis_code")
    return df.join(codes, "subject", "left").where(F.col("diagnosis_code").isNotNull()), df.select("subject").distinct().join(codes, "subject", "left_anti")


def _codes(sheet: DataFrame) -> DataFrame:
    code = F.col("code").cast("string").try_cast("double")
    return sheet.where(F.col("code").isNotNull()).select(F.trim(F.col("subject").cast("string")).alias("subject"), F.when(code == F.floor(code), code.cast("int")).alias("diagnosis_code"), "row")


def diagnosis_updates(subjects: DataFrame, sheet: DataFrame) -> DataFrame:
    """subject, new_code, old_code, action of sheet(row, subject, code): the last valid row of a subject counts; action is
    update, same or missing (no such subject)."""
    valid = _codes(sheet).where(F.col("diagnosis_code").isin(*DIAGNOSES) & (F.coalesce("subject", F.lit("")) != ""))
    last = valid.groupBy("subject").agg(F.max_by("diagnosis_code", "row").alias("new_code"))
    known = subjects.select(F.col("code").alias("subject"), F.col("diagnosis_code").alias("old_code"), F.lit(True).alias("_k"))
    action = F.when(F.col("_k").isNull(), "missing").when(F.col("old_code").eqNullSafe(F.col("new_code")), "same").otherwise("update")
    return last.join(known, "subject", "left").select("subject", "new_code", "old_code", action.alias("action"))


def diagnosis_summary(subjects: DataFrame, sheet: DataFrame) -> DataFrame:
    """One row: rows with a code, unique subjects, updated, missing subjects, invalid rows."""
    ok = F.coalesce(F.col("diagnosis_code").isin(*DIAGNOSES), F.lit(False)) & (F.coalesce("subject", F.lit("")) != "")
    counts = _codes(sheet).agg(F.count("*").alias("rows"), F.count_if(~ok).alias("invalid_rows"))
    per = diagnosis_updates(subjects, sheet).agg(F.count("*").alias("unique_subjects"), F.count_if(F.col("action") == "update").alias("updated"), F.count_if(F.col("action") == "missing").alias("missing_subjects"))
    return counts.crossJoin(per)  # one row each


def with_diagnoses(subjects: DataFrame, updates: DataFrame) -> DataFrame:
    """subjects with the new codes of updates, as diagnosis_updates gives them; columns stay as they are."""
    new = updates.where(F.col("action") == "update").select(F.col("subject").alias("_s"), "new_code")
    at = subjects.join(new, F.col("code") == F.col("_s"), "left")
    kept = F.coalesce(F.col("new_code"), F.col("diagnosis_code")).cast(subjects.schema["diagnosis_code"].dataType).alias("diagnosis_code")
    return at.select(*[kept if c == "diagnosis_code" else F.col(f"`{c}`") for c in subjects.columns])


def import_diagnoses(path: str, sheet: DataFrame) -> DataFrame:
    """Brings the subjects table in path (see store) up to sheet and returns diagnosis_summary's row of what was done. A new
    version is written only if a code changes, so a second run changes nothing, and a run that failed is run again."""
    spark = sheet.sparkSession
    subjects = store.current(spark, path)
    if subjects is None:
        raise FileNotFoundError(path)
    done = diagnosis_summary(subjects, sheet).collect()  # one row
    if done[0]["updated"]:
        store.put_version(with_diagnoses(subjects, diagnosis_updates(subjects, sheet)), path)
    return spark.createDataFrame(done)


def quantile(ordered: Column, q: float) -> Column:
    """The q quantile of a sorted array, between its neighbours by distance."""
    place = (F.size(ordered) - 1) * q
    low = F.floor(place).cast("int")
    at = lambda i: F.get(ordered, i)
    return at(low) + (at(F.least(low + 1, F.size(ordered) - 1)) - at(low)) * (place - low)


def day_statistics(long: DataFrame, keys: tuple[str, ...] = ("subject", "feature")) -> DataFrame:
    """Across a subject's days, of long(subject, feature, value): sd (population), mad, range, iqr and cv (null for mean 0).
    One aggregation; a subject's days are few, so the order statistics come from its sorted values."""
    v = F.col("value").cast("double")
    once = long.groupBy(*keys).agg(F.stddev_pop(v).alias("sd"), F.avg(v).alias("_a"), F.array_sort(F.collect_list(v)).alias("_s"))
    once = once.withColumn("_d", F.array_sort(F.transform("_s", lambda x: F.abs(x - quantile(F.col("_s"), 0.5)))))
    s = F.col("_s")
    return once.select(*keys, "sd", quantile(F.col("_d"), 0.5).alias("mad"), (F.element_at(s, -1) - F.element_at(s, 1)).alias("range"), (quantile(s, 0.75) - quantile(s, 0.25)).alias("iqr"), safe_div("sd", "_a").alias("cv"))


def inconsistent_identity(df: DataFrame, identity: list[str], subject: str = "subject") -> DataFrame:
    """subject, column, n of identity columns with several values (null is one) in a subject."""
    text = df.select(subject, *[F.col(f"`{c}`").cast("string").alias(c) for c in identity]).unpivot([subject], identity, "column", "value")
    n = F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))
    return text.groupBy(subject, "column").agg(n.alias("n")).where(F.col("n") > 1)


def class_overview(df: DataFrame) -> DataFrame:
    """code, label, n for every diagnosis code, zeros and missing ones with them."""
    codes = df.sparkSession.createDataFrame([(k, v) for k, v in DIAGNOSES.items()] + [(None, "missing")], "code int, label string")
    counts = df.groupBy(F.col("diagnosis_code").alias("_c")).count()
    return codes.join(counts, F.col("code").eqNullSafe(F.col("_c")), "left").select("code", "label", F.coalesce("count", F.lit(0)).alias("n"))


def scenario_dataset(df: DataFrame, positive: tuple[int, ...], negative: tuple[int, ...], code: str = "diagnosis_code") -> DataFrame:
    """Rows of either side with target 1 (positive) or 0."""
    c = F.col(code)
    return df.where(c.isin(*positive, *negative)).withColumn("target", c.isin(*positive).cast("int"))


def feature_coverage(long: DataFrame, threshold: float = 0.9, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """feature, non_missing_ratio, kept, drop_reason: coverage below threshold, or all zero."""
    v = F.col("value")
    per = long.groupBy(*keys).agg(F.avg(v.isNotNull().cast("double")).alias("non_missing_ratio"), F.coalesce(F.sum(F.abs(v)), F.lit(0.0)).alias("_s"))
    reason = F.when(F.col("non_missing_ratio") < threshold, "coverage").when(F.col("_s") == 0, "all_zero").otherwise("")
    return per.select(*keys, "non_missing_ratio", (reason == "").alias("kept"), reason.alias("drop_reason"))


# --- covariates -------------------------------------------------------------------------------------------------------


def control_covariates(df: DataFrame, key: str | list[str], features: list[str], covariates: tuple[str, str] = ("gender", "age")) -> DataFrame:
    """key (or keys), feature, residual: what least squares on the covariates leaves of each feature, nulls counted as 0.
    The table is read for the columns' means, for sums of products around them (by blocks of rows, all pairs at once), and
    for the residuals; then there are three equations a feature on its few sums, and where the covariates are constant or
    bound to each other, the solution of least norm."""
    keys = [key] if isinstance(key, str) else key
    zero = df.select(*keys, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in (*covariates, *features)])
    x, y = list(covariates), [*covariates, *features]
    table = zero.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(x)], *[F.col(f"`{c}`").alias(f"y{i}") for i, c in enumerate(y)])
    means, sums = _pair_sums(table, len(x), len(y))
    at = {tuple(map(int, r["feature"].split(":"))): r for r in sums.collect()}  # a row for a covariate and a feature

    def left(i: int, j: int) -> float:
        r = at[i, j]
        return r["sxy"] - r["sx"] * r["sy"] / r["n"] if r["n"] else 0.0

    gg, aa, ga = left(0, 0), left(1, 1), left(0, 1)
    det, slopes = gg * aa - ga * ga, {}
    for j, f in enumerate(features, 2):
        gv, av = left(0, j), left(1, j)
        if det > 1e-10 * gg * aa:
            slopes[f] = (gv * aa - av * ga) / det, (av * gg - gv * ga) / det
        else:  # least norm: along the only direction that varies
            slopes[f] = (gv / (gg + aa), av / (gg + aa)) if gg + aa > 0 else (0.0, 0.0)
    middle = dict(zip(y, means[len(x) :].tolist(), strict=True))
    d = {c: F.col(f"`{c}`") - middle[c] for c in y}
    g, a = covariates
    residual = lambda f: d[f] - slopes[f][0] * d[g] - slopes[f][1] * d[a]
    return zero.select(*[F.col(f"`{k}`") for k in keys], *[residual(f).alias(f) for f in features]).unpivot(keys, features, "feature", "residual")


#: Bins of a column of a feature at most, rows of a bin about, and rows beyond which a bin is cut into bins again.
RANK_BINS, BIN_ROWS, BIN_MOST = 256, 200_000, 1_000_000


def _bins_of(counts: DataFrame, *cols: str) -> dict[str, Column]:
    """For each of cols the column that tells which range of it a row of counts(feature, ...) lies in. The ranges are cut at
    quantiles of the feature's rows, found in one job (at most RANK_BINS numbers a feature and column), as many as rows ask
    for; so all that use them see the same."""
    marks = F.array(*[F.lit(i / RANK_BINS) for i in range(1, RANK_BINS)])
    found = counts.groupBy("feature").agg(F.count("*").alias("n"), *[F.percentile_approx(c, marks, 2000).alias(f"q{i}") for i, c in enumerate(cols)]).collect()

    def binned(col: str, place: int) -> Column:
        edges = {r["feature"]: np.unique(np.asarray(r[f"q{place}"], float)[:: max(1, RANK_BINS // max(1, -(-r["n"] // BIN_ROWS)))] if r["n"] > BIN_ROWS else np.empty(0)) for r in found}

        @F.pandas_udf("int")
        def bin_of(feature: pd.Series, value: pd.Series) -> pd.Series:
            out = np.zeros(len(value), np.int32)
            for f in feature.unique():
                own = (feature == f).to_numpy()
                out[own] = np.searchsorted(edges[f], value.to_numpy(float)[own], side="left")
            return pd.Series(out)

        return bin_of("feature", F.col(col).cast("double"))

    return {c: binned(c, i) for i, c in enumerate(cols)}


def average_ranks(counts: DataFrame, col: str, out: str, bin_: Column | None = None) -> DataFrame:
    """feature, col, out: the mean rank of each distinct value of col among all pairs of its feature, from
    counts(feature, col, c). Running sums go within bins of the value, then over the bins."""
    per = counts.groupBy("feature", col).agg(F.sum("c").alias("c"))
    per = per.withColumn("_b", bin_ if bin_ is not None else _bins_of(per, col)[col])
    bins = per.groupBy("feature", "_b").agg(F.sum("c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("feature", "_b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = per.withColumn("_i", inner).join(bins.withColumn("_p", before).drop("_n"), ["feature", "_b"])
    return at.select("feature", col, (F.col("_p") + F.col("_i") + (F.col("c") + 1) / 2.0).alias(out))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + k * d) or 1e-300)
        c = (1 + k / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_test_p(r: float, n: int) -> float:
    """Two-sided p value of a correlation r of n pairs by Student's t."""
    if n <= 2 or not abs(r) <= 1:
        return math.nan
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - r * r))


def crossings(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """How many pairs of entries, weighted by their counts c, have the smaller x with the greater y. Two x differ first in
    one of the bits of their ranks; for each bit, entries without it are sorted by y within those that agree above it, and
    entries with it look up how many of them are greater."""
    x, y = (np.unique(a, return_inverse=True)[1].astype(np.int64) for a in (x, y))
    c, width, total = c.astype(float), int(y.max(initial=0)) + 1, 0.0
    for bit in range(int(x.max(initial=0)).bit_length()):
        above, upper = x >> (bit + 1), (x >> bit & 1).astype(bool)
        key = above * width + y
        low = np.argsort(key[~upper], kind="stable")
        sums = np.concatenate(([0.0], np.cumsum(c[~upper][low])))
        ordered = key[~upper][low]
        total += (c[upper] * (sums[np.searchsorted(ordered, (above[upper] + 1) * width)] - sums[np.searchsorted(ordered, key[upper], "right")])).sum()
    return total


def inversions_up_to(n: int, k: int) -> int:
    """How many orders of n things have at most k inversions: the coefficients of the product of 1 + q + ... + q^(i-1)."""
    ways = np.ones(1, dtype=object)
    for i in range(2, n + 1):
        ways = np.convolve(ways, np.ones(i, dtype=object))
    return int(ways[: k + 1].sum())


def tau_b(n: int, crossed: float, tied: tuple[float, float, float], sums: tuple[float, float, float, float] | None = None) -> tuple[float, float]:
    """Kendall's tau-b and its two-sided p value from the number of pairs n, the crossed ones, those tied in x, in y, and in
    both, and for the p value with ties the sums of t(t-1)(t-2) and t(t-1)(2t+5) over the groups of equal x, then y.
    Without ties and for up to 33 things p is exact; else S is taken as normal with the variance of Kendall (Rank
    Correlation Methods, 1970): (n(n-1)(2n+5) - Sx2 - Sy2) / 18 + Sx1 Sy1 / (9n(n-1)(n-2)) + 2 Tx Ty / (n(n-1))."""
    pairs, (in_x, in_y, in_both) = n * (n - 1) / 2, tied
    if pairs in (in_x, in_y):
        return math.nan, math.nan
    s = pairs - in_x - in_y + in_both - 2 * crossed
    tau = min(1.0, max(-1.0, s / math.sqrt((pairs - in_x) * (pairs - in_y))))
    if not in_x and not in_y and n <= 33:
        k = int(min(crossed, pairs - crossed))
        return tau, 1.0 if 2 * k >= pairs else min(1.0, 2 * inversions_up_to(n, k) / math.factorial(n))
    x1, x2, y1, y2 = sums
    variance = (n * (n - 1) * (2 * n + 5) - x2 - y2) / 18 + 2 * in_x * in_y / (n * (n - 1)) + (x1 * y1 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return tau, math.erfc(abs(s) / math.sqrt(2 * variance))


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """tau_b of two short columns."""
    (tx, t_x, s_x), (ty, t_y, s_y) = ((t, (t * (t - 1) / 2).sum(), ((t * (t - 1) * (t - 2)).sum(), (t * (t - 1) * (2 * t + 5)).sum())) for t in (np.unique(a, return_counts=True)[1].astype(float) for a in (x, y)))
    both = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].astype(float)
    return tau_b(len(x), crossings(x, y, np.ones(len(x))), (t_x, t_y, (both * (both - 1) / 2).sum()), (*s_x, *s_y))


def _crossed(counts: DataFrame) -> DataFrame:
    """feature, crossed: the crossed pairs of counts(feature, x, y, c). Values are dealt into bins; pairs of different bins in
    both come from the bins' counts, others from within one bin of x, or of y. A bin of one value has none, one of more than
    BIN_MOST rows is cut into bins again as a feature of its own, and each other is a bounded group."""
    schema, parts = "feature string, crossed double", []
    level = counts.select(F.col("feature").alias("_of"), F.col("feature"), "x", "y", "c")

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [key[0]], "crossed": [crossings(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["c"].to_numpy())]})

    def between(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((RANK_BINS, RANK_BINS))
        m[rows["bx"], rows["by"]] = rows["c"]
        behind = np.zeros_like(m)  # what lies in later bins of x and earlier ones of y
        behind[:-1, 1:] = np.cumsum(np.cumsum(m[::-1], 0)[::-1], 1)[1:, :-1]
        return pd.DataFrame({"feature": [key[1]], "crossed": [(m * behind).sum()]})

    while True:
        bins = _bins_of(level, "x", "y")
        at = level.withColumns({"bx": bins["x"], "by": bins["y"]})
        cells = at.groupBy("feature", "_of", "bx", "by").agg(F.sum("c").alias("c"))
        parts.append(cells.groupBy("feature", "_of").applyInPandas(between, schema))
        # within a bin of x pairs differ in y anyhow; within one of y, those of one bin of x are counted already
        within_x = at.select("_of", F.concat_ws("/", "feature", F.lit("x"), "bx").alias("feature"), "x", "y", "c")
        within_y = at.groupBy("_of", F.concat_ws("/", "feature", F.lit("y"), "by").alias("feature"), F.col("bx").cast("double").alias("x"), "y").agg(F.sum("c").alias("c"))
        both = within_x.unionByName(within_y)
        sizes = both.groupBy("feature").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 < x1 and y0 < y1").select("feature", "n")
        large = [r["feature"] for r in sizes.where(F.col("n") > BIN_MOST).collect()]  # few: each has BIN_MOST rows
        small = both.join(F.broadcast(sizes.where(F.col("n") <= BIN_MOST).select("feature")), "feature", "left_semi")  # names of bins
        parts.append(small.groupBy("_of", "feature").applyInPandas(inside, schema))
        if not large:
            return reduce(DataFrame.unionByName, parts).groupBy("feature").agg(F.sum("crossed").alias("crossed"))
        level = both.join(F.broadcast(counts.sparkSession.createDataFrame([(f,) for f in large], "feature string")), "feature", "left_semi").select("_of", "feature", "x", "y", "c")


def _kendall(pairs: DataFrame, digits: int) -> DataFrame:
    counts = pairs.groupBy("feature", F.col("value").cast("double").alias("x"), F.col("covariate").cast("double").alias("y")).agg(F.count("*").alias("c"))
    t = F.col("t").cast("double")

    def ties(col: str) -> DataFrame:
        per = counts.groupBy("feature", col).agg(F.sum("c").alias("t"))
        return per.groupBy("feature").agg(F.sum(t * (t - 1) / 2).alias(f"t{col}"), F.sum(t * (t - 1) * (t - 2)).alias(f"{col}1"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{col}2"))

    c = F.col("c").cast("double")
    both = counts.groupBy("feature").agg(F.sum("c").alias("n"), F.sum(c * (c - 1) / 2).alias("txy")).where(F.col("n") >= 3)
    rows = both.join(ties("x"), "feature").join(ties("y"), "feature").join(_crossed(counts), "feature")  # a row a feature

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [tau_b(int(r.n), r.crossed, (r.tx, r.ty, r.txy), (r.x1, r.x2, r.y1, r.y2)) for r in b.itertuples()]
            clean = lambda v: None if math.isnan(v) else round(v, digits)
            yield pd.DataFrame({"feature": b["feature"], "n": b["n"], "r": [clean(r) for r, _ in found], "p": [clean(p) for _, p in found]})

    return rows.mapInPandas(run, "feature string, n long, r double, p double")


def _with_p(digits: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # on a row a pair
        for b in batches:
            p = [None if pd.isna(r) else round(t_test_p(min(1.0, max(-1.0, r)), int(n)), digits) for r, n in zip(b["r"], b["n"], strict=True)]
            yield b.assign(p=[None if v is None or math.isnan(v) else v for v in p], r=b["r"].round(digits))

    return run


def covariate_correlations(long: DataFrame, method: str = "pearson", digits: int = 4) -> DataFrame:
    """feature, n, r, p (rounded) of long(feature, value, covariate) over pairs without nulls, of three pairs or more. Ranks
    and crossed pairs come from counts of distinct pairs and bins of values, so no task holds a feature."""
    pairs = long.where(F.col("value").isNotNull() & F.col("covariate").isNotNull())
    if method == "kendall":
        return _kendall(pairs, digits)
    x, y, c = F.col("value").cast("double"), F.col("covariate").cast("double"), F.lit(1)
    if method == "spearman":
        counts = pairs.groupBy("feature", "value", "covariate").agg(F.count("*").alias("c"))
        bins = _bins_of(counts, "value", "covariate")
        pairs = counts.join(average_ranks(counts, "value", "_x", bins["value"]), ["feature", "value"]).join(average_ranks(counts, "covariate", "_y", bins["covariate"]), ["feature", "covariate"])
        x, y, c = F.col("_x"), F.col("_y"), F.col("c")
    means = pairs.groupBy("feature").agg((F.sum(x * c) / F.sum(c)).alias("_mx"), (F.sum(y * c) / F.sum(c)).alias("_my"))
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    sums = pairs.join(F.broadcast(means), "feature").groupBy("feature").agg(F.sum(c).alias("n"), F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"))
    r = safe_div("xy", F.sqrt(F.col("xx") * F.col("yy")))  # null for a constant

    return sums.where(F.col("n") >= 3).select("feature", "n", r.alias("r")).mapInPandas(_with_p(digits), "feature string, n long, r double, p double")


def all_correlations(df: DataFrame, features: list[str], covariates: list[str], method: str = "pearson", digits: int = 4) -> DataFrame:
    """covariate, feature, n, r, p of every feature with every covariate, over the rows where both are numbers. Pearson's sums
    are products of matrices, a block of rows at a time, so the table is read once (and once for the columns' means, from
    which the sums are taken) however many pairs there are; ranks go by pairs in one long table."""
    names = {f"{i}:{j}": (c, f) for i, c in enumerate(covariates) for j, f in enumerate(features)}
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    if method == "pearson":
        got = _pearson_blocks(df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(covariates)], *[number(f).alias(f"y{j}") for j, f in enumerate(features)]), len(covariates), len(features), digits)
    else:
        pair = lambda i, j: F.struct(F.lit(f"{i}:{j}").alias("feature"), number(features[j]).alias("value"), number(covariates[i]).alias("covariate"))
        got = covariate_correlations(df.select(F.inline(F.array(*[pair(i, j) for i in range(len(covariates)) for j in range(len(features))]))), method, digits)
    label = df.sparkSession.createDataFrame([(k, c, f) for k, (c, f) in names.items()], "_k string, covariate string, _f string")
    return got.join(F.broadcast(label), F.col("feature") == F.col("_k")).select("covariate", F.col("_f").alias("feature"), "n", "r", "p")  # a row a pair


def _pair_sums(table: DataFrame, n_x: int, n_y: int) -> tuple[np.ndarray, DataFrame]:
    """The means of columns x0 ... and y0 ..., and feature (numbers i:j), n, sx, sy, sxx, syy, sxy: sums around the means over
    the rows where xi and yj are numbers. A row a task and pair is summed up."""
    means = np.array([v or 0.0 for v in table.agg(*[F.avg(c) for c in table.columns]).first()])
    kinds = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, n_x, n_y))
        for b in batches:
            for a in range(0, len(b), 4096):
                v = b.iloc[a : a + 4096].to_numpy(float) - means
                known = np.isfinite(v)
                v, known = np.where(known, v, 0.0), known.astype(float)
                (x, y), (mx, my) = (np.split(m, [n_x], axis=1) for m in (v, known))
                total += np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
        i, j = np.divmod(np.arange(n_x * n_y), n_y)
        yield pd.DataFrame({"feature": [f"{a}:{b}" for a, b in zip(i, j, strict=True)]} | {k: total[m].ravel() for m, k in enumerate(kinds)})

    return means, table.mapInPandas(block, "feature string, " + ", ".join(f"{k} double" for k in kinds)).groupBy("feature").agg(*[F.sum(k).alias(k) for k in kinds])


def _pearson_blocks(table: DataFrame, n_x: int, n_y: int, digits: int) -> DataFrame:
    """feature (numbers i:j), n, r, p of columns x0 ... and y0 ..."""
    _, sums = _pair_sums(table, n_x, n_y)
    n = F.col("n")
    left = lambda a, b, both: F.greatest(F.col(both) - F.col(a) * F.col(b) / n, F.lit(0.0))
    xx, yy = left("sx", "sx", "sxx"), left("sy", "sy", "syy")
    # what rounding leaves of a constant isn't a spread
    flat = (xx <= 1e-12 * F.col("sxx")) | (yy <= 1e-12 * F.col("syy"))
    r = F.when(~flat, safe_div(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(xx * yy)))
    return sums.where(n >= 3).select("feature", n.cast("long").alias("n"), r.alias("r")).mapInPandas(_with_p(digits), "feature string, n long, r double, p double")
