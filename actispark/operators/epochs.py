"""Cutting samples into days, windows and epochs, and the statistics of an epoch's values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from actispark.functions.scalars import magnitude, z_angle

ORDER = ("ts", "line_no")


def filter_in_bed(samples: DataFrame, nights: DataFrame, most_nights: int = 200_000) -> DataFrame:
    """Samples strictly inside any window of nights(subject, lo, hi). Nights are broadcast if they are at most
    most_nights (a row is a name and two times: some MB); else both sides are joined by subject and day."""
    windows = nights.select(F.col("subject").alias("_s"), "lo", "hi")
    inside = (F.col("ts") > F.col("lo")) & (F.col("ts") < F.col("hi"))
    if windows.count() <= most_nights:
        return samples.join(F.broadcast(windows), (F.col("subject") == F.col("_s")) & inside, "left_semi")
    days = windows.withColumn("_d", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    return samples.join(days, (F.col("subject") == F.col("_s")) & (F.to_date("ts") == F.col("_d")) & inside, "left_semi")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def psg_epochs(samples: DataFrame, psg: DataFrame, seconds: int = 15) -> DataFrame:
    """Samples with the PSG row whose [ts, ts + seconds) they lie in (rows from the training start on): an equal join on
    the recording and a bucket of four epochs, then the range; only rows that reach over a bucket's end are in two. Equal PSG
    rows of a bucket are counted where the join needs them, meet the samples as one and are repeated behind it."""
    size, wide = seconds * 1_000_000, 4 * seconds * 1_000_000
    lo = _micros("epoch")
    rows = psg.select(F.col("recording_id").alias("_r"), F.col("ts").alias("epoch"), "sleep")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.floor(lo / wide), F.floor((lo + (size - 1)) / wide))))
    rows = rows.repartition("_r", "_b").groupBy("_r", "_b", "epoch", "sleep").agg(F.count("*").cast("int").alias("_n")).withColumn("_lo", lo)
    at = samples.withColumn("_t", _micros("ts"))
    on = (F.col("recording_id") == F.col("_r")) & (F.floor(F.col("_t") / wide) == F.col("_b")) & (F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_lo") + size)
    return at.join(rows, on).withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).drop("_r", "_b", "_lo", "_t", "_n", "_i")


def assign_epochs(df: DataFrame, seconds: int, anchor: list[str], label_offset: float = 0.0) -> DataFrame:
    """df with epoch: the start (plus label_offset) of the half-open window of seconds since the anchor group's first row.
    Groups' starts are few, so they come from an aggregate that is joined back and not from a window over all rows."""
    starts = df.groupBy(*anchor).agg(F.min("ts").alias("_start"))
    size = seconds * 1_000_000
    step = F.floor((_micros("ts") - _micros("_start")) / size) * size + round(label_offset * 1e6)
    return df.join(starts, anchor).withColumn("epoch", F.timestamp_micros((_micros("_start") + step).cast("long")).cast("timestamp_ntz")).drop("_start")


def reanchored_epochs(df: DataFrame, seconds: int, key: str = "recording_id", label_offset: float = 0.0, order: tuple[str, ...] = ORDER, chunk_hours: float = 1.0) -> DataFrame:
    """df with epoch: the start (plus label_offset) of its epoch, where an epoch ends with the first row that is seconds or
    more after its start and the row after that starts the next, whatever lies between.

    A recording is cut into chunks of time. What a chunk needs from those before it is the time that the running epoch waits
    for, so a chunk is a function from that time to its own last one; it depends on the chunk's first row at or after that
    time only, and is tabulated for the rows of its first seconds by doubling the links from each row to the next start. A
    row a chunk is then followed through each recording, and each chunk marks its epochs. No task holds a recording."""
    size = seconds * 1_000_000
    spare = {c.lower() for c in df.columns}
    if {"epoch", "_at", "_chunk", "_waits"} & spare:
        raise ValueError("columns epoch, _at, _chunk and _waits are made here")
    at = df.where(F.col("ts").isNotNull()).withColumn("_at", _micros("ts")).withColumn("_chunk", F.floor(F.col("_at") / round(chunk_hours * 3_600_000_000)))
    kind, by = df.schema[key].dataType.simpleString(), list(order)

    none = np.iinfo(np.int64).min  # waits for nothing: the next row starts an epoch

    def table_of(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["_at"].to_numpy())
        n = len(t)
        ends = np.searchsorted(t, t + size, side="left")  # the row that ends the epoch that starts here
        last = np.where(ends + 1 < n, ends + 1, np.arange(n))  # the next start, and by doubling the last one
        while (last[last] != last).any():
            last = last[last]
        after = np.where(ends[last] == n, t[last] + size, none)
        most = int(np.searchsorted(t, t[0] + size, side="left")) + 2  # rows an epoch from before can hand over to
        return pd.DataFrame({key: [group[0]], "_chunk": [group[1]], "times": [t[:most].tolist()], "after": [after[:most].tolist()], "final": [int(t[-1])]})

    def follow(group: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
        waits, out = none, []
        for c in chunks.sort_values("_chunk").itertuples(index=False):
            out.append((c[1], waits))
            times, after, final = np.asarray(c[2]), np.asarray(c[3]), c[4]
            if waits == none:
                waits = int(after[0])
            elif waits <= final:
                j = int(np.searchsorted(times, waits, side="left"))  # the row that ends the running epoch
                waits = int(after[j + 1]) if j + 1 < len(times) else none
        return pd.DataFrame(out, columns=["_chunk", "_waits"]).assign(**{key: [group[0]] * len(out)})[[key, "_chunk", "_waits"]]

    tables = at.select(key, "_chunk", "_at").groupBy(key, "_chunk").applyInPandas(table_of, f"`{key}` {kind}, _chunk long, times array<long>, after array<long>, final long")
    waits = tables.groupBy(key).applyInPandas(follow, f"`{key}` {kind}, _chunk long, _waits long")
    fields = StructType([*at.schema.fields, StructField("epoch", LongType())])

    def mark(group: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by, ignore_index=True, kind="stable")
        t, wait = rows["_at"].to_numpy(), int(entry["_waits"].iloc[0])
        starts, i = np.empty(len(t), np.int64), 0
        if wait != none:
            i = min(int(np.searchsorted(t, wait, side="left")) + 1, len(t))
            starts[:i] = wait - size
        while i < len(t):
            j = min(int(np.searchsorted(t, t[i] + size, side="left")) + 1, len(t))
            starts[i:j] = t[i]
            i = j
        return rows.assign(epoch=starts)

    marked = at.groupBy(key, "_chunk").cogroup(waits.groupBy(key, "_chunk")).applyInPandas(mark, fields)
    return marked.withColumn("epoch", F.timestamp_micros(F.col("epoch") + round(label_offset * 1e6)).cast("timestamp_ntz")).drop("_at", "_chunk")


def decimate(df: DataFrame, keys: list[str], factor: int | Column, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows 0, factor, 2 factor ... of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % factor == 0).drop("_i")


def with_noon(df: DataFrame) -> DataFrame:
    """df with noon: the start of the noon-to-noon day a row lies in."""
    return df.withColumn("noon", F.window("ts", "24 hours", "24 hours", "12 hours")["start"])


def noon_days(samples: DataFrame, fs: float, minimum_hours: float = 6.0) -> DataFrame:
    """samples with day_no: the noon-to-noon days of at least minimum_hours of rows, numbered 1, 2 ... in a recording.
    Days are counted first and the few counted days joined back, so rows are not windowed."""
    at = with_noon(samples)
    days = at.groupBy("recording_id", "noon").agg(F.count("*").alias("day_rows")).where(F.col("day_rows") / (fs * 3600) >= minimum_hours)
    days = days.withColumn("day_no", F.row_number().over(Window.partitionBy("recording_id").orderBy("noon")))
    return at.join(days, ["recording_id", "noon"]).drop("noon")


def sample_windows(df: DataFrame, size: int, keys: tuple[str, ...] = ("recording_id", "day_no"), order: tuple[str, ...] = ORDER) -> DataFrame:
    """df with window_no: windows of size rows; the last one of a group is never used (k size < n - size)."""
    w = Window.partitionBy(*keys)
    at = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at = at.withColumn("window_no", F.floor(F.col("_i") / size).cast("int"))
    return at.where(F.col("window_no") * size < F.col("_n") - size).drop("_i", "_n")


def majority_label(df: DataFrame, keys: list[str], flag: str = "sleep") -> DataFrame:
    """1 where more than half of a group's rows are, else 0."""
    return df.groupBy(*keys).agg((F.sum(flag) > F.count(flag) - F.sum(flag)).cast("int").alias("label"))


# --- statistics of a vector ------------------------------------------------------------------------------------------

#: The percentiles that are reported.
PERCENTILES = (1, 5, 10, 20, 25, 30, 40, 60, 70, 75, 80, 90, 95, 99)
NIGHT_PERCENTILES = (1, 5, 10, 20, 80, 90, 95, 99)
_ALL = (*PERCENTILES, 50)
TRIMS = (10, 20, 30, 40)


def statistic_names(night: bool = False) -> list[str]:
    """The statistics of a vector in their order: those of an epoch's signal, or of a night's activity index."""
    kinds = ["", "INTERQUARTILE ", "INTERDECILE ", "INTERPERCENTILE "]
    names = ["MAX", "MIN", "RELATIVE POSITION OF MAX", "RELATIVE POSITION OF MIN", "RANGE", "RELATIVE RANGE", "RELATIVE VARIATION RANGE"]
    names += [f"{r}{k}RANGE" for k in kinds[1:] for r in ("", "RELATIVE ")] + ["STUDENTIZED RANGE", "MEAN"] + ["HARMONIC MEAN"] * night
    names += [f"MEAN EXCLUDING OUTLIERS ({p})" for p in TRIMS] + ["MEDIAN", "MODE", "VARIANCE", "STANDARD DEVIATION", "MEDIAN ABSOLUTE DEVIATION", "RELATIVE STANDARD DEVIATION", "INDEX OF DISPERSION", "KURTOSIS", "SKEWNESS", "PEARSONS 1ST", "PEARSONS 2ND"]
    return names + [f"PERCENTILE {p}" for p in (NIGHT_PERCENTILES if night else PERCENTILES)] + ["ENTROPY", "MODULATION"] * night


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def vector_statistics(v: np.ndarray, night: bool = False) -> list[float | None]:
    """The statistics of v, in the order of statistic_names; vectors of length 1 or less have none."""
    n = len(v)
    if n <= 1:
        return [None] * len(statistic_names(night))
    s = np.sort(v)
    lo, hi, mean = float(s[0]), float(s[-1]), float(v.mean())
    d = v - mean if hi > lo else np.zeros(n)  # the mean of equal values may be off by rounding
    m2 = float((d * d).mean())
    var = m2 * n / (n - 1)
    sd, span = var**0.5, abs(hi - lo)
    q = dict(zip(_ALL, np.percentile(s, _ALL).tolist(), strict=True))
    values, first, count = np.unique(v, return_index=True, return_counts=True)
    often = count == count.max()
    mode = float(values[often][first[often].argmin()])
    out = [hi, lo, int(v.argmax()) / n, int(v.argmin()) / n, span, _ratio(span, hi), _ratio(span, mean)]
    for a, b in ((75, 25), (90, 10), (99, 1)):
        out += [q[a] - q[b], _ratio(q[a] - q[b], hi)]
    out += [_ratio(span, var), mean]
    if night:
        out.append(None if lo < 0 else 0.0 if lo == 0 else n / float((1 / v).sum()))
    for p in TRIMS:
        k = math.floor(n * (p / 100))
        out.append(float(s[k : n - k].mean()) if n > 2 * k else None)
    out += [q[50], mode, var, sd, float(np.median(np.abs(s - q[50]))), _ratio(sd, mean), _ratio(var, mean)]
    out += [float((d**4).mean()) / m2**2 - 3, float((d**3).mean()) / m2**1.5] if m2 else [None, None]
    out += [_ratio(3 * (mean - mode), sd), _ratio(3 * (mean - q[50]), sd)] + [q[p] for p in (NIGHT_PERCENTILES if night else PERCENTILES)]
    if night:
        total = float(v.sum())
        share = v / total if total else np.zeros(n)
        share = share[share > 0]
        out += [-float((share * np.log(share)).sum()), _ratio(span, hi + lo)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which the rows are sorted by."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held:
            t = pa.concat_tables([held.pop(), t])
        changed = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            a, b = t[k].slice(0, t.num_rows - 1), t[k].slice(1)
            differ = pc.or_kleene(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            changed |= differ.to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), t.num_rows]
        for x, y in zip(edges[:-2], edges[1:-1], strict=True):
            yield t.slice(x, y - x)
        held.append(t.slice(edges[-2]))
    yield from held


def vector_features(df: DataFrame, keys: list[str], signals: dict[str, str], order: tuple[str, ...] = ORDER, night: bool = False) -> DataFrame:
    """One row per group of keys with the statistics of each signal (name -> column). Rows are dealt by the keys and sorted
    once; a task goes through its groups, an epoch's or a night's rows each, and holds one of them at a time."""
    columns = [f"{name} | {stat}" for name in signals for stat in statistic_names(night)]
    schema = StructType([*(df.schema[k] for k in keys), *(StructField(c, DoubleType()) for c in columns)])
    rows = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(signals.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, found = [], []

        def batch() -> pa.RecordBatch:
            own = pa.concat_tables(first).combine_chunks()
            stats = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([*(own[k].chunk(0) for k in keys), *stats], [*keys, *columns])

        for t in _groups(batches, keys):
            first.append(t.select(keys).slice(0, 1))
            vectors = [t[f"_v{i}"].drop_null().to_numpy() for i in range(len(signals))]
            found.append([x for v in vectors for x in vector_statistics(v, night)])
            if len(first) == 1000:
                yield batch()
                first, found = [], []
        if first:
            yield batch()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))]).mapInArrow(run, schema)


def epoch_features(epochs: DataFrame, keys: list[str], signals: tuple[str, ...] = ("magnitude", "z_angle", "temperature")) -> DataFrame:
    """The 44 statistics of each signal per epoch; magnitude and angle come from x, y, z, temperature from temp."""
    made = {"magnitude": magnitude(), "z_angle": z_angle(), "temperature": F.col("temp")}
    at = reduce(lambda d, s: d if s in d.columns else d.withColumn(s, made[s]), signals, epochs)
    return vector_features(at, keys, {s.upper(): s for s in signals})
