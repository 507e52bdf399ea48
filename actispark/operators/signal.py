"""Activity index of the band-passed signal, and a night's statistics of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actispark.functions.scalars import tkeo
from actispark.operators.epochs import sample_windows, vector_features


def bandpass(fs: float, low: float = 0.25, high: float = 12.0, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a Butterworth band-pass by the bilinear transform; high must be below fs / 2."""
    if high >= fs / 2:
        raise ValueError(f"{high} Hz needs more than {2 * high} samples a second")
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    w1, w2 = 4 * np.tan(np.pi * np.array([low, high]) / fs)
    half = poles * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2 + 0j)
    p = np.concatenate([half + root, half - root])
    gain = (w2 - w1) ** order * np.real(4.0**order / np.prod(4 - p))
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    return gain * np.real(np.poly(zeros)), np.real(np.poly((4 + p) / (4 - p)))


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed over the last axis, for all rows at once."""
    y, z = np.empty_like(x), np.concatenate([state, np.zeros((*state.shape[:-1], 1))], axis=-1)
    for t in range(x.shape[-1]):
        y[..., t] = b[0] * x[..., t] + z[..., 0]
        z[..., :-1] = b[1:] * x[..., t, None] + z[..., 1:] - a[1:] * y[..., t, None]
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray, pad: int = 10) -> np.ndarray:
    """x filtered forth and back over its last axis, with odd extensions of pad at both ends."""
    n = len(a) - 1
    companion = np.vstack([-a[1:], np.eye(n - 1, n)])
    zi = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    for _ in range(2):
        ext = _filter(b, a, ext, zi * ext[..., :1])[..., ::-1]
    return ext[..., pad:-pad]


def activity_index(samples: DataFrame, fs: float, window_s: int = 60, cut: tuple[float, float] = (0.25, 12.0), batch: int = 512) -> DataFrame:
    """recording_id, day_no, ts (of the window's first sample), activity_index: the root of the axes' mean variance in
    windows of window_s * fs samples of a day. Windows are rows of one matrix; a group is a few hundred windows."""
    size = int(window_s * fs)
    b, a = bandpass(fs, *cut)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["recording_id", "day_no", "window_no", "ts", "line_no"])
        first = rows.iloc[::size]
        x = rows[["x", "y", "z"]].to_numpy(float).reshape(len(first), size, 3).transpose(0, 2, 1)
        return first[["recording_id", "day_no", "ts"]].assign(activity_index=np.sqrt(zero_phase(b, a, x).var(-1).mean(-1)))

    at = sample_windows(samples, size).select("recording_id", "day_no", "ts", "line_no", "window_no", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz"])
    group = [F.col("recording_id"), F.col("day_no"), F.floor(F.col("window_no") / batch)]
    return at.groupBy(*group).applyInPandas(run, "recording_id string, day_no int, ts timestamp_ntz, activity_index double")


def night_signal_features(df: DataFrame, keys: list[str], value: str = "activity_index", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The 43 statistics of a night's activity index: those of an epoch's vector, and energy at its greatest and least."""
    energy = tkeo(df, keys, list(order), value).groupBy(*keys).agg(F.max("tkeo").alias("ACTIVITY | TKEO MAX"), F.min("tkeo").alias("ACTIVITY | TKEO MIN"), F.count(value).alias("_n"))
    energy = energy.select(*keys, *[F.when(F.col("_n") > 1, F.col(f"ACTIVITY | TKEO {m}")).alias(f"ACTIVITY | TKEO {m}") for m in ("MAX", "MIN")])
    return vector_features(df, keys, {"ACTIVITY": value}, order, night=True).join(energy, keys)
