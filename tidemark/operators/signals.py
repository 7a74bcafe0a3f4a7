"""Spectra, wavelet features, angular fields and scaling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X
from ..functions.wavelets import decomposition
from ..plans.series import IDX, SeriesSpec, index_rows, null_safe_join
from ..plans.stats import SMALL_GROUP, column_quantiles, one_row
from .windows import sliding_windows

DOUBLES = T.ArrayType(T.DoubleType())


def _taper(kind: str, n: int) -> np.ndarray:
    t = np.arange(n)
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * t / n)
    if kind == "tukey":  # a quarter of the window is tapered, periodic form
        edge = 0.25 * n / 2
        rise = 0.5 * (1 + np.cos(np.pi * (t / edge - 1)))
        fall = 0.5 * (1 + np.cos(np.pi * ((n - t) / edge - 1)))
        return np.where(t < edge, rise, np.where(t > n - edge, fall, 1.0))
    return np.ones(n)


def power_density(values: Column, size: int, taper: str = "hann") -> Column:
    """One-sided power spectral density (unit sampling rate) of mean-removed, tapered windows."""
    w = _taper(taper, size)

    @F.pandas_udf(DOUBLES)
    def density(batch: pd.Series) -> pd.Series:
        block = np.stack(batch.to_numpy())
        block = (block - block.mean(axis=1, keepdims=True)) * w
        power = np.abs(np.fft.rfft(block, axis=1)) ** 2 / (w ** 2).sum()
        power[:, 1:-1 if size % 2 == 0 else None] *= 2
        return pd.Series(list(power))

    return density(values)


def welch(df: DataFrame, spec: SeriesSpec, size: int = 256) -> DataFrame:
    """Mean power density over half-overlapping Hann segments, per frequency."""
    seg = sliding_windows(df, spec, size, size // 2).select(*spec.keys, power_density(F.col("values"), size).alias("p"))
    rows = seg.select(*spec.keys, F.posexplode("p").alias("bin", "power"))
    return rows.groupBy(*spec.keys, "bin").agg((F.first("bin") / size).alias("frequency"), F.avg("power").alias("density"), F.count(F.lit(1)).alias("segments"))


def spectrogram(df: DataFrame, spec: SeriesSpec, size: int = 128) -> DataFrame:
    """Power density per segment (an eighth overlapping, quarter-tapered) and frequency."""
    seg = sliding_windows(df, spec, size, size - size // 8)
    rows = seg.select(*spec.keys, "win", F.posexplode(power_density(F.col("values"), size, "tukey")).alias("bin", "density"))
    return rows.withColumn("frequency", F.col("bin") / size).withColumn("time", F.col("win") * (size - size // 8) + size / 2)


def segment_spectrum(df: DataFrame, spec: SeriesSpec, size: int = 4096) -> DataFrame:
    """Amplitude (``2/n |X|``) and power spectrum of consecutive segments; the last one of a series may be shorter.

    A segment is the unit of work, so the length of a series does not matter.
    """
    rows = index_rows(df.select(*spec.keys, *spec.order, spec.value), spec).withColumn("segment", F.floor(F.col(IDX) / size))
    seg = rows.groupBy(*spec.keys, "segment").agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(spec.value).cast("double").alias("v")))).alias("_r"))
    seg = seg.withColumn("values", F.transform("_r", lambda p: p["v"])).withColumn("n", F.size("values")).drop("_r")

    @F.pandas_udf(DOUBLES)
    def magnitude(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: np.abs(np.fft.rfft(v))[: max(1, len(v) // 2)])

    out = seg.select(*spec.keys, "segment", "n", F.posexplode(magnitude("values")).alias("bin", "_m"))
    return out.select(*spec.keys, "segment", "bin", (F.col("bin") / F.col("n")).alias("frequency"), (2.0 / F.col("n") * F.col("_m")).alias("amplitude"), (F.col("_m") * F.col("_m")).alias("power"))


# ---- wavelets ----------------------------------------------------------------------------------------

def _transform(block: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    coefficients = block @ matrix
    noise = 1e-13 * np.abs(block).max(axis=1, keepdims=True)  # a fused product may leave dust where the exact result is 0
    return np.where(np.abs(coefficients) < noise, 0.0, coefficients)


def wavelet_coefficients(windows: DataFrame, size: int, wavelet: str = "db4", levels: int = 4, values: str = "values") -> DataFrame:
    """Adds ``approx`` and ``detail_1`` (coarsest) .. ``detail_<levels>`` arrays to windows of ``size`` values."""
    matrix, lengths = decomposition(wavelet, size, levels)

    @F.pandas_udf(DOUBLES)
    def transform(batch: pd.Series) -> pd.Series:
        return pd.Series(list(_transform(np.stack(batch.to_numpy()), matrix)))

    out, at = windows.withColumn("_all", transform(F.col(values))), 1
    for name, n in zip(["approx", *[f"detail_{i + 1}" for i in range(levels)]], lengths):
        out = out.withColumn(name, F.slice("_all", at, n))
        at += n
    return out.drop("_all")


def wavelet_reconstruct(coefficients: DataFrame, size: int, wavelet: str = "db4", levels: int = 4, out: str = "rebuilt") -> DataFrame:
    """Inverse of ``wavelet_coefficients``."""
    inverse = np.linalg.pinv(decomposition(wavelet, size, levels)[0])

    @F.pandas_udf(DOUBLES)
    def rebuild(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(batch.to_numpy()) @ inverse))

    return coefficients.withColumn(out, rebuild(F.concat("approx", *[f"detail_{i + 1}" for i in range(levels)])))


def feature_names(levels: int = 4) -> list[str]:
    details = [f"detail_{i}" for i in range(1, levels + 1)]
    return ([f"approx_{n}" for n in ("energy", "mean", "std", "entropy")]
            + [f"{d}_{n}" for d in details for n in ("energy", "mean", "std", "entropy", "max", "spikes", "zero_crossings")]
            + [f"{d}_energy_ratio" for d in details] + ["approx_energy_ratio"])


def _density_entropy(part: np.ndarray, bins: int = 50) -> np.ndarray:
    """``-sum(d log2(d + 1e-10))`` per row over the density of an equal-width histogram."""
    lo, hi = part.min(axis=1, keepdims=True), part.max(axis=1, keepdims=True)
    lo, width = np.where(hi > lo, lo, lo - 0.5), np.where(hi > lo, hi - lo, 1.0)
    cell = np.minimum(bins - 1, np.floor((part - lo) / width * bins)).astype(int) + bins * np.arange(len(part))[:, None]
    density = np.bincount(cell.ravel(), minlength=bins * len(part)).reshape(len(part), bins) / (part.shape[1] * width / bins)
    return -np.where(density > 0, density * np.log2(density + 1e-10), 0.0).sum(axis=1)


def wavelet_features(windows: DataFrame, size: int, wavelet: str = "db4", levels: int = 4, keep: Sequence[str] = (), values: str = "values") -> DataFrame:
    """4 approximation features, 7 per detail level and the energy shares of each window, one Arrow batch at a time."""
    matrix, lengths = decomposition(wavelet, size, levels)
    names = feature_names(levels)

    @F.pandas_udf(DOUBLES)
    def describe(batch: pd.Series) -> pd.Series:
        block = np.stack(batch.to_numpy())
        parts = np.split(_transform(block, matrix), np.cumsum(lengths)[:-1], axis=1)
        energy = [(p ** 2).sum(axis=1) for p in parts]
        total = sum(energy)
        columns = []
        for i, p in enumerate(parts):
            columns += [energy[i], p.mean(axis=1), p.std(axis=1), _density_entropy(p)]
            if i:
                crossings = (np.diff(np.sign(p), axis=1) != 0).sum(axis=1)
                columns += [np.abs(p).max(axis=1), (np.abs(p) > 3 * p.std(axis=1, keepdims=True)).sum(axis=1), crossings]
        columns += [e / np.where(total > 0, total, 1.0) for e in energy[1:] + energy[:1]]
        return pd.Series(list(np.column_stack(columns).astype(float)))

    out = windows.select(*keep, describe(F.col(values)).alias("_f"))
    return out.select(*keep, *[F.col("_f")[i].alias(n) for i, n in enumerate(names)])


# ---- angular field, scaling -----------------------------------------------------------------------------

def angular_field(windows: DataFrame, values: str = "values", out: str = "field") -> DataFrame:
    """Gramian angular summation field of each window as a matrix, ``cos(phi_i + phi_j)`` with the window scaled to [-1, 1],
    and as grey levels 0..255 in ``<out>_grey``."""
    ends = F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))
    scaled = X.bind(ends, lambda e: F.transform(values, lambda v: F.when(e["hi"] > e["lo"], F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (v - e["lo"]) / (e["hi"] - e["lo"]) - 1))).otherwise(0.0)))
    points = F.transform(scaled, lambda c: F.struct(c.alias("c"), F.sqrt(1 - c * c).alias("s")))
    field = X.bind(points, lambda p: F.transform(p, lambda a: F.transform(p, lambda b: a["c"] * b["c"] - a["s"] * b["s"])))
    return windows.withColumn(out, field).withColumn(f"{out}_grey", F.transform(out, lambda row: F.transform(row, lambda g: F.floor((g + 1) / 2 * 255).cast("int"))))


def min_max_scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), low: float = 0.0, high: float = 1.0, train=None) -> DataFrame:
    """Scales to [low, high] with extremes of the (training) rows; ``_min_<c>``/``_max_<c>`` stay for the inverse."""
    return _with_stats(df, columns, keys, train, {"min": F.min, "max": F.max}, lambda c: low + F.coalesce(
        F.try_divide(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")), F.lit(0.0)) * (high - low), keep=True)


def undo_min_max(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    back = (F.col(column) - low) / (high - low) * (F.col(f"_max_{column}") - F.col(f"_min_{column}")) + F.col(f"_min_{column}")
    return df.withColumn(column, back)


def standardise(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), train=None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    return _with_stats(df, columns, keys, train, {"mu": F.avg, "sd": F.stddev_pop}, lambda c: (F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0))


def _with_stats(df, columns, keys, train, aggs, scaled, keep=False):
    known = df if train is None else df.filter(train)
    row = known.groupBy(*keys).agg(*[fn(c).alias(f"_{tag}_{c}") for c in columns for tag, fn in aggs.items()])
    rows = null_safe_join(df, row, list(keys)) if keys else one_row(df, row)
    out = rows.withColumns({c: scaled(c) for c in columns})
    return out if keep else out.drop(*[f"_{tag}_{c}" for c in columns for tag in aggs])


def robust_scale(df: DataFrame, columns: Sequence[str], train=None, small: int = SMALL_GROUP) -> DataFrame:
    """(x - median) / IQR with exact quartiles; an IQR of 0 counts as 1."""
    row = column_quantiles(df if train is None else df.filter(train), columns, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, small)

    def scaled(c: str) -> Column:
        iqr = F.col(f"{c}_q3") - F.col(f"{c}_q1")
        return (F.col(c) - F.col(f"{c}_q2")) / F.when(iqr > 0, iqr).otherwise(1.0)

    return one_row(df, row).withColumns({c: scaled(c) for c in columns}).drop(*row.columns)
