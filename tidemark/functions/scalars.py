"""Row-wise expressions: calendar parts, cyclic encodings, bins, flags, text parsing, array helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bin edges of the two speed regime tables, and the marks of a written verdict.
REGIME_EDGES = [20000, 23000, 26000, 30000, 34000, 38000, 40000, 42000, 44000, 46500, 50000, 55000, 60000, 65000, 70000, 83000]
REGIME_EDGES_EVEN = [20000, 25000, 30000, 35000, 40000, 45000, 50000, 55000, 60000, 65000, 70000, 75000, 80000, 85000]
VERDICT_YES, VERDICT_START, VERDICT_END, VERDICT_REASON = "ANOMALY_DETECTED: true", "START_POINT:", "END_POINT:", "REASON:"


def calendar(ts: str) -> dict[str, Column]:
    """hour, minute, day of week (Monday 0) and a weekend flag."""
    dow = F.weekday(ts)
    return {"hour": F.hour(ts), "minute": F.minute(ts), "day_of_week": dow, "is_weekend": dow.isin(5, 6).cast("int")}


def cyclic(part: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * part / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def bin_index(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Index of the half-open bin ``(edge[i], edge[i+1]]`` holding the value, NULL outside all bins.

    ``include_lowest`` closes the first bin on the left.
    """
    above = sum(((value > F.lit(float(e))).cast("int") for e in edges[1:]), (value > F.lit(float(edges[0]))).cast("int"))
    found = F.when(value.isNotNull() & (value > F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1]))), above - 1)
    return F.when(value == F.lit(float(edges[0])), 0).otherwise(found) if include_lowest else found


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin over [low, high], the last one closed; a zero range is widened by 0.5 on both sides."""
    flat = high <= low
    lo = F.when(flat, low - 0.5).otherwise(low)
    span = F.when(flat, F.lit(1.0)).otherwise(high - low)
    return F.least(F.lit(bins - 1), F.floor((value - lo) / span * bins)).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    """Bounds a value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def outside(value: Column, low, high) -> Column:
    return F.when((value < low) | (value > high), 1).otherwise(0)


def above(score: Column, threshold, strict: bool = True) -> Column:
    """Score to 0/1; a NULL score counts as 0."""
    return F.when(score > threshold if strict else score >= threshold, 1).otherwise(0)


def status(flag: Column) -> Column:
    return F.when(flag == 1, "Anomaly").otherwise("Normal")


def confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def extreme_flags(value: Column, limit: float = 2.0) -> tuple[Column, Column]:
    return F.when(value > limit, 1).otherwise(0), F.when(value < -limit, 1).otherwise(0)


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def parse_answer(df: DataFrame, text: str, window_start: str, window_end: str) -> DataFrame:
    """Reads a written verdict such as ``ANOMALY_DETECTED: true; START_POINT: ..; END_POINT: ..; REASON: ..``.

    A point that is not a timestamp falls back to the bound of the window asked about; a missing one stays NULL,
    and so does everything when the verdict is not positive.
    """
    yes = F.col(text).contains(VERDICT_YES)
    kind = df.schema[window_start].dataType

    def part(mark):
        return F.when(yes & F.col(text).rlike(f"{mark}[^;]+"), F.trim(F.regexp_extract(text, f"{mark}([^;]+)", 1)))

    def point(mark, fallback):
        return F.when(part(mark).isNotNull(), F.coalesce(F.try_to_timestamp(part(mark)).cast(kind), F.col(fallback)))

    return df.withColumns({"is_anomaly": yes.cast("int"), "anomaly_start": point(VERDICT_START, window_start),
                           "anomaly_end": point(VERDICT_END, window_end), "reason": part(VERDICT_REASON)})


# ---- arrays --------------------------------------------------------------------------------------

def pad_left_edge(values: Column, count: int) -> Column:
    return F.concat(F.array_repeat(F.element_at(values, 1), count), values)


def zero_crossings(values: Column) -> Column:
    """Number of places where the sign of consecutive values differs."""
    n = F.size(values) - 1
    pairs = F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: F.signum(a) != F.signum(b))
    return F.size(F.filter(pairs, lambda p: p))


def bind(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``; a plain reference inside a lambda would be re-evaluated per element."""
    return F.transform(F.array(value), body)[0]


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def array_std(values: Column) -> Column:
    """Population deviation."""
    return bind(array_mean(values), lambda mean: F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / F.size(values)))


def spikes(values: Column, times: float = 3.0) -> Column:
    """How many absolute values exceed ``times`` the array's population deviation."""
    return bind(array_std(values), lambda sd: F.size(F.filter(values, lambda v: F.abs(v) > times * sd)))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def array_histogram(values: Column, bins: int) -> Column:
    ends = F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))
    cells = bind(ends, lambda e: F.transform(values, lambda v: histogram_bin(v, e["lo"], e["hi"], bins)))
    return bind(cells, lambda c: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(c, lambda v: v == b))))


# ---- special functions on short tables -------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if v is not None and 0 < v < 1 else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v and v is not None else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def gamma_value(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.gamma(v) if v is not None and v == v else None).astype("float64")


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: alternating series in ``sqrt(n1 n2 / (n1 + n2)) * d``."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * d
    parts = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))))
