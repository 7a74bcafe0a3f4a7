"""Rolling, lag, rank and trend features as ``Feature`` values (or dicts of them when intermediates are needed).

Row-count windows end at the current row; ``m`` is the minimum number of non-NULL values (default: the
whole window).  Plain statistics are native window expressions.  Order statistics over long frames, and
statistics that need the window's contents, run once per Arrow batch of a bounded (series, chunk) group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.features import Feature, running_sum, scalar
from ..plans.series import IDX

# A sliding frame is re-aggregated for every row, so its cost grows with its length.  Longer sums and means are differences of running
# sums, which all lengths share; longer minima and maxima are joined from two running aggregates (``_blocked``).  Variances, order
# statistics and higher moments get running updates (moment updates, skip list) in one Arrow pass for all of them, whose cost does not
# depend on the length; order statistics and higher moments already pay for that at short lengths.
NATIVE_ROWS = 120
NATIVE_COSTLY_ROWS = 16
BLOCK_ROWS, BLOCK_VALUES = 4096, 2 ** 19  # of a matrix of windows


def _moving(col: str, w: int, m: int | None, stat: Callable, back: int | None = None) -> Feature:
    """``stat(rolling)`` of the pandas rolling object, for long windows."""
    need = w if m is None else m
    return Feature(lambda pdf: stat(pdf[col].astype("float64").rolling(w, min_periods=need)), (col,), back=w - 1 if back is None else back, kind="pandas")


def _blocked(col: str, w: int, m: int | None, parts: dict[str, Callable[[Column], Column]], join: Callable) -> Feature:
    """A statistic of the last ``w`` rows in time that does not depend on ``w``.

    The series is cut into blocks of ``w`` rows. A window is the end of one block and the beginning of the next: running aggregates
    ``parts`` from each block's start up to a row, and from each row up to its block's end, are ``join``-ed. Nothing is subtracted, so no
    precision is lost on the way. ``join(before, here)`` gets both ends' parts by name, and NULLs (count 0) where an end is empty.
    """
    need = w if m is None else m
    parts = {"n": F.count, **parts}

    def build(laid):
        block = F.floor(F.col(IDX) / w)
        upto = Window.partitionBy(*laid.part, block).orderBy(*laid.order).rowsBetween(Window.unboundedPreceding, 0)
        onward = Window.partitionBy(*laid.part, block).orderBy(*[F.col(c).desc_nulls_last() for c in laid.order]).rowsBetween(Window.unboundedPreceding, 0)
        name = {p: f"{col}_{w}_{p}" for p in parts}
        ends = {f"_upto_{name[p]}": agg(F.col(col)).over(upto) for p, agg in parts.items()} | {f"_onward_{name[p]}": agg(F.col(col)).over(onward) for p, agg in parts.items()}
        full = F.col(IDX) % w == w - 1  # the block is the window
        lagged = {f"_before_{name[p]}": F.when(~full, F.lag(f"_onward_{name[p]}", w - 1).over(laid.ordered())) for p in parts}
        before, here = {p: F.col(f"_before_{name[p]}") for p in parts}, {p: F.col(f"_upto_{name[p]}") for p in parts}
        before["n"] = F.coalesce(before["n"], F.lit(0))
        return [ends, lagged, F.when(before["n"] + here["n"] >= need, join(before, here))]

    return Feature(build, (col,), back=w - 1, kind="staged")


def _summed(col: str, w: int, m: int | None, final: Callable[[Column, Column], Column]) -> Feature:
    """``final(sum, count)`` of the last ``w`` rows, from running sums of the values less their mean in the chunk, which keeps them small."""
    need = w if m is None else m

    def build(laid):
        o = laid.ordered()
        running = o.rowsBetween(Window.unboundedPreceding, 0)
        whole = isinstance(laid.df.schema[col].dataType, T.IntegralType)  # exact as they are
        mid, total, count = f"_mid_{col}", f"_total_{col}", f"_count_{col}"
        centre = F.lit(0).cast("long") if whole else F.coalesce(F.avg(col).over(Window.partitionBy(*laid.part)), F.lit(0.0))
        sums = {total: F.coalesce(F.sum(F.col(col) - F.col(mid)).over(running), F.lit(0)), count: F.count(col).over(running)}
        ago = {f"{total}_{w}": F.lag(total, w, 0 if whole else 0.0).over(o), f"{count}_{w}": F.lag(count, w, 0).over(o)}
        n = F.col(count) - F.col(f"{count}_{w}")
        return [{mid: centre}, sums, ago, F.when((n >= need) & (n > 0), final(F.col(total) - F.col(f"{total}_{w}") + n * F.col(mid), n))]

    return Feature(build, (col,), back=w - 1, kind="staged")


def _window(col: str, w: int, m: int | None, agg: Callable[[Column], Column], moving: Callable, costly: bool = False) -> Feature:
    if w > (NATIVE_COSTLY_ROWS if costly else NATIVE_ROWS):
        return _moving(col, w, m, moving)
    need = w if m is None else m

    def build(laid):
        over = laid.rows(-(w - 1), 0)
        return F.when(F.count(col).over(over) >= need, agg(F.col(col)).over(over))

    return Feature(build, (col,), back=w - 1)


def rolling_mean(col, w, m=None):
    return _window(col, w, m, F.avg, None) if w <= NATIVE_ROWS else _summed(col, w, m, lambda s, n: s / n)


def rolling_sum(col, w, m=None):
    return _window(col, w, m, F.sum, None) if w <= NATIVE_ROWS else _summed(col, w, m, lambda s, n: s)


def rolling_count(col, w):
    if w > NATIVE_ROWS:
        return replace(counted := _summed(col, w, 0, lambda s, n: n), build=lambda laid: [*(parts := counted.build(laid))[:-1], F.coalesce(parts[-1], F.lit(0))])
    return Feature(lambda laid: F.count(col).over(laid.rows(-(w - 1), 0)), (col,), back=w - 1)


def rolling_std(col, w, m=None):
    return _window(col, w, m, F.stddev_samp, lambda r: r.std())


def rolling_var(col, w, m=None):
    return _window(col, w, m, F.var_samp, lambda r: r.var())


def rolling_var_pop(col, w):
    return _window(col, w, 1, F.var_pop, lambda r: r.var(ddof=0))


def rolling_min(col, w, m=None):
    return _window(col, w, m, F.min, None) if w <= NATIVE_ROWS else _blocked(col, w, m, {"min": F.min}, lambda a, b: F.least(a["min"], b["min"]))


def rolling_max(col, w, m=None):
    return _window(col, w, m, F.max, None) if w <= NATIVE_ROWS else _blocked(col, w, m, {"max": F.max}, lambda a, b: F.greatest(a["max"], b["max"]))


def rolling_range(col, w, m=None):
    return _window(col, w, m, None, lambda r: r.max() - r.min()) if w > NATIVE_ROWS else _native_range(col, w, m)


def _native_range(col, w, m):
    need = w if m is None else m

    def build(laid):
        over = laid.rows(-(w - 1), 0)
        return F.when(F.count(col).over(over) >= need, F.max(col).over(over) - F.min(col).over(over))

    return Feature(build, (col,), back=w - 1)


def rolling_quantile(col, w, q, m=None):
    """Linear-interpolated quantile of the window."""
    return _window(col, w, m, lambda c: F.percentile(c, F.lit(q)), lambda r: r.quantile(q), costly=True)


def rolling_median(col, w, m=None):
    return rolling_quantile(col, w, 0.5, m)


def rolling_iqr(col, w, m=None):
    if w > NATIVE_COSTLY_ROWS:
        return _moving(col, w, m, lambda r: r.quantile(0.75) - r.quantile(0.25))
    inner = _window(col, w, m, lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))), None)
    return Feature(lambda laid: (lambda a: a[1] - a[0])(inner.build(laid)), (col,), back=w - 1)


def rolling_skew(col, w, m=None, bias=False):
    """Skewness; ``bias=False`` applies the sample correction, which needs three values."""
    need = w if m is None else m
    if w > NATIVE_COSTLY_ROWS:
        return _moving(col, w, m, lambda r: _uncorrect(r.skew(), r.count(), 3) if bias else r.skew())

    def build(laid):
        over = laid.rows(-(w - 1), 0)
        n = F.count(col).over(over).cast("double")
        g1 = F.skewness(col).over(over)
        value = g1 if bias else F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * g1)
        return F.when(n >= need, value)

    return Feature(build, (col,), back=w - 1)


def rolling_kurt(col, w, m=None, bias=False):
    """Excess kurtosis; ``bias=False`` applies the sample correction, which needs four values."""
    need = w if m is None else m
    if w > NATIVE_COSTLY_ROWS:
        return _moving(col, w, m, lambda r: _uncorrect(r.kurt(), r.count(), 4) if bias else r.kurt())

    def build(laid):
        over = laid.rows(-(w - 1), 0)
        n = F.count(col).over(over).cast("double")
        g2 = F.kurtosis(col).over(over)
        value = g2 if bias else F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        return F.when(n >= need, value)

    return Feature(build, (col,), back=w - 1)


def _uncorrect(value: pd.Series, n: pd.Series, order: int) -> pd.Series:
    """Sample-corrected skewness (order 3) or kurtosis (order 4) back to the population form."""
    n = n.where(n >= order)
    if order == 3:
        return value * (n - 2) / np.sqrt(n * (n - 1))
    return (value * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1)


def centred_mean(col, w, std=False):
    """Mean (or std) over a window centred on the row; an even window has one row more behind than ahead."""
    behind, ahead = w // 2, w - 1 - w // 2

    def build(laid):
        over = laid.rows(-behind, ahead)
        return F.when(F.count(col).over(over) >= w, (F.stddev_samp if std else F.avg)(col).over(over))

    return Feature(build, (col,), back=behind, fwd=ahead)


def lag(col, k):
    return Feature(lambda laid: F.lag(col, k).over(laid.ordered()), (col,), back=k)


def lead(col, k):
    return Feature(lambda laid: F.lead(col, k).over(laid.ordered()), (col,), fwd=k)


def diff(col, k=1, absolute=False):
    def build(laid):
        d = F.col(col) - F.lag(col, k).over(laid.ordered())
        return F.abs(d) if absolute else d

    return Feature(build, (col,), back=k)


def second_diff(col):
    def build(laid):
        o = laid.ordered()
        return F.col(col) - 2 * F.lag(col, 1).over(o) + F.lag(col, 2).over(o)

    return Feature(build, (col,), back=2)


def third_diff(col):
    def build(laid):
        o = laid.ordered()
        return F.col(col) - 3 * F.lag(col, 1).over(o) + 3 * F.lag(col, 2).over(o) - F.lag(col, 3).over(o)

    return Feature(build, (col,), back=3)


def pct_change(col, k=1):
    """Relative change to ``k`` rows ago; NULL where the earlier value is 0."""
    return Feature(lambda laid: F.try_divide(F.col(col), F.lag(col, k).over(laid.ordered())) - 1, (col,), back=k)


def rate_of_change(col, k=1):
    return Feature(lambda laid: (F.col(col) - F.lag(col, k).over(laid.ordered())) / k, (col,), back=k)


def rolling_z(col, w, m=None, eps: float | None = None):
    """(x - mean) / (std + eps); without ``eps`` a zero spread gives NULL."""
    need = w if m is None else m
    if w > NATIVE_ROWS:
        def moving(pdf):
            x = pdf[col].astype("float64")
            r = x.rolling(w, min_periods=need)
            sd = r.std()
            return (x - r.mean()) / (sd.where(sd > 0) if eps is None else sd + eps)

        return Feature(moving, (col,), back=w - 1, kind="pandas")

    def build(laid):
        over = laid.rows(-(w - 1), 0)
        sd = F.stddev_samp(col).over(over)
        gap = F.col(col) - F.avg(col).over(over)
        z = F.try_divide(gap, sd) if eps is None else gap / (sd + eps)
        return F.when(F.count(col).over(over) >= need, z)

    return Feature(build, (col,), back=w - 1)


def rolling_slope(col, w):
    """Least-squares slope against row position over a full window."""
    def build(laid):
        over = laid.rows(-(w - 1), 0)
        return F.when(F.count(col).over(over) >= w, F.regr_slope(F.col(col), F.col("idx").cast("double")).over(over))

    return Feature(build, (col, "idx"), back=w - 1)


def rolling_r2(col, w, m=3):
    """Squared correlation with row position; 0 for a constant window."""
    def build(laid):
        over = laid.rows(-(w - 1), 0)
        flat = F.min(col).over(over) == F.max(col).over(over)
        r2 = F.when(flat, F.lit(0.0)).otherwise(F.regr_r2(F.col(col), F.col("idx").cast("double")).over(over))
        return F.when(F.count(col).over(over) >= m, r2)

    return Feature(build, (col, "idx"), back=w - 1)


def direction_changes(col, w, m=3, prefix="_turn"):
    """Number of sign changes between consecutive differences inside the window."""
    flag = f"{prefix}_{col}"

    def turn(laid):
        o = laid.ordered()
        d1 = F.col(col) - F.lag(col, 1).over(o)
        d0 = F.lag(col, 1).over(o) - F.lag(col, 2).over(o)
        return F.when(d1 * d0 < 0, 1).otherwise(0)

    def count(laid):
        inside = laid.rows(-max(w - 3, 0), 0)
        return F.when(F.count(col).over(laid.rows(-(w - 1), 0)) >= m, F.sum(flag).over(inside))

    return {flag: Feature(turn, (col,), back=2), f"turns_{w}": Feature(count, (flag, col), back=w - 1)}


def rise_counts(col, w, rises, falls):
    """Rising steps inside the window, and ``w`` minus that."""
    flag = f"_rise_{col}"
    up = Feature(lambda laid: F.when(F.col(col) > F.lag(col, 1).over(laid.ordered()), 1).otherwise(0), (col,), back=1)
    # the first row of a window has no predecessor inside it, so w-1 flags are counted
    total = Feature(lambda laid: F.sum(flag).over(laid.rows(-(w - 2), 0)), (flag,), back=w - 2)
    return {flag: up, rises: total, falls: scalar(F.lit(w) - F.col(rises), rises)}


def window_extreme_flags(col, w):
    """1 where the row is the window's maximum / minimum."""
    def at(agg):
        return Feature(lambda laid: (F.col(col) == agg(col).over(laid.rows(-(w - 1), 0))).cast("int"), (col,), back=w - 1)

    return {f"is_max_{w}": at(F.max), f"is_min_{w}": at(F.min)}


def local_extreme(col, low: bool):
    """1 where the row is strictly below (above) both neighbours; looks one row ahead."""
    def build(laid):
        o = laid.ordered()
        before, after, x = F.lag(col, 1).over(o), F.lead(col, 1).over(o), F.col(col)
        hit = (x < before) & (x < after) if low else (x > before) & (x > after)
        return F.when(hit, 1).otherwise(0)

    return Feature(build, (col,), back=1, fwd=1)


def cusum_windowed(col, w, m=1, positive="cusum_pos", negative="cusum_neg"):
    """Window sums of the deviations above and below the rolling mean."""
    gap = f"_gap_{col}_{w}"
    return {
        f"_mean{gap}": rolling_mean(col, w, m),
        gap: scalar(F.col(col) - F.col(f"_mean{gap}"), f"_mean{gap}"),
        f"_up{gap}": scalar(F.greatest(F.lit(0.0), F.col(gap)), gap),
        f"_down{gap}": scalar(F.greatest(F.lit(0.0), -F.col(gap)), gap),
        positive: rolling_sum(f"_up{gap}", w, 1),
        negative: rolling_sum(f"_down{gap}", w, 1),
    }


def cusum_unbounded(col, w, m=1, deviation="positive_dev", out="cusum"):
    """Running total of the positive deviations from the rolling mean."""
    mean = f"_mean_for_{deviation}"
    return {
        mean: rolling_mean(col, w, m),
        deviation: scalar(F.when(F.col(mean).isNotNull(), F.greatest(F.lit(0.0), F.col(col) - F.col(mean))).otherwise(0.0), mean),
        out: running_sum(F.col(deviation), deviation),
    }


def rsi(col, w=14):
    """Relative strength index from rolling mean gains and losses; the first step counts as no change."""
    def build(laid):
        step = F.coalesce(F.col("_step"), F.lit(0.0))
        over = laid.rows(-(w - 1), 0)
        gain = F.avg(F.greatest(step, F.lit(0.0))).over(over)
        loss = F.avg(F.greatest(-step, F.lit(0.0))).over(over)
        value = F.when((gain == 0) & (loss == 0), None).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
        return F.when(F.count(col).over(over) >= w, value)

    return {"_step": diff(col), "rsi": Feature(build, (col, "_step"), back=w - 1)}


# ---- statistics that need the window's contents -------------------------------------------------

def trailing_windows(x: np.ndarray, w: int):
    """Blocks ``(start, matrix)`` whose row i holds the window ending at ``start + i``; missing leads are NaN."""
    padded = np.concatenate([np.full(w - 1, np.nan), x.astype(float)])
    view = np.lib.stride_tricks.sliding_window_view(padded, w)
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // w))
    for at in range(0, len(x), rows):
        yield at, view[at:at + rows]


def _by_window(col: str, w: int, m: int | None, stat: Callable[[np.ndarray], np.ndarray]) -> Feature:
    need = w if m is None else m

    def build(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[col].to_numpy(dtype=float, na_value=np.nan)
        out = np.full(len(x), np.nan)
        for at, block in trailing_windows(x, w):
            enough = (~np.isnan(block)).sum(axis=1) >= need
            if enough.any():
                out[at:at + len(block)][enough] = stat(block[enough])
        return pd.Series(out).astype("Float64").where(~np.isnan(out), None)

    return Feature(build, (col,), back=w - 1, kind="pandas")


def row_medians(block: np.ndarray) -> np.ndarray:
    ordered = np.sort(block, axis=1)
    n = (~np.isnan(block)).sum(axis=1)
    at = np.arange(len(block))
    return (ordered[at, (n - 1) // 2] + ordered[at, n // 2]) / 2


def _nearest(ordered: list[float], m: float, k: int) -> float:
    """The distance from ``m`` that ``k`` of the ordered values fall short of: k + 1 neighbours are as near as the farther end of theirs."""
    lo, hi = 0, len(ordered) - 1 - k
    while lo < hi:
        i = (lo + hi) // 2
        if ordered[i + k] - m >= m - ordered[i]:
            hi = i
        else:
            lo = i + 1
    far = max(ordered[lo + k] - m, m - ordered[lo])
    return min(far, m - ordered[lo - 1]) if lo else far


def moving_mads(x: np.ndarray, w: int, need: int) -> np.ndarray:
    """Median absolute deviations of the windows ending at each row, the window kept in order; NaN with fewer than ``need`` values."""
    values, out, ordered = x.tolist(), np.full(len(x), np.nan), []
    for i, v in enumerate(values):
        if i >= w and (old := values[i - w]) == old:
            del ordered[bisect_left(ordered, old)]
        if v == v:
            insort(ordered, v)
        n = len(ordered)
        if n and n >= need:
            m = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
            far = _nearest(ordered, m, n // 2)
            out[i] = far if n % 2 else (_nearest(ordered, m, n // 2 - 1) + far) / 2
    return out


def rolling_mad(col, w, m=None):
    """Median absolute deviation from the window median, unscaled."""
    by_window, need = _by_window(col, w, m, lambda b: row_medians(np.abs(b - row_medians(b)[:, None]))), w if m is None else m

    def build(pdf: pd.DataFrame) -> pd.Series:
        x = pdf[col].to_numpy(dtype=float, na_value=np.nan)
        if np.isinf(x).any():
            return by_window.build(pdf)
        out = moving_mads(x, w, need)
        return pd.Series(out).astype("Float64").where(~np.isnan(out), None)

    return replace(by_window, build=build)


def rolling_rank(col, w, m=None):
    """Average rank of the row within its window divided by the window's size."""
    def stat(block):
        last = block[:, -1:]
        n = (~np.isnan(block)).sum(axis=1)
        return ((block < last).sum(axis=1) + ((block == last).sum(axis=1) + 1) / 2) / n

    return _by_window(col, w, m, stat)


def rolling_entropy(col, w, bins=10, base="nat", m=None):
    """Shannon entropy of an equal-width histogram of the window; ``base`` is ``nat`` or ``log2`` (with 1e-9 added)."""
    def stat(block):
        lo, hi = np.nanmin(block, axis=1, keepdims=True), np.nanmax(block, axis=1, keepdims=True)
        span = np.where(hi > lo, hi - lo, 1.0)
        cell = np.minimum(bins - 1, np.floor((block - lo) / span * bins))
        n = (~np.isnan(block)).sum(axis=1)
        total = np.zeros(len(block))
        for b in range(bins):
            p = (cell == b).sum(axis=1) / n
            if base == "nat":
                total -= np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0)
            else:
                total -= np.where(p > 0, p * np.log2(p + 1e-9), 0.0)
        return total

    return _by_window(col, w, m, stat)


def spectral(col, w, what="centroid"):
    """Spectral centroid (magnitude-weighted mean frequency) or entropy (of the power spectrum) of the window."""
    def stat(block):
        mag = np.abs(np.fft.rfft(block, axis=1))
        if what == "centroid":
            total = mag.sum(axis=1)
            return np.where(total > 0, (mag * np.fft.rfftfreq(w)).sum(axis=1) / np.where(total > 0, total, 1), 0.0)
        power = mag ** 2
        total = power.sum(axis=1, keepdims=True)
        p = power / np.where(total > 0, total, 1)
        return -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0.0).sum(axis=1)

    return _by_window(col, w, None, stat)
