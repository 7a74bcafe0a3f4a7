"""Recursive and convolution filters: exponential moments, Savitzky-Golay, Butterworth, Kalman, causal decomposition.

Exponential moments and the Kalman level carry their state from chunk to chunk (``recursive``).  Convolutions and the zero-phase
filter read values carried over missing ones and a halo: after ``memory`` rows a starting state is below double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..plans.features import Feature, scalar
from .recursive import Ewm, KalmanLevel
from .rolling import diff, rolling_mean, rolling_var_pop

FORGET = math.log(1e-16)


def span_to_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def memory(alpha: float) -> int:
    """Rows after which a weight of ``(1-alpha)^n`` is below 1e-16."""
    return max(1, math.ceil(FORGET / math.log1p(-alpha)))


def ewm_mean(col, alpha, adjust=False):
    return Feature(lambda pdf: pdf[col].ewm(alpha=alpha, adjust=adjust).mean(), (col,), memory(alpha), kind="pandas", carry=Ewm(alpha, adjust))


def ewm_std(col, alpha, adjust=False):
    return Feature(lambda pdf: pdf[col].ewm(alpha=alpha, adjust=adjust).std(), (col,), memory(alpha), kind="pandas", carry=Ewm(alpha, adjust, std=True))


def ewm_deviation(col, mean):
    return scalar(F.col(col) - F.col(mean), col, mean)


def ewm_z(col, mean, std, eps=1e-9):
    return scalar((F.col(col) - F.col(mean)) / (F.col(std) + eps), col, mean, std)


def derivatives(col, alpha=0.3):
    """First and second difference of an exponential mean, missing steps counted as 0."""
    d = diff("_smooth")
    return {
        "_smooth": ewm_mean(col, alpha),
        "derivative_1": Feature(lambda s: F.coalesce(d.build(s), F.lit(0.0)), ("_smooth",), back=1),
        "derivative_2": Feature(
            lambda s: F.coalesce(F.col("derivative_1") - F.lag("derivative_1", 1).over(s.ordered()), F.lit(0.0)),
            ("derivative_1",), back=1),
    }


def polynomial_weights(w: int, order: int, at: int) -> np.ndarray:
    """Weights that evaluate at position ``at`` the polynomial fitted to ``w`` equally spaced values."""
    t = np.arange(w) - at
    return np.linalg.pinv(np.vander(t.astype(float), order + 1, increasing=True))[0]


def from_first(values: pd.Series, smooth) -> np.ndarray:
    """Smooths from the first known value on, missing ones replaced by the last known; rows before it stay missing."""
    x = values.ffill().to_numpy(dtype=float)
    lead = int(np.isnan(x).sum())
    return np.concatenate([x[:lead], smooth(x[lead:])])


def savgol(col, w, order=3, pad_left=False):
    """Savitzky-Golay smoothing; ends are evaluated on the polynomial of the first/last ``w`` rows.

    ``pad_left`` repeats the first value in front of the series, which removes the left-end fit but, as the
    window stays centred, does not make the filter causal.
    """
    half = w // 2

    def smooth(x: np.ndarray) -> np.ndarray:
        if len(x) <= w:  # a series this short is passed through
            return x
        if pad_left:
            x = np.concatenate([np.full(w - 1, x[0]), x])
        y = np.convolve(x, polynomial_weights(w, order, half)[::-1], mode="same")
        for i in range(half):
            y[i] = polynomial_weights(w, order, i) @ x[:w]
            y[len(x) - 1 - i] = polynomial_weights(w, order, w - 1 - i) @ x[-w:]
        return y[w - 1:] if pad_left else y

    return Feature(lambda pdf: from_first(pdf[col], smooth), (col,), back=w, fwd=w, kind="pandas", fill=True)


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital low-pass coefficients (b, a); ``cutoff`` is a fraction of the Nyquist frequency."""
    warped = 4.0 * math.tan(math.pi * cutoff / 2.0)
    k = np.arange(order)
    analog = warped * np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
    poles = (4.0 + analog) / (4.0 - analog)
    gain = np.real(warped ** order / np.prod(4.0 - analog))
    return gain * np.real(np.poly(-np.ones(order))), np.real(np.poly(poles))


def _one_pass(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y = np.empty_like(x)
    z = list(state) + [0.0]
    bs, as_ = b.tolist(), a.tolist()
    for i, v in enumerate(x.tolist()):
        out = bs[0] * v + z[0]
        for j in range(len(bs) - 1):
            z[j] = z[j + 1] + bs[j + 1] * v - as_[j + 1] * out
        y[i] = out
    return y


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward-backward filtering with odd extension at both ends and step-response start state."""
    n = len(b) - 1
    pad = 3 * (n + 1)
    if len(x) <= pad:
        return x
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    steady = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    once = _one_pass(b, a, ext, steady * ext[0])[::-1]
    return _one_pass(b, a, once, steady * once[0])[::-1][pad:-pad]


def butterworth_smooth(col, order=4, cutoff=0.1):
    """Zero-phase low-pass; the halo follows from the slowest pole, so it grows as the cutoff falls."""
    b, a = butterworth(order, cutoff)
    halo = max(3 * (order + 1) + 1, math.ceil(FORGET / math.log(np.abs(np.roots(a)).max())))
    return Feature(lambda pdf: from_first(pdf[col], lambda x: zero_phase(x, b, a)), (col,), halo, halo, "pandas", fill=True)


def kalman_level(col, process=1e-5, measurement=0.1):
    """One-dimensional level filter; its gain depends on how many values were seen."""
    level = KalmanLevel(process, measurement)

    def build(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[col].to_numpy(dtype=float, na_value=np.nan)
        return level.run(x, level.start(x[0] if len(x) else math.nan))

    return Feature(build, (col,), kind="pandas", carry=level)


def causal_decompose(col, period, cycles=3, prefix=""):
    """Classical causal decomposition: trailing-mean trend over one period, seasonal as the mean detrended value
    at the same phase over the last ``cycles`` periods, and the residual."""
    trend, season, rest = f"{prefix}trend", f"{prefix}seasonal", f"{prefix}residual"
    flat = f"_{prefix}detrended"

    def same_phase(laid):
        past = [F.lag(flat, k * period).over(laid.ordered()) for k in range(1, cycles + 1)]
        known = [F.when(p.isNotNull(), 1).otherwise(0) for p in past]
        total = sum((F.coalesce(p, F.lit(0.0)) for p in past[1:]), F.coalesce(past[0], F.lit(0.0)))
        return F.try_divide(total, sum(known[1:], known[0]))

    return {
        trend: rolling_mean(col, period),
        flat: scalar(F.col(col) - F.col(trend), col, trend),
        season: Feature(same_phase, (flat,), back=cycles * period),
        rest: scalar(F.col(flat) - F.col(season), flat, season),
    }


def strengths(window, prefix=""):
    """Trend and seasonal strength over a trailing window: ``max(0, 1 - var(residual)/var(part + residual))``."""
    trend, season, rest = f"{prefix}trend", f"{prefix}seasonal", f"{prefix}residual"

    def strength(part):
        both, own, joint = f"_{part}_rest", f"_{part}_var_rest", f"_{part}_var_both"
        return {both: scalar(F.col(part) + F.col(rest), part, rest), own: rolling_var_pop(rest, window), joint: rolling_var_pop(both, window),
                f"strength_{part}": scalar(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col(own), F.col(joint))), own, joint)}

    return {**strength(trend), **strength(season)}
