"""Named feature sets: each builds a dict of features for one value column, and knows how its gaps are filled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import scalars as X
from ..functions import smoothing as S
from ..functions.expanding import expanding_quantile
from ..operators import clean as C
from ..operators import profile as P
from ..operators import reshape as H
from .features import Feature, causal_only as keep_causal, chunk_size, running_sum, scalar, with_features
from .series import SUB, SeriesSpec, cut_up

Features = dict[str, Feature]


def _flag(cond: Column, *inputs: str) -> Feature:
    return scalar(F.when(cond, 1).otherwise(0), *inputs)


def baseline(x: str, span: int = 10, lags: tuple[int, ...] = (1, 5, 60)) -> Features:
    f: Features = {}
    for w, m in ((60, 1), (300, 60), (900, 180)):
        f |= {f"mean_{w}": R.rolling_mean(x, w, m), f"std_{w}": R.rolling_std(x, w, m), f"z_{w}": R.rolling_z(x, w, m, 1e-9), f"median_{w}": R.rolling_median(x, w, m),
              f"mean_median_{w}": scalar(F.col(f"mean_{w}") - F.col(f"median_{w}"), f"mean_{w}", f"median_{w}")}
    f |= {"diff_1": R.diff(x), "diff_5": R.diff(x, 5), "acceleration": R.second_diff(x)}
    for w, m in ((60, 1), (300, 60)):
        f |= R.cusum_unbounded(x, w, m, f"positive_dev_{w}", f"cusum_{w}")
        f |= {f"min_{w}": R.rolling_min(x, w, m), f"max_{w}": R.rolling_max(x, w, m), f"q25_{w}": R.rolling_quantile(x, w, .25, m), f"q75_{w}": R.rolling_quantile(x, w, .75, m)}
    a = S.span_to_alpha(span)
    return f | {"ewm_mean": S.ewm_mean(x, a), "ewm_std": S.ewm_std(x, a)} | {f"lag_{k}": R.lag(x, k) for k in lags}


def enhanced(x: str, ts: str = "ts") -> Features:
    f: Features = {}
    for w in (30, 60, 300, 900, 1800):
        m = max(1, int(.1 * w))
        f |= {f"mean_{w}": R.rolling_mean(x, w, m), f"std_{w}": R.rolling_std(x, w, m), f"median_{w}": R.rolling_median(x, w, m), f"skew_{w}": R.rolling_skew(x, w, m),
              f"kurt_{w}": R.rolling_kurt(x, w, m), f"range_{w}": R.rolling_range(x, w, m), f"z_{w}": R.rolling_z(x, w, m, 1e-9), f"q10_{w}": R.rolling_quantile(x, w, .1, m),
              f"q90_{w}": R.rolling_quantile(x, w, .9, m), f"iqr_{w}": R.rolling_iqr(x, w, m), f"cv_{w}": scalar(F.col(f"std_{w}") / (F.col(f"mean_{w}") + 1e-9), f"std_{w}", f"mean_{w}"),
              f"mean_median_{w}": scalar(F.col(f"mean_{w}") - F.col(f"median_{w}"), f"mean_{w}", f"median_{w}")}
    for k in (1, 5, 10, 30, 60, 120):
        f |= {f"diff_{k}": R.diff(x, k), f"pct_{k}": R.pct_change(x, k), f"lag_{k}": R.lag(x, k)}
    f |= {"acceleration": R.second_diff(x), "jerk": R.third_diff(x)}
    for span in (10, 30, 60, 120):
        a = S.span_to_alpha(span)
        f |= {f"ewm_mean_{span}": S.ewm_mean(x, a), f"ewm_std_{span}": S.ewm_std(x, a), f"ewm_dev_{span}": S.ewm_deviation(x, f"ewm_mean_{span}")}
    for w in (60, 300):
        f |= R.cusum_windowed(x, w, max(1, int(.1 * w)), f"cusum_pos_{w}", f"cusum_neg_{w}")
        f |= {f"entropy_{w}": R.rolling_entropy(x, w, base="log2", m=w // 10)}
    f |= {f"lag_{k}": R.lag(x, k) for k in (2, 3, 4)}
    f |= {"cross_60_300": _flag(F.col("mean_60") > F.col("mean_300"), "mean_60", "mean_300"), "cross_300_900": _flag(F.col("mean_300") > F.col("mean_900"), "mean_300", "mean_900")}
    return f | _calendar(ts, ("hour", "day_of_week", "is_weekend"))


def _calendar(ts: str, parts: tuple[str, ...]) -> Features:
    c, period = X.calendar(ts), {"hour": 24, "minute": 60, "day_of_week": 7}
    f = {p: scalar(c[p]) for p in parts}
    for p in parts:
        if p in period:
            sin, cos = X.cyclic(c[p], period[p])
            f |= {f"{p}_sin": scalar(sin), f"{p}_cos": scalar(cos)}
    return f


def _robust_window(x: str, w: int, m: int) -> Features:
    q1, q3 = F.col(f"q25_{w}"), F.col(f"q75_{w}")
    value = F.col(x)
    return {f"median_{w}": R.rolling_median(x, w, m), f"mad_{w}": R.rolling_mad(x, w, m),
            f"robust_z_{w}": scalar((value - F.col(f"median_{w}")) / (F.col(f"mad_{w}") + 1e-9), f"median_{w}", f"mad_{w}"),
            f"q25_{w}": R.rolling_quantile(x, w, .25, m), f"q75_{w}": R.rolling_quantile(x, w, .75, m), f"iqr_{w}": scalar(q3 - q1, f"q25_{w}", f"q75_{w}"),
            f"outside_iqr_{w}": _flag((value < q1 - 1.5 * (q3 - q1)) | (value > q3 + 1.5 * (q3 - q1)), f"q25_{w}", f"q75_{w}")}


def robust(x: str, ts: str = "ts") -> Features:
    f: Features = {}
    for w in (60, 300, 600, 900, 1200):
        f |= _robust_window(x, w, max(1, w // 50))
    for w in (60, 300):
        f |= {f"pct_dev_{w}": scalar((F.col(x) - F.col(f"median_{w}")) / (F.col(f"median_{w}") + 1e-9), f"median_{w}"), f"rank_{w}": R.rolling_rank(x, w, 1),
              f"n_mads_{w}": scalar(F.abs(F.col(x) - F.col(f"median_{w}")) / (F.col(f"mad_{w}") + 1e-9), f"median_{w}", f"mad_{w}")}
    f |= {"_mean_5": R.rolling_mean(x, 5, 1)}
    for k in (1, 5, 10, 30, 60):
        f |= {f"pct_{k}": R.pct_change(x, k), f"smooth_diff_{k}": R.diff("_mean_5", k)}
    for w in (30, 60):
        f |= {f"trend_r2_{w}": R.rolling_r2(x, w, 3)} | R.direction_changes(x, w, 3)
    f |= {"local_min": R.local_extreme(x, True), "local_max": R.local_extreme(x, False)}
    return f | _calendar(ts, ("hour", "minute"))


def causal(x: str) -> Features:
    f: Features = {f"ema_{round(100 * a)}": S.ewm_mean(x, a) for a in (.1, .3, .5)}
    f |= {f"savgol_{w}": S.savgol(x, w, pad_left=True) for w in (7, 15, 31)}
    for w in (60, 300, 600, 900, 1200):
        f |= _robust_window(x, w, 1)
    for k in (1, 5, 10, 30, 60):
        f |= {f"pct_{k}": R.pct_change(x, k), f"abs_{k}": R.diff(x, k, absolute=True), f"rate_{k}": R.rate_of_change(x, k)}
    f |= {"_d1": R.diff(x), "cumulative_change": running_sum(F.coalesce(F.col("_d1"), F.lit(0.0)), "_d1")}
    for w in (30, 60, 120):
        f |= R.rise_counts(x, w, f"rises_{w}", f"falls_{w}") | {f"var_{w}": R.rolling_var(x, w, 1)}
    f |= {"expanding_q10": expanding_quantile(x, .1, 100), "expanding_q90": expanding_quantile(x, .9, 100),
          "below_q10": _flag(F.col(x) < F.col("expanding_q10"), "expanding_q10"), "above_q90": _flag(F.col(x) > F.col("expanding_q90"), "expanding_q90")}
    for span in (10, 50, 200):
        a = S.span_to_alpha(span)
        f |= {f"ewm_mean_{span}": S.ewm_mean(x, a), f"ewm_std_{span}": S.ewm_std(x, a), f"ewm_z_{span}": S.ewm_z(x, f"ewm_mean_{span}", f"ewm_std_{span}")}
    f |= R.window_extreme_flags(x, 10) | R.window_extreme_flags(x, 30) | S.derivatives(x, .3)
    for w in (60, 300):
        lo = f"_lo_{w}"
        f |= {lo: R.rolling_min(x, w, 1), f"range_{w}": R.rolling_range(x, w, 1),
              f"position_{w}": scalar(X.clip((F.col(x) - F.col(lo)) / (F.col(f"range_{w}") + 1e-9), 0, 1), lo, f"range_{w}")}
    return f | {"kalman": S.kalman_level(x), "kalman_residual": scalar(F.col(x) - F.col("kalman"), "kalman"), "kalman_residual_abs": scalar(F.abs(F.col(x) - F.col("kalman")), "kalman")}


def binned(x: str, raw: str) -> Features:
    """``x`` is the per-bin z-score, ``raw`` the plain value."""
    f: Features = {"lag_1": R.lag(x, 1), "mean_30": R.rolling_mean(x, 30), "std_30": R.rolling_std(x, 30), "slope_30": R.rolling_slope(x, 30), "entropy_30": R.rolling_entropy(x, 30),
                   "z_30": R.rolling_z(x, 30), "rank_30": R.rolling_rank(x, 30), "savgol_51": S.savgol(x, 51), "butterworth": S.butterworth_smooth(x),
                   "deviation": scalar(F.col(x) - F.col("savgol_51"), "savgol_51"), "deviation_abs": scalar(F.abs(F.col(x) - F.col("savgol_51")), "savgol_51"), "acceleration": R.second_diff(x),
                   "to_mean": scalar(F.try_divide(F.col(x), F.col("mean_30")), "mean_30"), "_max_30": R.rolling_max(x, 30), "to_max": scalar(F.try_divide(F.col(x), F.col("_max_30")), "_max_30")}
    high, low = X.extreme_flags(F.col(x))
    return f | {"extreme_high": scalar(high), "extreme_low": scalar(low), "cumsum": running_sum(F.col(x), x), "raw_mean_120": R.rolling_mean(raw, 120), "raw_std_120": R.rolling_std(raw, 120)}


def spectral(x: str, w: int = 70) -> Features:
    """``x`` is the per-bin z-score."""
    return {"mean": R.rolling_mean(x, w), "std": R.rolling_std(x, w), "max": R.rolling_max(x, w), "iqr": R.rolling_iqr(x, w), "slope": R.rolling_slope(x, w), "centroid": R.spectral(x, w),
            "spectral_entropy": R.spectral(x, w, "entropy"), "z": R.rolling_z(x, w, None, 1e-6), "to_mean": scalar(F.col(x) / (F.col("mean") + 1e-6), "mean"),
            "to_max": scalar(F.col(x) / (F.col("max") + 1e-6), "max"), "ewm_mean": S.ewm_mean(x, .95, True), "ewm_std": S.ewm_std(x, .95, True), "diff_abs": R.diff(x, w, absolute=True),
            "acceleration": R.second_diff(x)}


def residual(x: str, period: int = 900, ts: str = "ts") -> Features:
    f = S.causal_decompose(x, period) | S.strengths(2 * period)
    f |= {"_abs": scalar(F.abs(F.col("residual")), "residual")}
    for w in (30, 60, 150, 300, 600):
        f |= {f"mean_{w}": R.rolling_mean("residual", w, 1), f"std_{w}": R.rolling_std("residual", w, 1), f"abs_mean_{w}": R.rolling_mean("_abs", w, 1), f"median_{w}": R.rolling_median("residual", w, 1),
              f"mad_{w}": R.rolling_mad("residual", w, 1), f"z_mad_{w}": scalar((F.col("residual") - F.col(f"median_{w}")) / (F.col(f"mad_{w}") + 1e-8), f"median_{w}", f"mad_{w}"),
              f"exceeds_3mad_{w}": _flag(F.abs(F.col(f"z_mad_{w}")) > 3, f"z_mad_{w}")}
    for k in (1, 5, 10, 30, 60):
        f |= {f"diff_{k}": R.diff("residual", k), f"abs_diff_{k}": R.diff("residual", k, absolute=True)}
    both = F.col("trend") + F.col("seasonal")
    f |= {"minus_trend": scalar(F.col(x) - F.col("trend"), "trend"), "trend_ratio": scalar(F.col(x) / (F.col("trend") + 1e-8), "trend"), "trend_diff_10": R.diff("trend", 10), "trend_acceleration": R.second_diff("trend"),
          "minus_seasonal": scalar(F.col(x) - F.col("seasonal"), "seasonal"), "expected": scalar(both, "trend", "seasonal"), "actual_vs_expected": scalar(F.col(x) - both, "trend", "seasonal"),
          "actual_vs_expected_ratio": scalar(F.col(x) / (both + 1e-8), "trend", "seasonal"), "_sd300": R.rolling_std("residual", 300, 30),
          "_high": _flag(F.abs(F.col("residual")) > 2 * F.col("_sd300"), "residual", "_sd300")}
    from ..operators.windows import consecutive_counter

    f |= consecutive_counter("_high", "consecutive_high")
    for w in (60, 300):
        f |= {f"skew_{w}": R.rolling_skew("residual", w, 30, bias=True), f"kurtosis_{w}": R.rolling_kurt("residual", w, 30, bias=True)}
    f |= {"low_strength": _flag((F.col("strength_trend") < .3) | (F.col("strength_seasonal") < .3), "strength_trend", "strength_seasonal"),
          "simple_score": scalar(F.abs(F.col("z_mad_60")) * (2 - F.col("strength_trend") - F.col("strength_seasonal")), "z_mad_60", "strength_trend", "strength_seasonal")}
    return f | {k: v for k, v in _calendar(ts, ("hour", "minute")).items() if "_" in k}


def pattern(x: str) -> Features:
    f: Features = {"diff": R.diff(x), "diff2": R.second_diff(x)}
    for w in (10, 50):
        f |= {f"mean_{w}": R.rolling_mean(x, w), f"std_{w}": R.rolling_std(x, w)}
    return f


def exploration(x: str, ts: str = "ts") -> Features:
    c = X.calendar(ts)
    return {"ma_5": R.rolling_mean(x, 5), "ma_30": R.rolling_mean(x, 30), "std_30": R.rolling_std(x, 30), "z_30": R.rolling_z(x, 30), "momentum": R.diff(x, 10), **R.rsi(x, 14),
            "hour": scalar(c["hour"]), "minute": scalar(c["minute"])}


BUILDERS: dict[str, Callable[..., Features]] = {"baseline": baseline, "enhanced": enhanced, "robust": robust, "causal": causal, "binned": binned, "spectral": spectral, "residual": residual,
                                                "pattern": pattern, "exploration": exploration}


def build(df: DataFrame, spec: SeriesSpec, name: str, causal: bool = True, fill: bool = True, train: Column | None = None, **options) -> tuple[DataFrame, list[str]]:
    """Adds a feature set; returns the frame and the feature names.

    ``causal=True`` leaves out features that look ahead; ``False`` gives the complete list.  With ``fill`` gaps are closed the way
    the set prescribes; means come from the rows of ``train`` when given.
    """
    x = spec.value
    if name in ("binned", "spectral"):
        edges, lowest = (X.REGIME_EDGES, False) if name == "binned" else (X.REGIME_EDGES_EVEN, True)
        df = P.normalise_by_bin(df, x, edges, lowest, fill=0.0 if name == "spectral" else None)
        features = binned("normalised", x) if name == "binned" else spectral("normalised", **options)
    elif name in ("enhanced", "robust", "residual", "exploration"):
        features = BUILDERS[name](x, ts=spec.ts, **options)
    else:
        features = BUILDERS[name](x, **options)
    if causal:
        features = keep_causal(features)
    names = [n for n in features if not n.startswith("_")]
    filled = C.filled_along(names, name == "spectral", None if name == "spectral" else 0.0) if fill and name in ("spectral", "residual") else {}
    df, cut = cut_up(df, spec, chunk_size(df, spec, {**features, **filled}))
    if name == "robust":
        df = H.time_position(df, spec, cut).drop("since_start", "inter_arrival").withColumnRenamed("position", "time_position")
    given = df.columns
    out = with_features(df, spec, {**features, **filled}, cut=cut)
    if name == "robust":
        names.append("time_position")
    if filled:
        out = out.select(*given, *[F.col(C.FILLED_ALONG + n).alias(n) for n in names])
    out = out.drop(*[c for c in [SUB] if c in out.columns])
    return (_fill(out, x, name, names, train) if fill and not filled else out), names


def _fill(df: DataFrame, x: str, name: str, names: list[str], train: Column | None) -> DataFrame:
    if name in ("robust", "causal", "exploration"):
        return C.fill_constant(df, names)
    if name == "pattern":
        value = F.col(x)
        return df.withColumns({n: F.coalesce(F.col(n), value if n.startswith("mean") else F.lit(0.0)) for n in names})
    if name in ("baseline", "enhanced"):
        zero = [n for n in names if n.startswith(("std", "diff", "acceleration", "jerk", "pct", "skew", "kurt", "entropy", "z_", "cv", "ewm_std"))]
        return C.fill_mean(C.fill_constant(df, zero), [n for n in names if n not in zero], train)
    return df.na.drop(subset=names)
