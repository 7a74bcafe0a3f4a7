"""Lag, rolling, cumulative and sequence windows (WIN rows)."""

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import smoothing as S
from tidemark.functions.expanding import expanding_quantile
from tidemark.operators import windows as W
from tidemark.plans.features import running_sum, scalar, with_features

from .base import (ALL, BY_TYPE, EV, ORD, ORD_ALL, at_least, events, over, query, r, rounded,
                   window_query)

LAGS = (1, 5, 10, 30, 60, 120)
o = f"({ORD})"

window_query("win_01_lag_lead", lambda: {**{f"lag_{k}": R.lag("x", k) for k in LAGS}, "lead_1": R.lead("x", 1)},
             {**{f"lag_{k}": f"lag(x, {k}) OVER o" for k in LAGS}, "lead_1": "lead(x, 1) OVER o"}, [f"o AS {o}"])
window_query("win_02_differences", lambda: {"d1": R.diff("x"), "d5": R.diff("x", 5), "d2": R.second_diff("x"), "d3": R.third_diff("x")},
             {"d1": "x - lag(x) OVER o", "d5": "x - lag(x,5) OVER o", "d2": "x - 2*lag(x,1) OVER o + lag(x,2) OVER o",
              "d3": "x - 3*lag(x,1) OVER o + 3*lag(x,2) OVER o - lag(x,3) OVER o"}, [f"o AS {o}"])
window_query("win_03_changes", lambda: {"pct_1": R.pct_change("x"), "pct_10": R.pct_change("x", 10), "rate_5": R.rate_of_change("x", 5),
                                "abs_5": R.diff("x", 5, absolute=True)},
             {"pct_1": "x / nullif(lag(x) OVER o, 0) - 1", "pct_10": "x / nullif(lag(x,10) OVER o, 0) - 1",
              "rate_5": "(x - lag(x,5) OVER o) / 5", "abs_5": "abs(x - lag(x,5) OVER o)"}, [f"o AS {o}"])
# means of integer cents are exact in both engines, so no rounding tie can differ
window_query("win_04_rolling_mean", lambda: {"m60": R.rolling_mean("cents", 60), "m60_1": R.rolling_mean("cents", 60, 1), "m300_60": R.rolling_mean("cents", 300, 60),
                                             "m900_180": R.rolling_mean("cents", 900, 180)},
             {"m60": at_least(60, "w60", "avg(cents) OVER w60"), "m60_1": "avg(cents) OVER w60",
              "m300_60": at_least(60, "w300", "avg(cents) OVER w300"), "m900_180": at_least(180, "w900", "avg(cents) OVER w900")},
             [over(60), over(300), over(900)], digits=None)
window_query("win_04_rolling_mean_one_series", lambda: {"m60": R.rolling_mean("cents", 60), "m1800": R.rolling_mean("cents", 1800, 180)},
             {"m60": at_least(60, "w60", "avg(cents) OVER w60"), "m1800": at_least(180, "w1800", "avg(cents) OVER w1800")},
             [over(60, ORD_ALL), over(1800, ORD_ALL)], spec=ALL, digits=None)
window_query("win_05_rolling_std_var", lambda: {"sd": R.rolling_std("x", 60, 2), "var": R.rolling_var("x", 30)},
             {"sd": at_least(2, "w60", "stddev_samp(x) OVER w60"), "var": at_least(30, "w30", "var_samp(x) OVER w30")}, [over(60), over(30)])
window_query("win_06_rolling_min_max_range", lambda: {"lo": R.rolling_min("x", 60, 1), "hi": R.rolling_max("x", 60, 1), "span": R.rolling_range("x", 300, 60)},
             {"lo": "min(x) OVER w60", "hi": "max(x) OVER w60", "span": at_least(60, "w300", "max(x) OVER w300 - min(x) OVER w300")},
             [over(60), over(300)])
window_query("win_07_rolling_quantiles", lambda: {"q10": R.rolling_quantile("x", 60, .1, 1), "med": R.rolling_median("x", 60, 1), "q90": R.rolling_quantile("x", 60, .9),
                                          "iqr": R.rolling_iqr("x", 60, 1)},
             {"q10": "quantile_cont(x, 0.1) OVER w60", "med": "quantile_cont(x, 0.5) OVER w60", "q90": at_least(60, "w60", "quantile_cont(x, 0.9) OVER w60"),
              "iqr": "quantile_cont(x, 0.75) OVER w60 - quantile_cont(x, 0.25) OVER w60"}, [over(60)])
window_query("win_06_long_min_max", lambda: {"lo": R.rolling_min("x", 300, 1), "hi": R.rolling_max("x", 900, 180)},
             {"lo": "min(x) OVER w300", "hi": at_least(180, "w900", "max(x) OVER w900")}, [over(300), over(900)])
window_query("win_07_long_rolling_quantiles", lambda: {"med300": R.rolling_median("x", 300, 6), "q25_600": R.rolling_quantile("x", 600, .25, 12), "iqr900": R.rolling_iqr("x", 900, 18)},
             {"med300": at_least(6, "w300", "quantile_cont(x, 0.5) OVER w300"), "q25_600": at_least(12, "w600", "quantile_cont(x, 0.25) OVER w600"),
              "iqr900": at_least(18, "w900", "quantile_cont(x, 0.75) OVER w900 - quantile_cont(x, 0.25) OVER w900")}, [over(300), over(600), over(900)])
window_query("win_08_rolling_skew_kurtosis", lambda: {"skew": R.rolling_skew("x", 60, 3), "kurt": R.rolling_kurt("x", 60, 4), "kurt_biased": R.rolling_kurt("x", 60, 30, bias=True)},
             {"skew": at_least(3, "w60", "skewness(x) OVER w60"), "kurt": at_least(4, "w60", "kurtosis(x) OVER w60"),
              "kurt_biased": at_least(30, "w60", "kurtosis_pop(x) OVER w60")}, [over(60)])
window_query("win_09_rolling_sum", lambda: {"total": R.rolling_sum("x", 60, 1), "n": R.rolling_count("x", 60)},
             {"total": "sum(x) OVER w60"}, [over(60)], ints={"n": "count(x) OVER w60"})


def ewm_sql(alpha: float) -> str:
    """Recursive mean from the series start: folding from the first value of a long enough window."""
    return f"list_reduce(list(x) OVER w200, lambda acc, v: acc * {1 - alpha!r} + v * {alpha!r})"


window_query("win_10_ewm_mean", lambda: {"e3": S.ewm_mean("x", .3), "e5": S.ewm_mean("x", .5)}, {"e3": ewm_sql(.3), "e5": ewm_sql(.5)}, [over(200)])


def weighted(alpha, expr):
    """Sum of ``expr(v, weight)`` over the last rows, newest weight 1."""
    n = "len(l)"
    return f"list_sum(list_transform(l, lambda v, i: {expr.replace('W', f'power({1 - alpha!r}, {n} - i)')}))"


EWM = f"{EV}, lists AS (SELECT event_id, list(x) OVER w120 AS l FROM ev WINDOW {over(120)})"
window_query("win_11_ewm_mean_adjusted", lambda: {"e95": S.ewm_mean("x", .95, True), "e30": S.ewm_mean("x", .3, True)},
             {"e95": f"{weighted(.95, 'v * W')} / {weighted(.95, 'W')}", "e30": f"{weighted(.3, 'v * W')} / {weighted(.3, 'W')}"}, [], ctes=EWM, source="lists")
S1, S2, MEAN = weighted(.3, "W"), weighted(.3, "W * W"), f"({weighted(.3, 'v * W')} / {weighted(.3, 'W')})"
STD = (f"CASE WHEN len(l) > 1 THEN sqrt(greatest(0, ({weighted(.3, 'v * v * W')} / s1 - mu * mu) * s1 * s1 / nullif(s1 * s1 - s2, 0))) END")
EWM2 = f"{EWM}, parts AS (SELECT event_id, l, {S1} AS s1, {S2} AS s2, {MEAN} AS mu FROM lists)"
window_query("win_12_ewm_std", lambda: {"sd": S.ewm_std("x", .3, True)}, {"sd": STD}, [], ctes=EWM2, source="parts", digits=5)
window_query("win_13_ewm_deviation", lambda: {"_m": S.ewm_mean("x", .3), "dev": S.ewm_deviation("x", "_m")}, {"dev": f"x - {ewm_sql(.3)}"}, [over(200)])


@query("win_13_ewm_zscore")
def ewm_zscore(spark, sf):
    a = S.span_to_alpha(60)
    f = {"mean": S.ewm_mean("x", a), "sd": S.ewm_std("x", a), "z": S.ewm_z("x", "mean", "sd")}
    return rounded(with_features(events(spark, sf), BY_TYPE, f), ["event_id"], ["mean", "sd", "z"])


window_query("win_14_rolling_zscore", lambda: {"z": R.rolling_z("x", 60), "z9": R.rolling_z("x", 60, 2, 1e-9), "z6": R.rolling_z("x", 70, None, 1e-6)},
             {"z": at_least(60, "w60", "(x - avg(x) OVER w60) / nullif(stddev_samp(x) OVER w60, 0)"),
              "z9": at_least(2, "w60", "(x - avg(x) OVER w60) / (stddev_samp(x) OVER w60 + 1e-9)"),
              "z6": at_least(70, "w70", "(x - avg(x) OVER w70) / (stddev_samp(x) OVER w70 + 1e-6)")}, [over(60), over(70)])

LISTS = f"{EV}, lists AS (SELECT *, list(x) OVER w60 AS l, quantile_cont(x, 0.5) OVER w60 AS med FROM ev WINDOW {over(60)})"
MAD = "list_median(list_transform(l, lambda v: abs(v - med)))"
window_query("win_15_rolling_mad", lambda: {"mad": R.rolling_mad("x", 60, 1)}, {"mad": MAD}, [], ctes=LISTS, source="lists")
MADS = f"{LISTS}, mads AS (SELECT *, {MAD} AS mad FROM lists)"
window_query("win_16_robust_zscore", lambda:
             {"_med": R.rolling_median("x", 60, 1), "_mad": R.rolling_mad("x", 60, 1),
              "z": scalar((F.col("x") - F.col("_med")) / (F.col("_mad") + 1e-6), "_med", "_mad"),
              "n_mads": scalar(F.abs(F.col("x") - F.col("_med")) / (F.col("_mad") + 1e-6), "_med", "_mad"),
              "over_3": scalar((F.abs(F.col("x") - F.col("_med")) > 3 * F.col("_mad")).cast("int"), "_med", "_mad")},
             {"z": "(x - med) / (mad + 1e-6)", "n_mads": "abs(x - med) / (mad + 1e-6)"}, [], ctes=MADS, source="mads",
             ints={"over_3": "CASE WHEN abs(x - med) > 3 * mad THEN 1 ELSE 0 END"}, digits=4)
QS = f"{EV}, qs AS (SELECT *, quantile_cont(x, 0.25) OVER w60 AS q1, quantile_cont(x, 0.75) OVER w60 AS q3 FROM ev WINDOW {over(60)})"
window_query("win_17_outside_iqr", lambda:
             {"q1": R.rolling_quantile("x", 60, .25, 1), "q3": R.rolling_quantile("x", 60, .75, 1),
              "outside": scalar(((F.col("x") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) |
                                 (F.col("x") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))).cast("int"), "q1", "q3")},
             {"q1": "q1", "q3": "q3"}, [], ctes=QS, source="qs",
             ints={"outside": "CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END"})
window_query("win_18_mean_median_cv", lambda:
             {"_mean": R.rolling_mean("x", 60, 2), "_med": R.rolling_median("x", 60, 2), "_sd": R.rolling_std("x", 60, 2),
              "gap": scalar(F.col("_mean") - F.col("_med"), "_mean", "_med"),
              "cv": scalar(F.col("_sd") / (F.col("_mean") + 1e-9), "_sd", "_mean"),
              "pct_dev": scalar((F.col("x") - F.col("_med")) / (F.col("_med") + 1e-9), "_med")},
             {"gap": at_least(2, "w60", "avg(x) OVER w60 - quantile_cont(x, 0.5) OVER w60"),
              "cv": at_least(2, "w60", "stddev_samp(x) OVER w60 / (avg(x) OVER w60 + 1e-9)"),
              "pct_dev": at_least(2, "w60", "(x - quantile_cont(x, 0.5) OVER w60) / (quantile_cont(x, 0.5) OVER w60 + 1e-9)")}, [over(60)])
window_query("win_19_rank_in_window", lambda: {"rank_60": R.rolling_rank("x", 60, 1)},
             {"rank_60": "(len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2.0) / len(l)"}, [], ctes=LISTS, source="lists")
POSITIVE = f"{EV}, dev AS (SELECT *, greatest(0, x - avg(x) OVER w60) AS up, greatest(0, avg(x) OVER w60 - x) AS down FROM ev WINDOW {over(60)})"
window_query("win_20_cusum_unbounded", lambda: R.cusum_unbounded("x", 60), {"positive_dev": "up", "cusum": f"sum(up) OVER ({ORD} ROWS UNBOUNDED PRECEDING)"}, [],
             ctes=POSITIVE, source="dev")
window_query("win_21_cusum_windowed", lambda: R.cusum_windowed("x", 60), {"cusum_pos": "sum(up) OVER w60", "cusum_neg": "sum(down) OVER w60"}, [over(60)],
             ctes=POSITIVE, source="dev")
window_query("win_22_cumulative_sum", lambda: {"total": running_sum(F.col("x"), "x"), "_d": R.diff("x"), "moved": running_sum(F.coalesce(F.col("_d"), F.lit(0.0)), "_d")},
             {"total": f"sum(x) OVER w", "moved": "x - first_value(x) OVER w"}, [f"w AS ({ORD} ROWS UNBOUNDED PRECEDING)"])
EXPAND = f"{EV}, e AS (SELECT *, quantile_cont(x, 0.1) OVER u AS q10, quantile_cont(x, 0.9) OVER u AS q90, count(x) OVER u AS n FROM ev WINDOW u AS ({ORD} ROWS UNBOUNDED PRECEDING))"
window_query("win_23_expanding_quantiles",
             lambda: {"q10": expanding_quantile("x", .1, 100), "q90": expanding_quantile("x", .9, 100), "below": scalar(F.when(F.col("x") < F.col("q10"), 1).otherwise(0), "q10"),
                      "above": scalar(F.when(F.col("x") > F.col("q90"), 1).otherwise(0), "q90")},
             {"q10": "CASE WHEN n >= 100 THEN q10 END", "q90": "CASE WHEN n >= 100 THEN q90 END"}, [], ctes=EXPAND, source="e",
             ints={"below": "CASE WHEN n >= 100 AND x < q10 THEN 1 ELSE 0 END", "above": "CASE WHEN n >= 100 AND x > q90 THEN 1 ELSE 0 END"})
window_query("win_24_rolling_slope", lambda: {"slope": R.rolling_slope("x", 30)},
             {"slope": at_least(30, "w30", "regr_slope(x, n) OVER w30")}, [over(30)],
             ctes=f"{EV}, num AS (SELECT *, CAST(row_number() OVER {o} - 1 AS DOUBLE) AS n FROM ev)", source="num")
window_query("win_25_trend_strength", lambda: {"r2": R.rolling_r2("x", 30)},
             {"r2": at_least(3, "w30", "CASE WHEN min(x) OVER w30 = max(x) OVER w30 THEN 0 ELSE regr_r2(x, n) OVER w30 END")}, [over(30)],
             ctes=f"{EV}, num AS (SELECT *, CAST(row_number() OVER {o} - 1 AS DOUBLE) AS n FROM ev)", source="num")
TURN = (f"{EV}, turns AS (SELECT *, CASE WHEN (x - lag(x) OVER o) * (lag(x) OVER o - lag(x,2) OVER o) < 0 THEN 1 ELSE 0 END AS t "
        f"FROM ev WINDOW o AS {o})")
window_query("win_26_direction_changes", lambda: R.direction_changes("x", 30), {}, [f"w28 AS ({ORD} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)", over(30)],
             ints={"turns_30": at_least(3, "w30", "sum(t) OVER w28")}, ctes=TURN, source="turns")
RISE = f"{EV}, rise AS (SELECT *, CASE WHEN x > lag(x) OVER {o} THEN 1 ELSE 0 END AS up FROM ev)"
window_query("win_27_rise_fall_counts", lambda: R.rise_counts("x", 30, "rises", "falls"), {}, [over(29)],
             ints={"rises": "sum(up) OVER w29", "falls": "30 - sum(up) OVER w29"}, ctes=RISE, source="rise")
window_query("win_28_window_extreme_flags", lambda: {**R.window_extreme_flags("x", 10), **R.window_extreme_flags("x", 30)}, {}, [over(10), over(30)],
             ints={f"is_{k}_{w}": f"CASE WHEN x = {k}(x) OVER w{w} THEN 1 ELSE 0 END" for w in (10, 30) for k in ("max", "min")})
window_query("win_29_local_extremes", lambda: {"low": R.local_extreme("x", True), "high": R.local_extreme("x", False)}, {}, [f"o AS {o}"],
             ints={"low": "CASE WHEN x < lag(x) OVER o AND x < lead(x) OVER o THEN 1 ELSE 0 END",
                   "high": "CASE WHEN x > lag(x) OVER o AND x > lead(x) OVER o THEN 1 ELSE 0 END"})
window_query("win_30_position_and_ratios", lambda:
             {"_lo": R.rolling_min("x", 60, 1), "_hi": R.rolling_max("x", 60, 1), "_mu": R.rolling_mean("x", 60, 1),
              "position": scalar(F.least(F.greatest((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9), F.lit(0.0)), F.lit(1.0)), "_lo", "_hi"),
              "to_mean": scalar(F.col("x") / (F.col("_mu") + 1e-6), "_mu"), "to_max": scalar(F.col("x") / (F.col("_hi") + 1e-6), "_hi")},
             {"position": "least(greatest((x - min(x) OVER w60) / (max(x) OVER w60 - min(x) OVER w60 + 1e-9), 0.0), 1.0)",
              "to_mean": "x / (avg(x) OVER w60 + 1e-6)", "to_max": "x / (max(x) OVER w60 + 1e-6)"}, [over(60)])
window_query("win_31_crossovers_macd", lambda:
             {"_a": R.rolling_mean("cents", 60, 6), "_b": R.rolling_mean("cents", 300, 30), "_c": R.rolling_mean("x", 50), "_d": R.rolling_mean("x", 500),
              "macd": scalar(F.col("_c") - F.col("_d"), "_c", "_d"),
              "cross": scalar(F.when(F.col("_a") > F.col("_b"), 1).otherwise(0), "_a", "_b")},
             {"macd": f"({at_least(50, 'w50', 'avg(x) OVER w50')}) - ({at_least(500, 'w500', 'avg(x) OVER w500')})"},
             [over(60), over(300), over(50), over(500)],
             ints={"cross": "CASE WHEN count(x) OVER w300 >= 30 AND avg(cents) OVER w60 > avg(cents) OVER w300 THEN 1 ELSE 0 END"})
STEP = f"{EV}, step AS (SELECT *, coalesce(x - lag(x) OVER {o}, 0) AS d FROM ev)"
window_query("win_32_rsi", lambda: R.rsi("x", 14),
             {"rsi": at_least(14, "w14", "CASE WHEN avg(greatest(d, 0)) OVER w14 = 0 AND avg(greatest(-d, 0)) OVER w14 = 0 THEN NULL "
                              "WHEN avg(greatest(-d, 0)) OVER w14 = 0 THEN 100 ELSE 100 - 100 / (1 + avg(greatest(d, 0)) OVER w14 / avg(greatest(-d, 0)) OVER w14) END")},
             [over(14)], ctes=STEP, source="step")
SMOOTH = f"{EV}, smooth AS (SELECT *, avg(x) OVER w5 AS a FROM ev WINDOW {over(5)})"
window_query("win_33_momentum_smooth_diff", lambda: {"momentum": R.diff("x", 10), "_a": R.rolling_mean("x", 5, 1), **{f"smooth_{k}": R.diff("_a", k) for k in (1, 5, 30)}},
             {"momentum": "x - lag(x, 10) OVER o", **{f"smooth_{k}": f"a - lag(a, {k}) OVER o" for k in (1, 5, 30)}}, [f"o AS {o}"], ctes=SMOOTH, source="smooth")


def entropy_sql(bins: int, log: str) -> str:
    cell = f"least({bins - 1}, CAST(floor((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * {bins}) AS INT))"
    share = f"(len(list_filter(c, lambda b: b = k)) / CAST(len(c) AS DOUBLE))"
    return (f"-list_sum(list_transform(range({bins}), lambda k: CASE WHEN {share} > 0 THEN {share} * {log.replace('P', share)} ELSE 0 END))",
            f"list_transform(l, lambda v: {cell})")


_nat, _cells = entropy_sql(10, "ln(P)")
_log2, _ = entropy_sql(10, "log2(P + 1e-9)")
ENT = (f"{EV}, lists AS (SELECT *, list(x) OVER w30 AS l, min(x) OVER w30 AS lo, max(x) OVER w30 AS hi FROM ev WINDOW {over(30)}), "
       f"cells AS (SELECT event_id, {_cells} AS c FROM lists)")
window_query("win_34_rolling_entropy", lambda: {"nat": R.rolling_entropy("x", 30), "bits": R.rolling_entropy("x", 30, base="log2", m=3)},
             {"nat": f"CASE WHEN len(c) >= 30 THEN {_nat} END", "bits": f"CASE WHEN len(c) >= 3 THEN {_log2} END"}, [], ctes=ENT, source="cells")
WIDTH = 70
_angle = f"2 * pi() * k * (i - 1) / {WIDTH}"
_mag2 = (f"list_transform(range({WIDTH // 2 + 1}), lambda k: power(list_sum(list_transform(l, lambda v, i: v * cos({_angle}))), 2) "
         f"+ power(list_sum(list_transform(l, lambda v, i: v * sin({_angle}))), 2))")
SPEC = (f"{EV}, lists AS (SELECT event_id, list(x) OVER w70 AS l FROM ev WINDOW {over(70)}), "
        f"spec AS (SELECT event_id, CASE WHEN len(l) = {WIDTH} THEN {_mag2} END AS p FROM lists), "
        "norm AS (SELECT event_id, p, list_sum(p) AS total, list_transform(p, lambda v: sqrt(v)) AS m FROM spec)")
window_query("win_35_spectral", lambda: {"centroid": R.spectral("x", 70), "sp_entropy": R.spectral("x", 70, "entropy")},
             {"centroid": f"list_sum(list_transform(m, lambda v, i: v * (i - 1) / {WIDTH}.0)) / list_sum(m)",
              "sp_entropy": "-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v / total * ln(v / total) ELSE 0 END))"}, [], ctes=SPEC, source="norm")


def around(w):
    return f"c{w} AS ({ORD} ROWS BETWEEN {w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING)"


window_query("win_36_centred", lambda: {"m60": R.centred_mean("x", 60), "sd31": R.centred_mean("x", 31, std=True), "_c": R.centred_mean("x", 60),
                                "detrended": scalar(F.col("x") - F.col("_c"), "_c", non_causal=True)},
             {"m60": at_least(60, "c60", "avg(x) OVER c60"), "sd31": at_least(31, "c31", "stddev_samp(x) OVER c31"),
              "detrended": at_least(60, "c60", "x - avg(x) OVER c60")}, [around(60), around(31)])
window_query("win_37_two_sigma_band", lambda:
             {"_m": R.rolling_mean("x", 100, 1), "_s": R.rolling_std("x", 100, 2), "upper": scalar(F.col("_m") + 2 * F.col("_s"), "_m", "_s"),
              "lower": scalar(F.col("_m") - 2 * F.col("_s"), "_m", "_s")},
             {"upper": at_least(2, "w100", "avg(x) OVER w100 + 2 * stddev_samp(x) OVER w100"),
              "lower": at_least(2, "w100", "avg(x) OVER w100 - 2 * stddev_samp(x) OVER w100")}, [over(100)])
HIGH = (f"{EV}, fl AS (SELECT *, CASE WHEN abs(x - 50) > 2 * (CASE WHEN count(x) OVER w300 >= 30 THEN stddev_samp(x) OVER w300 END) THEN 1 ELSE 0 END AS f, "
        f"row_number() OVER {o} AS n FROM ev WINDOW {over(300)}), runs AS (SELECT *, coalesce(max(CASE WHEN f = 0 THEN n END) OVER "
        f"({ORD} ROWS UNBOUNDED PRECEDING), 0) AS z FROM fl)")
def high():
    return {"_c": scalar(F.col("x") - 50, "x"), "_sd": R.rolling_std("_c", 300, 30),
        "high": scalar(F.when(F.abs(F.col("_c")) > 2 * F.col("_sd"), 1).otherwise(0), "_c", "_sd")}


window_query("win_38_consecutive_counter", lambda: {**high(), **W.consecutive_counter("high", "streak")}, {}, [], ints={"high": "f", "streak": "n - z"}, ctes=HIGH, source="runs")
window_query("win_39_high_residual_flag", high, {}, [], ints={"high": "f"}, ctes=HIGH, source="fl")


TOP = (f"{EV}, a AS (SELECT *, avg(x) OVER w1000 AS mu, stddev_samp(x) OVER w1000 AS sd, quantile_cont(x, 0.5) OVER w1000 AS med, "
       f"count(x) OVER w1000 AS n, list(x) OVER w1000 AS l, abs(x - lag(x) OVER {o}) AS ch FROM ev WINDOW {over(1000)}), "
       "b AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - med))) AS mad FROM a WHERE n >= 1000), "
       f"c AS (SELECT event_id, abs(x - mu) / sd + abs(x - med) / mad + ch / st AS score FROM b, LATERAL (SELECT 1) u, "
       f"(SELECT s AS s2, event_id AS e2, stddev_samp(x) OVER w1000 AS st FROM ev WINDOW {over(1000)}) t WHERE t.e2 = b.event_id)")


@query("win_40_multi_metric_top", f"WITH {TOP} SELECT event_id, {r('score', 5)} AS score FROM c ORDER BY round(score, 5) DESC, event_id LIMIT 1000")
def multi_metric(spark, sf):
    df = W.multi_metric_score(events(spark, sf), BY_TYPE, 1000)
    return rounded(df, ["event_id"], ["score"], digits=5).filter("score is not null").orderBy(F.desc("score"), "event_id").limit(1000)


TWO = (f"{EV}, z AS (SELECT *, x - avg(x) OVER w60 AS r60, x - avg(x) OVER w300 AS r300 FROM ev WINDOW {over(60)}, {over(300)}), "
       "g AS (SELECT s AS gs, stddev_pop(r60) AS s60, stddev_pop(r300) AS s300 FROM z GROUP BY 1)")


@query("win_41_multi_scale_agreement", f"WITH {TWO} SELECT event_id, CAST(CASE WHEN abs(r60) > 2 * s60 AND abs(r300) > 2 * s300 THEN 1 ELSE 0 END AS BIGINT) AS agree "
       "FROM z JOIN g ON s = gs")
def multi_scale(spark, sf):
    f = {"_a": R.rolling_mean("x", 60, 1), "_b": R.rolling_mean("x", 300, 1), "r60": scalar(F.col("x") - F.col("_a"), "_a"), "r300": scalar(F.col("x") - F.col("_b"), "_b")}
    return W.scale_agreement(with_features(events(spark, sf), BY_TYPE, f), ["s"], "r60", "r300").select("event_id", F.col("agree").cast("long"))


SEQ = (f"{EV}, q AS (SELECT event_id, count(*) OVER w40 AS n, sum(CAST(round(x * 100) AS BIGINT)) OVER w40 AS cents, first_value(x) OVER w40 AS first_x, "
       f"x AS last_x, label AS last_label, max(label) OVER w40 AS any_label, lead(x) OVER (ORDER BY_) AS next_x FROM ev WINDOW {over(40)})").replace("(ORDER BY_)", o)


@query("win_42_sequences", f"WITH {SEQ} SELECT event_id, first_x, last_x, next_x, CAST(cents AS BIGINT) AS cents, CAST(last_label AS BIGINT) AS last_label, "
       "CAST(any_label AS BIGINT) AS any_label FROM q WHERE n = 40")
def sequences(spark, sf):
    df = W.sequences(events(spark, sf), BY_TYPE, 40, ["x"])
    cents = F.aggregate("x_seq", F.lit(0).cast("long"), lambda a, v: a + F.round(v * 100).cast("long"))
    return df.select("event_id", F.col("x_seq")[0].alias("first_x"), F.col("x_seq")[39].alias("last_x"), "next_x", cents.alias("cents"),
                     F.col("last_label").cast("long"), F.col("any_label").cast("long"))


def sliding_sql(size, step):
    return (f"{EV}, num AS (SELECT *, row_number() OVER {o} - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM ev), "
            f"mem AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - {size - 1}) / {step}.0)) AS BIGINT), CAST(floor(i / {step}) AS BIGINT) + 1)) AS win FROM num)")


@query("win_43_sliding_windows", f"WITH {sliding_sql(128, 64)} SELECT s, win, CAST(min(i) AS BIGINT) AS start_idx, CAST(count(*) AS BIGINT) AS n, {r('avg(x)', 9)} AS mean, "
       f"{r('stddev_pop(x)')} AS sd, {r('(max(x) - avg(x)) / stddev_pop(x)')} AS top_z FROM mem WHERE win * 64 + 128 <= n GROUP BY s, win")
def sliding(spark, sf):
    df = W.sliding_windows(events(spark, sf), BY_TYPE, 128, 64, normalise=True)
    top = F.array_max("values")
    return df.select("s", "win", F.col("start_idx"), F.size("values").cast("long").alias("n"), r(F.col("mean"), 9).alias("mean"), r(F.col("sd")).alias("sd"), r(top).alias("top_z"))


TIMEWIN = (f"{EV}, b AS (SELECT s, min(ts) AS t0, max(ts) AS t1 FROM ev GROUP BY s), gen AS (SELECT s, t0, t1, unnest(range(0, "
           "CAST(floor(epoch(t1 - t0) / 43200.0) AS BIGINT) + 1)) AS win FROM b), win AS (SELECT s AS gs, win, t0 + win * INTERVAL 12 HOUR AS w0, "
           "least(t0 + win * INTERVAL 12 HOUR + INTERVAL 24 HOUR, t1) AS w1 FROM gen)")


@query("win_44_time_windows", f"WITH {TIMEWIN} SELECT s, win, CAST(count(*) AS BIGINT) AS n, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS sd, min(x) AS lo, max(x) AS hi "
       "FROM ev JOIN win ON s = gs AND ts BETWEEN w0 AND w1 GROUP BY s, win HAVING count(*) >= 2")
def time_windows(spark, sf):
    df = W.time_windows(events(spark, sf), BY_TYPE, size_seconds=86400, overlap=0.5)
    return df.select("s", "win", "n", r(F.col("mean")).alias("mean"), r(F.col("sd")).alias("sd"), "lo", "hi")


PERF = (f"{EV}, c AS (SELECT *, CASE WHEN x > 100 THEN 1 ELSE 0 END AS p, row_number() OVER {o} - 1 AS i FROM ev), "
        "d AS (SELECT s, i, sum(p * label) OVER w AS tp, sum(p * (1 - label)) OVER w AS fp, sum((1 - p) * label) OVER w AS fn, "
        f"sum((1 - p) * (1 - label)) OVER w AS tn FROM c WINDOW w AS ({ORD} ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING))")


@query("win_45_rolling_performance", f"WITH {PERF} SELECT s, CAST(i AS BIGINT) AS idx, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, "
       f"{r('CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1, {r('0.5 * (tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp))')} AS balanced_accuracy "
       "FROM d WHERE i >= 1000 AND i % 100 = 0 AND tp + fn > 0 AND tn + fp > 0")
def rolling_performance(spark, sf):
    df = events(spark, sf).withColumn("pred", (F.col("x") > 100).cast("int"))
    df = W.rolling_performance(df, BY_TYPE, "pred", size=1000, step=100)
    return rounded(df, ["s"], ["f1", "balanced_accuracy"], ["idx", "tp", "fp", "fn"])


PROFILE = (f"{EV}, f AS (SELECT *, CASE WHEN x > 20 THEN 1 ELSE 0 END AS hot FROM ev), g AS (SELECT *, row_number() OVER {o} - row_number() OVER "
           "(PARTITION BY s, hot ORDER BY ts, event_id) AS isl FROM f), h AS (SELECT s, event_id, isl, row_number() OVER (PARTITION BY s, isl ORDER BY ts, event_id) AS pos, "
           "count(*) OVER (PARTITION BY s, isl) AS n, min(ts) OVER (PARTITION BY s, isl) AS t0, x FROM g WHERE hot = 1), "
           "i AS (SELECT *, dense_rank() OVER (PARTITION BY s ORDER BY t0) AS run FROM h WHERE n > 10)")


@query("win_46_run_profiles", f"WITH {PROFILE} SELECT s, event_id, CAST(run AS BIGINT) AS run, {r('(pos - 1) / (n - 1.0)')} AS position, x FROM i WHERE run <= 20")
def run_profiles(spark, sf):
    df = events(spark, sf).withColumn("hot", (F.col("x") > 20).cast("int"))
    df = W.run_profiles(df, BY_TYPE, "hot", longer_than=10, first=20)
    return df.select("s", "event_id", F.col("run").cast("long"), r(F.col("position")).alias("position"), "x")
