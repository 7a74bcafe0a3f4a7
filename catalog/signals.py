"""SIG rows."""

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import smoothing as S
from tidemark.operators import detect as D
from tidemark.operators import signals as G
from tidemark.operators import windows as W
from tidemark.plans.features import scalar, with_features

from .base import BY_TYPE, EV, ORD, at_least, events, over, query, r, rounded, window_query
from .windows import ewm_sql

o = f"({ORD})"


def dots(weights):
    return "[" + ", ".join(repr(float(w)) for w in weights) + "]::DOUBLE[]"


def savgol_sql(w):
    """Middle rows use one weight vector; each of the first and last ``w // 2`` rows has its own over the first/last ``w`` values."""
    half = w // 2
    edge = "[" + ", ".join(dots(S.polynomial_weights(w, 3, i)) for i in range(half)) + "]"
    rev = "[" + ", ".join(dots(S.polynomial_weights(w, 3, w - 1 - i)) for i in range(half)) + "]"
    return (f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i, count(*) OVER (PARTITION BY s) AS n, list(x) OVER c AS l FROM ev WINDOW c AS ({ORD} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)), "
            f"e AS (SELECT s AS es, list(x ORDER BY i) FILTER (WHERE i < {w}) AS head, list(x ORDER BY i) FILTER (WHERE i >= n - {w}) AS tail FROM n GROUP BY s), "
            f"q AS (SELECT event_id, x, CASE WHEN i < {half} THEN list_dot_product(head, ({edge})[CAST(i AS INT) + 1]) WHEN i >= n - {half} THEN list_dot_product(tail, ({rev})[CAST(n - i AS INT)]) "
            f"ELSE list_dot_product(l, {dots(S.polynomial_weights(w, 3, half))}) END AS y FROM n JOIN e ON s = es)")


window_query("sig_01_02_savgol_51", lambda: {"y": S.savgol("x", 51), "dev": scalar(F.col("x") - F.col("y"), "y"), "dev_abs": scalar(F.abs(F.col("dev")), "dev")},
             {"y": "y", "dev": "x - y", "dev_abs": "abs(x - y)"}, [], ctes=savgol_sql(51), source="q")


@query("sig_03_butterworth")
def butterworth(spark, sf):
    return rounded(with_features(events(spark, sf), BY_TYPE, {"smooth": S.butterworth_smooth("x")}), ["event_id"], ["smooth"])


@query("sig_04_kalman", f"WITH RECURSIVE {EV}, n AS (SELECT s, event_id, x, row_number() OVER {o} AS i FROM ev), "
       "k AS (SELECT s, event_id, i, x AS level, 1.00001 * 0.1 / (1.00001 + 0.1) AS p, x FROM n WHERE i = 1 UNION ALL "
       "SELECT n.s, n.event_id, n.i, k.level + (k.p + 1e-5) / (k.p + 1e-5 + 0.1) * (n.x - k.level), (1 - (k.p + 1e-5) / (k.p + 1e-5 + 0.1)) * (k.p + 1e-5), n.x FROM k JOIN n ON n.s = k.s AND n.i = k.i + 1) "
       f"SELECT event_id, {r('level')} AS level, {r('x - level')} AS residual, {r('abs(x - level)')} AS residual_abs FROM k")
def kalman(spark, sf):
    f = {"level": S.kalman_level("x"), "residual": scalar(F.col("x") - F.col("level"), "level"), "residual_abs": scalar(F.abs(F.col("residual")), "residual")}
    return rounded(with_features(events(spark, sf), BY_TYPE, f), ["event_id"], ["level", "residual", "residual_abs"])


SMOOTH = f"{EV}, e AS (SELECT *, {ewm_sql(.3)} AS e FROM ev WINDOW {over(200)}), d AS (SELECT *, coalesce(e - lag(e) OVER {o}, 0) AS d1 FROM e)"
window_query("sig_05_smooth_derivatives", lambda: S.derivatives("x"), {"derivative_1": "d1", "derivative_2": f"coalesce(d1 - lag(d1) OVER {o}, 0)"}, [], ctes=SMOOTH, source="d")

PERIOD = 24
_past = [f"lag(flat, {k * PERIOD}) OVER {o}" for k in (1, 2, 3)]
_known = " + ".join(f"CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END" for p in _past)
DECOMP = (f"{EV}, t AS (SELECT *, {at_least(PERIOD, f'w{PERIOD}', f'avg(x) OVER w{PERIOD}')} AS trend FROM ev WINDOW {over(PERIOD)}), f AS (SELECT *, x - trend AS flat FROM t), "
          f"g AS (SELECT *, ({' + '.join(f'coalesce({p}, 0)' for p in _past)}) / nullif({_known}, 0) AS seasonal FROM f), h AS (SELECT *, flat - seasonal AS residual FROM g), "
          f"st AS (SELECT *, greatest(0, 1 - var_pop(residual) OVER w96 / nullif(var_pop(trend + residual) OVER w96, 0)) AS strength_trend, greatest(0, 1 - var_pop(residual) OVER w96 / nullif(var_pop(seasonal + residual) OVER w96, 0)) AS strength_seasonal, "
          f"count(residual) OVER w96 AS nr FROM h WINDOW {over(96)})")
window_query("sig_06_causal_decomposition", lambda: S.causal_decompose("x", PERIOD), {"trend": "trend", "seasonal": "seasonal", "residual": "residual"}, [], ctes=DECOMP, source="h")


LONG = (f"{EV}, t AS (SELECT *, {at_least(900, 'w900', 'avg(x) OVER w900')} AS trend FROM ev WINDOW {over(900)}), f AS (SELECT *, x - trend AS flat FROM t), "
        f"h AS (SELECT *, lag(flat, 900) OVER {o} AS seasonal, flat - lag(flat, 900) OVER {o} AS residual FROM f)")
window_query("sig_06_causal_decomposition_900", lambda: S.causal_decompose("x", 900), {"trend": "trend", "seasonal": "seasonal", "residual": "residual"}, [], ctes=LONG, source="h")


@query("sig_06_component_strength", f"WITH {DECOMP} SELECT event_id, {r('strength_trend')} AS strength_trend, {r('strength_seasonal')} AS strength_seasonal FROM st WHERE nr >= 2")
def strength(spark, sf):
    f = {**S.causal_decompose("x", PERIOD), **S.strengths(96), "nr": R.rolling_count("residual", 96)}
    return rounded(with_features(events(spark, sf), BY_TYPE, f).filter("nr >= 2"), ["event_id"], ["strength_trend", "strength_seasonal"])


RESID = (f"{DECOMP}, r AS (SELECT *, avg(residual) OVER w30 AS m, CASE WHEN count(residual) OVER w30 >= 2 THEN stddev_samp(residual) OVER w30 END AS sd, avg(abs(residual)) OVER w30 AS am, residual - lag(residual, 5) OVER {o} AS d5, "
         f"trend - lag(trend, 10) OVER {o} AS t10, quantile_cont(residual, 0.5) OVER w30 AS med FROM h WINDOW {over(30)})")
window_query("sig_07_residual_features",
             lambda: {**S.causal_decompose("x", PERIOD), "m": R.rolling_mean("residual", 30, 1), "sd": R.rolling_std("residual", 30, 2), "_a": scalar(F.abs(F.col("residual")), "residual"), "am": R.rolling_mean("_a", 30, 1),
                      "med": R.rolling_median("residual", 30, 1), "d5": R.diff("residual", 5), "t10": R.diff("trend", 10), "expected_gap": scalar(F.col("x") - F.col("trend") - F.col("seasonal"), "trend", "seasonal"),
                      "ratio": scalar(F.col("x") / (F.col("trend") + 1e-8), "trend")},
             {"m": "m", "sd": "sd", "am": "am", "med": "med", "d5": "d5", "t10": "t10", "expected_gap": "x - trend - seasonal", "ratio": "x / (trend + 1e-8)"}, [], ctes=RESID, source="r", digits=8)


def windows_sql(size, step):
    return (f"{EV}, n AS (SELECT s, x, row_number() OVER {o} - 1 AS i FROM ev), m AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - {size - 1}) / {step}.0)) AS BIGINT), CAST(i // {step} AS BIGINT) + 1)) AS win FROM n), "
            f"w AS (SELECT s, win, list(x ORDER BY i) AS l FROM m GROUP BY s, win HAVING count(*) = {size})")


def half(name, sign):
    return f"list_transform(range(len({name}) // 2), lambda k: ({name}[CAST(2 * k + 1 AS INT)] {sign} {name}[CAST(2 * k + 2 AS INT)]) / sqrt(2))"


HAAR = (f"{windows_sql(128, 64)}, a1 AS (SELECT s, win, {half('l', '+')} AS a, {half('l', '-')} AS d4 FROM w), a2 AS (SELECT s, win, d4, {half('a', '+')} AS b, {half('a', '-')} AS d3 FROM a1), "
        f"a3 AS (SELECT s, win, d4, d3, {half('b', '+')} AS c, {half('b', '-')} AS d2 FROM a2), a4 AS (SELECT s, win, d4, d3, d2, {half('c', '+')} AS a, {half('c', '-')} AS d1 FROM a3)")
_energy = {f"detail_{i}_energy": f"list_sum(list_transform(d{i}, lambda v: v * v))" for i in (1, 2, 3, 4)} | {"approx_energy": "list_sum(list_transform(a, lambda v: v * v))", "approx_mean": "list_avg(a)"}
_cross = {f"detail_{i}_zero_crossings": f"len(list_filter(range(1, len(d{i})), lambda k: sign(d{i}[CAST(k AS INT)]) <> sign(d{i}[CAST(k + 1 AS INT)])))" for i in (3, 4)}


@query("sig_09_10_haar_features", f"WITH {HAAR} SELECT s, win, " + ", ".join(f"{r(e, 8)} AS {n}" for n, e in _energy.items()) + ", " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in _cross.items()) + " FROM a4")
def haar(spark, sf):
    w = W.sliding_windows(events(spark, sf), BY_TYPE, 128, 64)
    f = G.wavelet_features(w, 128, "haar", keep=["s", "win"])
    return rounded(f, ["s", "win"], list(_energy), list(_cross), 8)


@query("sig_09_10_db4_features")
def db4(spark, sf):
    w = W.sliding_windows(events(spark, sf), BY_TYPE, 100, 10)
    f = G.wavelet_features(w, 100, "db4", keep=["s", "win"])
    return rounded(f, ["s", "win"], [c for c in f.columns if c not in ("s", "win")])


@query("sig_09_wavelet_reconstruction", f"WITH {windows_sql(128, 64)} SELECT s, win, {r('l[1]')} AS first_x, {r('l[128]')} AS last_x, {r('list_sum(l)', 4)} AS total FROM w")
def reconstruct(spark, sf):
    w = G.wavelet_coefficients(W.sliding_windows(events(spark, sf), BY_TYPE, 128, 64), 128, "db4")
    v = G.wavelet_reconstruct(w, 128, "db4")
    return v.select("s", "win", r(F.col("rebuilt")[0]).alias("first_x"), r(F.col("rebuilt")[127]).alias("last_x"), r(F.aggregate("rebuilt", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("sig_11_segment_spectrum")
def spectrum(spark, sf):
    return rounded(G.segment_spectrum(events(spark, sf), BY_TYPE, 1024), ["s", "segment"], ["frequency", "amplitude", "power"], ["bin"])


def psd_sql(size, taper):
    angle = f"2 * pi() * k * (j - 1) / {size}"
    return (f"list_transform(range({size // 2 + 1}), lambda k: (power(list_sum(list_transform(t, lambda v, j: v * cos({angle}))), 2) + power(list_sum(list_transform(t, lambda v, j: v * sin({angle}))), 2)) "
            f"* CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END / {float((taper ** 2).sum())!r})")


WELCH = (f"{windows_sql(256, 128)}, c AS (SELECT s, win, list_transform(l, lambda v, j: (v - list_avg(l)) * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / 256))) AS t FROM w), "
         f"p AS (SELECT s, unnest({psd_sql(256, G._taper('hann', 256))}) AS p, unnest(range(129)) AS bin FROM c)")


@query("sig_12_welch", f"WITH {WELCH} SELECT s, CAST(bin AS BIGINT) AS bin, {r('bin / 256')} AS frequency, {r('avg(p)', 4)} AS density, CAST(count(*) AS BIGINT) AS segments FROM p GROUP BY s, bin")
def welch(spark, sf):
    df = G.welch(events(spark, sf), BY_TYPE)
    return df.select("s", F.col("bin").cast("long"), r(F.col("frequency")).alias("frequency"), r(F.col("density"), 4).alias("density"), "segments")


@query("sig_12_spectrogram")
def spectrogram(spark, sf):
    return rounded(G.spectrogram(events(spark, sf), BY_TYPE), ["s", "win"], ["frequency", "time", "density"], ["bin"])


PEAK = (f"{EV}, d AS (SELECT s, row_number() OVER {o} - 1 AS i, abs(x - lag(x) OVER {o}) AS d FROM ev), st AS (SELECT *, CASE WHEN d IS NOT DISTINCT FROM lag(d) OVER (PARTITION BY s ORDER BY i) THEN 0 ELSE 1 END AS new FROM d), "
        "g AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY i) AS grp FROM st), t AS (SELECT s, grp, min(i) AS a, max(i) AS b, any_value(d) AS d FROM g GROUP BY s, grp), "
        "n AS (SELECT *, lag(d) OVER (PARTITION BY s ORDER BY grp) AS before, lead(d) OVER (PARTITION BY s ORDER BY grp) AS after FROM t), p AS (SELECT quantile_cont(d, 0.95) AS lim FROM d)")


@query("sig_13_changepoint_peaks", f"WITH {PEAK} SELECT s, CAST((a + b) // 2 AS BIGINT) AS idx, {r('d')} AS step FROM n, p WHERE d > before AND d > after AND d >= lim")
def peaks(spark, sf):
    return rounded(D.changepoint_peaks(events(spark, sf), BY_TYPE), ["s"], ["step"], ["idx"])


FIELD = (f"{windows_sql(32, 32)}, v AS (SELECT s, win, list_transform(l, lambda v: CASE WHEN list_max(l) > list_min(l) THEN 2 * (v - list_min(l)) / (list_max(l) - list_min(l)) - 1 ELSE 0 END) AS c FROM w), "
         "e AS (SELECT s, win, unnest(c) AS a, c FROM v), f AS (SELECT s, win, a * b - sqrt(greatest(0, 1 - a * a)) * sqrt(greatest(0, 1 - b * b)) AS g FROM (SELECT s, win, a, unnest(c) AS b FROM e))")


@query("sig_14_angular_field", f"WITH {FIELD} SELECT s, win, CAST(count(*) AS BIGINT) AS cells, {r('sum(g)')} AS total, {r('min(g)')} AS lowest, {r('max(g)')} AS highest FROM f GROUP BY s, win")
def angular_field(spark, sf):
    w = G.angular_field(W.sliding_windows(events(spark, sf), BY_TYPE, 32, 32).select("s", "win", "values"))
    flat = F.flatten("field")
    return w.select("s", "win", F.size(flat).cast("long").alias("cells"), r(F.aggregate(flat, F.lit(0.0), lambda a, b: a + b)).alias("total"), r(F.array_min(flat)).alias("lowest"), r(F.array_max(flat)).alias("highest"))


@query("sig_15_min_max", f"WITH {EV}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM ev) SELECT event_id, {r('(x - lo) / (hi - lo)')} AS scaled, {r('x')} AS back FROM ev, b")
def min_max(spark, sf):
    df = G.min_max_scale(events(spark, sf), ["x"])
    back = G.undo_min_max(df.withColumn("scaled", F.col("x")), "x")
    return rounded(back.withColumn("back", F.col("x")), ["event_id"], ["scaled", "back"])


@query("sig_16_standard_and_robust", f"WITH {EV}, b AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, quantile_cont(k, 0.25) AS q1, quantile_cont(k, 0.5) AS q2, quantile_cont(k, 0.75) AS q3 FROM ev WHERE label = 0) "
       f"SELECT event_id, {r('(x - mu) / sd')} AS standard, {r('(k - q2) / (q3 - q1)')} AS robust FROM ev, b")
def scaling(spark, sf):
    normal = F.col("label") == 0
    df = events(spark, sf).withColumns({"standard": F.col("x"), "robust": F.col("k").cast("double")})
    return rounded(G.robust_scale(G.standardise(df, ["standard"], train=normal), ["robust"], train=normal), ["event_id"], ["standard", "robust"])
