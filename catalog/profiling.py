"""AGG rows."""

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import scalars as X
from tidemark.operators import profile as P
from tidemark.plans.features import with_features
from tidemark.plans.stats import quantiles

from .base import ALL, BY_TYPE, EV, ORD, ORD_ALL, events, over, query, r, rounded

o = f"({ORD})"
SPEED = f"{EV}, sp AS (SELECT *, 20000 + (x - 0.01) * 140 AS speed FROM ev)"


def speeds(spark, sf):
    return events(spark, sf).withColumn("speed", 20000 + (F.col("x") - 0.01) * 140)


def bin_sql(edges, lowest=False, v="speed"):
    cases = " ".join(f"WHEN {v} > {a} AND {v} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    first = f"WHEN {v} = {edges[0]} THEN 0 " if lowest else ""
    return f"CASE {first}{cases} END"


@query("agg_01_bin_statistics", f"WITH {SPEED}, b AS (SELECT {bin_sql(X.REGIME_EDGES)} AS bin, speed FROM sp) SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, "
       f"{r('avg(speed)', 4)} AS mean, {r('stddev_samp(speed)', 4)} AS std FROM b GROUP BY bin")
def bin_statistics(spark, sf):
    return rounded(P.bin_stats(speeds(spark, sf), "speed", X.REGIME_EDGES), [], ["mean", "std"], ["bin", "n"], 4)


@query("agg_02_03_hourly", f"WITH {EV} SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std, "
       f"CAST(sum(label) AS BIGINT) AS anomalies, {r('avg(label) * 100')} AS anomaly_rate_pct FROM ev GROUP BY 1")
def hourly(spark, sf):
    return rounded(P.hourly_stats(events(spark, sf), "ts", "x", "label"), [], ["mean", "std", "anomaly_rate_pct"], ["hour", "n", "anomalies"])


@query("agg_04_extreme_hours", f"WITH {EV}, c AS (SELECT hour(ts) AS h, count(*) AS c FROM ev WHERE label = 1 GROUP BY 1) SELECT "
       "CAST((SELECT h FROM c ORDER BY c DESC, h LIMIT 1) AS BIGINT) AS most_hour, CAST((SELECT h FROM c ORDER BY c, h LIMIT 1) AS BIGINT) AS least_hour, "
       "CAST(max(c) AS BIGINT) AS most, CAST(min(c) AS BIGINT) AS least FROM c")
def extreme_hours(spark, sf):
    return rounded(P.extreme_hours(events(spark, sf), "ts", "label"), [], [], ["most_hour", "least_hour", "most", "least"])


DESCRIBE = ("CAST(count(x) AS BIGINT) AS n, {} AS mean, {} AS std, min(x) AS min, max(x) AS max, {} AS q25, {} AS q50, {} AS q75").format(
    r("avg(x)"), r("stddev_samp(x)"), *[r(f"quantile_cont(x, {q})") for q in (0.25, 0.5, 0.75)])


@query("agg_05_describe", f"WITH {EV} SELECT CAST(label AS BIGINT) AS label, {DESCRIBE} FROM ev GROUP BY GROUPING SETS ((), (label))")
def describe(spark, sf):
    return rounded(P.describe(events(spark, sf), "x", "label"), ["min", "max"], ["mean", "std", "q25", "q50", "q75"], ["label", "n"])


@query("agg_06_time_range", f"WITH {EV} SELECT s, CAST(count(*) AS BIGINT) AS n, {r('epoch(max(ts) - min(ts))')} AS seconds, {r('count(*) / epoch(max(ts) - min(ts))', 9)} AS rate FROM ev GROUP BY s")
def time_range(spark, sf):
    df = P.time_range(events(spark, sf), BY_TYPE)
    return df.select("s", "n", r(F.col("seconds")).alias("seconds"), r(F.col("rate"), 9).alias("rate"))


@query("agg_07_label_distribution", f"WITH {EV} SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n, {r('count(*) / (SELECT count(*) FROM ev)')} AS share FROM ev GROUP BY label")
def label_distribution(spark, sf):
    return rounded(P.label_distribution(events(spark, sf), "label"), [], ["share"], ["label", "n"])


G1 = "(sum(power(x - mu, 3)) / count(*)) / power(sum(power(x - mu, 2)) / count(*), 1.5)"


@query("agg_08_shape_metrics", f"WITH {EV}, m AS (SELECT *, avg(x) OVER (PARTITION BY s) AS mu FROM ev) SELECT s, {r(G1)} AS skew, {r('kurtosis_pop(x)')} AS kurt, "
       f"{r('stddev_samp(x) / avg(x)')} AS cv FROM m GROUP BY s")
def shape(spark, sf):
    return rounded(P.shape_metrics(events(spark, sf), "x", ["s"]), ["s"], ["skew", "kurt", "cv"])


@query("agg_09_percentile_curve", f"WITH {EV}, c AS (SELECT quantile_cont(x, list_transform(range(101), lambda i: i / 100.0)) AS q FROM ev), "
       f"u AS (SELECT unnest(q) AS v, unnest(range(101)) AS pct FROM c) SELECT CAST(pct AS BIGINT) AS pct, {r('v')} AS value FROM u")
def percentile_curve(spark, sf):
    return rounded(P.percentile_curve(events(spark, sf), "x"), [], ["value"], ["pct"])


@query("agg_09_quantiles_by_series", f"WITH {EV} SELECT s, {r('quantile_cont(x, 0.1)')} AS q10, {r('quantile_cont(x, 0.5)')} AS q50, {r('quantile_cont(x, 0.99)')} AS q99 FROM ev GROUP BY s")
def series_quantiles(spark, sf):
    return rounded(quantiles(events(spark, sf), "x", {"q10": .1, "q50": .5, "q99": .99}, ["s"]), ["s"], ["q10", "q50", "q99"])


HIST = "least({k} - 1, CAST(floor((x - lo) / (hi - lo) * {k}) AS BIGINT))"


@query("agg_10_histogram", f"WITH {EV}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM ev), c AS (SELECT label, {HIST.format(k=50)} AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM ev, b GROUP BY 1, 2) "
       f"SELECT CAST(label AS BIGINT) AS label, bin, CAST(n AS BIGINT) AS n, {r('n / sum(n) OVER (PARTITION BY label) / ((hi - lo) / 50)', 9)} AS density, {r('lo + bin * (hi - lo) / 50')} AS left_edge FROM c")
def histogram(spark, sf):
    df = P.histogram(events(spark, sf), "x", 50, ["label"])
    return df.select(F.col("label").cast("long"), F.col("bin").cast("long"), "n", r(F.col("density"), 9).alias("density"), r(F.col("left_edge")).alias("left_edge"))


@query("agg_11_log_histogram", f"WITH {EV}, l AS (SELECT ln(1 + x) AS x FROM ev), b AS (SELECT min(x) AS lo, max(x) AS hi FROM l) SELECT {HIST.format(k=30)} AS bin, CAST(count(*) AS BIGINT) AS n FROM l, b GROUP BY 1")
def log_histogram(spark, sf):
    df = events(spark, sf).select(F.log1p("x").alias("x"))
    return P.histogram(df, "x", 30).select(F.col("bin").cast("long"), "n")


@query("agg_12_box_statistics", f"WITH {EV}, q AS (SELECT s AS g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM ev GROUP BY s) "
       f"SELECT s, {r('q1')} AS q1, {r('q2')} AS q2, {r('q3')} AS q3, min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS low_whisker, "
       "max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS high_whisker, CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers "
       "FROM ev JOIN q ON s = g GROUP BY s, q1, q2, q3")
def box(spark, sf):
    return rounded(P.box_stats(events(spark, sf), "x", ["s"]), ["s", "low_whisker", "high_whisker"], ["q1", "q2", "q3"], ["outliers"])


@query("agg_13_empirical_cdf", f"WITH {EV}, n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM ev) SELECT x, CAST(count(*) AS BIGINT) AS n, "
       f"{r('min(i) / (max(n) - 1)')} AS p_first, {r('max(i) / (max(n) - 1)')} AS p_last FROM n GROUP BY x")
def ecdf(spark, sf):
    return rounded(P.empirical_cdf(events(spark, sf), "x"), ["x"], ["p_first", "p_last"], ["n"])


CORR = f"{EV}, f AS (SELECT x, k, avg(x) OVER w60 AS m, coalesce(x - lag(x) OVER {o}, 0) AS d FROM ev WINDOW {over(60)})"
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr FROM f" for a in ("x", "k", "m", "d") for b in ("x", "k", "m", "d"))


@query("agg_14_correlations", f"WITH {CORR} {PAIRS}")
def correlations(spark, sf):
    df = with_features(events(spark, sf), BY_TYPE, {"m": R.rolling_mean("x", 60, 1), "d": R.diff("x")}).na.fill(0.0, ["d"])
    return rounded(P.correlations(df, ["x", "k", "m", "d"]), ["a", "b"], ["corr"])


ACF = (f"{EV}, c AS (SELECT s, ts, event_id, x - avg(x) OVER (PARTITION BY s) AS c FROM ev), n AS (SELECT *, row_number() OVER {o} AS i FROM c), "
       "k AS (SELECT unnest(range(51)) AS lag), v AS (SELECT s, sum(c * c) AS v FROM n GROUP BY s)")


@query("agg_15_autocorrelation", f"WITH {ACF} SELECT a.s, CAST(lag AS BIGINT) AS lag, {r('sum(a.c * b.c) / any_value(v.v)')} AS acf FROM k, n a JOIN n b ON a.s = b.s AND b.i = a.i - lag "
       "JOIN v ON v.s = a.s GROUP BY a.s, lag")
def acf(spark, sf):
    return rounded(P.autocorrelation(events(spark, sf), BY_TYPE, 50), ["s"], ["acf"], ["lag"])


@query("agg_16_label_transitions", f"WITH {EV}, n AS (SELECT label, lead(label) OVER ({ORD_ALL}) AS nx FROM ev) SELECT CAST(label AS BIGINT) AS state, CAST(nx AS BIGINT) AS next_state, "
       "CAST(count(*) AS BIGINT) AS n FROM n WHERE nx IS NOT NULL GROUP BY 1, 2")
def label_transitions(spark, sf):
    return rounded(P.label_transitions(events(spark, sf), ALL, "label"), [], [], ["state", "next_state", "n"])


@query("agg_17_decile_transitions", f"WITH {EV}, e AS (SELECT quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM ev), "
       f"d AS (SELECT s, ts, event_id, len(list_filter(q, lambda v: v < x)) AS state FROM ev, e), n AS (SELECT state, lead(state) OVER {o} AS nx FROM d), "
       "c AS (SELECT state, nx, count(*) AS n FROM n WHERE nx IS NOT NULL GROUP BY 1, 2) "
       f"SELECT CAST(state AS BIGINT) AS state, CAST(nx AS BIGINT) AS next_state, CAST(n AS BIGINT) AS n, {r('n / sum(n) OVER (PARTITION BY state)')} AS p FROM c")
def decile_transitions(spark, sf):
    return rounded(P.decile_transitions(events(spark, sf), BY_TYPE), [], ["p"], ["state", "next_state", "n"])


@query("agg_18_density_grid", f"WITH {EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i FROM ev), b AS (SELECT s AS g, max(i) AS i1, min(x) AS v0, max(x) AS v1 FROM n GROUP BY s) "
       "SELECT s, CAST(greatest(0, ceil(CAST(i * 100 AS DOUBLE) / i1) - 1) AS BIGINT) AS time_bin, CAST(greatest(0, ceil((x - v0) * 50 / (v1 - v0)) - 1) AS BIGINT) AS value_bin, "
       "CAST(sum(label) AS BIGINT) AS anomalies, CAST(count(*) AS BIGINT) AS n FROM n JOIN b ON s = g GROUP BY 1, 2, 3")
def density_grid(spark, sf):
    return rounded(P.density_grid(events(spark, sf), BY_TYPE), ["s"], [], ["time_bin", "value_bin", "anomalies", "n"])


@query("agg_19_minute_matrix", f"WITH {EV}, n AS (SELECT *, (row_number() OVER ({ORD_ALL}) - 1) // 60 AS b FROM ev) SELECT CAST(b AS BIGINT) AS block, CAST(b // 60 AS BIGINT) AS row, CAST(b % 60 AS BIGINT) AS col, "
       "CAST(max(label) AS BIGINT) AS any_flag FROM n GROUP BY b")
def minute_matrix(spark, sf):
    return rounded(P.minute_matrix(events(spark, sf), ALL), [], [], ["block", "row", "col", "any_flag"])


@query("agg_20_label_contrast", f"WITH {EV} SELECT {r('avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0)')} AS mean_diff, "
       f"{r('quantile_cont(x, 0.5) FILTER (WHERE label = 1) - quantile_cont(x, 0.5) FILTER (WHERE label = 0)')} AS median_diff FROM ev")
def label_contrast(spark, sf):
    return rounded(P.label_contrast(events(spark, sf), "x", "label"), [], ["mean_diff", "median_diff"])


AROUND = (f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i, count(*) OVER (PARTITION BY s) - 1 AS last, label - lag(label) OVER {o} AS d FROM ev), "
          "st AS (SELECT s AS g, i AS p FROM n WHERE d = 1 AND i > 60 AND i <= last - 60), pr AS (SELECT s, x, i - p AS off FROM n JOIN st ON s = g AND i BETWEEN p - 60 AND p + 60)")


@query("agg_21_before_after_starts", f"WITH {AROUND} SELECT s, CAST(count(*) FILTER (WHERE off < 0) AS BIGINT) AS n_pre, {r('avg(x) FILTER (WHERE off < 0)')} AS mean_pre, min(x) FILTER (WHERE off < 0) AS min_pre, "
       f"CAST(count(*) FILTER (WHERE off >= 0) AS BIGINT) AS n_post, {r('avg(x) FILTER (WHERE off >= 0)')} AS mean_post, min(x) FILTER (WHERE off >= 0) AS min_post FROM pr GROUP BY s")
def around_starts(spark, sf):
    return rounded(P.around_starts(events(spark, sf), BY_TYPE, "label"), ["s", "min_pre", "min_post"], ["mean_pre", "mean_post"], ["n_pre", "n_post"])


@query("agg_22_flag_gaps", f"WITH {EV}, g AS (SELECT event_id, epoch(ts - lag(ts) OVER {o}) AS gap FROM ev WHERE label = 1) SELECT event_id, {r('gap')} AS gap FROM g WHERE gap > 1 AND gap < 36000")
def flag_gaps(spark, sf):
    return rounded(P.flag_gaps(events(spark, sf), BY_TYPE, "label", 1, 36000), ["event_id"], ["gap"])


@query("agg_23_change_summary", f"WITH {EV}, d AS (SELECT s, x - lag(x) OVER {o} AS d FROM ev) SELECT s, {r('max(abs(d))')} AS max_change, {r('avg(abs(d))')} AS mean_change, {r('stddev_samp(d)')} AS volatility FROM d GROUP BY s")
def change_summary(spark, sf):
    return rounded(P.change_summary(events(spark, sf), BY_TYPE), ["s"], ["max_change", "mean_change", "volatility"])


@query("agg_24_density_curve", f"WITH {EV}, m AS (SELECT x, count(*) AS w FROM ev GROUP BY x), t AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM ev), "
       "g AS (SELECT unnest(range(200)) AS p) SELECT CAST(p AS BIGINT) AS point, "
       f"{r('any_value(lo + (hi - lo) * p / 199)')} AS at, {r('sum(w * exp(-0.5 * power((lo + (hi - lo) * p / 199 - x) / (sd * power(n, -0.2)), 2))) / any_value(n * sd * power(n, -0.2) * sqrt(2 * pi()))', 9)} AS density "
       "FROM m, t, g GROUP BY p")
def density_curve(spark, sf):
    df = P.density_curve(events(spark, sf), "x", 200)
    return df.select(F.col("point").cast("long"), r(F.col("at")).alias("at"), r(F.col("density"), 9).alias("density"))


@query("agg_25_normal_qq_fit")
def qq(spark, sf):
    return P.qq_fit(P.normal_qq(events(spark, sf), "x", "event_id"), "x")


RET = f"{EV}, d AS (SELECT x / nullif(lag(x) OVER {o}, 0) - 1 AS ret FROM ev), f AS (SELECT avg(ret) AS mu, stddev_samp(ret) AS sigma, min(ret) AS lo, max(ret) AS hi FROM d), g AS (SELECT unnest(range(100)) AS p)"


@query("agg_26_normal_fit_of_returns", f"WITH {RET} SELECT CAST(p AS BIGINT) AS point, {r('mu', 4)} AS mu, {r('sigma', 4)} AS sigma, {r('lo + (hi - lo) * p / 99', 4)} AS at, "
       f"{r('exp(-0.5 * power((lo + (hi - lo) * p / 99 - mu) / sigma, 2)) / (sigma * sqrt(2 * pi()))', 9)} AS pdf FROM f, g")
def normal_fit(spark, sf):
    df = with_features(events(spark, sf), BY_TYPE, {"ret": R.pct_change("x")})
    return P.normal_fit(df, "ret").select(F.col("point").cast("long"), *[r(F.col(c), 4).alias(c) for c in ("mu", "sigma", "at")], r(F.col("pdf"), 9).alias("pdf"))


GEV = (f"{EV}, n AS (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY x) - 1.0 AS j, CAST(count(*) OVER (PARTITION BY s) AS DOUBLE) AS n FROM ev), "
       "b AS (SELECT s, avg(x) AS b0, sum(x * j / (n - 1) / n) AS b1, sum(x * j * (j - 1) / (n - 1) / (n - 2) / n) AS b2 FROM n GROUP BY s), "
       "t AS (SELECT *, 2 / (3 + (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)) - ln(2) / ln(3) AS z FROM b), k AS (SELECT *, 7.859 * z + 2.9554 * z * z AS k FROM t), "
       "a AS (SELECT *, (2 * b1 - b0) * k / ((1 - power(2, -k)) * gamma(1 + k)) AS a FROM k), l AS (SELECT *, b0 - a * (1 - gamma(1 + k)) / k AS loc FROM a), "
       "lim AS (SELECT s AS g, k, a, loc, loc + a / k * (1 - power(-ln(0.001), k)) AS lo, loc + a / k * (1 - power(-ln(0.999), k)) AS hi FROM l)")


@query("agg_27_extreme_value_limits", f"WITH {GEV} SELECT s, {r('k')} AS shape, {r('a')} AS scale, {r('loc')} AS location, {r('lo', 4)} AS low_limit, {r('hi', 4)} AS high_limit, "
       "CAST(count(*) FILTER (WHERE x < lo) AS BIGINT) AS below, CAST(count(*) FILTER (WHERE x > hi) AS BIGINT) AS above FROM (SELECT s, x FROM ev) e JOIN lim ON s = g GROUP BY s, k, a, loc, lo, hi")
def extreme_value_limits(spark, sf):
    df = P.extreme_value_limits(events(spark, sf), "x", keys=["s"])
    return df.select("s", *[r(F.col(c)).alias(c) for c in ("shape", "scale", "location")], *[r(F.col(c), 4).alias(c) for c in ("low_limit", "high_limit")], "below", "above")


@query("agg_28_score_by_label", f"WITH {EV} SELECT CAST(label AS BIGINT) AS label, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std FROM ev GROUP BY label")
def score_by_label(spark, sf):
    df = events(spark, sf).groupBy("label").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return rounded(df, [], ["mean", "std"], ["label"])


TYPES = (f"{EV}, st AS (SELECT *, x - lag(x) OVER {o} AS step FROM ev), n AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd FROM ev WHERE label = 0), "
         "p AS (SELECT quantile_cont(step, 0.95) AS p95 FROM st WHERE label = 1)")


@query("agg_29_flag_types", f"WITH {TYPES} SELECT CASE WHEN abs(step) > p95 THEN 'sudden_change' WHEN x < mu - 2 * sd THEN 'low_speed' WHEN x > mu + 2 * sd THEN 'high_speed' ELSE 'other' END AS type, "
       "CAST(count(*) AS BIGINT) AS n FROM st, n, p WHERE label = 1 GROUP BY 1")
def flag_types(spark, sf):
    return P.classify_flagged(events(spark, sf), BY_TYPE, "label").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
