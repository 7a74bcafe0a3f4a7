"""DET rows."""

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import detect as D
from tidemark.operators import evaluate as E
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.plans.features import scalar, with_features

from .base import BY_TYPE, EV, ORD, events, over, query, r, rounded

o = f"({ORD})"


@query("det_01_iqr_outliers", f"WITH {EV}, q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM ev) SELECT event_id, CAST(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END AS BIGINT) AS outlier FROM ev, q")
def iqr(spark, sf):
    return rounded(D.iqr_outliers(events(spark, sf), "x"), ["event_id"], [], ["outlier"])


@query("det_02_z_outliers", f"WITH {EV}, b AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM ev) SELECT event_id, {r('(x - mu) / sd')} AS z, CAST(CASE WHEN abs((x - mu) / sd) > 3 THEN 1 ELSE 0 END AS BIGINT) AS outlier FROM ev, b")
def z(spark, sf):
    return rounded(D.z_outliers(events(spark, sf), "x"), ["event_id"], ["z"], ["outlier"])


RZ = (f"{EV}, a AS (SELECT *, avg(x) OVER w300 AS mu, stddev_samp(x) OVER w300 AS sd, quantile_cont(x, 0.5) OVER w300 AS med, count(x) OVER w300 AS n, list(x) OVER w300 AS l FROM ev WINDOW {over(300)}), "
      "b AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - med))) AS mad FROM a)")


@query("det_03_rolling_outlier_counts", f"WITH {RZ} SELECT s, CAST(count(*) FILTER (WHERE n >= 300 AND abs(x - mu) / sd > 3) AS BIGINT) AS z_outliers, CAST(count(*) FILTER (WHERE n >= 300 AND abs(x - med) / mad > 3) AS BIGINT) AS mad_outliers FROM b GROUP BY s")
def rolling_outliers(spark, sf):
    f = {"_z": R.rolling_z("x", 300), "_med": R.rolling_median("x", 300), "_mad": R.rolling_mad("x", 300), "zo": scalar(F.abs("_z") > 3, "_z"),
         "mo": scalar(F.abs(F.col("x") - F.col("_med")) > 3 * F.col("_mad"), "_med", "_mad")}
    return with_features(events(spark, sf), BY_TYPE, f).groupBy("s").agg(F.count_if("zo").alias("z_outliers"), F.count_if("mo").alias("mad_outliers"))


@query("det_05_normal_baseline", f"WITH {EV}, b AS (SELECT s AS g, avg(x) AS mu, stddev_samp(x) AS sd FROM ev WHERE label = 0 GROUP BY s) SELECT event_id, {r('(x - mu) / sd')} AS z FROM ev JOIN b ON s = g")
def baseline(spark, sf):
    return rounded(D.normal_baseline_z(events(spark, sf), "x", "label", ["s"]), ["event_id"], ["z"])


@query("det_06_normal_percentile_threshold", f"WITH {EV}, t AS (SELECT quantile_cont(x, 0.95) AS t FROM ev WHERE label = 0) SELECT event_id, {r('t')} AS threshold, CAST(CASE WHEN x > t THEN 1 ELSE 0 END AS BIGINT) AS pred FROM ev, t")
def normal_percentile(spark, sf):
    df = events(spark, sf)
    t = D.percentile_threshold(df, "x", 95, F.col("label") == 0)
    return rounded(D.apply_threshold(df, "x", t), ["event_id"], ["threshold"], ["pred"])


@query("det_07_percentile_threshold", f"WITH {EV}, t AS (SELECT quantile_cont(x, 0.8) AS t FROM ev) SELECT event_id, CAST(CASE WHEN x > t THEN 1 ELSE 0 END AS BIGINT) AS pred FROM ev, t")
def score_percentile(spark, sf):
    df = events(spark, sf)
    return rounded(D.apply_threshold(df, "x", D.percentile_threshold(df, "x", 80)), ["event_id"], [], ["pred"])


MZ = (f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i FROM ev), m AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 99) / 20.0)) AS BIGINT), CAST(i // 20 AS BIGINT) + 1)) AS win FROM n), "
      "w AS (SELECT s, win, avg(x) AS a, stddev_pop(x) AS b, max(x) AS c FROM m GROUP BY 1, 2 HAVING count(*) = 100), t AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM w)")


@query("det_08_max_feature_z", f"WITH {MZ} SELECT s, win, {r('greatest(abs(a - ma) / sa, abs(b - mb) / sb, abs(c - mc) / sc)')} AS max_z FROM w, t")
def max_z(spark, sf):
    w = W.sliding_windows(events(spark, sf), BY_TYPE, 100, 20).withColumn("top", F.array_max("values"))
    return rounded(D.max_feature_z(w, ["mean", "sd", "top"]), ["s", "win"], ["max_z"])


TAIL = (f"{EV}, t AS (SELECT quantile_cont(x, 0.98) AS t, count(*) AS n FROM ev), p AS (SELECT x - t AS y, t, n FROM ev, t WHERE x > t), "
        "f AS (SELECT any_value(t) AS t, any_value(n) AS n, count(*) AS np, avg(y) AS m1, avg(y * y) AS m2 FROM p), g AS (SELECT *, 0.5 * (m1 * m1 / m2 - 1) AS gamma, 0.5 * m1 * (m1 * m1 / m2 + 1) AS sigma FROM f)")


@query("det_09_tail_fit_moments", f"WITH {TAIL} SELECT {r('t')} AS t, CAST(np AS BIGINT) AS n_peaks, {r('gamma')} AS gamma, {r('sigma')} AS sigma, {r('t + sigma / gamma * (power(0.001 * n / np, -gamma) - 1)')} AS z_q FROM g")
def tail_moments(spark, sf):
    return rounded(D.tail_fit_moments(events(spark, sf), "x"), [], ["t", "gamma", "sigma", "z_q"], ["n_peaks"])


@query("det_09_tail_fit_likelihood")
def tail_likelihood(spark, sf):
    return rounded(D.tail_fit_likelihood(events(spark, sf), "x"), [], ["t", "gamma", "sigma", "z_q"], ["n_peaks"], 4)


QS = (0.1, 0.01, 0.001)
SWEEP = f"{TAIL}, z AS (SELECT u.q, t + sigma / gamma * (power(u.q * n / np, -gamma) - 1) AS z FROM g, (SELECT unnest({list(QS)}::DOUBLE[]) AS q) u)"


@query("det_10_tail_threshold_sweep", f"WITH {SWEEP} SELECT q AS name, {r('z')} AS threshold, CAST(count(*) FILTER (WHERE x > z) AS BIGINT) AS n_above FROM ev, z GROUP BY q, z")
def tail_sweep(spark, sf):
    df = events(spark, sf)
    fits = [D.tail_fit_moments(df, "x", q).select(F.lit(q).alias("name"), F.col("z_q").alias("threshold")) for q in QS]
    out = J.sweep_table(df, "x", fits[0].unionByName(fits[1]).unionByName(fits[2]))
    return out.select("name", r(F.col("threshold")).alias("threshold"), "n_above")


HALF = f"{EV}, h AS (SELECT *, avg(x) OVER w30 AS m, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 0 END AS late FROM ev WINDOW {over(30)})"


def ks_sql(c, source="h", side="late"):
    return (f"SELECT '{c}' AS feature, max(abs(f1 - f2)) AS ks, any_value(u) AS u FROM (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS f1, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS f2, "
            f"sum(a * (sum_ab - (a + b) + (a + b + 1) / 2.0)) OVER () - sum(a) OVER () * (sum(a) OVER () + 1) / 2 AS u FROM (SELECT v, a, b, sum(a + b) OVER (ORDER BY v) AS sum_ab FROM "
            f"(SELECT CAST({c} AS DOUBLE) AS v, CAST(count(*) FILTER (WHERE {side} = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE {side} = 1) AS DOUBLE) AS b FROM {source} GROUP BY 1)))")


def shifts_sql(c):
    m = f"(SELECT abs(avg({c}) FILTER (WHERE late = 0) - avg({c}) FILTER (WHERE late = 1)) / (abs(avg({c}) FILTER (WHERE late = 0)) + 1e-10) FROM h)"
    return m, m.replace("avg(", "stddev_samp(")


def drift_sql(c):
    m, d = shifts_sql(c)
    return f"SELECT feature, {r('ks')} AS ks, {r(m)} AS mean_shift, {r(d)} AS std_shift, CAST(CASE WHEN ks > 0.1 OR {m} > 0.2 THEN 1 ELSE 0 END AS BIGINT) AS significant FROM ({ks_sql(c)})"


@query("det_12_drift_report", f"WITH {HALF} {drift_sql('x')} UNION ALL {drift_sql('m')} UNION ALL {drift_sql('k')}")
def drift(spark, sf):
    df = with_features(events(spark, sf), BY_TYPE, {"m": R.rolling_mean("x", 30, 1)})
    out = D.drift_report(df, ["x", "m", "k"], F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'"))
    return rounded(out, ["feature"], ["ks", "mean_shift", "std_shift"], ["significant"])


@query("det_13_two_sample_tests", f"WITH {EV} SELECT feature, {r('ks')} AS ks, {r('u', 1)} AS u FROM ({ks_sql('x', 'ev', 'label')})")
def two_sample(spark, sf):
    out = D.two_sample(events(spark, sf), ["x"], F.col("label") == 1)
    return out.select("feature", r(F.col("ks")).alias("ks"), r(F.col("u"), 1).alias("u"))


@query("det_13_two_sample_p_values")
def p_values(spark, sf):
    return rounded(D.with_p_values(D.two_sample(events(spark, sf), ["x", "k"], F.col("label") == 1)), ["feature"], ["ks", "ks_p", "u", "u_z", "u_p"])


@query("det_14_monitoring_report", f"WITH {EV}, b AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM ev), m AS (SELECT count(*) AS n, avg(CASE WHEN x > 100 THEN 1 ELSE 0 END) AS rate, max(x / 600) AS mx, max(abs((x - mu) / sd)) AS ext FROM ev, b) "
       f"SELECT CAST(n AS BIGINT) AS n_samples, {r('rate')} AS anomaly_rate, {r('mx')} AS max_probability, CAST(CASE WHEN abs(rate - 0.1) / 0.1 > 0.5 THEN 1 ELSE 0 END + CASE WHEN mx < 0.8 THEN 1 ELSE 0 END + CASE WHEN ext > 5 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings, "
       "CASE WHEN abs(rate - 0.1) / 0.1 > 0.5 OR mx < 0.8 OR ext > 5 THEN 'WARNING' ELSE 'PASS' END AS performance_check FROM m")
def monitoring(spark, sf):
    df = D.z_outliers(events(spark, sf), "x").withColumns({"p": F.col("x") / 600, "f": (F.col("x") > 100).cast("int")})
    out = D.monitoring_report(df, ["z"], "p", "f", 0.1)
    return out.select("n_samples", r(F.col("anomaly_rate")).alias("anomaly_rate"), r(F.col("max_probability")).alias("max_probability"), F.size("warnings").cast("long").alias("n_warnings"), "performance_check")


def half_scores(cond):
    return f"(SELECT count(*) FILTER (WHERE x > 100 AND label = 1) * 1.0 AS tp, count(*) FILTER (WHERE x > 100 AND label = 0) AS fp, count(*) FILTER (WHERE x <= 100 AND label = 1) AS fn FROM ev WHERE {cond})"


DEG = f"{EV}, a AS {half_scores('event_id % 2 = 0')}, b AS {half_scores('event_id % 2 = 1')}"
_METRICS = {"precision": "{t}.tp / ({t}.tp + {t}.fp)", "recall": "{t}.tp / ({t}.tp + {t}.fn)", "f1": "2 * {t}.tp / (2 * {t}.tp + {t}.fp + {t}.fn)"}


def deg_sql(name, e):
    first, second = e.format(t="a"), e.format(t="b")
    return f"SELECT '{name}' AS metric, {r(first)} AS first, {r(second)} AS second, {r(f'({first} - {second}) / ({first}) * 100')} AS degradation_pct FROM a, b"


@query("det_15_metric_degradation", f"WITH {DEG} " + " UNION ALL ".join(deg_sql(n, e) for n, e in _METRICS.items()))
def degradation(spark, sf):
    df = events(spark, sf).withColumn("p", (F.col("x") > 100).cast("int"))
    tables = [E.metric_table(E.scores(E.confusion(df.filter(F.col("event_id") % 2 == side), "label", "p")), list(_METRICS)) for side in (0, 1)]
    return rounded(D.degradation(*tables), ["metric"], ["first", "second", "degradation_pct"])
