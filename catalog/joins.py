"""JN rows."""

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.operators import runs as P2
from tidemark.operators import windows as W
from tidemark.plans.series import index_rows

from .base import ALL, BY_TYPE, EV, ORD, events, over, query, r, rounded
from .profiling import SPEED, bin_sql, speeds

o = f"({ORD})"
BINNED = f"{SPEED}, b AS (SELECT *, {{bins}} AS bin FROM sp), st AS (SELECT bin AS g, avg(speed) AS mu, stddev_samp(speed) AS sd FROM b WHERE bin IS NOT NULL GROUP BY bin)"


@query("jn_01_sig_17_bin_normalise", f"WITH {BINNED.format(bins=bin_sql(X.REGIME_EDGES))} SELECT event_id, CAST(bin AS BIGINT) AS bin, {r('mu', 4)} AS bin_mean, "
       f"{r('(speed - mu) / nullif(sd, 0)')} AS normalised FROM b LEFT JOIN st ON bin = g")
def normalise(spark, sf):
    df = P.normalise_by_bin(speeds(spark, sf), "speed", X.REGIME_EDGES)
    return df.select("event_id", F.col("bin").cast("long"), r(F.col("bin_mean"), 4).alias("bin_mean"), r(F.col("normalised")).alias("normalised"))


@query("sig_17_bin_normalise_filled", f"WITH {BINNED.format(bins=bin_sql(X.REGIME_EDGES_EVEN, True))} SELECT event_id, {r('coalesce((speed - mu) / nullif(sd, 0), 0)')} AS normalised FROM b LEFT JOIN st ON bin = g")
def normalise_filled(spark, sf):
    return rounded(P.normalise_by_bin(speeds(spark, sf), "speed", X.REGIME_EDGES_EVEN, True, fill=0.0), ["event_id"], ["normalised"])


@query("jn_02_bin_lookup", f"WITH {SPEED} SELECT event_id, CAST({bin_sql(X.REGIME_EDGES)} AS BIGINT) AS open_low, CAST({bin_sql(X.REGIME_EDGES, True)} AS BIGINT) AS closed_low FROM sp")
def bins(spark, sf):
    return speeds(spark, sf).select("event_id", X.bin_index(F.col("speed"), X.REGIME_EDGES).cast("long").alias("open_low"),
                                    X.bin_index(F.col("speed"), X.REGIME_EDGES, True).cast("long").alias("closed_low"))


RUNS = (f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i, CASE WHEN x > 100 THEN 1 ELSE 0 END AS hot FROM ev), g AS (SELECT *, i - row_number() OVER (PARTITION BY s ORDER BY i) AS isl FROM n WHERE hot = 1), "
        "runs AS (SELECT s AS rs, min(i) AS a, max(i) AS b, min(ts) AS t0, max(ts) AS t1 FROM g GROUP BY s, isl)")


def hot(spark, sf):
    return events(spark, sf).withColumn("hot", (F.col("x") > 100).cast("int"))


@query("jn_03_index_to_time", f"WITH {RUNS} SELECT rs AS s, CAST(a AS BIGINT) AS start_idx, CAST(b AS BIGINT) AS end_idx, {r('epoch(t1 - t0)')} AS seconds FROM runs")
def index_times(spark, sf):
    df = hot(spark, sf)
    runs = P2.run_intervals(df, BY_TYPE, "hot").select("s", "start_idx", "end_idx")
    out = J.index_times(runs, df, BY_TYPE)
    return out.select("s", "start_idx", "end_idx", r(F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / 1e6).alias("seconds"))


@query("jn_04_interval_context", f"WITH {RUNS} SELECT rs AS s, CAST(a AS BIGINT) AS start_idx, CAST(min(i) AS BIGINT) AS lo, CAST(max(i) AS BIGINT) AS hi, CAST(count(*) AS BIGINT) AS n, {r('avg(x)')} AS mean "
       "FROM runs JOIN n ON s = rs AND i BETWEEN a - 60 AND b + 60 GROUP BY rs, a")
def context(spark, sf):
    df = hot(spark, sf)
    out = J.interval_context(df, BY_TYPE, P2.run_intervals(df, BY_TYPE, "hot"), 60)
    out = out.groupBy("s", "start_idx").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    return rounded(out, ["s"], ["mean"], ["start_idx", "lo", "hi", "n"])


TIMEWIN = (f"{EV}, b AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM ev), w AS (SELECT t0, t1, floor(epoch(t1 - t0) * 0.05) AS size FROM b), "
           "gen AS (SELECT *, unnest(range(CAST(ceil(epoch(t1 - t0) / (size / 2)) AS BIGINT))) AS win FROM w), "
           "win AS (SELECT win, t0 + to_microseconds(CAST(win * size / 2 * 1000000 AS BIGINT)) AS a, t0 + to_microseconds(CAST((win * size / 2 + size) * 1000000 AS BIGINT)) AS z FROM gen)")


@query("jn_05_time_window_members", f"WITH {TIMEWIN} SELECT win, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(x) AS lo FROM win JOIN ev ON ts BETWEEN a AND z GROUP BY win")
def time_members(spark, sf):
    df = W.time_window_members(events(spark, sf), ALL, None, overlap=0.5)
    return df.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min("x").alias("lo"))


FLAGWIN = (f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i FROM ev), m AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i - 99) / 50.0)) AS BIGINT), CAST(i // 50 AS BIGINT) + 1)) AS win FROM n), "
           "f AS (SELECT s AS fs, win AS fw FROM m GROUP BY 1, 2 HAVING count(*) = 100 AND avg(x) > 55)")


@query("jn_06_flagged_window_points", f"WITH {FLAGWIN}, h AS (SELECT DISTINCT event_id AS e FROM m JOIN f ON s = fs AND win = fw) SELECT event_id, CAST(CASE WHEN e IS NULL THEN 0 ELSE 1 END AS BIGINT) AS flagged FROM ev LEFT JOIN h ON e = event_id")
def flagged_points(spark, sf):
    df = events(spark, sf)
    flagged = W.sliding_windows(df, BY_TYPE, 100, 50).filter("mean > 55").select("s", "win")
    return rounded(W.mark_flagged_points(df, BY_TYPE, flagged, 100, 50), ["event_id"], [], ["flagged"])


CUTS = [10.0, 50.0, 100.0, 150.0, 200.0]


@query("jn_07_threshold_sweep", f"WITH {EV}, t AS (SELECT unnest({CUTS}::DOUBLE[]) AS threshold) SELECT s, threshold, CAST(count(*) FILTER (WHERE x > threshold) AS BIGINT) AS n_above, "
       "CAST(count(*) FILTER (WHERE x > threshold AND label = 1) AS BIGINT) AS true_positives FROM ev, t GROUP BY s, threshold")
def sweep(spark, sf):
    return J.threshold_sweep(events(spark, sf), "x", CUTS, "label", ["s"])


CONTEXT = f"{EV}, h AS (SELECT hour(ts) AS h, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM ev GROUP BY 1)"


@query("jn_08_det_04_contextual_score", f"WITH {CONTEXT} SELECT event_id, {r('CASE WHEN n > 30 THEN abs(x - mu) / sd ELSE 0 END')} AS context_score FROM ev JOIN h ON hour(ts) = h")
def contextual(spark, sf):
    return rounded(J.contextual_scores(events(spark, sf), "ts", "x"), ["event_id"], ["context_score"])


@query("jn_09_label_at_centre", f"WITH {FLAGWIN}, w AS (SELECT s AS ws, win FROM m GROUP BY 1, 2 HAVING count(*) = 100) SELECT ws AS s, win, CAST(coalesce(label, 0) AS BIGINT) AS centre_label "
       "FROM w LEFT JOIN n ON s = ws AND i = win * 50 + 50")
def centre_label(spark, sf):
    df = events(spark, sf)
    wins = W.sliding_windows(df, BY_TYPE, 100, 50).select("s", "win")
    return J.label_at_centre(wins, df, BY_TYPE, 100, 50).select("s", "win", F.col("centre_label").cast("long"))


@query("jn_10_align_sequence_scores", f"WITH {EV} SELECT event_id, {r('CASE WHEN count(*) OVER w40 = 40 THEN (max(x) OVER w40 - min(x) OVER w40) / 600 ELSE 0 END')} AS score FROM ev WINDOW {over(40)}")
def align(spark, sf):
    df = events(spark, sf)
    seq = W.sequences(df, BY_TYPE, 40, ["x"]).select("event_id", ((F.array_max("x_seq") - F.array_min("x_seq")) / 600).alias("score"))
    return rounded(J.align_scores(df, seq, ["event_id"], "score"), ["event_id"], ["score"])


REC = f"{EV}, n AS (SELECT *, (row_number() OVER {o} - 1) // 500 AS seg FROM ev), d AS (SELECT s AS ds, seg AS dg, stddev_pop(x) AS sd FROM n GROUP BY 1, 2)"


@query("jn_11_recurrence", f"WITH {REC} SELECT a.event_id, CAST(count(*) AS BIGINT) AS neighbours FROM n a JOIN d ON a.s = ds AND a.seg = dg JOIN n b ON a.s = b.s AND a.seg = b.seg AND abs(a.x - b.x) < sd * 0.1 GROUP BY a.event_id")
def recurrence(spark, sf):
    return rounded(J.recurrence(events(spark, sf), BY_TYPE), ["event_id"], [], ["neighbours"])


@query("jn_12_lagged_pairs", f"WITH {EV}, p AS (SELECT event_id, x, lead(x, 10) OVER {o} AS later FROM ev) SELECT * FROM p WHERE later IS NOT NULL")
def lagged_pairs(spark, sf):
    return J.lagged_pairs(events(spark, sf), BY_TYPE, 10).select("event_id", "x", "later")


@query("jn_13_column_assembly", f"WITH {EV} SELECT event_id, CAST(row_number() OVER {o} - 1 AS BIGINT) AS idx, x AS speed, {r('x / 600')} AS anomaly_probability, "
       "CAST(CASE WHEN x / 600 > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS predicted_label, CASE WHEN x / 600 > 0.5 THEN 'Anomaly' ELSE 'Normal' END AS anomaly_status FROM ev")
def assembly(spark, sf):
    df = index_rows(events(spark, sf), BY_TYPE)
    p = F.col("x") / 600
    return df.select("event_id", "idx", F.col("x").alias("speed"), r(p).alias("anomaly_probability"), X.above(p, 0.5).cast("long").alias("predicted_label"),
                     X.status(X.above(p, 0.5)).alias("anomaly_status"))
