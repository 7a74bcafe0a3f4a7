"""PP rows."""

from pyspark.sql import functions as F

from tidemark.operators import profile as G
from tidemark.operators import runs as P

from .base import ALL, BY_TYPE, EV, ORD, ORD_ALL, events, over, query, r, rounded

o = f"({ORD})"


def flags(limit):
    return f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i, count(*) OVER (PARTITION BY s) - 1 AS last, CASE WHEN x > {limit} THEN 1 ELSE 0 END AS f FROM ev)"


def flagged(spark, sf, limit):
    return events(spark, sf).withColumn("f", (F.col("x") > limit).cast("int"))


def islands(limit):
    return f"{flags(limit)}, g AS (SELECT *, i - row_number() OVER (PARTITION BY s ORDER BY i) AS isl FROM n WHERE f = 1)"


RUN_COLS = (f"CAST(min(i) AS BIGINT) AS start_idx, CAST(max(i) AS BIGINT) AS end_idx, CAST(count(*) AS BIGINT) AS n, min(x) AS min_value, max(x) AS max_value, {r('avg(x)')} AS mean_value")
RUNS = f"{islands(40)}, runs AS (SELECT s, {RUN_COLS}, max(last) AS last FROM g GROUP BY s, isl)"


@query("pp_01_08_run_intervals", f"WITH {RUNS} SELECT s, start_idx, end_idx, n, min_value, max_value, mean_value FROM runs")
def intervals(spark, sf):
    return rounded(P.run_intervals(flagged(spark, sf, 40), BY_TYPE, "f"), ["s", "min_value", "max_value"], ["mean_value"], ["start_idx", "end_idx", "n"])


@query("pp_01_closed_runs_only", f"WITH {RUNS} SELECT s, start_idx, end_idx FROM runs WHERE end_idx < last")
def closed(spark, sf):
    return P.run_intervals(flagged(spark, sf, 40), BY_TYPE, "f", keep_open_run=False).select("s", "start_idx", "end_idx")


@query("pp_01_run_intervals_one_series", f"WITH {EV}, n AS (SELECT *, row_number() OVER ({ORD_ALL}) - 1 AS i, CASE WHEN x > 40 THEN 1 ELSE 0 END AS f FROM ev), "
       "g AS (SELECT *, i - row_number() OVER (ORDER BY i) AS isl FROM n WHERE f = 1) SELECT CAST(min(i) AS BIGINT) AS start_idx, CAST(max(i) AS BIGINT) AS end_idx, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY isl")
def intervals_one(spark, sf):
    return P.run_intervals(flagged(spark, sf, 40), ALL, "f").select("start_idx", "end_idx", "n")


NEAR = (f"max(CASE WHEN f = 1 THEN i END) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS b, min(CASE WHEN f = 1 THEN i END) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a")


def gap_sql(limit, gap):
    return f"{flags(limit)}, m AS (SELECT *, {NEAR} FROM n), q AS (SELECT *, CASE WHEN f = 1 OR a - b - 1 <= {gap} THEN 1 ELSE 0 END AS filled FROM m)"


@query("pp_02_gap_fill", f"WITH {gap_sql(100, 10)} SELECT event_id, CAST(f AS BIGINT) AS f, CAST(filled AS BIGINT) AS filled FROM q")
def gap_fill(spark, sf):
    return rounded(P.fill_gaps(flagged(spark, sf, 100), BY_TYPE, "f", 10), ["event_id"], [], ["f", "filled"])


@query("pp_02_gap_fill_300", f"WITH {gap_sql(250, 300)} SELECT event_id, CAST(filled AS BIGINT) AS filled FROM q")
def gap_fill_300(spark, sf):
    return rounded(P.fill_gaps(flagged(spark, sf, 250), BY_TYPE, "f", 300), ["event_id"], [], ["filled"])


@query("pp_02_gap_fill_wide", f"WITH {gap_sql(200, 120)} SELECT event_id, CAST(filled AS BIGINT) AS filled FROM q")
def gap_fill_wide(spark, sf):
    return rounded(P.fill_gaps(flagged(spark, sf, 200), BY_TYPE, "f", 120), ["event_id"], [], ["filled"])


@query("pp_03_drop_short_runs", f"WITH {islands(20)}, l AS (SELECT event_id AS e, count(*) OVER (PARTITION BY s, isl) AS len FROM g) SELECT event_id, CAST(CASE WHEN len >= 8 THEN 1 ELSE 0 END AS BIGINT) AS kept FROM ev LEFT JOIN l ON e = event_id")
def drop_short(spark, sf):
    return rounded(P.drop_short_runs(flagged(spark, sf, 20), BY_TYPE, "f", 8), ["event_id"], [], ["kept"])


@query("pp_04_majority_vote", f"WITH {flags(40)} SELECT event_id, CAST(CASE WHEN avg(f) OVER c > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS voted FROM n WINDOW c AS ({ORD} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def vote(spark, sf):
    return rounded(P.majority_vote(flagged(spark, sf, 40), BY_TYPE, "f", 15), ["event_id"], [], ["voted"])


@query("pp_05_run_statistics", f"WITH {RUNS} SELECT s, CAST(count(*) AS BIGINT) AS n_runs, CAST(sum(n) AS BIGINT) AS n_rows, {r('avg(n)')} AS mean_n, CAST(max(n) AS BIGINT) AS max_n, CAST(min(n) AS BIGINT) AS min_n, "
       f"{r('avg(max_value - min_value)')} AS mean_range, {r('corr(n, max_value - min_value)')} AS range_length_corr FROM runs GROUP BY s")
def run_statistics(spark, sf):
    out = P.run_summary(P.run_intervals(flagged(spark, sf, 40), BY_TYPE, "f"), BY_TYPE)
    return rounded(out, ["s"], ["mean_n", "mean_range", "range_length_corr"], ["n_runs", "n_rows", "max_n", "min_n"])


COLL = (f"{EV}, n AS (SELECT *, row_number() OVER ({ORD}) - 1 AS i, count(*) OVER (PARTITION BY s) - 1 AS last, CASE WHEN count(x) OVER w30 >= 30 AND abs((x - avg(x) OVER w30) / nullif(stddev_samp(x) OVER w30, 0)) > 0.3 THEN 1 ELSE 0 END AS f "
        f"FROM ev WINDOW {over(30)}), g AS (SELECT *, i - row_number() OVER (PARTITION BY s ORDER BY i) AS isl FROM n WHERE f = 1), runs AS (SELECT s, {RUN_COLS}, max(last) AS last FROM g GROUP BY s, isl)")


@query("pp_06_collective_runs", f"WITH {COLL} SELECT s, start_idx, end_idx, n FROM runs WHERE n > 10 AND end_idx < last")
def collective(spark, sf):
    return P.collective_runs(events(spark, sf), BY_TYPE, w=30, z=0.3, longer_than=10).select("s", "start_idx", "end_idx", "n")


TRANS = f"{EV}, t AS (SELECT *, label - lag(label) OVER {o} AS change, x - lag(x) OVER {o} AS value_change FROM ev)"


@query("pp_07_transitions", f"WITH {TRANS} SELECT event_id, CAST(change AS BIGINT) AS change, {r('value_change')} AS value_change FROM t WHERE change IN (1, -1)")
def transitions(spark, sf):
    return rounded(P.transitions(events(spark, sf), BY_TYPE, "label"), ["event_id"], ["value_change"], ["change"])


@query("pp_09_prediction_summary", f"WITH {EV}, p AS (SELECT s, x / 600 AS p, CASE WHEN x > 100 THEN 1 ELSE 0 END AS f FROM ev) SELECT s, CAST(count(*) AS BIGINT) AS total, CAST(sum(f) AS BIGINT) AS anomalies, {r('avg(f) * 100')} AS rate_pct, "
       f"CAST(count(*) FILTER (WHERE p > 0.8) AS BIGINT) AS high_confidence, CAST(count(*) FILTER (WHERE p BETWEEN 0.4 AND 0.6) AS BIGINT) AS low_confidence, {r('avg(abs(p - 0.5) * 2)')} AS mean_confidence, {r('max(p)')} AS max_score FROM p GROUP BY s")
def summary(spark, sf):
    df = flagged(spark, sf, 100).withColumn("p", F.col("x") / 600)
    return rounded(P.prediction_summary(df, "p", "f", ["s"]), ["s"], ["rate_pct", "mean_confidence", "max_score"], ["total", "anomalies", "high_confidence", "low_confidence"])


@query("pp_10_transition_histogram", f"WITH {TRANS}, c AS (SELECT * FROM t WHERE change = 1), b AS (SELECT min(value_change) AS lo, max(value_change) AS hi FROM c) SELECT least(19, CAST(floor((value_change - lo) / (hi - lo) * 20) AS BIGINT)) AS bin, "
       "CAST(count(*) AS BIGINT) AS n FROM c, b GROUP BY 1")
def transition_histogram(spark, sf):
    rows = P.transitions(events(spark, sf), BY_TYPE, "label").filter("change = 1")
    return rounded(G.histogram(rows, "value_change", 20), [], [], ["bin", "n"])
