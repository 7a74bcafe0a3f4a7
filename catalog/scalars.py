"""FN, STR, ARR, RSH, SRT and MAP rows."""

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import reshape as H
from tidemark.operators import windows as W
from tidemark.plans.stats import attach_group_stats

from .base import BY_TYPE, EV, ORD, events, over, query, r, rounded, table

o = f"({ORD})"


@query("fn_01_calendar", f"WITH {EV} SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, "
       "CAST(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend FROM ev")
def calendar(spark, sf):
    return rounded(events(spark, sf).withColumns(X.calendar("ts")), ["event_id"], [], ["hour", "minute", "day_of_week", "is_weekend"])


@query("fn_02_cyclic", f"WITH {EV} SELECT event_id, {r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos, "
       f"{r('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS dow_sin, {r('cos(2 * pi() * minute(ts) / 60)')} AS minute_cos FROM ev")
def cyclic(spark, sf):
    hour, dow, minute = X.cyclic(F.hour("ts"), 24), X.cyclic(F.weekday("ts"), 7), X.cyclic(F.minute("ts"), 60)
    df = events(spark, sf).withColumns({"hour_sin": hour[0], "hour_cos": hour[1], "dow_sin": dow[0], "minute_cos": minute[1]})
    return rounded(df, ["event_id"], ["hour_sin", "hour_cos", "dow_sin", "minute_cos"])


@query("fn_03_time_position", f"WITH {EV}, b AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM ev) SELECT event_id, {r('epoch(ts - t0)')} AS since_start, "
       f"{r('epoch(ts - t0) / epoch(t1 - t0)')} AS position, {r(f'epoch(ts - lag(ts) OVER {o})')} AS inter_arrival FROM ev, b")
def time_position(spark, sf):
    return rounded(H.time_position(events(spark, sf), BY_TYPE), ["event_id"], ["since_start", "position", "inter_arrival"])


@query("fn_04_math", "SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in {
    "a": "abs(value - 50)", "b": "sqrt(value)", "c": "ln(value + 1)", "d": "log2(value + 1)", "e": "exp(-value / 100)", "f": "CAST(sign(value - 50) AS DOUBLE)", "g": "floor(value / 7)",
    "h": "power(value, 1.5)", "i": "acos(value / 1000)", "j": "cos(value)"}.items()) + " FROM events")
def math_functions(spark, sf):
    v = F.col("value")
    cols = {"a": F.abs(v - 50), "b": F.sqrt(v), "c": F.log1p(v), "d": F.log2(v + 1), "e": F.exp(-v / 100), "f": F.signum(v - 50), "g": F.floor(v / 7), "h": F.pow(v, F.lit(1.5)),
            "i": F.acos(v / 1000), "j": F.cos(v)}
    return rounded(table(spark, sf, "events").withColumns(cols), ["event_id"], list(cols))


ZS = f"{EV}, b AS (SELECT s AS g, avg(x) AS mu, stddev_pop(x) AS sd FROM ev GROUP BY s), z AS (SELECT event_id, (x - mu) / sd AS z FROM ev JOIN b ON s = g)"


@query("fn_05_extreme_flags", f"WITH {ZS} SELECT event_id, CAST(CASE WHEN z > 2 THEN 1 ELSE 0 END AS BIGINT) AS high, CAST(CASE WHEN z < -2 THEN 1 ELSE 0 END AS BIGINT) AS low FROM z")
def extreme_flags(spark, sf):
    df = attach_group_stats(events(spark, sf), ["s"], [F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")])
    high, low = X.extreme_flags((F.col("x") - F.col("mu")) / F.col("sd"))
    return df.select("event_id", high.cast("long").alias("high"), low.cast("long").alias("low"))


@query("fn_06_confidence", f"WITH {EV} SELECT event_id, {r('abs(k / 100.0 - 0.5) * 2')} AS confidence FROM ev")
def confidence(spark, sf):
    return events(spark, sf).select("event_id", r(X.confidence(F.col("k") / 100)).alias("confidence"))


ANSWER = ("CASE WHEN value > 100 THEN 'ANOMALY_DETECTED: true; START_POINT: ' || CASE WHEN event_id % 3 = 0 THEN 'near the start' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END "
          "|| '; END_POINT: unknown; REASON: high value for ' || event_type ELSE 'ANOMALY_DETECTED: false; REASON: none' END")


@query("str_01_parse_answers", f"WITH a AS (SELECT event_id, ts, {ANSWER} AS t, value FROM events) SELECT event_id, CAST(contains(t, 'ANOMALY_DETECTED: true') AS BIGINT) AS is_anomaly, "
       "CASE WHEN value > 100 THEN CAST(epoch(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 HOUR ELSE date_trunc('second', ts) END) AS BIGINT) END AS anomaly_start, "
       "CASE WHEN value > 100 THEN CAST(epoch(ts + INTERVAL 1 HOUR) AS BIGINT) END AS anomaly_end, CASE WHEN value > 100 THEN trim(regexp_extract(t, 'REASON:([^;]+)', 1)) END AS reason FROM a".replace(
           "CAST(epoch(CASE", "CAST(floor(epoch(CASE").replace("date_trunc('second', ts) END) AS", "date_trunc('second', ts) END)) AS").replace("CAST(epoch(ts + INTERVAL 1 HOUR) AS", "CAST(floor(epoch(ts + INTERVAL 1 HOUR)) AS"))
def parse_answers(spark, sf):
    df = table(spark, sf, "events").withColumns({"w0": F.expr("ts - INTERVAL 1 HOUR"), "w1": F.expr("ts + INTERVAL 1 HOUR")})
    start = F.when(F.col("event_id") % 3 == 0, "near the start").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = F.when(F.col("value") > 100, F.format_string("ANOMALY_DETECTED: true; START_POINT: %s; END_POINT: unknown; REASON: high value for %s", start, F.col("event_type"))) \
            .otherwise("ANOMALY_DETECTED: false; REASON: none")
    df = X.parse_answer(df.withColumn("answer", text), "answer", "w0", "w1")
    sec = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    return df.select("event_id", F.col("is_anomaly").cast("long"), sec("anomaly_start").alias("anomaly_start"), sec("anomaly_end").alias("anomaly_end"), "reason")


@query("str_02_format_summary", f"WITH {EV}, a AS (SELECT s, count(*) AS n, round(avg(label) * 100, 2) AS pct FROM ev GROUP BY s) "
       "SELECT s, s || ': ' || n || ' rows, ' || printf('%.2f', pct) || '% flagged' AS line, replace(s || '.csv', '.csv', '_predictions.csv') AS file FROM a")
def format_summary(spark, sf):
    a = events(spark, sf).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label") * 100, 2).alias("pct"))
    return a.select("s", F.format_string("%s: %d rows, %.2f%% flagged", "s", "n", "pct").alias("line"),
                    F.replace(F.concat("s", F.lit(".csv")), F.lit(".csv"), F.lit("_predictions.csv")).alias("file"))


SEQ = f"{EV}, q AS (SELECT event_id, list(x - 50) OVER w20 AS l FROM ev WINDOW {over(20)}), m AS (SELECT event_id, l, list_avg(l) AS mu, list_stddev_pop(l) AS sd, list_min(l) AS lo, list_max(l) AS hi FROM q WHERE len(l) = 20)"


@query("arr_01_array_functions", f"WITH {SEQ} SELECT event_id, CAST(len(list_filter(range(1, 20), lambda i: sign(l[i]) <> sign(l[i + 1]))) AS BIGINT) AS crossings, "
       "CAST(len(list_filter(l, lambda v: abs(v) > 3 * sd)) AS BIGINT) AS spikes, CAST(list_position(l, hi) - 1 AS BIGINT) AS at_max, "
       f"CAST(len(list_filter(l, lambda v: least(9, floor((v - lo) / (hi - lo) * 10)) = 0)) AS BIGINT) AS lowest_bin, {r('l[1] + l[20]')} AS ends, CAST(20 + 5 AS BIGINT) AS padded, {r('mu')} AS mean, {r('sd')} AS sd FROM m")
def array_functions(spark, sf):
    df = W.sequences(events(spark, sf).withColumn("c", F.col("x") - 50), BY_TYPE, 20, ["c"])
    a = F.col("c_seq")
    return df.select("event_id", X.zero_crossings(a).cast("long").alias("crossings"), X.spikes(a).cast("long").alias("spikes"), X.argmax(a).cast("long").alias("at_max"),
                     X.array_histogram(a, 10)[0].cast("long").alias("lowest_bin"), r(F.slice(a, 1, 1)[0] + F.slice(a, 20, 1)[0]).alias("ends"),
                     F.size(X.pad_left_edge(a, 5)).cast("long").alias("padded"), r(X.array_mean(a)).alias("mean"), r(X.array_std(a)).alias("sd"))


@query("rsh_01_wide_to_long", f"WITH {EV} SELECT event_id AS date, 'x' AS cols, x AS data FROM ev UNION ALL SELECT event_id, 'label', CAST(label AS DOUBLE) FROM ev")
def wide_to_long(spark, sf):
    return H.to_long(events(spark, sf), "event_id", ["x", "label"], "date")


@query("rsh_01_long_to_wide", f"WITH {EV} SELECT event_id AS date, x, CAST(k AS DOUBLE) AS k, CAST(label AS DOUBLE) AS label FROM ev")
def long_to_wide(spark, sf):
    long = H.to_long(events(spark, sf), "event_id", ["x", "k", "label"], "date")
    return H.to_wide(long, "date", "cols", "data", ["x", "k", "label"])


@query("srt_01_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_k(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("map_01_json_report", f"WITH {EV} SELECT s, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS flagged FROM ev GROUP BY s")
def json_report(spark, sf):
    report = events(spark, sf).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("flagged"))
    text = report.select("s", F.to_json(F.struct("n", "flagged")).alias("report"))
    return text.select("s", F.from_json("report", "n BIGINT, flagged BIGINT").alias("r")).select("s", "r.n", "r.flagged")
