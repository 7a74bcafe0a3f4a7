"""SRC, CLN and FLT rows."""

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import clean as C
from tidemark.operators import runs as P
from tidemark.functions import rolling as R
from tidemark.plans.features import scalar, with_features
from tidemark.plans.lineage import checkpoint_folder
from tidemark.plans.series import SeriesSpec, index_rows
from tidemark.plans.stats import one_row, quantiles
from tidemark.sources import tables as T

from .base import ALL, BY_TYPE, BY_USER, EV, ORD, ORD_ALL, ORD_USER, events, over, query, r, rounded, table

o = f"({ORD})"


@query("flagship_alarm_intervals", f"""WITH {EV}, z AS (SELECT *, CASE WHEN abs((x - avg(x) OVER w60) / nullif(stddev_samp(x) OVER w60, 0)) > 3 THEN 1 ELSE 0 END AS alarm,
  row_number() OVER {o} - 1 AS i FROM ev WINDOW {over(60)}),
 n AS (SELECT *, max(CASE WHEN alarm = 1 THEN i END) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS b,
  min(CASE WHEN alarm = 1 THEN i END) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM z),
 f AS (SELECT *, CASE WHEN alarm = 1 OR a - b - 1 <= 10 THEN 1 ELSE 0 END AS filled FROM n),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY s ORDER BY i) AS isl FROM f WHERE filled = 1)
 SELECT s, CAST(min(i) AS BIGINT) AS start_idx, CAST(max(i) AS BIGINT) AS end_idx, CAST(count(*) AS BIGINT) AS n, min(x) AS min_value, max(x) AS max_value,
  {r('avg(x)')} AS mean_value, {r('CASE WHEN count(*) > 1 THEN stddev_samp(x) END')} AS std_value FROM g GROUP BY s, isl""")
def flagship(spark, sf):
    f = {"_z": R.rolling_z("x", 60, 1), "alarm": scalar(F.when(F.abs("_z") > 3, 1).otherwise(0), "_z"), **P.filled("alarm", 10, "filled")}
    alarms = with_features(events(spark, sf).select("s", "ts", "event_id", "x"), BY_TYPE, f)
    out = P.run_intervals(alarms, BY_TYPE, "filled")
    return rounded(out, ["s", "min_value", "max_value"], ["mean_value", "std_value"], ["start_idx", "end_idx", "n"])


@query("src_03_pruned_scan", "SELECT event_id, value FROM events WHERE value > 100")
def pruned(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").filter("value > 100")


@query("src_04_alternate_names", f"SELECT event_id, {r('value')} AS speed FROM events")
def alternates(spark, sf):
    df = table(spark, sf, "events").withColumnRenamed("value", T.PRODUCTION_VALUE)
    return T.first_present(df, [T.PRODUCTION_VALUE, "speed"], "speed").select("event_id", r(F.col("speed")).alias("speed"))


@query("src_05_set_01_union", "SELECT event_id AS id, value AS v FROM events UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def union(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return T.union_tables([a, b])


@query("src_06_09_sorted_index", f"WITH {EV} SELECT s, event_id, CAST(row_number() OVER {o} - 1 AS BIGINT) AS idx FROM ev ORDER BY s, idx")
def sorted_index(spark, sf):
    return index_rows(events(spark, sf), BY_TYPE).select("s", "event_id", "idx").orderBy("s", "idx")


@query("src_09_index_one_series", f"WITH {EV} SELECT event_id, CAST(row_number() OVER ({ORD_ALL}) - 1 AS BIGINT) AS idx FROM ev")
def one_series_index(spark, sf):
    return index_rows(events(spark, sf), ALL).select("event_id", "idx")


@query("src_07_position_slice", f"WITH {EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i FROM ev) SELECT event_id, CAST(i AS BIGINT) AS idx FROM n WHERE i >= 100 AND i < 250")
def slice_rows(spark, sf):
    return T.position_slice(events(spark, sf), BY_TYPE, 100, 250).select("event_id", "idx")


@query("src_08_synthetic_clock", f"WITH {EV} SELECT event_id, CAST(epoch(TIMESTAMP '2025-05-13 10:15:18' + (row_number() OVER {o} - 1) * INTERVAL 1 SECOND) AS BIGINT) AS clock FROM ev")
def clock(spark, sf):
    df = T.synthetic_clock(events(spark, sf), BY_TYPE, "2025-05-13 10:15:18")
    return df.select("event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', time_value)").alias("clock"))


@query("src_13_align_features", "SELECT event_id, value AS b, CAST(0 AS DOUBLE) AS missing, value * 2 AS a FROM events")
def align(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") * 2).alias("a"), F.col("value").alias("b"), F.lit(1).alias("unused"))
    return T.align_features(df, ["b", "missing", "a"], keep=["event_id"])


@query("cln_01_exact_duplicates", "SELECT DISTINCT event_type, user_id, k FROM (SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events "
       "UNION ALL SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) FROM events)")
def dedupe(spark, sf):
    df = events(spark, sf).select(F.col("s").alias("event_type"), "user_id", "k")
    return df.unionByName(df).dropDuplicates()


@query("cln_02_average_duplicate_times", "SELECT CAST(epoch(o_orderdate) AS BIGINT) AS day, o_orderstatus, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents "
       "FROM orders GROUP BY 1, 2")
def average_duplicates(spark, sf):
    df = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    df = C.average_duplicates(df, SeriesSpec(("o_orderstatus",), "o_orderdate"), ["cents"])
    return df.select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("day"), "o_orderstatus", "cents")


HOLES = f"{EV}, h AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE x END AS v FROM ev)"


def holes(spark, sf):
    return events(spark, sf).withColumn("v", F.when(F.col("k") % 5 != 0, F.col("x")))


@query("cln_03_drop_missing", f"WITH {HOLES} SELECT event_id, v FROM h WHERE v IS NOT NULL")
def drop_missing(spark, sf):
    return holes(spark, sf).na.drop(subset=["v"]).select("event_id", "v")


@query("cln_04_constant_fill", f"WITH {HOLES} SELECT event_id, coalesce(v, 0) AS v FROM h")
def constant_fill(spark, sf):
    return C.fill_constant(holes(spark, sf), ["v"]).select("event_id", "v")


@query("cln_05_mean_fill", f"WITH {HOLES} SELECT event_id, {r('coalesce(v, (SELECT avg(v) FROM h WHERE label = 0))')} AS v FROM h")
def mean_fill(spark, sf):
    return rounded(C.fill_mean(holes(spark, sf), ["v"], train=F.col("label") == 0), ["event_id"], ["v"])


@query("cln_06_forward_backward_fill", f"WITH {HOLES} SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING), "
       f"first_value(v IGNORE NULLS) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM h")
def fill_along(spark, sf):
    return C.fill_along(holes(spark, sf), BY_TYPE, ["v"]).select("event_id", "v")


@query("cln_06_forward_fill_one_series", f"WITH {HOLES} SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER ({ORD_ALL} ROWS UNBOUNDED PRECEDING), 0) AS v FROM h")
def fill_one(spark, sf):
    return C.fill_along(holes(spark, sf), ALL, ["v"], backward=False, rest=0.0).select("event_id", "v")


@query("cln_07_infinity_to_null", "SELECT event_id, CASE WHEN value > 300 THEN NULL ELSE value END AS v FROM events")
def infinities(spark, sf):
    df = table(spark, sf, "events").withColumn("v", F.when(F.col("value") > 300, F.lit(float("inf"))).otherwise(F.col("value")))
    return C.null_infinities(df, ["v"]).select("event_id", "v")


@query("cln_08_median_imputation", f"WITH {HOLES} SELECT event_id, {r('coalesce(v, (SELECT quantile_cont(v, 0.5) FROM h WHERE label = 0))')} AS v FROM h")
def median_fill(spark, sf):
    return rounded(C.fill_median(holes(spark, sf), ["v"], train=F.col("label") == 0), ["event_id"], ["v"])


@query("cln_09_winsorise", f"WITH {EV}, b AS (SELECT quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM ev WHERE label = 0) "
       f"SELECT event_id, {r('least(greatest(x, lo), hi)')} AS v FROM ev, b")
def winsorise(spark, sf):
    df = C.winsorise(events(spark, sf).withColumn("v", F.col("x")), ["v"], train=F.col("label") == 0)
    return rounded(df, ["event_id"], ["v"])


@query("cln_10_clip", f"WITH {HOLES} SELECT event_id, CASE WHEN v IS NOT NULL THEN least(greatest(v, 10.0), 100.0) END AS v FROM h")
def clip(spark, sf):
    return C.clip_columns(holes(spark, sf), ["v"], 10, 100).select("event_id", "v")


@query("cln_11_warm_up_trim", f"WITH {EV}, n AS (SELECT event_id, row_number() OVER ({ORD_USER}) - 1 AS i FROM ev) SELECT event_id, CAST(i AS BIGINT) AS idx FROM n WHERE i >= 30")
def trim(spark, sf):
    return C.trim_warm_up(index_rows(events(spark, sf), BY_USER), 30).select("event_id", "idx")


@query("flt_01_label_split", f"WITH {EV} SELECT s, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS flagged, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS normal, "
       f"max(x) FILTER (WHERE label = 1) AS top FROM ev GROUP BY s")
def label_split(spark, sf):
    hit = F.col("label") == 1
    return events(spark, sf).groupBy("s").agg(F.count_if(hit).alias("flagged"), F.count_if(~hit).alias("normal"), F.max(F.when(hit, F.col("x"))).alias("top"))


@query("flt_02_03_threshold_and_band", "SELECT event_id, CAST(CASE WHEN value > 100 THEN 1 ELSE 0 END AS BIGINT) AS above, CAST(CASE WHEN value >= 100 THEN 1 ELSE 0 END AS BIGINT) AS at_least, "
       "CAST(CASE WHEN value < 5 OR value > 150 THEN 1 ELSE 0 END AS BIGINT) AS outside FROM events")
def thresholds(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", X.above(v, 100).cast("long").alias("above"), X.above(v, 100, strict=False).cast("long").alias("at_least"),
                                             X.outside(v, 5, 150).cast("long").alias("outside"))


@query("flt_04_time_range", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 12:00:00'")
def time_range(spark, sf):
    lo, hi = F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-07 12:00:00'")
    return table(spark, sf, "events").filter(F.col("ts").between(lo, hi)).select("event_id", "value")


@query("flt_05_membership", "SELECT event_id, user_id FROM events WHERE weekday(ts) IN (0, 6) AND user_id IN (SELECT user_id FROM events WHERE value > 250)")
def membership(spark, sf):
    df = table(spark, sf, "events")
    big = df.filter("value > 250").select("user_id").distinct()
    return df.filter(F.weekday("ts").isin(5, 6)).join(big, "user_id", "left_semi").select("event_id", "user_id")


@query("flt_06_deny_list", "SELECT event_id, value FROM events")
def deny_list(spark, sf):
    df = table(spark, sf, "events")
    return df.select(*C.feature_columns(df, ["ts", "user_id", "event_type", "props"]))


@query("flt_07_status_text", f"WITH {EV} SELECT event_id, CASE WHEN label = 1 THEN 'Anomaly' ELSE 'Normal' END AS status FROM ev")
def status(spark, sf):
    return events(spark, sf).select("event_id", X.status(F.col("label")).alias("status"))


@query("src_01_02_10_csv_round_trip", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, value FROM events")
def csv_round_trip(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "value")
    path = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    T.write_table(df, path, "csv")
    back = T.read_csv(spark, path, df.schema, origin="file")
    return back.select("event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("second"), "value")


@query("src_11_json_summary", f"WITH {EV} SELECT s, CAST(count(*) AS BIGINT) AS n, max(x) AS top FROM ev GROUP BY s")
def json_summary(spark, sf):
    path = f"{checkpoint_folder(spark)}/json-{uuid.uuid4().hex}"
    T.write_summary(events(spark, sf).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")), path)
    return spark.read.schema("s STRING, n BIGINT, top DOUBLE").json(path)


@query("src_12_saved_parameters", f"WITH {EV}, p AS (SELECT quantile_cont(x, 0.5) AS med FROM ev) SELECT event_id, {r('x - med')} AS gap FROM ev, p")
def saved_parameters(spark, sf):
    """Fitted parameters go to a one-row table and are applied after reading them back."""
    path = f"{checkpoint_folder(spark)}/params-{uuid.uuid4().hex}"
    df = events(spark, sf)
    quantiles(df, "x", {"med": 0.5}).write.parquet(path)
    return rounded(one_row(df, spark.read.parquet(path).agg(F.max("med").alias("med"))).withColumn("gap", F.col("x") - F.col("med")), ["event_id"], ["gap"])
