"""Small frames and comparisons for the tests."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark import SeriesSpec

START = dt.datetime(2024, 1, 1)
SPEC = SeriesSpec(("s",), "ts", ("id",), "x", "label", mode="whole")


def frame(spark, values, labels=None, name="a", first_id=0):
    """One series with a second between rows."""
    labels = labels if labels is not None else [0] * len(values)
    rows = [(name, START + dt.timedelta(seconds=i), first_id + i, None if v is None else float(v), int(y)) for i, (v, y) in enumerate(zip(values, labels))]
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, id bigint, x double, label int")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def close(got, want, tol=1e-6):
    assert len(got) == len(want), (len(got), len(want))
    for i, (g, w) in enumerate(zip(got, want)):
        assert (g is None) == (w is None), (i, g, w)
        assert w is None or abs(g - w) <= tol * max(1.0, abs(w)), (i, g, w)


def events(spark, sf="0.001"):
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"/root/testdata/sf{sf}/events.parquet").select(
        F.col("event_type").alias("s"), "ts", F.col("event_id").alias("id"), F.col("value").alias("x"), F.when(k >= 90, 1).otherwise(0).alias("label"))


def as_list(x):
    return [None if v is None or np.isnan(v) else float(v) for v in x]
