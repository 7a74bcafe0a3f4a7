"""Long/wide tables and time position columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.features import Feature, with_features
from ..plans.series import Cut, SeriesSpec, micros
from ..plans.stats import one_row


def to_long(df: DataFrame, key: str, channels: Sequence[str], key_name: str = "date") -> DataFrame:
    """One ``(key, cols, data)`` row per channel."""
    cells = [F.struct(F.lit(c).alias("cols"), F.col(c).cast("double").alias("data")) for c in channels]
    return df.select(F.col(key).alias(key_name), F.explode(F.array(*cells)).alias("c")).select(key_name, "c.cols", "c.data")


def to_wide(df: DataFrame, key: str, names: str, values: str, channels: Sequence[str]) -> DataFrame:
    """One column per listed channel; naming the channels keeps it a single aggregation."""
    return df.groupBy(key).pivot(names, list(channels)).agg(F.first(values))


def time_position(df: DataFrame, spec: SeriesSpec, cut: Cut | None = None) -> DataFrame:
    """Seconds since the first row, position 0..1 in the whole span, and seconds since the previous row of the series."""
    rows = df.withColumn("_t", micros(df, spec.ts))
    rows = with_features(rows, spec, {"inter_arrival": Feature(lambda s: (F.col("_t") - F.lag("_t", 1).over(s.ordered())) / 1e6, ("_t",), back=1)}, cut=cut)
    rows = one_row(rows, rows.agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1")))
    since = (F.col("_t") - F.col("_t0")) / 1e6
    return rows.withColumn("since_start", since).withColumn("position", F.try_divide(since, (F.col("_t1") - F.col("_t0")) / 1e6)).drop("_t", "_t0", "_t1")
