"""Joins the analyses need: interval context, recurrence, thresholds, label alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.features import Feature, with_features
from ..plans.series import IDX, SeriesSpec, index_rows, null_safe_join
from ..plans.stats import ordered_prefix


def interval_context(df: DataFrame, spec: SeriesSpec, intervals: DataFrame, around: int, bucket: int = 4096) -> DataFrame:
    """Rows within ``around`` positions of each interval, tagged with the interval's ``start_idx``/``end_idx``.

    Intervals are repeated once per position bucket they touch and rows carry one bucket, so the range join becomes
    an equi-join on (keys, bucket) and a long interval is spread over many tasks.
    """
    rows = df if IDX in df.columns else index_rows(df, spec)
    lo, hi = F.greatest(F.lit(0), F.col("start_idx") - around), F.col("end_idx") + around
    spread = intervals.select(*spec.keys, "start_idx", "end_idx", lo.alias("_lo"), hi.alias("_hi"),
                              F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))).alias("_bucket"))
    out = null_safe_join(rows.withColumn("_bucket", F.floor(F.col(IDX) / bucket)), spread, [*spec.keys, "_bucket"], "inner")
    return out.filter((F.col(IDX) >= F.col("_lo")) & (F.col(IDX) <= F.col("_hi"))).drop("_lo", "_hi", "_bucket")


def index_times(intervals: DataFrame, df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Looks up the timestamps of interval ends given by position."""
    at = index_rows(df.select(*spec.keys, *spec.order), spec).select(*spec.keys, IDX, spec.ts)
    first = at.withColumnsRenamed({IDX: "start_idx", spec.ts: "start_ts"})
    last = at.withColumnsRenamed({IDX: "end_idx", spec.ts: "end_ts"})
    return null_safe_join(null_safe_join(intervals, first, [*spec.keys, "start_idx"]), last, [*spec.keys, "end_idx"])


def threshold_sweep(df: DataFrame, score: str, thresholds: Sequence[float], label: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Number of scores above each threshold (and confusion counts), all thresholds in one pass over the data."""
    s = F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = s > F.lit(float(t))
        aggs.append(F.count_if(hit).alias(f"n{i}"))
        if label:
            aggs.append(F.count_if(hit & (F.col(label) == 1)).alias(f"t{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n_above"), *([F.col(f"t{i}").alias("true_positives")] if label else []))
             for i, t in enumerate(thresholds)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("r")).select(*keys, "r.*")


def sweep_table(df: DataFrame, score: str, thresholds: DataFrame) -> DataFrame:
    """Number of scores above each of a table of named thresholds, however many: one running total over distinct scores and thresholds."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("n"))
    marks = thresholds.filter("threshold is not null").select(F.col("threshold").cast("double").alias("threshold"), F.lit(0).cast("long").alias("n"))
    per = counts.unionByName(marks).groupBy("threshold").agg(F.sum("n").alias("n"))
    above = ordered_prefix(per, "threshold", ["n"], descending=True).select("threshold", (F.col("n_upto") - F.col("n")).alias("n_above"))
    return thresholds.select("name", F.col("threshold").cast("double").alias("threshold")).join(above, "threshold")


def recurrence(df: DataFrame, spec: SeriesSpec, segment: int = 500, share: float = 0.1) -> DataFrame:
    """How many rows of its segment lie within ``share`` population deviations of each row (itself included).

    Segments have a fixed number of rows, so their arrays are bounded; counts come from the segment array instead of pairs.
    """
    rows = index_rows(df.select(*spec.keys, *spec.order, spec.value), spec).withColumn("segment", F.floor(F.col(IDX) / segment))
    seg = rows.groupBy(*spec.keys, "segment").agg(F.array_sort(F.collect_list(spec.value)).alias("_all"), F.stddev_pop(spec.value).alias("_sd"))
    tagged = null_safe_join(rows, seg, [*spec.keys, "segment"])
    near = F.expr(f"size(filter(_all, v -> abs(v - `{spec.value}`) < _sd * {share!r}))")
    return tagged.withColumn("neighbours", near).drop("_all", "_sd")


def lagged_pairs(df: DataFrame, spec: SeriesSpec, lag: int = 10) -> DataFrame:
    """Phase-space pairs (value now, value ``lag`` rows later)."""
    ahead = Feature(lambda s: F.lead(spec.value, lag).over(s.ordered()), (spec.value,), fwd=lag)
    return with_features(df, spec, {"later": ahead}).filter("later is not null")


def contextual_scores(df: DataFrame, ts: str, value: str, at_least: int = 30) -> DataFrame:
    """|x - hour mean| / hour std when the hour has more than ``at_least`` rows, else 0; at most 24 statistics rows."""
    rows = df.withColumn("hour", F.hour(ts))
    stats = rows.groupBy("hour").agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(F.broadcast(stats.filter("hour is not null")), "hour", "left")
    score = F.when(F.col("_n") > at_least, F.try_divide(F.abs(F.col(value) - F.col("_mu")), F.col("_sd"))).otherwise(0.0)
    return rows.withColumn("context_score", score).drop("_mu", "_sd", "_n")


def label_at_centre(windows: DataFrame, df: DataFrame, spec: SeriesSpec, size: int, step: int) -> DataFrame:
    """Label of the middle row of each count window, 0 beyond the end of the series."""
    centre = windows.withColumn("centre", (F.col("win") * step + size // 2).cast("long"))
    at = index_rows(df.select(*spec.keys, *spec.order, spec.label), spec).select(*spec.keys, F.col(IDX).alias("centre"), F.col(spec.label).alias("_label"))
    return null_safe_join(centre, at, [*spec.keys, "centre"]).withColumn("centre_label", F.coalesce("_label", F.lit(0))).drop("_label")


def align_scores(df: DataFrame, scores: DataFrame, on: Sequence[str], score: str) -> DataFrame:
    """Every row of the series with its sequence score; rows before the first complete sequence get 0."""
    return null_safe_join(df, scores.select(*on, score), list(on)).withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))
