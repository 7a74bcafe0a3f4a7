"""Runs of flagged rows: intervals, gap filling, short-run removal, voting, run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag
from ..plans.features import Feature, running_sum, scalar, with_features
from ..plans.series import IDX, SeriesSpec


def _begins(flag: str) -> Feature:
    def build(laid):
        was = F.coalesce(F.lag(flag, 1).over(laid.ordered()), F.lit(0))
        return F.when((F.col(flag) == 1) & (was != 1), 1).otherwise(0)

    return Feature(build, (flag,), back=1)


def mark_runs(df: DataFrame, spec: SeriesSpec, flag: str, out: str = "run_id") -> DataFrame:
    """Numbers the runs of 1s of each series from 1 in column ``run_id`` (meaningful on rows where the flag is 1)."""
    return with_features(df, spec, {"_begins": _begins(flag), out: running_sum(F.col("_begins"), "_begins")}, index=True)


def run_intervals(df: DataFrame, spec: SeriesSpec, flag: str, keep_open_run: bool = True) -> DataFrame:
    """One row per run of 1s: index and time bounds, length, and value statistics.

    ``keep_open_run=False`` leaves out a run that reaches the end of its series.
    """
    f = {"_begins": _begins(flag), "run_id": running_sum(F.col("_begins"), "_begins"),
         "final": Feature(lambda s: F.lead(F.lit(1), 1).over(s.ordered()).isNull().cast("int"), (), fwd=1)}
    x = F.col(spec.value)
    narrow = df.select(*dict.fromkeys([*spec.keys, *spec.order, spec.value, flag]))
    rows = with_features(narrow, spec, f, index=True)
    out = (rows.filter(F.col(flag) == 1).groupBy(*spec.keys, "run_id")
           .agg(F.min(IDX).alias("start_idx"), F.max(IDX).alias("end_idx"), F.min(spec.ts).alias("start_ts"), F.max(spec.ts).alias("end_ts"),
                F.count(F.lit(1)).alias("n"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean_value"),
                F.stddev_samp(x).alias("std_value"), F.max("final").alias("_open")))
    if not keep_open_run:
        out = out.filter("_open = 0")
    return out.drop("_open")


def filled(flag: str, gap: int, out: str) -> dict[str, Feature]:
    """Turns 0s into 1s between two runs at most ``gap`` rows apart; a bounded look to both sides is enough."""
    def build(laid):
        one = F.when(F.col(flag) == 1, F.col(IDX))
        # the nearest 1 on either side, as running values: a frame of ``gap`` rows would be read again for every row
        before = F.last(one, ignorenulls=True).over(laid.rows(Window.unboundedPreceding, 0))
        after = F.last(one, ignorenulls=True).over(laid.reverse().rowsBetween(Window.unboundedPreceding, 0))
        return F.when(F.col(flag) == 1, 1).when(after - before - 1 <= gap, 1).otherwise(0)

    return {out: Feature(build, (flag, IDX), back=gap, fwd=gap)}


def fill_gaps(df: DataFrame, spec: SeriesSpec, flag: str, gap: int, out: str = "filled") -> DataFrame:
    if gap <= 0:
        return df.withColumn(out, F.col(flag))
    return with_features(df, spec, filled(flag, gap, out))


def long_runs(flag: str, shortest: int, out: str) -> dict[str, Feature]:
    """Clears runs with fewer than ``shortest`` rows; a look of ``shortest`` rows to both sides decides."""
    def build(laid):
        zero = F.when(F.coalesce(F.col(flag), F.lit(0)) != 1, F.col(IDX))
        reach_back, reach_on = laid.rows(-shortest, 0), laid.rows(0, shortest)
        before = F.coalesce(F.max(zero).over(reach_back), F.min(IDX).over(reach_back) - 1)
        after = F.coalesce(F.min(zero).over(reach_on), F.max(IDX).over(reach_on) + 1)
        return F.when((F.col(flag) == 1) & (after - before - 1 >= shortest), 1).otherwise(0)

    return {out: Feature(build, (flag, IDX), back=shortest, fwd=shortest)}


def drop_short_runs(df: DataFrame, spec: SeriesSpec, flag: str, shortest: int, out: str = "kept") -> DataFrame:
    return with_features(df, spec, long_runs(flag, shortest, out))


def majority_vote(df: DataFrame, spec: SeriesSpec, flag: str, w: int, centred: bool = True, out: str = "voted") -> DataFrame:
    """1 where more than half of the rows around (or up to) the row are flagged."""
    back, fwd = (w // 2, w - 1 - w // 2) if centred else (w - 1, 0)
    vote = Feature(lambda s: F.when(F.avg(flag).over(s.rows(-back, fwd)) > 0.5, 1).otherwise(0), (flag,), back=back, fwd=fwd)
    return with_features(df, spec, {out: vote})


def run_summary(intervals: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Count and length statistics of a set of intervals per series."""
    return intervals.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"),
        F.avg(F.col("max_value") - F.col("min_value")).alias("mean_range"), F.corr("n", F.col("max_value") - F.col("min_value")).alias("range_length_corr"))


def transitions(df: DataFrame, spec: SeriesSpec, flag: str) -> DataFrame:
    """Rows where the flag turns on (``change`` 1) or off (-1), with the value and its change there."""
    f = {"_was": lag(flag, 1), "_before": lag(spec.value, 1),
         "change": scalar(F.col(flag) - F.col("_was"), flag, "_was"),
         "value_change": scalar(F.col(spec.value) - F.col("_before"), "_before")}
    return with_features(df, spec, f).filter("change in (1, -1)")


def collective_runs(df: DataFrame, spec: SeriesSpec, w: int = 1000, z: float = 3.0, longer_than: int = 10, keep_open_run: bool = False) -> DataFrame:
    """Runs of more than ``longer_than`` consecutive rows whose rolling z exceeds ``z``."""
    from ..functions.rolling import rolling_z

    f = {"_z": rolling_z(spec.value, w), "odd": scalar(F.when(F.abs("_z") > z, 1).otherwise(0), "_z")}
    return run_intervals(with_features(df, spec, f), spec, "odd", keep_open_run).filter(F.col("n") > longer_than)


def prediction_summary(df: DataFrame, score: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Totals, alarm rate, and how many scores are confident (> .8), unsure (.4 to .6), with mean confidence."""
    p = F.col(score)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col(pred).cast("long")).alias("anomalies"), (F.avg(pred) * 100).alias("rate_pct"),
        F.sum((p > 0.8).cast("long")).alias("high_confidence"), F.sum(((p >= 0.4) & (p <= 0.6)).cast("long")).alias("low_confidence"),
        F.avg(F.abs(p - 0.5) * 2).alias("mean_confidence"), F.max(score).alias("max_score"))
