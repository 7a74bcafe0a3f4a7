"""Sequence, sliding and time windows, and operators built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalars import bind
from ..plans.features import Feature, carry_last, running_sum, scalar, with_features
from ..plans.series import IDX, SeriesSpec, index_rows, lay_out, micros, null_safe_join
from ..plans.stats import attach_group_stats


def consecutive_counter(flag: str, out: str) -> dict[str, Feature]:
    """Rows since the flag last was 0 (0 on rows where it is 0)."""
    zero = f"_zero_{flag}"
    return {zero: carry_last(F.when(F.coalesce(F.col(flag), F.lit(0)) == 0, F.col(IDX)), flag, IDX),
            out: scalar(F.col(IDX) - F.coalesce(F.col(zero), F.lit(-1)), zero, IDX)}


def multi_metric_score(df: DataFrame, spec: SeriesSpec, w: int = 1000) -> DataFrame:
    """Sum of |rolling z|, |deviation from median| / MAD and |step| / rolling std; NULL during warm-up."""
    x = spec.value
    f = {"_z": R.rolling_z(x, w), "_med": R.rolling_median(x, w), "_mad": R.rolling_mad(x, w),
         "_sd": R.rolling_std(x, w), "_step": R.diff(x, 1, absolute=True),
         "score": scalar(F.abs("_z") + F.try_divide(F.abs(F.col(x) - F.col("_med")), F.col("_mad"))
                         + F.try_divide(F.col("_step"), F.col("_sd")), "_z", "_med", "_mad", "_sd", "_step")}
    return with_features(df, spec, f)


def scale_agreement(df: DataFrame, keys: Sequence[str], short: str, long: str, times: float = 2.0) -> DataFrame:
    """1 where the residuals at both scales exceed ``times`` their own population deviation."""
    stats = [F.stddev_pop(short).alias("_s1"), F.stddev_pop(long).alias("_s2")]
    df = attach_group_stats(df, keys, stats)
    hit = (F.abs(F.col(short)) > times * F.col("_s1")) & (F.abs(F.col(long)) > times * F.col("_s2"))
    return df.withColumn("agree", F.when(hit, 1).otherwise(0)).drop("_s1", "_s2")


def sequences(df: DataFrame, spec: SeriesSpec, size: int, columns: Sequence[str]) -> DataFrame:
    """One row per complete trailing sequence of ``size`` rows.

    ``<col>_seq`` arrays, plus the three targets used with sequences: ``next_<value>`` (the following value),
    ``last_label`` and ``any_label``.  The arrays multiply the data ``size`` times, so feed them straight to a scorer.
    """
    def gather(c):
        return Feature(lambda laid: F.collect_list(F.col(c)).over(laid.rows(-(size - 1), 0)), (c,), back=size - 1)

    f = {f"{c}_seq": gather(c) for c in columns}
    f[f"next_{spec.value}"] = R.lead(spec.value, 1)
    if spec.label:
        f["last_label"] = scalar(F.col(spec.label), spec.label)
        f["any_label"] = R.rolling_max(spec.label, size, 1)
    return with_features(df, spec, f).filter(F.size(f"{columns[0]}_seq") == size)


def sliding_windows(df: DataFrame, spec: SeriesSpec, size: int, step: int, normalise: bool = False,
                    keep_label: bool = False) -> DataFrame:
    """Complete windows of ``size`` rows every ``step`` rows, as one ordered array per window.

    ``normalise`` z-scales each window with its population deviation (an almost constant window becomes zeros).

    Rows are collected once, in blocks of ``step``; a window joins the blocks it covers, in the layout the rows already have, so no
    row is sent or sorted more than once (apart from the halo of a chunk).
    """
    label = [spec.label] if keep_label and spec.label else []
    laid = lay_out(df.select(*dict.fromkeys([*spec.keys, *spec.order, spec.value, *label])), spec, fwd=size - 1).with_index()
    row = F.struct(IDX, F.col(spec.value).alias("v"), F.col(spec.ts).alias("t"), laid.own.alias("own"), *([F.col(spec.label).alias("y")] if label else []))
    rows = laid.df.withColumn("win", F.floor(F.col(IDX) / step)).filter(F.col(IDX) - F.col("win") * step < size)
    blocks = rows.groupBy(*laid.part, "win").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    ahead = Window.partitionBy(*laid.part).orderBy("win").rowsBetween(0, -(-size // step) - 1)
    first = F.col("_rows")[0]
    starts = blocks.withColumn("_rows", F.slice(F.flatten(F.collect_list("_rows").over(ahead)), 1, size))
    starts = starts.filter((F.size("_rows") == size) & first["own"] & (first[IDX] == F.col("win") * step))
    out = starts.select(*spec.keys, "win", F.transform("_rows", lambda p: p["v"]).alias("values"), first[IDX].alias("start_idx"), first["t"].alias("start_ts"), F.col("_rows")[size - 1]["t"].alias("end_ts"),
                        *([F.array_max(F.transform("_rows", lambda p: p["y"])).alias("label")] if label else []))
    total = lambda values, of: F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))
    known = F.transform(F.filter("values", lambda v: v.isNotNull()), lambda v: v.cast("double"))
    spread = lambda x, m: F.sqrt(F.try_divide(total(x, lambda v: (v - m) * (v - m)), F.size(x)))
    stats = bind(known, lambda x: bind(F.try_divide(total(x, lambda v: v), F.size(x)), lambda m: F.struct(m.alias("mean"), spread(x, m).alias("sd"))))
    if normalise:
        scaled = lambda s: F.transform("values", lambda v: F.when(s["sd"] < 1e-6, F.lit(0.0)).otherwise((v - s["mean"]) / s["sd"]))
        stats = bind(stats, lambda s: F.struct(s["mean"].alias("mean"), s["sd"].alias("sd"), scaled(s).alias("values")))
    out = out.withColumn("_stats", stats).withColumns({c: F.col("_stats")[c] for c in ("mean", "sd", *(["values"] if normalise else []))})
    return out.select(*spec.keys, "win", "start_idx", "start_ts", "end_ts", "mean", "sd", *(["label"] if label else []), "values")


def time_window_members(df: DataFrame, spec: SeriesSpec, size_seconds: float | None, overlap: float = 0.5,
                        share: float = 0.05) -> DataFrame:
    """Repeats each row once per time window holding it; windows start at the series start, both edges inclusive.

    Without ``size_seconds`` a window spans ``share`` of the series.  Window numbers follow from the row's
    own offset, so no range join is needed.
    """
    t = micros(df, spec.ts)
    rows = attach_group_stats(df.withColumn("_t", t), spec.keys, [F.min("_t").alias("_t0"), F.max("_t").alias("_t1")])
    if size_seconds is None:
        size = F.floor((F.col("_t1") - F.col("_t0")) / 1e6 * share) * 1e6
    else:
        size = F.lit(float(size_seconds) * 1e6)
    step = size * (1 - overlap)
    offset = F.col("_t") - F.col("_t0")
    first = F.greatest(F.lit(0), F.ceil((offset - size) / step)).cast("long")
    starts = F.greatest(F.lit(0), F.ceil((F.col("_t1") - F.col("_t0")) / step) - 1)
    last = F.least(F.floor(offset / step), starts).cast("long")
    member = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("win", F.explode(member)).drop("_t", "_t0", "_t1")


def time_windows(df: DataFrame, spec: SeriesSpec, size_seconds: float | None = None, overlap: float = 0.5) -> DataFrame:
    """Summary of every time window with at least two points."""
    x = spec.value
    rows = time_window_members(df.select(*spec.keys, spec.ts, x), spec, size_seconds, overlap)
    return (rows.groupBy(*spec.keys, "win")
            .agg(F.count(F.lit(1)).alias("n"), F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"),
                 F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
            .filter("n >= 2"))


def mark_flagged_points(df: DataFrame, spec: SeriesSpec, flagged: DataFrame, size: int, step: int) -> DataFrame:
    """1 for every row inside at least one flagged count window (``flagged`` holds keys and ``win``).

    A window opens at its first row and closes behind its last; a running sum of these events counts the windows open at a row.
    """
    win = flagged.select(*spec.keys, "win").distinct()
    events = win.select(*spec.keys, (F.col("win") * step).alias(IDX), F.lit(1).alias("_event")).union(win.select(*spec.keys, F.col("win") * step + size, F.lit(-1)))
    events = events.groupBy(*spec.keys, IDX).agg(F.sum("_event").alias("_event"))
    rows = null_safe_join(index_rows(df, spec), events, [*spec.keys, IDX])
    out = with_features(rows, spec, {"flagged": running_sum(F.coalesce("_event", F.lit(0)), "_event")}, index=True)
    return out.withColumn("flagged", (F.col("flagged") > 0).cast("int")).drop("_event")


def rolling_performance(df: DataFrame, spec: SeriesSpec, pred: str, size: int = 1000, step: int = 100) -> DataFrame:
    """Confusion counts, F1 and balanced accuracy of the previous ``size`` rows at every ``step``-th row.

    Stretches whose labels are all equal are skipped.
    """
    y, p = F.col(spec.label), F.col(pred)

    hits = {"tp": (y == 1) & (p == 1), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tn": (y == 0) & (p == 0)}
    f: dict[str, Feature] = {}
    for name, hit in hits.items():
        f |= {f"_hit_{name}": scalar(hit.cast("long"), spec.label, pred), f"_upto_{name}": R.rolling_sum(f"_hit_{name}", size, 0), name: R.lag(f"_upto_{name}", 1)}
    out = with_features(df, spec, f, index=True)
    out = out.filter((F.col(IDX) >= size) & (F.col(IDX) % step == 0) & (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    balanced = 0.5 * (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp")))
    return out.withColumn("f1", f1).withColumn("balanced_accuracy", balanced)


def run_profiles(df: DataFrame, spec: SeriesSpec, flag: str, longer_than: int = 10, first: int = 20) -> DataFrame:
    """Rows of the first runs of the flag that are long enough, with their position inside the run scaled to 0..1."""
    from .runs import mark_runs

    rows = mark_runs(df, spec, flag).filter(F.col(flag) == 1)
    runs = rows.groupBy(*spec.keys, "run_id").agg(F.min(IDX).alias("_from"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > longer_than)
    runs = runs.withColumn("run", F.row_number().over(Window.partitionBy(*spec.keys).orderBy("_from"))).filter(F.col("run") <= first)
    out = null_safe_join(rows, runs, [*spec.keys, "run_id"], "inner")
    return out.withColumn("position", (F.col(IDX) - F.col("_from")) / (F.col("_n") - 1)).drop("_from", "_n", "run_id")
