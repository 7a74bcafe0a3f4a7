"""Profiling aggregates of one or many series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import lead
from ..functions.scalars import bin_index, gamma_value, histogram_bin, normal_quantile
from ..plans.features import Feature, scalar, with_features
from ..plans.series import IDX, SeriesSpec, index_rows, lay_out, micros, null_safe_join
from ..plans.stats import SMALL_GROUP, attach_group_stats, average_ranks, one_row, ordered_prefix, quantiles


def bin_stats(df: DataFrame, value: str, edges: Sequence[float], include_lowest: bool = False) -> DataFrame:
    """Mean and std per regime bin; at most one row per bin (plus one for values outside)."""
    binned = df.withColumn("bin", bin_index(F.col(value), edges, include_lowest))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def normalise_by_bin(df: DataFrame, value: str, edges: Sequence[float], include_lowest: bool = False, stats: DataFrame | None = None,
                     fill: float | None = None, out: str = "normalised") -> DataFrame:
    """z-score of each value inside its regime bin; the statistics table is bounded by the number of edges."""
    stats = bin_stats(df, value, edges, include_lowest) if stats is None else stats
    stats = F.broadcast(stats.filter("bin is not null").select("bin", F.col("mean").alias("bin_mean"), F.col("std").alias("bin_std")))
    joined = df.withColumn("bin", bin_index(F.col(value), edges, include_lowest)).join(stats, "bin", "left")
    z = F.try_divide(F.col(value) - F.col("bin_mean"), F.col("bin_std"))
    return joined.withColumn(out, z if fill is None else F.coalesce(z, F.lit(fill)))


def describe(df: DataFrame, value: str, label: str | None = None, small: int = SMALL_GROUP) -> DataFrame:
    """count, mean, std, min, quartiles, max for all rows (``label`` NULL) and for each label value; rows without a label count among
    all rows only."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    quarter = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if label is None:
        return one_row(df.agg(*aggs), quantiles(df, value, quarter, small=small))
    sides = df.select(value, F.explode(F.array_distinct(F.array(F.lit(None).cast("int"), F.col(label).cast("int")))).alias("label"))
    return null_safe_join(sides.groupBy("label").agg(*aggs), quantiles(sides, value, quarter, ["label"], small), ["label"])


def time_range(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """First and last time, span in seconds and rows per second, per series."""
    rows = df.withColumn("_t", micros(df, spec.ts))
    out = rows.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"),
                                       ((F.max("_t") - F.min("_t")) / 1e6).alias("seconds"))
    return out.withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col("seconds")))


def hourly_stats(df: DataFrame, ts: str, value: str, label: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    if label:
        aggs += [F.sum(F.col(label).cast("long")).alias("anomalies"), (F.avg(label) * 100).alias("anomaly_rate_pct")]
    return df.groupBy(F.hour(ts).alias("hour")).agg(*aggs)


def extreme_hours(df: DataFrame, ts: str, label: str) -> DataFrame:
    """Hours with the most and the fewest flagged rows (earliest hour on ties) among hours that have any."""
    counts = df.filter(F.col(label) == 1).groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.max_by("hour", F.struct("c", -F.col("hour"))).alias("most_hour"), F.min_by("hour", F.struct("c", "hour")).alias("least_hour"),
                      F.max("c").alias("most"), F.min("c").alias("least"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per label value; the share uses a total over the (few) label rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return one_row(counts, counts.agg(F.sum("n").alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def shape_metrics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))


def percentile_curve(df: DataFrame, value: str, points: int = 101, small: int = SMALL_GROUP) -> DataFrame:
    """``(pct, value)`` for evenly spaced percentages 0..100."""
    grid = {f"p{i}": i / (points - 1) for i in range(points)}
    wide = quantiles(df, value, grid, small=small)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i * 100 // (points - 1)).alias("pct"), F.col(n).alias("value")) for i, n in enumerate(grid)])).alias("r")).select("r.*")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Count and density per equal-width bin between the overall extremes (per group in ``by``)."""
    rows = one_row(df, df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    counts = rows.groupBy(*by, histogram_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(*by, "_lo")  # at most ``bins`` rows per group
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) / bins
    return counts.withColumn("density", F.col("n") / F.sum("n").over(total) / width).withColumn("left_edge", F.col("_lo") + F.col("bin") * width).drop("_lo", "_hi")


def box_stats(df: DataFrame, value: str, keys: Sequence[str] = (), small: int = SMALL_GROUP) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR) and number of outliers."""
    q = quantiles(df, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, keys, small)
    rows = null_safe_join(df, q, list(keys)) if keys else one_row(df, q)
    x, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    return rows.groupBy(*keys, "q1", "q2", "q3").agg(F.min(F.when(inside, x)).alias("low_whisker"), F.max(F.when(inside, x)).alias("high_whisker"),
                                                     F.sum((~inside).cast("long")).alias("outliers"))


def empirical_cdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: its count and the scaled positions ``i/(n-1)`` of its first and last copy."""
    t = average_ranks(df, value, keys=keys)
    last = F.greatest(F.col("n_all") - 1, F.lit(1))
    return t.select(*keys, value, "n", ((F.col("n_upto") - F.col("n")) / last).alias("p_first"), ((F.col("n_upto") - 1) / last).alias("p_last"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, from one aggregate row."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def autocorrelation(df: DataFrame, spec: SeriesSpec, lags: int = 50) -> DataFrame:
    """Autocorrelation at lags 0..``lags`` per series, normalised by the full sum of squares.

    Every chunk (with ``lags`` rows of its predecessor) yields ``lags + 1`` partial sums of products, which are then added up.
    """
    x = spec.value
    rows = attach_group_stats(df.select(*spec.keys, *spec.order, x), spec.keys, [F.avg(x).alias("_mu")])
    laid = lay_out(rows, spec, back=lags)
    own = laid.df.withColumn("_own", laid.own)
    keys, order = list(spec.keys), laid.order
    schema = T.StructType([*df.select(*keys).schema, T.StructField("lag", T.IntegerType()), T.StructField("_s", T.DoubleType())])

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        c = np.nan_to_num(pdf[x].to_numpy(dtype=float) - pdf["_mu"].to_numpy())
        mine = np.where(pdf["_own"].to_numpy(), c, 0.0)
        sums = [float(mine[k:] @ c[: len(c) - k]) if k < len(c) else 0.0 for k in range(lags + 1)]
        out = pd.DataFrame({"lag": np.arange(lags + 1, dtype="int32"), "_s": sums})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "lag", "_s"]]

    sums = own.groupBy(*laid.part).applyInPandas(products, schema).groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(Window.partitionBy(*keys))  # lags + 1 rows per series
    return sums.select(*keys, "lag", F.try_divide(F.col("_s"), zero).alias("acf"))


def label_transitions(df: DataFrame, spec: SeriesSpec, label: str) -> DataFrame:
    """How often each label value is followed by each."""
    nxt = with_features(df.select(*spec.keys, *spec.order, label), spec, {"next": lead(label, 1)}).filter("next is not null")
    return nxt.groupBy(F.col(label).alias("state"), F.col("next").alias("next_state")).agg(F.count(F.lit(1)).alias("n"))


def decile_transitions(df: DataFrame, spec: SeriesSpec, small: int = SMALL_GROUP) -> DataFrame:
    """Transition probabilities between the deciles of the value (edge-based, lowest edge included)."""
    x = spec.value
    edges = quantiles(df, x, {f"e{i}": i / 10 for i in range(11)}, small=small)
    rows = one_row(df.select(*spec.keys, *spec.order, x), edges)
    state = sum(((F.col(x) > F.col(f"e{i}")).cast("int") for i in range(2, 10)), (F.col(x) > F.col("e1")).cast("int"))
    f = {"state": scalar(state, x), "next_state": lead("state", 1)}
    counts = with_features(rows, spec, f).filter("next_state is not null").groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def density_grid(df: DataFrame, spec: SeriesSpec, time_bins: int = 100, value_bins: int = 50) -> DataFrame:
    """Flagged rows per (position bin, value bin); ``pd.cut``-style bins closed on the right, lowest included."""
    rows = index_rows(df.select(*spec.keys, *spec.order, spec.value, spec.label), spec)
    bounds = [F.min(IDX).alias("_i0"), F.max(IDX).alias("_i1"), F.min(spec.value).alias("_v0"), F.max(spec.value).alias("_v1")]
    rows = attach_group_stats(rows, spec.keys, bounds)

    def cut(c, lo, hi, k):
        place = F.coalesce(F.try_divide((F.col(c) - F.col(lo)) * k, F.col(hi) - F.col(lo)), F.lit(0.0))  # a constant is all in the first bin
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.ceil(place) - 1).cast("int"))

    return rows.groupBy(*spec.keys, cut(IDX, "_i0", "_i1", time_bins).alias("time_bin"), cut(spec.value, "_v0", "_v1", value_bins).alias("value_bin")) \
               .agg(F.sum(F.col(spec.label).cast("long")).alias("anomalies"), F.count(F.lit(1)).alias("n"))


def minute_matrix(df: DataFrame, spec: SeriesSpec, block: int = 60, columns: int = 60) -> DataFrame:
    """Any-flag per block of rows, arranged as matrix cells (row, col)."""
    rows = index_rows(df.select(*spec.keys, *spec.order, spec.label), spec)
    cell = F.floor(F.col(IDX) / block)
    return rows.groupBy(*spec.keys, cell.alias("block")).agg(F.max(spec.label).alias("any_flag")) \
               .withColumn("row", F.floor(F.col("block") / columns)).withColumn("col", F.col("block") % columns)


def label_contrast(df: DataFrame, value: str, label: str, small: int = SMALL_GROUP) -> DataFrame:
    """Difference of means and medians between flagged and other rows."""
    med = quantiles(df, value, {"med": 0.5}, [label], small)
    med = med.agg(F.max(F.when(F.col(label) == 1, F.col("med"))).alias("m1"), F.max(F.when(F.col(label) == 0, F.col("med"))).alias("m0"))
    mean = df.agg(F.avg(F.when(F.col(label) == 1, F.col(value))).alias("a1"), F.avg(F.when(F.col(label) == 0, F.col(value))).alias("a0"))
    return one_row(mean, med).select((F.col("a1") - F.col("a0")).alias("mean_diff"), (F.col("m1") - F.col("m0")).alias("median_diff"))


def around_starts(df: DataFrame, spec: SeriesSpec, flag: str, before: int = 60, after: int = 60) -> DataFrame:
    """Value statistics of the rows just before and from each run start, over starts with room on both sides.

    A row counts once per start near it, so starts inside a bounded frame are counted instead of joined.
    """
    rows = attach_group_stats(index_rows(df.select(*spec.keys, *spec.order, spec.value, flag), spec).withColumnRenamed(IDX, "pos"),
                              spec.keys, [F.max("pos").alias("_last")])
    starts = Feature(lambda s: F.when((F.col(flag) - F.lag(flag, 1).over(s.ordered()) == 1) & (F.col("pos") > before)
                                      & (F.col("pos") <= F.col("_last") - after), 1).otherwise(0), (flag,), back=1)
    f = {"start": starts,
         "pre": Feature(lambda s: F.coalesce(F.sum("start").over(s.rows(1, before)), F.lit(0)), ("start",), fwd=before),
         "post": Feature(lambda s: F.sum("start").over(s.rows(-after, 0)), ("start",), back=after)}
    x = F.col(spec.value)
    wide = with_features(rows, spec, f)
    return wide.groupBy(*spec.keys).agg(
        F.sum("pre").alias("n_pre"), F.try_divide(F.sum(F.col("pre") * x), F.sum("pre")).alias("mean_pre"), F.min(F.when(F.col("pre") > 0, x)).alias("min_pre"),
        F.sum("post").alias("n_post"), F.try_divide(F.sum(F.col("post") * x), F.sum("post")).alias("mean_post"), F.min(F.when(F.col("post") > 0, x)).alias("min_post"))


def flag_gaps(df: DataFrame, spec: SeriesSpec, flag: str, above: float = 1.0, below: float | None = None) -> DataFrame:
    """Seconds between consecutive flagged rows, kept when above (and below) the limits."""
    rows = df.filter(F.col(flag) == 1)
    rows = rows.withColumn("_t", micros(rows, spec.ts))
    gaps = with_features(rows, spec, {"gap": Feature(lambda s: (F.col("_t") - F.lag("_t", 1).over(s.ordered())) / 1e6, ("_t",), back=1)}).drop("_t")
    keep = F.col("gap") > above
    return gaps.filter(keep if below is None else keep & (F.col("gap") < below))


def change_summary(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    d = Feature(lambda s: F.col(spec.value) - F.lag(spec.value, 1).over(s.ordered()), (spec.value,), back=1)
    rows = with_features(df.select(*spec.keys, *spec.order, spec.value), spec, {"d": d})
    return rows.groupBy(*spec.keys).agg(F.max(F.abs("d")).alias("max_change"), F.avg(F.abs("d")).alias("mean_change"), F.stddev_samp("d").alias("volatility"))


def density_curve(df: DataFrame, value: str, points: int = 1000, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on an even grid between the extremes, Scott bandwidth.

    Equal values are merged first; every task then adds its values' kernels onto the grid and only the grids are shuffled.
    """
    keys = list(keys)
    merged = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    shape = [F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    stats = df.groupBy(*keys).agg(*shape)
    rows = null_safe_join(merged, stats, keys) if keys else one_row(merged, stats)
    schema = T.StructType([f for f in df.select(*keys).schema] + [T.StructField("point", T.IntegerType()), T.StructField("at", T.DoubleType()), T.StructField("_part", T.DoubleType())])

    def add_kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, part in (pdf.groupby(keys, dropna=False) if keys else [((), pdf)]):
                first = part.iloc[0]
                grid = np.linspace(first["_lo"], first["_hi"], points)
                width = first["_sd"] * first["_n"] ** -0.2
                scale = 1.0 / (first["_n"] * width * np.sqrt(2 * np.pi))
                total = np.zeros(points)
                for at in range(0, len(part), 2000):
                    v, w = part[value].to_numpy()[at:at + 2000, None], part["_w"].to_numpy()[at:at + 2000, None]
                    total += (w * np.exp(-0.5 * ((grid[None, :] - v) / width) ** 2)).sum(axis=0)
                out = pd.DataFrame({"point": np.arange(points, dtype="int32"), "at": grid, "_part": total * scale})
                for name, v in zip(keys, group if isinstance(group, tuple) else (group,)):
                    out[name] = v
                yield out[[*keys, "point", "at", "_part"]]

    return rows.mapInPandas(add_kernels, schema).groupBy(*keys, "point").agg(F.max("at").alias("at"), F.sum("_part").alias("density"))


def row_positions(df: DataFrame, by: str, tie: str, spread: int | None = None) -> DataFrame:
    """1-based position of each row in the global order of ``by``.

    Copies of one value are dealt into ``spread`` hash buckets so that even a value held by most rows is ranked in pieces.
    """
    n = df.count()
    spread = spread or max(1, n // SMALL_GROUP)
    rows = df.withColumn("_deal", F.pmod(F.xxhash64(tie), F.lit(spread)).cast("int"))
    counts = rows.groupBy(by, "_deal").agg(F.count(F.lit(1)).alias("n"))
    per_value = ordered_prefix(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by, ["n"])
    deals = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    deals = null_safe_join(deals, per_value.select(by, (F.col("n_upto") - F.col("n")).alias("_base"), F.col("n_all").alias("total")), [by])
    deals = deals.select(by, "_deal", (F.col("_base") + F.col("_before")).alias("_offset"), "total")
    inside = Window.partitionBy(by, "_deal").orderBy(tie)
    return null_safe_join(rows.withColumn("_rn", F.row_number().over(inside)), deals, [by, "_deal"]) \
        .withColumn("position", F.col("_offset") + F.col("_rn")).drop("_deal", "_offset", "_rn")


def normal_qq(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Theoretical normal quantile (order-statistic medians) next to each ordered value."""
    rows = row_positions(df.select(value, tie).filter(F.col(value).isNotNull()), value, tie)
    i, n = F.col("position"), F.col("total").cast("double")
    top = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == F.col("total"), top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))
    return rows.withColumn("theoretical", normal_quantile(p)).select("position", "theoretical", value)


def qq_fit(points: DataFrame, value: str) -> DataFrame:
    return points.agg(F.regr_slope(value, "theoretical").alias("slope"), F.regr_intercept(value, "theoretical").alias("intercept"),
                      F.corr(value, "theoretical").alias("r"))


def normal_fit(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """Mean and deviation of a column and the fitted normal density on an even grid between its extremes."""
    fit = df.agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    grid = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1)
    pdf = F.try_divide(F.exp(-0.5 * F.pow(F.try_divide(F.col("at") - F.col("mu"), F.col("sigma")), F.lit(2))), F.col("sigma") * F.sqrt(2 * F.pi()))
    return grid.withColumn("at", at).withColumn("pdf", pdf).drop("_lo", "_hi")


def extreme_value_limits(df: DataFrame, value: str, low: float = 0.001, high: float = 0.999, keys: Sequence[str] = ()) -> DataFrame:
    """Generalised extreme value fit by L-moments, its two tail quantiles, and how many values lie outside them."""
    keys = list(keys)
    t = average_ranks(df, value, keys=keys)
    n, c = F.col("n_all").cast("double"), F.col("n").cast("double")
    a, b = F.col("n_upto").cast("double") - c, F.col("n_upto").cast("double") - 1  # 0-based positions a..b of the copies of this value

    def ones(k):  # sum of i over 0..k
        return k * (k + 1) / 2

    def twos(k):  # sum of i(i-1) over 0..k
        return (k + 1) * k * (k - 1) / 3

    x = F.col(value)
    m = t.groupBy(*keys).agg((F.sum(x * c) / F.max(n)).alias("b0"), F.try_divide(F.sum(x * (ones(b) - ones(a - 1))), F.max(n * (n - 1))).alias("b1"),
                             F.try_divide(F.sum(x * (twos(b) - twos(a - 1))), F.max(n * (n - 1) * (n - 2))).alias("b2"))
    l2 = 2 * F.col("b1") - F.col("b0")
    m = m.withColumn("t3", F.try_divide(6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), l2))
    z = F.try_divide(F.lit(2.0), 3.0 + F.col("t3")) - F.lit(np.log(2) / np.log(3))
    m = m.withColumn("shape", 7.8590 * z + 2.9554 * z * z).withColumn("_g", gamma_value(1 + F.col("shape")))
    m = m.withColumn("scale", F.try_divide(l2 * F.col("shape"), (1 - F.pow(F.lit(2.0), -F.col("shape"))) * F.col("_g")))
    m = m.withColumn("location", F.col("b0") - F.try_divide(F.col("scale") * (1 - F.col("_g")), F.col("shape")))

    def tail(p):
        return F.col("location") + F.try_divide(F.col("scale"), F.col("shape")) * (1 - F.pow(F.lit(-np.log(p)), F.col("shape")))

    limits = m.select(*keys, "shape", "scale", "location", tail(low).alias("low_limit"), tail(high).alias("high_limit"))
    rows = null_safe_join(df, limits, keys) if keys else one_row(df, limits)
    return rows.groupBy(*limits.columns).agg(F.sum((x < F.col("low_limit")).cast("long")).alias("below"), F.sum((x > F.col("high_limit")).cast("long")).alias("above"))


def classify_flagged(df: DataFrame, spec: SeriesSpec, label: str, small: int = SMALL_GROUP) -> DataFrame:
    """Type of each flagged row: sudden change (|step| above the 95th percentile of steps) before low / high (2 sigma
    of the normal rows) before other."""
    x = F.col(spec.value)
    rows = with_features(df, spec, {"step": Feature(lambda s: x - F.lag(spec.value, 1).over(s.ordered()), (spec.value,), back=1)})
    normal = df.agg(F.avg(F.when(F.col(label) == 0, x)).alias("_mu"), F.stddev_samp(F.when(F.col(label) == 0, x)).alias("_sd"))
    flagged = rows.filter(F.col(label) == 1)
    flagged = one_row(one_row(flagged, normal), quantiles(flagged, "step", {"_p95": 0.95}, small=small))
    kind = F.when(F.abs("step") > F.col("_p95"), "sudden_change").when(x < F.col("_mu") - 2 * F.col("_sd"), "low_speed") \
            .when(x > F.col("_mu") + 2 * F.col("_sd"), "high_speed").otherwise("other")
    return flagged.withColumn("type", kind).drop("_mu", "_sd", "_p95")
