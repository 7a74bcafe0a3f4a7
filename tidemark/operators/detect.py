"""Model-free detectors, threshold selection and drift tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import lag, lead
from ..functions.scalars import kolmogorov_p, normal_two_sided
from ..plans.features import Feature, carry_last, with_features
from ..plans.lineage import cut_lineage
from ..plans.series import IDX, SeriesSpec, null_safe_join
from ..plans.stats import SMALL_GROUP, attach_group_stats, one_row, ordered_prefix, quantiles


def iqr_outliers(df: DataFrame, value: str, times: float = 1.5, keys: Sequence[str] = (), small: int = SMALL_GROUP) -> DataFrame:
    """1 where the value lies outside the quartile fences of its group."""
    q = quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, keys, small)
    rows = null_safe_join(df, q, list(keys)) if keys else one_row(df, q)
    x, spread = F.col(value), (F.col("_q3") - F.col("_q1")) * times
    return rows.withColumn("outlier", F.when((x < F.col("_q1") - spread) | (x > F.col("_q3") + spread), 1).otherwise(0)).drop("_q1", "_q3")


def z_outliers(df: DataFrame, value: str, limit: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Population z-score of the group and a flag where its size exceeds ``limit``."""
    rows = attach_group_stats(df, keys, [F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd")])
    rows = rows.withColumn("z", F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")
    return rows.withColumn("outlier", F.when(F.abs("z") > limit, 1).otherwise(0))


def normal_baseline_z(df: DataFrame, value: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """z-score against the rows labelled normal."""
    normal = F.when(F.col(label) == 0, F.col(value))
    rows = attach_group_stats(df, keys, [F.avg(normal).alias("_mu"), F.stddev_samp(normal).alias("_sd")])
    return rows.withColumn("z", F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


def percentile_threshold(df: DataFrame, score: str, pct: float, where: Column | None = None, small: int = SMALL_GROUP) -> DataFrame:
    """One-row table with the exact percentile of a score, over the rows of ``where`` if given."""
    return quantiles(df if where is None else df.filter(where), score, {"threshold": pct / 100.0}, small=small)


def apply_threshold(df: DataFrame, score: str, threshold: DataFrame, out: str = "pred", strict: bool = True) -> DataFrame:
    rows = one_row(df, threshold.agg(F.max("threshold").alias("_t")))
    hit = F.col(score) > F.col("_t") if strict else F.col(score) >= F.col("_t")
    return rows.withColumn(out, F.when(hit, 1).otherwise(0)).withColumnRenamed("_t", "threshold")


def max_feature_z(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest |population z| over the given columns; a constant column contributes nothing."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))]
    rows = one_row(df, df.agg(*aggs))
    zs = [F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}"))), F.lit(0.0)) for c in columns]
    return rows.withColumn("max_z", F.greatest(*zs) if len(zs) > 1 else zs[0]).drop(*[f"_{k}_{c}" for c in columns for k in ("mu", "sd")])


def changepoint_peaks(df: DataFrame, spec: SeriesSpec, pct: float = 95.0, small: int = SMALL_GROUP) -> DataFrame:
    """Local maxima of |step| at or above its ``pct`` percentile; a flat top counts once, at its middle row."""
    x = spec.value
    steps = with_features(df.select(*spec.keys, *spec.order, x), spec, {"step": Feature(
        lambda s: F.abs(F.col(x) - F.lag(x, 1).over(s.ordered())), (x,), back=1)}, index=True)
    # one row per stretch of equal steps, then a stretch higher than both neighbours is a peak
    new = Feature(lambda s: F.when(F.col("step").eqNullSafe(F.lag("step", 1).over(s.ordered())) & F.col("step").isNotNull(), None).otherwise(F.col("pos")), ("step",), back=1)
    stretches = with_features(steps.withColumnRenamed(IDX, "pos"), spec, {"_new": new, "first_pos": carry_last(F.col("_new"), "_new")})
    tops = stretches.groupBy(*spec.keys, "first_pos").agg(F.max("pos").alias("last_pos"), F.max("step").alias("step"))
    short = SeriesSpec(spec.keys, "first_pos", (), "step", None, spec.chunk_rows, spec.cell_rows, spec.mode)
    ranked = with_features(tops, short, {"before": lag("step", 1), "after": lead("step", 1)})
    peaks = ranked.filter((F.col("step") > F.col("before")) & (F.col("step") > F.col("after")))
    limit = quantiles(steps, "step", {"_limit": pct / 100.0}, small=small)
    peaks = one_row(peaks, limit).filter(F.col("step") >= F.col("_limit")).drop("_limit", "before", "after")
    return peaks.withColumn("idx", F.floor((F.col("first_pos") + F.col("last_pos")) / 2)).drop("first_pos", "last_pos")


# ---- two-sample tests --------------------------------------------------------------------------------

def two_sample(df: DataFrame, columns: Sequence[str], second: Column) -> DataFrame:
    """Kolmogorov-Smirnov and Mann-Whitney statistics per column between rows where ``second`` is false and true.

    Values are counted per distinct value and side; running totals of those counts give both empirical distribution
    functions and the average ranks in one pass.
    """
    side = F.when(second, 1).otherwise(0)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(side.alias("_side"), cells.alias("c")).select("_side", "c.feature", "c.v").filter("v is not null")
    counts = long.groupBy("feature", "v").agg(F.count_if(F.col("_side") == 0).alias("a"), F.count_if(F.col("_side") == 1).alias("b"))
    t = ordered_prefix(counts, "v", ["a", "b"], ["feature"])
    tie = F.col("a") + F.col("b")
    rank = F.col("a_upto") + F.col("b_upto") - tie + (tie + 1) / 2
    out = t.groupBy("feature").agg(
        F.max("a_all").alias("n1"), F.max("b_all").alias("n2"), F.max(F.abs(F.try_divide(F.col("a_upto"), F.col("a_all")) - F.try_divide(F.col("b_upto"), F.col("b_all")))).alias("ks"),
        F.sum(F.col("a") * rank).alias("_ranks"), F.sum(F.pow(tie.cast("double"), F.lit(3)) - tie).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = out.withColumn("u", F.col("_ranks") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread)
    return out.withColumn("u_z", z).drop("_ranks", "_ties")


def with_p_values(tests: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return tests.withColumn("ks_p", kolmogorov_p(F.col("ks"), n1, n2)).withColumn("u_p", normal_two_sided(F.col("u_z")))


def drift_report(df: DataFrame, columns: Sequence[str], second: Column, ks_limit: float = 0.1, shift_limit: float = 0.2) -> DataFrame:
    """Per column: KS statistic, relative shift of mean and std, and whether the drift counts as significant."""
    tests = two_sample(df, columns, second)
    aggs = []
    for i, c in enumerate(columns):
        for tag, on in (("1", ~second), ("2", second)):
            aggs += [F.avg(F.when(on, F.col(c))).alias(f"m{tag}_{i}"), F.stddev_samp(F.when(on, F.col(c))).alias(f"s{tag}_{i}")]
    row = df.agg(*aggs)

    def shift(kind, i):
        return F.abs(F.col(f"{kind}1_{i}") - F.col(f"{kind}2_{i}")) / (F.abs(F.col(f"{kind}1_{i}")) + 1e-10)

    shifts = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), shift("m", i).alias("mean_shift"), shift("s", i).alias("std_shift"))
                                            for i, c in enumerate(columns)])).alias("r")).select("r.*")
    out = tests.join(F.broadcast(shifts), "feature")
    significant = (F.col("ks") > ks_limit) | (F.col("mean_shift") > shift_limit)
    return out.withColumn("significant", F.when(significant, 1).otherwise(0))


# ---- extreme value thresholds ---------------------------------------------------------------------------

def _quantile_expr(q: float) -> Column:
    """Threshold exceeded with probability ``q`` under the fitted tail."""
    ratio = F.lit(float(q)) * F.col("n") / F.col("n_peaks")
    return F.when(F.col("gamma") != 0, F.col("t") + F.col("sigma") / F.col("gamma") * (F.pow(ratio, -F.col("gamma")) - 1)) \
            .otherwise(F.col("t") - F.col("sigma") * F.log(ratio))


def _peaks(df: DataFrame, score: str, pct: float, keys: Sequence[str], small: int) -> tuple[DataFrame, DataFrame]:
    keys = list(keys)
    level = quantiles(df, score, {"t": pct / 100.0}, keys, small)
    level = null_safe_join(level, df.groupBy(*keys).agg(F.count(score).alias("n")), keys) if keys else one_row(level, df.agg(F.count(score).alias("n")))
    rows = null_safe_join(df.select(*keys, score), level, keys) if keys else one_row(df.select(score), level)
    return rows.filter(F.col(score) > F.col("t")).select(*keys, "t", "n", (F.col(score) - F.col("t")).alias("y")), level


def tail_fit_moments(df: DataFrame, score: str, q: float = 1e-3, pct: float = 98.0, keys: Sequence[str] = (), central: bool = False,
                     small: int = SMALL_GROUP) -> DataFrame:
    """Peaks over the ``pct`` percentile, fitted by moments, and the threshold ``z_q``.

    By default the second moment is taken around zero; ``central=True`` uses the variance.
    """
    peaks, _ = _peaks(df, score, pct, keys, small)
    m1 = F.avg("y")
    fit = peaks.groupBy(*keys, "t", "n").agg(F.count("y").alias("n_peaks"), m1.alias("_m1"), (F.var_pop("y") if central else F.avg(F.col("y") * F.col("y"))).alias("_m2"))
    ratio = F.col("_m1") * F.col("_m1") / F.col("_m2")
    fit = fit.withColumn("gamma", 0.5 * (ratio - 1) if not central else 0.5 * (1 - ratio)).withColumn("sigma", 0.5 * F.col("_m1") * (ratio + 1))
    return fit.withColumn("z_q", _quantile_expr(q)).drop("_m1", "_m2").filter("n_peaks >= 2")


def tail_fit_likelihood(df: DataFrame, score: str, q: float = 1e-3, pct: float = 98.0, keys: Sequence[str] = (), grid: int = 256, rounds: int = 4,
                        small: int = SMALL_GROUP) -> DataFrame:
    """Peaks over threshold fitted by maximum likelihood reduced to one unknown.

    For a candidate ``x`` the shape is ``mean(ln(1 + x y))`` and the scale ``shape / x``.  In every round each task adds up both means
    for a grid of candidates on each side of 0 over its own peaks, only those short sums are shuffled, and the next round zooms in
    around the best candidate.  Only stationary points count (the likelihood is unbounded towards the negative end); the
    exponential tail ``x = 0`` always competes.
    """
    keys = list(keys)
    peaks, _ = _peaks(df, score, pct, keys, small)
    peaks = cut_lineage(peaks)
    shape = peaks.groupBy(*keys, "t", "n").agg(F.count("y").alias("n_peaks"), F.avg("y").alias("mean"), F.min("y").alias("_lo"), F.max("y").alias("_hi")).filter("n_peaks >= 2")
    eps = 1e-8
    negative = F.struct(F.lit(-1).alias("side"), (-1.0 / F.col("_hi") + eps).alias("a"), F.lit(-eps).alias("b"))
    positive = F.struct(F.lit(1).alias("side"), F.lit(eps).alias("a"), F.greatest(2 * (F.col("mean") - F.col("_lo")) / F.pow("_lo", F.lit(2)), F.lit(10 * eps)).alias("b"))
    bounds = shape.select(*keys, F.explode(F.array(negative, positive)).alias("s")).select(*keys, "s.*")
    schema = T.StructType([*peaks.select(*keys).schema, *[T.StructField(n, T.DoubleType()) for n in ("side", "x", "left", "right", "logs", "inverses", "count")]])

    def candidates(side: float, a: float, b: float) -> np.ndarray:
        # even spacing below 0; geometric above, where the range spans many orders of magnitude
        return np.linspace(a, b, grid) if side < 0 else np.geomspace(a, b, grid)

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, part in pdf.groupby([*keys, "side", "a", "b"], dropna=False):
                x = candidates(*group[-3:])
                logs, inverses = np.zeros(grid), np.zeros(grid)
                for y in np.array_split(part["y"].to_numpy(), -(-len(part) // 1000)):
                    grown = 1 + x[:, None] * y[None, :]
                    logs += np.log(grown).sum(axis=1)
                    inverses += (1 / grown).sum(axis=1)
                out = pd.DataFrame({"side": float(group[-3]), "x": x, "left": x[np.maximum(np.arange(grid) - 1, 0)], "right": x[np.minimum(np.arange(grid) + 1, grid - 1)],
                                    "logs": logs, "inverses": inverses, "count": float(len(part))})
                yield out.assign(**dict(zip(keys, group)))[[f.name for f in schema]]

    for _ in range(rounds):
        rows = null_safe_join(peaks.select(*keys, "y"), bounds, keys, "inner") if keys else peaks.select("y").crossJoin(F.broadcast(bounds))
        tried = rows.mapInPandas(partial_sums, schema).groupBy(*keys, "side", "x", "left", "right").agg(
            (F.sum("logs") / F.sum("count")).alias("gamma"), (F.sum("inverses") / F.sum("count")).alias("u"))
        tried = tried.withColumn("sigma", F.try_divide(F.col("gamma"), F.col("x"))).withColumn("ll", -F.log("sigma") - F.col("gamma") - 1).filter("sigma > 0")
        best = tried.groupBy(*keys, "side").agg(F.max_by(F.struct("gamma", "sigma", "u", "left", "right", "ll"), "ll").alias("m")).select(*keys, "side", "m.*")
        best = cut_lineage(best)
        bounds = best.select(*keys, "side", F.col("left").alias("a"), F.col("right").alias("b"))
    stationary = F.abs(F.col("u") * (1 + F.col("gamma")) - 1) < 1e-4
    flat = shape.select(*keys, F.lit(0.0).alias("side"), F.lit(0.0).alias("gamma"), F.col("mean").alias("sigma"), (-F.log("mean") - 1).alias("ll"))
    every = best.filter(stationary).select(*keys, "side", "gamma", "sigma", "ll").unionByName(flat)
    win = every.groupBy(*keys).agg(F.max_by(F.struct("gamma", "sigma", "ll"), F.struct(F.col("ll"), -F.abs("side"))).alias("m"))
    win = win.select(*keys, F.col("m.gamma"), F.col("m.sigma"), F.col("m.ll").alias("mean_ll"))
    base = shape.select(*keys, "t", "n", "n_peaks")
    return (null_safe_join(base, win, keys) if keys else one_row(base, win)).withColumn("z_q", _quantile_expr(q))


def monitoring_report(df: DataFrame, scaled: Sequence[str], score: str, pred: str, expected_rate: float, limit: float = 5.0, check: int | None = None) -> DataFrame:
    """One-row health check of a scored batch.

    Warns when the alarm rate is off the training rate by more than half of it, when no score reaches 0.8, and when a scaled feature
    (one of the first ``check``, if given) leaves ``[-limit, limit]``.
    """
    watched = list(scaled)[:check]
    row = df.agg(F.count(F.lit(1)).alias("n_samples"), F.avg(pred).alias("anomaly_rate"), F.max(score).alias("max_probability"),
                 *[F.max(F.abs(c)).alias(f"_x_{i}") for i, c in enumerate(watched)])
    off = F.abs(F.col("anomaly_rate") - expected_rate) / F.lit(float(expected_rate)) > 0.5
    extreme = F.array_compact(F.array(*[F.when(F.col(f"_x_{i}") > limit, F.lit(c)) for i, c in enumerate(watched)]))
    warn = [F.when(off, F.format_string("alarm rate %.3f differs from training rate %.3f", "anomaly_rate", F.lit(float(expected_rate)))),
            F.when(F.col("max_probability") < 0.8, F.lit("no high-confidence alarm")),
            F.when(F.size(extreme) > 0, F.concat(F.lit("extreme values in: "), F.array_join(F.slice(extreme, 1, 5), ", ")))]
    out = row.withColumn("warnings", F.array_compact(F.array(*warn))).withColumn("expected_anomaly_rate", F.lit(float(expected_rate)))
    return out.withColumn("performance_check", F.when(F.size("warnings") == 0, "PASS").otherwise("WARNING")).drop(*[f"_x_{i}" for i in range(len(watched))])


def degradation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Relative loss in percent from the first to the second table of ``(metric, value)``."""
    b = second.select("metric", F.col("value").alias("second"))
    return first.select("metric", F.col("value").alias("first")).join(b, "metric").withColumn(
        "degradation_pct", F.try_divide(F.col("first") - F.col("second"), F.col("first")) * 100)
