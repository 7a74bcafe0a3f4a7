"""Statistics that reach every row: one-row and per-group tables, exact distributed quantiles, ordered prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .series import null_safe_join

SMALL_GROUP = 1_000_000  # values one task may sort or hash for an exact order statistic


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Adds aggregates of the row's group (or of the whole frame) as columns; the row count is unchanged.

    The aggregate table has one row per group; without keys it has exactly one row and is broadcast.
    """
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))
    return null_safe_join(df, df.groupBy(*keys).agg(*aggs), keys)


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attaches a table that is an ungrouped aggregate, hence one row."""
    return df.crossJoin(F.broadcast(row))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.max("n")).first()[0] or 0)


def quantiles(df: DataFrame, column: str, qs: dict[str, float], keys: Sequence[str] = (), small: int = SMALL_GROUP) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``qs``.

    Groups up to ``small`` rows use the built-in exact percentile.  Larger ones are narrowed down by repeated
    1024-bin histograms around each wanted rank, so no task ever holds a large group.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(column).cast("double").alias("_v")).filter("_v is not null")
    if largest_group(data, keys) <= small:
        at_once = F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs.values()]))
        return data.groupBy(*keys).agg(at_once.alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(qs)])
    return _narrowed(data, qs, keys, small)


def column_quantiles(df: DataFrame, columns: Sequence[str], qs: dict[str, float], small: int = SMALL_GROUP) -> DataFrame:
    """One row with exact quantiles of many columns, ``<column><name>`` for every entry of ``qs``.

    One scan counts the values of all columns, a second one gives all quantiles; beyond ``small`` values columns are narrowed down
    together, as groups of one histogram table.
    """
    if not columns:
        return df.agg(F.lit(0).alias("_none"))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = data.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(counts, default=0) <= small:
        at_once = F.array(*[F.lit(float(q)) for q in qs.values()])
        row = data.agg(*[F.percentile(c, at_once).alias(c) for c in columns])
        return row.select(*[F.col(c)[i].alias(f"{c}{n}") for c in columns for i, n in enumerate(qs)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns]))
    found = quantiles(data.select(each.alias("_e")).select("_e.*"), "_value", qs, ["_column"], small)
    return found.agg(*[F.max(F.when(F.col("_column") == c, F.col(n))).alias(f"{c}{n}") for c in columns for n in qs])


def _narrowed(data: DataFrame, qs: dict[str, float], keys: list[str], small: int, bins: int = 1024) -> DataFrame:
    size = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(q)).alias("p")) for n, q in qs.items()]))
    goals = size.withColumn("_w", wanted).select(*keys, "_n", "_lo", "_hi", F.col("_w.q").alias("_q"), F.col("_w.p").alias("_p"))
    at = (F.col("_n") - 1) * F.col("_p")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.floor(at).alias("k")), F.struct(F.lit(1).alias("e"), F.ceil(at).alias("k"))))
    goals = goals.withColumn("_frac", at - F.floor(at)).withColumn("_e", ends)
    goals = goals.select(*keys, "_q", "_frac", F.col("_e.e").alias("_end"), F.col("_e.k").alias("_rank"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi")
    on = [*keys, "_q", "_end"]
    while True:  # the lowest and the highest value of a bracket always part, so brackets shrink until they fit
        inside = _candidates(data, goals, keys)
        width = (F.col("_hi") - F.col("_lo")) / bins
        far = F.when(F.col("_v") == float("-inf"), 0).when(F.col("_v") < 0, 1).when(F.col("_v") < float("inf"), 2).otherwise(3)
        cell = F.when(width == float("inf"), far).when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width))).otherwise((F.col("_v") > F.col("_lo")).cast("int"))
        hist = inside.groupBy(*on, "_frac", "_rank", "_below", cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*on).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_upto", F.col("_below") + F.sum("_c").over(upto))
        hit = (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank"))
        goals = hist.filter(hit).select(*on, "_frac", "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), "_lo", "_hi", "_c")
        goals = cut_lineage(goals)
        if int(goals.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_c")).otherwise(0))).first()[0] or 0) <= small:
            break
    counts = _candidates(data, goals.drop("_c"), keys).groupBy(*on, "_frac", "_rank", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(upto)).filter(F.col("_upto") > F.col("_rank"))
    found = found.groupBy(*on, "_frac").agg(F.min("_v").alias("_v"))
    low, high = F.max(F.when(F.col("_end") == 0, F.col("_v"))), F.max(F.when(F.col("_end") == 1, F.col("_v")))
    part = F.max("_frac")
    between = F.when((part == 0) | (low == high), low).when(high - low == float("inf"), low * (1 - part) + high * part).otherwise(low + (high - low) * part)
    found = found.groupBy(*keys, "_q").agg(between.alias("_v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, F.col("_v"))).alias(n) for n in qs])


def _candidates(data: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """Values that lie in a wanted bracket; the goal table has two rows per group and quantile."""
    right = goals.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    if not keys:
        right = F.broadcast(right)
    return data.join(right, cond).drop(*[f"_right_{k}" for k in keys])


def ordered_prefix(table: DataFrame, by: str, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = False,
                   bucket_rows: int = SMALL_GROUP) -> DataFrame:
    """Adds ``<sum>_upto`` (inclusive running total along ``by``) and ``<sum>_all`` (group total) to a table that has
    one row per (keys, by).

    Rows are bucketed on approximate quantiles of ``by`` so that a bucket holds about ``bucket_rows`` rows; bucket
    totals are scanned first and each bucket then on its own.
    """
    keys = list(keys)
    rows = table.count()
    pieces = -(-rows // bucket_rows)
    if pieces > 1:
        cuts = sorted(set(table.approxQuantile(by, [i / pieces for i in range(1, pieces)], 0.2 / pieces)))
        split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=by, outputCol="_bucket")
        table = split.transform(table)
    else:
        table = table.withColumn("_bucket", F.lit(0.0))
    along = F.desc(by) if descending else F.asc(by)
    bucket_order = F.desc("_bucket") if descending else F.asc("_bucket")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = table.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    totals = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(outer), F.lit(0)).alias(f"_b_{c}") for c in sums],
                           *[F.sum(f"_t_{c}").over(every).alias(f"{c}_all") for c in sums])
    local = table.withColumns({f"{c}_upto": F.sum(c).over(inner) for c in sums})
    out = null_safe_join(local, totals, [*keys, "_bucket"])
    return out.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_b_{c}") for c in sums}).drop("_bucket", *[f"_b_{c}" for c in sums])


def average_ranks(df: DataFrame, column: str, extra: dict[str, Column] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value that is not NULL: ``n`` (its count), ``rank`` (average rank) and running totals of ``extra`` counts."""
    extra = extra or {}
    table = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in extra.items()])
    table = ordered_prefix(table, column, ["n", *extra], keys)
    return table.withColumn("rank", F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2)
