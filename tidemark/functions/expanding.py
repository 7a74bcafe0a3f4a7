"""Quantiles of everything seen so far (expanding windows)."""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.features import Feature
from ..plans.lineage import cut_lineage
from ..plans.series import CHUNK, Laid, null_safe_join

BINS = 256


def expanding_quantile(col: str, q: float, m: int = 1) -> Feature:
    """Linear-interpolated quantile of all values up to the row, NULL before ``m`` values."""
    return Feature(ExpandingQuantile(col, q, m), (col,), kind="frame")


@dataclass(frozen=True)
class ExpandingQuantile:
    col: str
    q: float
    m: int

    @staticmethod
    def all(laid: Laid, builds: "dict[str, ExpandingQuantile]") -> Laid:
        """All quantiles of a level in one pass over the rows; what a chunk needs of earlier ones is told apart by the feature's name."""
        order, schema = laid.order, T.StructType([*laid.df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in builds]])
        if not laid.is_chunked:
            def whole(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(order, kind="stable")
                return pdf.assign(**{n: pdf[b.col].expanding(min_periods=b.m).quantile(b.q) for n, b in builds.items()})

            return laid.with_df(laid.df.groupBy(*laid.part).applyInPandas(whole, schema))

        def per_chunk(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order, kind="stable")
            own = (rows["_chunk"] == rows["_home"]).to_numpy()
            done = {n: b.along(rows[b.col].to_numpy(dtype=float, na_value=np.nan), own, before[before["_of"] == n]) for n, b in builds.items()}
            return rows.assign(**done)

        parts = [_relevant_earlier_values(laid, b.col, b.q).withColumn("_of", F.lit(n)) for n, b in builds.items()]
        earlier = reduce(DataFrame.unionByName, parts)
        earlier = earlier.withColumnsRenamed({c: f"_of_{c}" for c in laid.part})  # both sides come from the same rows
        grouped = laid.df.groupBy(*laid.part).cogroup(earlier.groupBy(*[f"_of_{c}" for c in laid.part]))
        return laid.with_df(grouped.applyInPandas(per_chunk, schema))

    def along(self, values: np.ndarray, own: np.ndarray, before: pd.DataFrame) -> np.ndarray:
        """The quantile at each own row of a chunk."""
        below = int(before["_below"].iloc[0]) if len(before) else 0
        seen = int(before["_before"].iloc[0]) if len(before) else 0
        known = np.repeat(before["_v"].to_numpy(), before["_c"].to_numpy()) if len(before) else np.array([])
        known = np.sort(known[~np.isnan(known)]).tolist()
        out = np.full(len(values), np.nan)
        for i, v in enumerate(values.tolist()):
            if not own[i]:
                continue
            if v == v:
                insort(known, v)
                seen += 1
            if seen >= self.m:
                at = self.q * (seen - 1)
                lo = int(at) - below
                hi = min(lo + 1, len(known) - 1) if at > int(at) else lo
                out[i] = known[lo] + (known[hi] - known[lo]) * (at - int(at))
        return out


def _relevant_earlier_values(laid: Laid, col: str, q: float) -> DataFrame:
    """Per chunk, the earlier values whose rank can still become the quantile while the chunk is read.

    A chunk of R rows moves the wanted rank among the earlier values by at most R, so a band of about 2R ranks is enough.
    Counts per value bin, summed over earlier chunks, tell which bins the band touches and how many values lie below it.
    """
    keys = list(laid.spec.keys)
    own = laid.df.filter(laid.own).filter(F.col(col).isNotNull()).select(*keys, CHUNK, F.col(col).cast("double").alias("_v"))
    cuts = sorted(set(own.approxQuantile("_v", [i / BINS for i in range(1, BINS)], 0.2 / BINS)))
    own = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_v", outputCol="_b").transform(own)
    own = cut_lineage(own.groupBy(*keys, CHUNK, F.col("_b").cast("int").alias("_b"), "_v").agg(F.count(F.lit(1)).alias("_c")))
    in_bin = own.groupBy(*keys, CHUNK, "_b").agg(F.sum("_c").alias("_n"))
    sizes = in_bin.groupBy(*keys, CHUNK).agg(F.sum("_n").alias("_size"))
    grid = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
    grid = null_safe_join(grid, in_bin, [*keys, CHUNK, "_b"]).fillna(0, ["_n"])
    past = Window.partitionBy(*keys, "_b").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_p", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    along = Window.partitionBy(*keys, CHUNK)
    grid = grid.withColumn("_end", F.sum("_p").over(along.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.sum("_p").over(along))
    lowest = F.floor(q * F.col("_before")) - F.col("_size") - 1
    highest = F.ceil(q * (F.col("_before") + F.col("_size"))) + 1
    band = grid.filter((F.col("_p") > 0) & (F.col("_end") > lowest) & (F.col("_end") - F.col("_p") <= highest))
    band = band.withColumn("_below", F.min(F.col("_end") - F.col("_p")).over(along)).select(*keys, F.col(CHUNK).alias("_later"), "_b", "_below", "_before")
    values = null_safe_join(own, band, [*keys, "_b"], "inner").filter(F.col(CHUNK) < F.col("_later"))
    return values.groupBy(*keys, F.col("_later").alias(CHUNK), "_below", "_before", "_v").agg(F.sum("_c").alias("_c"))
