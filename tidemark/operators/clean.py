"""Cleaning: duplicates, missing values, infinities, clipping, splits by predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, finite
from ..plans.features import Feature, scalar, with_features
from ..plans.series import SeriesSpec
from ..plans.stats import column_quantiles, one_row


def average_duplicates(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """One row per (keys, ts) with the mean of each column."""
    return df.groupBy(*spec.keys, spec.ts).agg(*[F.avg(c).alias(c) for c in columns])


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def fill_mean(df: DataFrame, columns: Sequence[str], train=None) -> DataFrame:
    """NULL to the column mean; ``train`` (a condition) restricts the rows the mean is taken from."""
    known = df if train is None else df.filter(train)
    means = known.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return one_row(df, means).withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in columns}).drop(*means.columns)


def fill_median(df: DataFrame, columns: Sequence[str], train=None) -> DataFrame:
    """NULL to the exact median of the training rows."""
    medians = column_quantiles(df if train is None else df.filter(train), columns, {"_median": 0.5})
    return one_row(df, medians).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_median")) for c in columns}).drop(*medians.columns)


FILLED_ALONG = "filled_along_"


def filled_along(columns: Sequence[str], backward: bool = True, rest: float | None = None) -> dict[str, Feature]:
    """Each column under a prefixed name, the last known value carried forward, then (optionally) the next one backward, then a constant.

    A chunk's own rows alone are carried, as features that read carried ones are right on these only.
    """
    def own(c: str, kind: str) -> Feature:
        return Feature(lambda laid: F.when(laid.own, F.col(c)), (c,), kind=kind, non_causal=kind == "next")

    f: dict[str, Feature] = {}
    for c in columns:
        parts = {f"_ahead_{c}": own(c, "last")} | ({f"_behind_{c}": own(c, "next")} if backward else {})
        tail = [] if rest is None else [F.lit(rest)]
        f |= parts | {FILLED_ALONG + c: scalar(F.coalesce(*[F.col(p) for p in parts], *tail), *parts)}
    return f


def fill_along(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], backward: bool = True, rest: float | None = None) -> DataFrame:
    """Carries the last known value forward, then (optionally) the next one backward, then a constant."""
    wide = with_features(df, spec, filled_along(columns, backward, rest))
    return wide.select(*[F.col(FILLED_ALONG + c if c in columns else c).alias(c) for c in df.columns])


def null_infinities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.001, high: float = 0.999, train=None) -> DataFrame:
    """Clips to exact quantiles of the training rows."""
    bounds = column_quantiles(df if train is None else df.filter(train), columns, {"_low": low, "_high": high})
    kept = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}_low")), F.col(f"{c}_high"))) for c in columns}
    return one_row(df, bounds).withColumns(kept).drop(*bounds.columns)


def clip_columns(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), low, high) for c in columns})


def trim_warm_up(df: DataFrame, rows: int, index: str = "idx") -> DataFrame:
    return df.filter(F.col(index) >= rows)


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """All columns but the excluded ones, in frame order."""
    return [c for c in df.columns if c not in set(excluded)]
