"""Time-series anomaly analytics as Spark DataFrame operators."""

from .plans.features import Feature, with_features
from .plans.series import SeriesSpec, index_rows, lay_out

__all__ = ["Feature", "SeriesSpec", "index_rows", "lay_out", "with_features"]
