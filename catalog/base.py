"""Shared table views, series specs and helpers of the query catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import SeriesSpec, with_features


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor view of the event stream: series ``s``, value ``x``, a roughly 10% label."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("s"), "ts", "event_id", "user_id", F.col("value").alias("x"),
        F.when(k >= 90, 1).otherwise(0).alias("label"), k.alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))


EV = """ev AS (SELECT event_type AS s, ts, event_id, user_id, value AS x,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 90 THEN 1 ELSE 0 END AS label,
  CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""

BY_TYPE = SeriesSpec(("s",), "ts", ("event_id",), "x", "label")
BY_USER = SeriesSpec(("user_id",), "ts", ("event_id",), "x", "label")
ALL = SeriesSpec((), "ts", ("event_id",), "x", "label")

ORD = "PARTITION BY s ORDER BY ts, event_id"
ORD_USER = "PARTITION BY user_id ORDER BY ts, event_id"
ORD_ALL = "ORDER BY ts, event_id"


def over(w: int, order: str = ORD, name: str | None = None) -> str:
    """Named window of the last ``w`` rows."""
    return f"{name or f'w{w}'} AS ({order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def r(expr: str | Column, digits: int | None = 6):
    """The same rounding on both sides; adding 0.0 turns a negative zero into zero.

    ``digits=None`` leaves the value alone, for results that both engines compute exactly.
    """
    if digits is None:
        return expr
    if isinstance(expr, str):
        return f"(round({expr}, {digits}) + 0.0)"
    return F.round(expr, digits)


def rounded(df: DataFrame, keep: list[str], values: list[str], ints: list[str] = (), digits: int | None = 6) -> DataFrame:
    return df.select(*keep, *[r(F.col(c).cast("double"), digits).alias(c) for c in values],
                     *[F.col(c).cast("long").alias(c) for c in ints])


def window_query(name: str, features, values: dict[str, str], windows: list[str], ints: dict[str, str] | None = None,
                 spec: SeriesSpec = BY_TYPE, source: str = "ev", ctes: str = EV, digits: int | None = 6):
    """Registers a feature query (``features()`` builds it) on the event series together with its SQL over named windows."""
    ints = ints or {}
    cols = [f"{r(e, digits)} AS {n}" for n, e in values.items()] + [f"CAST({e} AS BIGINT) AS {n}" for n, e in ints.items()]
    clause = f" WINDOW {', '.join(windows)}" if windows else ""
    sql = f"WITH {ctes} SELECT event_id, {', '.join(cols)} FROM {source}{clause}"

    @query(name, sql)
    def run(spark, sf):
        df = with_features(events(spark, sf), spec, features())
        return rounded(df, ["event_id"], list(values), list(ints), digits)

    return run


def at_least(m: int, w: str, expr: str) -> str:
    return f"CASE WHEN count(x) OVER {w} >= {m} THEN {expr} END"
