"""Helpers the operators share: per-text Arrow functions, stored frames, union-find inside tasks and across the cluster."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import checkpoint_folder, cut_lineage

ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The frame written as a table of the shared checkpoint folder and read again: evaluated once, whatever executors are lost later."""
    at = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_function(start: Callable[[], Callable[[list[str]], list[dict]]], returns: str) -> Callable[[Column], Column]:
    """A column function from a text to a struct. ``start()`` runs once in each task and gives the function of a list of texts.

    A null text is the empty text. The function is marked non-deterministic so that Spark evaluates it once, however many of the
    struct's fields are used.
    """
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        work, arrow = start(), to_arrow_type(kind)
        for texts in batches:
            yield pa.array(work([t or "" for t in texts.to_pylist()]), arrow)

    udf = F.arrow_udf(run, kind).asNondeterministic()
    return lambda text: udf(F.coalesce(text, F.lit("")))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b), the smallest node of each node's component: min-label rounds with pointer jumping."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label = up


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the smallest node of the component.

    Alternating large-star and small-star rounds: each joins the edges with the least neighbour of every node, a map-side minimum,
    so that a hub's neighbours are never gathered and Spark may split a hub's rows. Lineage is cut after every round.
    """
    kind = dict(edges.dtypes)["a"]
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).union(
            e.join(least, "u").select("u", F.least("m", "u").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(now) == seen and now[0] == now[2]:
            break
        seen = tuple(now)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).select(
        F.col("node").cast(kind).alias("node"), F.col("root").cast(kind).alias("root"))
