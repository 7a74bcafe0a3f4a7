"""Reading, aligning and writing sensor tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.series import SeriesSpec, index_rows

# Column names of the production export and of the labelled tables.
PRODUCTION_TIME, PRODUCTION_VALUE = "Time_stamp", "A2:MCPGSpeed"
LABELLED_SCHEMA = T.StructType([T.StructField("indo_time", T.TimestampNTZType()), T.StructField("speed", T.DoubleType()),
                                T.StructField("pred_label", T.IntegerType())])


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, columns: Sequence[str] | None = None,
             origin: str | None = None) -> DataFrame:
    """CSV with a header and an explicit schema; several paths are one scan, ``origin`` adds the file name."""
    df = spark.read.schema(schema).option("header", True).csv(list(paths) if not isinstance(paths, str) else paths)
    if origin:
        df = df.withColumn(origin, F.input_file_name())
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def first_present(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """Renames the first of the alternative column names that exists."""
    for name in names:
        if name in df.columns:
            return df.withColumnRenamed(name, out)
    raise ValueError(f"none of {list(names)} in {df.columns}")


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def position_slice(df: DataFrame, spec: SeriesSpec, start: int, stop: int) -> DataFrame:
    """Rows with ``start <= position < stop`` of every series."""
    return index_rows(df, spec).filter((F.col("idx") >= start) & (F.col("idx") < stop))


def synthetic_clock(df: DataFrame, spec: SeriesSpec, start: str, out: str = "time_value") -> DataFrame:
    """One second per row from ``start``, along the series order."""
    at = F.expr(f"TIMESTAMP_NTZ'{start}'")
    return index_rows(df, spec).withColumn(out, at + F.make_dt_interval(secs=F.col("idx").cast("decimal(18,6)")))


def align_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the wanted features in their order; missing ones become 0."""
    return df.select(*keep, *[F.col(f"`{c}`") if c in df.columns else F.lit(0.0).alias(c) for c in wanted])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A short summary table as JSON lines."""
    df.write.mode("overwrite").json(path)


def replay(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """Streaming source that replays stored files a few per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
