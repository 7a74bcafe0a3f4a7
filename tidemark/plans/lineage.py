"""Shared folder for checkpoints, and cutting the lineage of iterative jobs with them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` (or already set on the context).

    Only a local session without one gets a temporary folder; a cluster must name a folder all executors share.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the frame to the checkpoint folder and goes on from there; survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
