"""The folder that driver and executors share, and lineage that is cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where none is set, in local mode only (elsewhere executors would not see it)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, with its lineage cut there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
