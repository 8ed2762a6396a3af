"""Reliable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where that is absent and one process runs all, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="logloom-")
        context.setCheckpointDir(found)
    return found


def settle(frame: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, for results that several branches of a plan read."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
