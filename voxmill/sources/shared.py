"""Tables between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this process where that is unset and Spark runs in it, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="voxmill-"))
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint: later steps neither repeat its work nor depend on an executor that may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
