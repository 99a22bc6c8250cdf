"""Tables between the steps of an operator: written to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs in this process, as in tests, one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("voxmill.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="voxmill-")
        spark.conf.set("voxmill.work.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses; what is there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches that Python workers get, unless the session has a bound of its own.  By Spark's, of
    64 MB, a task's whole share of the texts stands in the executor's native memory, and in its worker once more."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table: later steps neither repeat its work nor depend on an executor that may be lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes cut tables that no later step reads."""
    for table in tables:
        where, files = _hadoop(table.sparkSession, table.cut_path)
        files.delete(where, True)
