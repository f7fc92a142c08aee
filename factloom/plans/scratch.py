"""Tables in the shared folder, to cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session names none (tests), a temporary folder, set once.

    On a cluster a folder of one machine would be lost to the others, so the setting must be there.
    """
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(CHECKPOINT, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; leftovers are only disk
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, not a re-run of
    what made the table.  Parquet also takes less disk than a checkpoint.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts in one batch handed to a worker; the default of 10,000 long texts would not fit.
BATCH_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lower the number of rows of a batch to ``BATCH_ROWS``, unless it is lower already."""
    if not 0 < int(spark.conf.get(ARROW_ROWS, "10000")) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
