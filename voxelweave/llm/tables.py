"""What the text kernels need of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from voxelweave.functions.storage import checked_broadcast, dropped, is_small
from voxelweave.functions.storage import cut as stored
from voxelweave.shipping import ship

__all__ = ["checked_broadcast", "dropped", "is_small", "small_batches", "stored"]


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Arrow batches of few rows and few bytes, so that a Python worker holds a few MB of text at a time;
    the workers also get this package. Every operator with a kernel calls this first."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
