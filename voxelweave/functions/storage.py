"""Scratch tables on storage that all executors share, and joins whose broadcast side is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table that may be broadcast (16 bytes each in a hashed relation: tens of MB).
BROADCAST_ROWS = 500_000
#: The same where several such tables are in one plan, all of which the driver holds at once.
LIGHT_ROWS = 100_000
FOLDER = "voxelweave"

_own: str | None = None


def scratch(spark: SparkSession) -> str:
    """Our folder in the one that spark.checkpoint.dir names. Only a local session without that
    setting (tests) gets a temporary folder; on a cluster it must be set."""
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="spark-")
        shared = _own
    return f"{shared.rstrip('/')}/{FOLDER}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to scratch and read back: ends its lineage and survives the loss of
    any executor."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the scratch files behind tables made by cut() that are read no more; others stay."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{FOLDER}/" in parent:
                path = spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df has at most `rows` rows; stops counting just beyond."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size has been checked, else df (a shuffled join follows)."""
    return F.broadcast(df) if is_small(df, rows) else df


def light_broadcast(df: DataFrame, rows: int = LIGHT_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else with one for a merge join: Spark goes by the size of
    compressed files and might broadcast it after all."""
    return F.broadcast(df) if is_small(df, rows) else df.hint("merge")
