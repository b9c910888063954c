"""Residuals kept as a table whose files hold ranges of slices, read back by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices of a range: what is read at least for one slice.
RANGE = 16
COLUMNS = ["volume", "z", "y", "x", "r", "g"]


def write_residuals(residuals: DataFrame, path: str, slices: int = RANGE, mode: str = "errorifexists") -> None:
    """residuals (volume, z, y, x, r, g) as Parquet folders volume=.../z_range=..., sorted within; a range of a volume is
    written by one task. Residual and gray value are kept as 16-bit numbers, the store's unit is written beside
    them as a column, so that a reader needs nothing else."""
    rows = residuals.select("volume", *[F.col(c).cast("int").alias(c) for c in "zyx"], F.col("r").cast("short").alias("r"), F.col("g").cast("short").alias("g"))
    rows = rows.withColumn("slices", F.lit(slices).cast("short")).withColumn("z_range", F.floor(F.col("z") / slices).cast("int"))
    rows.repartition("volume", "z_range").sortWithinPartitions("volume", "z_range", "z", "y", "x").write.partitionBy("volume", "z_range").mode(mode).parquet(path)


def read_residuals(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, volumes: list[str] | None = None, slices: int = RANGE) -> DataFrame:
    """(volume, z, y, x, r, g) of slices first to last (both included) of the named volumes, all by default. The range
    becomes a filter on z_range, a folder, so only its files are opened, and one on z, which prunes within them.
    slices: as written; another value is an error when rows are read, never a wrong result."""
    schema = "volume string, z int, y int, x int, r short, g short, slices short, z_range int"
    rows = spark.read.schema(schema).parquet(path)
    if first is not None:
        rows = rows.where((F.col("z_range") >= first // slices) & (F.col("z") >= first))
    if last is not None:
        rows = rows.where((F.col("z_range") <= last // slices) & (F.col("z") <= last))
    if volumes is not None:
        rows = rows.where(F.col("volume").isin(volumes))
    fits = F.when(F.col("slices") == slices, F.col("z")).otherwise(F.raise_error(F.lit(f"the store's ranges are not of {slices} slices")).cast("int"))
    return rows.select("volume", fits.alias("z"), "y", "x", F.col("r").cast("int").alias("r"), F.col("g").cast("int").alias("g"))
