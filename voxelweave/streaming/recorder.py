"""Batch-incremental recording: new files only, idempotent per batch, runs written last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions.storage import scratch


def record(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process what is new and stop. Each batch goes to out/data/batch=N, overwritten if the batch is
    retried, and its marker to out/runs/batch=N last; readers see only marked batches."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        batch.sparkSession.range(1).select(F.lit(number).alias("done")).write.mode("overwrite").parquet(f"{out}/runs/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Rows of all batches that have a marker."""
    data = spark.read.schema(schema + ", batch int").option("basePath", f"{out}/data").parquet(f"{out}/data")
    runs = spark.read.schema("done int, batch int").option("basePath", f"{out}/runs").parquet(f"{out}/runs")
    return data.join(F.broadcast(runs.select("batch").distinct()), "batch", "left_semi").drop("batch")


def recorded_totals(spark: SparkSession, folder: str, shards: int = 8) -> DataFrame:
    """(shard, n, total) of events read as a stream and recorded in partial sums."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    base = f"{scratch(spark)}/record-{uuid.uuid4().hex}"
    part = lambda b: b.groupBy((F.col("user_id") % shards).alias("shard")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    record(stream, part, f"{base}/out", f"{base}/checkpoint")
    return committed(spark, f"{base}/out", "shard long, n long, total double").groupBy("shard").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Event-time counts and sums by type; rows later than `late` behind the watermark are dropped, as
    a stream must to end its windows."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
