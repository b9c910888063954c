"""Readers of the tables, and their views as candidates, voxels, profiles and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The review code that stands for each order status.
STATUS_LABEL = {"F": 0, "O": 1, "P": 4}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def label_of(status: str = "o_orderstatus"):
    out = None
    for s, code in STATUS_LABEL.items():
        out = F.when(F.col(status) == s, code) if out is None else out.when(F.col(status) == s, code)
    return out.cast("int")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate_id, volume, label, experiment) from orders."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("volume"), label_of().alias("label"), F.col("o_custkey").alias("experiment")
    )


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate_id, volume, y, x): grown voxels from returned line items; a candidate hits a voxel
    once however many of its lines say so."""
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"))
    volumes = candidates(spark, folder).select("candidate_id", "volume")
    return lines.join(volumes, "candidate_id").select("candidate_id", "volume", "y", "x").distinct()


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate_id, p, y, w, slab): probability, outcome and weight of each line item."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), F.round(F.col("l_discount") * 10, 6).alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.col("l_quantity").alias("w"), F.col("l_linestatus").alias("slab"),
    )


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, ts, event_id, value): a series of values per user."""
    return table(spark, folder, "events").select("user_id", "ts", "event_id", "value")


#: Parts of a voxel volume, and slices, rows and columns that a volume may have.
PARTS, SLICES, EDGE = 2000, 128, 24


def cube(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, z, y, x, v, id): voxel volumes binned from line items, so that their number grows with the
    table: a volume is a return flag and a range of PARTS part numbers, z six weeks of shipping, y the
    place in the range, x the supplier."""
    t = table(spark, folder, "lineitem")
    block = F.floor(F.col("l_partkey") / PARTS).cast("long")
    v = t.select(
        F.concat_ws("-", "l_returnflag", block).alias("volume"), (block * 32 + F.ascii("l_returnflag") - 64).cast("long").alias("number"),
        F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")) / 42).cast("long").alias("z"),
        F.floor(F.col("l_partkey") % PARTS / 84).cast("long").alias("y"), (F.col("l_suppkey") % EDGE).alias("x"), F.col("l_quantity").alias("q"),
    ).groupBy("volume", "number", "z", "y", "x").agg(F.sum("q").cast("long").cast("double").alias("v"))
    code = ((F.col("number") * SLICES + F.col("z")) * EDGE + F.col("y")) * EDGE + F.col("x")
    return v.select("volume", "z", "y", "x", "v", code.cast("long").alias("id"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(volume, z, y, x, g): the same volumes binned more coarsely, nearly all of their voxels filled, with a mean
    measure as an 8-bit gray value. Volumes grow in number with the table."""
    t = table(spark, folder, "lineitem")
    block = F.floor(F.col("l_partkey") / PARTS).cast("long")
    v = t.select(
        F.concat_ws("-", "l_returnflag", block).alias("volume"), F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")) / 42).cast("long").alias("z"),
        F.floor(F.col("l_partkey") % PARTS / 250).cast("long").alias("y"), (F.col("l_suppkey") % 8).alias("x"), F.col("l_quantity").alias("q"),
    )
    g = v.groupBy("volume", "z", "y", "x").agg(F.sum("q").cast("long").alias("s"), F.count("*").alias("n"))
    return g.select("volume", "z", "y", "x", F.expr("5 * s div n").alias("g"))
