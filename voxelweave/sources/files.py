"""Scans of configuration, CSV and annotation files."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "name string, z_min int, z_max int, voxel_size double, form_factor string, nominal_diameter_mm double, nominal_height_mm double, voxels_x int, voxels_y int"


def _dimension(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Small dimension tables of a TOML file's [[cell]] and [[experiment]] entries, read through Spark
    so that the file may lie in any store."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    got = tomllib.loads(text)
    keys = sorted({k for r in got.get("experiment", []) for k in r})
    kinds = {bool: "boolean", int: "long", float: "double", str: "string", list: "array<long>"}
    first = {k: next(r[k] for r in got.get("experiment", []) if k in r) for k in keys}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in first.items()) or "experiment_number long"
    return {"cells": _dimension(spark, got.get("cell", []), CELLS), "experiments": _dimension(spark, got.get("experiment", []), schema)}


def csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """A CSV file with header by explicit schema; `lists` are string columns like [1.0, 2.5] or
    (1.0, 2.5) that become arrays of doubles. A list that cannot be read is null."""
    df = spark.read.schema(schema).csv(path, header=True)
    for c in lists:
        df = df.withColumn(c, F.from_json(F.translate(F.col(c), "()", "[]"), "array<double>"))
    return df.select(*(only or df.columns))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, points) of nested annotations: every outline of at least three points."""
    schema = "annotations array<struct<polygon: struct<paths: array<array<struct<x: double, y: double>>>>>>"
    a = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.explode("annotations").alias("a"))
    p = a.select("file", F.posexplode("a.polygon.paths").alias("path", "points"))
    return p.where(F.size("points") >= 3)


def boxes(outlines: DataFrame, margin: int = 4) -> DataFrame:
    """Integer bounding boxes of outlines, widened by margin."""
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return outlines.select(
        "file", "path", (F.floor(F.array_min(x)) - margin).alias("x0"), (F.ceil(F.array_max(x)) + margin).alias("x1"), (F.floor(F.array_min(y)) - margin).alias("y0"), (F.ceil(F.array_max(y)) + margin).alias("y1")
    )


def fixed(rows: DataFrame, decimals: int = 4) -> DataFrame:
    """rows with every fraction as a string of so many decimals, as tables for people have them; null stays null."""
    fraction = {f.name for f in rows.schema if f.dataType.simpleString() in ("float", "double")}
    return rows.select(*[F.format_string(f"%.{decimals}f", F.col(f"`{c}`").cast("double")).alias(c) if c in fraction else F.col(f"`{c}`") for c in rows.columns])


def append_csv(rows: DataFrame, path: str, keys: list[str], decimals: int = 4, replace: bool = True) -> None:
    """Add rows to a folder of CSV files, one subfolder for each value of keys; what is there for those values is
    replaced, so a run that is repeated leaves no row twice, or with replace=False stays beside the new rows. Each file has a header. Missing fractions stay empty."""
    missing = [F.when(F.col(f"`{c}`") != "null", F.col(f"`{c}`")).alias(c) if c not in keys else F.col(f"`{c}`") for c in rows.columns]
    out = fixed(rows, decimals).select(*[F.col(f"`{c}`").cast("string").alias(c) if c not in keys else F.col(f"`{c}`") for c in rows.columns]).select(*missing)
    out.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(*keys).csv(path)


def new_only(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the log lacks: what a resumed recording still has to add."""
    return rows.join(log.select(*keys).distinct(), keys, "left_anti")
