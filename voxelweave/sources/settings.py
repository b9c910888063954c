"""Settings of cells, experiments and sweeps: typed columns with their physical conversions, and values from a command line."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, fields, replace
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.operators.relational import grid
from voxelweave.sources.store import SCHEMAS


def accessors(cells: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row a cell and experiment, with what both together say in voxels: z_extent_max, the axial limit rounded up to whole
    slices; diameter and height of the cell in voxels, rounded; small_z_low and small_z_high. Bounds that are
    not two numbers raise an error when they are read. Both tables come from one configuration file."""
    bounds = F.col("small_z_bounds")
    two = F.when(F.size(bounds) == 2, bounds).otherwise(F.raise_error(F.concat(F.lit("small_z_bounds must hold two numbers, not "), F.coalesce(bounds.cast("string"), F.lit("null")))).cast("array<long>"))
    pairs = cells.crossJoin(F.broadcast(experiments))
    return pairs.select(
        *[f"`{c}`" for c in pairs.columns], F.ceil(F.col("max_axial_extent_mm") / F.col("voxel_size")).cast("int").alias("z_extent_max"),
        F.bround(F.col("nominal_diameter_mm") / F.col("voxel_size"), 0).cast("int").alias("diameter"), F.bround(F.col("nominal_height_mm") / F.col("voxel_size"), 0).cast("int").alias("height"),
        two[0].alias("small_z_low"), two[1].alias("small_z_high"),
    )


def experiment_rows(experiments: DataFrame, numbers: DataFrame, min_fill: float, enforce_shape_gates: bool) -> DataFrame:
    """Rows of the store's experiments table for the entries of a configuration; numbers gives (experiment_number,
    experiment_id). The two arguments replace what an entry says; other columns must be there, else an error."""
    kinds = dict(f.split() for f in SCHEMAS["experiments"].split(", "))
    given = {"min_fill": F.lit(float(min_fill)), "enforce_shape_gates": F.lit(bool(enforce_shape_gates))}
    missing = [c for c in kinds if c not in experiments.columns and c not in given and c != "experiment_id"]
    if missing:
        raise ValueError(f"experiment entries lack {', '.join(missing)}")
    t = experiments.drop("experiment_id").join(F.broadcast(numbers), "experiment_number")
    return t.select(*[given.get(c, F.col(c)).cast(kind).alias(c) for c, kind in kinds.items()])


@dataclass(frozen=True)
class Sweep:
    """Axes of a sweep over noise, size, strength, resampling and rotation; a tuple is an axis, one value is the same for all."""

    noise_seeds: tuple[int, ...] = (-1, 10, 11, 12, 13, 14)
    bit_depths: tuple[int, ...] = (8, 16)
    particle_sigmas: tuple[float, ...] = (0.5,)
    amplitude_snrs: tuple[float, ...] = (10.0,)
    interpolation_orders: tuple[int, ...] = (1, 3, 5)
    theta_angles_deg: tuple[float, ...] = (0.0, 0.1, 1.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0)
    phi_angles_deg: tuple[float, ...] = (0.0, 0.1, 0.2, 1.0, 5.0)
    measurement_top_k: int = 7
    voxels_z: int = 1024
    voxels_xy: int = 1024

    def conditions(self, spark: SparkSession) -> DataFrame:
        """Every combination of the axes, with the values common to all."""
        axes = {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), tuple)}
        common = {f.name: F.lit(getattr(self, f.name)) for f in fields(self) if f.name not in axes}
        return grid(spark, **axes).withColumns(common)


def from_arguments(defaults: Any, arguments: list[str]) -> tuple[Any, argparse.Namespace]:
    """A copy of defaults, a frozen dataclass, with the values that arguments give, and the switches --dry-run and --reset-output.
    Each field is an option of its type; a tuple takes one value or more. What isn't given stays as it is."""
    parser = argparse.ArgumentParser()
    kinds = get_type_hints(type(defaults))
    for f in fields(defaults):
        kind, many = kinds[f.name], isinstance(getattr(defaults, f.name), tuple)
        parser.add_argument("--" + f.name.replace("_", "-"), type=kind.__args__[0] if many else kind, nargs="+" if many else None, default=MISSING)
    for switch in ("--dry-run", "--reset-output"):
        parser.add_argument(switch, action="store_true")
    got = parser.parse_args(arguments)
    given = {f.name: v for f in fields(defaults) if (v := getattr(got, f.name)) is not MISSING}
    return replace(defaults, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}), got
