"""The whole feature row of every candidate, from its voxels and their surroundings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxelweave.functions.storage import cut
from voxelweave.operators import contours, residual
from voxelweave.operators.volume import labelled, surface_ratio

AXES = ["z", "y", "x"]
PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]


def _shapes(objects: DataFrame, high: float) -> DataFrame:
    """Sizes, box, weighted centre, peak and moments of every object in one grouping."""
    seed = F.col("snr") >= high
    order = F.struct("r", *[-F.col(c) for c in AXES])
    return objects.groupBy("volume", "component").agg(
        F.count("*").alias("n_voxels"), F.count_if(seed).alias("n_seed_total"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.max("g").alias("gs_peak"),
        *[(F.max(c) - F.min(c) + 1).alias(f"{c}_extent") for c in AXES], *[(F.sum(F.col("r") * F.col(c)) / F.sum("r")).alias(f"centroid_{c}") for c in AXES],
        (F.sum("snr") / F.sqrt(F.count("*"))).alias("snr_cluster"), F.max("r").cast("double").alias("r_peak"), (F.max("r") / F.avg("r")).alias("r_peak_ratio"), F.max("snr").alias("snr_peak"),
        (F.sum(F.when(seed, F.col("r")).otherwise(0)) / F.sum("r")).alias("seed_grown_ratio"), F.max_by(F.struct(*AXES), order).alias("top"),
        *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in PAIRS],
    )


#: What _axes adds.
LEANINGS = ("l1", "l2", "l3", "linearity", "planarity", "sphericity", "axis_z", "normal_z")


def _axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Principal values and axes of many objects at once, beside what they have; every voxel is a cube with a spread of its own."""
    for t in batches:
        m = np.zeros((t.num_rows, 3, 3))
        for a, b in PAIRS:
            i, j = AXES.index(a), AXES.index(b)
            m[:, i, j] = m[:, j, i] = t.column(f"c{a}{b}").to_numpy(zero_copy_only=False) + (1 / 12 if a == b else 0)
        values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
        l3, l2, l1 = values.T
        found = (l1, l2, l3, (l1 - l2) / l1, (l2 - l3) / l1, l3 / l1, np.abs(vectors[:, 0, 2]), np.abs(vectors[:, 0, 0]))
        yield pa.RecordBatch.from_arrays([*t.columns, *map(pa.array, found)], [*t.schema.names, *LEANINGS])


def _seed_parts(objects: DataFrame, high: float, key: str, middle: DataFrame) -> DataFrame:
    """(component, n_seed, n_seed_regions, seed_offset): the largest connected part above `high`, their number, and how
    far the weighted centre of one lies from the object's at most."""
    seeds = objects.where(F.col("snr") >= high).withColumnRenamed("component", "object")
    parts = labelled(seeds, ["volume"], AXES, key)
    mid = parts.groupBy("object", "component").agg(F.count("*").alias("n"), *[(F.sum(F.col("r") * F.col(c)) / F.sum("r")).alias(f"p{c}") for c in AXES])
    mid = mid.drop("component").withColumnRenamed("object", "component").join(middle.hint("merge"), "component")
    far = sum((F.pow(F.col(f"p{c}") - F.col(f"centroid_{c}"), 2) for c in AXES[1:]), F.pow(F.col("pz") - F.col("centroid_z"), 2))
    return mid.groupBy("component").agg(F.max("n").alias("n_seed"), F.count("*").alias("n_seed_regions"), F.max(F.sqrt(far)).alias("seed_offset"))


def candidate_rows(voxels: DataFrame, objects: DataFrame, key: str, high: float, metal: float, size: tuple[int, int], circles: DataFrame | None = None, slab: int = 64) -> DataFrame:
    """One row per object with all features: sizes, box, centre and peak, signal, seeds, principal axes, shells, gray
    values, surface and radial position.

    voxels: (volume, z, y, x, key, g, r, snr), written; objects: those of them that belong to one, with component. Sums
    are grouped once; seeds, surfaces and the ranked values around come from groupings of their own and are joined by
    component, so no object has to fit in a task, and a table that grows with the objects is broadcast up to a counted
    number of rows only. radial_pos is by the radius of the slab's circle; without circles, or where the slab has
    none, the distance from the middle of an image of `size`. Missing shells give nulls.
    """
    shapes = _shapes(objects, high)
    shapes = cut(shapes.mapInArrow(_axes, StructType([*shapes.schema.fields, *[StructField(c, DoubleType()) for c in LEANINGS]])), "shapes")
    seeds = _seed_parts(objects, high, key, shapes.select("component", *[f"centroid_{c}" for c in AXES]))
    out = shapes.join(seeds.hint("merge"), "component", "left").join(residual.surroundings(voxels, objects, key, metal).hint("merge"), "component", "left")
    out = out.join(surface_ratio(objects, ["volume"], AXES, key).withColumnRenamed("surface", "surface_ratio").hint("merge"), "component", "left")
    n = F.col("n_voxels")
    ellipsoid = 4 * math.pi * 3**1.5 * F.sqrt(F.col("l1") * F.col("l2") * F.col("l3"))
    out = out.withColumns({
        "fill": n / (F.col("z_extent") * F.col("y_extent") * F.col("x_extent")), "fill_pca": F.when((F.col("l2") > 0) & (F.col("l3") > 0), n / ellipsoid),
        "diag": 2 * F.sqrt(3 * F.col("l1")) / F.greatest(*[F.col(f"{c}_extent") for c in AXES]), "metal_threshold": F.lit(float(metal)),
        "peak_offset": F.sqrt(sum((F.pow(F.col(f"top.{c}") - F.col(f"centroid_{c}"), 2) for c in AXES[1:]), F.pow(F.col("top.z") - F.col("centroid_z"), 2))),
    }).withColumns({f"peak_{c}": F.col(f"top.{c}") for c in AXES})
    out = out.drop("top", *[f"c{a}{b}" for a, b in PAIRS])
    far = F.sqrt(F.pow(F.col("centroid_y") - size[0] / 2, 2) + F.pow(F.col("centroid_x") - size[1] / 2, 2))
    if circles is None:
        return out.withColumn("radial_pos", far)
    return contours.radial_position(out, circles, slab).withColumn("radial_pos", F.coalesce("radial_pos", far))
