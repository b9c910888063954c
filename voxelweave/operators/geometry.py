"""Rotation of volumes, boxes of what it needs, outlines as coverage of pixels."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ["z", "y", "x"]


def plane_rotation(degrees: float, axes: tuple[int, int]) -> np.ndarray:
    """3 x 3 matrix that takes an output position, relative to the centre, to the input position of a volume that is
    turned by so many degrees in the plane of two axes."""
    m = np.eye(3)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    a, b = axes
    m[a, a], m[a, b], m[b, a], m[b, b] = c, s, -s, c
    return m


def about_centre(matrix: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Offset with which a matrix turns about the middle of a volume."""
    centre = (np.array(shape) - 1) / 2
    return centre - matrix @ centre


def input_box(matrix: np.ndarray, offset: np.ndarray, low: list[int], high: list[int], shape: tuple[int, int, int], halo: int = 2) -> list[tuple[int, int]]:
    """Half-open input ranges that an output box [low, high) reads: its corners carried back, widened by halo, clipped
    to the volume."""
    corners = np.array(list(itertools.product(*[(a, b - 1) for a, b in zip(low, high)])))
    at = corners @ matrix.T + offset
    first, last = np.floor(at.min(axis=0)).astype(int) - halo, np.ceil(at.max(axis=0)).astype(int) + 1 + halo
    return [(max(0, int(a)), min(n, int(b))) for a, b, n in zip(first, last, shape)]


def chunk_size(shape: tuple[int, int, int], itemsize: int, axis: int, budget: int) -> int:
    """Planes across axis that fit in so many bytes, one at least."""
    plane = itemsize * math.prod(n for i, n in enumerate(shape) if i != axis)
    return max(1, budget // plane)


def resampled(voxels: DataFrame, keys: list[str], value: str, matrix: np.ndarray, offset: np.ndarray) -> DataFrame:
    """voxels' positions with the value that an affine map reads there, interpolated linearly between the eight voxels
    around; what is missing counts as 0. Each input voxel is read by position in one join."""
    at = [sum((float(matrix[i, j]) * F.col(c) for j, c in enumerate(AXES[1:], 1)), float(matrix[i, 0]) * F.col("z") + float(offset[i])) for i in range(3)]
    at = [F.round(a, 9) for a in at]  # so that a whole position stays one
    base = voxels.select(*keys, *AXES, *[F.floor(a).cast("long").alias(f"_f{c}") for a, c in zip(at, AXES)], *[(a - F.floor(a)).alias(f"_r{c}") for a, c in zip(at, AXES)])
    corner = F.explode(F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(step, AXES)]) for step in itertools.product((0, 1), repeat=3)])).alias("o")
    asked = base.select("*", corner)
    weight = None
    for c in AXES:
        w = F.when(F.col(f"o.{c}") == 1, F.col(f"_r{c}")).otherwise(1 - F.col(f"_r{c}"))
        weight = w if weight is None else weight * w
    asked = asked.select(*keys, *AXES, *[(F.col(f"_f{c}") + F.col(f"o.{c}")).alias(f"_{c}") for c in AXES], weight.alias("_w"))
    source = voxels.select(*keys, *[F.col(c).alias(f"_{c}") for c in AXES], F.col(value).alias("_v"))
    read = asked.join(source, [*keys, *[f"_{c}" for c in AXES]], "left")
    return read.groupBy(*keys, *AXES).agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0))).alias(value))


def polygon_coverage(edges: DataFrame, keys: list[str], height: int, width: int, scale: int) -> DataFrame:
    """(keys, y, x, coverage): share of each pixel inside an outline, by scale x scale sample points and the even-odd
    rule. edges: (keys, y0, x0, y1, x1). Each edge meets the sample rows that it crosses; a point is inside if an odd
    number of edges lies to its right, so samples of a row are settled by sorted crossings, not by all edges."""
    step = 1.0 / scale
    first = F.ceil((F.least("y0", "y1") - step / 2) / step)
    last = F.ceil((F.greatest("y0", "y1") - step / 2) / step) - 1
    rows = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(height * scale - 1)))
    crossing = edges.where(F.greatest(first, F.lit(0)) <= F.least(last, F.lit(height * scale - 1))).select(*keys, "y0", "x0", "y1", "x1", F.explode(rows).alias("row"))
    ry = (F.col("row") + 0.5) * step
    at = F.col("x0") + (ry - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    line = crossing.select(*keys, "row", at.alias("at")).groupBy(*keys, "row").agg(F.sort_array(F.collect_list("at")).alias("c"))
    spans = F.expr("transform(sequence(0, cast(size(c) / 2 as int) - 1), i -> struct(c[2 * i] as a, c[2 * i + 1] as b))")
    s = line.select(*keys, "row", F.explode(spans).alias("s"))
    lo = F.greatest(F.ceil((F.col("s.a") - step / 2) / step), F.lit(0))
    hi = F.least(F.ceil((F.col("s.b") - step / 2) / step) - 1, F.lit(width * scale - 1))
    cells = s.where(lo <= hi).select(*keys, "row", F.explode(F.sequence(lo, hi)).alias("col"))
    pixel = lambda c: F.floor(F.col(c) / scale).cast("int")
    return cells.groupBy(*keys, pixel("row").alias("y"), pixel("col").alias("x")).agg((F.count("*") / (scale * scale)).alias("coverage"))


def coverage_iou(coverage: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, iou) of outlines' coverage and a mask (y, x) of whole pixels."""
    hit = coverage.join(mask.select("y", "x", F.lit(1.0).alias("m")), ["y", "x"], "left").groupBy(*keys)
    g = hit.agg(F.sum("coverage").alias("c"), F.sum(F.col("coverage") * F.coalesce("m", F.lit(0.0))).alias("both"))
    all_ = mask.agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(all_)).select(*keys, (F.col("both") / (F.col("c") + F.col("n") - F.col("both"))).alias("iou"))  # one count



def aligned_maps(shape: tuple[int, int, int], theta: float, phi: float) -> list[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
    """(matrix, offset, axes) of the arrays that a two-step alignment reads, each seen from the output: the one between
    the steps, turned back by phi in (z, x), and the source, turned by theta in (y, x) as well."""
    found, m, o = [], np.eye(3), np.zeros(3)
    for degrees, axes in ((-phi, (0, 2)), (theta, (1, 2))):
        if degrees:
            turn = plane_rotation(degrees, axes)
            m, o = turn @ m, turn @ o + about_centre(turn, shape)
            found.append((m, o, axes))
    return found


def valid_intervals(lines: DataFrame, shape: tuple[int, int, int], maps: list[tuple[np.ndarray, np.ndarray, tuple[int, int]]], margin: float = 1.0) -> DataFrame:
    """lines (z, y, ...) with x_min and x_max: the half-open range of x for which every map leads into its array, `margin`
    voxels from the edge along the axes of its turn. Each bound is linear in x, so it cuts the line to a range,
    and the ranges meet in one; (size, 0) if it is empty."""
    low, high, possible = F.lit(0.0), F.lit(shape[2] - 1.0), F.lit(True)
    for matrix, offset, axes in maps:
        for i, n in enumerate(shape):
            inset = margin if i in axes else 0.0
            base = float(matrix[i, 0]) * F.col("z") + float(matrix[i, 1]) * F.col("y") + float(offset[i])
            slope = float(matrix[i, 2])
            if abs(slope) < 1e-12:
                possible = possible & base.between(inset, n - 1 - inset)
                continue
            ends = [(F.lit(bound) - base) / slope for bound in (inset, n - 1 - inset)]
            low, high = F.greatest(low, F.least(*ends)), F.least(high, F.greatest(*ends))
    possible = possible & (low <= high)
    clipped = lambda c: F.greatest(F.lit(0), F.least(F.lit(shape[2]), c)).cast("int")
    return lines.withColumn("x_min", clipped(F.when(possible, F.ceil(low - 1e-9)).otherwise(shape[2]))).withColumn("x_max", clipped(F.when(possible, F.floor(high + 1e-9) + 1).otherwise(0)))


def moved_boxes(points: DataFrame, keys: list[str], matrix: np.ndarray, offset: np.ndarray, halo: int, shape: tuple[int, int, int]) -> DataFrame:
    """(keys, z0, z1, y0, y1, x0, x1): box (ends included) of each group's points carried by matrix @ point + offset,
    widened by halo and clipped; groups that leave the volume are left out."""
    at = [F.round(sum((float(matrix[i, j]) * F.col(c) for j, c in enumerate(AXES[1:], 1)), float(matrix[i, 0]) * F.col("z") + float(offset[i])), 9) for i in range(3)]
    ends = []
    for c, a, n in zip(AXES, at, shape):
        ends += [F.greatest(F.floor(F.min(a)) - halo, F.lit(0)).cast("long").alias(f"{c}0"), F.least(F.ceil(F.max(a)) + halo, F.lit(n - 1)).cast("long").alias(f"{c}1")]
    return points.groupBy(*keys).agg(*ends).where(" and ".join(f"{c}0 <= {c}1" for c in AXES))


def top_in_boxes(voxels: DataFrame, boxes: DataFrame, keys: list[str], volume: str, value: str, k: int, tile: int = 8) -> DataFrame:
    """(keys, rank, z, y, x, value): the k largest values in each box (keys, volume, z0, z1, ...), ties in order of z, y, x.

    Boxes meet tiles of voxels. Tiles wholly inside a box hold a voxel as large as their maximum each, so the k-th largest
    of these maxima bounds what is needed: only tiles with as large a maximum give their voxels, which
    are then ranked.
    """
    own = voxels.select(volume, *AXES, value, *[F.floor(F.col(c) / tile).cast("long").alias(f"_{c}") for c in AXES])
    tiles = own.groupBy(volume, *[f"_{c}" for c in AXES]).agg(F.max(value).alias("_most"))
    asked = boxes
    for c in AXES:
        asked = asked.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / tile).cast("long"), F.floor(F.col(f"{c}1") / tile).cast("long"))))
    whole = F.lit(True)
    for c in AXES:
        whole = whole & (F.col(f"_{c}") * tile >= F.col(f"{c}0")) & (F.col(f"_{c}") * tile + tile - 1 <= F.col(f"{c}1"))
    met = asked.join(tiles, [volume, *[f"_{c}" for c in AXES]])
    w = Window.partitionBy(*keys).orderBy(F.col("_most").desc())
    bound = met.where(whole).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k).select(*keys, F.col("_most").alias("_bound"))
    need = met.join(bound, keys, "left").where("_bound is null or _most >= _bound")
    inside = F.lit(True)
    for c in AXES:
        inside = inside & F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1"))
    found = need.join(own, [volume, *[f"_{c}" for c in AXES]]).where(inside)
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *AXES)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", *AXES, value)
