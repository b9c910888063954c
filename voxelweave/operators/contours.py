"""Masks in the plane from pixel rows: metal, outside, outer border, circle through it, what it encloses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.storage import checked_broadcast, cut
from voxelweave.operators.volume import labelled
from voxelweave.operators.windows import running

#: Directions clockwise from up, as (y, x).
UP, RIGHT, DOWN, LEFT = (-1, 0), (0, 1), (1, 0), (0, -1)
TURNS = ((UP, RIGHT), (RIGHT, DOWN), (DOWN, LEFT), (LEFT, UP))
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def planes(pixels: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """(keys, y0, y1, x0, x1, start): box of each plane's pixels, widened by pad, and the number of places in the boxes
    before it, so that start + place in the box numbers all places of all planes."""
    box = pixels.groupBy(*keys).agg(*[(f(c) + s * pad).cast("long").alias(f"{c}{k}") for c in "yx" for k, f, s in ((0, F.min, -1), (1, F.max, 1))])
    area = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return cut(running(box.withColumn("area", area), [], keys, ["area"]).select(*keys, "y0", "y1", "x0", "x1", F.col("area_before").alias("start")), "planes")


def _place(start: str = "start"):
    return (F.col(start) + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0") + 1) + F.col("x") - F.col("x0")).cast("long")


def components2d(pixels: DataFrame, keys: list[str], boxes: DataFrame, diagonal: bool = True) -> DataFrame:
    """pixels (keys, y, x, ...) with their component, the least number of a place in it."""
    rows = pixels.join(checked_broadcast(boxes), keys).withColumn("_id", _place()).select(*pixels.columns, "_id")
    return labelled(rows, keys, ["y", "x"], "_id", diagonal).drop("_id")


def metal_mask(
    pixels: DataFrame, keys: list[str], value: str, threshold: float, min_area: int, margin: float = 0, size: tuple[int, int] | None = None, boxes: DataFrame | None = None
) -> DataFrame:
    """(keys, y, x): parts above threshold, connected over corners too, of at least min_area pixels; with a margin, all
    parts above threshold - margin that hold one, grown by a pixel over faces (within size, if given)."""
    boxes = planes(pixels, keys) if boxes is None else boxes
    seeds = cut(components2d(pixels.where(F.col(value) > threshold).select(*keys, "y", "x"), keys, boxes), "seeds")
    big = seeds.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_area).select("component")
    seeds = seeds.join(big, "component", "left_semi").select(*keys, "y", "x")
    if margin <= 0:
        return seeds
    low = cut(components2d(pixels.where(F.col(value) > threshold - margin).select(*keys, "y", "x"), keys, boxes), "low")
    held = low.join(seeds, [*keys, "y", "x"], "left_semi").select("component").distinct()
    mask = low.join(held, "component", "left_semi")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), UP, RIGHT, DOWN, LEFT)])).alias("o")
    wide = mask.select(*keys, "y", "x", near).select(*keys, (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x")).distinct()
    if size:
        wide = wide.where(F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1))
    return wide


def _filled(boxes: DataFrame, keys: list[str]) -> DataFrame:
    rows = boxes.withColumn("y", F.explode(F.sequence("y0", "y1")))
    return rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*keys, "y", "x")


def outside(mask: DataFrame, keys: list[str], boxes: DataFrame | None = None) -> DataFrame:
    """(keys, y, x): places of the planes' boxes (the mask's with a frame around it, unless given larger ones) that faces
    connect with the frame without crossing the mask. Empty places are labelled in tiles; the frame's first
    place has its plane's least number, so its component is the outside."""
    boxes = planes(mask, keys, 1) if boxes is None else boxes.join(mask.select(*keys).distinct(), keys, "left_semi")
    empty = _filled(boxes, keys).join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    parts = components2d(empty, keys, boxes, diagonal=False)
    out = parts.join(checked_broadcast(boxes.select(*keys, F.col("start").alias("component"))), [*keys, "component"], "left_semi")
    return cut(out.select(*keys, "y", "x"), "outside")


def enclosed(mask: DataFrame, keys: list[str], boxes: DataFrame | None = None) -> DataFrame:
    """(keys, y, x): the mask and all that the outside does not reach."""
    boxes = planes(mask, keys, 1) if boxes is None else boxes
    every = _filled(boxes.join(mask.select(*keys).distinct(), keys, "left_semi"), keys)
    return every.join(outside(mask, keys, boxes), [*keys, "y", "x"], "left_anti")


def outlines(mask: DataFrame, keys: list[str], boxes: DataFrame | None = None) -> DataFrame:
    """(keys, component, y, x, next_y, next_x): the outer borders of the mask's parts (connected over corners), as steps
    from border pixel to border pixel, clockwise. Parts inside a hole of another have none; a single
    pixel has no step. mask: (keys, y, x), with component if it has been labelled.

    A border pixel has a side that faces the outside. Along such a side the border goes on to the pixel diagonally
    ahead if that is set, else to the one ahead, else around the corner of the same pixel: three places near it
    decide, so every step is found from a pixel's own surroundings, which one grouping brings together, and
    steps join end to end wherever their pixels are stored.
    """
    boxes = planes(mask, keys, 1) if boxes is None else boxes
    parts = mask if "component" in mask.columns else components2d(mask.select(*keys, "y", "x"), keys, boxes)
    out = outside(mask, keys, boxes)

    def told(rows: DataFrame, near: list[tuple[int, int]], first: int, component) -> DataFrame:
        """Each place tells those around it that it lies there, by a bit for its direction from them."""
        told = F.array(*[F.struct(F.lit(-dy).alias("a"), F.lit(-dx).alias("b"), F.lit(1 << (first + AROUND.index((dy, dx)))).alias("bit")) for dy, dx in near])
        c = F.when((F.col("o.a") == 0) & (F.col("o.b") == 0), component).alias("component")
        return rows.withColumn("o", F.explode(told)).select(*keys, (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"), F.col("o.bit").alias("bit"), c)

    both = told(parts, AROUND, 0, F.col("component")).unionByName(told(out, [UP, RIGHT, DOWN, LEFT], 9, F.lit(None).cast("long")))
    seen = both.groupBy(*keys, "y", "x").agg(F.sum("bit").alias("bits"), F.max("component").alias("component")).where("component is not null")
    is_set = lambda at, first=0: F.col("bits").bitwiseAND(F.lit(1 << (first + AROUND.index(at)))) != 0
    steps = []
    for side, way in TURNS:
        ahead, corner = way, (side[0] + way[0], side[1] + way[1])
        to = lambda at: F.struct(F.lit(at[0]).alias("a"), F.lit(at[1]).alias("b"))
        steps.append(F.when(is_set(side, 9), F.when(is_set(corner), to(corner)).when(is_set(ahead), to(ahead))))
    s = seen.withColumn("s", F.explode(F.array_compact(F.array(*steps))))
    return s.select(*keys, "component", "y", "x", (F.col("y") + F.col("s.a")).alias("next_y"), (F.col("x") + F.col("s.b")).alias("next_x"))


def enclosed_areas(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, points, area): steps of each outer border, and the area inside the polygon through its pixels."""
    cross = F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y")
    return steps.groupBy(*keys, "component").agg(F.count("*").alias("points"), (F.abs(F.sum(cross)) / 2).alias("area"))


def taubin_circles(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, yc, xc, r, points): the circle A (x^2 + y^2) + B x + C y + D = 0 with the least sum of squares of its left
    side, for a mean square of its gradient of one. Null for fewer than three points or points on a line.

    Spark adds up moments about the centre of the points. With D eliminated and A scaled, what is left is the least
    eigenvector of a 3 x 3 matrix of moments, solved for many groups at once.
    """
    middle = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(checked_broadcast(cut(middle, "middle")), keys).select(*keys, "mx", "my", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"))
    p = p.withColumn("w", F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    pairs = [a + b for a in "wuv" for b in "wuv" if a <= b]
    g = p.groupBy(*keys).agg(F.count("*").alias("points"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.avg("w").alias("w"), *[F.covar_pop(a[0], a[1]).alias(a) for a in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            scale = 2 * np.sqrt(t["w"].to_numpy())
            m = np.zeros((len(t), 3, 3))
            for i, a in enumerate("wuv"):
                for j, b in enumerate("wuv"):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        m[:, i, j] = t[min(a, b) + max(a, b)].to_numpy() / (scale if a == "w" else 1) / (scale if b == "w" else 1)
            enough = (t["points"].to_numpy() > 2) & np.isfinite(m).all(axis=(1, 2))
            m[~enough] = np.eye(3)
            a, b, c = np.linalg.eigh(m)[1][:, :, 0].T if len(t) else np.zeros((3, 0))
            a = np.where(enough & (np.abs(a) > 1e-9), a, np.nan) / np.where(scale > 0, scale, 1)
            b, c = -b / (2 * a), -c / (2 * a)
            out = t[keys].assign(yc=t["my"] + c, xc=t["mx"] + b, r=np.sqrt(b * b + c * c + t["w"].to_numpy()), points=t["points"])
            yield out.astype(object).where(out.notna(), None)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return g.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", yc double, xc double, r double, points long")


def ends_and_middle(voxels: DataFrame, slab: int, value: str) -> DataFrame:
    """(volume, slab, y, x, value): maximum over three slices each at both ends and in the middle of every slab."""
    v = voxels.withColumn("slab", F.floor(F.col("z") / slab).cast("long"))
    span = v.groupBy("volume", "slab").agg(F.min("z").alias("z0"), (F.max("z") - F.min("z") + 1).alias("nz"))
    i, half, nz = F.col("z") - F.col("z0"), F.floor(F.col("nz") / 2), F.col("nz")
    chosen = (i < 3) | i.between(half - 1, half + 1) | (i >= nz - 3)
    return v.join(checked_broadcast(cut(span, "span")), ["volume", "slab"]).where(chosen).groupBy("volume", "slab", "y", "x").agg(F.max(value).alias(value))


def can_geometry(voxels: DataFrame, value: str, slab: int, threshold: float, min_area: int, margin: float = 0, size: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(circles, inside) of the metal around each slab of voxels (volume, z, y, x, value).

    circles: (volume, slab, yc, xc, r, points), Taubin's circle through the outer border of the metal part that encloses
    the largest area; inside: (volume, slab, y, x), the part and all that it encloses. Slabs without such a
    part have no row in either.
    """
    keys = ["volume", "slab"]
    pixels = cut(ends_and_middle(voxels, slab, value), "ends")
    boxes = planes(pixels, keys, 2)  # room for growth and for the frame
    mask = metal_mask(pixels, keys, value, threshold, min_area, margin, size, boxes)
    parts = cut(components2d(mask, keys, boxes), "metal")
    steps = cut(outlines(parts, keys, boxes), "steps")
    best = enclosed_areas(steps, keys).groupBy(*keys).agg(F.max_by("component", F.struct("area", -F.col("component"))).alias("component"))
    best = checked_broadcast(cut(best, "best"))
    circles = taubin_circles(steps.join(best, [*keys, "component"], "left_semi"), keys)
    return circles, enclosed(parts.join(best, [*keys, "component"], "left_semi").select(*keys, "y", "x"), keys, boxes)


def gated(voxels: DataFrame, inside: DataFrame, slab: int) -> DataFrame:
    """Voxels inside the metal of their slab; slabs without any keep all of theirs."""
    v = voxels.withColumn("slab", F.floor(F.col("z") / slab).cast("long"))
    known = checked_broadcast(cut(inside.select("volume", "slab", F.lit(1).alias("_k")).distinct(), "known"))
    hit = v.join(known, ["volume", "slab"], "left").join(inside.withColumn("_in", F.lit(1)), ["volume", "slab", "y", "x"], "left")
    return hit.where("_k is null or _in is not null").select(*voxels.columns)


def radial_position(objects: DataFrame, circles: DataFrame, slab: int) -> DataFrame:
    """objects (volume, centroid_z, centroid_y, centroid_x, ...) with radial_pos: distance from their slab's circle centre
    by its radius; null where the slab has none."""
    o = objects.withColumn("slab", F.floor(F.col("centroid_z") / slab).cast("long"))
    c = checked_broadcast(cut(circles.select("volume", "slab", "yc", "xc", "r"), "circles"))
    dy, dx = F.col("centroid_y") - F.col("yc"), F.col("centroid_x") - F.col("xc")
    return o.join(c, ["volume", "slab"], "left").select(*objects.columns, (F.sqrt(dy * dy + dx * dx) / F.col("r")).alias("radial_pos"))
