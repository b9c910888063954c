"""Detection in voxel tables: hysteresis components, features, slab kernels with halo and ownership."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.columns import safe_ratio
from voxelweave.functions.storage import cut, light_broadcast
from voxelweave.operators.linking import FEW_EDGES, reachable
from voxelweave.operators.windows import quantiles


@dataclass(frozen=True)
class Detection:
    """Thresholds and gates. high, low: of v / sigma; seeds: least voxels of the largest connected
    core above high; extent: slices an object may span at most (also the halo of a slab)."""

    high: float = 4.0
    low: float = 2.99
    seeds: int = 2
    extent: int = 10
    slab: int = 64


def neighbours(voxels: DataFrame, place: list[str], axes: list[str], key: str) -> DataFrame:
    """(a, b) of voxels that share a face: one self-join on coordinates, each voxel asking for the one
    ahead of it along each axis."""
    ahead = F.array(*[F.struct(*[(F.col(c) + int(c == axis)).alias(c) for c in axes]) for axis in axes])
    asks = voxels.select(*place, F.col(key).alias("a"), F.explode(ahead).alias("n")).select(*place, "a", *[F.col(f"n.{c}").alias(c) for c in axes])
    return asks.join(voxels.select(*place, *axes, F.col(key).alias("b")).hint("merge"), [*place, *axes]).select("a", "b")


#: Edge of the tiles that are labelled at a time.
TILE = 32


def _steps(n: int, diagonal: bool) -> list[tuple[int, ...]]:
    """Steps to the neighbours ahead: over faces, or over edges and corners too."""
    all_ = [o for o in itertools.product((-1, 0, 1), repeat=n) if o > (0,) * n]
    return all_ if diagonal else [o for o in all_ if sum(map(abs, o)) == 1]


def _tile_labels(axes: list[str], key: str, diagonal: bool) -> Callable:
    """Voxels of one tile with the smallest key of their connected part of it."""

    def run(t: pa.Table) -> pa.Table:
        at = np.stack([np.asarray(t.column(c).combine_chunks()) for c in axes])
        at -= at.min(axis=1)[:, None]
        keys = np.asarray(t.column(key).combine_chunks())
        mask = np.zeros(at.max(axis=1) + 1, bool)
        mask[tuple(at)] = True
        _, part = np.unique(label3d(mask, diagonal)[tuple(at)], return_inverse=True)
        least = np.full(part.max() + 1, keys.max())
        np.minimum.at(least, part, keys)
        return t.append_column("part", pa.array(least[part], pa.int64()))

    return run


def labelled(voxels: DataFrame, place: list[str], axes: list[str], key: str, diagonal: bool = False) -> DataFrame:
    """voxels with their component (smallest key), connected over faces or, if diagonal, over edges and corners too.

    Tiles of TILE voxels an edge are labelled by a NumPy kernel; only the parts that touch across tile
    borders become edges, so the rounds that join them work on few rows.
    """
    tile = [F.floor(F.col(c) / TILE).cast("long").alias(f"_{c}") for c in axes]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.schema)
    keys = [*place, *[f"_{c}" for c in axes]]
    types = ", ".join(f"_{c} long" for c in axes)
    parts = voxels.select("*", *tile).groupBy(*keys).applyInArrow(_tile_labels(axes, key, diagonal), f"{schema}, {types}, part long")
    parts = cut(parts.drop(*[f"_{c}" for c in axes]), "parts")
    # a voxel on a tile's border asks for its neighbours beyond; only voxels on a border can answer
    last = lambda c: F.pmod(F.col(c), F.lit(TILE))
    rim = F.lit(False)
    for c in axes:
        rim = rim | last(c).isin(0, TILE - 1)
    steps = F.array(*[F.struct(*[F.lit(o).alias(c) for c, o in zip(axes, step)]) for step in _steps(len(axes), diagonal)])
    beyond = F.lit(False)
    for c in axes:
        beyond = beyond | ((last(c) == 0) & (F.col(f"o.{c}") < 0)) | ((last(c) == TILE - 1) & (F.col(f"o.{c}") > 0))
    border = parts.where(rim)
    asks = border.withColumn("o", F.explode(steps)).where(beyond).select(*place, *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in axes], F.col("part").alias("a"))
    edges = asks.join(border.select(*place, *axes, F.col("part").alias("b")).hint("merge"), [*place, *axes]).select("a", "b").distinct()
    roots = light_broadcast(cut(reachable(edges, few=FEW_EDGES).withColumnRenamed("id", "part"), "roots"))
    return parts.join(roots, "part", "left").select(*voxels.columns, F.coalesce("component", "part").alias("component"))


def hysteresis(voxels: DataFrame, place: list[str], axes: list[str], value: str, low: float, high: float, key: str, diagonal: bool = False) -> DataFrame:
    """voxels >= low with their component (smallest key), for components that hold a voxel >= high."""
    found = labelled(voxels.where(F.col(value) >= low), place, axes, key, diagonal)
    seeds = found.groupBy("component").agg(F.max(value).alias("_top")).where(F.col("_top") >= high)
    return found.join(light_broadcast(cut(seeds.select("component"), "seeds")), "component", "left_semi")


def features(objects: DataFrame, place: list[str], axes: list[str], value: str, high: float) -> DataFrame:
    """One row per component: sizes, box, weighted centroid, fill, peak with ties in C order."""
    order = F.struct(F.col(value), *[-F.col(c) for c in axes])
    g = objects.groupBy(*place, "component").agg(
        F.count("*").alias("n_voxels"), F.sum(F.when(F.col(value) >= high, 1).otherwise(0)).alias("n_seed"), F.max(value).alias("peak"),
        F.max_by(F.struct(*axes), order).alias("top"), F.sum(value).alias("_s"),
        *[F.sum(F.col(value) * F.col(c)).alias(f"_s{c}") for c in axes], *[(F.max(c) - F.min(c) + 1).alias(f"{c}_extent") for c in axes],
    )
    box = F.col(f"{axes[0]}_extent")
    for c in axes[1:]:
        box = box * F.col(f"{c}_extent")
    return g.select(
        *place, "component", "n_voxels", "n_seed", "peak", *[F.col(f"top.{c}").alias(f"peak_{c}") for c in axes],
        *[safe_ratio(F.col(f"_s{c}"), F.col("_s")).alias(f"centroid_{c}") for c in axes], *[f"{c}_extent" for c in axes], safe_ratio(F.col("n_voxels"), box).alias("fill"),
    )


def surface_ratio(objects: DataFrame, place: list[str], axes: list[str], key: str) -> DataFrame:
    """(component, surface): share of a component's voxels with a face on something else."""
    n = neighbours(objects, place, axes, key)
    inside = n.select(F.col("a").alias(key)).unionByName(n.select(F.col("b").alias(key))).groupBy(key).count().where(F.col("count") == 2 * len(axes))
    marked = objects.join(inside.select(key, F.lit(1).alias("in")).hint("merge"), key, "left")
    return marked.groupBy("component").agg((1 - F.sum(F.coalesce("in", F.lit(0))) / F.count("*")).alias("surface"))


def label3d(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Component numbers (0: background) by label minima over neighbours, of any number of axes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    cuts = []
    for step in _steps(mask.ndim, diagonal):
        ahead = tuple(slice(max(o, 0), n + min(o, 0)) for o, n in zip(step, mask.shape))
        here = tuple(slice(max(-o, 0), n + min(-o, 0)) for o, n in zip(step, mask.shape))
        cuts.append((here, ahead))
    while True:
        new = labels.copy()
        for here, ahead in cuts:
            for one, other in ((here, ahead), (ahead, here)):
                a, b = new[one], new[other]
                new[one] = np.where((a > 0) & (b > 0), np.minimum(a, b), a)
        flat = new.ravel()
        root = np.where(flat > 0, flat[np.maximum(flat, 1) - 1], 0)  # jump to the label's own label
        new = root.reshape(mask.shape)
        if (new == labels).all():
            return new
        labels = new


def parts(at: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """For voxels at (n, axes) whole coordinates, all different, the smallest row number of each one's connected part.
    Work and memory follow the voxels, not the box around them."""
    span = at.max(axis=0) - at.min(axis=0) + 3  # a margin, so that no step leads round an edge
    stride = np.append(np.cumprod(span[:0:-1])[::-1], 1).astype(np.int64)
    code = (at - at.min(axis=0) + 1) @ stride
    order = np.argsort(code)
    code = code[order]
    ends = []
    for step in _steps(at.shape[1], diagonal):
        to = np.minimum(np.searchsorted(code, code + np.dot(step, stride)), len(code) - 1)
        met = np.flatnonzero(code[to] == code + np.dot(step, stride))
        ends.append((order[met], order[to[met]]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(len(at))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _detect(cfg: Detection) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        volume, core = pdf["volume"].iloc[0], int(pdf["slab"].iloc[0])
        at, value = pdf[["z", "y", "x"]].to_numpy(np.int64), pdf["v"].to_numpy(float)
        part = parts(at)
        strong = value >= cfg.high
        seed = np.full(len(at), -1)
        if strong.any():
            seed[strong] = parts(at[strong])
        places = np.argsort(part, kind="stable")
        begin = np.flatnonzero(np.diff(part[places], prepend=-1))
        rows = []
        for here in np.split(places, begin[1:]):
            s = seed[here]
            if not (s >= 0).any():
                continue
            p, v = at[here], value[here]
            n_seed = int(np.bincount(s[s >= 0]).max())
            extent = int(p[:, 0].max() - p[:, 0].min() + 1)
            centre = (p * v[:, None]).sum(axis=0) / v.sum()
            # the slab whose core holds the centroid owns the object
            if n_seed < cfg.seeds or extent > cfg.extent or not core * cfg.slab <= centre[0] < (core + 1) * cfg.slab:
                continue
            top = p[np.lexsort((p[:, 2], p[:, 1], p[:, 0], -v))[0]]
            shifted = p - p.mean(axis=0)
            l1, l2, l3 = sorted(np.linalg.eigvalsh(shifted.T @ shifted / len(p) + np.eye(3) / 12), reverse=True)
            rows.append((volume, len(p), n_seed, extent, *centre, float(v.max()), *(int(c) for c in top), (l1 - l2) / l1, (l2 - l3) / l1, l3 / l1))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTED.split(", ")])

    return run


DETECTED = "volume string, n_voxels long, n_seed long, z_extent long, centroid_z double, centroid_y double, centroid_x double, peak double, peak_z long, peak_y long, peak_x long, linearity double, planarity double, sphericity double"


def detect_slabs(voxels: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Objects of voxel rows (volume, z, y, x, v) found slab by slab.

    Each voxel goes to its slab and, within `extent` slices of an edge, to the neighbouring one too;
    a slab's voxels of at least `low` are one group for a NumPy kernel that follows them, not the plane. The intensity-weighted centroid decides which slab
    owns an object, so results don't depend on the slab size for objects within the extent.
    """
    core = F.floor(F.col("z") / cfg.slab)
    slabs = F.sequence(F.floor((F.col("z") - cfg.extent) / cfg.slab), F.floor((F.col("z") + cfg.extent) / cfg.slab))
    spread = voxels.where(F.col("v") >= cfg.low).withColumn("slab", F.explode(slabs)).where((F.abs(core - F.col("slab")) <= 1) & (F.col("slab") >= 0))
    return spread.groupBy("volume", "slab").applyInPandas(_detect(cfg), DETECTED)


def mip(voxels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Maximum projection onto the plane of keys."""
    return voxels.groupBy(*keys).agg(F.max(value).alias("mip"))


def contrast_range(voxels: DataFrame, keys: list[str], value: str, high: float = 0.985) -> DataFrame:
    """(lo, hi): most frequent value (the smallest of equals) and an exact upper percentile."""
    n = voxels.groupBy(*keys, value).agg(F.count("*").alias("n"))
    lo = n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("lo"))
    return lo.join(quantiles(voxels, keys, value, {"hi": high}), keys)


def regional_sd(voxels: DataFrame, keys: list[str], axes: list[str], value: str, edge: int) -> DataFrame:
    """Sample deviation of the means of edge**n cubes."""
    cubes = voxels.groupBy(*keys, *[F.floor(F.col(c) / edge).alias(c) for c in axes]).agg(F.avg(value).alias("m"))
    return cubes.groupBy(*keys).agg(F.stddev_samp("m").alias("sd"), F.count("*").alias("cubes"))


def axis_angles(voxels: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """(keys, theta, phi): degrees by which the principal axis of the voxels leans from the first of axes, towards the
    third and the second. Spark adds up the covariances; a 3 x 3 matrix a group is solved in Python."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    g = voxels.groupBy(*keys).agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            m = np.empty((len(t), 3, 3))
            for a, b in pairs:
                m[:, axes.index(a), axes.index(b)] = m[:, axes.index(b), axes.index(a)] = t[a + b]
            v = np.linalg.eigh(m)[1][:, :, -1] if len(t) else np.zeros((0, 3))
            v = v * np.where(v[:, :1] < 0, -1, 1)
            yield t[keys].assign(theta=np.degrees(np.arctan2(v[:, 2], v[:, 0])), phi=np.degrees(np.arctan2(v[:, 1], v[:, 0])))

    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}
    return g.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", theta double, phi double")
