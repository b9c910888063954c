"""Morphology of voxel sets, the object at a point with its projection, and blending of one into an image."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.volume import label3d

AXES = ["z", "y", "x"]
Step = tuple[int, ...]


def ball(radius: float, axes: int = 3) -> list[Step]:
    """Steps of at most radius."""
    r = int(radius)
    return [s for s in itertools.product(range(-r, r + 1), repeat=axes) if sum(o * o for o in s) <= radius * radius]


def _moved(voxels: DataFrame, keys: list[str], axes: list[str], steps: list[Step]) -> DataFrame:
    told = F.explode(F.array(*[F.struct(*[F.lit(o).alias(c) for c, o in zip(axes, s)]) for s in steps])).alias("o")
    return voxels.select(*keys, *axes, told).select(*keys, *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in axes])


def dilated(voxels: DataFrame, keys: list[str], steps: list[Step], axes: list[str] = AXES) -> DataFrame:
    """(keys, axes): all places that a step from a voxel reaches, once each; Spark drops repeats before the shuffle."""
    return _moved(voxels, keys, axes, steps).distinct()


def eroded(voxels: DataFrame, keys: list[str], steps: list[Step], axes: list[str] = AXES) -> DataFrame:
    """(keys, axes): places from which every step leads to a voxel. Voxels vote for the places that reach them; whatever
    is outside the table is no voxel. voxels has no repeats."""
    votes = _moved(voxels, keys, axes, [tuple(-o for o in s) for s in steps]).groupBy(*keys, *axes).agg(F.count("*").alias("_n"))
    return votes.where(F.col("_n") == len(set(steps))).select(*keys, *axes)


def closed(voxels: DataFrame, keys: list[str], steps: list[Step], axes: list[str] = AXES) -> DataFrame:
    """Dilation, then erosion: fills what is narrower than the steps. Space has no edge here."""
    return eroded(dilated(voxels, keys, steps, axes), keys, steps, axes)


def opened(voxels: DataFrame, keys: list[str], steps: list[Step], axes: list[str] = AXES) -> DataFrame:
    """Erosion, then dilation: removes what is narrower than the steps."""
    return dilated(eroded(voxels, keys, steps, axes), keys, steps, axes)


@dataclass(frozen=True)
class Extraction:
    """edge: voxels along each side of a point's surroundings (odd); window: of the search for the local maximum; high,
    low: of the residual by the noise, for the seed and for growth."""

    edge: int = 15
    window: int = 3
    high: float = 4.0
    low: float = 2.5


def _noise(residual: np.ndarray, known: np.ndarray, centre: tuple[int, ...]) -> float:
    """Deviation from the median of absolute deviations, twice, the second time without outliers."""
    some = known.copy()
    some[centre] = False
    width = 0.0
    for _ in range(2):
        middle = np.median(residual[some])
        width = np.median(np.abs(residual[some] - middle))
        some = known & (np.abs(residual - middle) < 3.5 * width)
        if not some.any():
            break
    return float(1.4826 * width)


def _shift(mask: np.ndarray, step: Step) -> np.ndarray:
    out = np.zeros_like(mask)
    to = tuple(slice(max(o, 0), n + min(o, 0)) for o, n in zip(step, mask.shape))
    from_ = tuple(slice(max(-o, 0), n + min(-o, 0)) for o, n in zip(step, mask.shape))
    out[to] = mask[from_]
    return out


def _region(residual: np.ndarray, noise: float, centre: tuple[int, ...], cfg: Extraction) -> np.ndarray:
    """Part above the upper limit that holds the centre, all parts above the lower one that it touches, without holes
    and narrow gaps; connected over corners."""
    core = label3d(residual > cfg.high * noise, True)
    if not core[centre]:
        return np.zeros(residual.shape, bool)
    low = label3d(residual > cfg.low * noise, True)
    grown = np.isin(low, np.setdiff1d(low[core == core[centre]], [0])) & (low > 0)
    free = label3d(np.pad(~grown, 1, constant_values=True), True)
    whole = (free != free[0, 0, 0])[1:-1, 1:-1, 1:-1]
    wide = np.pad(whole, 2)
    near = ball(1)
    wide = np.any([_shift(wide, s) for s in near], axis=0)
    return np.all([_shift(wide, s) for s in near], axis=0)[2:-2, 2:-2, 2:-2] | grown


def extracted(voxels: DataFrame, points: DataFrame, value: str, cfg: Extraction = Extraction()) -> DataFrame:
    """(point, z, y, x, n_voxels, noise, dy, dx, strength): the object at each point (point, volume, z, y, x), projected.

    A point moves to the largest value in its window (the first of equals in order of z, y, x). Around it, the median
    along z is taken off; the object is what is connected with the centre above `high` noises, grown above
    `low`, with holes filled and gaps closed. Its pixels, relative to the centre, add up its residual weighted by
    confidence (0 half a noise below `low`, 1 half a noise above `high`), scaled to its largest residual at most. A
    point without an object has one row with n_voxels 0 and nulls.

    Voxels meet points by cells as large as the surroundings; a point's surroundings are one group, of bounded size.
    """
    edge, half = cfg.edge, cfg.edge // 2
    reach = half + cfg.window // 2
    cells = points.select("point", "volume", *[F.col(c).alias(f"p{c}") for c in AXES])
    for c in AXES:
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"p{c}") - reach) / edge), F.floor((F.col(f"p{c}") + reach) / edge))))
    near = voxels.select("volume", *AXES, F.col(value).cast("double").alias("v"), *[F.floor(F.col(c) / edge).alias(f"c{c}") for c in AXES])
    close = F.lit(True)
    for c in AXES:
        close = close & (F.abs(F.col(c) - F.col(f"p{c}")) <= reach)
    around = near.join(cells, ["volume", *[f"c{c}" for c in AXES]]).where(close).select("point", *AXES, *[f"p{c}" for c in AXES], "v")

    def extract(pdf: pd.DataFrame) -> pd.DataFrame:
        at, v, p = pdf[AXES].to_numpy(), pdf["v"].to_numpy(), pdf[["pz", "py", "px"]].iloc[0].to_numpy()
        order = np.lexsort((*at.T[::-1], -v))
        order = order[(np.abs(at[order] - p) <= cfg.window // 2).all(axis=1)]
        none = pd.DataFrame([[pdf["point"].iloc[0], *map(int, p), 0, None, None, None, None]], columns=names)
        if not len(order):
            return none
        centre = at[order[0]]
        inside = (np.abs(at - centre) <= half).all(axis=1)
        low = at[inside].min(axis=0)
        cube = np.full(at[inside].max(axis=0) - low + 1, np.nan)
        cube[tuple((at[inside] - low).T)] = v[inside]
        known = ~np.isnan(cube)
        residual = np.where(known, cube - np.nanmedian(np.where(known.any(axis=0), cube, 0), axis=0), 0)
        middle = tuple(centre - low)
        noise = _noise(residual, known, middle)
        region = _region(residual, noise, middle, cfg)
        own = residual * region
        if not (own > 0).any():
            return none.assign(z=int(centre[0]), y=int(centre[1]), x=int(centre[2]), noise=noise)
        first = max(cfg.low - 0.5, 0)
        sure = np.clip((own / noise - first) / (cfg.high + 0.5 - first), 0, 1) if noise > 0 else (own > 0).astype(float)
        flat = (own * sure).sum(axis=0)
        if flat.max() > own.max():
            flat *= max(own.max(), 0) / flat.max()
        y, x = np.nonzero(flat)
        rows = {"point": pdf["point"].iloc[0], "z": int(centre[0]), "y": int(centre[1]), "x": int(centre[2]), "n_voxels": int(region.sum()), "noise": noise}
        return pd.DataFrame(rows | {"dy": y - middle[1], "dx": x - middle[2], "strength": flat[y, x]})[names]

    names = ["point", "z", "y", "x", "n_voxels", "noise", "dy", "dx", "strength"]
    kind = dict(points.dtypes)["point"]
    return around.groupBy("point").applyInPandas(extract, f"point {kind}, z long, y long, x long, n_voxels long, noise double, dy long, dx long, strength double")




def blended(image: DataFrame, stamp: DataFrame, keys: list[str], value: str, size: tuple[int, int], blur: float = 1.0, cut_at: float = 2.0, gain: float = 0.75) -> DataFrame:
    """(keys, y, x, value): image pixels plus `gain` times the stamp (keys, y, x, strength), which is blurred by a Gaussian
    cut off at cut_at widths and scaled back to its largest strength; whole numbers from 0 to 255.

    Each stamp pixel tells the few around it; stamp pixels outside the image count for nothing.
    """
    if blur < 0 or blur * cut_at < 1.5:
        raise ValueError("the blur is negative or its kernel too narrow")
    r = int(cut_at * blur + 0.5)
    bell = np.exp(-0.5 * (np.arange(-r, r + 1) / blur) ** 2)
    bell /= bell.sum()
    h, w = size
    own = stamp.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    steps = F.array(*[F.struct(F.lit(a - r).alias("a"), F.lit(b - r).alias("b"), F.lit(float(bell[a] * bell[b])).alias("w")) for a, b in itertools.product(range(2 * r + 1), repeat=2)])
    # a place reads its neighbours mirrored at the edge, so a pixel near the edge also tells places through its image
    told = own.withColumn("o", F.explode(steps))
    images = []
    for y in (F.col("y"), -1 - F.col("y"), 2 * h - 1 - F.col("y")):
        for x in (F.col("x"), -1 - F.col("x"), 2 * w - 1 - F.col("x")):
            images.append(F.struct((y + F.col("o.a")).alias("y"), (x + F.col("o.b")).alias("x")))
    told = told.withColumn("to", F.explode(F.array(*images))).where(F.col("to.y").between(0, h - 1) & F.col("to.x").between(0, w - 1))
    soft = told.groupBy(*keys, F.col("to.y").alias("y"), F.col("to.x").alias("x")).agg(F.sum(F.col("strength") * F.col("o.w")).alias("soft"))
    top = own.groupBy(*keys).agg(F.max("strength").alias("_top")).where(F.col("_top") > 0)
    peak = soft.groupBy(*keys).agg(F.max("soft").alias("_peak")).where(F.col("_peak") > 0)
    soft = soft.join(top, keys).join(peak, keys).select(*keys, "y", "x", (F.col("soft") * F.col("_top") / F.col("_peak")).alias("soft"))
    out = image.join(soft, [*keys, "y", "x"], "left")
    return out.select(*keys, "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(F.col(value) + gain * F.coalesce("soft", F.lit(0.0))))).cast("int").alias(value))
