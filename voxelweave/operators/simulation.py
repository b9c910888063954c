"""Points and blobs: rotation of points, rasters, correlated noise, retention, thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import safe_ratio


def rotated(rows: DataFrame, zyx: tuple[str, str, str], theta: float, phi: float, centre: tuple[float, float, float]) -> DataFrame:
    """rows with rz, ry, rx: points turned by theta in the (y, x) plane, then by -phi in (z, x)."""
    z, y, x = (F.col(c) - m for c, m in zip(zyx, centre))
    ct, st = math.cos(math.radians(theta)), math.sin(math.radians(theta))
    cp, sp = math.cos(math.radians(-phi)), math.sin(math.radians(-phi))
    y1, x1 = ct * y - st * x, st * y + ct * x
    z2, x2 = cp * z - sp * x1, sp * z + cp * x1
    return rows.withColumn("rz", z2 + centre[0]).withColumn("ry", y1 + centre[1]).withColumn("rx", x2 + centre[2])


def inside_cylinder(y: Column, x: Column, centre: tuple[float, float], radius: float) -> Column:
    """Whether a voxel centre lies within the radius (axis along z)."""
    return (y - centre[0]) * (y - centre[0]) + (x - centre[1]) * (x - centre[1]) < radius * radius


def quantised(v: Column, sd: float, top: int) -> Column:
    """Normalised values as integers about the middle of [0, top], rounded half to even, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.bround(top / 2 + sd * v, 0))).cast("int")


def retention(rows: DataFrame, key: list[str], state: str, before: object, after: object, value: str, k: int, noise: str) -> DataFrame:
    """Peak and summed top-k values before and after, contrast-to-noise ratios, what is retained."""
    w = Window.partitionBy(*key, state).orderBy(F.col(value).desc())
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    g = top.groupBy(*key, state).agg(F.max(value).alias("peak"), F.sum(value).alias("total"), F.sqrt(F.sum(F.col(noise) * F.col(noise))).alias("rss"))
    g = g.withColumn("cnr", safe_ratio(F.col("total"), F.col("rss")))
    a = g.where(F.col(state) == before).select(*key, *[F.col(c).alias(f"{c}_before") for c in ("peak", "total", "cnr")])
    b = g.where(F.col(state) == after).select(*key, *[F.col(c).alias(f"{c}_after") for c in ("peak", "total", "cnr")])
    j = a.join(b, key)
    for c in ("peak", "total", "cnr"):
        j = j.withColumn(f"{c}_retention", safe_ratio(F.col(f"{c}_after"), F.col(f"{c}_before")))
    return j.withColumn("peak_drop", F.col("peak_before") - F.col("peak_after"))


def otsu(hist: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """(keys, threshold): value that maximises the between-class variance of a histogram; the
    smallest of equals. Values up to it form the lower class."""
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = hist.withColumn("m", F.col(value) * F.col(n)).select(*keys, value, F.sum(n).over(up).alias("w0"), F.sum("m").over(up).alias("s0"), F.sum(n).over(all_).alias("w"), F.sum("m").over(all_).alias("s"))
    d = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    score = F.round(F.col("w0") * (F.col("w") - F.col("w0")) * d * d, 3)
    ok = h.where("w0 < w").withColumn("b", score)
    return ok.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("b"), F.col(value))).alias("threshold"))


def rastered(blobs: DataFrame, key: str, zyx: tuple[str, str, str], sigma: float, amplitude: float, truncation: float = 2.5) -> DataFrame:
    """(key, z, y, x, v): Gaussian blobs integrated over voxels, scaled so that the voxel under the
    centre holds the amplitude, within truncation sigmas."""
    r = math.ceil(truncation * sigma)
    span = F.sequence(F.lit(-r), F.lit(r))
    base = blobs.select(key, *[F.col(c).cast("double").alias(a) for c, a in zip(zyx, ("cz", "cy", "cx"))])
    cells = base.withColumn("dz", F.explode(span)).withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))

    def weight(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        erf = np.vectorize(math.erf, otypes=[float])
        for b in batches:
            if b.empty:
                continue
            v, peak, far = np.ones(len(b)), np.ones(len(b)), np.zeros(len(b))
            out = {key: b[key]}
            for a in "zyx":
                c = b[f"c{a}"].to_numpy()
                at = np.floor(c + 0.5) + b[f"d{a}"].to_numpy()
                part = lambda p: (erf((p + 0.5 - c) / sigma / math.sqrt(2)) - erf((p - 0.5 - c) / sigma / math.sqrt(2))) / 2  # noqa: B023, E731
                v, peak, far = v * part(at), peak * part(np.floor(c + 0.5)), far + (at - c) ** 2
                out[a] = at.astype(np.int64)
            got = pd.DataFrame(out | {"v": amplitude * v / peak})
            yield got[far <= (truncation * sigma) ** 2]

    kind = blobs.schema[key].dataType.simpleString()
    return cells.mapInPandas(weight, f"{key} {kind}, z long, y long, x long, v double")


def injected(volume: DataFrame, blobs: DataFrame, place: list[str], top: float) -> DataFrame:
    """Voxels plus blob voxels, summed and clipped to [0, top]."""
    both = volume.select(*place, "v").unionByName(blobs.select(*place, "v"))
    return both.groupBy(*place).agg(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.sum("v"))).alias("v"))


def ar2(rows: DataFrame, keys: list[str], order: str, value: str, rho1: float, rho2: float) -> DataFrame:
    """White series turned into AR(2) series of unit variance with the given correlations at lags 1
    and 2; one bounded series a group."""
    p1, p2 = rho1 * (1 - rho2) / (1 - rho1**2), (rho2 - rho1**2) / (1 - rho1**2)
    e2 = 1 - p1 * rho1 - p2 * rho2
    if e2 <= 0:
        raise ValueError("these correlations give no stationary series")
    e = math.sqrt(e2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[value].to_numpy(float)
        y = np.empty_like(x)
        for i in range(len(x)):
            y[i] = x[0] if i == 0 else rho1 * y[0] + math.sqrt(1 - rho1**2) * x[1] if i == 1 else p1 * y[i - 1] + p2 * y[i - 2] + e * x[i]
        return pdf.assign(filtered=y)[[*keys, order, "filtered"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", filtered double")
