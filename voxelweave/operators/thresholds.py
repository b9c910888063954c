"""Thresholds from gray-value histograms: Spark counts, a kernel reads the 256 counts of a volume."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 256


def smoothed(h: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, mirrored at the ends."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(h, r, mode="symmetric"), k / k.sum(), "valid")


def curvature(h: np.ndarray, width: int) -> np.ndarray:
    """Second derivative of a cubic fitted to the `width` values around each place; near the ends, of the cubic of the
    first or last `width` values."""
    r = width // 2
    x = np.arange(-r, r + 1)
    fit = np.linalg.pinv(np.stack([np.ones(width), x, x**2, x**3], axis=1))
    out = np.empty(len(h))
    out[r : len(h) - r] = np.lib.stride_tricks.sliding_window_view(h, width) @ (2 * fit[2])
    for part, at, to in ((h[:width], x[:r], slice(0, r)), (h[-width:], x[r + 1 :], slice(len(h) - r, len(h)))):
        c = fit @ part
        out[to] = 2 * c[2] + 6 * c[3] * at
    return out


def peaks(h: np.ndarray, least: float, apart: int) -> list[int]:
    """Local maxima (the middle of a flat one) of at least `least`; of two nearer than `apart` the higher stays."""
    found, i = [], 1
    while i < len(h) - 1:
        j = i
        while j < len(h) - 1 and h[j + 1] == h[i]:
            j += 1
        if h[i - 1] < h[i] and j < len(h) - 1 and h[j + 1] < h[i] and h[i] >= least:
            found.append((i + j) // 2)
        i = j + 1
    if apart <= 1:
        return found
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-h[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    return sorted(kept)


# Fixed values of metal_threshold: smoothing 3.0, peaks 10 levels apart, no peak above 245, a cubic over 21 levels; the
# two lowest and the highest level take their neighbour's count.
def metal_threshold(hist: DataFrame, keys: list[str], value: str, n: str, percent: int = 50) -> DataFrame:
    """(keys, threshold): where the slope of the last large peak of gray values runs out, and `percent` of the way from
    there to the brightest. hist: (keys, value 0 to 255, n). Saturated values don't count as a peak. Null without a
    peak or without a place where the slope turns."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(LEVELS)
        np.add.at(h, pdf[value].to_numpy(int), pdf[n].to_numpy(float))
        h[0] = h[1] = h[2]
        h[-1] = h[-2]
        h = smoothed(h, 3.0)
        high = peaks(h, h.max() // 2, 10)
        if high and high[-1] > 245:
            high.pop()
        bend = curvature(h, 21)
        turn = [i + 1 for i in range(high[-1], LEVELS - 1) if bend[i] < 0 <= bend[i + 1]] if high else []
        level = turn[0] + percent * (255 - turn[0]) // 100 if turn else None
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"threshold": pd.array([level], dtype="Int64")})

    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}
    counted = hist.groupBy(*keys, value).agg(F.sum(n).alias(n))
    return counted.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", threshold long")


def prominence(h: np.ndarray, peak: int) -> tuple[float, int]:
    """(height of a peak over the higher of the two valleys that part it from higher ground, place of the left valley,
    the nearest of equally deep ones)."""
    higher = np.flatnonzero(h > h[peak])
    low = higher[higher < peak].max(initial=-1) + 1
    high = higher[higher > peak].min(initial=len(h))
    left = peak - int(h[low : peak + 1][::-1].argmin())
    return float(h[peak] - max(h[left], h[peak:high].min())), left


def half_width(h: np.ndarray, peak: int) -> float:
    """Width of a peak at half its prominence, between neighbouring values by straight lines."""
    level = h[peak] - prominence(h, peak)[0] / 2
    width = 0.0
    for side in (h[peak::-1], h[peak:]):
        below = np.flatnonzero(side <= level)
        k = int(below[0]) if len(below) else len(side) - 1
        width += k - ((level - side[k]) / (side[k - 1] - side[k]) if k and side[k] < level else 0.0)
    return width


def sampled_slices(voxels: DataFrame, keys: list[str], value: str, step: int) -> DataFrame:
    """(keys, value, n, slices): values counted in every step-th slice from 0 and in the last one, which counts once more
    if it is among these; slices: how many were read."""
    last = voxels.groupBy(*keys).agg(F.max("z").alias("_last"))
    times = (F.col("z") % step == 0).cast("long") + (F.col("z") == F.col("_last")).cast("long")
    n = voxels.join(last, keys).withColumn("_t", times).where("_t > 0").groupBy(*keys, "_last", value).agg(F.sum("_t").alias("n"))
    return n.select(*keys, value, "n", (F.floor(F.col("_last") / step) + 2).cast("long").alias("slices"))


# Shares, widths and prominences by which landmarks of raw scans are told.
AIR_HEIGHT, AIR_WIDTH, VALLEY_SMOOTH, VALLEY_DEPTH = 0.5, 1.0, 5, 1.0
METAL_SMOOTH, METAL_HEIGHT, TAIL_SMOOTH, TAIL_PROMINENCE = 2.0, 0.1, 5.0, 10


def _averaged(h: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(np.pad(h, width // 2, mode="symmetric"), np.full(width, 1 / width), "valid")


def _all_peaks(h: np.ndarray) -> list[int]:
    return peaks(h, -np.inf, 1)


def raw_levels(h: np.ndarray, slices: int) -> tuple[int, int, int | None, int | None]:
    """(air, core, brightest, metal) of the histogram of a raw scan of any number of levels (256 or 65,536). Air: the
    first high peak; core: half way from there to the first valley beyond; metal: the foot, on the left, of the
    most prominent peak to the right of the last high one; None if there is none."""
    bright = np.flatnonzero(h)
    air = next((p for p in peaks(h, h.max() * AIR_HEIGHT, 1) if half_width(h, p) >= AIR_WIDTH), 0)
    rest = h.copy()
    rest[: air + 1] = 0
    low = -_averaged(rest, VALLEY_SMOOTH)
    valley = next((p for p in _all_peaks(low) if prominence(low, p)[0] >= VALLEY_DEPTH), air)
    soft = smoothed(rest, METAL_SMOOTH)
    high = peaks(soft, soft.max() * METAL_HEIGHT, 1)
    metal = None
    if high and soft.max() > 0:
        tail = smoothed(soft[high[-1] :], TAIL_SMOOTH)
        found = [(prominence(tail, p), p) for p in _all_peaks(tail)]
        found = [f for f in found if f[0][0] >= TAIL_PROMINENCE * slices]
        metal = high[-1] + max(found, key=lambda f: (f[0][0], -f[1]))[0][1] if found else None
    return int(air), int(air + valley) // 2, int(bright[-1]) if len(bright) else None, metal


def raw_landmarks(hist: DataFrame, keys: list[str], value: str, levels: int = 1 << 16) -> DataFrame:
    """(keys, air, core, brightest, metal) from sampled_slices(); a group is its distinct levels."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(levels)
        np.add.at(h, pdf[value].to_numpy(int), pdf["n"].to_numpy(float))
        found = raw_levels(h, int(pdf["slices"].iloc[0]))
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {c: pd.array([x], dtype="Int64") for c, x in zip(("air", "core", "brightest", "metal"), found)})

    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}
    return hist.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", air long, core long, brightest long, metal long")
