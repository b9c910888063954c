"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Review label codes.
FALSE_POSITIVE, TRUE_POSITIVES, NEEDS_REVIEW, UNREVIEWED = 0, (1, 2, 3), 4, (-1, 10)


def safe_ratio(after: Column, before: Column) -> Column:
    """after / before; null if before is 0 or either is missing, NaN or infinite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    a, b = after.cast("double"), before.cast("double")
    return F.when(finite(a) & finite(b) & (b != 0), a / b)


def clean(value: Column, default: float = 0.0) -> Column:
    """value, or default where it is null, NaN or infinite."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def ground_truth_label(labels: Column) -> Column:
    """1 if the set holds a true-positive code and no 0, 0 for the reverse, else null."""
    tp = F.arrays_overlap(labels, F.array(*[F.lit(c) for c in TRUE_POSITIVES]))
    fp = F.array_contains(labels, F.lit(FALSE_POSITIVE))
    tp, fp = F.coalesce(tp, F.lit(False)), F.coalesce(fp, F.lit(False))
    return F.when(tp & ~fp, 1).when(fp & ~tp, 0).cast("int")


def right_closed_bin(p: Column, bins: int = 10) -> Column:
    """Number (from 1) of the right-closed bin of p in [0, 1]; 0 belongs to the first."""
    return F.when(p <= 1 / bins, 1).otherwise(F.ceil(F.round(p * bins, 9))).cast("int")


def axial_ok(z: Column, y: Column, x: Column, n: Column, fill: Column, lo: int, hi_small: int, cutoff: int, factor: float, pad: float, min_fill: float) -> Column:
    """Shape gate in two regimes: small objects by axial extent alone, larger ones by aspect and fill."""
    return F.when(z < lo, False).when(n < cutoff, z <= hi_small).otherwise((z <= F.least(y, x) * factor + pad) & (fill >= min_fill))


def physical(features: dict[str, str], s: Column) -> Iterable[Column]:
    """Voxel measures in mm by kind: volume (s^3), length (s), area (s^2)."""
    power = {"length": 1, "area": 2, "volume": 3}
    return [(F.col(name) * F.pow(s, F.lit(power[kind]))).alias(f"{name}_mm") for name, kind in features.items()]


# Coefficients of the fitted noise scale (constant, r1, r1^2, r2, r1 r2; constant, r1, r2) and the
# ranges of both correlations that the fit covers.
SCALE_N = (0.48417, -0.04204, 0.16959, -0.14318, 3.06188)
SCALE_N2 = (-1.06974, 8.88342, 5.72699)
R1_RANGE, R2_RANGE = (0.30, 0.70), (0.08, 0.18)


def median_noise_scale(n: int, rho1: Column, rho2: Column) -> Column:
    """Sigma of a value minus the median of its n neighbours (itself included), in units of the noise, from the
    correlations at lags 1 and 2. Outside the fitted range one correlation is clipped: the first, or else
    the second."""
    bad1 = (rho1 < R1_RANGE[0]) | (rho1 > R1_RANGE[1])
    r1 = F.greatest(F.least(rho1, F.lit(R1_RANGE[1])), F.lit(R1_RANGE[0]))
    r2 = F.when(bad1, rho2).otherwise(F.greatest(F.least(rho2, F.lit(R2_RANGE[1])), F.lit(R2_RANGE[0])))
    a, b = SCALE_N, SCALE_N2
    one = a[0] + a[1] * r1 + a[2] * r1 * r1 + a[3] * r2 + a[4] * r1 * r2
    return 1 - one / n - (b[0] + b[1] * r1 + b[2] * r2) / (n * n)


def mean_residual_scale(n: int, rho1: Column, rho2: Column) -> Column:
    """Sigma of a value minus the mean of its n-1 neighbours under two lags of correlation."""
    inside = n * n - n * (1 + 2 * (rho1 + rho2)) - 2 * (rho1 + 2 * rho2)
    return F.sqrt(F.greatest(inside, F.lit(0.0))) / (n - 1)


def rescale(v: Column, lo: float, hi: float, out_max: int) -> Column:
    """Linear rescale of [lo, hi] to [1, out_max], clipped, rounded half to even."""
    t = (F.greatest(F.least(v.cast("double"), F.lit(float(hi))), F.lit(float(lo))) - lo) / (hi - lo)
    return F.bround(1 + t * (out_max - 1), 0).cast("int")


def first_quadrant(angle: Column) -> Column:
    """Angle of a line folded into [0, 90] degrees."""
    a = F.pmod(angle.cast("double"), F.lit(180.0))
    return F.least(a, 180.0 - a)


def portal_yx(y: Column, x: Column, height: int) -> tuple[Column, Column]:
    """Raw row and column as the portal shows them: upside down."""
    return F.lit(height - 1) - y, x


def slab_range(portal_z: Column, size_mm: float, thickness: float = 1.0, pad: float = -0.5) -> tuple[Column, Column]:
    """First and last slice of a slab around a portal position, rounded half to even."""
    start = (portal_z - pad) / size_mm
    return F.bround(start, 0).cast("long"), F.bround(start + thickness / size_mm, 0).cast("long")


# Largest depths that a volume of one and of two bytes a voxel may seem to have.
DEPTH_1, DEPTH_2 = 6000, 12000


def infer_depth(size: Column, height: int, width: int) -> tuple[Column, Column]:
    """Slices and bytes a voxel of a raw volume of so many bytes: what would be too deep for one byte a voxel
    has two or four."""
    plain = F.floor(size / (height * width)).cast("long")
    wide = F.when(plain <= DEPTH_1, 1).when(plain <= DEPTH_2, 2).otherwise(4)
    return F.floor(plain / wide).cast("long"), wide


def displayed(v: Column, lo: Column, hi: Column) -> Column:
    """Gray value for the screen: contrast 1.2, brightness 10, clipped, truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255 * (1.2 * (v - lo) / (hi - lo) + 10 / 255))).cast("int")


def rescaled_to(v: Column, lo: Column, hi: Column, top: int) -> Column:
    """v from its range to [0, top], truncated; a range of one value gives 0."""
    return F.coalesce(F.floor(safe_ratio(v - lo, hi - lo) * top), F.lit(0)).cast("int")
