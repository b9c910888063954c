"""Recursive filters along a series: blocks of rows, states carried from block to block, a second pass; cubic splines
and resampling by them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.storage import checked_broadcast, cut
from voxelweave.operators.windows import running

AXES = ["z", "y", "x"]
#: Rows of a block, and about the rows that one group of a kernel holds. The last block of a series has up to twice
#: as many; a series of fewer rows is one block.
BLOCK = 4096


def blocks(rows: DataFrame, keys: list[str], order: list[str], size: int = BLOCK) -> DataFrame:
    """rows with _i, their number in the series, _n, its length, _block, _blocks, the number of these, and _bucket.
    Sorted ranges carry the counts, so a series of any length takes many tasks; buckets deal many short
    series, or some blocks of a long one, to a group."""
    numbered = running(rows.withColumn("_one", F.lit(1)), keys, order, ["_one"])
    i, n = F.col("_one_before"), F.col("_one_all")
    many = F.greatest(F.floor(n / size), F.lit(1))
    out = numbered.select(*rows.columns, i.cast("long").alias("_i"), n.cast("long").alias("_n"), F.least(F.floor(i / size), many - 1).alias("_block"), many.alias("_blocks"))
    buckets = max(1, math.ceil(rows.count() / size))
    return cut(out.withColumn("_bucket", F.pmod(F.xxhash64(*keys, "_block"), F.lit(buckets))), "blocks")


def _side_by_side(t: pd.DataFrame, keys: list[str], value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows as (values by place and block, block of each row, place of each row, first row of each block)."""
    unit = t.groupby([*keys, "_block"], sort=False, dropna=False).ngroup().to_numpy()
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    place = np.arange(len(unit)) - first[unit]
    x = np.zeros((place.max() + 1, unit.max() + 1))
    x[place, unit] = t[value]
    return x, unit, place, first


def _kinds(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def carried(blocked: DataFrame, keys: list[str], value: str, pole: float, start: Callable[[np.ndarray, int], float], backward: bool = False) -> DataFrame:
    """Rows of blocks() with `filtered`: y[k] = x[k] + pole y[k - 1] along each series (backward: y[k + 1]), and the first
    y is start(first values of the series in that direction, its length).

    A block's last y is its own one, from a state of zero, plus a power of the pole times the last y of the block before.
    Own ones are found for all blocks at once and carried along a series by its blocks (one row each); a second pass
    filters each block from where the one before ends. Series of one block go through that pass only.
    """
    names = blocked.columns

    def swept(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Filtered values of all blocks of a group, each from its carried state or, where a series begins, from start()."""
        t = pdf.assign(_at=-pdf["_i"] if backward else pdf["_i"]).sort_values([*keys, "_block", "_at"], kind="stable")
        x, unit, place, first = _side_by_side(t, keys, value)
        size, n = np.bincount(unit), t["_n"].to_numpy()[first]
        begins = np.flatnonzero(t["_block"].to_numpy()[first] == (t["_blocks"].to_numpy()[first] - 1 if backward else 0))
        state = t["_state"].fillna(0.0).to_numpy()[first].astype(float) if "_state" in t else np.zeros(len(first))
        y = np.empty_like(x)
        for k in range(len(x)):
            state = x[k] + pole * state
            if k == 0:
                state[begins] = [start(x[: size[b], b], int(n[b])) for b in begins]
            y[k] = state
        return t, y, unit, place, first

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, unit, _, first = swept(pdf)
        size = np.bincount(unit)
        return t.iloc[first][[*keys, "_block"]].assign(own=y[size - 1, np.arange(len(size))], size=size)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ascending=not backward)
        state, before = 0.0, []
        for own, size in zip(pdf["own"], pdf["size"]):
            before.append(state)
            state = own + pole ** int(size) * state
        return pdf[[*keys, "_block"]].assign(_state=before)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, unit, place, _ = swept(pdf)
        return t.assign(filtered=y[place, unit])[[*names, "filtered"]]

    place = _kinds(blocked, [*keys, "_block"])
    own = blocked.where("_blocks > 1").groupBy("_bucket").applyInPandas(ends, f"{place}, own double, size long")
    states = cut(own.groupBy(*keys).applyInPandas(carry, f"{place}, _state double"), "states")
    joined = blocked.join(checked_broadcast(states), [*keys, "_block"], "left")
    return joined.groupBy("_bucket").applyInPandas(final, f"{_kinds(blocked, names)}, filtered double")


# Pole and gain of the cubic B-spline's inverse.
POLE, GAIN = math.sqrt(3) - 2, 6.0
#: Values after which the pole's powers are below the precision of doubles.
FADED = 40


def _forward_start(x: np.ndarray, n: int) -> float:
    """Sum over the series mirrored at its first and last value."""
    if n == 1:
        return float(x[0])
    if n > FADED or len(x) < n:
        m = min(FADED, len(x))
        return float(POLE ** np.arange(m) @ x[:m])
    k = np.arange(1, n - 1)
    inner = (POLE**k + POLE ** (2 * n - 2 - k)) @ x[1 : n - 1]
    return float((x[0] + POLE ** (n - 1) * x[n - 1] + inner) / (1 - POLE ** (2 * n - 2)))


def _backward_start(x: np.ndarray, n: int) -> float:
    return float(-x[0] / (GAIN * POLE)) if n == 1 else float((x[0] + POLE * x[1]) / (1 - POLE**2))


def spline_coefficients(rows: DataFrame, keys: list[str], axis: str, value: str, size: int = BLOCK) -> DataFrame:
    """rows with value replaced by the coefficients of the cubic spline through the values along axis, mirrored at both
    ends. Rows of keys are one series without gaps."""
    b = blocks(rows.withColumn(value, F.col(value).cast("double") * GAIN), keys, [axis], size)
    one = carried(b, keys, value, POLE, _forward_start)
    one = cut(one.withColumn(value, -POLE * F.col("filtered")).drop("filtered"), "forward")
    two = carried(one, keys, value, POLE, _backward_start, backward=True)
    return two.select(*[F.col("filtered").alias(c) if c == value else F.col(c) for c in rows.columns])


def dense(voxels: DataFrame, keys: list[str], value: str, shape: tuple[int, int, int]) -> DataFrame:
    """Every place of a volume of that shape with its value, 0 where the table has none."""
    grid = voxels.select(*keys).distinct()
    for c, n in zip(AXES, shape):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    known = voxels.select(*keys, *[F.col(c).cast("long").alias(c) for c in AXES], F.col(value).cast("double").alias(value))
    return grid.join(known, [*keys, *AXES], "left").select(*keys, *AXES, F.coalesce(value, F.lit(0.0)).alias(value))


def _weights(t: np.ndarray) -> np.ndarray:
    """The cubic B-spline at the four places around a position, t beyond the second of them."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, 3 * (1 - t) ** 3 - 6 * (1 - t) ** 2 + 4, t**3]) / 6


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def resampled_spline(voxels: DataFrame, keys: list[str], value: str, matrix: np.ndarray, offset: np.ndarray, shape: tuple[int, int, int], tile: int = 24) -> DataFrame:
    """(keys, z, y, x, value): a volume of `shape` whose places read the input at matrix @ place + offset, by cubic splines
    along all axes; 0 where that lies outside the input. matrix must be invertible.

    Coefficients are found along one axis after the other. Then each input voxel goes to the tiles of the output that
    may read it (its place carried forward, with the reach of a spline), and a tile is one group of bounded size.
    """
    c = dense(voxels, keys, value, shape)
    for axis in AXES:
        c = spline_coefficients(c, [*keys, *[a for a in AXES if a != axis]], axis, value)
    back = np.linalg.inv(matrix)
    reach = np.abs(back).sum(axis=1) * 2 + 1e-6
    for i, a in enumerate(AXES):
        at = sum((float(back[i, j]) * (F.col(o) - float(offset[j])) for j, o in enumerate(AXES[1:], 1)), float(back[i, 0]) * (F.col("z") - float(offset[0])))
        last = (shape[i] - 1) // tile
        low, high = F.floor((at - float(reach[i])) / tile), F.floor((at + float(reach[i])) / tile)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(last))
        c = c.withColumn(f"_{a}", F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))
    for a in AXES:
        c = c.withColumn(f"_{a}", F.explode(f"_{a}"))

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[AXES].to_numpy()
        low = known.min(axis=0)
        cube = np.zeros(known.max(axis=0) - low + 1)
        cube[tuple((known - low).T)] = pdf[value]
        corner = [int(pdf[f"_{a}"].iloc[0]) * tile for a in AXES]
        grid = np.stack(np.meshgrid(*[np.arange(s, min(s + tile, n)) for s, n in zip(corner, shape)], indexing="ij"), axis=-1).reshape(-1, 3)
        at = grid @ matrix.T + offset
        near = np.rint(at)
        at = np.where(np.abs(at - near) < 1e-9, near, at)
        inside = ((at >= 0) & (at <= np.array(shape) - 1)).all(axis=1)
        at, out = at[inside], np.zeros(len(grid))
        base = np.floor(at).astype(int)
        w = [_weights(at[:, i] - base[:, i]) for i in range(3)]
        total = np.zeros(len(at))
        for steps in itertools.product(range(4), repeat=3):
            weight = w[0][steps[0]] * w[1][steps[1]] * w[2][steps[2]]
            index = [_mirrored(base[:, i] + s - 1, shape[i]) - low[i] for i, s in enumerate(steps)]
            used = weight != 0
            total[used] += weight[used] * cube[tuple(i[used] for i in index)]
        out[inside] = total
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(grid) for k in keys} | {a: grid[:, i] for i, a in enumerate(AXES)} | {value: out})

    schema = f"{_kinds(voxels, keys)}, z long, y long, x long, `{value}` double"
    return c.groupBy(*keys, *[f"_{a}" for a in AXES]).applyInPandas(read, schema)
