"""Recursive filters and spline resampling against NumPy."""

import numpy as np
import pytest

from voxelweave.operators import geometry, recursive


def matrix_of_splines(n):
    """Values of a cubic spline at its knots from its coefficients, mirrored at the ends."""
    m = np.zeros((n, n))
    for i in range(n):
        for o, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            j = abs(i + o)
            m[i, 2 * n - 2 - j if j >= n else j] += w
    return m if n > 1 else np.ones((1, 1))


@pytest.mark.parametrize("size", [16, 4096])
def test_coefficients_equal_a_linear_solve(spark, size):
    """Long series are cut into blocks (of 16 rows here) that carry states; one series holds most rows."""
    rng = np.random.default_rng(1)
    series = {k: rng.standard_normal(n) for k, n in enumerate((1, 2, 3, 15, 16, 31, 32, 33, 500))}
    rows = [(k, int(i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    got = recursive.spline_coefficients(spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in rows], "k long, i long, v double"), ["k"], "i", "v", max(size, 2)).collect()
    for k, x in series.items():
        mine = np.array([r["v"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["i"])])
        want = np.linalg.solve(matrix_of_splines(len(x)), x)
        assert np.abs(mine - want).max() < (1e-6 if size == 16 and len(x) > 31 else 1e-9)


def test_carried_states_equal_one_sweep(spark):
    """A pole near one, where what is carried over many blocks matters; in both directions."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal(2000)
    rows = spark.createDataFrame([("a", int(i), float(v)) for i, v in enumerate(x)] + [(None, 0, 5.0)], "k string, i long, v double")
    b = recursive.blocks(rows, ["k"], ["i"], 64)
    assert b.where("k = 'a'").select("_block").distinct().count() == 31
    for backward in (False, True):
        got = {(r["k"], r["i"]): r["filtered"] for r in recursive.carried(b, ["k"], "v", 0.999, lambda first, n: first[0], backward).collect()}
        y, state = np.empty(2000), 0.0
        for i in range(1999, -1, -1) if backward else range(2000):
            state = x[i] + 0.999 * state
            y[i] = state
        assert max(abs(got["a", i] - y[i]) for i in range(2000)) < 1e-9 and got[None, 0] == 5.0


def naive(volume, matrix, offset):
    """Every place of the output from all coefficients of the input."""
    c = volume.astype(float)
    for axis in range(3):
        c = np.moveaxis(np.linalg.solve(matrix_of_splines(c.shape[axis]), np.moveaxis(c, axis, 0).reshape(c.shape[axis], -1)).reshape(np.moveaxis(c, axis, 0).shape), 0, axis)
    out = np.zeros(volume.shape)
    for p in np.ndindex(volume.shape):
        at = matrix @ np.array(p) + offset
        at = np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at)
        if (at < 0).any() or (at > np.array(volume.shape) - 1).any():
            continue
        w = []
        for i in range(3):
            row = np.zeros(volume.shape[i])
            for j in range(int(np.floor(at[i])) - 1, int(np.floor(at[i])) + 3):
                d = abs(at[i] - j)
                b = (2 - d) ** 3 / 6 - (4 * (1 - d) ** 3 / 6 if d < 1 else 0) if d < 2 else 0.0
                n = volume.shape[i]
                k = abs(j) % (2 * n - 2)
                row[2 * n - 2 - k if k >= n else k] += b
            w.append(row)
        out[p] = np.einsum("i,j,k,ijk", *w, c)
    return out


def test_rotation_by_splines(spark):
    rng = np.random.default_rng(3)
    shape = (7, 11, 9)
    v = rng.integers(0, 200, shape).astype(float)
    v[rng.random(shape) < 0.2] = 0  # left out of the table
    rows = [("v", *map(int, p), float(v[p])) for p in np.ndindex(shape) if v[p]]
    table = spark.createDataFrame(rows, "volume string, z long, y long, x long, g double")
    turn = geometry.plane_rotation(17.0, (1, 2)) @ geometry.plane_rotation(6.0, (0, 2))
    for matrix, offset in ((turn, geometry.about_centre(turn, shape)), (np.eye(3), np.zeros(3)), (np.eye(3), np.array([0.5, -1.25, 2.0]))):
        got = np.full(shape, np.nan)
        for r in recursive.resampled_spline(table, ["volume"], "g", matrix, offset, shape, tile=5).collect():
            got[r["z"], r["y"], r["x"]] = r["g"]
        assert np.abs(got - naive(v, matrix, offset)).max() < 1e-6
