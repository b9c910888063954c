"""Outlines, circles and insides of masks against flood fill and a singular value decomposition in NumPy."""

from collections import Counter, deque

import numpy as np
import pytest

from voxelweave.operators import contours, volume


def reached(mask):
    """Places that the frame reaches over faces without crossing the mask."""
    h, w = mask.shape
    big = np.pad(mask, 1)
    out = np.zeros_like(big)
    todo = deque([(0, 0)])
    out[0, 0] = True
    while todo:
        y, x = todo.popleft()
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            a, b = y + dy, x + dx
            if 0 <= a < h + 2 and 0 <= b < w + 2 and not big[a, b] and not out[a, b]:
                out[a, b] = True
                todo.append((a, b))
    return out[1:-1, 1:-1]


def masks():
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[:90, :80]
    found = []
    for k in range(10):
        cy, cx, r, thick = rng.uniform(35, 50), rng.uniform(35, 45), rng.uniform(15, 33), rng.uniform(2, 5)
        d = np.hypot(yy - cy, xx - cx)
        m = (d < r) & (d > r - thick)
        m |= rng.random(m.shape) < 0.02  # specks inside, outside and on the ring
        if k % 3 == 0:
            m[int(cy), :] |= d[int(cy), :] < r  # a bar across the hole
        found.append(m)
    found += [np.zeros((5, 5), bool), np.ones((3, 4), bool), np.eye(6, dtype=bool), np.array([[1, 0, 1], [0, 0, 0], [1, 1, 1]], bool)]
    return found


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(str(k), 0, int(y), int(x)) for k, m in enumerate(masks()) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "volume string, slab long, y long, x long").cache()


def taubin(points):
    """Taubin's fit by the singular values of the design itself."""
    p = np.array(points, float)
    mean = p.mean(axis=0)
    q = p - mean
    z = (q**2).sum(axis=1)
    zm = z.mean()
    v = np.linalg.svd(np.column_stack([(z - zm) / (2 * np.sqrt(zm)), q]), full_matrices=False)[2][-1]
    a = v[0] / (2 * np.sqrt(zm))
    centre = -v[1:] / a / 2
    return *(centre + mean), np.sqrt((centre**2).sum() + zm)


def test_outside_and_borders(spark, pixels):
    keys = ["volume", "slab"]
    out = contours.outside(pixels, keys)
    outer = {k: set() for k in range(14)}
    for r in out.collect():
        outer[int(r["volume"])].add((r["y"], r["x"]))
    steps = {}
    for r in contours.outlines(pixels, keys).collect():
        steps.setdefault(int(r["volume"]), []).append(((r["y"], r["x"]), (r["next_y"], r["next_x"]), r["component"]))
    for k, m in enumerate(masks()):
        free = reached(m)
        ys, xs = np.nonzero(m)
        if len(ys):
            box = np.zeros_like(m)
            box[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = True
            assert {(y, x) for y, x in outer[k] if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and box[y, x]} == {tuple(map(int, p)) for p in np.argwhere(free & box)}
        mine = steps.get(k, [])
        # steps join end to end: as many leave each pixel as reach it, and they run along set pixels beside the outside
        assert Counter(a for a, _, _ in mine) == Counter(b for _, b, _ in mine)
        beside = {(y, x) for y, x in np.argwhere(m).tolist() if any((y + a, x + b) in outer[k] for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        lone = {p for p in beside if not any((p[0] + a, p[1] + b) in set(map(tuple, np.argwhere(m).tolist())) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)}
        assert {a for a, _, _ in mine} == beside - lone
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b, _ in mine)


def test_circles_equal_a_singular_value_fit(spark, pixels):
    keys = ["volume", "slab"]
    steps = contours.outlines(pixels, keys)
    areas = contours.enclosed_areas(steps, keys).collect()
    best = {}
    for r in areas:
        now = (r["area"], -r["component"])
        best[r["volume"]] = max(best.get(r["volume"], now), now)
    points = {}
    for r in steps.collect():
        if best[r["volume"]][1] == -r["component"]:
            points.setdefault(r["volume"], []).append((r["y"], r["x"]))
    chosen = [(v, 0, *p) for v, ps in points.items() for p in ps]
    got = {r["volume"]: r for r in contours.taubin_circles(spark.createDataFrame(chosen, pixels.schema), keys).collect()}
    for v in map(str, range(10)):
        y, x, r = taubin(points[v])
        assert (got[v]["yc"], got[v]["xc"], got[v]["r"]) == pytest.approx((y, x, r), abs=1e-6)
        assert got[v]["points"] == len(points[v])
    assert got["11"]["r"] == pytest.approx(taubin(points["11"])[2], abs=1e-6)
    assert got["12"]["r"] is None  # a diagonal: points on a line


def test_polygon_area_of_simple_shapes(spark):
    keys = ["volume", "slab"]
    square = [("s", 0, y, x) for y in range(5) for x in range(7)] + [("d", 0, y, x) for y in range(9) for x in range(9) if abs(y - 4) + abs(x - 4) <= 4]
    hollow = [("h", 0, y, x) for y in range(6) for x in range(6) if y in (0, 5) or x in (0, 5)] + [("h", 0, 2, 2), ("h", 0, 2, 3)]
    got = {(r["volume"], r["area"], r["points"]) for r in contours.enclosed_areas(contours.outlines(spark.createDataFrame(square + hollow, "volume string, slab long, y long, x long"), keys), keys).collect()}
    assert got == {("s", 24.0, 20), ("d", 32.0, 16), ("h", 25.0, 20)}


def test_can_gates_detection(spark):
    """A bright ring in every slice: objects inside are found, those outside are dropped and the circle is the ring's."""
    yy, xx = np.mgrid[:64, :64]
    d = np.hypot(yy - 31.5, xx - 30.5)
    rows = []
    for z in range(20):
        g = np.where((d < 25) & (d > 21), 220, 40)
        rows += [("a", z, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(g)]
    blobs = [(5, 30, 30), (15, 33, 25), (6, 2, 2), (15, 60, 61)]
    table = {r[:4]: r for r in rows}
    for z, y, x in blobs:
        for dz in (0, 1):
            table["a", z + dz, y, x] = ("a", z + dz, y, x, 150.0)
    voxels = spark.createDataFrame(list(table.values()), "volume string, z long, y long, x long, v double")
    circles, inside = contours.can_geometry(voxels, "v", 10, 190, 10, 20, (64, 64))
    for c in circles.collect():
        assert (c["yc"], c["xc"]) == pytest.approx((31.5, 30.5), abs=0.2) and 24 < c["r"] < 27
    assert circles.count() == 2
    strong = voxels.where("v between 100 and 190")
    cfg = volume.Detection(high=100, low=90, seeds=1, extent=5, slab=10)
    every = volume.detect_slabs(strong, cfg)
    found = contours.radial_position(volume.detect_slabs(contours.gated(strong, inside, 10), cfg), circles, 10).collect()
    assert every.count() == 4 and {(r["peak_y"], r["peak_x"]) for r in found} == {(30, 30), (33, 25)}
    assert all(0 <= r["radial_pos"] < 0.5 for r in found)
    none = spark.createDataFrame([("b", 3, 1, 1, 5.0)], voxels.schema)
    circles, inside = contours.can_geometry(none, "v", 10, 190, 10)
    assert circles.count() == 0 and inside.count() == 0 and contours.gated(none, inside, 10).count() == 1


def test_metal_mask(spark):
    m = np.zeros((12, 12))
    m[2:5, 2:5] = 200  # large enough
    m[5, 5] = 160  # below the threshold, within the margin, over a corner
    m[9, 9] = 200  # too small
    rows = [("a", 0, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(m)]
    t = spark.createDataFrame(rows, "volume string, slab long, y long, x long, v double")
    got = {(r["y"], r["x"]) for r in contours.metal_mask(t, ["volume", "slab"], "v", 180, 4).collect()}
    assert got == {(y, x) for y in range(2, 5) for x in range(2, 5)}
    core = got | {(5, 5)}
    got = {(r["y"], r["x"]) for r in contours.metal_mask(t, ["volume", "slab"], "v", 180, 4, 30, (12, 6)).collect()}
    assert got == {(y + a, x + b) for y, x in core for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) if x + b < 6}


def test_candidate_rows_of_known_objects(spark):
    """Axes, surface, seeds and radial position of a rod and of two joined balls in a can."""
    from voxelweave.operators import candidates

    cells = {(z, 10, 10): (9, 40.0) for z in range(5, 12)}  # a rod along z
    for c in (20, 24):  # two seeds joined by weaker voxels
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                cells[8, 12 + a, c + b] = (5 if a or b else 9, 60.0)
    cells[8, 12, 22] = (4, 60.0)
    rows = []
    for z, y, x in np.ndindex(16, 24, 32):
        snr, g = cells.get((z, y, x), (0.5, 10.0))
        rows.append(("v", z, y, x, int((z * 24 + y) * 32 + x), g, float(snr), float(snr)))
    voxels = spark.createDataFrame(rows, "volume string, z long, y long, x long, id long, g double, r double, snr double").cache()
    objects = volume.hysteresis(voxels, ["volume"], ["z", "y", "x"], "snr", 3.0, 8.0, "id").cache()
    circles = spark.createDataFrame([("v", 0, 10.0, 10.0, 20.0, 99)], "volume string, slab long, yc double, xc double, r double, points long")
    rod, pair = candidates.candidate_rows(voxels, objects, "id", 8.0, 100.0, (24, 32), circles).orderBy("component").collect()
    assert (rod["n_voxels"], rod["z_extent"], rod["fill"], rod["surface_ratio"], rod["n_seed"], rod["n_seed_regions"]) == (7, 7, 1.0, 1.0, 7, 1)
    assert rod["axis_z"] == pytest.approx(1) and rod["l1"] == pytest.approx(4 + 1 / 12) and rod["l3"] == pytest.approx(1 / 12) and rod["radial_pos"] == 0
    assert rod["seed_offset"] == 0 and rod["edge_contrast"] == pytest.approx(8.5) and rod["decay_drop"] == 0 and rod["gs_contrast"] == pytest.approx(30)
    assert (pair["n_voxels"], pair["n_seed"], pair["n_seed_regions"], pair["n_seed_total"]) == (19, 1, 2, 2)
    assert pair["normal_z"] == pytest.approx(1) and pair["seed_offset"] == pytest.approx(2) and pair["r_peak"] == 9
    assert pair["radial_pos"] == pytest.approx(np.hypot(2, 12) / 20) and pair["seed_grown_ratio"] == pytest.approx(18 / (18 + 16 * 5 + 4))
    far = candidates.candidate_rows(voxels, objects, "id", 8.0, 100.0, (24, 32)).orderBy("component").first()
    assert far["radial_pos"] == pytest.approx(np.hypot(2, 6))


def test_candidate_rows_broadcast_nothing_by_object(spark, monkeypatch):
    """Objects in many volumes: the rows of one pass are those of the features taken alone, and where no table counts as
    small, all that the last plan broadcasts are the carried totals of one ranking."""
    from pyspark.sql import functions as F

    from voxelweave.functions import storage
    from voxelweave.operators import candidates, residual, windows

    v = spark.range(60 * 1000).selectExpr(
        "concat('v', id div 1000) volume", "id div 100 % 10 z", "id div 10 % 10 y", "id % 10 x", "id", "pmod(hash(id), 200) g", "pmod(hash(id, 1), 90) - 45 r", "pmod(hash(id, 1), 90) / 18.0D - 2.5D snr"
    ).cache()
    objects = storage.cut(volume.hysteresis(v, ["volume"], ["z", "y", "x"], "snr", 1.6, 2.2, "id"), "objects")
    assert objects.select("component").distinct().count() > 500
    taken = []
    monkeypatch.setattr(storage, "is_small", lambda df, rows=0: False)
    monkeypatch.setattr(windows, "is_small", lambda df, rows=0: False)
    write = windows.cut
    monkeypatch.setattr(windows, "cut", lambda df, tag: taken.append((tag, out := write(df, tag))) or out)
    got = candidates.candidate_rows(v, objects, "id", 2.2, 190.0, (10, 10))
    plan = got._jdf.queryExecution().executedPlan().toString()  # tables so small are under Spark's own limit
    assert plan.count("BroadcastHashJoin") == sum(tag == "totals" for tag, _ in taken) == 1
    names = ["edge_contrast", "decay_drop", "gs_median", "gs_p90", "gs_peak", "gs_iqr", "gs_shell_median", "gs_contrast"]
    apart = residual.shell_features(v, objects, "id").join(residual.grayscale_features(v, objects, "id", 190.0), "component")
    tidy = lambda d: sorted(map(tuple, d.select("component", *[F.col(c).cast("double") for c in names]).collect()))
    assert tidy(got) == tidy(apart)
