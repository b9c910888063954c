"""Stored volumes, morphology, local objects, landmarks, noise models and turned boxes against NumPy."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.jobs import stages
from voxelweave.operators import geometry, morphology, stats, thresholds
from voxelweave.sources import files, raw_volume, residual_store, settings, store


def table(spark, cube, name="v"):
    rows = [(name, *map(int, p), float(cube[p])) for p in np.ndindex(cube.shape)]
    return spark.createDataFrame(rows, "volume string, z long, y long, x long, v double")


# ---------------------------------------------------------------- stored volumes


def slices(spark, depth=40, dtype="uint16"):
    rng = np.random.default_rng(1)
    cube = rng.integers(0, 1000, (depth, 6, 5)).astype(dtype)
    rows = [("a", z, 6, 5, dtype, cube[z].tobytes()) for z in range(depth)] + [("b", z, 6, 5, dtype, cube[z].tobytes()) for z in (3, 7)]
    return cube, spark.createDataFrame(rows, raw_volume.RawVolume.schema(None))


def test_written_volume_reads_back(spark, tmp_path):
    cube, rows = slices(spark)
    path = str(tmp_path / "vol")
    raw_volume.write_volume(rows, path)
    back = raw_volume.read_volume(spark, path, slices=7)
    got = {(r["volume"], r["z"]): bytes(r["bytes"]) for r in back.collect()}
    assert got == {(v, z): cube[z].tobytes() for v, z in [("a", z) for z in range(40)] + [("b", 3), ("b", 7)]}
    # appended slices join the others; a slice that is there is an error and changes nothing
    more = spark.createDataFrame([("b", 8, 6, 5, "uint16", cube[8].tobytes())], rows.schema)
    raw_volume.write_volume(more, path, "append")
    with pytest.raises(Exception, match="twice"):
        raw_volume.write_volume(more, path, "append")
    assert raw_volume.read_volume(spark, path).count() == 43
    v = raw_volume.as_voxels(raw_volume.read_volume(spark, path).where("volume = 'a'"))
    assert v.agg(F.sum("v")).first()[0] == cube.sum()


def test_failed_attempts_leave_nothing_to_read(spark, tmp_path):
    """A task that breaks off and runs again, and a job that is aborted."""
    cube, rows = slices(spark)
    data = [r.asDict() for r in rows.where("volume = 'a'").collect()]
    writer = raw_volume._Writer(str(tmp_path / "vol"), True)

    def broken():
        yield from data[:5]
        raise OSError("lost executor")

    with pytest.raises(OSError):
        writer.write(broken())
    again, other = writer.write(iter(data[20:])), writer.write(iter(data[:20]))
    writer.commit([again, None, other])
    assert sum(f.endswith(".raw") for f in os.listdir(tmp_path / "vol")) == 3
    manifest = json.loads((tmp_path / "vol" / raw_volume.MANIFEST).read_text())
    assert [p["slices"][0] for p in manifest] == [0, 20]
    got = raw_volume.read_volume(spark, str(tmp_path / "vol")).collect()
    assert sorted((r["z"], bytes(r["bytes"])) for r in got) == [(z, cube[z].tobytes()) for z in range(40)]
    lost = writer.write(iter(data[:3]))
    writer.abort([lost])
    assert sum(f.endswith(".raw") for f in os.listdir(tmp_path / "vol")) == 3
    with pytest.raises(ValueError, match="bytes"):
        writer.write(iter([{**data[0], "bytes": b"x"}]))
    with pytest.raises(ValueError, match="differ"):
        writer.write(iter([data[0], {**data[1], "h": 5, "w": 6}]))


def test_ranges_choose_partitions(spark, tmp_path):
    _, rows = slices(spark)
    path = str(tmp_path / "vol")
    raw_volume.write_volume(rows, path)
    every = raw_volume.read_volume(spark, path, slices=4)
    few = raw_volume.read_volume(spark, path, slices=4, first=10, last=13)
    assert few.rdd.getNumPartitions() <= 2 and every.rdd.getNumPartitions() >= 10
    assert sorted(r["z"] for r in few.collect()) == [10, 11, 12, 13]
    # filters on one table don't disturb each other
    assert (every.where("z = 3").count(), every.count(), every.where("z in (3, 39)").count(), every.where("z < 0").count()) == (2, 42, 3, 0)


def test_pushed_filters_choose_partitions(spark, tmp_path):
    """Each query loads its own table."""
    _, rows = slices(spark)
    path = str(tmp_path / "vol")
    raw_volume.write_volume(rows, path)
    pushed = lambda where: raw_volume.read_volume(spark, path, slices=4, push=True).where(where)
    assert pushed("volume = 'a' and z between 10 and 13").rdd.getNumPartitions() <= 2
    assert sorted(r["z"] for r in pushed("volume = 'a' and z between 10 and 13").collect()) == [10, 11, 12, 13]
    assert sorted(r["z"] for r in pushed("z in (3, 39)").collect()) == [3, 3, 39]
    assert [r["z"] for r in pushed("z > 38").collect()] == [39] and pushed("z < 0").count() == 0 and pushed("h = 6").count() == 42


def test_residual_ranges_read_their_files_only(spark, tmp_path):
    path = str(tmp_path / "res")
    rows = spark.range(100 * 12).selectExpr("concat('v', id % 2) volume", "cast(id div 12 as int) z", "cast(id % 12 as int) y", "0 x", "cast(id % 500 - 200 as int) r", "cast(id % 256 as int) g")
    residual_store.write_residuals(rows, path)
    got = residual_store.read_residuals(spark, path, 30, 39, ["v1"])
    want = {tuple(r) for r in rows.where("volume = 'v1' and z between 30 and 39").collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "z_range" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(z,30)" in plan
    files = {f.split("/z_range=")[1].split("/")[0] for f in got.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files == {"1", "2"}  # slices 16 to 47
    assert residual_store.read_residuals(spark, path).count() == 1200
    with pytest.raises(Exception, match="ranges"):
        residual_store.read_residuals(spark, path, slices=8).collect()


# ---------------------------------------------------------------- morphology


def shifted(mask, step):
    big = np.pad(mask, 3)
    return np.roll(big, step, (0, 1, 2))


def test_morphology_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((32, 32, 32)) < 0.25
    mask[:10, :10, :10] = True
    rows = spark.createDataFrame([("m", *map(int, p)) for p in np.argwhere(mask)], "volume string, z long, y long, x long")
    cell = [(0, 0, 0), (0, 0, 1), (1, 0, 0)]
    for steps in (morphology.ball(1), cell):
        wide = np.any([shifted(mask, s) for s in steps], axis=0)
        thin = np.all([np.roll(wide, tuple(-o for o in s), (0, 1, 2)) for s in steps], axis=0)
        small = np.all([np.roll(np.pad(mask, 3), tuple(-o for o in s), (0, 1, 2)) for s in steps], axis=0)
        open_ = np.any([np.roll(small, s, (0, 1, 2)) for s in steps], axis=0)
        for f, want in ((morphology.dilated, wide), (morphology.closed, thin), (morphology.eroded, small), (morphology.opened, open_)):
            got = {(r["z"], r["y"], r["x"]) for r in f(rows, ["volume"], steps).collect()}
            assert got == {tuple(int(c) - 3 for c in p) for p in np.argwhere(want)}
    assert len(morphology.ball(1)) == 7 and len(morphology.ball(1.5, 2)) == 9


def test_local_objects(spark):
    """A blob with a hole on a slope is found whole whatever its place; noise alone gives none."""
    rng = np.random.default_rng(6)
    cube = rng.normal(100, 2, (40, 40, 40)) + np.arange(40)[None, :, None]
    for p in morphology.ball(2):
        cube[20 + p[0], 19 + p[1], 17 + p[2]] += 60
    cube[20, 19, 17] += 5
    cube[20, 19, 18] -= 62  # a hole beside the centre
    cube[3, 38, 38] += 80  # near a corner
    points = [(1, "v", 21, 19, 17), (2, "v", 3, 39, 39), (3, "v", 30, 5, 30), (4, "v", 90, 90, 90)]
    got = morphology.extracted(table(spark, cube), spark.createDataFrame(points, "point long, volume string, z long, y long, x long"), "v").collect()
    per = {k: [r for r in got if r["point"] == k] for k in (1, 2, 3, 4)}
    blob = per[1]
    assert {(r["z"], r["y"], r["x"]) for r in blob} == {(20, 19, 17)} and 33 <= blob[0]["n_voxels"] <= 36  # noise beside it may join
    assert {(r["dy"], r["dx"]) for r in blob} >= {(b, c) for _, b, c in morphology.ball(2)}
    assert 1.5 < blob[0]["noise"] < 2.5 and max(r["strength"] for r in blob) == pytest.approx(65, abs=6)
    assert per[2][0]["n_voxels"] >= 1 and (per[2][0]["y"], per[2][0]["x"]) == (38, 38)
    assert len(per[3]) == 1 and per[3][0]["n_voxels"] == 0 and not per[4]


# ---------------------------------------------------------------- landmarks


def test_landmarks_of_three_shapes():
    """Air and material humps, with and without metal, of 256 and of 65,536 levels."""
    for levels, unit in ((256, 1), (65536, 200)):
        x = np.arange(levels) / unit
        hump = lambda at, wide, n: n * np.exp(-0.5 * ((x - at) / wide) ** 2)
        air, material, metal = hump(40, 4, 9000), hump(120, 10, 4000), hump(220, 5, 300)
        h = np.floor(air + material + metal)
        a, core, top, foot = thresholds.raw_levels(h, 5)
        assert a == 40 * unit
        assert 40 * unit < core < 120 * unit and top == np.flatnonzero(h)[-1]
        assert 130 * unit < foot < 220 * unit
        without = thresholds.raw_levels(np.floor(air + material), 5)
        assert without[0] == 40 * unit and without[3] is None
        assert thresholds.raw_levels(np.zeros(levels), 5) == (0, 0, None, None)


def test_prominence_and_width():
    h = np.array([0, 5, 2, 9, 1, 1, 4, 0, 3, 3, 0], float)
    assert thresholds.peaks(h, 0, 1) == [1, 3, 6, 8]
    assert thresholds.prominence(h, 3) == (9.0, 0) and thresholds.prominence(h, 1)[0] == 3.0
    assert thresholds.prominence(h, 6) == (3.0, 5) and thresholds.prominence(h, 8) == (3.0, 7)
    triangle = np.array([0, 0, 4, 0, 0], float)
    assert thresholds.half_width(triangle, 2) == pytest.approx(1.0)
    wide = np.array([0, 2, 4, 2, 0], float)
    assert thresholds.half_width(wide, 2) == pytest.approx(2.0)


def test_landmarks_from_voxels(spark):
    rng = np.random.default_rng(2)
    cube = np.where(rng.random((21, 30, 30)) < 0.6, rng.normal(40, 4, (21, 30, 30)), rng.normal(140, 8, (21, 30, 30))).round().clip(0, 255)
    h = thresholds.sampled_slices(table(spark, cube), ["volume"], "v", 5)
    seen = np.concatenate([cube[[0, 5, 10, 15, 20]], cube[20:]]).ravel().astype(int)
    assert {int(r["v"]): r["n"] for r in h.collect()} == {int(v): int(n) for v, n in zip(*np.unique(seen, return_counts=True))}
    got = thresholds.raw_landmarks(h, ["volume"], "v", 256).first()
    assert (got["air"], got["core"], got["brightest"], got["metal"]) == thresholds.raw_levels(np.bincount(seen, minlength=256).astype(float), 6)


# ---------------------------------------------------------------- noise models, intervals, boxes


def test_least_eigenvalue_equals_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(n, float(rng.uniform(-0.9, 0.9)), float(rng.uniform(-0.6, 0.6))) for n in range(1, 101)]
    t = spark.createDataFrame(rows, "n int, a double, b double")
    got = t.withColumn("least", stats.least_eigenvalue(F.col("n"), F.col("a"), F.col("b"))).collect()
    for r in got:
        m = np.eye(r["n"]) + sum(c * (np.eye(r["n"], k=k) + np.eye(r["n"], k=-k)) for k, c in ((1, r["a"]), (2, r["b"])))
        assert r["least"] == pytest.approx(np.linalg.eigvalsh(m)[0], abs=1e-9)


@pytest.mark.parametrize("theta, phi", [(0.0, 0.0), (12.0, 0.0), (0.0, -9.0), (25.0, 7.0)])
def test_valid_intervals_equal_a_point_test(spark, theta, phi):
    shape, margin = (9, 14, 17), 1.0
    maps = geometry.aligned_maps(shape, theta, phi)
    lines = spark.createDataFrame([(z, y) for z in range(9) for y in range(14)], "z long, y long")
    for r in geometry.valid_intervals(lines, shape, maps, margin).collect():
        good = []
        for x in range(17):
            ok = True
            for m, o, axes in maps:
                at = m @ np.array([r["z"], r["y"], x]) + o
                ok &= all(-1e-9 + (margin if i in axes else 0) <= at[i] <= n - 1 - (margin if i in axes else 0) + 1e-9 for i, n in enumerate(shape))
            if ok:
                good.append(x)
        assert list(range(r["x_min"], r["x_max"])) == good


def test_top_in_turned_boxes_equals_ranking_all(spark):
    rng = np.random.default_rng(9)
    cube = rng.integers(0, 50, (30, 30, 30)).astype(float)  # many ties
    m = geometry.plane_rotation(30, (1, 2))
    o = geometry.about_centre(m, (30, 30, 30))
    points = [(g, "v", *map(int, rng.integers(5, 25, 3))) for g in range(6) for _ in range(4)] + [(9, "v", 500, 0, 0)] + [(7, "v", 0, 0, 0), (7, "v", 29, 29, 29)]
    boxes = geometry.moved_boxes(spark.createDataFrame(points, "g int, volume string, z long, y long, x long"), ["g", "volume"], m, o, 2, (30, 30, 30))
    got = geometry.top_in_boxes(table(spark, cube), boxes, ["g"], "volume", "v", 7).collect()
    assert 9 not in {r["g"] for r in got}
    for g in (*range(6), 7):
        p = np.round(np.array([q[2:] for q in points if q[0] == g]) @ m.T + o, 9)
        low, high = np.maximum(np.floor(p.min(0)) - 2, 0), np.minimum(np.ceil(p.max(0)) + 2, 29)
        inside = [q for q in itertools.product(range(30), repeat=3) if (np.array(q) >= low).all() and (np.array(q) <= high).all()]
        want = sorted(inside, key=lambda q: (-cube[q], q))[:7]
        assert [(r["z"], r["y"], r["x"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want


def test_blending_equals_dense_arrays(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (12, 10)).astype(float)
    stamp = np.zeros((12, 10))
    stamp[0:3, 7:10] = rng.uniform(0, 90, (3, 3))  # at a corner: the blur is mirrored there
    bell = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    bell /= bell.sum()
    soft = np.pad(stamp, 2, mode="symmetric")
    soft = np.apply_along_axis(np.convolve, 0, soft, bell, "valid")
    soft = np.apply_along_axis(np.convolve, 1, soft, bell, "valid")
    want = np.clip(np.rint(image + 0.75 * soft * stamp.max() / soft.max()), 0, 255)
    pixels = spark.createDataFrame([("a", *map(int, p), float(image[p])) for p in np.ndindex(image.shape)], "k string, y long, x long, v double")
    marks = spark.createDataFrame([("a", *map(int, p), float(stamp[p])) for p in np.ndindex(stamp.shape) if stamp[p]] + [("a", -3, 4, 500.0)], "k string, y long, x long, strength double")
    for r in morphology.blended(pixels, marks, ["k"], "v", (12, 10)).collect():
        assert r["v"] == want[r["y"], r["x"]]
    with pytest.raises(ValueError):
        morphology.blended(pixels, marks, ["k"], "v", (12, 10), blur=0.5)


CELL = """[[cell]]
name = "a"
z_min = 1
z_max = 90
voxel_size = 0.0164
form_factor = "round"
nominal_diameter_mm = 18.0
nominal_height_mm = 65.0
voxels_x = 10
voxels_y = 10

[[experiment]]
experiment_number = 7
slab_thickness = 5
high_threshold_scale = 4.0
low_threshold_scale = 2.99
baseline_method = "median"
min_seed_voxels = 2
aniso_factor = 1.5
small_vol_cutoff = 5
z_pad = 1
small_z_bounds = %s
max_axial_extent_mm = 0.15
"""


def test_settings_of_cells_and_experiments(spark, tmp_path):
    for name, bounds in (("good", "[1, 4]"), ("bad", "[1]")):
        (tmp_path / f"{name}.toml").write_text(CELL % bounds)
    got = files.config(spark, f"file://{tmp_path}/good.toml")
    r = settings.accessors(got["cells"], got["experiments"]).first()
    assert (r.z_extent_max, r.diameter, r.height, r.small_z_low, r.small_z_high, r.slab_thickness) == (math.ceil(0.15 / 0.0164), round(18 / 0.0164), round(65 / 0.0164), 1, 4, 5)
    bad = files.config(spark, f"file://{tmp_path}/bad.toml")
    with pytest.raises(Exception, match="two numbers"):
        settings.accessors(bad["cells"], bad["experiments"]).collect()
    numbers = spark.createDataFrame([(7, 3)], "experiment_number long, experiment_id long")
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.write("experiments", settings.experiment_rows(got["experiments"], numbers, 0.25, False), "overwrite")
    e = s.read("experiments").first()
    assert (e.experiment_id, e.min_fill, e.enforce_shape_gates, e.small_z_bounds, e.baseline_method) == (3, 0.25, False, [1, 4], "median")
    with pytest.raises(ValueError, match="z_pad"):
        settings.experiment_rows(got["experiments"].drop("z_pad"), numbers, 0.25, False)


def test_sweep_from_arguments(spark):
    plain = settings.Sweep()
    same, got = settings.from_arguments(plain, [])
    assert same == plain and not got.dry_run
    new, got = settings.from_arguments(plain, ["--noise-seeds", "1", "2", "--voxels-z", "8", "--phi-angles-deg", "0.5", "--dry-run"])
    assert (new.noise_seeds, new.voxels_z, new.phi_angles_deg, new.bit_depths) == ((1, 2), 8, (0.5,), plain.bit_depths) and got.dry_run
    c = new.conditions(spark)
    assert c.count() == c.drop("voxels_z").distinct().count() == 2 * 2 * 1 * 1 * 3 * 11 * 1 and c.where("voxels_z = 8 and measurement_top_k = 7").count() == c.count()


def test_stages_log_and_stop(spark, tmp_path):
    v = spark.createDataFrame([("a", 0, 1), ("a", 1, 5)], "volume string, z long, g long")
    steps = [stages.Step("twice", lambda t: t.withColumn("g", F.col("g") * 2)), stages.Step("off", lambda t: t.limit(0), on=False), stages.Step("more", lambda t: t.withColumn("g", F.col("g") + 1))]
    log = f"file://{tmp_path}/log"
    for k in range(2):
        code, out = stages.staged(v, steps, "in", f"file://{tmp_path}/out{k}", log, {"depth": 8})
        assert code == 0 and sorted(r.g for r in out.collect()) == [3, 11]

    def refuse(t):
        raise stages.Invalid("too deep")

    assert stages.staged(v, [*steps, stages.Step("refuse", refuse)], "in", f"file://{tmp_path}/none", log) == (1, None)
    runs = spark.read.parquet(log).collect()
    assert len(runs) == 2 and all(set(r.seconds) == {"twice", "more", "save"} and r.settings == {"depth": "8"} and r.total >= max(r.seconds.values()) for r in runs)
    with pytest.raises(Exception, match="exists"):
        stages.staged(v, steps, "in", f"file://{tmp_path}/out0", log)


def test_csv_rows_are_added_or_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    for replace, want in ((True, 1), (False, 2), (False, 3), (True, 1)):
        files.append_csv(spark.createDataFrame([(1, 0.5)], "k int, v double"), path, ["k"], replace=replace)
        assert [r.v for r in spark.read.csv(path, header=True).collect()] == ["0.5000"] * want
