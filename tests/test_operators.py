"""Kernels and operators against brute force on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelweave.jobs import learning
from voxelweave.operators import experiments, linking, relational, stats, volume, windows
from voxelweave.sources import raw_volume


def flood(mask):
    """6-connected components by flood fill."""
    labels, k = np.zeros(mask.shape, int), 0
    for p in np.argwhere(mask):
        if labels[tuple(p)]:
            continue
        k += 1
        todo = [tuple(p)]
        while todo:
            q = todo.pop()
            if labels[q] or not mask[q]:
                continue
            labels[q] = k
            for axis in range(mask.ndim):
                for step in (-1, 1):
                    r = list(q)
                    r[axis] += step
                    if 0 <= r[axis] < mask.shape[axis]:
                        todo.append(tuple(r))
    return labels


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=20, deadline=None)
def test_label3d_matches_flood_fill(seed):
    mask = np.random.default_rng(seed).random((6, 7, 8)) < 0.4
    got, want = volume.label3d(mask), flood(mask)
    assert ((got > 0) == mask).all()
    pairs = set(zip(got[mask].tolist(), want[mask].tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def cube_rows(spark, cube, name="v"):
    rows = [(name, int(z), int(y), int(x), float(cube[z, y, x])) for z, y, x in np.argwhere(cube > 0)]
    return spark.createDataFrame(rows, "volume string, z long, y long, x long, v double")


def test_slabs_do_not_change_objects(spark):
    rng = np.random.default_rng(3)
    cube = np.where(rng.random((40, 16, 16)) < 0.06, rng.integers(3, 9, (40, 16, 16)), 0).astype(float)
    cube[9:12, 3:6, 3:6] = 8  # across an edge between slabs
    rows = cube_rows(spark, cube)
    results = []
    for slab in (40, 20, 6):
        found = volume.detect_slabs(rows, volume.Detection(high=6, low=3, seeds=2, extent=8, slab=slab)).collect()
        results.append(sorted((r.n_voxels, r.n_seed, round(r.centroid_z, 6), r.peak_z, r.peak_y, r.peak_x) for r in found))
    assert results[0] == results[1] == results[2] and results[0]
    labels, seed = flood(cube >= 3), flood(cube >= 6)
    want = []
    for k in range(1, labels.max() + 1):
        p = labels == k
        z = np.argwhere(p)[:, 0]
        if (cube[p] >= 6).any() and np.bincount(seed[p & (cube >= 6)]).max() >= 2 and z.max() - z.min() < 8:
            want.append(int(p.sum()))
    assert sorted(r[0] for r in results[0]) == sorted(want)


def test_streak_and_constant_volume(spark):
    cube = np.zeros((30, 4, 4))
    cube[5:25, 1, 1] = 9
    assert volume.detect_slabs(cube_rows(spark, cube), volume.Detection(high=6, low=3, seeds=1, extent=10, slab=16)).count() == 0


def test_chain_closes_and_volumes_stay_apart(spark):
    hits = spark.createDataFrame([(1, "a", 0, 0), (2, "a", 0, 0), (2, "a", 1, 0), (3, "a", 1, 0), (3, "a", 1, 0), (4, "b", 0, 0), (5, "b", 9, 9)], "candidate_id long, volume string, y int, x int")
    for make in (linking.overlap_edges, linking.star_edges):
        e = make(hits, "candidate_id", ["volume", "y", "x"])
        got = {r.candidate_id: r.component for r in linking.components(hits, e, "candidate_id").collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    seeds = spark.createDataFrame([(3,)], "id long")
    assert {r.id for r in linking.closure(e, seeds).collect()} == {1, 2, 3}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_components_match_union_find(spark, pairs):
    root = list(range(31))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = spark.createDataFrame([(i,) for i in range(31)], "id long")
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    got = {r.id: r.component for r in linking.components(nodes, edges, "id").collect()}
    assert got == {i: find(i) for i in range(31)}


def test_long_chain(spark):
    edges = spark.range(300).selectExpr("id a", "id + 1 b")
    nodes = spark.range(301)
    assert linking.components(nodes, edges, "id").where("component <> 0").count() == 0


@pytest.mark.parametrize("labels,want", [([0, 1], None), ([1, -1], 1), ([0], 0), ([4, 10], None), ([None], None), ([2, 3], 1)])
def test_ground_truth_rule(spark, labels, want):
    m = spark.createDataFrame([(1, v) for v in labels], "component long, label int")
    assert linking.component_labels(m, "label").first().ground_truth == want


def test_latest_and_propagate(spark):
    m = spark.createDataFrame([(1, 1, None), (2, 1, 4), (3, 1, 0), (4, 4, None)], "candidate_id long, component long, label int")
    d = spark.createDataFrame([(1, 2)], "candidate_id long, new int")
    got = {r.candidate_id: (r.old, r.new) for r in linking.propagate(m, "candidate_id", "label", d).collect()}
    assert got == {1: (-1, 2), 2: (4, 2)}
    assert linking.propagate(m, "candidate_id", "label", d, force=True).count() == 3
    d = spark.createDataFrame([(1, 4)], "candidate_id long, new int")
    assert linking.propagate(m, "candidate_id", "label", d).count() == 0


@given(st.lists(st.integers(-20, 20), min_size=5, max_size=25))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_clamped_window_is_always_full(spark, values):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, t int, v double")
    got = {r.t: (r.mid, r.most) for r in windows.clamped_windows(rows, ["k"], ["t"], "v", 5).collect()}
    for i in range(len(values)):
        s = max(0, min(i - 2, len(values) - 5))
        assert got[i] == (float(np.median(values[s : s + 5])), float(max(values[s : s + 5])))


def test_even_window_is_an_error(spark):
    with pytest.raises(ValueError):
        windows.clamped_windows(spark.range(3).selectExpr("0 k", "id t", "1.0 v"), ["k"], ["t"], "v", 4)


def test_auc_of_reversed_scores(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(0, float(rng.integers(0, 9)), int(rng.integers(0, 2))) for _ in range(200)], "g int, p double, y int")
    a = stats.auc(rows, "p", "y", ["g"]).first().auc
    b = stats.auc(rows.selectExpr("g", "-p p", "y"), "p", "y", ["g"]).first().auc
    assert a == pytest.approx(1 - b)
    assert stats.auc(rows.selectExpr("g", "p", "1 y"), "p", "y", ["g"]).first().auc is None


def test_exact_binomial_interval(spark):
    rows = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (0, 0)], "k long, n long")
    got = {(r.k, r.n): (round(r.low, 4), round(r.high, 4)) for r in stats.clopper_pearson(rows, "k", "n").collect()}
    assert got == {(0, 10): (0.0, 0.3085), (5, 10): (0.1871, 0.8129), (10, 10): (0.6915, 1.0), (0, 0): (0.0, 1.0)}


def test_core_of_known_mixtures(spark):
    """Spike, core and far values in known shares; the law is met whatever the spike."""
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for k, (w, mu, sd, far) in enumerate([(0.4, 0, 6, 0), (0, 0, 3, 0), (0.7, 1.5, 4, 0), (0.2, -2, 9, 0.02), (0.1, 0.3, 1.2, 0)]):
        n = 40000
        v = np.concatenate([np.zeros(int(n * w)), rng.uniform(-200, 200, int(n * far)), rng.normal(mu, sd, int(n * (1 - w - far)))])
        rows += [(str(k), int(x), int(c)) for x, c in zip(*np.unique(np.rint(v).astype(int), return_counts=True))]
        truth[str(k)] = w, mu, sd
    rows += [("none", 0, 5), ("one", 3, 9), ("flat", -3, 7), ("flat", 3, 7)]
    got = {r.g: r for r in stats.core_width(spark.createDataFrame(rows, "g string, d int, n long"), ["g"], "d", "n").collect()}
    for g, (w, mu, sd) in truth.items():
        assert got[g].sd == pytest.approx(sd, rel=0.05) and got[g].w == pytest.approx(w, abs=0.02) and got[g].mu == pytest.approx(mu, abs=0.25)
    assert set(got) == {*truth, "none", "one", "flat"} and got["none"].sd is None and got["one"].sd is None


def test_resume_groups(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 1), (None, 1), (None, 2)], "k string, id int")
    expected = spark.createDataFrame([(1,), (2,)], "id int")
    assert sorted((r.k is None, r.k) for r in relational.complete_groups(rows, ["k"], "id", expected).collect()) == [(False, "a"), (True, None)]
    assert {r.k for r in relational.complete_groups(rows, ["k"], "id").collect()} == {"a", "b", None}


def test_interpolation_beyond_the_ends(spark):
    knots = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0)], "k int, t int, v double")
    grid = spark.createDataFrame([(0, t) for t in (5, 10, 15, 20, 30)], "k int, t int")
    got = {r.t: r.v for r in windows.interpolated(grid, knots, ["k"], "t", "v").collect()}
    assert got == {5: 1.0, 10: 1.0, 15: 2.0, 20: 3.0, 30: 3.0}


def test_raw_volume_source(spark, tmp_path):
    data = np.arange(5 * 3 * 4, dtype=np.uint16)
    (tmp_path / "v.raw").write_bytes(data.tobytes())
    raw_volume.register(spark)
    df = spark.read.format("rawvolume").option("path", str(tmp_path / "v.raw")).option("volume", "v").option("height", 3).option("width", 4).option("itemsize", 2).option("slices", 2).load()
    rows = sorted(df.collect(), key=lambda r: r.z)
    assert [r.z for r in rows] == [0, 1, 2, 3, 4] and b"".join(bytes(r.bytes) for r in rows) == data.tobytes()
    assert raw_volume.infer_dtype(120, 60) == "uint16"
    with pytest.raises(ValueError):
        raw_volume.infer_dtype(100, 60)


def test_store_commits_last(spark, tmp_path):
    from voxelweave.sources.store import Store

    s = Store(spark, f"file://{tmp_path}")
    peaks = "peak_z int, peak_y int, peak_x int, centroid_z double, centroid_y double, centroid_x double"
    vox = "peak_z int, peak_y int, peak_x int, z int, y int, x int, residual int, grayscale int, in_grown int"
    one = spark.createDataFrame([(1, 2, 3, 1.0, 2.0, 3.0), (4, 5, 6, 4.0, 5.0, 6.0)], peaks)
    s.record(7, "a", one, spark.createDataFrame([(1, 2, 3, 1, 2, 3, 9, 8, 1), (4, 5, 6, 4, 5, 6, 9, 8, 1), (4, 5, 6, 4, 5, 7, 9, 8, 0)], vox))
    s.record(7, "b", one.limit(0), spark.createDataFrame([], vox))
    s.record(8, "a", one.limit(1), spark.createDataFrame([(1, 2, 3, 1, 2, 3, 9, 8, 1)], vox))
    assert sorted(r.candidate_id for r in s.visible().collect()) == [1, 2, 3]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "volume_name string")
    assert [r.volume_name for r in s.pending(names, 7).collect()] == ["c"]
    s.write("label_events", spark.createDataFrame([(1, 1, 0), (1, 5, 2), (2, 1, -1)], "candidate_id long, at long, label int"))
    assert {(r.candidate_id, r.label) for r in s.labels().collect()} == {(1, 2), (2, -1)}
    assert s.delete(7, "a") and not s.delete(99)
    assert s.read("voxels").count() == 1 and {(r.experiment_id, r.volume_name) for r in s.read("runs").collect()} == {(7, "b"), (8, "a")}
    assert s.labels().count() == 0
    # what broke off before its marker is invisible, does no harm and is replaced by the next try
    s.write("experiments", spark.createDataFrame([(8, 80)], "experiment_id long, experiment_number long").select("*", *[F.lit(None).alias(c) for c in ("slab_thickness", "high_threshold_scale", "low_threshold_scale", "baseline_method", "min_seed_voxels", "aniso_factor", "small_vol_cutoff", "z_pad", "small_z_bounds", "min_fill", "max_axial_extent_mm", "enforce_shape_gates")]))
    s.write("candidates", s.read("candidates").withColumn("volume_name", F.lit("broken")))
    assert s.flat().count() == 1 and s.visible().count() == 1
    s.record(8, "broken", one, spark.createDataFrame([], vox))
    ids = [r.candidate_id for r in s.visible().where("volume_name = 'broken'").collect()]
    assert len(ids) == 2 and min(ids) > 3
    assert s.delete(8) and s.visible().count() == 0 and s.read("experiments").count() == 0


def test_noise_scale_clips_only_the_first_bad_correlation(spark):
    from voxelweave.functions.columns import median_noise_scale

    def want(n, a, b):
        if not 0.3 <= a <= 0.7:
            a = min(max(a, 0.3), 0.7)
        else:
            b = min(max(b, 0.08), 0.18)
        return 1 - (0.48417 - 0.04204 * a + 0.16959 * a * a - 0.14318 * b + 3.06188 * a * b) / n - (-1.06974 + 8.88342 * a + 5.72699 * b) / n**2

    rows = [(0.5, 0.1), (0.2, 0.3), (0.9, 0.0), (0.4, 0.3), (0.4, 0.01)]
    d = spark.createDataFrame(rows, "a double, b double")
    got = [r.s for r in d.select(median_noise_scale(21, F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([want(21, *r) for r in rows])


def test_paired_intervals_and_signed_ranks(spark):
    d = spark.createDataFrame([(i, int(i < 12), int(i < 5 or i > 28), 1) for i in range(40)], "item long, a int, b int, c int")
    r = {(x["first"], x["second"]): x for x in stats.paired_intervals(stats.discordant_pairs(d, "item", ["a", "b", "c"])).collect()}
    ab = r["a", "b"]
    assert (ab.only_first, ab.only_second, ab["diff"]) == (7, 11, pytest.approx(-0.1))
    # the exact interval of 7 of 18 is (0.1730, 0.6425)
    assert (ab.pair_low, ab.pair_high) == (pytest.approx(18 * (2 * 0.17300 - 1) / 40, abs=2e-3), pytest.approx(18 * (2 * 0.64254 - 1) / 40, abs=2e-3))
    assert ab.pair_low_all < ab.pair_low and ab.pair_high_all > ab.pair_high and r["a", "c"].apart
    x = [1.5, -0.5, 0.0, 2.0, -2.0, 3.0, 0.5]
    t = stats.paired_tests(spark.createDataFrame([("g", v) for v in x], "g string, d double"), ["g"], "d").first()
    # ranks of sizes 0.5 0.5 1.5 2 2 3: 1.5 1.5 3 4.5 4.5 6; the negative ones sum to 6
    assert (t.n, t.w) == (7, 6.0) and t.t == pytest.approx(np.mean(x) / (np.std(x, ddof=1) / np.sqrt(7)))


def test_surface_mixture_and_axis(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=300), rng.normal(size=300)
    z = 1 + 2 * x - y + 0.5 * x * x + 0.25 * x * y - 0.75 * y * y
    d = spark.createDataFrame([("a", float(p), float(q), float(r)) for p, q, r in zip(x, y, z)], "g string, x double, y double, z double")
    c = stats.quadratic_surface(d, ["g"], "x", "y", "z").first()
    assert [c[f"c{i}"] for i in range(6)] == pytest.approx([1, 2, -1, 0.5, 0.25, -0.75])
    v = np.concatenate([rng.normal(-4, 1, 400), rng.normal(5, 2, 600)])
    m = stats.gaussian_mixture(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", 2).collect()
    assert [r.mean for r in m] == pytest.approx([-4, 5], abs=0.4) and m[0].weight == pytest.approx(0.4, abs=0.05)
    line = [("v", k, round(k * 0.2), round(-k * 0.1)) for k in range(60)]
    a = volume.axis_angles(spark.createDataFrame(line, "p string, z long, y long, x long"), ["p"], ["z", "y", "x"]).first()
    assert (a.theta, a.phi) == (pytest.approx(-np.degrees(np.arctan(0.1)), abs=0.3), pytest.approx(np.degrees(np.arctan(0.2)), abs=0.3))


def test_folds_are_whole_groups_and_scores_out_of_fold(spark):
    from voxelweave.jobs import learning

    folder = "/root/testdata/sf0.001"
    rows = learning.folds(learning.training_table(spark, folder), "component", 5)
    assert rows.groupBy("component").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    per = rows.groupBy("fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    assert len(per) == 5 and max(r.y for r in per) - min(r.y for r in per) <= 0.2 * max(r.y for r in per)
    same = learning.permuted(rows, "candidate_id", "price", 1)
    assert same.count() == rows.count() and same.agg(F.sum("price")).first()[0] == pytest.approx(rows.agg(F.sum("price")).first()[0])
    moved = rows.select("candidate_id", F.col("price").alias("was")).join(same, "candidate_id").where("was <> price").count()
    assert moved > 0.5 * rows.count()


@pytest.mark.parametrize("name", ["train_gbt", "network_scores", "logistic_coefficients", "blobs_injected"])
def test_fits_learn_something(spark, name):
    from voxelweave.jobs import catalogue

    got = catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()
    if name in ("train_gbt", "network_scores"):
        assert len(got) == 5 and all(0 < r.brier < 0.25 and r.ap > 0.6 for r in got)
    elif name == "logistic_coefficients":
        odds = {r.feature: r.odds for r in got}
        assert odds["lines"] > 1.1 and all(r.odds == pytest.approx(np.exp(r.coefficient)) for r in got)
    else:
        assert got and all(0 <= r.v <= 255 for r in got) and len({(r.volume, r.z, r.y, r.x) for r in got}) == len(got)


def test_csv_sinks(spark, tmp_path):
    from voxelweave.sources import files

    path = f"file://{tmp_path}/out"
    one = spark.createDataFrame([("v1", 7, 1.23456, None), ("v2", 8, None, "x")], "volume string, n int, at double, note string")
    files.append_csv(one, path, ["volume"])
    files.append_csv(one.where("n = 7").withColumn("at", F.lit(2.0)), path, ["volume"])
    got = {tuple(r) for r in spark.read.option("header", True).csv(path).select("volume", "n", "at", "note").collect()}
    assert got == {("v1", "7", "2.0000", None), ("v2", "8", None, "x")}
    assert [r.n for r in files.new_only(one, spark.createDataFrame([("v2",)], "volume string"), ["volume"]).collect()] == [7]


def test_rotation_geometry(spark):
    from voxelweave.operators import geometry

    m = geometry.plane_rotation(90, (1, 2))
    off = geometry.about_centre(m, (1, 3, 3))
    rows = [("a", 0, y, x, float(10 * y + x)) for y in range(3) for x in range(3)]
    v = spark.createDataFrame(rows, "p string, z long, y long, x long, v double")
    got = {(r.y, r.x): r.v for r in geometry.resampled(v, ["p"], "v", m, off).collect()}
    want = np.rot90(np.array([[10 * y + x for x in range(3)] for y in range(3)]))
    assert got == {(y, x): pytest.approx(float(want[y, x])) for y in range(3) for x in range(3)}
    assert geometry.input_box(np.eye(3), np.zeros(3), [2, 0, 0], [4, 3, 3], (9, 3, 3)) == [(0, 6), (0, 3), (0, 3)]
    assert geometry.chunk_size((100, 10, 10), 2, 0, 1000) == 5 and geometry.chunk_size((1, 100, 100), 8, 0, 10) == 1


def test_diagonal_components(spark, monkeypatch):
    monkeypatch.setattr(volume, "TILE", 2)
    rows = spark.createDataFrame([("v", 0, 0, 1), ("v", 1, 1, 2), ("v", 2, 2, 3), ("v", 2, 0, 4)], "p string, y long, x long, id long")
    got = {r.id: r.component for r in volume.labelled(rows, ["p"], ["y", "x"], "id", diagonal=True).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2 - 1}
    assert {r.component for r in volume.labelled(rows, ["p"], ["y", "x"], "id").collect()} == {1, 2, 3, 4}


def test_importance_finds_the_feature_that_matters(spark):
    from voxelweave.jobs import learning

    got = {r.feature: r["drop"] for r in learning.permutation_importance(spark, "/root/testdata/sf0.001", repeats=1, k=2).collect()}
    assert len(got) == 5 and max(got, key=got.get) == "lines"


def test_metal_threshold(spark):
    from voxelweave.operators import thresholds

    x = np.arange(256)
    h = np.rint(9000 * np.exp(-0.5 * ((x - 60) / 9) ** 2) + 6000 * np.exp(-0.5 * ((x - 130) / 10) ** 2) + 20).astype(int)
    rows = spark.createDataFrame([("a", int(v), int(n)) for v, n in zip(x, h)] + [("b", 7, 3)], "volume string, g long, n long")
    got = {r.volume: r.threshold for r in thresholds.metal_threshold(rows, ["volume"], "g", "n").collect()}
    # the slope of the second peak turns one width after it; smoothing widens both
    turn = 130 + (10**2 + 3**2) ** 0.5
    assert abs(got["a"] - (turn + (255 - turn) / 2)) <= 3
    flat = np.polyval([2, -3, 5, 1], np.linspace(0, 1, 60))
    want = np.polyval(np.polyder([2, -3, 5, 1], 2), np.linspace(0, 1, 60)) / 59**2
    assert thresholds.curvature(flat, 21) == pytest.approx(want, abs=1e-9)
    assert thresholds.peaks(np.array([0, 3, 1, 4, 4, 4, 0, 2, 0.0]), 2, 3) == [1, 4, 7] and thresholds.peaks(np.array([0, 3, 1, 4, 4, 4, 0, 2, 0.0]), 2, 4) == [4]


def test_minted_ids_are_dense_over_many_ranges(spark):
    from voxelweave.sources.store import minted

    rows = spark.range(5000).selectExpr("(id * 7919) % 5003 k", "id % 3 g").repartition(7)
    got = minted(rows, spark.createDataFrame([(41,)], "id long"), "id", ["k"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(42, 5042)) and [r.k for r in got] == sorted(r.k for r in got)


def test_running_sums_and_quantiles_of_one_large_group(spark):
    n = 20000
    d = spark.range(n).selectExpr("'a' g", "(id * 7919) % 20011 v", "id % 5 w").unionByName(spark.createDataFrame([("b", 1, 2), (None, 3, 1)], "g string, v long, w long"))
    rows = windows.running(d, ["g"], ["v"], ["w"]).orderBy("g", "v").collect()
    seen = {}
    for r in rows:
        assert r.w_before == seen.get(r.g, 0)
        seen[r.g] = r.w_before + r.w
    assert all(r.w_all == seen[r.g] for r in rows)
    v = np.array([r.v for r in rows if r.g == "a"])
    q = {r.g: r for r in windows.quantiles(d, ["g"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    assert (q["a"].low, q["a"].mid) == (pytest.approx(np.quantile(v, 0.1)), pytest.approx(np.median(v))) and q["b"].mid == 1 and q[None].mid == 3


def test_interpolation_of_a_long_series(spark):
    grid = spark.range(200000).selectExpr("1 k", "id / 2 at")
    knots = spark.range(0, 100001, 10).selectExpr("1 k", "cast(id as double) at", "cast(id * id as double) v")
    got = windows.interpolated(grid, knots, ["k"], "at", "v").agg(F.count("*").alias("n"), F.max(F.abs(F.col("v") - F.col("at") * F.col("at"))).alias("off")).first()
    assert got.n == 200000 and 0 < got.off <= 25 + 1e-6


def test_tiles_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(volume, "TILE", 4)
    rng = np.random.default_rng(3)
    mask = rng.random((13, 11, 9)) < 0.35
    at = np.argwhere(mask)
    rows = spark.createDataFrame([("v", int(z) - 5, int(y), int(x), int((z * 11 + y) * 9 + x)) for z, y, x in at], "p string, z long, y long, x long, id long")
    got = {r.id: r.component for r in volume.labelled(rows, ["p"], ["z", "y", "x"], "id").collect()}
    labels = volume.label3d(mask)
    ids = {int((z * 11 + y) * 9 + x): int(labels[z, y, x]) for z, y, x in at}
    least = {}
    for i, lab in ids.items():
        least[lab] = min(i, least.get(lab, i))
    assert got == {i: least[lab] for i, lab in ids.items()}


def test_raster_sums_and_peak(spark):
    from voxelweave.operators import simulation

    p = spark.createDataFrame([(1, 10.0, 10.0, 10.0), (2, 5.3, 6.6, 7.1)], "id long, z double, y double, x double")
    got = simulation.rastered(p, "id", ("z", "y", "x"), 1.0, 4.0).toPandas()
    assert got[got.id == 1].v.max() == pytest.approx(4.0) and got[(got.id == 1) & (got.z == 10) & (got.y == 10) & (got.x == 10)].v.item() == pytest.approx(4.0)
    assert (got.groupby("id").size() > 50).all()


def test_ar2_has_its_correlations(spark):
    from voxelweave.operators import simulation

    x = np.random.default_rng(0).standard_normal(20000)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, t int, v double")
    y = simulation.ar2(rows, ["k"], "t", "v", 0.5, 0.15).orderBy("t").toPandas().filtered.to_numpy()
    assert np.corrcoef(y[:-1], y[1:])[0, 1] == pytest.approx(0.5, abs=0.03) and np.corrcoef(y[:-2], y[2:])[0, 1] == pytest.approx(0.15, abs=0.03)
    with pytest.raises(ValueError):
        simulation.ar2(rows, ["k"], "t", "v", 0.9, 0.1)


def test_file_scans(spark, tmp_path):
    from voxelweave.sources import files

    (tmp_path / "c.toml").write_text('[[cell]]\nname = "a"\nz_min = 3\nz_max = 9\nvoxel_size = 0.01\n[[experiment]]\nexperiment_number = 6\nsmall_z_bounds = [1, 4]\nmin_fill = 0.1\n[[experiment]]\nexperiment_number = 7\n')
    got = files.config(spark, f"file://{tmp_path}/c.toml")
    assert got["cells"].first().z_max == 9 and {r.experiment_number for r in got["experiments"].collect()} == {6, 7}
    (tmp_path / "m.csv").write_text('name,sigma,n\na,"(1.0, 2.5)",3\nb,,4\n')
    rows = files.csv(spark, f"file://{tmp_path}/m.csv", "name string, sigma string, n int", ("sigma",), ["name", "sigma"]).collect()
    assert [(r.name, r.sigma) for r in rows] == [("a", [1.0, 2.5]), ("b", None)]
    (tmp_path / "p.json").write_text('{"annotations": [{"polygon": {"paths": [[{"x": 1.2, "y": 2}, {"x": 5, "y": 9.5}, {"x": 3, "y": 3}], [{"x": 0, "y": 0}]]}}]}')
    box = files.boxes(files.polygons(spark, f"file://{tmp_path}/p.json")).collect()
    assert [(b.x0, b.x1, b.y0, b.y1) for b in box] == [(-3, 9, -2, 14)]


def test_sparse_parts_match_flood():
    rng = np.random.default_rng(5)
    for share in (0.02, 0.2, 0.5):
        mask = rng.random((9, 11, 7)) < share
        for diagonal in (False, True):
            at = np.argwhere(mask)
            dense = volume.label3d(mask, diagonal)[mask]
            assert (np.unique(dense, return_inverse=True)[1] == np.unique(volume.parts(at + [100, 0, 9], diagonal), return_inverse=True)[1]).all()
    assert volume.parts(np.array([[0, 0, 5], [0, 1, 0]])).tolist() == [0, 1]  # the end of a row and the start of the next


def test_long_series_in_blocks_equal_whole_ones(spark):
    """Every window over blocks of seven rows gives what one window a series gives."""
    rng = np.random.default_rng(8)
    rows = [("long", t, float(v)) for t, v in enumerate(rng.integers(0, 60, 150))] + [("short", t, float(v)) for t, v in enumerate(rng.integers(0, 60, 3))] + [(None, t, float(t)) for t in range(20)]
    df = spark.createDataFrame([*rows, ("gap", 0, 50.0), ("gap", 1, None), ("gap", 2, 50.0)], "k string, t long, v double")
    full = df.where("v is not null")
    knots = full.where("t % 9 = 4 or t > 100 and t % 40 = 0")
    both = {
        "clamped": lambda **n: windows.clamped_windows(full, ["k"], ["t"], "v", 5, **n),
        "clamped_wide": lambda **n: windows.clamped_windows(full, ["k"], ["t"], "v", 11, **n),
        "sliding": lambda **n: windows.sliding_mean(full, ["k"], ["t"], "v", 9, **n),
        "smooth": lambda **n: windows.gaussian_smooth(full, ["k"], ["t"], "v", 1.5, **n),
        "noise": lambda **n: windows.difference_noise(full, ["k"], ["t"], "v", **n),
        "contiguity": lambda **n: windows.contiguity(full, ["k"], ["t"], "v", 20, 0.2, 4, **n),
        "interpolated": lambda **n: windows.interpolated(full.select("k", "t"), knots, ["k"], "t", "v", **n),
        "islands": lambda **n: windows.islands(df, ["k"], ["t"], "v", 10, 40, long=n.get("long", windows.SERIES)),
    }
    tidy = lambda d: sorted((tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in d.collect()), key=repr)
    for name, f in both.items():
        whole, blocks = tidy(f()), tidy(f(long=10, size=7))
        assert whole == blocks and whole, name
    # the case of a gap: a missing value ends a run
    assert windows.islands(df, ["k"], ["t"], "v", 10, 40).where("k = 'gap'").count() == 2
    assert windows.sliding_mean(full.where("t < 0"), ["k"], ["t"], "v", 2).count() == 0


def test_running_sums_of_few_rows_are_the_same(spark):
    df = spark.createDataFrame([(k, t, t * t % 7) for k in ("a", None) for t in range(40)], "k string, t long, v long")
    assert sorted(map(repr, windows.running(df, ["k"], ["t"], ["v"]).collect())) == sorted(map(repr, windows.running(df, ["k"], ["t"], ["v"], few=1000).collect()))
    assert sorted(map(repr, windows.running(df, ["k"], ["t"], ["v"], few=10).collect())) == sorted(map(repr, windows.running(df, ["k"], ["t"], ["v"]).collect()))


def test_carried_totals_do_not_grow_with_the_groups(spark, monkeypatch):
    """Of 3,000 groups only those that reach over an edge between ranges have totals; sums are those of plain windows."""
    carried = []
    write = windows.cut

    def counted(df, tag):
        out = write(df, tag)
        if tag == "totals":
            carried.append(out.count())
        return out

    monkeypatch.setattr(windows, "cut", counted)
    many = spark.range(9000).selectExpr("if(id % 3000 = 7, null, id % 3000) k", "id t", "if(id % 3000 = 9, null, id % 11) v")
    large = spark.range(9000, 15000).selectExpr("1500L k", "id t", "if(id < 14000, null, id % 7) v")
    both, joined = many.unionByName(large), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")  # else tables so small are one range
    try:
        rows = sorted(map(repr, windows.running(both, ["k"], ["t"], ["v"]).collect()))
    finally:
        spark.conf.unset(joined)
    assert rows == sorted(map(repr, windows._summed(both, ["k"], ["t"], ["v"]).collect())) and len(rows) == 15000
    assert 2 <= carried[0] <= 2 * (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1)


def test_recall_by_size_bands_and_intervals(spark):
    """Counts by hand; interval ends satisfy the binomial tails that define them."""
    rng = np.random.default_rng(2)
    objects = [(i, float(rng.integers(0, 9)), [1, 0, None][i % 3], float(rng.integers(-5, 40)), int(rng.random() < 0.6), int(rng.random() < 0.3)) for i in range(200)]
    objects += [(200, None, 1, 3.0, 1, 1), (201, 5.0, 0, None, 1, 0)]
    df = spark.createDataFrame(objects, "id long, size double, truth int, radial double, a int, b int")
    got = {(r.level, r.window): r for r in experiments.recall_intervals(experiments.recall_by_size(df, ["a", "b"], "size", "truth", [0, 4]), 2).collect()}
    tail = lambda p, n, lo, hi: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(lo, hi + 1))
    for level in (0.0, 4.0):
        here = [o for o in objects if o[1] is not None and o[1] >= level]
        for w, at in (("a", 4), ("b", 5)):
            r = got[level, w]
            assert (r.n, r.hits) == (sum(o[2] == 1 for o in here), sum(o[2] == 1 and o[at] for o in here))
            assert (r.n_false, r.false_hits) == (sum(o[2] == 0 for o in here), sum(o[2] == 0 and o[at] for o in here))
            for alpha, low, high in ((0.05, r.low, r.high), (0.025, r.low_all, r.high_all)):
                assert abs(tail(low, r.n, r.hits, r.n) - alpha / 2) < 1e-6 and abs(tail(high, r.n, 0, r.hits) - alpha / 2) < 1e-6
    bands = {(r.level, r.band): r for r in experiments.radial_bands(df, "radial", "size", "truth", [4], [0, 10, 30]).collect()}
    false = [o for o in objects if o[1] is not None and o[1] >= 4 and o[2] == 0]
    for band, lo, hi in ((0, 0, 10), (1, 10, 30)):
        r, inside = bands[4.0, band], [o for o in false if o[3] is not None and lo <= o[3] < hi]
        assert r.n_false == len(inside) and abs(r.of_false - len(inside) / len(false)) < 1e-12 and abs(r.of_band - len(inside) / (len(inside) + r.n_true)) < 1e-12
    assert len(bands) == 2 and experiments.recall_by_size(df.where("id < 0"), ["a"], "size", "truth", [0]).count() == 0


def test_rank_codes_and_outer_labels(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 2.0), (3, None), (4, 4.0), (5, float("nan")), (6, -1.0)], "k int, v double")
    assert {r.k: r.code for r in experiments.rank_codes(df, "v").collect()} == {1: 2, 2: 1, 3: None, 4: 2, 5: None, 6: 0}
    image = [("a", 2, 0, 3), ("a", 2, 3, 5), ("a", 0, 2, 5), ("a", 4, 2, 3), ("a", 0, 0, 9), ("b", 1, 1, 7), ("c", 2, 2, 0), ("d", 2, 1, 8)]
    rows = spark.createDataFrame(image, "k string, y int, x int, label int")
    # a: 3 and 5 twice each, so the smaller; b has labels beside the centre lines only; d is the only one, first and last
    assert sorted(tuple(r) for r in experiments.outer_label_vote(rows, ["k"], "label", 5, 5).collect()) == [("a", 3, 2), ("d", 8, 2)]


def test_peak_views_match_flood(spark):
    """A view's noise, thresholds and parts against flood fill, with and without a least area of cores."""
    rng = np.random.default_rng(4)
    image = np.where(rng.random((20, 20)) < 0.5, rng.integers(3, 16, (20, 20)), 0).astype(float)
    image[7:10, 11:14] = 14
    y, x = np.unravel_index(image.argmax(), image.shape)
    noise = min(2.7, np.sort(image[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].ravel())[-2:].mean() / 4.2)
    rows = spark.createDataFrame([("a", int(i), int(j), float(image[i, j]), int(i * 20 + j)) for i in range(20) for j in range(20)], "k string, y int, x int, v double, id long")
    peaks = spark.createDataFrame([("a", int(y), int(x))], "k string, y int, x int")
    low, high = image > 2.8 * noise, image > 4 * noise
    grown, cores = volume.label3d(low, True), volume.label3d(high, True)
    for area in (1, 4):
        large = np.isin(cores, [c for c in np.unique(cores[cores > 0]) if (cores == c).sum() >= area])
        want = np.argwhere(np.isin(grown, np.unique(grown[large & high])) & low)
        got = experiments.peak_views(rows, peaks, "k", "v", "id", area).collect()
        assert sorted((r.y, r.x) for r in got) == sorted(map(tuple, want.tolist())) and got


def test_held_out_auc_leaves_each_group_out(spark):
    """Against a penalised logistic fit by Newton's steps on all other groups; a group of one class gives no row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, len(learning.FEATURES)))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=240) > 0).astype(int)
    group = [[*"abcd", None][i % 5] for i in range(240)] + ["one"] * 6
    x, y = np.vstack([x, rng.normal(size=(6, x.shape[1]))]), np.append(y, [1] * 6)
    rows = spark.createDataFrame([(g, int(c), *map(float, v)) for g, c, v in zip(group, y, x)], ["volume", "y", *learning.FEATURES])
    got = {r.held: (r.n, r.positives, r.auc) for r in learning.held_out_auc(rows, "volume", learning.penalised_logistic).collect()}
    assert set(got) == {*"abcd", None}
    group = np.array([g or "-" for g in group])
    for g in [*"abcd", "-"]:
        fit, held = group != g, group == g
        mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0, ddof=1)
        a, b = np.c_[np.ones(fit.sum()), (x[fit] - mean) / sd], np.zeros(x.shape[1] + 1)
        ridge = np.diag([0.0] + [1.0] * x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-a @ b))
            b -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y[fit]) + ridge @ b)
        s = np.c_[np.ones(held.sum()), (x[held] - mean) / sd] @ b
        up, down = s[y[held] == 1], s[y[held] == 0]
        auc = ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / up.size / down.size
        n, positives, have = got[None if g == "-" else g]
        assert (n, positives) == (held.sum(), y[held].sum()) and abs(have - auc) < 0.005
    with pytest.raises(ValueError):
        learning.held_out_auc(rows, "volume", learning.penalised_logistic, most=3)


def test_training_windows_and_cleaning(spark):
    every = learning.training_table(spark, "/root/testdata/sf0.001")
    some = learning.training_table(spark, "/root/testdata/sf0.001", windows=[1996, 1997])
    assert some.count() == every.where("window in (1996, 1997)").count() > 0
    # weights are of the pool, not of the whole table: a component's add up to 1
    assert all(abs(r[0] - 1) < 1e-9 for r in some.groupBy("component").agg(F.sum("weight")).select("sum(weight)").collect())
    dirty = spark.createDataFrame([(float("inf"), 1.0), (float("nan"), 2.0), (None, -float("inf"))], "quantity double, price double")
    assert [tuple(r) for r in learning.cleaned(dirty, ["quantity", "price"]).collect()] == [(0.0, 1.0), (0.0, 2.0), (0.0, 0.0)]
