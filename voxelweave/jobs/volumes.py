"""Queries over voxel volumes: cans, stored residuals, resampling, closing, landmarks."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions.storage import cut, scratch
from voxelweave.jobs.registry import query, r6
from voxelweave.jobs.scans import HIGH, METAL, RESIDUAL, RINGS, SCAN, WIDTH, _found, _walk
from voxelweave.operators import candidates, contours, geometry, morphology, recursive, residual, stats, thresholds
from voxelweave.sources import raw_volume, residual_store
from voxelweave.sources.tables import EDGE, cube, scan

AXES = ["z", "y", "x"]
CUBE = """cube AS (SELECT volume, z, y, x, sum(q)::BIGINT::DOUBLE v, (((n * 128 + z) * 24 + y) * 24 + x)::BIGINT id FROM (SELECT l_returnflag || '-' || (l_partkey // 2000) volume,
          l_partkey // 2000 * 32 + ascii(l_returnflag) - 64 n, ((l_shipdate::DATE - DATE '1990-01-01') // 42)::BIGINT z, l_partkey % 2000 // 84 y, l_suppkey % 24 x, l_quantity q FROM lineitem)
          GROUP BY volume, n, z, y, x)"""

# ---------------------------------------------------------------- cans

SLAB, BRIGHT, MARGIN, AREA = 32, 80, 30, 3


def _parts(rows: str, name: str) -> str:
    """SQL of the parts of rows (volume, slab, y, x), connected over corners: (volume, slab, p, component)."""
    return f"""{name}_p AS (SELECT *, y * 24 + x p FROM {rows}), {name}_w(volume, slab, p, q) AS (SELECT volume, slab, p, p FROM {name}_p UNION
          SELECT w.volume, w.slab, w.p, b.p FROM {name}_w w JOIN {name}_p a ON w.volume = a.volume AND w.slab = a.slab AND w.q = a.p
          JOIN {name}_p b ON a.volume = b.volume AND a.slab = b.slab AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
          {name} AS (SELECT volume, slab, p, min(q) component FROM {name}_w GROUP BY ALL)"""


def _flood(blocked: str, name: str) -> str:
    """SQL of the places of a frame around the plane that its corner reaches over faces without entering `blocked`."""
    return f"""{name}(volume, slab, y, x) AS (SELECT DISTINCT volume, slab, -1::BIGINT, -1::BIGINT FROM {blocked} UNION SELECT o.volume, o.slab, o.y + sy, o.x + sx FROM {name} o CROSS JOIN dirs
          WHERE o.y + sy BETWEEN -1 AND 24 AND o.x + sx BETWEEN -1 AND 24 AND (o.volume, o.slab, o.y + sy, o.x + sx) NOT IN (SELECT (volume, slab, y, x) FROM {blocked}))"""


CAN = f"""{CUBE}, dirs(sy, sx, wy, wx) AS (VALUES (-1, 0, 0, 1), (0, 1, 1, 0), (1, 0, 0, -1), (0, -1, -1, 0)), sl AS (SELECT *, z // {SLAB} slab FROM cube),
          span AS (SELECT volume, slab, min(z) z0, max(z) - min(z) + 1 nz FROM sl GROUP BY 1, 2),
          proj AS (SELECT volume, slab, y, x, max(v) v FROM sl JOIN span USING (volume, slab) WHERE z - z0 < 3 OR z - z0 BETWEEN nz // 2 - 1 AND nz // 2 + 1 OR z - z0 >= nz - 3 GROUP BY 1, 2, 3, 4),
          hot AS (SELECT * FROM proj WHERE v > {BRIGHT}), warm AS (SELECT * FROM proj WHERE v > {BRIGHT - MARGIN}), {_parts("hot", "seed")}, {_parts("warm", "low")},
          big AS (SELECT volume, slab, p FROM seed WHERE (volume, slab, component) IN (SELECT (volume, slab, component) FROM seed GROUP BY volume, slab, component HAVING count(*) >= {AREA})),
          held AS (SELECT volume, slab, p // 24 y, p % 24 x FROM low WHERE (volume, slab, component) IN (SELECT (volume, slab, component) FROM low JOIN big USING (volume, slab, p))),
          metal AS (SELECT DISTINCT volume, slab, y, x FROM (SELECT * FROM held UNION ALL SELECT volume, slab, y + sy, x + sx FROM held CROSS JOIN dirs) WHERE y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23),
          {_parts("metal", "part")}, {_flood("metal", "free")},
          ahead AS (SELECT m.volume, m.slab, m.y, m.x, m.y + wy + CASE WHEN c.y IS NULL THEN 0 ELSE sy END ny, m.x + wx + CASE WHEN c.y IS NULL THEN 0 ELSE sx END nx
             FROM metal m CROSS JOIN dirs JOIN free o ON o.volume = m.volume AND o.slab = m.slab AND o.y = m.y + sy AND o.x = m.x + sx
             LEFT JOIN metal c ON c.volume = m.volume AND c.slab = m.slab AND c.y = m.y + sy + wy AND c.x = m.x + sx + wx
             LEFT JOIN metal a ON a.volume = m.volume AND a.slab = m.slab AND a.y = m.y + wy AND a.x = m.x + wx WHERE c.y IS NOT NULL OR a.y IS NOT NULL),
          border AS (SELECT ahead.*, component FROM ahead JOIN part ON part.volume = ahead.volume AND part.slab = ahead.slab AND part.p = ahead.y * 24 + ahead.x),
          areas AS (SELECT volume, slab, component, count(*) points, abs(sum(x * ny - nx * y)) / 2 area FROM border GROUP BY 1, 2, 3),
          best AS (SELECT volume, slab, component, points, area FROM areas QUALIFY row_number() OVER (PARTITION BY volume, slab ORDER BY area DESC, component) = 1),
          can AS (SELECT volume, slab, p // 24 y, p % 24 x FROM part JOIN best USING (volume, slab, component)), {_flood("can", "around")},
          plane AS (SELECT volume, slab, y.range y, x.range x FROM best CROSS JOIN range(24) y CROSS JOIN range(24) x),
          inside AS (SELECT volume, slab, y, x FROM plane WHERE (volume, slab, y, x) NOT IN (SELECT (volume, slab, y, x) FROM around))"""
CIRCLE = f"""{CAN}, mid AS (SELECT b.volume, b.slab, avg(x) mx, avg(y) my FROM border b JOIN best USING (volume, slab, component) GROUP BY 1, 2),
          uv AS (SELECT volume, slab, mx, my, x - mx u, y - my v, (x - mx) * (x - mx) + (y - my) * (y - my) w FROM border JOIN best USING (volume, slab, component) JOIN mid USING (volume, slab)),
          mom AS (SELECT volume, slab, any_value(mx) mx, any_value(my) my, count(*) n, avg(w) w, covar_pop(w, w) / (4 * avg(w)) a, covar_pop(w, u) / (2 * sqrt(avg(w))) b, covar_pop(w, v) / (2 * sqrt(avg(w))) c,
             covar_pop(u, u) d, covar_pop(u, v) e, covar_pop(v, v) f FROM uv GROUP BY 1, 2),
          q AS (SELECT *, (a + d + f) / 3 q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) p FROM mom WHERE n > 2),
          l AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) l FROM q),
          k AS (SELECT *, [b * e - c * (d - l), c * b - (a - l) * e, (a - l) * (d - l) - b * b] k1, [b * (f - l) - c * e, c * c - (a - l) * (f - l), (a - l) * e - b * c] k2,
             [(d - l) * (f - l) - e * e, e * c - b * (f - l), b * e - (d - l) * c] k3 FROM l),
          g AS (SELECT *, CASE WHEN list_inner_product(k1, k1) >= greatest(list_inner_product(k2, k2), list_inner_product(k3, k3)) THEN k1 WHEN list_inner_product(k2, k2) >= list_inner_product(k3, k3) THEN k2 ELSE k3 END k FROM k)"""


def _can(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return contours.can_geometry(cube(spark, d).select("volume", *AXES, "v"), "v", SLAB, BRIGHT, AREA, MARGIN, (EDGE, EDGE))


@query(f"""WITH RECURSIVE {CIRCLE} SELECT volume, slab, n points, n_inside, round(my - k[3] / k[1] * sqrt(w), 4) yc, round(mx - k[2] / k[1] * sqrt(w), 4) xc,
       round(sqrt((k[2] / k[1]) ** 2 * w + (k[3] / k[1]) ** 2 * w + w), 4) r FROM g JOIN (SELECT volume, slab, count(*) n_inside FROM inside GROUP BY 1, 2) USING (volume, slab)""")
def can_circles(spark, d):
    """Circle through the outer border of the metal around each slab, and the number of pixels that it encloses."""
    circles, inside = _can(spark, d)
    n = inside.groupBy("volume", "slab").agg(F.count("*").alias("n_inside"))
    return circles.where("r is not null").join(n, ["volume", "slab"]).select("volume", "slab", "points", "n_inside", *[F.round(c, 4).alias(c) for c in ("yc", "xc", "r")])


@query(f"""WITH RECURSIVE {CAN} SELECT volume, z, y, x, v FROM sl WHERE v >= 30 AND ((volume, slab) NOT IN (SELECT (volume, slab) FROM best) OR (volume, slab, y, x) IN (SELECT (volume, slab, y, x) FROM inside))""")
def can_gated(spark, d):
    """Strong voxels inside the metal of their slab, the input of detection there."""
    return contours.gated(cube(spark, d).where("v >= 30").select("volume", *AXES, "v"), _can(spark, d)[1], SLAB)


# ---------------------------------------------------------------- stored residuals and raw volumes


@query(f"WITH {RESIDUAL} SELECT volume, z, y, x, r, g FROM res WHERE z BETWEEN 60 AND 69")
def residual_range(spark, d):
    """Ten slices of a residual that was written once as a table of ranges of slices."""
    path = f"{scratch(spark)}/residuals-{uuid.uuid4().hex}"
    residual_store.write_residuals(residual.residuals(scan(spark, d), WIDTH, METAL).select("volume", *AXES, "r", "g"), path)
    return residual_store.read_residuals(spark, path, 60, 69).select("volume", *[F.col(c).cast("long").alias(c) for c in (*AXES, "r", "g")])


@query(f"WITH {SCAN} SELECT volume, z, sum(g)::BIGINT total, count(*) FILTER (g > 0) filled FROM scan WHERE z BETWEEN 50 AND 59 GROUP BY 1, 2")
def raw_volume_range(spark, d):
    """Gray volumes written as raw slices, ten of them read back without opening the others."""
    path = f"{raw_volume.local_path(scratch(spark))}/raw-{uuid.uuid4().hex}"
    raw_volume.write_volume(raw_volume.as_slices(scan(spark, d), "g", 8, 8), path)
    v = raw_volume.as_voxels(raw_volume.read_volume(spark, path, slices=4, first=50, last=59))
    return v.groupBy("volume", "z").agg(F.sum("v").cast("long").alias("total"), F.count_if(F.col("v") > 0).alias("filled")).where("filled > 0")


# ---------------------------------------------------------------- resampling

SHAPE = (110, 8, 8)
TURN = geometry.plane_rotation(9.0, (1, 2)) @ geometry.plane_rotation(-2.0, (0, 2))
SHIFT = geometry.about_centre(TURN, SHAPE)


def _linear(matrix: np.ndarray, offset: np.ndarray, i: int, names: tuple[str, ...] = ("z", "y", "x")) -> str:
    return "(" + " + ".join(f"{float(matrix[i, j])!r}::DOUBLE * {c}" for j, c in enumerate(names)) + f" + {float(offset[i])!r}::DOUBLE)"


def _mirror(i: str, n: int) -> str:
    m = f"(abs({i}) % {2 * n - 2})"
    return f"CASE WHEN {m} >= {n} THEN {2 * n - 2} - {m} ELSE {m} END"


def _spline_sql() -> str:
    steps, before = [], "grid"
    for axis, n in zip(AXES, SHAPE):
        same = " AND ".join(f"s.{c} = d.{c}" for c in AXES if c != axis)
        steps.append(f"c{axis} AS (SELECT d.volume, d.z, d.y, d.x, sum(h * s.v) v FROM {before} d CROSS JOIN taps JOIN {before} s ON s.volume = d.volume AND {same} AND s.{axis} = {_mirror(f'(d.{axis} + k)', n)} GROUP BY 1, 2, 3, 4)")
        before = f"c{axis}"
    at = ", ".join(f"{_linear(TURN, SHIFT, i)} r{c}" for i, c in enumerate(AXES))
    snap = ", ".join(f"CASE WHEN abs(r{c} - round(r{c})) < 1e-9 THEN round(r{c}) ELSE r{c} END a{c}" for c in AXES)
    inside = " AND ".join(f"a{c} BETWEEN 0 AND {n - 1}" for c, n in zip(AXES, SHAPE))
    bell = lambda c: f"CASE WHEN abs(a{c} - floor(a{c}) - o{c}.range) < 1 THEN (4 - 6 * abs(a{c} - floor(a{c}) - o{c}.range) ** 2 + 3 * abs(a{c} - floor(a{c}) - o{c}.range) ** 3) / 6 ELSE (2 - abs(a{c} - floor(a{c}) - o{c}.range)) ** 3 / 6 END"
    reads = " AND ".join(f"s.{c} = {_mirror(f'(floor(a{c})::BIGINT + o{c}.range)', n)}" for c, n in zip(AXES, SHAPE))
    return f"""WITH {SCAN}, grid AS (SELECT v0.volume, z.range z, y.range y, x.range x, coalesce(g, 0)::DOUBLE v FROM (SELECT DISTINCT volume FROM scan) v0 CROSS JOIN range({SHAPE[0]}) z CROSS JOIN range({SHAPE[1]}) y CROSS JOIN range({SHAPE[2]}) x
          LEFT JOIN scan ON scan.volume = v0.volume AND scan.z = z.range AND scan.y = y.range AND scan.x = x.range), taps AS (SELECT range k, sqrt(3) * power(sqrt(3) - 2, abs(range)) h FROM range(-24, 25)), {", ".join(steps)},
          pos AS (SELECT volume, z, y, x, {snap} FROM (SELECT volume, z, y, x, {at} FROM grid)),
          got AS (SELECT t.volume, t.z, t.y, t.x, sum(({bell("z")}) * ({bell("y")}) * ({bell("x")}) * s.v) v FROM pos t CROSS JOIN range(-1, 3) oz CROSS JOIN range(-1, 3) oy CROSS JOIN range(-1, 3) ox JOIN cx s ON s.volume = t.volume AND {reads} WHERE {inside} GROUP BY 1, 2, 3, 4)
          SELECT volume, z, y, x, round(coalesce(got.v, 0), 3) + 0.0 g FROM grid LEFT JOIN got USING (volume, z, y, x)"""


@query(_spline_sql())
def rotated_spline(spark, d):
    """Volumes turned about two axes, read by cubic splines."""
    v = recursive.resampled_spline(scan(spark, d), ["volume"], "g", TURN, SHIFT, SHAPE)
    return v.select("volume", *AXES, (F.round("g", 3) + F.lit(0.0)).alias("g"))


ALIGNED = geometry.aligned_maps(SHAPE, 7.0, -4.0)


def _within(margin: float) -> str:
    tests = []
    for matrix, offset, axes in ALIGNED:
        tests += [f"{_linear(matrix, offset, i)} BETWEEN {margin if i in axes else 0} - 1e-9 AND {n - 1 - (margin if i in axes else 0)} + 1e-9" for i, n in enumerate(SHAPE)]
    return " AND ".join(tests)


@query(f"""WITH {SCAN}, lines AS (SELECT DISTINCT volume, z, y FROM scan), ok AS (SELECT volume, z, y, min(x) lo, max(x) hi FROM (SELECT * FROM lines CROSS JOIN range(8)) l(volume, z, y, x) WHERE {_within(0.5)} GROUP BY 1, 2, 3) SELECT volume, z, y, coalesce(lo, 8)::INT x_min, coalesce(hi + 1, 0)::INT x_max FROM lines LEFT JOIN ok USING (volume, z, y)""")
def valid_after_alignment(spark, d):
    """Range of x in each line of a volume that two turns fill from real voxels."""
    return geometry.valid_intervals(scan(spark, d).select("volume", "z", "y").distinct(), SHAPE, ALIGNED, 0.5)


WIDE = (128, EDGE, EDGE)
TILT = geometry.plane_rotation(20.0, (1, 2))
TILTED = geometry.about_centre(TILT, WIDE)


@query(f"""WITH {CUBE}, support AS (SELECT volume, z // 16 part, {", ".join(f"round({_linear(TILT, TILTED, i)}, 9) a{c}" for i, c in enumerate(AXES))} FROM cube WHERE v >= 120),
       box AS (SELECT volume, part, {", ".join(f"greatest(floor(min(a{c})) - 1, 0) {c}0, least(ceil(max(a{c})) + 1, {n - 1}) {c}1" for c, n in zip(AXES, WIDE))} FROM support GROUP BY 1, 2)
       SELECT volume, part, row_number() OVER (PARTITION BY volume, part ORDER BY v DESC, z, y, x)::INT AS rank, z, y, x, v FROM box JOIN cube USING (volume) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 QUALIFY rank <= 10""")
def top_in_turned_boxes(spark, d):
    """The ten largest values in the box around each group of strong voxels after a turn."""
    v = cube(spark, d).select("volume", *AXES, "v")
    strong = v.where("v >= 120").withColumn("part", F.floor(F.col("z") / 16))
    boxes = geometry.moved_boxes(strong, ["volume", "part"], TILT, TILTED, 1, WIDE)
    return geometry.top_in_boxes(v, boxes, ["volume", "part"], "volume", "v", 10)


# ---------------------------------------------------------------- morphology, landmarks, noise models

STEPS = "(VALUES " + ", ".join(str(s) for s in morphology.ball(1)) + ") s(dz, dy, dx)"


@query(f"""WITH {CUBE}, m AS (SELECT volume, z, y, x FROM cube WHERE v >= 60), wide AS (SELECT DISTINCT volume, z + dz z, y + dy y, x + dx x FROM m CROSS JOIN {STEPS})
       SELECT volume, z - dz z, y - dy y, x - dx x FROM wide CROSS JOIN {STEPS} GROUP BY ALL HAVING count(*) = 7""")
def closed_voxels(spark, d):
    """Strong voxels with what is narrower than a ball of one voxel between them."""
    return morphology.closed(cube(spark, d).where("v >= 60").select("volume", *AXES), ["volume"], morphology.ball(1))


BELL = np.exp(-0.5 * np.arange(-2, 3) ** 2) / np.exp(-0.5 * np.arange(-2, 3) ** 2).sum()
KERNEL = "(VALUES " + ", ".join(f"({a - 2}, {b - 2}, {float(BELL[a] * BELL[b])!r}::DOUBLE)" for a, b in itertools.product(range(5), repeat=2)) + ") k(dy, dx, w)"


@query(f"""WITH {CUBE}, img AS (SELECT volume, y, x, least(max(v), 255) v FROM cube GROUP BY 1, 2, 3), top AS (SELECT volume, y ty, x tx FROM img QUALIFY row_number() OVER (PARTITION BY volume ORDER BY v DESC, y, x) = 1),
       stamp AS (SELECT volume, y, x, v / 4 s FROM img JOIN top USING (volume) WHERE abs(y - ty) <= 2 AND abs(x - tx) <= 2),
       told AS (SELECT volume, yy + dy y, xx + dx x, s * w s FROM (SELECT volume, s, unnest([y, -1 - y, 47 - y]) yy, x FROM stamp) a CROSS JOIN LATERAL (SELECT unnest([a.x, -1 - a.x, 47 - a.x]) xx) b CROSS JOIN {KERNEL}),
       soft AS (SELECT volume, y, x, sum(s) s FROM told WHERE y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23 GROUP BY 1, 2, 3),
       scale AS (SELECT volume, max(stamp.s) / any_value(p) f FROM stamp JOIN (SELECT volume, max(s) p FROM soft GROUP BY 1) USING (volume) GROUP BY 1)
       SELECT volume, y, x, greatest(0, least(255, round_even(v + 0.75 * coalesce(s * f, 0), 0)))::INT v FROM img LEFT JOIN (SELECT soft.volume, y, x, s, f FROM soft JOIN scale USING (volume)) USING (volume, y, x)""")
def blended_image(spark, d):
    """The surroundings of a projection's brightest pixel, softened and added to it."""
    img = cut(cube(spark, d).groupBy("volume", "y", "x").agg(F.least(F.max("v"), F.lit(255.0)).alias("v")), "image")
    top = img.groupBy("volume").agg(F.max_by(F.struct(F.col("y").alias("ty"), F.col("x").alias("tx")), F.struct("v", -F.col("y"), -F.col("x"))).alias("t"))
    stamp = img.join(top, "volume").where("abs(y - t.ty) <= 2 and abs(x - t.tx) <= 2").select("volume", "y", "x", (F.col("v") / 4).alias("strength"))
    return morphology.blended(img, stamp, ["volume"], "v", (EDGE, EDGE))


@query()
def local_objects(spark, d):
    """The object at the brightest voxel of each volume and quarter, projected with confidence."""
    v = cube(spark, d).select("volume", *AXES, "v")
    top = v.withColumn("part", F.floor(F.col("z") / 25)).groupBy("volume", "part").agg(F.max_by(F.struct(*AXES), F.struct("v", *[-F.col(c) for c in AXES])).alias("p"))
    points = top.select(F.concat_ws("/", "volume", "part").alias("point"), "volume", *[f"p.{c}" for c in AXES])
    return morphology.extracted(v, points, "v")


@query()
def raw_landmarks(spark, d):
    """Air, core, brightest and metal level of every volume, from some slices."""
    h = thresholds.sampled_slices(scan(spark, d), ["volume"], "g", 10)
    return thresholds.raw_landmarks(h, ["volume"], "g")


@query()
def noise_model_eigenvalues(spark, d):
    """Least eigenvalue of each slice's noise correlation over windows of three widths; a model is none if it is negative."""
    n = residual.slice_noise(scan(spark, d)).where("rho1 is not null")
    rows = n.select("volume", "z", "rho1", "rho2", F.explode(F.array(*[F.lit(k) for k in (5, 11, 25)])).alias("n"))
    return rows.select("volume", "z", "n", r6(stats.least_eigenvalue(F.col("n"), F.col("rho1"), F.col("rho2"))).alias("least"))


# ---------------------------------------------------------------- candidates

WHOLE = ("n_voxels", "n_seed", "n_seed_regions", "n_seed_total", "z_min", "z_max", "z_extent", "y_extent", "x_extent", "peak_z", "peak_y", "peak_x", "gs_peak")
PARTS_OF = (
    "centroid_z", "centroid_y", "centroid_x", "fill", "snr_cluster", "r_peak", "r_peak_ratio", "peak_offset", "seed_offset", "snr_peak", "linearity", "planarity", "sphericity", "l1", "l2", "l3",
    "edge_contrast", "decay_drop", "seed_grown_ratio", "fill_pca", "diag", "surface_ratio", "radial_pos", "gs_median", "gs_p90", "gs_iqr", "gs_shell_median", "gs_contrast", "metal_threshold",
)


@query(f"""WITH RECURSIVE {RINGS}, seeds AS (SELECT * FROM objects WHERE snr >= {HIGH}), {_walk("seeds", "regions")},
       w AS (SELECT volume, component, count(*) n_voxels, count(*) FILTER (snr >= {HIGH}) n_seed_total, min(z) z_min, max(z) z_max, max(z) - min(z) + 1 z_extent, max(y) - min(y) + 1 y_extent, max(x) - min(x) + 1 x_extent,
          sum(r * z) / sum(r)::DOUBLE centroid_z, sum(r * y) / sum(r)::DOUBLE centroid_y, sum(r * x) / sum(r)::DOUBLE centroid_x, sum(snr) / sqrt(count(*)) snr_cluster, max(r)::DOUBLE r_peak, max(r) / avg(r) r_peak_ratio, max(snr) snr_peak,
          coalesce(sum(r) FILTER (snr >= {HIGH}), 0) / sum(r)::DOUBLE seed_grown_ratio, covar_pop(z, z) + 1 / 12.0::DOUBLE a, covar_pop(z, y) b, covar_pop(z, x) c, covar_pop(y, y) + 1 / 12.0::DOUBLE d, covar_pop(y, x) e, covar_pop(x, x) + 1 / 12.0::DOUBLE f,
          median(g) gs_median, quantile_cont(g, 0.9) gs_p90, max(g) gs_peak, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) gs_iqr FROM objects GROUP BY 1, 2),
       peak AS (SELECT component, z peak_z, y peak_y, x peak_x FROM objects QUALIFY row_number() OVER (PARTITION BY component ORDER BY r DESC, z, y, x) = 1),
       part AS (SELECT seeds.component, regions.component region, count(*) n, sum(r * z) / sum(r)::DOUBLE z, sum(r * y) / sum(r)::DOUBLE y, sum(r * x) / sum(r)::DOUBLE x FROM seeds JOIN regions USING (id) GROUP BY 1, 2),
       so AS (SELECT component, max(n) n_seed, count(*) n_seed_regions, max(sqrt((z - centroid_z) ** 2 + (y - centroid_y) ** 2 + (x - centroid_x) ** 2)) seed_offset FROM part JOIN w USING (component) GROUP BY 1),
       q AS (SELECT *, (a + d + f) / 3 q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) p FROM w),
       t AS (SELECT *, CASE WHEN p > 1e-12 THEN acos(greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * p * p * p)))) / 3 ELSE 0 END phi FROM q),
       l AS (SELECT *, 3 * q - l1 - l3 l2 FROM (SELECT *, q + 2 * p * cos(phi) l1, q + 2 * p * cos(phi + 2 * pi() / 3) l3 FROM t)),
       sh AS (SELECT component, median(snr) FILTER (d > 1 AND r <> 0) shell, median(snr) FILTER (d = 1 AND r <> 0) - median(snr) FILTER (d = 2 AND r <> 0) decay_drop, median(g) FILTER (d > 1 AND r <> 0 AND g <= {METAL}) gs_shell_median FROM ring GROUP BY 1),
       rim AS (SELECT component, median(snr) edge, median(g) ge, count(*) surface FROM edge GROUP BY 1),
       everything AS (SELECT *, n_voxels / (z_extent * y_extent * x_extent)::DOUBLE fill, sqrt((peak_z - centroid_z) ** 2 + (peak_y - centroid_y) ** 2 + (peak_x - centroid_x) ** 2) peak_offset, (l1 - l2) / l1 linearity, (l2 - l3) / l1 planarity, l3 / l1 sphericity,
          edge - shell edge_contrast, ge - gs_shell_median gs_contrast, n_voxels / (4 * pi() * 3 ** 1.5 * sqrt(l1 * l2 * l3)) fill_pca, 2 * sqrt(3 * l1) / greatest(z_extent, y_extent, x_extent) diag, surface / n_voxels::DOUBLE surface_ratio,
          sqrt((centroid_y - 4) ** 2 + (centroid_x - 4) ** 2) radial_pos, {METAL}.0::DOUBLE metal_threshold FROM l LEFT JOIN peak USING (component) LEFT JOIN so USING (component) LEFT JOIN sh USING (component) LEFT JOIN rim USING (component))
       SELECT volume, component, {", ".join(f"{c}::BIGINT {c}" for c in WHOLE)}, {", ".join(f"round({c} + 1e-9::DOUBLE, 4) + 0.0 {c}" for c in PARTS_OF)} FROM everything""")
def candidate_rows(spark, d):
    """Every feature of every candidate, from gray values in one job."""
    voxels, objects = _found(spark, d)
    # sums of whole ten-thousandths are moved off the middle before they are rounded
    rows = candidates.candidate_rows(voxels, objects, "id", HIGH, METAL, (8, 8))
    return rows.select("volume", "component", *[F.col(c).cast("long").alias(c) for c in WHOLE], *[(F.round(F.col(c) + 1e-9, 4) + F.lit(0.0)).alias(c) for c in PARTS_OF])
