"""Queries over gray volumes: residual, noise, detection with all features, post-processing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import displayed, rescaled_to, safe_ratio
from voxelweave.functions.storage import checked_broadcast, cut
from voxelweave.jobs.registry import query, r6
from voxelweave.operators import geometry, residual, thresholds, volume, windows
from voxelweave.operators.windows import quantiles
from voxelweave.sources.tables import EDGE, SLICES, scan

WIDTH, METAL, LOW, HIGH = 5, 190, 1.4, 2.2
AXES = ["z", "y", "x"]

SCAN = """scan AS (SELECT volume, z, y, x, (5 * sum(q)::BIGINT // count(*))::BIGINT g FROM (SELECT l_returnflag || '-' || (l_partkey // 2000) volume,
          ((l_shipdate::DATE - DATE '1990-01-01') // 42)::BIGINT z, l_partkey % 2000 // 250 y, l_suppkey % 8 x, l_quantity q FROM lineitem) GROUP BY 1, 2, 3, 4)"""
RESIDUAL = f"""{SCAN}, num AS (SELECT *, row_number() OVER (PARTITION BY volume, y, x ORDER BY z) - 1 i, count(*) OVER (PARTITION BY volume, y, x) size FROM scan),
          res AS (SELECT a.volume, a.z, a.y, a.x, any_value(a.g) g, CASE WHEN max(b.g) > {METAL} THEN 0 ELSE any_value(a.g) - floor(median(b.g))::BIGINT END r FROM num a JOIN num b ON a.volume = b.volume AND a.y = b.y AND a.x = b.x
          AND b.i BETWEEN greatest(0, least(a.i - 2, a.size - 5)) AND greatest(0, least(a.i - 2, a.size - 5)) + 4 WHERE a.size >= 5 GROUP BY 1, 2, 3, 4)"""
NOISE = f"""{RESIDUAL}, lead5 AS (SELECT volume, z, g s0, lead(g, 1) OVER w s1, lead(g, 2) OVER w s2, lead(g, 3) OVER w s3, lead(g, 4) OVER w s4 FROM scan WINDOW w AS (PARTITION BY volume, y, x ORDER BY z)),
          diff AS (SELECT volume, z, s0 - s1 d1, s1 - s2 d2, s0 - 2 * s1 + s2 da, s2 - 2 * s3 + s4 db FROM lead5 WHERE s4 IS NOT NULL),
          mom AS (SELECT volume, z, count(*) n, (var_samp(d1) + var_samp(d2)) / 2 v1, (var_samp(da) + var_samp(db)) / 2 v2, covar_samp(da, db) v3 FROM diff WHERE d1 <> 0 AND d2 <> 0 AND da <> 0 AND db <> 0 GROUP BY 1, 2 HAVING count(*) >= 2),
          sol AS (SELECT volume, z, n, a, (a - v1 / 2) / a rho1, (a + v2 / 2 - 2 * v1) / a rho2 FROM (SELECT *, (v3 - 3 * v2 + 10 * v1) / 3 a FROM mom)),
          noise AS (SELECT volume, z, n, CASE WHEN ok THEN sqrt(a) END sigma, CASE WHEN ok THEN rho1 END rho1, CASE WHEN ok THEN rho2 END rho2 FROM (SELECT *, coalesce(a > 0 AND abs(rho1) < 1 AND abs(rho2) < 1, false) ok FROM sol))"""
SIGMA = f"""{NOISE}, clipped AS (SELECT volume, z, sigma, greatest(least(rho1, 0.7), 0.3) r1, CASE WHEN rho1 < 0.3 OR rho1 > 0.7 THEN rho2 ELSE greatest(least(rho2, 0.18), 0.08) END r2 FROM noise WHERE sigma IS NOT NULL),
          sig AS (SELECT volume, z, sigma * (1 - (0.48417 - 0.04204 * r1 + 0.16959 * r1 * r1 - 0.14318 * r2 + 3.06188 * r1 * r2) / 5 - (-1.06974 + 8.88342 * r1 + 5.72699 * r2) / 25) sigma_r FROM clipped)"""
SNR = f"""{SIGMA}, snr AS (SELECT volume, z, y, x, g, r, round(r / coalesce(sigma_r, sigma_v), 6) snr, (((ascii(volume) - 64 + 32 * split_part(volume, '-', 2)::BIGINT) * 128 + z) * 24 + y) * 24 + x id FROM res JOIN (SELECT volume, avg(sigma_r) sigma_v FROM sig GROUP BY 1) USING (volume) LEFT JOIN sig USING (volume, z))"""


def _walk(rows: str, name: str, also: str = "") -> str:
    """SQL of the connected parts of rows (volume, z, y, x, id): (id, component)."""
    face = lambda c: " AND ".join(f"a.{k} = b.{k}" for k in ("volume", "z", "y", "x") if k != c) + f" AND abs(a.{c} - b.{c}) = 1{also}"
    joins = " UNION ALL ".join(f"SELECT a.id a, b.id b FROM {rows} a JOIN {rows} b ON {face(c)}" for c in "zyx")
    return f"""{name}_e AS ({joins}), {name}_w(id, seen) AS (SELECT id, id FROM {rows} UNION SELECT {name}_w.id, b FROM {name}_w JOIN {name}_e ON a = {name}_w.seen),
          {name} AS (SELECT id, min(seen) component FROM {name}_w GROUP BY 1)"""


FOUND = f"""{SNR}, low AS (SELECT * FROM snr WHERE snr >= {LOW}), {_walk("low", "parts")},
          objects AS (SELECT low.*, component FROM low JOIN parts USING (id) WHERE component IN (SELECT component FROM low JOIN parts USING (id) GROUP BY 1 HAVING max(snr) >= {HIGH}))"""
OFFSETS = "off AS (SELECT i.range dz, j.range dy, k.range dx, abs(i.range) + abs(j.range) + abs(k.range) d FROM range(-3, 4) i, range(-3, 4) j, range(-3, 4) k WHERE abs(i.range) + abs(j.range) + abs(k.range) <= 3)"
RINGS = f"""{FOUND}, {OFFSETS}, ring AS (SELECT component, snr.g, snr.r, snr.snr, min(off.d) d FROM objects o CROSS JOIN off JOIN snr ON snr.volume = o.volume AND snr.z = o.z + dz AND snr.y = o.y + dy AND snr.x = o.x + dx GROUP BY o.component, snr.id, snr.g, snr.r, snr.snr HAVING min(off.d) > 0),
          edge AS (SELECT o.* FROM objects o WHERE (SELECT count(*) FROM parts_e e JOIN parts p ON p.id = e.b WHERE e.a = o.id) < 6)"""


def _snr(spark: SparkSession, d: str) -> DataFrame:
    s = residual.snr(scan(spark, d), WIDTH, METAL)
    number = F.ascii("volume") - 64 + 32 * F.split_part("volume", F.lit("-"), F.lit(2)).cast("long")
    return s.withColumn("id", (((number * SLICES + F.col("z")) * EDGE + F.col("y")) * EDGE + F.col("x")).cast("long"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = cut(_snr(spark, d), "snr")
    return v, cut(volume.hysteresis(v, ["volume"], AXES, "snr", LOW, HIGH, "id"), "objects")


# The chain from gray values to candidates


@query(f"WITH {RESIDUAL} SELECT volume, z, y, x, r FROM res")
def residual_volume(spark, d):
    return residual.residuals(scan(spark, d), WIDTH, METAL).select("volume", *AXES, "r")


@query(f"WITH {NOISE} SELECT volume, z, n, round(sigma, 5) sigma, round(rho1, 5) rho1, round(rho2, 5) rho2 FROM noise")
def slice_noise(spark, d):
    return residual.slice_noise(scan(spark, d)).select("volume", "z", "n", *[F.round(c, 5).alias(c) for c in ("sigma", "rho1", "rho2")])


@query(f"WITH {NOISE} SELECT volume, count(*) n, count(sigma) valid, round(min(sigma), 5) least, round(median(sigma), 5) mid, round(max(sigma), 5) most FROM noise GROUP BY 1")
def volume_noise_summary(spark, d):
    n = cut(residual.slice_noise(scan(spark, d)), "noise")
    g = n.groupBy("volume").agg(F.count("*").alias("n"), F.count("sigma").alias("valid"), F.round(F.min("sigma"), 5).alias("least"), F.round(F.max("sigma"), 5).alias("most"))
    return g.join(quantiles(n, ["volume"], "sigma", {"mid": 0.5}), "volume", "left").select("volume", "n", "valid", "least", F.round("mid", 5).alias("mid"), "most")


@query(f"WITH {SIGMA} SELECT volume, z, round(sigma_r, 5) sigma_r FROM sig")
def residual_sigma(spark, d):
    return residual.residual_sigma(residual.slice_noise(scan(spark, d)), WIDTH).select("volume", "z", F.round("sigma_r", 5).alias("sigma_r"))


@query(f"""WITH RECURSIVE {FOUND} SELECT volume, component, count(*) n_voxels, count(*) FILTER (snr >= {HIGH}) n_seed, max(snr) peak, round(sum(snr * z) / sum(snr), 5) centroid_z,
       round(sum(snr * y) / sum(snr), 5) centroid_y, round(sum(snr * x) / sum(snr), 5) centroid_x, max(z) - min(z) + 1 z_extent FROM objects GROUP BY 1, 2""")
def scan_candidates(spark, d):
    """Residual, noise, hysteresis and features in one job, from gray values to candidates."""
    f = volume.features(_found(spark, d)[1], ["volume"], AXES, "snr", HIGH)
    return f.select("volume", "component", "n_voxels", "n_seed", "peak", *[F.round(f"centroid_{c}", 5).alias(f"centroid_{c}") for c in AXES], "z_extent")


@query(f"""WITH RECURSIVE {RINGS} SELECT component, round(median(snr) - (SELECT median(snr) FROM ring WHERE ring.component = e.component AND d > 1 AND r <> 0) + 1e-9::DOUBLE, 4) edge_contrast,
       round((SELECT median(snr) FROM ring WHERE ring.component = e.component AND d = 1 AND r <> 0) - (SELECT median(snr) FROM ring WHERE ring.component = e.component AND d = 2 AND r <> 0) + 1e-9::DOUBLE, 4) decay_drop FROM edge e GROUP BY 1""")
def shell_features(spark, d):
    return residual.shell_features(*_found(spark, d), "id").select("component", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("edge_contrast", "decay_drop")])  # off the middle between two roundings


@query(f"""WITH RECURSIVE {RINGS}, own AS (SELECT component, median(g) gs_median, quantile_cont(g, 0.9) gs_p90, max(g) gs_peak, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) gs_iqr FROM objects GROUP BY 1),
       shell AS (SELECT component, median(g) s FROM ring WHERE d > 1 AND r <> 0 AND g <= {METAL} GROUP BY 1), rim AS (SELECT component, median(g) e FROM edge GROUP BY 1)
       SELECT component, round(gs_median, 4) gs_median, round(gs_p90, 4) gs_p90, gs_peak, round(gs_iqr, 4) gs_iqr, round(s, 4) gs_shell_median, round(e - s, 4) gs_contrast FROM own LEFT JOIN shell USING (component) LEFT JOIN rim USING (component)""")
def grayscale_features(spark, d):
    f = residual.grayscale_features(*_found(spark, d), "id", METAL)
    return f.select("component", "gs_peak", *[F.round(c, 4).alias(c) for c in ("gs_median", "gs_p90", "gs_iqr", "gs_shell_median", "gs_contrast")])


@query(f"""WITH RECURSIVE {FOUND}, seeds AS (SELECT * FROM objects WHERE snr >= {HIGH}), {_walk("seeds", "regions")}, whole AS (SELECT component, sum(snr * z) / sum(snr) z, sum(snr * y) / sum(snr) y, sum(snr * x) / sum(snr) x FROM objects GROUP BY 1),
       part AS (SELECT seeds.component, regions.component region, sum(snr * z) / sum(snr) z, sum(snr * y) / sum(snr) y, sum(snr * x) / sum(snr) x FROM seeds JOIN regions USING (id) GROUP BY 1, 2)
       SELECT p.component, count(*) n_seed_regions, round(max(sqrt((p.z - w.z) * (p.z - w.z) + (p.y - w.y) * (p.y - w.y) + (p.x - w.x) * (p.x - w.x))), 5) seed_offset FROM part p JOIN whole w USING (component) GROUP BY 1""")
def seed_offsets(spark, d):
    return residual.seed_offsets(_found(spark, d)[1], "snr", HIGH, "id").select("component", "n_seed_regions", F.round("seed_offset", 5).alias("seed_offset"))


@query(f"""WITH RECURSIVE {FOUND}, box AS (SELECT volume, component, min(z) - 1 z0, max(z) + 1 z1, min(y) - 1 y0, max(y) + 1 y1, min(x) - 1 x0, max(x) + 1 x1 FROM objects GROUP BY 1, 2)
       SELECT b.component, s.volume, s.z, s.y, s.x, s.r, s.g, CASE WHEN o.id IS NULL THEN 0 ELSE 1 END in_grown FROM box b JOIN snr s ON s.volume = b.volume AND s.z BETWEEN z0 AND z1 AND s.y BETWEEN y0 AND y1 AND s.x BETWEEN x0 AND x1
       LEFT JOIN objects o ON o.id = s.id AND o.component = b.component""")
def voxel_dump(spark, d):
    return residual.voxel_dump(*_found(spark, d), 1)


COLLAPSE = f"""{SNR}, many AS (SELECT volume, high, z, y, x, id * 3 + k id FROM snr JOIN (VALUES (1.6::DOUBLE, 0), (2.0, 1), (2.4, 2)) v(high, k) ON snr >= high), {_walk("many", "parts", " AND a.high = b.high")},
          sizes AS (SELECT volume, high, component, count(*) c FROM many JOIN parts USING (id) GROUP BY 1, 2, 3)"""


def _collapse(spark: SparkSession, d: str) -> DataFrame:
    return residual.noise_collapse(_snr(spark, d), "id", [1.6, 2.0, 2.4], [1, 2, 3])


@query(f"WITH RECURSIVE {COLLAPSE} SELECT volume, high, m, count(*) FILTER (c >= m) n FROM sizes CROSS JOIN (VALUES (1), (2), (3)) v(m) GROUP BY 1, 2, 3")
def noise_collapse(spark, d):
    return _collapse(spark, d)


@query(f"""WITH RECURSIVE {COLLAPSE}, n AS (SELECT volume, high, m, count(*) FILTER (c >= m) n FROM sizes CROSS JOIN (VALUES (1), (2), (3)) v(m) GROUP BY 1, 2, 3)
       SELECT high, min(m) FILTER (worst <= 4) knee FROM (SELECT high, m, max(n) worst FROM n GROUP BY 1, 2) GROUP BY 1""")
def collapse_knee(spark, d):
    """Smallest size at which no volume has more than four parts."""
    worst = _collapse(spark, d).groupBy("high", "m").agg(F.max("n").alias("worst"))
    return worst.groupBy("high").agg(F.min(F.when(F.col("worst") <= 4, F.col("m"))).alias("knee"))


# Noise by slice


@query(f"""WITH {SCAN}, p AS (SELECT volume, z, g, lead(g) OVER w h, lead(z) OVER w nz FROM scan WINDOW w AS (PARTITION BY volume, y, x ORDER BY z)), s AS (SELECT volume, z, stddev_pop(h - g) / sqrt(2) sd, corr(g, h) rho FROM p WHERE nz = z + 1 GROUP BY 1, 2 HAVING count(*) > 2),
       e AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY z) i, count(*) OVER (PARTITION BY volume) n, lead(sd) OVER w sd1, lead(rho) OVER w rho1, lag(sd) OVER w sd0, lag(rho) OVER w rho0 FROM s WINDOW w AS (PARTITION BY volume ORDER BY z))
       SELECT volume, z, round(CASE WHEN i = 1 THEN sd1 / sqrt(1 - rho1) WHEN i = n THEN sd0 / sqrt(1 - rho0) ELSE sd / sqrt(1 - rho) END, 5) noise FROM e WHERE n >= 3""")
def noise_by_slice(spark, d):
    """Noise of each pair of slices, corrected for their correlation; the ends take over their neighbour's."""
    s = _pairs(spark, d).agg((F.stddev_pop(F.col("h") - F.col("g")) / math.sqrt(2)).alias("sd"), F.corr("g", "h").alias("rho"), F.count("*").alias("c")).where("c > 2")
    w = Window.partitionBy("volume").orderBy("z")
    e = s.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("volume")), "after": F.lead(F.struct("sd", "rho")).over(w), "early": F.lag(F.struct("sd", "rho")).over(w)})
    use = F.when(F.col("i") == 1, F.col("after")).when(F.col("i") == F.col("n"), F.col("early")).otherwise(F.struct("sd", "rho"))
    return e.where("n >= 3").withColumn("u", use).select("volume", "z", F.round(F.col("u.sd") / F.sqrt(1 - F.col("u.rho")), 5).alias("noise"))


def _pairs(spark: SparkSession, d: str):
    w = Window.partitionBy("volume", "y", "x").orderBy("z")
    p = scan(spark, d).select("volume", "z", "g", F.lead("g").over(w).alias("h"), F.lead("z").over(w).alias("nz"))
    return p.where("nz = z + 1").groupBy("volume", "z")


@query(f"""WITH {SCAN}, p AS (SELECT volume, z, g, lead(g) OVER w h, lead(z) OVER w nz FROM scan WINDOW w AS (PARTITION BY volume, y, x ORDER BY z)), c AS (SELECT volume, min(z) + 4 lo, max(z) - 4 hi FROM scan GROUP BY 1)
       SELECT volume, z, round(stddev_pop(h - g) / sqrt(2 * (1 - 0.25)), 5) noise FROM p JOIN c USING (volume) WHERE nz = z + 1 AND z NOT IN (lo - 1, lo, hi - 1, hi) GROUP BY 1, 2""")
def noise_fixed_correlation(spark, d):
    """Noise of each pair of slices at a given correlation, without the two pairs at either cap."""
    caps = scan(spark, d).groupBy("volume").agg((F.min("z") + 4).alias("lo"), (F.max("z") - 4).alias("hi"))
    s = _pairs(spark, d).agg(F.round(F.stddev_pop(F.col("h") - F.col("g")) / math.sqrt(2 * 0.75), 5).alias("noise"))
    keep = ~((F.col("z") == F.col("lo") - 1) | (F.col("z") == F.col("lo")) | (F.col("z") == F.col("hi") - 1) | (F.col("z") == F.col("hi")))
    return s.join(caps, "volume").where(keep).select("volume", "z", "noise")


@query(f"WITH {RESIDUAL} SELECT volume, round(1.05 * sqrt(avg(r * r)), 5) about_zero, round(1.05 * stddev_samp(r), 5) about_mean FROM res WHERE r <> 0 GROUP BY 1")
def local_noise(spark, d):
    """Noise of the background about a known centre (by n) and about its own mean (by n - 1)."""
    r = residual.residuals(scan(spark, d), WIDTH, METAL).where("r <> 0")
    return r.groupBy("volume").agg(F.round(1.05 * F.sqrt(F.avg(F.col("r") * F.col("r"))), 5).alias("about_zero"), F.round(1.05 * F.stddev_samp("r"), 5).alias("about_mean"))


# Slabs, gray values, boxes


@query(f"WITH {SCAN} SELECT volume, z // 5 slab, y, x, round(median(g), 4) mid, round(avg(g), 6) mean, max(g) most FROM scan GROUP BY 1, 2, 3, 4")
def slab_projections(spark, d):
    v = scan(spark, d).withColumn("slab", F.floor(F.col("z") / 5))
    g = v.groupBy("volume", "slab", "y", "x").agg(F.round(F.median("g"), 4).alias("mid"), r6(F.avg("g")).alias("mean"), F.max("g").alias("most"))  # five slices a group
    return g


@query(f"WITH {SCAN} SELECT volume, z, count(*) n, sum(g)::BIGINT total FROM scan WHERE z BETWEEN 50 AND 80 GROUP BY 1, 2")
def analysis_range(spark, d):
    return scan(spark, d).where("z between 50 and 80").groupBy("volume", "z").agg(F.count("*").alias("n"), F.sum("g").alias("total"))


@query(f"""WITH {SCAN}, e AS (SELECT volume, min(g) lo, max(g) hi FROM scan GROUP BY 1) SELECT volume, z, y, x, CASE WHEN hi > lo THEN floor((g - lo) / (hi - lo)::DOUBLE * 65535) ELSE 0 END::INT wide, (g // 2)::INT half,
       greatest(0, least(255, 255 * (1.2 * (g - 20) / 220.0 + 10 / 255.0)))::DOUBLE::DECIMAL(12, 6)::DOUBLE shown FROM scan JOIN e USING (volume)""")
def gray_conversions(spark, d):
    """Rescaled to 16 bits by the volume's own range, halved to fewer bits, and as a screen shows it."""
    v = scan(spark, d)
    e = v.groupBy("volume").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    shown = F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255 * (1.2 * (F.col("g") - 20) / 220.0 + 10 / 255.0)))
    return v.join(e, "volume").select("volume", *AXES, rescaled_to(F.col("g"), F.col("lo"), F.col("hi"), 65535).alias("wide"), F.floor(F.col("g") / 2).cast("int").alias("half"), r6(shown).alias("shown"))


@query(f"WITH {SCAN} SELECT volume, z, avg(floor(greatest(0, least(255, 255 * (1.2 * (g - 20) / 220.0 + 10 / 255.0))))::INT)::DECIMAL(12, 6)::DOUBLE mean_shown FROM scan GROUP BY 1, 2")
def display_levels(spark, d):
    v = scan(spark, d).withColumn("s", displayed(F.col("g"), F.lit(20.0), F.lit(240.0)))
    return v.groupBy("volume", "z").agg(r6(F.avg("s")).alias("mean_shown"))


@query(f"""WITH {SCAN} SELECT a.z, a.y, a.x, a.g - b.g difference, a.g + b.g total FROM scan a JOIN scan b ON a.volume = 'A-0' AND b.volume = 'R-0' AND a.z = b.z AND a.y = b.y AND a.x = b.x""")
def volume_difference(spark, d):
    v = scan(spark, d)
    a, b = (v.where(F.col("volume") == f"{k}-0").select(*AXES, F.col("g").alias(k)) for k in "AR")
    return a.join(b, AXES).select(*AXES, (F.col("A") - F.col("R")).alias("difference"), (F.col("A") + F.col("R")).alias("total"))


@query(f"WITH {SCAN} SELECT volume, round(avg(g) / stddev_pop(g), 6) below, round((255 - avg(g)) / stddev_pop(g), 6) above FROM scan GROUP BY 1")
def headroom(spark, d):
    g = scan(spark, d).groupBy("volume").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("s"))
    return g.select("volume", r6(safe_ratio(F.col("m"), F.col("s"))).alias("below"), r6(safe_ratio(255 - F.col("m"), F.col("s"))).alias("above"))


@query(f"""WITH {SCAN}, e AS (SELECT volume, min(g) lo, max(g) hi, count(*) n FROM scan GROUP BY 1) SELECT volume, CASE WHEN n = 0 THEN 'empty' WHEN lo >= hi THEN 'no range' WHEN lo < 0 OR hi > 255 THEN 'out of range' ELSE 'ok' END verdict FROM e""")
def range_checks(spark, d):
    e = scan(spark, d).groupBy("volume").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n"))
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("lo") >= F.col("hi"), "no range").when((F.col("lo") < 0) | (F.col("hi") > 255), "out of range").otherwise("ok")
    return e.select("volume", verdict.alias("verdict"))


@query(f"""WITH {SCAN}, p AS (SELECT volume, z, avg(g) m FROM scan GROUP BY 1, 2), f AS (SELECT volume, z, abs(lead(m) OVER w - lag(m) OVER w) d FROM p WINDOW w AS (PARTITION BY volume ORDER BY z)),
       e AS (SELECT volume, z AS mid_z FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY round(d, 9) DESC, z) r FROM f WHERE d IS NOT NULL) WHERE r = 1) SELECT volume, z - (mid_z - 10) new_z, 7 - y new_y, x, g FROM scan JOIN e USING (volume) WHERE z BETWEEN mid_z - 10 AND mid_z + 10""")
def axial_crop(spark, d):
    """Slices within ten of the strongest edge along the axis, numbered anew, turned upside down."""
    v = scan(spark, d)
    p = v.groupBy("volume", "z").agg(F.avg("g").alias("m"))
    edge = windows.strongest_edge(p, ["volume"], "z", "m").select("volume", "at")
    out = v.join(checked_broadcast(cut(edge, "edge")), "volume").where(F.col("z").between(F.col("at") - 10, F.col("at") + 10))  # one row a volume
    return out.select("volume", (F.col("z") - F.col("at") + 10).alias("new_z"), (7 - F.col("y")).alias("new_y"), "x", "g")


@query(f"""WITH {SCAN}, c AS (SELECT volume, round_even(sum(g * y) / sum(g)::DOUBLE, 0)::BIGINT cy, round_even(sum(g * x) / sum(g)::DOUBLE, 0)::BIGINT cx FROM scan WHERE g > 130 GROUP BY 1)
       SELECT volume, z, y - cy + 3 new_y, x - cx + 3 new_x, g FROM scan JOIN c USING (volume) WHERE abs(y - cy) <= 3 AND abs(x - cx) <= 3 AND cy BETWEEN 3 AND 5 AND cx BETWEEN 3 AND 5""")
def radial_crop(spark, d):
    """A square of seven around the weighted centre of what is bright; volumes where it sticks out are left out."""
    v = scan(spark, d)
    c = v.where("g > 130").groupBy("volume").agg(*[F.bround(F.sum(F.col("g") * F.col(k)) / F.sum("g"), 0).cast("long").alias(f"c{k}") for k in "yx"])
    inside = (F.abs(F.col("y") - F.col("cy")) <= 3) & (F.abs(F.col("x") - F.col("cx")) <= 3) & F.col("cy").between(3, 5) & F.col("cx").between(3, 5)
    out = v.join(checked_broadcast(cut(c, "centres")), "volume").where(inside)  # one row a volume
    return out.select("volume", "z", (F.col("y") - F.col("cy") + 3).alias("new_y"), (F.col("x") - F.col("cx") + 3).alias("new_x"), "g")


@query()
def axis_angles(spark, d):
    """Tilt of each volume's bright part: angles of the principal axis of its voxels."""
    return volume.axis_angles(scan(spark, d).where("g > 130"), ["volume"], AXES)


# Rotation, outlines, planes


@query(f"""WITH {SCAN}, m AS (SELECT cos(radians(4.0)) ct, sin(radians(4.0)) st, cos(radians(-3.0)) cp, sin(radians(-3.0)) sp),
       a AS (SELECT volume, z, y, x, round(cp * z + sp * x + (73.5 - cp * 73.5 - sp * 3.5), 9) iz, round(-sp * st * z + ct * y + cp * st * x + (3.5 + sp * st * 73.5 - ct * 3.5 - cp * st * 3.5), 9) iy,
       round(-sp * ct * z - st * y + cp * ct * x + (3.5 + sp * ct * 73.5 + st * 3.5 - cp * ct * 3.5), 9) ix FROM scan, m),
       r AS (SELECT a.*, floor(iz)::BIGINT + i.range cz, floor(iy)::BIGINT + j.range cy, floor(ix)::BIGINT + k.range cx, CASE i.range WHEN 1 THEN iz - floor(iz) ELSE 1 - (iz - floor(iz)) END * CASE j.range WHEN 1 THEN iy - floor(iy) ELSE 1 - (iy - floor(iy)) END
       * CASE k.range WHEN 1 THEN ix - floor(ix) ELSE 1 - (ix - floor(ix)) END w FROM a, range(2) i, range(2) j, range(2) k)
       SELECT r.volume, r.z, r.y, r.x, round(sum(w * coalesce(s.g, 0)), 5) g FROM r LEFT JOIN scan s ON s.volume = r.volume AND s.z = r.cz AND s.y = r.cy AND s.x = r.cx GROUP BY 1, 2, 3, 4""")
def rotated_volume(spark, d):
    """Both tilts taken out in one resampling about the middle of the volume."""
    shape = (148, 8, 8)
    matrix = geometry.plane_rotation(4.0, (1, 2)) @ geometry.plane_rotation(-3.0, (0, 2))
    out = geometry.resampled(scan(spark, d), ["volume"], "g", matrix, geometry.about_centre(matrix, shape))
    return out.select("volume", *AXES, F.round("g", 5).alias("g"))


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    """Edges of star-shaped outlines: the points of each label in the order of their angle."""
    p = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", (12 + 20 * F.col("embedding")[1].cast("double")).alias("y"), (12 + 20 * F.col("embedding")[0].cast("double")).alias("x"))
    w = Window.partitionBy("label").orderBy(F.round(F.atan2(F.col("y") - 12, F.col("x") - 12), 9), "vec_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return p.select("label", F.col("y").alias("y0"), F.col("x").alias("x0"), nxt("y").alias("y1"), nxt("x").alias("x1"))


OUTLINE = """p AS (SELECT vec_id, label, 12 + 20 * embedding[2]::DOUBLE y, 12 + 20 * embedding[1]::DOUBLE x FROM embeddings), o AS (SELECT *, round(atan2(y - 12, x - 12), 9) a FROM p),
          e AS (SELECT label, y y0, x x0, coalesce(lead(y) OVER w, first(y) OVER v) y1, coalesce(lead(x) OVER w, first(x) OVER v) x1 FROM o WINDOW w AS (PARTITION BY label ORDER BY a, vec_id), v AS (PARTITION BY label ORDER BY a, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
          s AS (SELECT i.range r, j.range c, (i.range + 0.5) / 4 sy, (j.range + 0.5) / 4 sx FROM range(96) i, range(96) j),
          inside AS (SELECT label, r, c FROM s JOIN e ON least(y0, y1) <= sy AND greatest(y0, y1) > sy GROUP BY 1, 2, 3, sy, sx HAVING count(*) FILTER (x0 + (sy - y0) * (x1 - x0) / (y1 - y0) <= sx) % 2 = 1),
          cover AS (SELECT label, (r // 4)::INT y, (c // 4)::INT x, count(*) / 16.0::DOUBLE coverage FROM inside GROUP BY 1, 2, 3)"""


@query(f"WITH {OUTLINE} SELECT label, y, x, coverage FROM cover")
def outline_coverage(spark, d):
    return geometry.polygon_coverage(_outlines(spark, d), ["label"], 24, 24, 4)


@query(f"""WITH {OUTLINE}, mask AS (SELECT DISTINCT y, x FROM cover WHERE label = 0 AND coverage >= 0.5) SELECT label, round(sum(coverage * (m IS NOT NULL)::INT) / (sum(coverage) + (SELECT count(*) FROM mask) - sum(coverage * (m IS NOT NULL)::INT)), 6) iou
       FROM cover LEFT JOIN (SELECT y, x, 1 m FROM mask) USING (y, x) GROUP BY 1""")
def outline_iou(spark, d):
    """Overlap of each outline with the first one's mask."""
    cover = cut(geometry.polygon_coverage(_outlines(spark, d), ["label"], 24, 24, 4), "coverage")
    mask = cover.where("label = 0 and coverage >= 0.5").select("y", "x")
    return geometry.coverage_iou(cover, mask, ["label"]).select("label", r6("iou").alias("iou"))


def _walk8(rows: str, name: str) -> str:
    near = "a.volume = b.volume AND a.z = b.z AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id"
    return f"""{name}_w(id, seen) AS (SELECT id, id FROM {rows} UNION SELECT w.id, b.id FROM {name}_w w JOIN {rows} a ON a.id = w.seen JOIN {rows} b ON {near}), {name} AS (SELECT id, min(seen) component FROM {name}_w GROUP BY 1)"""


IDS = "(((ascii(volume) - 64 + 32 * split_part(volume, '-', 2)::BIGINT) * 128 + z) * 24 + y) * 24 + x"
BRIGHT = f"{SCAN}, bright AS (SELECT *, {IDS} id FROM scan WHERE g >= 150), {_walk8('bright', 'parts')}"


def _bright(spark: SparkSession, d: str, low: float) -> DataFrame:
    number = F.ascii("volume") - 64 + 32 * F.split_part("volume", F.lit("-"), F.lit(2)).cast("long")
    v = scan(spark, d).withColumn("id", (((number * SLICES + F.col("z")) * EDGE + F.col("y")) * EDGE + F.col("x")).cast("long"))
    return v.where(F.col("g") >= low)


@query(f"""WITH RECURSIVE {BRIGHT}
       SELECT volume, z, component, count(*) area, max(g) peak, round(avg(y), 6) cy, round(avg(x), 6) cx FROM bright JOIN parts USING (id) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def slice_objects(spark, d):
    """Bright objects of each slice, connected over corners too, of at least two pixels."""
    found = volume.labelled(_bright(spark, d, 150), ["volume", "z"], ["y", "x"], "id", diagonal=True)
    g = found.groupBy("volume", "z", "component").agg(F.count("*").alias("area"), F.max("g").alias("peak"), r6(F.avg("y")).alias("cy"), r6(F.avg("x")).alias("cx"))
    return g.where("area >= 2")


@query(f"""WITH RECURSIVE {BRIGHT}, kept AS (SELECT component FROM bright JOIN parts USING (id) GROUP BY 1 HAVING max(g) >= 180 AND count(*) >= 3), metal AS (SELECT volume, z, y, x FROM bright JOIN parts USING (id) WHERE component IN (SELECT component FROM kept)),
       wide AS (SELECT volume, z, y, x FROM metal UNION SELECT volume, z, y + 1, x FROM metal UNION SELECT volume, z, y - 1, x FROM metal UNION SELECT volume, z, y, x + 1 FROM metal UNION SELECT volume, z, y, x - 1 FROM metal)
       SELECT volume, z, y, x FROM wide WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7""")
def metal_mask(spark, d):
    """Metal of each slice: parts above a lower level that hold a pixel above the threshold and have three pixels at
    least, grown by one pixel."""
    found = volume.hysteresis(_bright(spark, d, 150), ["volume", "z"], ["y", "x"], "g", 150, 180, "id", diagonal=True)
    big = found.groupBy("component").agg(F.count("*").alias("n")).where("n >= 3").select("component")
    metal = found.join(big, "component", "left_semi").select("volume", *AXES)
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    wide = metal.select("volume", "z", F.col("y"), F.col("x"), F.explode(steps).alias("s")).select("volume", "z", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return wide.where("y between 0 and 7 and x between 0 and 7").distinct()


@query(f"""WITH {SNR}, hot AS (SELECT * FROM snr WHERE snr >= 1.0), n AS (SELECT a.volume, a.z, a.y, a.x, count(*) n FROM hot a JOIN hot b ON a.volume = b.volume AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, 4)
       SELECT volume, z, y, x, n FROM n WHERE n > 5""")
def enhanced_voxels(spark, d):
    """Voxels with more than five strong ones among the 27 around them."""
    return residual.crowded(_snr(spark, d).where("snr >= 1.0"), 5)


@query(f"WITH RECURSIVE {FOUND} SELECT component, y, x, round(least(sum(snr * 0.5), max(max(snr)) OVER (PARTITION BY component)), 7) confidence FROM objects GROUP BY 1, 2, 3")
def confidence_projection(spark, d):
    """Objects projected along the axis: half their strength added up, at most their largest."""
    o = _found(spark, d)[1]
    top = o.groupBy("component").agg(F.max("snr").alias("top"))
    p = o.groupBy("component", "y", "x").agg(F.sum(F.col("snr") * 0.5).alias("s")).join(top, "component")
    return p.select("component", "y", "x", F.round(F.least("s", "top"), 7).alias("confidence"))


@query()
def metal_thresholds(spark, d):
    """The gray value that divides metal from the rest, by volume."""
    h = scan(spark, d).groupBy("volume", "g").agg(F.count("*").alias("n"))
    return thresholds.metal_threshold(h, ["volume"], "g", "n")


@query(f"WITH {SCAN} SELECT volume, z, y, x, g - round((coalesce(lag(g) OVER w, g) + g + coalesce(lead(g) OVER w, g)) / 3.0, 6) r FROM scan WINDOW w AS (PARTITION BY volume, y, x ORDER BY z)")
def rolling_residual(spark, d):
    """Gray value minus the mean of the slice and its two neighbours; at an end the slice stands for the missing one."""
    w = Window.partitionBy("volume", "y", "x").orderBy("z")
    near = (F.coalesce(F.lag("g").over(w), F.col("g")) + F.col("g") + F.coalesce(F.lead("g").over(w), F.col("g"))) / 3
    return scan(spark, d).select("volume", *AXES, (F.col("g") - F.round(near, 6)).alias("r"))
