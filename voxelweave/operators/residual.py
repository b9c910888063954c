"""From a gray volume to its residual, its noise and the surroundings of what is found in it."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import median_noise_scale, safe_ratio
from voxelweave.functions.storage import cut, light_broadcast
from voxelweave.operators.volume import labelled, neighbours
from voxelweave.operators.windows import clamped_windows, quantiles

AXES = ["z", "y", "x"]
PLANE = ["volume", "y", "x"]


def residuals(scan: DataFrame, width: int, metal: float) -> DataFrame:
    """(volume, z, y, x, g, r): gray value minus the truncated median of the `width` slices around it; 0 where
    their maximum is above the metal threshold. A line of voxels is as long as a volume is deep, so lines aren't counted."""
    w = clamped_windows(scan, PLANE, ["z"], "g", width, carry=("g",), long=0)
    r = F.when(F.col("most") > metal, F.lit(0)).otherwise(F.col("g") - F.floor("mid")).cast("long")
    return w.select("volume", "z", "y", "x", "g", r.alias("r"))


def slice_noise(scan: DataFrame) -> DataFrame:
    """(volume, z, n, sigma, rho1, rho2) from the five slices that begin at z: variance and correlations at lags 1 and
    2 solve the moments of first and second differences; voxels with a zero difference don't count. Null
    where the solution is no noise (variance or correlations out of range)."""
    w = Window.partitionBy(*PLANE).orderBy("z")
    s = scan.select("volume", "z", *[(F.col("g") if k == 0 else F.lead("g", k).over(w)).alias(f"s{k}") for k in range(5)]).where("s4 is not null")
    d = s.selectExpr("volume", "z", "s0 - s1 d1", "s1 - s2 d2", "s0 - 2 * s1 + s2 da", "s2 - 2 * s3 + s4 db").where("d1 <> 0 and d2 <> 0 and da <> 0 and db <> 0")
    g = d.groupBy("volume", "z").agg(
        F.count("*").alias("n"), ((F.var_samp("d1") + F.var_samp("d2")) / 2).alias("v1"), ((F.var_samp("da") + F.var_samp("db")) / 2).alias("v2"), F.covar_samp("da", "db").alias("v3")
    ).where("n >= 2")
    v1, v2, v3 = F.col("v1"), F.col("v2"), F.col("v3")
    a = (v3 - 3 * v2 + 10 * v1) / 3  # the 3 x 3 system, solved by hand
    g = g.withColumn("a", a).withColumn("rho1", safe_ratio(F.col("a") - v1 / 2, F.col("a"))).withColumn("rho2", safe_ratio(F.col("a") + v2 / 2 - 2 * v1, F.col("a")))
    ok = (F.col("a") > 0) & (F.abs("rho1") < 1) & (F.abs("rho2") < 1)
    return g.select("volume", "z", "n", *[F.when(ok, c).alias(k) for k, c in (("sigma", F.sqrt("a")), ("rho1", F.col("rho1")), ("rho2", F.col("rho2")))])


def residual_sigma(noise: DataFrame, width: int) -> DataFrame:
    """(volume, z, sigma_r): noise of the residual of each slice that has an estimate."""
    known = noise.where("sigma is not null")
    return known.select("volume", "z", (F.col("sigma") * median_noise_scale(width, F.col("rho1"), F.col("rho2"))).alias("sigma_r"))


def snr(scan: DataFrame, width: int, metal: float) -> DataFrame:
    """residuals with snr, by the sigma of the slice or, where it has none, the mean one of the volume; volumes
    without any estimate are left out. Only (volume, z) rows are broadcast, after a size check."""
    sigma = cut(residual_sigma(slice_noise(scan), width), "sigma")
    mean = sigma.groupBy("volume").agg(F.avg("sigma_r").alias("sigma_v"))
    r = residuals(scan, width, metal).join(light_broadcast(mean), "volume").join(light_broadcast(sigma), ["volume", "z"], "left")
    return r.select("volume", "z", "y", "x", "g", "r", F.round(F.col("r") / F.coalesce("sigma_r", "sigma_v"), 6).alias("snr"))


def rings(objects: DataFrame, radius: int) -> DataFrame:
    """(volume, component, z, y, x, d): voxels within `radius` steps over faces of an object, by their least number
    of steps d; 0 in the object. A dilation by faces is a ball of the city-block distance."""
    span = range(-radius, radius + 1)
    offsets = [o for o in itertools.product(span, span, span) if sum(map(abs, o)) <= radius]
    o = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(at, AXES)], F.lit(sum(map(abs, at))).alias("d")) for at in offsets])).alias("o")
    near = objects.select("volume", "component", *AXES, o).select("volume", "component", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in AXES], "o.d")
    return near.groupBy("volume", "component", *AXES).agg(F.min("d").alias("d"))


def inner_edge(objects: DataFrame, key: str) -> DataFrame:
    """Voxels of objects with a face on something else."""
    n = neighbours(objects.select("volume", "component", *AXES, key), ["volume", "component"], AXES, key)
    inside = n.select(F.col("a").alias(key)).unionByName(n.select(F.col("b").alias(key))).groupBy(key).count().where("count = 6").select(key)
    return objects.join(inside.hint("merge"), key, "left_anti")


def _medians(rows: DataFrame, value: str, name: str) -> DataFrame:
    return quantiles(rows, ["component"], value, {name: 0.5})


def shell_features(voxels: DataFrame, objects: DataFrame, key: str, radius: int = 3) -> DataFrame:
    """(component, edge_contrast, decay_drop): snr of the object's edge over that of the surrounding shell (2 to radius
    steps away), and how much it falls from the first ring to the second. Zeroed voxels don't count; null
    without a shell."""
    ring = rings(objects, radius).where("d > 0").join(voxels.select("volume", *AXES, "r", "snr"), ["volume", *AXES]).where("r <> 0")
    ring = cut(ring.select("component", "d", "snr"), "rings")
    parts = [_medians(inner_edge(objects, key), "snr", "edge"), _medians(ring.where("d > 1"), "snr", "shell"), _medians(ring.where("d = 1"), "snr", "one"), _medians(ring.where("d = 2"), "snr", "two")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "component", "left")
    return out.select("component", (F.col("edge") - F.col("shell")).alias("edge_contrast"), (F.col("one") - F.col("two")).alias("decay_drop"))


def grayscale_features(voxels: DataFrame, objects: DataFrame, key: str, metal: float, radius: int = 3) -> DataFrame:
    """(component, gs_median, gs_p90, gs_peak, gs_iqr, gs_shell_median, gs_contrast): level and spread of the gray
    values, and the edge over the shell 2 to radius steps away, without zeroed voxels and metal."""
    own = quantiles(objects, ["component"], "g", {"gs_median": 0.5, "gs_p90": 0.9, "q25": 0.25, "q75": 0.75})
    peak = objects.groupBy("component").agg(F.max("g").alias("gs_peak"))
    ring = rings(objects, radius).where("d > 1").join(voxels.select("volume", *AXES, "r", "g"), ["volume", *AXES]).where((F.col("r") != 0) & (F.col("g") <= metal))
    out = own.join(peak, "component").join(_medians(ring, "g", "gs_shell_median"), "component", "left").join(_medians(inner_edge(objects, key), "g", "edge"), "component", "left")
    return out.select("component", "gs_median", "gs_p90", "gs_peak", (F.col("q75") - F.col("q25")).alias("gs_iqr"), "gs_shell_median", (F.col("edge") - F.col("gs_shell_median")).alias("gs_contrast"))


def _tagged(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(component, what, v): a row for each value of a row that is not missing."""
    each = F.array(*[F.struct(F.lit(what).alias("what"), v.cast("double").alias("v")) for what, v in values.items()])
    return rows.select("component", F.explode(each).alias("e")).select("component", "e.what", "e.v").where("v is not null")


def surroundings(voxels: DataFrame, objects: DataFrame, key: str, metal: float, radius: int = 3) -> DataFrame:
    """All of shell_features and grayscale_features but the peak. Rings and edges are found once, and the values of
    all kinds are ranked together, so one shuffle serves every quantile and nothing is broadcast by object."""
    d, g, snr = F.col("d"), F.col("g"), F.col("snr")
    ring = rings(objects, radius).where("d > 0").join(voxels.select("volume", *AXES, "r", "g", "snr").hint("merge"), ["volume", *AXES]).where("r <> 0")
    ring = _tagged(ring, {"shell": F.when(d > 1, snr), "one": F.when(d == 1, snr), "two": F.when(d == 2, snr), "gs_shell": F.when((d > 1) & (g <= metal), g)})
    rows = ring.unionByName(_tagged(inner_edge(objects, key), {"edge": snr, "gs_edge": g})).unionByName(_tagged(objects, {"gs": g}))
    q = quantiles(rows, ["component", "what"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9})
    at = lambda what, share="q50": F.max(F.when(F.col("what") == what, F.col(share)))
    return q.groupBy("component").agg(
        (at("edge") - at("shell")).alias("edge_contrast"), (at("one") - at("two")).alias("decay_drop"), at("gs").alias("gs_median"), at("gs", "q90").alias("gs_p90"),
        (at("gs", "q75") - at("gs", "q25")).alias("gs_iqr"), at("gs_shell").alias("gs_shell_median"), (at("gs_edge") - at("gs_shell")).alias("gs_contrast"),
    )


def seed_offsets(objects: DataFrame, value: str, high: float, key: str) -> DataFrame:
    """(component, n_seed_regions, seed_offset): parts of an object above `high`, and the largest distance of one's
    weighted centre from the object's: two merged objects show here."""
    centre = lambda d, keys, tag: d.groupBy(*keys).agg(*[(F.sum(F.col(value) * F.col(c)) / F.sum(value)).alias(f"{tag}{c}") for c in AXES])
    whole = centre(objects, ["component"], "o")
    seeds = objects.where(F.col(value) >= high).withColumnRenamed("component", "object")
    parts = labelled(seeds, ["volume"], AXES, key).withColumnRenamed("component", "part")
    mid = centre(parts, ["object", "part"], "p").withColumnRenamed("object", "component").join(whole, "component")
    far = sum(((F.col(f"p{c}") - F.col(f"o{c}")) * (F.col(f"p{c}") - F.col(f"o{c}")) for c in AXES[1:]), (F.col("pz") - F.col("oz")) * (F.col("pz") - F.col("oz")))
    return mid.groupBy("component").agg(F.count("*").alias("n_seed_regions"), F.max(F.sqrt(far)).alias("seed_offset"))


def voxel_dump(voxels: DataFrame, objects: DataFrame, margin: int) -> DataFrame:
    """Voxels of each object's box, widened by margin, with in_grown 1 in the object itself. Slices of a box are
    joined, rows and columns filtered, so a box costs as many rows as it has slices."""
    ends = [f(c).alias(f"{c}{k}") for c in AXES for k, f in ((0, F.min), (1, F.max))]
    box = objects.groupBy("volume", "component").agg(*ends)
    box = box.withColumn("z", F.explode(F.sequence(F.col("z0") - margin, F.col("z1") + margin)))
    inside = F.col("y").between(F.col("y0") - margin, F.col("y1") + margin) & F.col("x").between(F.col("x0") - margin, F.col("x1") + margin)
    dump = voxels.join(box, ["volume", "z"]).where(inside).select("component", "volume", *AXES, "r", "g")
    own = objects.select("component", "volume", *AXES, F.lit(1).alias("own"))
    return dump.join(own, ["component", "volume", *AXES], "left").select("component", "volume", *AXES, "r", "g", F.coalesce("own", F.lit(0)).alias("in_grown"))


def noise_collapse(voxels: DataFrame, key: str, highs: list[float], sizes: list[int]) -> DataFrame:
    """(volume, high, m, n): connected parts of at least m voxels above each threshold; all thresholds are labelled
    together."""
    reached = F.explode(F.array(*[F.lit(float(h)) for h in highs])).alias("high")
    wide = len(highs)
    v = voxels.select("volume", *AXES, key, "snr", reached).where("snr >= high")
    rank = F.array_position(F.array(*[F.lit(float(h)) for h in highs]), F.col("high")) - 1
    v = v.select("volume", "high", *AXES, (F.col(key) * wide + rank).cast("long").alias("id"))
    n = labelled(v, ["volume", "high"], AXES, "id").groupBy("volume", "high", "component").agg(F.count("*").alias("c"))
    return n.groupBy("volume", "high").agg(*[F.count_if(F.col("c") >= m).alias(f"m{m}") for m in sizes]).unpivot(["volume", "high"], [f"m{m}" for m in sizes], "m", "n").select(
        "volume", "high", F.substring("m", 2, 9).cast("int").alias("m"), "n"
    )


def crowded(voxels: DataFrame, least: int) -> DataFrame:
    """(volume, z, y, x, n): voxels with more than `least` of the table's among the 27 around them, itself included.
    Each voxel tells its neighbourhood; the counts are added up before the shuffle."""
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(at, AXES)]) for at in itertools.product((-1, 0, 1), repeat=3)])).alias("o")
    told = voxels.select("volume", *AXES, around).select("volume", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in AXES])
    n = told.groupBy("volume", *AXES).agg(F.count("*").alias("n")).where(F.col("n") > least)
    return n.join(voxels.select("volume", *AXES), ["volume", *AXES], "left_semi")
