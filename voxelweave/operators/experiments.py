"""Recall of experiments by size and place, rank codes of grids, votes of outer labels, views of one peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import safe_ratio
from voxelweave.functions.storage import checked_broadcast, cut
from voxelweave.operators.stats import clopper_pearson
from voxelweave.operators.volume import labelled
from voxelweave.operators.windows import FEW, running


def _levels(objects: DataFrame, size: str, levels: list[float]) -> DataFrame:
    """An object once for each level that its size reaches; a missing size reaches none."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in levels]), lambda t: t <= F.col(size))
    return objects.withColumn("level", F.explode(reached))


def recall_by_size(objects: DataFrame, found: list[str], size: str, truth: str, levels: list[float]) -> DataFrame:
    """(level, window, n, hits, recall, n_false, false_hits, false_ratio) over objects of at least each size: how many true
    ones (truth = 1) and false ones (0) each window found (its column of `found` is 1). Other truths, and sizes
    below all levels, don't count. One pass: sums of all windows by level, then turned into rows."""
    true, false = F.col(truth) == 1, F.col(truth) == 0
    sums = [F.count_if(c & (F.col(w) == 1)).alias(f"{k}_{w}") for w in found for k, c in (("t", true), ("f", false))]
    g = _levels(objects, size, levels).groupBy("level").agg(F.count_if(true).alias("n"), F.count_if(false).alias("n_false"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"t_{w}").alias("hits"), F.col(f"f_{w}").alias("false_hits")) for w in found]))
    t = g.select("level", "n", "n_false", each.alias("w")).select("level", "n", "n_false", "w.*")
    return t.select(
        "level", "window", "n", "hits", safe_ratio(F.col("hits"), F.col("n")).alias("recall"), "n_false", "false_hits", (F.col("false_hits") / F.greatest("hits", F.lit(1))).alias("false_ratio")
    )


def recall_intervals(recall: DataFrame, windows: int, alpha: float = 0.05) -> DataFrame:
    """recall_by_size with exact intervals of the recall: nominal (low, high) and, for as many comparisons as there are
    windows, Bonferroni's (low_all, high_all)."""
    one = clopper_pearson(recall, "hits", "n", alpha)
    every = clopper_pearson(one.withColumnsRenamed({"low": "_low", "high": "_high"}), "hits", "n", alpha / windows)
    return every.withColumnsRenamed({"low": "low_all", "high": "high_all"}).withColumnsRenamed({"_low": "low", "_high": "high"})


def band_of(value: Column, bounds: list[float]) -> Column:
    """Number of the band [bounds[i], bounds[i + 1]) that holds value; null outside all of them, and for NaN."""
    out = None
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        inside = (value >= lo) & (value < hi)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def radial_bands(objects: DataFrame, radial: str, size: str, truth: str, levels: list[float], bounds: list[float]) -> DataFrame:
    """(level, band, n_true, n_false, of_band, of_false): true and false objects by distance band at each least size, the
    share of a band that is false and the share of all false ones that lie in it (outside all bands included)."""
    t = _levels(objects.where(F.col(truth).isin(0, 1)), size, levels).withColumn("band", band_of(F.col(radial), bounds))
    g = t.groupBy("level", "band").agg(F.count_if(F.col(truth) == 1).alias("n_true"), F.count_if(F.col(truth) == 0).alias("n_false"))
    every = g.withColumn("_all", F.sum("n_false").over(Window.partitionBy("level")))  # a row a level and band
    share = lambda n: F.col("n_false") / F.greatest(n, F.lit(1))
    return every.where("band is not null").select("level", "band", "n_true", "n_false", share(F.col("n_true") + F.col("n_false")).alias("of_band"), share(F.col("_all")).alias("of_false"))


def rank_codes(rows: DataFrame, value: str, name: str = "code") -> DataFrame:
    """rows with the number, from 0, of their value among the distinct ones, in order; null where the value is null or NaN."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    codes = running(known.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1)), [], [value], ["_one"], FEW)
    codes = codes.select(F.col(value).alias("_value"), F.col("_one_before").cast("int").alias(name))
    return rows.join(checked_broadcast(cut(codes, "codes")), F.col(value) == F.col("_value"), "left").drop("_value")


def outer_label_vote(labels: DataFrame, keys: list[str], label: str, height: int, width: int) -> DataFrame:
    """(keys, label, votes): the label that most often is the first or last one on the two centre lines of an image of
    labelled pixels (y, x, label > 0); of equally frequent ones the smallest. Images without a label on
    either line give no row."""
    p = labels.where(F.col(label) > 0)
    ends = []
    for axis, middle, along in (("y", height // 2, "x"), ("x", width // 2, "y")):
        line = p.where(F.col(axis) == middle).groupBy(*keys).agg(F.min_by(label, along).alias("first"), F.max_by(label, along).alias("last"))
        ends.append(line.select(*keys, F.explode(F.array("first", "last")).alias("label")))
    votes = ends[0].unionByName(ends[1]).groupBy(*keys, "label").agg(F.count("*").alias("votes"))
    return votes.groupBy(*keys).agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))


# Highest noise of a view, the multiple of it that a peak stands for, and the thresholds of a view.
PROXY_TOP, PROXY_PEAK, PROXY_HIGH, PROXY_LOW = 2.7, 4.2, 4.0, 2.8


def peak_views(pixels: DataFrame, peaks: DataFrame, key: str, value: str, number: str, area: int = 1) -> DataFrame:
    """Pixels (key, y, x, value, number) of a projection that belong to what stands out around its peak (key, y, x): those
    connected (over corners too) above the lower threshold to a part of at least `area` pixels above the upper one.

    The thresholds are multiples of a noise that the peak itself gives: the mean of the two highest of the nine pixels
    around it, divided; it has an upper limit. `number` is a pixel's own number, ascending within the table.
    Only one noise a view is joined, broadcast after a size check.
    """
    spot = peaks.select(key, F.col("y").alias("_y"), F.col("x").alias("_x"))
    near = pixels.join(checked_broadcast(spot), key).where((F.abs(F.col("y") - F.col("_y")) <= 1) & (F.abs(F.col("x") - F.col("_x")) <= 1))
    top = F.slice(F.sort_array(F.collect_list(F.col(value).cast("double")), asc=False), 1, 2)  # of nine at most
    noise = near.groupBy(key).agg(top.alias("_top"))
    noise = noise.select(key, F.least(F.lit(PROXY_TOP), F.aggregate("_top", F.lit(0.0), lambda a, b: a + b) / F.size("_top") / PROXY_PEAK).alias("_noise"))
    grown = pixels.join(checked_broadcast(cut(noise, "noise")), key).where(F.col(value) > PROXY_LOW * F.col("_noise"))
    parts = labelled(grown, [key], ["y", "x"], number, diagonal=True)
    strong = parts.where(F.col(value) > PROXY_HIGH * F.col("_noise"))
    if area > 1:
        cores = labelled(strong.withColumnRenamed("component", "_part"), [key], ["y", "x"], number, diagonal=True)
        strong = cores.groupBy("component", "_part").count().where(F.col("count") >= area).select(F.col("_part").alias("component"))
    kept = checked_broadcast(cut(strong.select("component").distinct(), "kept"))
    return parts.join(kept, "component", "left_semi").select(key, "y", "x", value, number, "component")
