"""Summaries, classifier metrics and estimators as aggregate plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import right_closed_bin, safe_ratio
from voxelweave.operators.windows import FEW, quantiles, running


def two_level_ci(rows: DataFrame, keys: list[str], seed: str, metrics: list[str]) -> DataFrame:
    """Per condition and metric: mean, sd, count, standard error and 95 % half-width over seeds of
    the mean of each seed's rows."""
    long = rows.unpivot([*keys, seed], metrics, "metric", "value")
    per = long.groupBy(*keys, seed, "metric").agg(F.avg("value").alias("value"))
    out = per.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    sem = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return out.withColumn("sem", sem).withColumn("ci95", 1.96 * sem)


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sd, min, quartiles and max by group; quartiles interpolate exactly."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = quantiles(rows, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return out.join(q, keys, "left").select(*keys, "n", "mean", "sd", "least", "q25", "q50", "q75", "most")


def calibration(rows: DataFrame, p: str, y: str, w: str, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Weighted mean prediction and outcome by right-closed bin; empty bins don't appear."""
    g = rows.withColumn("bin", right_closed_bin(F.col(p), bins)).groupBy(*(keys or []), "bin")
    total = F.sum(w)
    return g.agg((F.sum(F.col(p) * F.col(w)) / total).alias("mean_p"), (F.sum(F.col(y) * F.col(w)) / total).alias("mean_y"), total.alias("weight"))


def threshold_metrics(rows: DataFrame, p: str, y: str, w: str, thresholds: list[float]) -> DataFrame:
    """Weighted precision, recall and F1 for p >= t; null where undefined. One pass: rows are first
    summed by the number of thresholds they reach."""
    reached = sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in sorted(thresholds)[1:]), F.when(F.col(p) >= min(thresholds), 1).otherwise(0))
    part = rows.groupBy(reached.alias("k")).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(F.col(w))).alias("neg"))
    ts = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(i + 1).alias("i")) for i, t in enumerate(sorted(thresholds))])
    each = part.select("*", F.explode(ts).alias("x"))
    hit = F.col("k") >= F.col("x.i")
    g = each.groupBy(F.col("x.t").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0.0)).alias("fp"), F.sum("pos").alias("all")
    )
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("all"))
    return g.select("threshold", precision.alias("prec"), recall.alias("recall"), safe_ratio(2 * precision * recall, precision + recall).alias("f1"))


def auc(rows: DataFrame, score: str, y: str, keys: list[str]) -> DataFrame:
    """Area under the ROC by mid-ranks of tied scores; null unless both classes occur.

    Scores are counted first and ranked by running sums over ranges of them.
    """
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos")
    ties = running(rows.groupBy(*keys, score).agg(F.count("*").alias("n"), pos), keys, [score], ["n"], FEW)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    g = ties.withColumn("r", rank * F.col("pos")).groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("pos").cast("double").alias("n1"), (F.sum("n") - F.sum("pos")).cast("double").alias("n0"))
    return g.select(*keys, safe_ratio(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))


def average_precision(rows: DataFrame, score: str, y: str, w: str, keys: list[str]) -> DataFrame:
    """Weighted average precision: ties grouped, step-wise sum of precision times recall gained."""
    t = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("tp"), F.sum(w).alias("weight"))
    up = running(t, keys, [score], ["tp", "weight"], FEW)
    down = lambda c: F.col(f"{c}_all") - F.col(f"{c}_before")  # noqa: E731  of this score and all higher ones
    g = up.withColumn("prec", down("tp") / down("weight")).groupBy(*keys).agg(F.sum(F.col("tp") * F.col("prec")).alias("s"), F.sum("tp").alias("t"))
    return g.select(*keys, safe_ratio(F.col("s"), F.col("t")).alias("ap"))


def brier(rows: DataFrame, p: str, y: str, w: str, keys: list[str]) -> DataFrame:
    d = F.col(p) - F.col(y)
    return rows.groupBy(*keys).agg((F.sum(F.col(w) * d * d) / F.sum(w)).alias("brier"))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) for all bins; the last includes hi; values outside are left out."""
    width = (hi - lo) / bins
    v = F.col(value)
    b = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    counted = rows.where(v.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def robust_noise(rows: DataFrame, keys: list[str], value: str, clip: float = 3.5) -> DataFrame:
    """1.4826 * median absolute deviation, again after values beyond clip deviations are dropped."""
    def mad(d: DataFrame, tag: str) -> DataFrame:
        m = quantiles(d, keys, value, {"m" + tag: 0.5})
        away = d.join(m, keys).select(*keys, F.abs(F.col(value) - F.col("m" + tag)).alias("away"))
        return m.join(quantiles(away, keys, "away", {"d" + tag: 0.5}), keys)

    first = mad(rows, "1")
    near = rows.join(first, keys).where(F.abs(F.col(value) - F.col("m1")) <= clip * F.col("d1"))
    return mad(near.select(*keys, value), "2").select(*keys, (1.4826 * F.col("d2")).alias("noise"))


def moments(rows: DataFrame, keys: list[str], axes: tuple[str, str]) -> DataFrame:
    """Second moments (by n, plus 1/12 for the width of a voxel), principal axes of the 2x2 matrix,
    elongation."""
    a, b = axes
    s = rows.groupBy(*keys).agg(
        (F.var_pop(a) + 1 / 12).alias("aa"), (F.var_pop(b) + 1 / 12).alias("bb"), F.covar_pop(a, b).alias("ab"), F.count("*").alias("n")
    )
    mid, off = (F.col("aa") + F.col("bb")) / 2, F.sqrt(F.pow((F.col("aa") - F.col("bb")) / 2, 2) + F.pow("ab", 2))
    return s.withColumn("l1", mid + off).withColumn("l2", mid - off).withColumn("elongation", safe_ratio(F.col("l1") - F.col("l2"), F.col("l1")))


def linear_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def circle_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares circle from sums: centre and radius by the normal equations of
    x^2 + y^2 = 2ax + 2by + q, taken about the group's mean."""
    mean = rows.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = rows.join(mean, keys).withColumn("u", F.col(x) - F.col("mx")).withColumn("v", F.col(y) - F.col("my"))
    u, v = F.col("u"), F.col("v")
    s = d.groupBy(*keys, "mx", "my").agg(
        F.count("*").alias("n"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(u * (u * u + v * v)).alias("ru"), F.sum(v * (u * u + v * v)).alias("rv"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a = safe_ratio(F.col("ru") * F.col("vv") - F.col("rv") * F.col("uv"), 2 * det)
    b = safe_ratio(F.col("rv") * F.col("uu") - F.col("ru") * F.col("uv"), 2 * det)
    r = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(*keys, (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), r.alias("radius"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or 1e-300)
            c = (1 + t / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def _quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_tail(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(counts: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """counts with the exact binomial interval (low, high) of k of n; (0, 1) if n is 0."""
    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low = [0.0 if not kk or not nn else _quantile(alpha / 2, kk, nn - kk + 1) for kk, nn in zip(b[k], b[n])]
            high = [1.0 if kk == nn or not nn else _quantile(1 - alpha / 2, kk + 1, nn - kk) for kk, nn in zip(b[k], b[n])]
            yield b.assign(low=low, high=high)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema) + ", low double, high double"
    return counts.mapInPandas(bounds, schema)


def _discrete_normal(v: np.ndarray, c: np.ndarray) -> tuple[float, float] | None:
    """(mu, sd) of the most likely normal law on the whole numbers v, observed c times each; None if none has a peak.
    Its log density is linear in (v, v^2), so the likelihood is concave and Newton's method meets both means."""
    if len(v) < 3:
        return None
    at, scale = v.mean(), max(float(v.std()), 1.0)
    t = np.stack([(v - at) / scale, ((v - at) / scale) ** 2])
    share = c / c.sum()
    theta = np.array([0.0, -0.5])
    for _ in range(200):
        law = theta @ t
        p = np.exp(law - law.max())
        p /= p.sum()
        mean = t @ p
        spread = (t * p) @ t.T - np.outer(mean, mean)
        step = np.linalg.lstsq(spread, t @ share - mean, rcond=None)[0]
        theta = theta + step * min(1.0, 2.0 / max(1e-300, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    if theta[1] >= 0:
        return None
    return float(at - scale * theta[0] / (2 * theta[1])), float(scale * math.sqrt(-0.5 / theta[1]))


def core_width(hist: DataFrame, keys: list[str], value: str, n: str, reach: float = 2.0) -> DataFrame:
    """(keys, w, mu, sd): what a histogram (keys, value, n) of whole differences holds: a normal core of mean mu and
    width sd, far values, and a spike of weight w at zero. Nulls where too few values tell a core.

    The core is the most likely normal law on the whole numbers within `reach` widths of its mean, zero left out, which
    the spike disturbs; the range starts from the quartiles and follows the law until it stays. The spike is
    what zero holds beyond the law. A group is its distinct values, however many voxels were counted.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby(value)[n].sum()
        v, c = g.index.to_numpy(float), g.to_numpy(float)
        other = v != 0
        found: tuple[float, float] | None = None
        if c[other].sum() > 0:
            below = np.cumsum(c[other]) / c[other].sum()
            low, high = (v[other][np.searchsorted(below, q)] for q in (0.25, 0.75))
            found, seen = ((low + high) / 2, max((high - low) / 1.349, 0.75)), set()
        while found:
            first, last = math.ceil(found[0] - reach * found[1]), math.floor(found[0] + reach * found[1])
            if (first, last) in seen:
                break
            seen.add((first, last))
            whole = np.arange(first, last + 1)
            whole = whole[whole != 0].astype(float)
            count = g.reindex(whole, fill_value=0).to_numpy(float)
            found = _discrete_normal(whole, count) if count.sum() else None
        if not found:
            w = mu = sd = None
        else:
            mu, sd = found
            law = np.exp(-0.5 * ((whole - mu) / sd) ** 2)
            expected = count.sum() * math.exp(-0.5 * (mu / sd) ** 2) / law.sum()
            w = float(max(0.0, c[~other].sum() - expected) / c.sum())
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), w, mu, sd]], columns=[*keys, "w", "mu", "sd"])

    kinds = {f.name: f.dataType.simpleString() for f in hist.schema}
    return hist.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", w double, mu double, sd double")


def paired(rows: DataFrame, keys: list[str], arm: str, first: object, second: object, value: str) -> DataFrame:
    """(keys, before, after, delta): means of two arms on the keys that both have."""
    def one(v: object, name: str) -> DataFrame:
        return rows.where(F.col(arm) == v).groupBy(*keys).agg(F.avg(value).alias(name))

    return one(first, "before").join(one(second, "after"), keys).withColumn("delta", F.col("after") - F.col("before"))


def pick(rows: DataFrame, level: str, conditions: Column) -> DataFrame:
    """The largest level that meets conditions, one row (null if none does)."""
    return rows.where(conditions).agg(F.max(level).alias("picked"))


def column_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(metric, max_abs, mean_abs) of columns on the keys that both have. Pairs of missing values agree; one
    missing value of a pair makes the column infinitely different."""
    sides = [d.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "metric", v) for d, v in ((left, "_a"), (right, "_b"))]
    gone = lambda c: F.col(c).isNull() | F.isnan(c)
    j = sides[0].join(sides[1], [*keys, "metric"]).withColumn("_odd", gone("_a") != gone("_b"))
    d = F.when(~gone("_a") & ~gone("_b"), F.abs(F.col("_a") - F.col("_b")))
    g = j.groupBy("metric").agg(F.max("_odd").alias("odd"), F.coalesce(F.max(d), F.lit(0.0)).alias("most"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean"))
    value = lambda c: F.when(F.col("odd"), float("inf")).otherwise(F.col(c))
    return g.select("metric", value("most").alias("max_abs"), value("mean").alias("mean_abs"))


def discordant_pairs(matrix: DataFrame, item: str, arms: list[str]) -> DataFrame:
    """(first, second, n, only_first, only_second, diff) for each unordered pair of 0/1 columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1 :]]
    one = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    p = matrix.select(F.explode(one).alias("p")).select("p.*")
    g = p.groupBy("first", "second").agg(F.count("*").alias("n"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("only_first"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("only_second"))
    return g.withColumn("diff", (F.col("only_first") - F.col("only_second")) / F.col("n"))


def paired_intervals(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """discordant_pairs with the exact conditional interval of diff (low, high) and the one for all pairs together
    (low_all, high_all: alpha divided by their number). All zero without discordant items."""
    m = pairs.count()  # one row a pair of arms
    disc = pairs.withColumn("disc", F.col("only_first") + F.col("only_second"))
    for a, tag in ((alpha, ""), (alpha / max(m, 1), "_all")):
        disc = clopper_pearson(disc, "only_first", "disc", a)
        back = lambda c: F.when(F.col("disc") == 0, 0.0).otherwise(F.col("disc") * (2 * F.col(c) - 1) / F.col("n"))  # noqa: B023, E731
        disc = disc.withColumn("_l", back("low")).withColumn("_h", back("high")).drop("low", "high").withColumnsRenamed({"_l": f"pair_low{tag}", "_h": f"pair_high{tag}"})
    return disc.drop("disc").withColumn("apart", (F.col("pair_low_all") > 0) | (F.col("pair_high_all") < 0))


def paired_tests(differences: DataFrame, keys: list[str], d: str) -> DataFrame:
    """(n, mean_diff, t, w, z) by group: the paired t statistic; the smaller signed-rank sum of the differences that
    aren't 0, ties at mid-ranks, and its normal deviate."""
    s = differences.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    size = differences.where(F.col(d) != 0).groupBy(*keys, F.abs(d).alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col(d) > 0).alias("up"))
    rank = running(size, keys, ["size"], ["c"], FEW).withColumn("r", F.col("c_before") + (F.col("c") + 1) / 2)
    c = F.col("c").cast("double")
    w = rank.groupBy(*keys).agg(F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * (F.col("c") - F.col("up"))).alias("minus"), F.sum("c").cast("double").alias("m"), F.sum(c * c * c - c).alias("ties"))
    m = F.col("m")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    least = F.least("plus", "minus")
    w = w.select(*keys, least.alias("w"), safe_ratio(least - m * (m + 1) / 4, sd).alias("z"))
    t = safe_ratio(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))
    return s.join(w, keys).select(*keys, "n", "mean_diff", t.alias("t"), "w", "z")


def accuracy_f_beta(rows: DataFrame, p: str, y: str, thresholds: list[float], beta2: float) -> DataFrame:
    """(threshold, accuracy, f_beta) for p >= threshold; f_beta is null without a hit. One aggregate."""
    hit = lambda t, k: F.count_if((F.col(p) >= t) & (F.col(y) == k)).cast("double")
    g = rows.agg(*[hit(t, k).alias(f"h{i}_{k}") for i, t in enumerate(thresholds) for k in (0, 1)], F.count_if(F.col(y) == 1).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{i}_1").alias("tp"), F.col(f"h{i}_0").alias("fp")) for i, t in enumerate(thresholds)])
    x = g.select("pos", "n", F.explode(each).alias("x")).select("pos", "n", "x.*")
    right = F.col("tp") + F.col("n") - F.col("pos") - F.col("fp")
    f = F.when(F.col("tp") > 0, (1 + beta2) * F.col("tp") / ((1 + beta2) * F.col("tp") + beta2 * (F.col("pos") - F.col("tp")) + F.col("fp")))
    return x.select("threshold", (right / F.col("n")).alias("accuracy"), f.alias("f_beta"))


def robust_line(points: DataFrame, keys: list[str], key: str, x: str, y: str, near: float, sampled: int) -> DataFrame:
    """(keys, inliers, slope, intercept): of the lines through two of `sampled` points a group, in a fixed random
    order, the one with most points within `near` of it, fitted again to those by least squares."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit("0"))), key)
    few = points.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sampled)
    lists = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_r").alias("i"), F.col(x).alias("px"), F.col(y).alias("py")))).alias("_s"))
    pair = lists.select(*keys, F.explode("_s").alias("a"), F.col("_s")).select(*keys, "a", F.explode("_s").alias("b")).where("a.i < b.i and a.px <> b.px")
    slope = (F.col("b.py") - F.col("a.py")) / (F.col("b.px") - F.col("a.px"))
    lines = pair.select(*keys, F.col("a.i").alias("i"), F.col("b.i").alias("j"), slope.alias("m"), (F.col("a.py") - slope * F.col("a.px")).alias("q"))
    off = F.abs(F.col(y) - F.col("m") * F.col(x) - F.col("q")) <= near
    votes = points.join(lines, keys).groupBy(*keys, "i", "j", "m", "q").agg(F.count_if(off).alias("n"))
    best = votes.groupBy(*keys).agg(F.min_by(F.struct("m", "q"), F.struct(-F.col("n"), "i", "j")).alias("l")).select(*keys, "l.m", "l.q")
    g = points.join(best, keys).where(off).groupBy(*keys)
    fit = g.agg(F.count("*").alias("inliers"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count_distinct(x).alias("_d"))
    return fit.where("_d > 1").drop("_d")


def quadratic_surface(rows: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """(keys, c0 .. c5): least-squares z = c0 + c1 x + c2 y + c3 x^2 + c4 x y + c5 y^2. Spark adds up the moments;
    only a 6 x 6 system a group is solved in Python."""
    terms = [F.lit(1.0), F.col(x), F.col(y), F.col(x) * F.col(x), F.col(x) * F.col(y), F.col(y) * F.col(y)]
    sums = [F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    g = rows.groupBy(*keys).agg(*sums, *[F.sum(a * F.col(z)).alias(f"r{i}") for i, a in enumerate(terms)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.empty((len(b), 6, 6))
            for i in range(6):
                for j in range(i, 6):
                    m[:, i, j] = m[:, j, i] = b[f"m{i}_{j}"]
            r = b[[f"r{i}" for i in range(6)]].to_numpy()
            c = np.stack([np.linalg.lstsq(a, v, rcond=None)[0] for a, v in zip(m, r)]) if len(b) else np.zeros((0, 6))
            yield b[keys].assign(**{f"c{i}": c[:, i] for i in range(6)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return g.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + "".join(f", c{i} double" for i in range(6)))


def gaussian_mixture(rows: DataFrame, value: str, k: int, seed: int = 0) -> DataFrame:
    """(component, weight, mean, sd) of a fitted mixture, in order of the means."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=[value], outputCol="_x", handleInvalid="skip").transform(rows.select(F.col(value).cast("double").alias(value)))
    model = GaussianMixture(featuresCol="_x", k=k, seed=seed).fit(x)
    parts = sorted((float(g.mean[0]), float(w), float(g.cov.toArray()[0, 0]) ** 0.5) for w, g in zip(model.weights, model.gaussians))
    return rows.sparkSession.createDataFrame([(i, w, m, s) for i, (m, w, s) in enumerate(parts)], "component int, weight double, mean double, sd double")


def least_eigenvalue(n: Column, first: Column, second: Column, steps: int = 60) -> Column:
    """Least eigenvalue of the n x n matrix with ones on the diagonal and `first` and `second` beside it, by bisection: the
    number of negative pivots of the matrix less a shift is the number of eigenvalues below the shift (Sturm),
    and the pivots of so narrow a band come one after the other from the two before."""

    def below(shift: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("d1"), F.lit(1.0).alias("d2"), F.lit(0.0).alias("e1"), F.lit(0.0).alias("f1"), F.lit(0.0).alias("f2"), F.lit(False).alias("found"))

        def pivot(s: Column, i: Column) -> Column:
            # d1, d2: the last two pivots; e1: the last row's next factor; f1, f2: factors two rows on, of the last two rows
            d = (1.0 - shift) - s["e1"] * s["e1"] * s["d1"] - s["f2"] * s["f2"] * s["d2"]
            d = F.when(F.abs(d) < 1e-300, F.lit(-1e-300)).otherwise(d)
            e = (first - s["f1"] * s["e1"] * s["d1"]) / d
            return F.struct(d.alias("d1"), s["d1"].alias("d2"), e.alias("e1"), (second / d).alias("f1"), s["f1"].alias("f2"), (s["found"] | (d < 0)).alias("found"))

        return F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, pivot, lambda s: s["found"])

    reach = 2 * (F.abs(first) + F.abs(second))
    ends = F.struct((1.0 - reach).alias("lo"), F.lit(1.0).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        yes = below(middle)
        return F.struct(F.when(yes, s["lo"]).otherwise(middle).alias("lo"), F.when(yes, middle).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halved, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(n >= 1, found)
