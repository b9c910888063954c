"""Windows along an axis: clamped medians, projections, gaps and islands, interpolation, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from voxelweave.functions.storage import checked_broadcast, cut, is_small

#: Counted rows that one window may sum in order, where a caller says that its rows are counted.
FEW = 100_000
#: Rows of a series that one task may hold; if any has more, all are worked in blocks of BLOCK rows.
SERIES, BLOCK = 500_000, 1 << 16


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _summed(rows: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """What running() gives, by one window a group."""
    early = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(early), F.lit(0)).alias(f"{c}_before") for c in sums]
    return rows.select("*", *before, *[F.sum(c).over(Window.partitionBy(*keys)).alias(f"{c}_all") for c in sums])


def running(rows: DataFrame, keys: list[str], order: list[str], sums: list[str], few: int = 0) -> DataFrame:
    """rows with, for each column c of sums, c_before (its sum over the rows of the same keys that come earlier
    in order) and c_all (over all rows of the keys).

    Rows are sorted into ranges of keys and order, which are written; totals of the groups that reach over an edge
    between ranges are windowed, and only within a range are rows summed in order. So a group of any size takes many
    tasks, and the totals, at most two for each edge, don't grow with the groups. Where `few` is given, rows are
    written first, and if there are at most so many, plain windows sum them.
    """
    if few:
        rows = cut(rows, "counted")
        if is_small(rows, few):
            return _summed(rows, keys, order, sums)
    parts = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    every = Window.partitionBy(*keys)
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumn("_parts", F.count("*").over(every)).where("_parts > 1")
    early = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        *[F.sum(f"_{c}").over(early).alias(f"_{c}_early") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"_{c}_all") for c in sums],
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    here, whole = local.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = parts.join(F.broadcast(cut(totals, "totals")), same, "left")
    before = [(F.coalesce(f"_{c}_early", F.lit(0)) + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(f"{c}_before") for c in sums]
    return out.select(*rows.columns, *before, *[F.when(F.col("_p").isNull(), F.sum(c).over(whole)).otherwise(F.col(f"_{c}_all")).alias(f"{c}_all") for c in sums])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles by group, named by shares, interpolated between neighbouring ranks; missing values don't
    count. Values are counted first and ranked by running sums, so no group needs to fit in a task."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    r = running(n, keys, [value], ["n"], FEW)
    at = {name: F.lit(q) * (F.col("n_all") - 1) for name, q in shares.items()}
    holds = lambda i: F.when((F.col("n_before") <= i) & (i < F.col("n_before") + F.col("n")), F.col(value))
    ends = [F.max(holds(f(p))).alias(f"_{e}_{name}") for name, p in at.items() for e, f in (("lo", F.floor), ("hi", F.ceil))]
    g = r.groupBy(*keys, "n_all").agg(*ends)
    cols = [(F.col(f"_lo_{name}") + (p - F.floor(p)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name) for name, p in at.items()]
    return g.select(*keys, *cols)


def has_long(rows: DataFrame, keys: list[str], long: int) -> bool:
    """True if a series has more than `long` rows. Keys are counted; one number reaches the driver."""
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > long


def series(rows: DataFrame, keys: list[str], order: list[str], before: int = 0, after: int = 0, long: int = SERIES, size: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """rows with _i, their number in the series from 0, _size, its length, and _own; and the window, in order, in which
    each row with _own finds the `before` rows ahead of it and the `after` rows that follow, as far as the series has any.

    Where every series has at most `long` rows (0: not asked, the caller knows a bound), the window is the series. Else
    it is a block of `size` rows of a series, with copies of the rows around that its own ones reach; copies are
    not _own. Numbers come from sorted ranges with carried counts, so the longest series takes many tasks.
    """
    if not long or not has_long(rows, keys, long):
        w = _window(keys, order)
        return rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_size", F.count("*").over(Window.partitionBy(*keys))).withColumn("_own", F.lit(True)), w
    n = running(rows.withColumn("_one", F.lit(1)), keys, order, ["_one"])
    n = n.select(*rows.columns, F.col("_one_before").cast("int").alias("_i"), F.col("_one_all").alias("_size"))
    block = lambda i: F.floor(i / size)
    reached = F.sequence(F.greatest(block(F.col("_i") - after), F.lit(0)), F.least(block(F.col("_i") + before), block(F.col("_size") - 1)))
    spread = n.withColumn("_block", F.explode(reached)).withColumn("_own", F.col("_block") == block(F.col("_i")))
    return spread, _window([*keys, "_block"], ["_i"])


def clamped_windows(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int, carry: tuple[str, ...] = (), long: int = SERIES, size: int = BLOCK) -> DataFrame:
    """Per row, median and maximum of exactly `width` rows around it, and its carry columns; near an end the
    window shifts inwards instead of shrinking. width is odd; series shorter than it give nothing.

    The value array of a row's neighbourhood comes from one window frame of 2 * width - 1 rows, cut
    to the clamped range: no self-join.
    """
    if width % 2 == 0:
        raise ValueError("the window must be odd")
    n, w = series(rows, keys, order, width - 1, width - 1, long, size)
    around = w.rowsBetween(-(width - 1), width - 1)
    start = F.greatest(F.lit(0), F.least(F.col("_i") - width // 2, F.col("_size") - width))
    first = F.greatest(F.lit(0), F.col("_i") - (width - 1))
    near = n.withColumn("_v", F.collect_list(F.col(value).cast("double")).over(around)).where((F.col("_size") >= width) & F.col("_own"))
    near = near.withColumn("_v", F.slice("_v", start - first + 1, F.lit(width)))
    return near.select(*keys, *order, *carry, F.element_at(F.array_sort("_v"), width // 2 + 1).alias("mid"), F.array_max("_v").alias("most"))


def sliding_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int, long: int = SERIES, size: int = BLOCK) -> DataFrame:
    """Mean of each row and the width - 1 that follow, where so many follow."""
    n, w = series(rows, keys, order, 0, width - 1, long, size)
    mean = n.withColumn("avg_next", F.avg(value).over(w.rowsBetween(0, width - 1)))
    return mean.where(F.col("_own") & (F.col("_i") + width <= F.col("_size"))).select(*rows.columns, "avg_next")


def log_sum_exp(rows: DataFrame, keys: list[str], value: str, beta: float) -> DataFrame:
    """Soft maximum by group: m + ln(sum exp(beta (v - m))) / beta."""
    m = rows.groupBy(*keys).agg(F.max(value).alias("m"))
    return rows.join(m, keys).groupBy(*keys, "m").agg(F.sum(F.exp(beta * (F.col(value) - F.col("m")))).alias("s")).select(*keys, (F.col("m") + F.log("s") / beta).alias("soft_max"))


def contiguity(rows: DataFrame, keys: list[str], order: list[str], value: str, tau: float, kappa: float, beta: float, long: int = SERIES, size: int = BLOCK) -> DataFrame:
    """Soft maximum of the products of neighbouring gated values: gate = sigmoid(kappa (v - tau))."""
    n, w = series(rows, keys, order, 0, 1, long, size)
    gate = n.withColumn("_g", 1 / (1 + F.exp(-kappa * (F.col(value) - tau))))
    pair = gate.withColumn("_p", F.col("_g") * F.lead("_g").over(w)).where("_own and _p is not null")
    return log_sum_exp(pair, keys, "_p", beta)


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str, low: float, high: float, least: int = 1, long: int = SERIES) -> DataFrame:
    """Runs of values >= low that hold at least `least` values >= high: 1-D hysteresis.

    A run is known by the number of lower (or missing) values before it, a running sum; so runs of any length, in
    series of any length, are grouped with sums on the map side.
    """
    flagged = rows.withColumn("_gap", F.when(F.col(value) >= low, 0).otherwise(1)).withColumn("_one", F.lit(1))
    n = (running if has_long(rows, keys, long) else _summed)(flagged, keys, order, ["_gap", "_one"]).where("_gap = 0").withColumn("i", (F.col("_one_before") + 1).cast("int"))
    g = n.groupBy(*keys, "_gap_before").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), F.max(value).alias("peak"), F.sum(F.when(F.col(value) >= high, 1).otherwise(0)).alias("seeds"))
    return g.where(F.col("seeds") >= least).drop("_gap_before")


def _between(at: Column, p: str, q: str) -> Column:
    """The value at `at` on the line from knot p to knot q (structs of x and v); the other one's where one is missing."""
    v = F.when(F.col(p).isNull(), F.col(f"{q}.v")).when(F.col(q).isNull() | (F.col(f"{q}.x") == F.col(f"{p}.x")), F.col(f"{p}.v"))
    return v.otherwise(F.col(f"{p}.v") + F.try_divide(F.col(f"{q}.v") - F.col(f"{p}.v"), F.col(f"{q}.x") - F.col(f"{p}.x")) * (at - F.col(f"{p}.x")))


def interpolated(grid: DataFrame, knots: DataFrame, keys: list[str], at: str, value: str, long: int = SERIES, size: int = BLOCK) -> DataFrame:
    """grid (keys, at) with `value` interpolated linearly between knots, constant beyond the ends.

    Knots and grid points are sorted together, knots first where they meet. The last knot before and the first
    after each point come from two growing windows, one in either direction, so the work is linear. Series of
    more than `long` rows are cut into blocks; those carry their first and last knots to one another.
    """
    k = knots.select(*keys, F.col(at), F.struct(F.col(at).alias("x"), F.col(value).alias("v")).alias("knot"))
    both = grid.select(*keys, at, F.lit(None).cast(k.schema["knot"].dataType).alias("knot"), F.lit(1).alias("asked")).unionByName(k.withColumn("asked", F.lit(0)))
    if not has_long(both, keys, long):
        back = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy(*keys).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, 0)
        s = both.withColumn("p", F.last("knot", True).over(back)).withColumn("q", F.last("knot", True).over(ahead)).where("asked = 1")
        return s.select(*keys, at, _between(F.col(at), "p", "q").alias(value))
    cells, w = series(both, keys, [at, "asked"], long=long, size=size)
    cells = cut(cells, "cells")
    last, first = F.max_by("knot", F.when(F.col("knot").isNotNull(), F.col("_i"))), F.min_by("knot", F.when(F.col("knot").isNotNull(), F.col("_i")))
    ends = cells.groupBy(*keys, "_block").agg(last.alias("_last"), first.alias("_first"))
    early = _window(keys, ["_block"]).rowsBetween(Window.unboundedPreceding, -1)
    late = _window(keys, ["_block"]).rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_block").alias("_b"), F.last("_last", True).over(early).alias("_early"), F.first("_first", True).over(late).alias("_late")
    )
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    j = cells.join(checked_broadcast(cut(ends, "ends")), same)
    j = j.withColumn("p", F.coalesce(F.last("knot", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_early")))
    j = j.withColumn("q", F.coalesce(F.first("knot", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_late")))
    return j.where("asked = 1").select(*keys, at, _between(F.col(at), "p", "q").alias(value))


def gaussian_smooth(rows: DataFrame, keys: list[str], order: list[str], value: str, sigma: float, long: int = SERIES, size: int = BLOCK) -> DataFrame:
    """Gaussian smoothing with the end values repeated beyond the ends, radius 4 sigma."""
    r = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(weights)
    n, w = series(rows, keys, order, r, r, long, size)
    # rows that reach beyond an end see that end in their own window
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = n.withColumn("_a", F.first(value).over(whole)).withColumn("_z", F.last(value).over(whole))
    terms = [F.coalesce(F.lag(value, -k).over(w), F.col("_a") if k < 0 else F.col("_z")) * (x / total) for k, x in zip(range(-r, r + 1), weights)]
    return base.withColumn("smooth", sum(terms[1:], terms[0])).where("_own").select(*rows.columns, "smooth")


def difference_noise(rows: DataFrame, keys: list[str], order: list[str], value: str, long: int = SERIES, size: int = BLOCK) -> DataFrame:
    """Noise of a series from neighbouring differences: sd (by n) / sqrt 2, and lag-1 correlation."""
    n, w = series(rows, keys, order, 0, 1, long, size)
    d = n.withColumn("_n", F.lead(value).over(w)).where("_own and _n is not null")
    return d.groupBy(*keys).agg((F.stddev_pop(F.col("_n") - F.col(value)) / math.sqrt(2)).alias("noise"), F.corr(value, "_n").alias("lag1"), F.count("*").alias("n"))


def strongest_edge(profile: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, at): position of the largest central difference; the first of equal ones."""
    w = _window(keys, [order])
    d = profile.withColumn("d", F.abs(F.lead(value).over(w) - F.lag(value).over(w))).where("d is not null")
    return d.groupBy(*keys).agg(F.max_by(order, F.struct(F.col("d"), -F.col(order))).alias("at"), F.max("d").alias("step"))


def ecdf(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, share): share of rows up to each distinct value."""
    n = running(rows.groupBy(*keys, value).agg(F.count("*").alias("n")), keys, [value], ["n"], FEW)
    return n.select(*keys, value, ((F.col("n_before") + F.col("n")) / F.col("n_all")).alias("share"))
