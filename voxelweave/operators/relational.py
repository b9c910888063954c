"""Store semantics: views, filters, scoped deletes, resume checks, validated joins, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.operators.linking import radius_pairs


def review_filter(rows: DataFrame, equals: dict[str, object] | None = None, within: dict[str, Sequence] | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """Rows that pass all conditions; a missing value passes none. ranges: (low, high), None open."""
    test: Column = F.lit(True)
    for c, v in (equals or {}).items():
        test = test & (F.col(c) == v)
    for c, v in (within or {}).items():
        test = test & F.col(c).isin(*v)
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            test = test & (F.col(c) >= lo)
        if hi is not None:
            test = test & (F.col(c) <= hi)
    return rows.where(test)


def scoped_delete(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """What stays of a table when the rows of doomed keys go; the rewrite that a delete is here."""
    return table.join(doomed.select(key).distinct(), key, "left_anti")


def complete_groups(rows: DataFrame, keys: list[str], member: str, expected: DataFrame | None = None) -> DataFrame:
    """Groups whose members are all there, each once: what a resumed run may skip.

    expected: one column of member ids that a group must equal; without it a group need only have no
    repeats. Null keys form groups like any value.
    """
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(member).alias("d"))
    ok = g.where("n = d")
    if expected is not None:
        want = expected.distinct()
        hit = rows.join(want, member, "left_semi").groupBy(*keys).agg(F.countDistinct(member).alias("h"))
        size = want.agg(F.count("*").alias("want"))
        same = F.lit(True)
        for k in keys:
            same = same & ok[k].eqNullSafe(hit[k])
        ok = ok.join(hit, same).select(*[ok[k] for k in keys], "n", "d", "h").crossJoin(F.broadcast(size)).where("h = want and d = want")
    return ok.select(*keys, "n")


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once; rows with a null key are left out."""
    n = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(n, keys, "left_semi")


def isolated(points: DataFrame, key: str, group: list[str], axes: list[str], distance: float) -> DataFrame:
    """Points without another of their group nearer than distance in the plane (or along the line) of axes. Cells of
    that width limit the comparison to neighbouring ones."""
    pairs = radius_pairs(points, key, axes, distance, group).where(F.col("distance") < distance)
    near = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key)))
    return points.join(near.distinct(), key, "left_anti")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counting repeats; side tells which."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A report of one row: rows on either side, matched rows, repeated keys on either side."""
    twice = lambda d, n: d.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias(n))
    counts = [
        left.agg(F.count("*").alias("left_rows")), right.agg(F.count("*").alias("right_rows")),
        left.select(*keys).join(right.select(*keys), keys).agg(F.count("*").alias("matched")), twice(left, "left_repeats"), twice(right, "right_repeats"),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))  # one row each
    return out


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group; order must break all ties."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def seeded_key(key: str, seed: int) -> Column:
    """A random order of keys that a seed fixes, whatever the partitioning."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of seeded_key: the same rows whatever the partitioning."""
    return rows.orderBy(seeded_key(key, seed), key).limit(n)


def grid(spark, **axes: Sequence) -> DataFrame:
    """Every combination of the axes' values."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name]).coalesce(1)  # else partitions multiply with the axes
        out = one if out is None else out.crossJoin(one)
    return out
