"""Linking candidates that share voxels: edges, closures, components, label rules, propagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import FALSE_POSITIVE, NEEDS_REVIEW, TRUE_POSITIVES, UNREVIEWED, ground_truth_label
from voxelweave.functions.storage import cut, dropped


def overlap_edges(voxels: DataFrame, key: str, place: list[str]) -> DataFrame:
    """(a, b), a < b: pairs of candidates with a voxel in common. place: volume and coordinates.

    The pairwise form is the contract of this operator; to link, use star_edges.
    """
    v = voxels.select(key, *place).distinct()
    left = v.select(*place, F.col(key).alias("a"))
    right = v.select(*place, F.col(key).alias("b"))
    return left.join(right, place).where("a < b").select("a", "b").distinct()


def star_edges(voxels: DataFrame, key: str, place: list[str]) -> DataFrame:
    """(a, b): the smallest candidate of each voxel with each other one. Same components as
    overlap_edges with k-1 instead of k(k-1)/2 edges for k candidates."""
    v = voxels.select(key, *place).distinct()
    least = v.groupBy(*place).agg(F.min(key).alias("a"), F.max(key).alias("z")).where("a < z").drop("z")
    return v.join(least, place).where(F.col(key) > F.col("a")).select("a", F.col(key).alias("b")).distinct()


#: Star rounds after which the loop gives up (each about halves the depth of what is left).
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges u > v. Rows are grouped for a minimum only, which Spark sums before
    the shuffle, so a hub with very many neighbours is no problem."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        moved = edges.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v")
    out = moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return out if large else out.distinct()  # repeats between the two stars do no harm


#: Edges that one task may settle: a few MB.
FEW_EDGES = 100_000


def _settled(edges: pa.Table) -> pa.Table:
    """Stars of all parts of a few edges: label minima over the edges, then each label's own label."""
    ids, ends = np.unique(np.concatenate([np.asarray(edges["u"]), np.asarray(edges["v"])]), return_inverse=True)
    u, v = ends[: len(edges)], ends[len(edges) :]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        np.minimum.at(new, root[u], new[u])
        np.minimum.at(new, root[v], new[v])
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root < np.arange(len(ids))
    return pa.table({"u": pa.array(ids[far], pa.int64()), "v": pa.array(ids[root[far]], pa.int64())})


def reachable(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """(id, component): smallest id reachable, for every id in an edge; ids in no edge are left out.

    Alternating large-star and small-star rounds over written edge tables. Edges with a null end and
    self-loops link nothing; repeated edges count once. Only two numbers a round reach the driver.
    Once at most `few` edges are left, one task settles them. Rounds that don't settle are an error.
    """
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct(),
        "edges",
    )

    def summary(edges: DataFrame) -> tuple:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return seen["n"], seen["h"]

    state, before = summary(now), None
    for _ in range(MAX_ROUNDS):
        if state[0] == 0 or state == before:
            break
        if state[0] <= few:
            after = cut(now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_settled, "u long, v long"), "edges")
            dropped(now)
            now = after
            break
        after = cut(_star(_star(now, True), False), "edges")
        dropped(now)
        now, before, state = after, state, summary(after)
    else:
        raise RuntimeError("components did not settle")
    hubs = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(hubs)


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): smallest id reachable; nodes without an edge stand alone."""
    labels = reachable(edges, few=FEW_EDGES).withColumnRenamed("id", key)
    return nodes.select(key).distinct().join(labels, key, "left").select(key, F.coalesce("component", key).alias("component"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): everything reachable from seeds, seeds included; breadth first, one join a level."""
    both = cut(edges.select(F.col("a").alias("id"), "b").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("b"))).distinct(), "both")
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("id")).distinct(), "seen")
    edge = seen
    while True:
        edge = cut(edge.join(both, "id").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"), "edge")
        if edge.isEmpty():
            return seen
        seen = cut(seen.unionByName(edge), "seen")


def component_labels(members: DataFrame, label: str) -> DataFrame:
    """(component, labels, ground_truth): sorted distinct labels of a component and their rule."""
    g = members.groupBy("component").agg(F.sort_array(F.collect_set(label)).alias("labels"))
    return g.withColumn("ground_truth", ground_truth_label(F.col("labels")))


def contradictions(members: DataFrame, label: str) -> DataFrame:
    """Rows of components that hold both a 0 and a true-positive label."""
    bad = members.groupBy("component").agg(
        F.max(F.when(F.col(label) == FALSE_POSITIVE, 1)).alias("fp"), F.max(F.when(F.col(label).isin(*TRUE_POSITIVES), 1)).alias("tp")
    ).where("fp = 1 and tp = 1")
    return members.join(bad.select("component"), "component", "left_semi")


def mixed_history(members: DataFrame, label: str) -> DataFrame:
    """(component, labels): components with a true-positive label and any other."""
    other = ~F.col(label).isin(*TRUE_POSITIVES)
    g = members.groupBy("component").agg(
        F.sum(F.when(F.col(label).isin(*TRUE_POSITIVES), 1).otherwise(0)).alias("tp"), F.sum(F.when(other, 1).otherwise(0)).alias("rest"),
        F.sort_array(F.collect_set(label)).alias("labels"),
    )
    return g.where("tp > 0 and rest > 0").select("component", F.array_join(F.col("labels").cast("array<string>"), ";").alias("labels"))


def sample_weights(rows: DataFrame, component: str) -> DataFrame:
    """rows with weight = 1 / rows of the component: every object weighs 1 in all."""
    n = rows.groupBy(component).agg(F.count("*").alias("_n"))
    return rows.join(n, component).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def arg_max(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """(group, best, best_key): largest value and the smallest key that has it; nulls don't compete."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group)
    return g.agg(F.max(value).alias("best"), F.max_by(key, F.struct(F.col(value), -F.col(key))).alias("best_key"))


def latest_label(events: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Latest label of each key: an append-only label log read as a table."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col(label).alias("label"))


def propagate(members: DataFrame, key: str, label: str, decisions: DataFrame, force: bool = False) -> DataFrame:
    """(key, old, new) of candidates whose label changes when decisions (key, new) spread over their
    components. Only labels 0 to 3 spread; they overwrite unreviewed and needs-review labels, or any
    if force. Of several decisions in a component, that of the smallest key counts."""
    d = members.join(decisions.withColumnRenamed("new", "_new"), key).where(F.col("_new").between(0, 3))
    per = d.groupBy("component").agg(F.min_by("_new", key).alias("new"))
    old = F.coalesce(F.col(label), F.lit(-1))
    free = F.lit(True) if force else old.isin(*UNREVIEWED, NEEDS_REVIEW)
    return members.join(per, "component").where(free & (old != F.col("new"))).select(key, old.alias("old"), "new")


def radius_pairs(points: DataFrame, key: str, axes: list[str], radius: float, group: list[str]) -> DataFrame:
    """(a, b), a < b: points of a group within radius. A grid of cells of that width limits the
    comparison to a point's own cell and the neighbouring ones."""
    cell = [F.floor(F.col(c) / radius).cast("long") for c in axes]
    near = points.select(*group, F.col(key).alias("a"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(axes)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    for i in range(len(axes)):
        near = near.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + k for k in (-1, 0, 1)])))
    home = points.select(*group, F.col(key).alias("b"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(axes)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    d2 = sum(((F.col(f"p{i}") - F.col(f"q{i}")) * (F.col(f"p{i}") - F.col(f"q{i}")) for i in range(1, len(axes))), (F.col("p0") - F.col("q0")) * (F.col("p0") - F.col("q0")))
    return near.join(home, [*group, *[f"c{i}" for i in range(len(axes))]]).where((F.col("a") < F.col("b")) & (d2 <= radius * radius)).select("a", "b", F.sqrt(d2).alias("distance"))


def tracked(points: DataFrame, key: str, axes: list[str], radius: float, group: list[str]) -> DataFrame:
    """points with track: the smallest key of those of the group that steps of at most radius reach."""
    c = components(points, radius_pairs(points, key, axes, radius, group), key)
    return points.join(c.withColumnRenamed("component", "track"), key)


def track_summary(rows: DataFrame, level: str, seeds: str, regions: str, key: str) -> DataFrame:
    """(track, present, seed_mean, seed_range, seed_cv, any_merge) over the levels of a sweep; at each level the
    candidate with most seeds counts, the smallest key of equals."""
    best = rows.groupBy("track", level).agg(F.max(F.struct(F.col(seeds).alias("n"), (-F.col(key)).alias("k"), F.col(regions).alias("m"))).alias("b"))
    n, m = F.col("b.n"), F.col("b.m")
    cv = F.when(F.avg(n) > 0, F.stddev_pop(n) / F.avg(n)).otherwise(0.0)
    return best.groupBy("track").agg(
        F.count("*").alias("present"), F.avg(n).alias("seed_mean"), (F.max(n) - F.min(n)).alias("seed_range"), cv.alias("seed_cv"), F.max((m > 1).cast("int")).alias("any_merge")
    )
