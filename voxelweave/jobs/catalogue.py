"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import axial_ok, first_quadrant, rescale, safe_ratio
from voxelweave.jobs import learning
from voxelweave.jobs.registry import QUERIES, SQL, Query, query, r6
from voxelweave.operators import linking, relational, simulation, stats, volume, windows
from voxelweave.sources import store
from voxelweave.streaming import recorder
from voxelweave.sources.tables import EDGE, SLICES, candidates, cube, hits, label_of, profile, scores, table


def queries() -> dict[str, Query]:
    from voxelweave.jobs import experiments, reports, scans, stages, stores, volumes  # noqa: F401  they register theirs

    return dict(QUERIES) | learning.queries()


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


LABEL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 4 END"
HITS = """SELECT DISTINCT l_orderkey candidate_id, o_orderpriority volume, l_partkey y, l_suppkey x
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""
EDGES = f"""hits AS ({HITS}), edges AS (SELECT DISTINCT p.candidate_id a, q.candidate_id b FROM hits p JOIN hits q
          USING (volume, y, x) WHERE p.candidate_id < q.candidate_id)"""
MEMBERS = f"""{EDGES}, both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
          walk(id, seen) AS (SELECT a, a FROM both_ UNION SELECT a, b FROM both_ UNION SELECT walk.id, both_.b FROM walk JOIN both_ ON both_.a = walk.seen),
          root AS (SELECT id, min(seen) component FROM walk GROUP BY id),
          members AS (SELECT o_orderkey candidate_id, o_orderpriority volume, {LABEL} label, coalesce(component, o_orderkey) component
                      FROM orders LEFT JOIN root ON id = o_orderkey)"""
SCORES = "SELECT l_orderkey candidate_id, round(l_discount * 10, 6) p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y, l_quantity w, l_linestatus slab FROM lineitem"


def _members(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return c.join(linking.components(c, linking.star_edges(hits(spark, d), "candidate_id", ["volume", "y", "x"]), "candidate_id"), "candidate_id")


# Views, filters, joins


@query("""SELECT o_orderkey candidate_id, c_mktsegment experiment, n_name site, o_orderpriority volume,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 4 END label,
       coalesce(n_voxels, -1) n_voxels, round(coalesce(mass, -1), 6) mass
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN (SELECT l_orderkey, count(*) n_voxels, sum(l_quantity) mass FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def flat_view(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_voxels"), F.sum("l_quantity").alias("mass"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(per, o.o_orderkey == per.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").alias("candidate_id"), F.col("c_mktsegment").alias("experiment"), F.col("n_name").alias("site"), F.col("o_orderpriority").alias("volume"),
        label_of().alias("label"), F.coalesce("n_voxels", F.lit(-1)).alias("n_voxels"), r6(F.coalesce("mass", F.lit(-1.0))).alias("mass"),
    )


@query(f"""SELECT candidate_id, round(p, 6) p, w FROM ({SCORES}) WHERE slab = 'F' AND w >= 10 AND w <= 40 AND p >= 0.5 AND y IN (1)""")
def review_filter(spark, d):
    s = relational.review_filter(scores(spark, d), equals={"slab": "F"}, within={"y": [1]}, ranges={"w": (10, 40), "p": (0.5, None)})
    return s.select("candidate_id", r6("p").alias("p"), "w")


@query("""SELECT n_name site, count(DISTINCT o_orderkey) n_candidates, count(l_orderkey) n_voxels FROM nation
       JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
       WHERE n_regionkey = 2 GROUP BY 1""")
def scoped_counts(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 2")
    o = n.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    j = o.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy(F.col("n_name").alias("site")).agg(F.count("o_orderkey").alias("n_candidates"), F.sum(F.coalesce("k", F.lit(0))).alias("n_voxels"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def scoped_delete(spark, d):
    doomed = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.scoped_delete(table(spark, d, "lineitem"), doomed, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey candidate_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_missing(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id")).join(lines, "candidate_id", "left_anti")


@query("""SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) n, count(DISTINCT l_partkey) k FROM lineitem GROUP BY 1, 2) WHERE n = k""")
def resume_complete_groups(spark, d):
    return relational.complete_groups(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT l_orderkey, l_linenumber FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1) USING (l_orderkey, l_linenumber)""")
def duplicated_keys(spark, d):
    return relational.duplicated(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT o_orderkey k, o_custkey g, o_totalprice p, epoch(o_orderdate) / 864.0 t FROM orders) SELECT k candidate_id FROM o WHERE NOT EXISTS
       (SELECT 1 FROM o q WHERE q.g = o.g AND q.k <> o.k AND (q.p - o.p) * (q.p - o.p) + (q.t - o.t) * (q.t - o.t) < 25000000)""")
def isolation_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), "o_custkey", "o_totalprice", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 864e6).alias("t"))
    return relational.isolated(o, "candidate_id", ["o_custkey"], ["o_totalprice", "t"], 5000).select("candidate_id")


@query("""(SELECT o_custkey id, 'left' side FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, 'left' FROM orders WHERE o_orderstatus = 'O')
       UNION ALL (SELECT o_custkey, 'right' FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey, 'right' FROM orders WHERE o_orderstatus = 'F')""")
def drift_except_all(spark, d):
    o = table(spark, d, "orders")
    one = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return relational.difference(one("F"), one("O"))


@query("""SELECT (SELECT count(*) FROM lineitem) left_rows, (SELECT count(*) FROM orders) right_rows,
       (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) matched,
       (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) left_repeats,
       (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) right_repeats""")
def lossless_join_check(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return relational.one_to_one(lines, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("""SELECT o_custkey id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def set_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")))


@query("""SELECT o_custkey candidate_id, label FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 4 END label,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) WHERE r = 1""")
def label_latest_wins(spark, d):
    o = table(spark, d, "orders").withColumn("code", label_of()).withColumnRenamed("o_custkey", "candidate_id")
    return linking.latest_label(o, "candidate_id", ["o_orderdate", "o_orderkey"], "code")


@query("""SELECT l_returnflag, l_linestatus, t.theta::DOUBLE theta, count(*) n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)
       CROSS JOIN (VALUES (0.5), (5.0), (15.0)) t(theta) GROUP BY ALL""")
def condition_grid(spark, d):
    seeds = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
    return seeds.crossJoin(F.broadcast(relational.grid(spark, theta=[0.5, 5.0, 15.0]))).groupBy("l_returnflag", "l_linestatus", "theta").agg(F.count("*").alias("n"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, r "rank" FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_shipdate) r FROM lineitem) WHERE r <= 3""")
def topk_per_group(spark, d):
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")]]
    return relational.top_k(table(spark, d, "lineitem"), ["l_partkey"], order, 3).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INT) k, count(*) n, round(avg(value), 6) mean FROM events GROUP BY 1""")
def json_props(spark, d):
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("""SELECT o_orderkey candidate_id, round(CASE WHEN c_acctbal <> 0 THEN o_totalprice / c_acctbal END, 6) ratio FROM orders JOIN customer ON o_custkey = c_custkey""")
def safe_ratios(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("candidate_id"), r6(safe_ratio(F.col("o_totalprice"), F.col("c_acctbal"))).alias("ratio"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 2 THEN false WHEN l_quantity < 5 THEN l_linenumber <= 4
       ELSE l_linenumber <= least(l_partkey % 7, l_suppkey % 5) * 1.5 + 1 AND l_discount >= 0.03 END passes FROM lineitem""")
def shape_gate(spark, d):
    gate = axial_ok(F.col("l_linenumber"), F.col("l_partkey") % 7, F.col("l_suppkey") % 5, F.col("l_quantity"), F.col("l_discount"), 2, 4, 5, 1.5, 1, 0.03)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gate.alias("passes"))


@query("""SELECT event_id, CAST(round_even(1 + (greatest(least(value, 80), 5) - 5) / 75.0 * 254, 0) AS INT) gray,
       round(least(t, 180 - t), 6) angle FROM (SELECT event_id, value, ((value * 7) % 180 + 180) % 180 t FROM events)""")
def intensity_and_angle(spark, d):
    return table(spark, d, "events").select("event_id", rescale(F.col("value"), 5, 80, 255).alias("gray"), r6(first_quadrant(F.col("value") * 7)).alias("angle"))


# Linking


@query(f"WITH {EDGES} SELECT a, b FROM edges")
def overlap_edges(spark, d):
    return linking.overlap_edges(hits(spark, d), "candidate_id", ["volume", "y", "x"])


@query(f"""WITH hits AS ({HITS}) SELECT DISTINCT a, candidate_id b FROM hits JOIN (SELECT volume, y, x, min(candidate_id) a FROM hits GROUP BY ALL)
       USING (volume, y, x) WHERE candidate_id > a""")
def star_edges(spark, d):
    return linking.star_edges(hits(spark, d), "candidate_id", ["volume", "y", "x"])


@query(f"WITH RECURSIVE {MEMBERS} SELECT candidate_id, component FROM members")
def components(spark, d):
    return _members(spark, d).select("candidate_id", "component")


@query(f"""WITH RECURSIVE {MEMBERS}, lab AS (SELECT component, max(CASE WHEN label IN (1, 2, 3) THEN 1 ELSE 0 END) tp, max(CASE WHEN label = 0 THEN 1 ELSE 0 END) fp,
       count(*) n FROM members GROUP BY 1)
       SELECT candidate_id, volume, component, CASE WHEN tp = 1 AND fp = 0 THEN 1 WHEN fp = 1 AND tp = 0 THEN 0 ELSE -1 END ground_truth, round(1.0 / n, 6) weight
       FROM members JOIN lab USING (component)""")
def components_labelled(spark, d):
    m = _members(spark, d)
    g = linking.component_labels(m, "label").select("component", F.coalesce("ground_truth", F.lit(-1)).alias("ground_truth"))
    return linking.sample_weights(m, "component").join(g, "component").select("candidate_id", "volume", "component", "ground_truth", r6("weight").alias("weight"))


@query(f"""WITH RECURSIVE {EDGES}, both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
       walk(id) AS (SELECT min(a) FROM edges UNION SELECT both_.b FROM walk JOIN both_ ON both_.a = walk.id) SELECT id FROM walk""")
def bfs_seed(spark, d):
    h = hits(spark, d)
    e = linking.star_edges(h, "candidate_id", ["volume", "y", "x"])
    return linking.closure(e, e.agg(F.min("a").alias("id")))


@query(f"""WITH RECURSIVE {MEMBERS} SELECT component, candidate_id, label FROM members WHERE component IN (SELECT component FROM members GROUP BY 1
       HAVING max(CASE WHEN label = 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN label IN (1, 2, 3) THEN 1 ELSE 0 END) = 1)""")
def contradictions(spark, d):
    return linking.contradictions(_members(spark, d), "label").select("component", "candidate_id", "label")


@query(f"""SELECT o_custkey component, string_agg(DISTINCT label::VARCHAR, ';' ORDER BY label::VARCHAR) labels FROM (SELECT o_custkey, {LABEL} label FROM orders) GROUP BY 1
       HAVING sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) > 0""")
def mixed_history(spark, d):
    return linking.mixed_history(candidates(spark, d).withColumnRenamed("experiment", "component"), "label")


@query(f"""WITH RECURSIVE {MEMBERS}, dec AS (SELECT component, arg_min(candidate_id % 5, candidate_id) new FROM members
       WHERE candidate_id % 7 = 0 AND candidate_id % 5 BETWEEN 0 AND 3 GROUP BY 1)
       SELECT candidate_id, coalesce(label, -1) AS old, new FROM members JOIN dec USING (component) WHERE coalesce(label, -1) IN (-1, 10, 4) AND coalesce(label, -1) <> new""")
def propagation(spark, d):
    m = _members(spark, d)
    decisions = m.where("candidate_id % 7 = 0").select("candidate_id", (F.col("candidate_id") % 5).alias("new"))
    return linking.propagate(m, "candidate_id", "label", decisions)


@query(f"""WITH s AS ({SCORES}) SELECT candidate_id, max(p) best, min(id) best_key FROM (SELECT l_orderkey candidate_id, l_discount p, l_partkey id,
       max(l_discount) OVER (PARTITION BY l_orderkey) m FROM lineitem) WHERE p = m GROUP BY 1""")
def arg_max_group(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_discount").alias("p"), F.col("l_partkey").alias("id"))
    return linking.arg_max(t, "candidate_id", "p", "id")


@query(f"""WITH s AS ({SCORES}) SELECT candidate_id, round(max(p), 6) best FROM s WHERE candidate_id NOT IN
       (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY 1""")
def triage_queue(spark, d):
    reviewed = candidates(spark, d).where("label in (0, 1)").select("candidate_id")
    return scores(spark, d).join(reviewed, "candidate_id", "left_anti").groupBy("candidate_id").agg(r6(F.max("p")).alias("best"))


POINTS = "SELECT vec_id, label, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings"


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"""WITH p AS ({POINTS}) SELECT a.vec_id a, b.vec_id b, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) distance
       FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.0025""")
def radius_pairs(spark, d):
    return linking.radius_pairs(_points(spark, d), "vec_id", ["x", "y", "z"], 0.05, ["label"]).select("a", "b", r6("distance").alias("distance"))


@query(f"""WITH RECURSIVE p AS ({POINTS}), e AS (SELECT a.vec_id a, b.vec_id b FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id
       WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.0025),
       walk(id, seen) AS (SELECT vec_id, vec_id FROM p UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.seen),
       c AS (SELECT id, min(seen) track FROM walk GROUP BY 1)
       SELECT track, count(*) n, min(label) label, round(avg(x), 6) cx, round(max(x) - min(x), 6) spread FROM c JOIN p ON vec_id = id GROUP BY 1""")
def radius_tracks(spark, d):
    p = _points(spark, d)
    c = linking.components(p, linking.radius_pairs(p, "vec_id", ["x", "y", "z"], 0.05, ["label"]), "vec_id")
    g = p.join(c, "vec_id").groupBy(F.col("component").alias("track"))
    return g.agg(F.count("*").alias("n"), F.min("label").alias("label"), r6(F.avg("x")).alias("cx"), r6(F.max("x") - F.min("x")).alias("spread"))


TRACKED = f"""p AS (SELECT vec_id, label % 2 volume, label // 2 AS level, vec_id % 13 n_seed, vec_id % 3 regions, x, y, z FROM ({POINTS})), e AS (SELECT a.vec_id a, b.vec_id b FROM p a JOIN p b ON a.volume = b.volume AND a.vec_id <> b.vec_id
          WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.0049), walk(id, seen) AS (SELECT vec_id, vec_id FROM p UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.seen), c AS (SELECT id, min(seen) track FROM walk GROUP BY 1)"""


def _tracked(spark, d):
    p = _points(spark, d).select(
        "vec_id", (F.col("label") % 2).alias("volume"), F.expr("label div 2").cast("int").alias("level"), (F.col("vec_id") % 13).alias("n_seed"), (F.col("vec_id") % 3).alias("regions"), "x", "y", "z"
    )
    return linking.tracked(p, "vec_id", ["x", "y", "z"], 0.07, ["volume"])


@query(f"""WITH RECURSIVE {TRACKED}, best AS (SELECT track, level, max(n_seed) n, arg_max(regions, (n_seed, -vec_id)) regions FROM c JOIN p ON vec_id = id GROUP BY 1, 2)
       SELECT track, count(*) present, round(avg(n), 6) seed_mean, max(n) - min(n) seed_range, round(CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0 END, 6) seed_cv, max(CASE WHEN regions > 1 THEN 1 ELSE 0 END) any_merge FROM best GROUP BY 1""")
def object_tracks(spark, d):
    """Objects followed over the levels of a sweep: the strongest of an object's candidates at each level."""
    return linking.track_summary(_tracked(spark, d), "level", "n_seed", "regions", "vec_id").select("track", "present", r6("seed_mean").alias("seed_mean"), "seed_range", r6("seed_cv").alias("seed_cv"), "any_merge")


@query(f"""WITH RECURSIVE {TRACKED} SELECT track, max(CASE WHEN level = 0 THEN 1 ELSE 0 END) level_0, max(CASE WHEN level = 1 THEN 1 ELSE 0 END) level_1, max(CASE WHEN level = 2 THEN 1 ELSE 0 END) level_2, max(CASE WHEN level = 3 THEN 1 ELSE 0 END) level_3,
       max(CASE WHEN level = 4 THEN 1 ELSE 0 END) level_4, max(n_seed) size, round(avg(x), 6) radial FROM c JOIN p ON vec_id = id GROUP BY 1""")
def object_windows(spark, d):
    """Objects by windows: 1 where a window found the object; its largest size and mean place."""
    t = _tracked(spark, d)
    return t.groupBy("track").agg(*[F.max((F.col("level") == k).cast("int")).alias(f"level_{k}") for k in range(5)], F.max("n_seed").alias("size"), r6(F.avg("x")).alias("radial"))


@query(f"""WITH RECURSIVE {MEMBERS} SELECT component, max(CASE WHEN label = 0 THEN 1 ELSE 0 END) found_0, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) found_1,
       max(CASE WHEN label = 4 THEN 1 ELSE 0 END) found_4 FROM members GROUP BY 1""")
def detection_matrix(spark, d):
    m = _members(spark, d)
    return m.groupBy("component").agg(*[F.max(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"found_{k}") for k in (0, 1, 4)])


# Statistics


@query("""WITH long AS (UNPIVOT (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
       ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value),
       per AS (SELECT l_returnflag, l_linestatus, l_linenumber, metric, avg(value) value FROM long GROUP BY ALL),
       s AS (SELECT l_returnflag, l_linestatus, metric, avg(value) mean, stddev_samp(value) sd, count(value) n FROM per GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, metric, round(mean, 6) mean, round(sd, 6) sd, n, round(sd / sqrt(n), 6) sem, round(1.96 * sd / sqrt(n), 6) ci95 FROM s""")
def two_level_ci(spark, d):
    t = stats.two_level_ci(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return t.select("l_returnflag", "l_linestatus", "metric", *[r6(c).alias(c) for c in ("mean", "sd")], "n", *[r6(c).alias(c) for c in ("sem", "ci95")])


@query(f"""SELECT CASE WHEN p <= 0.1 THEN 1 ELSE CAST(ceil(round(p * 10, 9)) AS INT) END bin, round(sum(p * w) / sum(w), 6) mean_p,
       round(sum(y * w) / sum(w), 6) mean_y, sum(w) weight FROM ({SCORES}) GROUP BY 1""")
def calibration_bins(spark, d):
    return stats.calibration(scores(spark, d), "p", "y", "w").select("bin", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"), "weight")


def _threshold_sql(values: str) -> str:
    return f"""WITH g AS (SELECT t.threshold, sum(CASE WHEN p >= t.threshold AND y = 1 THEN w ELSE 0 END) tp, sum(CASE WHEN p >= t.threshold AND y = 0 THEN w ELSE 0 END) fp,
       sum(CASE WHEN y = 1 THEN w ELSE 0 END) al FROM ({SCORES}) CROSS JOIN (SELECT unnest([{values}])::DOUBLE threshold) t GROUP BY 1),
       m AS (SELECT threshold, tp / nullif(tp + fp, 0) prec, tp / nullif(al, 0) recall FROM g)
       SELECT threshold, round(prec, 6) prec, round(recall, 6) recall, round(2 * prec * recall / nullif(prec + recall, 0), 6) f1 FROM m"""


SWEEP = [round(0.02 * k, 2) for k in range(1, 50)]


@query(_threshold_sql("0.3, 0.5, 0.7"))
def threshold_pr(spark, d):
    t = stats.threshold_metrics(scores(spark, d), "p", "y", "w", [0.3, 0.5, 0.7])
    return t.select("threshold", *[r6(c).alias(c) for c in ("prec", "recall", "f1")])


@query(_threshold_sql(", ".join(map(str, SWEEP))))
def threshold_sweep(spark, d):
    t = stats.threshold_metrics(scores(spark, d), "p", "y", "w", SWEEP)
    return t.select("threshold", *[r6(c).alias(c) for c in ("prec", "recall", "f1")])


@query(f"""WITH r AS (SELECT slab, y, rank() OVER (PARTITION BY slab ORDER BY p) + (count(*) OVER (PARTITION BY slab, p) - 1) / 2.0 r FROM ({SCORES})),
       g AS (SELECT slab, sum(CASE WHEN y = 1 THEN r ELSE 0 END) r, sum(y)::DOUBLE n1, (count(*) - sum(y))::DOUBLE n0 FROM r GROUP BY 1)
       SELECT slab, round(CASE WHEN n1 * n0 <> 0 THEN (r - n1 * (n1 + 1) / 2) / (n1 * n0) END, 6) auc FROM g""")
def auc_midrank(spark, d):
    return stats.auc(scores(spark, d), "p", "y", ["slab"]).select("slab", r6("auc").alias("auc"))


@query(f"""WITH t AS (SELECT slab, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) tp, sum(w) al FROM ({SCORES}) GROUP BY ALL),
       s AS (SELECT slab, tp, sum(tp) OVER o / sum(al) OVER o prec FROM t WINDOW o AS (PARTITION BY slab ORDER BY p DESC))
       SELECT slab, round(sum(tp * prec) / nullif(sum(tp), 0), 6) ap FROM s GROUP BY 1""")
def weighted_ap(spark, d):
    return stats.average_precision(scores(spark, d), "p", "y", "w", ["slab"]).select("slab", r6("ap").alias("ap"))


@query(f"SELECT slab, round(sum(w * (p - y) * (p - y)) / sum(w), 6) brier FROM ({SCORES}) GROUP BY 1")
def brier(spark, d):
    return stats.brier(scores(spark, d), "p", "y", "w", ["slab"]).select("slab", r6("brier").alias("brier"))


@query("""SELECT o_orderpriority, count(o_totalprice) n, round(avg(o_totalprice), 4) mean, round(stddev_samp(o_totalprice), 4) sd, min(o_totalprice) least,
       round(quantile_cont(o_totalprice, 0.25), 4) q25, round(quantile_cont(o_totalprice, 0.5), 4) q50, round(quantile_cont(o_totalprice, 0.75), 4) q75,
       max(o_totalprice) most FROM orders GROUP BY 1""")
def describe_by_group(spark, d):
    t = stats.describe(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return t.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd")], "least", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "most")


@query("""SELECT l_partkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "before", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "after",
       round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A'), 6) delta FROM lineitem GROUP BY 1
       HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0""")
def paired_delta(spark, d):
    t = stats.paired(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "A", "R", "l_quantity")
    return t.select("l_partkey", *[r6(c).alias(c) for c in ("before", "after", "delta")])


@query("""WITH h AS (SELECT least(floor((l_extendedprice - 0) / 2500.0), 39)::INT bin, count(*) n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1)
       SELECT r.range::INT bin, coalesce(n, 0) n FROM range(40) r LEFT JOIN h ON h.bin = r.range""")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", 0.0, 100000.0, 40)


@query("""WITH a AS (SELECT *, median(value) OVER (PARTITION BY event_type) m1 FROM events),
       b AS (SELECT *, median(abs(value - m1)) OVER (PARTITION BY event_type) d1 FROM a), c AS (SELECT * FROM b WHERE abs(value - m1) <= 3.5 * d1),
       e AS (SELECT *, median(value) OVER (PARTITION BY event_type) m2 FROM c)
       SELECT event_type, round(1.4826 * median(abs(value - m2)), 6) noise FROM e GROUP BY 1""")
def robust_noise(spark, d):
    return stats.robust_noise(table(spark, d, "events"), ["event_type"], "value").select("event_type", r6("noise").alias("noise"))


@query("""WITH s AS (SELECT l_returnflag, var_pop(l_quantity) + 1.0::DOUBLE / 12 aa, var_pop(l_discount * 100) + 1.0::DOUBLE / 12 bb,
       covar_pop(l_quantity, l_discount * 100) ab, count(*) n FROM lineitem GROUP BY 1), t AS (SELECT *, (aa + bb) / 2 mid, sqrt(power((aa - bb) / 2, 2) + ab * ab) f FROM s)
       SELECT l_returnflag, n, round(mid + f, 5) l1, round(mid - f, 5) l2, round(2 * f / (mid + f), 5) elongation FROM t""")
def pca_moments(spark, d):
    t = stats.moments(table(spark, d, "lineitem").withColumn("cents", F.col("l_discount") * 100), ["l_returnflag"], ("l_quantity", "cents"))
    return t.select("l_returnflag", "n", *[F.round(c, 5).alias(c) for c in ("l1", "l2", "elongation")])


@query("""SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) r, round(regr_slope(l_extendedprice, l_quantity), 4) slope,
       round(regr_intercept(l_extendedprice, l_quantity), 3) intercept FROM lineitem GROUP BY 1""")
def linear_fit(spark, d):
    t = stats.linear_fit(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice")
    return t.select("l_linestatus", r6("r").alias("r"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y FROM embeddings), d AS (SELECT *, x - avg(x) OVER w u, y - avg(y) OVER w v, avg(x) OVER w mx, avg(y) OVER w my
       FROM p WINDOW w AS (PARTITION BY label)), s AS (SELECT label, max(mx) mx, max(my) my, count(*) n, sum(u*u) uu, sum(v*v) vv, sum(u*v) uv, sum(u*(u*u+v*v)) ru, sum(v*(u*u+v*v)) rv FROM d GROUP BY 1),
       c AS (SELECT *, (ru*vv - rv*uv) / (2 * (uu*vv - uv*uv)) a, (rv*uu - ru*uv) / (2 * (uu*vv - uv*uv)) b FROM s)
       SELECT label, round(mx + a, 6) cx, round(my + b, 6) cy, round(sqrt(a*a + b*b + (uu+vv)/n), 6) radius FROM c""")
def circle_fit(spark, d):
    return stats.circle_fit(_points(spark, d), ["label"], "x", "y").select("label", *[r6(c).alias(c) for c in ("cx", "cy", "radius")])


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) / count(CASE WHEN l_linestatus = 'F' THEN 1 END), 6) AS "F",
       round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / count(CASE WHEN l_linestatus = 'O' THEN 1 END), 6) AS "O" FROM lineitem GROUP BY 1""")
def conditional_pivot(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return p.select("l_returnflag", r6("F").alias("F"), r6("O").alias("O"))


@query("""SELECT metric, round(avg(value), 6) mean FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY 1""")
def unpivot_mean(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return t.unpivot([], t.columns, "metric", "value").groupBy("metric").agg(r6(F.avg("value")).alias("mean"))


@query(f"""WITH g AS (SELECT l_linenumber lev, avg(l_discount * 10) rate, count(*) n, stddev_samp(l_quantity) spread FROM lineitem GROUP BY 1),
       grid AS (SELECT unnest([0.45, 0.495, 0.505, 0.55])::DOUBLE tol), cap AS (SELECT unnest([14.3, 14.5, 15.0])::DOUBLE ceiling)
       SELECT tol, ceiling, max(CASE WHEN rate <= tol AND spread <= ceiling THEN lev ELSE -1 END) picked FROM g CROSS JOIN grid CROSS JOIN cap GROUP BY 1, 2""")
def sensitivity_grid(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("lev")).agg(F.avg(F.col("l_discount") * 10).alias("rate"), F.stddev_samp("l_quantity").alias("spread"))
    every = relational.grid(spark, tol=[0.45, 0.495, 0.505, 0.55], ceiling=[14.3, 14.5, 15.0])
    ok = F.when((F.col("rate") <= F.col("tol")) & (F.col("spread") <= F.col("ceiling")), F.col("lev")).otherwise(-1)
    return g.crossJoin(F.broadcast(every)).groupBy("tol", "ceiling").agg(F.max(ok).alias("picked"))


@query("""SELECT max(lev) picked FROM (SELECT l_linenumber lev, avg(l_quantity) m FROM lineitem GROUP BY 1) WHERE m <= 26""")
def config_pick(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("lev")).agg(F.avg("l_quantity").alias("m"))
    return stats.pick(g, "lev", F.col("m") <= 26)


# Windows


@query("""WITH n AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 i, count(*) OVER (PARTITION BY user_id) z FROM events),
       k AS (SELECT *, greatest(0, least(i - 2, z - 5)) s FROM n WHERE z >= 5)
       SELECT a.user_id, a.ts, a.event_id, round(median(b.value), 6) mid, round(max(b.value), 6) most FROM k a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.s AND a.s + 4 GROUP BY ALL""")
def clamp_shift_median(spark, d):
    t = windows.clamped_windows(profile(spark, d), ["user_id"], ["ts", "event_id"], "value", 5)
    return t.select("user_id", "ts", "event_id", r6("mid").alias("mid"), r6("most").alias("most"))


@query("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
       l AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) isl FROM n WHERE value >= 10)
       SELECT user_id, min(i) AS first, max(i) AS last, count(*) n, round(max(value), 6) peak, count(*) FILTER (value >= 40) seeds FROM l GROUP BY user_id, isl HAVING count(*) FILTER (value >= 40) >= 1""")
def hysteresis_1d(spark, d):
    t = windows.islands(profile(spark, d), ["user_id"], ["ts", "event_id"], "value", 10, 40)
    return t.select("user_id", "first", "last", "n", r6("peak").alias("peak"), "seeds")


@query("""WITH e AS (SELECT user_id, event_id pos, value FROM events), k AS (SELECT * FROM e WHERE pos % 5 = 0)
       SELECT e.user_id, e.pos, round(CASE WHEN p.pos IS NULL THEN q.value WHEN q.pos IS NULL OR q.pos = p.pos THEN p.value
       ELSE p.value + (q.value - p.value) / (q.pos - p.pos) * (e.pos - p.pos) END, 6) AS value FROM e
       ASOF LEFT JOIN k p ON p.user_id = e.user_id AND e.pos >= p.pos ASOF LEFT JOIN k q ON q.user_id = e.user_id AND e.pos <= q.pos""")
def interp_1d(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), "value")
    return windows.interpolated(e.select("user_id", "pos"), e.where("pos % 5 = 0"), ["user_id"], "pos", "value").select("user_id", "pos", r6("value").alias("value"))


@query("""WITH m AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) m FROM events)
       SELECT user_id, round(m + ln(sum(exp(0.1 * (value - m)))) / 0.1, 6) soft_max FROM m GROUP BY user_id, m""")
def logsumexp(spark, d):
    return windows.log_sum_exp(profile(spark, d), ["user_id"], "value", 0.1).select("user_id", r6("soft_max").alias("soft_max"))


@query("""WITH g AS (SELECT user_id, 1 / (1 + exp(-0.2 * (value - 20))) * lead(1 / (1 + exp(-0.2 * (value - 20)))) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events),
       m AS (SELECT *, max(p) OVER (PARTITION BY user_id) m FROM g WHERE p IS NOT NULL)
       SELECT user_id, round(m + ln(sum(exp(4 * (p - m)))) / 4, 6) soft_max FROM m GROUP BY user_id, m""")
def contiguity(spark, d):
    return windows.contiguity(profile(spark, d), ["user_id"], ["ts", "event_id"], "value", 20, 0.2, 4).select("user_id", r6("soft_max").alias("soft_max"))


@query("""SELECT user_id, event_id, round(a, 6) avg_next FROM (SELECT user_id, event_id, avg(value) OVER w a, count(*) OVER w n FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5""")
def sliding_mean(spark, d):
    return windows.sliding_mean(profile(spark, d), ["user_id"], ["ts", "event_id"], "value", 5).select("user_id", "event_id", r6("avg_next").alias("avg_next"))


@query("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER w i, count(*) OVER (PARTITION BY user_id) z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       k AS (SELECT unnest(range(-4, 5)) k), t AS (SELECT sum(exp(-0.5 * k * k)) t FROM k)
       SELECT a.user_id, a.event_id, round(sum(exp(-0.5 * k * k) / t * b.value), 6) smooth FROM n a CROSS JOIN k CROSS JOIN t JOIN n b ON b.user_id = a.user_id AND b.i = greatest(1, least(a.z, a.i + k)) GROUP BY ALL""")
def gaussian_smooth(spark, d):
    return windows.gaussian_smooth(profile(spark, d), ["user_id"], ["ts", "event_id"], "value", 1.0).select("user_id", "event_id", r6("smooth").alias("smooth"))


@query("""WITH n AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) nx FROM events)
       SELECT user_id, round(stddev_pop(nx - value) / sqrt(2), 6) noise, round(corr(value, nx), 6) lag1, count(*) n FROM n WHERE nx IS NOT NULL GROUP BY 1""")
def difference_noise(spark, d):
    t = windows.difference_noise(profile(spark, d), ["user_id"], ["ts", "event_id"], "value")
    return t.select("user_id", r6("noise").alias("noise"), r6("lag1").alias("lag1"), "n")


@query("""SELECT event_type, round(value, 0) v, round(max(c), 6) share FROM (SELECT event_type, round(value, 0) AS value, cume_dist() OVER (PARTITION BY event_type ORDER BY round(value, 0)) c FROM events) GROUP BY 1, 2""")
def ecdf(spark, d):
    e = table(spark, d, "events").select("event_type", F.round("value", 0).alias("v"))
    return windows.ecdf(e, ["event_type"], "v").select("event_type", "v", r6("share").alias("share"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2""")
def tumbling_day(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Volumes

CUBE = """cube AS (SELECT volume, z, y, x, sum(q)::BIGINT::DOUBLE v, (((n * 128 + z) * 24 + y) * 24 + x)::BIGINT id FROM (SELECT l_returnflag || '-' || (l_partkey // 2000) volume,
          l_partkey // 2000 * 32 + ascii(l_returnflag) - 64 n, ((l_shipdate::DATE - DATE '1990-01-01') // 42)::BIGINT z, l_partkey % 2000 // 84 y, l_suppkey % 24 x, l_quantity q FROM lineitem)
          GROUP BY volume, n, z, y, x)"""
FACE = "((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"
OBJECTS = f"""{CUBE}, low AS (SELECT * FROM cube WHERE v >= 30), e AS (
          SELECT a.id a, b.id b FROM low a JOIN low b ON a.volume = b.volume AND a.z = b.z AND a.y = b.y AND abs(a.x - b.x) = 1 UNION ALL
          SELECT a.id, b.id FROM low a JOIN low b ON a.volume = b.volume AND a.z = b.z AND a.x = b.x AND abs(a.y - b.y) = 1 UNION ALL
          SELECT a.id, b.id FROM low a JOIN low b ON a.volume = b.volume AND a.x = b.x AND a.y = b.y AND abs(a.z - b.z) = 1),
          walk(id, seen) AS (SELECT id, id FROM low UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.seen),
          c AS (SELECT id, min(seen) component FROM walk GROUP BY 1),
          objects AS (SELECT low.*, component FROM low JOIN c USING (id) WHERE component IN (SELECT component FROM low JOIN c USING (id) GROUP BY 1 HAVING max(v) >= 48))"""


def _objects(spark, d):
    return volume.hysteresis(cube(spark, d), ["volume"], ["z", "y", "x"], "v", 30, 48, "id")


@query(f"""WITH RECURSIVE {OBJECTS} SELECT volume, component, count(*) n_voxels, count(*) FILTER (v >= 48) n_seed, max(v) peak,
       round(sum(v * z) / sum(v), 6) centroid_z, round(sum(v * y) / sum(v), 6) centroid_y, round(sum(v * x) / sum(v), 6) centroid_x, max(z) - min(z) + 1 z_extent,
       round(count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1))::DOUBLE, 6) fill, min(id) FILTER (v = m) - component peak_offset
       FROM (SELECT *, max(v) OVER (PARTITION BY component) m FROM objects) GROUP BY 1, 2""")
def hysteresis_objects(spark, d):
    f = volume.features(_objects(spark, d), ["volume"], ["z", "y", "x"], "v", 48)
    whole = SLICES * EDGE * EDGE
    top = F.col("component") - F.col("component") % whole + (F.col("peak_z") * EDGE + F.col("peak_y")) * EDGE + F.col("peak_x")
    return f.select(
        "volume", "component", "n_voxels", "n_seed", "peak", *[r6(f"centroid_{c}").alias(f"centroid_{c}") for c in "zyx"], "z_extent", r6("fill").alias("fill"),
        (top - F.col("component")).alias("peak_offset"),
    )


@query(f"""WITH RECURSIVE {OBJECTS} SELECT component, round(avg(CASE WHEN k = 6 THEN 0 ELSE 1 END), 6) surface FROM
       (SELECT o.id, o.component, count(e.b) k FROM objects o LEFT JOIN e ON e.a = o.id GROUP BY 1, 2) GROUP BY 1""")
def surface_ratios(spark, d):
    return volume.surface_ratio(_objects(spark, d), ["volume"], ["z", "y", "x"], "id").select("component", r6("surface").alias("surface"))


@query(f"""WITH RECURSIVE {OBJECTS}, hi AS (SELECT * FROM objects WHERE v >= 48), f AS (SELECT e.a, e.b FROM e JOIN hi p ON p.id = e.a JOIN hi q ON q.id = e.b),
       climb(id, seen) AS (SELECT id, id FROM hi UNION SELECT climb.id, f.b FROM climb JOIN f ON f.a = climb.seen),
       core AS (SELECT component, max(n) n_seed FROM (SELECT component, root, count(*) n FROM (SELECT id, min(seen) root FROM climb GROUP BY 1) JOIN hi USING (id) GROUP BY 1, 2) GROUP BY 1),
       m AS (SELECT volume, component, count(*) n_voxels, max(z) - min(z) + 1 z_extent, sum(v * z) / sum(v) cz, sum(v * y) / sum(v) cy, sum(v * x) / sum(v) cx, max(v) peak, min(id) FILTER (v = m) top,
         var_pop(z) + 1 / 12 a, var_pop(y) + 1 / 12 b, var_pop(x) + 1 / 12 c, covar_pop(z, y) d, covar_pop(z, x) e, covar_pop(y, x) f FROM (SELECT *, max(v) OVER (PARTITION BY component) m FROM objects) GROUP BY 1, 2),
       q AS (SELECT *, (a + b + c) / 3 q FROM m WHERE z_extent <= 10), p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) p FROM q),
       r AS (SELECT *, CASE WHEN p < 1e-9 THEN 0 ELSE acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / 2 / p ** 3))) / 3 END r FROM p),
       l AS (SELECT *, q + 2 * p * cos(r) l1, q + 2 * p * cos(r + 2 * pi() / 3) l3 FROM r)
       SELECT volume, n_voxels, n_seed, z_extent, round(cz, 6) centroid_z, round(cy, 6) centroid_y, round(cx, 6) centroid_x, peak, top // 576 % 128 peak_z, top // 24 % 24 peak_y, top % 24 peak_x,
         abs(round((2 * l1 - 3 * q + l3) / l1, 4)) linearity, abs(round((3 * q - l1 - 2 * l3) / l1, 4)) planarity, abs(round(l3 / l1, 4)) sphericity FROM l JOIN core USING (component)""")
def detect_slabs(spark, d):
    v = cube(spark, d).select("volume", "z", "y", "x", "v")
    t = volume.detect_slabs(v, volume.Detection(high=48, low=30, seeds=1, extent=10, slab=16))
    shape = [F.abs(F.round(c, 4)).alias(c) for c in ("linearity", "planarity", "sphericity")]
    return t.select("volume", "n_voxels", "n_seed", "z_extent", *[r6(f"centroid_{c}").alias(f"centroid_{c}") for c in "zyx"], "peak", "peak_z", "peak_y", "peak_x", *shape)


@query(f"WITH {CUBE} SELECT volume, y, x, max(v) mip FROM cube GROUP BY ALL")
def mip_projection(spark, d):
    return volume.mip(cube(spark, d), ["volume", "y", "x"], "v")


@query(f"""WITH {CUBE}, n AS (SELECT volume, v, count(*) n FROM cube GROUP BY 1, 2), lo AS (SELECT volume, v lo FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY n DESC, v) r FROM n) WHERE r = 1)
       SELECT volume, lo, round(quantile_cont(v, 0.985), 6) hi FROM cube JOIN lo USING (volume) GROUP BY 1, 2""")
def contrast_range(spark, d):
    return volume.contrast_range(cube(spark, d), ["volume"], "v").select("volume", "lo", r6("hi").alias("hi"))


@query(f"""WITH {CUBE}, p AS (SELECT volume, z, avg(v) m FROM cube GROUP BY 1, 2), g AS (SELECT volume, z, abs(lead(m) OVER w - lag(m) OVER w) d FROM p WINDOW w AS (PARTITION BY volume ORDER BY z)),
       r AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY d DESC, z) r FROM g WHERE d IS NOT NULL) SELECT volume, z AS at, round(d, 6) step FROM r WHERE r = 1""")
def axial_profile_argmax(spark, d):
    p = cube(spark, d).groupBy("volume", "z").agg(F.avg("v").alias("m"))
    return windows.strongest_edge(p, ["volume"], "z", "m").select("volume", "at", r6("step").alias("step"))


@query(f"""WITH {CUBE}, c AS (SELECT volume, z // 4 a, y // 4 b, x // 4 e, avg(v) m FROM cube GROUP BY ALL) SELECT volume, round(stddev_samp(m), 6) sd, count(*) cubes FROM c GROUP BY 1""")
def regional_sd(spark, d):
    return volume.regional_sd(cube(spark, d), ["volume"], ["z", "y", "x"], "v", 4).select("volume", r6("sd").alias("sd"), "cubes")


@query("""SELECT user_id % 8 AS shard, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1""")
def stream_recorded(spark, d):
    return recorder.recorded_totals(spark, d).select("shard", "n", F.round("total", 4).alias("total"))


@query()
def clopper_pearson(spark, d):
    s = scores(spark, d).groupBy("slab").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return stats.clopper_pearson(s, "k", "n")


@query()
def core_width(spark, d):
    e = profile(spark, d)
    diff = F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).cast("int")
    h = e.join(table(spark, d, "events").select("event_id", "event_type"), "event_id").withColumn("d", diff).where("d is not null").groupBy("event_type", "d").agg(F.count("*").alias("n"))
    return stats.core_width(h, ["event_type"], "d", "n")


# Store and simulation


@query("""SELECT c_custkey, c_name, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) candidate_id FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def minted_ids(spark, d):
    o = table(spark, d, "orders")
    new = table(spark, d, "customer").join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return store.minted(new.select("c_custkey", "c_name"), o.select(F.col("o_orderkey").alias("candidate_id")), "candidate_id", ["c_custkey"])


@query("""WITH log AS (SELECT o_custkey id, min(o_orderkey) match FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
       new AS (SELECT o_custkey id, max(o_orderkey) match FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
       SELECT * FROM log WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""")
def match_upsert(spark, d):
    o = table(spark, d, "orders")
    log = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("match"))
    new = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("match"))
    return store.upserted(log, new, "id", overwrite=True)


@query(f"""WITH p AS ({POINTS}), t AS (SELECT vec_id, z, cos(radians(15.0)) * y - sin(radians(15.0)) * x ry, sin(radians(15.0)) * y + cos(radians(15.0)) * x x1 FROM p)
       SELECT vec_id, round(cos(radians(-5.0)) * z - sin(radians(-5.0)) * x1, 6) rz, round(ry, 6) ry, round(sin(radians(-5.0)) * z + cos(radians(-5.0)) * x1, 6) rx FROM t""")
def rotated_points(spark, d):
    r = simulation.rotated(_points(spark, d), ("z", "y", "x"), 15.0, 5.0, (0.0, 0.0, 0.0))
    return r.select("vec_id", *[r6(c).alias(c) for c in ("rz", "ry", "rx")])


@query("""WITH t AS (SELECT l_partkey, l_returnflag f, l_extendedprice v, l_quantity q, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice DESC) r FROM lineitem),
       g AS (SELECT l_partkey, f, max(v) peak, sum(v) total, sum(v) / sqrt(sum(q * q)) cnr FROM t WHERE r <= 3 GROUP BY 1, 2)
       SELECT a.l_partkey, round(b.peak / a.peak, 6) peak_retention, round(b.total / a.total, 6) total_retention, round(b.cnr / a.cnr, 5) cnr_retention, round(a.peak - b.peak, 4) peak_drop
       FROM g a JOIN g b USING (l_partkey) WHERE a.f = 'A' AND b.f = 'R'""")
def contrast_retention(spark, d):
    r = simulation.retention(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "A", "R", "l_extendedprice", 3, "l_quantity")
    return r.select("l_partkey", r6("peak_retention").alias("peak_retention"), r6("total_retention").alias("total_retention"), F.round("cnr_retention", 5).alias("cnr_retention"), F.round("peak_drop", 4).alias("peak_drop"))


@query(f"""WITH {CUBE}, h AS (SELECT volume, v, count(*) n FROM cube GROUP BY 1, 2), c AS (SELECT volume, v, sum(n) OVER u w0, sum(v * n) OVER u s0, sum(n) OVER a w, sum(v * n) OVER a s FROM h
       WINDOW u AS (PARTITION BY volume ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY volume)),
       b AS (SELECT volume, v, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 3) b FROM c WHERE w0 < w)
       SELECT volume, v threshold FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY b DESC, v) r FROM b) WHERE r = 1""")
def otsu_threshold(spark, d):
    h = cube(spark, d).groupBy("volume", "v").agg(F.count("*").alias("n"))
    return simulation.otsu(h, ["volume"], "v", "n")


@query(f"""WITH {CUBE} SELECT volume, z, count(*) n, sum(v)::BIGINT::DOUBLE total FROM cube WHERE (y - 11.5) * (y - 11.5) + (x - 11.5) * (x - 11.5) < 100 GROUP BY 1, 2""")
def radial_mask(spark, d):
    c = cube(spark, d).where(simulation.inside_cylinder(F.col("y"), F.col("x"), (11.5, 11.5), 10.0))
    return c.groupBy("volume", "z").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"""WITH p AS ({POINTS}) SELECT vec_id, CAST(greatest(0, least(255, round_even(127.5 + 300.0 * x, 0))) AS INT) gray FROM p""")
def quantised_noise(spark, d):
    return _points(spark, d).select("vec_id", simulation.quantised(F.col("x"), 300.0, 255).alias("gray"))


@query()
def blobs_injected(spark, d):
    p = _points(spark, d).select("vec_id", F.col("label").cast("string").alias("volume"), *[(12 + 20 * F.col(c)).alias(c) for c in "zyx"])
    raster = simulation.rastered(p, "vec_id", ("z", "y", "x"), 1.0, 5.0).join(p.select("vec_id", "volume"), "vec_id")
    return simulation.injected(cube(spark, d), raster, ["volume", "z", "y", "x"], 255.0)


@query()
def correlated_series(spark, d):
    return simulation.ar2(profile(spark, d), ["user_id"], "event_id", "value", 0.5, 0.13)
