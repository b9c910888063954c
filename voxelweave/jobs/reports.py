"""Queries of the review, calibration and experiment reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.functions.columns import infer_depth, physical, portal_yx, safe_ratio, slab_range
from voxelweave.jobs.registry import query, r6
from voxelweave.operators import relational, stats, windows
from voxelweave.operators.windows import quantiles
from voxelweave.sources.tables import label_of, profile, table

LABEL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 4 END"


# Configuration and lookups


@query("""SELECT p_partkey, (z // CASE WHEN z <= 6000 THEN 1 WHEN z <= 12000 THEN 2 ELSE 4 END)::BIGINT depth, CASE WHEN z <= 6000 THEN 1 WHEN z <= 12000 THEN 2 ELSE 4 END width
       FROM (SELECT p_partkey, (p_size * 800 * 100 * 100) // 10000 z FROM part)""")
def depth_inference(spark, d):
    p = table(spark, d, "part").withColumn("bytes", F.col("p_size").cast("long") * 800 * 100 * 100)
    depth, width = infer_depth(F.col("bytes"), 100, 100)
    return p.select("p_partkey", depth.alias("depth"), width.alias("width"))


@query("SELECT p_partkey experiment_number, p_type baseline_method, p_retailprice threshold FROM part WHERE p_size = 21")
def experiments_by_parameter(spark, d):
    found = relational.review_filter(table(spark, d, "part"), equals={"p_size": 21})
    return found.select(F.col("p_partkey").alias("experiment_number"), F.col("p_type").alias("baseline_method"), F.col("p_retailprice").alias("threshold"))


@query("SELECT p_size, p_type, min(p_partkey) first_config FROM part GROUP BY 1, 2")
def config_resolver(spark, d):
    """The first entry of every (thickness, method) at once, where a lookup asks for one."""
    return table(spark, d, "part").groupBy("p_size", "p_type").agg(F.min("p_partkey").alias("first_config"))


@query("SELECT p_partkey experiment_number, p_brand site, p_size slab, round(p_retailprice, 6) scale FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part WHERE p_type = 'SMALL')")
def experiment_row(spark, d):
    p = table(spark, d, "part")
    key = p.where("p_type = 'SMALL'").agg(F.max("p_partkey").alias("p_partkey"))
    row = p.join(F.broadcast(key), "p_partkey")  # one key
    return row.select(F.col("p_partkey").alias("experiment_number"), F.col("p_brand").alias("site"), F.col("p_size").alias("slab"), r6("p_retailprice").alias("scale"))


@query("""SELECT p_partkey, CAST(round_even(p_size / 2.0 / 0.0164, 0) AS INT) radius, CAST(round_even(1.5 / 0.0164, 0) AS INT) padding, CAST(ceil(p_size / 0.0164) AS BIGINT) extent,
       CAST(round_even(p_size / (0.0164 * 0.0164), 0) AS INT) area, round(degrees(atan(1.0 / p_size)), 9) least_angle FROM part""")
def scan_parameters(spark, d):
    s, size = 0.0164, F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.bround(size / 2 / s, 0).cast("int").alias("radius"), F.bround(F.lit(1.5 / s), 0).cast("int").alias("padding"), F.ceil(size / s).cast("long").alias("extent"),
        F.bround(size / (s * s), 0).cast("int").alias("area"), F.round(F.degrees(F.atan(1 / size)), 9).alias("least_angle"),
    )


@query("""SELECT DISTINCT l_linenumber::BIGINT seed, CAST(l_quantity AS INT) depth, round(l_discount * 10, 3) sigma, l_shipdate::DATE::VARCHAR AS at,
       coalesce(l_linestatus, '') state FROM lineitem""")
def condition_keys(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(
        F.col("l_linenumber").cast("long").alias("seed"), F.col("l_quantity").cast("int").alias("depth"), F.round(F.col("l_discount") * 10, 3).alias("sigma"),
        F.col("l_shipdate").cast("date").cast("string").alias("at"), F.coalesce("l_linestatus", F.lit("")).alias("state"),
    ).distinct()


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '%LOW')")
def not_yet_processed(spark, d):
    done = F.col("o_orderpriority").endswith("URGENT") | F.col("o_orderpriority").endswith("LOW")
    return table(spark, d, "orders").where(~done).select("o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, round(atan(0.5 * w / sdd), 9) half_angle, round(pi() * w * (sdd - 30) / (sqrt(sdd * sdd + w * w / 4) * (pi() / 2 + atan(0.5 * w / sdd))), 6) critical,
       round(pitch * (pi() + 2 * atan(0.5 * w / sdd)) / (2 * pi()), 6) excess, round((120 + pitch * (pi() + 2 * atan(0.5 * w / sdd)) / (2 * pi())) / pitch, 6) turns
       FROM (SELECT p_partkey, p_size::DOUBLE w, p_retailprice sdd, p_size / 4.0 pitch FROM part)""")
def pitch_geometry(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), F.col("p_retailprice").alias("sdd"), (F.col("p_size") / 4).alias("pitch"))
    w, sdd, pitch = F.col("w"), F.col("sdd"), F.col("pitch")
    half = F.atan(0.5 * w / sdd)
    critical = math.pi * w * (sdd - 30) / (F.sqrt(sdd * sdd + w * w / 4) * (math.pi / 2 + half))
    excess = pitch * (math.pi + 2 * half) / (2 * math.pi)
    return p.select("p_partkey", F.round(half, 9).alias("half_angle"), r6(critical).alias("critical"), r6(excess).alias("excess"), r6((120 + excess) / pitch).alias("turns"))


# Review tables


@query(f"""SELECT o_orderkey candidate_id, CASE WHEN {LABEL} IS NOT NULL AND NOT ({LABEL} = 1 AND o_orderpriority IN ('1-URGENT', '5-LOW')) THEN 1 ELSE 0 END in_sample FROM orders""")
def in_sample(spark, d):
    o = table(spark, d, "orders").withColumn("label", label_of())
    spiked = F.coalesce((F.col("label") == 1) & F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.lit(False))
    return o.select(F.col("o_orderkey").alias("candidate_id"), (F.col("label").isNotNull() & ~spiked).cast("int").alias("in_sample"))


@query("SELECT event_id, user_id, value FROM events WHERE value >= 5 AND event_type <> 'error'")
def query_string(spark, d):
    return table(spark, d, "events").where("value >= 5 and event_type <> 'error'").select("event_id", "user_id", "value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem, (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s, avg(l_extendedprice) pm, stddev_pop(l_extendedprice) ps FROM lineitem)
       WHERE l_quantity > m - s AND l_quantity < m + s AND l_extendedprice > pm - 0.5 * ps AND l_extendedprice < pm + 0.5 * ps AND l_linenumber IN (1, 3, 5) AND l_returnflag IN ('A', 'R')""")
def box_filter(spark, d):
    t = table(spark, d, "lineitem")
    spread = t.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"), F.avg("l_extendedprice").alias("pm"), F.stddev_pop("l_extendedprice").alias("ps"))
    near = lambda c, m, s, k: (F.col(c) > F.col(m) - k * F.col(s)) & (F.col(c) < F.col(m) + k * F.col(s))
    j = t.crossJoin(F.broadcast(spread)).where(near("l_quantity", "m", "s", 1.0) & near("l_extendedprice", "pm", "ps", 0.5))
    return relational.review_filter(j, within={"l_linenumber": [1, 3, 5], "l_returnflag": ["A", "R"]}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""SELECT l_orderkey, l_linenumber, p_brand cluster, coalesce({LABEL}, -1) label, CASE l_returnflag WHEN 'A' THEN 'kept' WHEN 'R' THEN 'returned' END verdict
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_linenumber <= p_size LEFT JOIN orders ON l_orderkey = o_orderkey""")
def instance_cluster(spark, d):
    t, p, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    j = t.join(p, (t.l_partkey == p.p_partkey) & (t.l_linenumber <= p.p_size), "left").join(o, t.l_orderkey == o.o_orderkey, "left")
    names = F.create_map(F.lit("A"), F.lit("kept"), F.lit("R"), F.lit("returned"))
    return j.select("l_orderkey", "l_linenumber", F.col("p_brand").alias("cluster"), F.coalesce(label_of(), F.lit(-1)).alias("label"), F.try_element_at(names, "l_returnflag").alias("verdict"))


@query("""SELECT status, n, row_number() OVER (ORDER BY n DESC, status NULLS LAST) place FROM
       (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END status, count(*) n FROM orders GROUP BY 1)""")
def label_counts(spark, d):
    n = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("status").asc_nulls_last())))  # a row a label


@query("""SELECT o_custkey component, min(o_totalprice) FILTER (o_orderstatus <> 'P') label_price, count(*) n FROM orders GROUP BY 1""")
def first_known(spark, d):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.min(known).alias("label_price"), F.count("*").alias("n"))


@query(f"SELECT l_linestatus slab, {LABEL} label, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def config_label_counts(spark, d):
    t, o = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return t.join(o, t.l_orderkey == o.o_orderkey).groupBy(F.col("l_linestatus").alias("slab"), label_of().alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(avg(dz), 6) mean_dz, round(stddev_pop(dz), 6) sd_dz, round(avg(dy), 6) mean_dy, round(stddev_pop(dy), 6) sd_dy FROM (SELECT l_returnflag, l_linestatus, l_quantity - l_tax / 0.0164 dz, l_partkey - (1425 - l_suppkey) dy FROM lineitem) GROUP BY 1, 2")
def alignment_offsets(spark, d):
    t = table(spark, d, "lineitem").withColumn("dz", F.col("l_quantity") - F.col("l_tax") / 0.0164).withColumn("dy", F.col("l_partkey") - (1425 - F.col("l_suppkey")))
    return t.groupBy("l_returnflag", "l_linestatus").agg(*[r6(f(c)).alias(f"{n}_{c}") for c in ("dz", "dy") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


@query("SELECT event_type, count(*) FILTER (value > 4.7) above, count(*) n FROM events GROUP BY 1")
def above_threshold(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 4.7).alias("above"), F.count("*").alias("n"))


@query(f"""SELECT * FROM (SELECT o_orderkey candidate_id, 1 y, o_totalprice score FROM orders WHERE {LABEL} = 1 UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE {LABEL} = 0)""")
def labelled_sets(spark, d):
    o = table(spark, d, "orders").withColumn("label", label_of())
    one = lambda k: o.where(F.col("label") == k).select(F.col("o_orderkey").alias("candidate_id"), F.lit(k).alias("y"), F.col("o_totalprice").alias("score"))
    return one(1).unionByName(one(0))


@query("SELECT p_type, p_size, min(p_partkey) first FROM part GROUP BY 1, 2")
def distinct_configs(spark, d):
    p = table(spark, d, "part")
    pairs = p.select("p_type", "p_size").dropDuplicates()
    return pairs.join(p, ["p_type", "p_size"]).groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("first"))


@query("SELECT level, min(event_id) first_seen FROM (SELECT event_id, greatest(2, least(17, floor(value)))::INT AS level FROM events) GROUP BY 1")
def slice_levels(spark, d):
    """Levels clipped to the slices there are, each once, by its first occurrence."""
    e = table(spark, d, "events").withColumn("level", F.greatest(F.lit(2), F.least(F.lit(17), F.floor("value"))).cast("int"))
    return e.groupBy("level").agg(F.min("event_id").alias("first_seen"))


@query("""SELECT l_orderkey candidate_id, l_linenumber AS line, p, row_number() OVER (ORDER BY p DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey) place FROM
       (SELECT *, CASE WHEN l_discount < 0.03 THEN NULL ELSE l_discount END p FROM lineitem)""")
def review_order(spark, d):
    """Place of every row in the review list: scores descending, missing ones last, ties by three keys. Sorted ranges
    carry the counts, so no task sees the whole list."""
    t = table(spark, d, "lineitem").withColumn("p", F.when(F.col("l_discount") >= 0.03, F.col("l_discount")))
    t = t.withColumn("behind", F.when(F.col("p").isNull(), F.lit(float("inf"))).otherwise(-F.col("p").cast("double"))).withColumn("one", F.lit(1))
    t = windows.running(t, [], ["behind", "l_orderkey", "l_linenumber", "l_partkey"], ["one"])
    return t.select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("line"), "p", (F.col("one_before") + 1).alias("place"))


@query("SELECT min(o_orderkey) first_open FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def first_unresolved(spark, d):
    log = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(log, "o_orderkey", "left_anti").agg(F.min("o_orderkey").alias("first_open"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|7'), o_orderkey LIMIT 200")
def seeded_sample(spark, d):
    return relational.seeded_sample(table(spark, d, "orders"), "o_orderkey", 200, 7).select("o_orderkey")


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5(n_nationkey::VARCHAR || '|3'), n_nationkey) place FROM nation")
def shuffled_cells(spark, d):
    """A fixed random order of the cells of each group."""
    w = Window.partitionBy("n_regionkey").orderBy(relational.seeded_key("n_nationkey", 3), "n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(w).alias("place"))


# Measures and differences


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS phase, round(sum(l_tax), 6) AS seconds, count(*) n FROM lineitem GROUP BY 1, 2, 3")
def timing_rollup(spark, d):
    phase = F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", phase.alias("phase")).agg(r6(F.sum("l_tax")).alias("seconds"), F.count("*").alias("n"))


DIFF = """SELECT metric, CASE WHEN bool_or((a IS NULL) <> (b IS NULL)) THEN 'Infinity'::DOUBLE ELSE coalesce(round(max(abs(a - b)), 6), 0) END max_abs,
          CASE WHEN bool_or((a IS NULL) <> (b IS NULL)) THEN 'Infinity'::DOUBLE ELSE coalesce(round(avg(abs(a - b)), 6), 0) END mean_abs FROM"""


@query(f"""WITH f AS (SELECT l_orderkey k, max(l_tax) tax, max(l_discount) FILTER (l_linenumber <= 7) discount, max(CASE WHEN l_linenumber < 0 THEN 1.0 END) none FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
       g AS (SELECT l_orderkey k, min(l_tax) tax, min(l_discount) FILTER (l_linenumber > 1) discount, max(CASE WHEN l_linenumber < 0 THEN 1.0 END) none FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
       {DIFF} (SELECT 'tax' metric, f.tax a, g.tax b FROM f JOIN g USING (k) UNION ALL SELECT 'discount', f.discount, g.discount FROM f JOIN g USING (k) UNION ALL SELECT 'none', f.none, g.none FROM f JOIN g USING (k)) GROUP BY 1""")
def column_differences(spark, d):
    t = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    none = F.max(F.when(F.col("l_linenumber") < 0, F.lit(1.0))).alias("none")
    f = t.groupBy("l_orderkey").agg(F.max("l_tax").alias("tax"), F.max(F.when(F.col("l_linenumber") <= 7, F.col("l_discount"))).alias("discount"), none)
    g = t.groupBy("l_orderkey").agg(F.min("l_tax").alias("tax"), F.min(F.when(F.col("l_linenumber") > 1, F.col("l_discount"))).alias("discount"), none)
    out = stats.column_differences(f, g, ["l_orderkey"], ["tax", "discount", "none"])
    return out.select("metric", r6("max_abs").alias("max_abs"), r6("mean_abs").alias("mean_abs"))


@query("""SELECT l_linenumber, l_returnflag, round(avg(CASE WHEN b <> 0 THEN a / b END), 6) factor, round(avg(a), 6) plain FROM
       (SELECT l_linenumber, l_returnflag, l_tax a, l_discount b FROM lineitem) GROUP BY 1, 2""")
def noise_factors(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_linenumber", "l_returnflag").agg(r6(F.avg(safe_ratio(F.col("l_tax"), F.col("l_discount")))).alias("factor"), r6(F.avg("l_tax")).alias("plain"))


@query("""WITH m AS (SELECT o_custkey item, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) w0, max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) w1,
       max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) w2 FROM orders GROUP BY 1), l AS (UNPIVOT m ON w0, w1, w2 INTO NAME w VALUE hit)
       SELECT a.w AS first, b.w AS second, count(*) FILTER (a.hit = 1 AND b.hit = 0) only_first, count(*) FILTER (a.hit = 0 AND b.hit = 1) only_second,
       round((count(*) FILTER (a.hit = 1 AND b.hit = 0) - count(*) FILTER (a.hit = 0 AND b.hit = 1)) / count(*), 6) diff FROM l a JOIN l b ON a.item = b.item AND a.w < b.w GROUP BY 1, 2""")
def window_pairs(spark, d):
    """Unordered pairs of windows: what only one of both finds."""
    m = _detections(spark, d)
    return stats.discordant_pairs(m, "item", ["w0", "w1", "w2"]).select("first", "second", "only_first", "only_second", r6("diff").alias("diff"))


def _detections(spark: SparkSession, d: str) -> DataFrame:
    found = lambda p: F.max((F.col("o_orderpriority") == p).cast("int"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(found("1-URGENT").alias("w0"), found("3-MEDIUM").alias("w1"), found("5-LOW").alias("w2"))


@query()
def paired_intervals(spark, d):
    """Exact conditional intervals of the differences between windows, nominal and for all pairs together."""
    return stats.paired_intervals(stats.discordant_pairs(_detections(spark, d), "item", ["w0", "w1", "w2"]))


@query("""WITH p AS (SELECT l_partkey k, avg(l_extendedprice) FILTER (l_returnflag = 'A') a, avg(l_extendedprice) FILTER (l_returnflag = 'R') b, l_linestatus g FROM lineitem GROUP BY l_partkey, l_linestatus),
       x AS (SELECT g, round(a - b, 6) d FROM p WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 r FROM x WHERE d <> 0),
       s AS (SELECT g, count(*) n, avg(d) m, stddev_samp(d) sd FROM x GROUP BY 1), w AS (SELECT g, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) w FROM n GROUP BY 1)
       SELECT g, n, round(m, 4) mean_diff, round(m / (sd / sqrt(n)), 6) t, round(w, 2) w FROM s JOIN w USING (g)""")
def paired_tests(spark, d):
    when = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    pairs = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_linestatus").alias("g")).agg(when("A").alias("a"), when("R").alias("b"))
    out = stats.paired_tests(pairs.where("a is not null and b is not null").select("g", F.round(F.col("a") - F.col("b"), 6).alias("d")), ["g"], "d")
    return out.select("g", "n", F.round("mean_diff", 4).alias("mean_diff"), r6("t").alias("t"), F.round("w", 2).alias("w"))


def _auc_sql(rows: str) -> str:
    return f"""SELECT feature, k, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) auc FROM
        (SELECT *, rank() OVER (PARTITION BY feature, k ORDER BY v) + (count(*) OVER (PARTITION BY feature, k, v) - 1) / 2.0 r FROM ({rows})) GROUP BY 1, 2"""


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]
LONG = "SELECT 0 k, metric feature, v, y FROM (UNPIVOT (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y, " + ", ".join(f"{c}::DOUBLE {c}" for c in FEATURES) + " FROM lineitem) ON " + ", ".join(FEATURES) + " INTO NAME metric VALUE v)"


@query(f"SELECT feature, round(auc, 6) auc FROM ({_auc_sql(LONG)}) ORDER BY auc DESC, feature LIMIT 6")
def top_features(spark, d):
    t = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    a = stats.auc(t.unpivot("y", FEATURES, "feature", "v"), "v", "y", ["feature"])
    return a.orderBy(F.col("auc").desc(), "feature").limit(6).select("feature", r6("auc").alias("auc"))


KLOW = "SELECT l_linenumber k, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y, l_quantity / greatest(1, round(l_discount * 100)) growth, l_partkey % 3 regions, l_extendedprice v FROM lineitem WHERE l_linenumber <= 5"


@query(f"""WITH c AS ({KLOW}), a AS ({_auc_sql("SELECT 'v' feature, k, v, y FROM c")})
       SELECT c.k, round(median(growth) FILTER (y = 1), 6) grow_median, round(avg(CASE WHEN growth < 5 THEN 100.0 ELSE 0 END) FILTER (y = 1), 6) near_seed,
       round(avg(CASE WHEN regions > 1 THEN 100.0 ELSE 0 END) FILTER (y = 1), 6) merged, count(*) FILTER (y = 0) n_fp, round(max(auc), 6) auc FROM c JOIN a USING (k) GROUP BY 1""")
def low_threshold_table(spark, d):
    t = table(spark, d, "lineitem").where("l_linenumber <= 5").select(
        F.col("l_linenumber").alias("k"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_quantity") / F.greatest(F.lit(1.0), F.round(F.col("l_discount") * 100))).alias("growth"),
        (F.col("l_partkey") % 3).alias("regions"), F.col("l_extendedprice").alias("v"),
    )
    found = t.where("y = 1")
    share = lambda c: r6(F.avg(F.when(F.col("y") == 1, F.when(c, 100.0).otherwise(0.0))))
    g = t.groupBy("k").agg(share(F.col("growth") < 5).alias("near_seed"), share(F.col("regions") > 1).alias("merged"), F.count_if(F.col("y") == 0).alias("n_fp"))
    mid = quantiles(found, ["k"], "growth", {"grow_median": 0.5})
    return g.join(mid, "k").join(stats.auc(t, "v", "y", ["k"]), "k").select("k", r6("grow_median").alias("grow_median"), "near_seed", "merged", "n_fp", r6("auc").alias("auc"))


@query(f"""WITH r AS (SELECT 'v' feature, l_suppkey % 10 k, l_extendedprice v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y FROM lineitem),
       ok AS (SELECT k FROM r GROUP BY 1 HAVING max(y) = 1 AND min(y) = 0), a AS ({_auc_sql("SELECT * FROM r WHERE k IN (SELECT k FROM ok)")})
       SELECT count(*) folds, round(avg(auc), 6) mean_auc, round(stddev_samp(auc), 6) sd_auc FROM a""")
def held_out_group_auc(spark, d):
    """AUC of each held-out group that has both classes, over groups."""
    r = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("k"), F.col("l_extendedprice").alias("v"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    a = stats.auc(r, "v", "y", ["k"]).where("auc is not null")
    return a.agg(F.count("*").alias("folds"), r6(F.avg("auc")).alias("mean_auc"), r6(F.stddev_samp("auc")).alias("sd_auc"))


@query("""WITH s AS (SELECT l_discount * 10 p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y FROM lineitem), t AS (SELECT t, count(*) FILTER (p >= t AND y = 1)::DOUBLE tp, count(*) FILTER (p >= t AND y = 0)::DOUBLE fp,
       count(*) FILTER (p < t AND y = 1)::DOUBLE fn, count(*)::DOUBLE n FROM s CROSS JOIN (VALUES (0.2::DOUBLE), (0.5), (0.8)) v(t) GROUP BY 1)
       SELECT t threshold, round((tp + n - tp - fp - fn) / n, 6) accuracy, round(CASE WHEN tp > 0 THEN 3 * tp / (3 * tp + 2 * fn + fp) END, 6) f_beta FROM t""")
def accuracy_f_beta(spark, d):
    """Accuracy and F-beta with beta squared 2 (recall counts twice)."""
    s = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return stats.accuracy_f_beta(s, "p", "y", [0.2, 0.5, 0.8], 2.0).select("threshold", r6("accuracy").alias("accuracy"), r6("f_beta").alias("f_beta"))


@query("""WITH w AS (SELECT o_orderkey candidate_id, o_custkey component, o_orderpriority volume, o_totalprice p, o_orderstatus s FROM orders), b AS (SELECT component, max(p) best, arg_min(candidate_id, (-p, candidate_id)) source,
       max(CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 1 END) label, count(*) n FROM w GROUP BY 1) SELECT candidate_id, round(best, 2) best, source, coalesce(label, -1) label, n, v.volume best_volume
       FROM w JOIN b USING (component) JOIN (SELECT candidate_id source, volume FROM w) v USING (source)""")
def cluster_scores(spark, d):
    """Each instance with its cluster's best score, the instance that gave it, and that one's place."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("component"), F.col("o_orderpriority").alias("volume"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    label = F.max(F.when(F.col("s") == "F", 0).when(F.col("s") == "O", 1))
    best = F.min_by("candidate_id", F.struct(-F.col("p"), "candidate_id")).alias("source")
    b = o.groupBy("component").agg(F.max("p").alias("best"), best, label.alias("label"), F.count("*").alias("n"))
    b = b.join(o.select(F.col("candidate_id").alias("source"), F.col("volume").alias("best_volume")), "source")
    return o.join(b, "component").select("candidate_id", F.round("best", 2).alias("best"), "source", F.coalesce("label", F.lit(-1)).alias("label"), "n", "best_volume")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * power(s_mm, 3), 9) size_mm, round(l_tax * s_mm, 9) extent_mm, round(l_discount * s_mm * s_mm, 9) l1_mm,
       round(least(l_linenumber - 1, 7 - l_linenumber) * s_mm, 9) edge_mm FROM lineitem JOIN (SELECT s_suppkey, 0.01 + s_nationkey / 1000.0 s_mm FROM supplier) ON l_suppkey = s_suppkey""")
def unit_features(spark, d):
    """Voxel measures in millimetres by the voxel size of their volume."""
    t, s = table(spark, d, "lineitem"), table(spark, d, "supplier").select("s_suppkey", (0.01 + F.col("s_nationkey") / 1000).alias("s_mm"))
    j = t.join(s, t.l_suppkey == s.s_suppkey).withColumns({"size": F.col("l_quantity"), "extent": F.col("l_tax"), "l1": F.col("l_discount"), "edge": F.least(F.col("l_linenumber") - 1, 7 - F.col("l_linenumber"))})
    mm = physical({"size": "volume", "extent": "length", "l1": "area", "edge": "length"}, F.col("s_mm"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", *mm).select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 9).alias(c) for c in ("size_mm", "extent_mm", "l1_mm", "edge_mm")])


# Geometry


@query("""SELECT vec_id, CAST(1424 - CAST(floor(700 + 600 * y) AS BIGINT) AS BIGINT) portal_y, CAST(floor(700 + 600 * x) AS BIGINT) portal_x, CAST(round_even((20 * (z + 1) + 0.5) / 0.0164, 0) AS BIGINT) first,
       CAST(round_even((20 * (z + 1) + 0.5) / 0.0164 + 1.0 / 0.0164, 0) AS BIGINT) last FROM (SELECT vec_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings)""")
def portal_positions(spark, d):
    p = _points(spark, d).withColumn("ry", F.floor(700 + 600 * F.col("y"))).withColumn("rx", F.floor(700 + 600 * F.col("x")))
    y, x = portal_yx(F.col("ry"), F.col("rx"), 1425)
    first, last = slab_range(20 * (F.col("z") + 1), 0.0164)
    return p.select("vec_id", y.alias("portal_y"), x.alias("portal_x"), first.alias("first"), last.alias("last"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


POINTS = "SELECT vec_id, label, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings"


@query(f"""WITH b AS (SELECT label, floor(100 * min(x))::BIGINT lo, floor(100 * max(x))::BIGINT + 1 hi, floor(100 * min(y))::BIGINT lo2, floor(100 * max(y))::BIGINT + 1 hi2 FROM ({POINTS}) GROUP BY 1), u AS (SELECT min(lo) all0, max(hi) all1 FROM b)
       SELECT label, greatest(lo - 3, -20) x0, least(hi + 3, 20) x1, lo2 y0, hi2 y1, all0, all1, (hi - lo) * (hi2 - lo2) area FROM b, u WHERE greatest(lo - 3, -20) < least(hi + 3, 20)""")
def boxes_of_points(spark, d):
    """Half-open boxes of labelled points, widened, clipped, and their union."""
    at = lambda c, f: F.floor(100 * f(c)).cast("long")
    b = _points(spark, d).groupBy("label").agg(at("x", F.min).alias("lo"), (at("x", F.max) + 1).alias("hi"), at("y", F.min).alias("y0"), (at("y", F.max) + 1).alias("y1"))
    u = b.agg(F.min("lo").alias("all0"), F.max("hi").alias("all1"))
    x0, x1 = F.greatest(F.col("lo") - 3, F.lit(-20)), F.least(F.col("hi") + 3, F.lit(20))
    out = b.crossJoin(F.broadcast(u)).select("label", x0.alias("x0"), x1.alias("x1"), "y0", "y1", "all0", "all1", ((F.col("hi") - F.col("lo")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return out.where("x0 < x1")


@query(f"""WITH p AS ({POINTS}), s AS (SELECT label, regr_slope(x, z) sx, regr_slope(y, z) sy FROM p GROUP BY 1), r AS (SELECT label, 1 / sqrt(1 + sx * sx + sy * sy) a, sx / sqrt(1 + sx * sx + sy * sy) b, sy / sqrt(1 + sx * sx + sy * sy) c FROM s)
       SELECT vec_id, round(a * z + b * x + c * y, 6) rz, round(-b * z + (1 - b * b / (1 + a)) * x - b * c / (1 + a) * y, 6) rx, round(-c * z - b * c / (1 + a) * x + (1 - c * c / (1 + a)) * y, 6) ry FROM p JOIN r USING (label)""")
def straightened(spark, d):
    """Points turned so that the fitted centre line of their label becomes the z axis."""
    p = _points(spark, d)
    s = p.groupBy("label").agg(F.regr_slope("x", "z").alias("sx"), F.regr_slope("y", "z").alias("sy"))
    n = F.sqrt(1 + F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    u = s.select("label", (1 / n).alias("a"), (F.col("sx") / n).alias("b"), (F.col("sy") / n).alias("c"))
    a, b, c, z, x, y = (F.col(k) for k in "abczxy")
    k = 1 / (1 + a)  # (1 - cosine) / sine^2
    out = p.join(u, "label")
    return out.select("vec_id", r6(a * z + b * x + c * y).alias("rz"), r6(-b * z + (1 - b * b * k) * x - b * c * k * y).alias("rx"), r6(-c * z - b * c * k * x + (1 - c * c * k) * y).alias("ry"))


@query("""WITH o AS (SELECT o_custkey g, o_orderkey k, epoch(o_orderdate) / 86400.0 x, o_totalprice / 1000 y FROM orders),
       c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(k::VARCHAR || '|0'), k) r FROM o), s AS (SELECT a.g, a.r i, b.r j, (b.y - a.y) / (b.x - a.x) m, a.y - (b.y - a.y) / (b.x - a.x) * a.x q FROM c a JOIN c b ON a.g = b.g AND a.r < b.r AND b.r <= 8 AND a.x <> b.x),
       n AS (SELECT s.g, i, j, m, q, count(*) FILTER (abs(y - m * x - q) <= 40) n FROM s JOIN o ON o.g = s.g GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, i, j) r FROM n) WHERE r = 1)
       SELECT o.g, count(*) inliers, round(regr_slope(y, x), 6) slope FROM o JOIN best USING (g) WHERE abs(y - m * x - q) <= 40 GROUP BY 1 HAVING count(DISTINCT x) > 1""")
def robust_lines(spark, d):
    """The line through two sampled points of a group that most points lie near, fitted again to these."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6).alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return stats.robust_line(o, ["g"], "k", "x", "y", 40.0, 8).select("g", "inliers", r6("slope").alias("slope"))


@query()
def quadratic_surface(spark, d):
    """Six coefficients of a surface over (x, y), by label."""
    return stats.quadratic_surface(_points(spark, d), ["label"], "x", "y", "z")


@query()
def mixture(spark, d):
    """Two Gaussian components of the event values, weights and means in order of the means."""
    return stats.gaussian_mixture(profile(spark, d), "value", 2)
