"""Queries of the experiment reports: what was reviewed and found, by size and place; grids; labels and views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelweave.functions.columns import slab_range
from voxelweave.functions.storage import scratch
from voxelweave.jobs import catalogue
from voxelweave.jobs.registry import SQL, query, r6
from voxelweave.jobs.scans import SCAN
from voxelweave.operators import experiments
from voxelweave.sources import files
from voxelweave.sources.tables import SLICES, cube, label_of, scan, table

#: Cells whose particles were put in on purpose; the windows, sizes and bands of the recall report.
SPIKED = ["1-URGENT", "2-HIGH"]
WINDOWS, SIZES, BANDS = [1, 2, 3, 4, 5], [0.0, 60.0, 150.0], [0.0, 50.0, 100.0, 200.0, 300.0, 450.0]


@query("""SELECT coalesce(o_orderpriority, 'all') volume, count(*) total, count(*) FILTER (o_orderstatus IN ('F', 'O')) reviewed, round(count(*) FILTER (o_orderstatus IN ('F', 'O')) / count(*), 3) share
       FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def reviewed_fraction(spark, d):
    """Candidates and reviewed ones of each volume and of all."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("place"), label_of().isin(0, 1).alias("done"))
    g = o.rollup("place").agg(F.count("*").alias("total"), F.count_if("done").alias("reviewed"))
    return g.select(F.coalesce("place", F.lit("all")).alias("volume"), "total", "reviewed", F.round(F.col("reviewed") / F.col("total"), 3).alias("share"))


@query("""WITH t AS (SELECT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) spiked, o_totalprice v FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT min(v) lo, max(v) hi FROM t)
       SELECT spiked, least(floor((v - lo) / (hi - lo) * 50), 49)::BIGINT bin, count(*) n FROM t CROSS JOIN e GROUP BY 1, 2""")
def natural_split(spark, d):
    """Distances of found particles in spiked cells beside those in all others, on common bins."""
    t = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.coalesce(F.col("o_orderpriority").isin(SPIKED), F.lit(False)).alias("spiked"), F.col("o_totalprice").alias("v"))
    ends = t.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49)).cast("long")
    return t.crossJoin(F.broadcast(ends)).groupBy("spiked", at.alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber k, printf('%.4f', avg(l_quantity)) growth, printf('%.4f', avg(l_discount)) share, count(*) n FROM lineitem GROUP BY 1""")
def decision_table(spark, d):
    """The table of decisions with four decimals, written as CSV with a header and read back."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_quantity").alias("growth"), F.avg("l_discount").alias("share"), F.count("*").alias("n"))
    path = f"{scratch(spark)}/decisions-{uuid.uuid4().hex}"
    files.fixed(t).coalesce(1).write.option("header", True).csv(path)  # a row a level
    return files.csv(spark, path, "k int, growth string, share string, n long")


@query(f"""WITH grid AS ({SQL["sensitivity_grid"]}) SELECT tol, ceiling, picked, dense_rank() OVER (ORDER BY picked) - 1 code FROM grid""")
def grid_codes(spark, d):
    """What the sensitivity grid picks, as codes of a heat map."""
    return experiments.rank_codes(catalogue.sensitivity_grid(spark, d), "picked").select("tol", "ceiling", "picked", F.col("code").cast("long").alias("code"))


OBJECTS = """o AS (SELECT l_orderkey id, sum(l_quantity) size, max((l_linenumber = 1)::INT) w1, max((l_linenumber = 2)::INT) w2, max((l_linenumber = 3)::INT) w3, max((l_linenumber = 4)::INT) w4, max((l_linenumber = 5)::INT) w5 FROM lineitem GROUP BY 1),
          objects AS (SELECT o.*, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END truth, o_totalprice / 1000 radial FROM o JOIN orders ON id = o_orderkey), levels AS (SELECT unnest([0, 60, 150])::DOUBLE AS level)"""


def _objects(spark, d):
    found = [F.max((F.col("l_linenumber") == w).cast("int")).alias(f"w{w}") for w in WINDOWS]
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("size"), *found)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("truth"), (F.col("o_totalprice") / 1000).alias("radial"))
    return g.join(o, "id")


_BY_SIZE = " UNION ALL ".join(
    f"SELECT level, 'w{w}' AS window_, count(*) FILTER (truth = 1) n, count(*) FILTER (truth = 1 AND w{w} = 1) hits, round(count(*) FILTER (truth = 1 AND w{w} = 1) / count(*) FILTER (truth = 1), 6) recall, count(*) FILTER (truth = 0) n_false, "
    f"count(*) FILTER (truth = 0 AND w{w} = 1) false_hits, round(count(*) FILTER (truth = 0 AND w{w} = 1) / greatest(1, count(*) FILTER (truth = 1 AND w{w} = 1)), 6) false_ratio FROM objects JOIN levels ON size >= level GROUP BY 1"
    for w in WINDOWS
)


def _recall(spark, d):
    return experiments.recall_by_size(_objects(spark, d), [f"w{w}" for w in WINDOWS], "size", "truth", SIZES)


@query(f"WITH {OBJECTS} {_BY_SIZE}")
def recall_by_size(spark, d):
    """Recall of every window over objects of at least each size, and the false ones it found beside."""
    return _recall(spark, d).withColumnsRenamed({"window": "window_"}).withColumns({"recall": r6("recall"), "false_ratio": r6("false_ratio")})


@query()
def recall_intervals(spark, d):
    """The same with exact intervals, nominal and for all windows together."""
    t = experiments.recall_intervals(_recall(spark, d), len(WINDOWS))
    return t.withColumns({c: r6(c) for c in ("recall", "false_ratio", "low", "high", "low_all", "high_all")})


@query(f"""WITH {OBJECTS}, b AS (SELECT unnest(range(5)) band, unnest([0, 50, 100, 200, 300])::DOUBLE lo, unnest([50, 100, 200, 300, 450])::DOUBLE hi),
       g AS (SELECT level, band, count(*) FILTER (truth = 1) n_true, count(*) FILTER (truth = 0) n_false FROM objects JOIN levels ON size >= level LEFT JOIN b ON radial >= lo AND radial < hi WHERE truth IS NOT NULL GROUP BY 1, 2)
       SELECT level, band, n_true, n_false, round(n_false / greatest(1, n_true + n_false), 6) of_band, round(n_false / greatest(1, every), 6) of_false FROM (SELECT *, sum(n_false) OVER (PARTITION BY level) every FROM g) WHERE band IS NOT NULL""")
def radial_bands(spark, d):
    t = experiments.radial_bands(_objects(spark, d), "radial", "size", "truth", SIZES, BANDS)
    return t.withColumns({"of_band": r6("of_band"), "of_false": r6("of_false")})


@query(f"""WITH {SCAN}, s AS (SELECT *, 7.5 + 0.25 * (split_part(volume, '-', 2)::BIGINT % 4) p FROM scan)
       SELECT volume, y, x, count(*) n, round(avg(g), 6) mean FROM s WHERE z >= round_even((p + 0.5) / 0.1, 0) AND z < round_even((p + 0.5) / 0.1 + 1.0 / 0.1, 0) GROUP BY 1, 2, 3""")
def portal_slabs(spark, d):
    """The mean of the slices that the viewer's slab holds at a place of each volume."""
    s = scan(spark, d)
    at = 7.5 + 0.25 * (F.split_part("volume", F.lit("-"), F.lit(2)).cast("long") % 4)
    first, last = slab_range(at, 0.1)
    return s.where((F.col("z") >= first) & (F.col("z") < last)).groupBy("volume", "y", "x").agg(F.count("*").alias("n"), r6(F.avg("g")).alias("mean"))


@query(f"""WITH {SCAN}, p AS (SELECT volume, z, y, x, g // 40 AS k FROM scan WHERE g >= 40), e AS (
       SELECT volume, z, arg_min(k, x) k FROM p WHERE y = 4 GROUP BY 1, 2 UNION ALL SELECT volume, z, arg_max(k, x) FROM p WHERE y = 4 GROUP BY 1, 2 UNION ALL
       SELECT volume, z, arg_min(k, y) FROM p WHERE x = 4 GROUP BY 1, 2 UNION ALL SELECT volume, z, arg_max(k, y) FROM p WHERE x = 4 GROUP BY 1, 2), v AS (SELECT volume, z, k, count(*) n FROM e GROUP BY 1, 2, 3)
       SELECT volume, z, k AS label, n votes FROM (SELECT *, row_number() OVER (PARTITION BY volume, z ORDER BY n DESC, k) r FROM v) WHERE r = 1""")
def outer_labels(spark, d):
    """The label that stands outermost on the centre lines of every slice."""
    return experiments.outer_label_vote(scan(spark, d).withColumn("k", F.expr("g div 40")), ["volume", "z"], "k", 8, 8)


@query(f"""WITH RECURSIVE {catalogue.CUBE}, mip AS (SELECT volume, y, x, max(v) / 6 m, (min(id) // (576 * 128) * 576 + y * 24 + x)::BIGINT id FROM cube GROUP BY 1, 2, 3),
       pk AS (SELECT volume, y, x FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY m DESC, y, x) r FROM mip) WHERE r = 1),
       nine AS (SELECT mip.volume, m, row_number() OVER (PARTITION BY mip.volume ORDER BY m DESC) r FROM mip JOIN pk ON mip.volume = pk.volume AND abs(mip.y - pk.y) <= 1 AND abs(mip.x - pk.x) <= 1),
       noise AS (SELECT volume, least(2.7, avg(m) / 4.2) s FROM nine WHERE r <= 2 GROUP BY 1), low AS (SELECT mip.*, s FROM mip JOIN noise USING (volume) WHERE m > 2.8 * s),
       step AS (SELECT i.range dy, j.range dx FROM range(-1, 2) i, range(-1, 2) j), e AS (SELECT a.id a, b.id b FROM low a CROSS JOIN step JOIN low b ON a.volume = b.volume AND b.y = a.y + dy AND b.x = a.x + dx),
       walk(id, seen) AS (SELECT id, id FROM low UNION SELECT walk.id, e.b FROM walk JOIN e ON e.a = walk.seen), c AS (SELECT id, min(seen) component FROM walk GROUP BY 1)
       SELECT volume, y, x, round(m, 6) m, component FROM low JOIN c USING (id) WHERE component IN (SELECT component FROM low JOIN c USING (id) WHERE m > 4 * s)""")
def peak_views(spark, d):
    """What stands out around the peak of every volume's projection."""
    c = cube(spark, d)
    plane = 24 * 24
    p = c.groupBy("volume", "y", "x").agg((F.max("v") / 6).alias("m"), F.floor(F.min("id") / (plane * SLICES)).alias("_number"))
    p = p.withColumn("id", (F.col("_number") * plane + F.col("y") * 24 + F.col("x")).cast("long")).drop("_number")
    peaks = p.groupBy("volume").agg(F.min_by(F.struct("y", "x"), F.struct(-F.col("m"), "y", "x")).alias("at")).select("volume", "at.*")
    return experiments.peak_views(p, peaks, "volume", "m", "id").select("volume", "y", "x", r6("m").alias("m"), "component")
