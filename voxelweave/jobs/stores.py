"""Queries over an experiment store that is filled from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions.storage import scratch
from voxelweave.jobs.registry import query, r6
from voxelweave.sources.store import Store
from voxelweave.sources.tables import label_of, table

STORE = """cand AS (SELECT o_orderkey candidate_id, c_nationkey::BIGINT experiment_id, o_orderpriority volume_name, o_orderdate AS at, o_totalprice price, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 4 END label
           FROM orders JOIN customer ON o_custkey = c_custkey), seen AS (SELECT * FROM cand WHERE NOT (volume_name = '5-LOW' AND experiment_id % 2 = 0))"""


def _filled(spark: SparkSession, d: str) -> Store:
    """A store with every nation as an experiment and every priority as a volume; some recordings broke off before
    their marker."""
    s = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("experiment_id"), (F.col("n_nationkey") * 10).cast("long").alias("experiment_number"), (F.col("n_regionkey") + 5).cast("long").alias("slab_thickness"))
    names = {"high_threshold_scale": "double", "low_threshold_scale": "double", "baseline_method": "string", "min_seed_voxels": "long", "aniso_factor": "double", "small_vol_cutoff": "long", "z_pad": "long", "small_z_bounds": "array<long>", "min_fill": "double", "max_axial_extent_mm": "double", "enforce_shape_gates": "boolean"}
    s.write("experiments", n.select("*", *[F.lit(None).cast(kind).alias(k) for k, kind in names.items()]))
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("candidate_id"), F.col("c_nationkey").cast("long").alias("experiment_id"), F.col("o_orderpriority").alias("volume_name"), label_of().alias("label"), F.col("o_totalprice").alias("price"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at")
    )
    place = [F.lit(None).cast("int").alias(c) for c in ("particle", "peak_z", "peak_y", "peak_x")] + [F.lit(None).cast("double").alias(f"centroid_{c}") for c in "zyx"]
    s.write("candidates", j.select("candidate_id", "experiment_id", "volume_name", *place).repartition("experiment_id", "volume_name"))
    s.write("label_events", j.select("candidate_id", F.lit(0).cast("long").alias("at"), F.lit(-1).alias("label")).unionByName(j.where("label <> 4").select("candidate_id", "at", "label")))
    scores = j.where("candidate_id % 3 = 0").select("candidate_id", "experiment_id", "volume_name", (F.col("price") / 1e6).alias("ml_prob"), F.lit(None).cast("double").alias("ml_prob_particle_max"), F.lit(None).cast("long").alias("ml_prob_max_source_candidate_id"), F.lit(None).cast("int").alias("cluster_ml_label"), F.lit(None).cast("boolean").alias("in_sample"))
    s.write("scores", scores.repartition("experiment_id", "volume_name"))
    done = j.where("not (volume_name = '5-LOW' and experiment_id % 2 = 0)").groupBy("experiment_id", "volume_name").agg(F.count("*").alias("n_candidates"))
    s.write("runs", done.withColumn("n_voxels", F.lit(0).cast("long")).coalesce(1))
    return s


@query(f"WITH {STORE} SELECT candidate_id, experiment_id, n_nationkey * 10::BIGINT experiment_number, n_regionkey + 5::BIGINT slab_thickness, volume_name, CASE WHEN label = 4 THEN -1 ELSE label END label, CASE WHEN candidate_id % 3 = 0 THEN round(price / 1e6, 6) END ml_prob FROM seen JOIN nation ON n_nationkey = experiment_id")
def store_flat_view(spark, d):
    return _filled(spark, d).flat().select("candidate_id", "experiment_id", "experiment_number", "slab_thickness", "volume_name", "label", r6("ml_prob").alias("ml_prob"))


@query(f"WITH {STORE} SELECT experiment_id, volume_name, count(*) n FROM seen WHERE experiment_id <> 3 AND NOT (experiment_id = 4 AND volume_name = '1-URGENT') GROUP BY 1, 2")
def store_delete(spark, d):
    """One experiment and one volume of another removed with all that belongs to them."""
    s = _filled(spark, d)
    if not (s.delete(3) and s.delete(4, "1-URGENT")) or s.delete(99):
        raise RuntimeError("the store did not delete what it holds")
    return s.visible().groupBy("experiment_id", "volume_name").agg(F.count("*").alias("n"))


@query(f"WITH {STORE}, v AS (SELECT DISTINCT volume_name FROM cand) SELECT volume_name FROM v WHERE volume_name NOT IN (SELECT volume_name FROM seen WHERE experiment_id = 2)")
def store_pending(spark, d):
    s = _filled(spark, d)
    return s.pending(s.read("candidates").select("volume_name").distinct(), 2)


@query(f"WITH {STORE} SELECT experiment_id, volume_name, count(*) n_candidates FROM seen GROUP BY 1, 2")
def store_runs(spark, d):
    return _filled(spark, d).read("runs").select("experiment_id", "volume_name", "n_candidates")
