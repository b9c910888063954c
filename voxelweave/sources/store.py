"""The experiment store on Parquet folders: fixed schemas, id minting, appends, scoped deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.functions.storage import cut

# Column names and types of the store's tables.
SCHEMAS = {
    "experiments": "experiment_id long, experiment_number long, slab_thickness long, high_threshold_scale double, low_threshold_scale double, baseline_method string, min_seed_voxels long, aniso_factor double, small_vol_cutoff long, z_pad long, small_z_bounds array<long>, min_fill double, max_axial_extent_mm double, enforce_shape_gates boolean",
    "candidates": "candidate_id long, experiment_id long, volume_name string, particle int, peak_z int, peak_y int, peak_x int, centroid_z double, centroid_y double, centroid_x double",
    "features": "candidate_id long, n_voxels long, n_seed long, n_seed_regions long, n_seed_total long, z_min int, z_max int, z_extent int, y_extent int, x_extent int, fill double, snr_cluster double, r_peak double, r_peak_ratio double, peak_offset double, seed_offset double, snr_peak double, linearity double, planarity double, sphericity double, axis_z double, normal_z double, edge_contrast double, decay_drop double, seed_grown_ratio double, fill_pca double, diag double, radial_pos double, gs_median double, gs_p90 double, gs_peak double, gs_shell_median double, gs_contrast double, gs_iqr double, metal_threshold double, l1 double, l2 double, l3 double, surface_ratio double, z_extent_max int",
    "voxels": "candidate_id long, z int, y int, x int, residual int, grayscale int, in_grown int",
    "runs": "experiment_id long, volume_name string, n_candidates long, n_voxels long",
    "scores": "candidate_id long, ml_prob double, ml_prob_particle_max double, ml_prob_max_source_candidate_id long, cluster_ml_label int, in_sample boolean",
    "label_events": "candidate_id long, at long, label int",
}
PLACE = {"experiment_id": "long", "volume_name": "string"}
#: Columns by which a table is partitioned; others aren't.
PARTITIONS = {"experiments": ["experiment_id"]} | dict.fromkeys(("candidates", "features", "voxels", "runs", "scores"), [*PLACE])


def minted(rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with dense new ids above those of existing, in the given order.

    Rows are range-sorted, written with the number of their range, counted by range and numbered within it,
    so no task sees all of them and no range changes between the two readings.
    """
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    parts = cut(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "minted")
    n = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_rank", rank).join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))
    return out.withColumn(key, F.col("_top") + F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before", "_top")


def upserted(log: DataFrame, new: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """log with the rows of new whose key it lacks; with overwrite, new rows replace old ones."""
    if overwrite:
        return log.join(new.select(key), key, "left_anti").unionByName(new)
    return log.unionByName(new.join(log.select(key), key, "left_anti"))


@dataclass
class Store:
    """Parquet tables in folders, those of a volume partitioned by (experiment_id, volume_name).

    A recording overwrites its own partitions only, so one that broke off is simply run again; its row
    in `runs` is written last, and what has none is not visible. A delete removes that row first. Each
    commit is Spark's own; a table whose folder exists is never taken for an empty one.
    """

    spark: SparkSession
    root: str

    def _path(self, table: str, experiment: int | None = None, volume: str | None = None) -> str:
        path = f"{self.root}/{table}"
        if experiment is not None:
            path += f"/experiment_id={experiment}"
        if volume is not None:
            path += "/volume_name=" + self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(volume)
        return path

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _schema(self, table: str) -> str:
        own = SCHEMAS[table]
        extra = [f"{c} {PLACE[c]}" for c in PARTITIONS.get(table, []) if f"{c} {PLACE[c]}" not in own]
        return ", ".join([own, *extra])

    def read(self, table: str) -> DataFrame:
        """The table; empty only where its folder was never made. Tables of volumes have the place columns."""
        fs, at = self._fs(self._path(table))
        if not fs.exists(at):
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(self._path(table))

    def write(self, table: str, rows: DataFrame, mode: str = "append") -> None:
        """Append rows, or replace ("overwrite") the partitions that they fall in - the whole of a table
        without partitions."""
        names = [f.split()[0] for f in self._schema(table).split(", ")]
        out = rows.select(*names).write.mode(mode)
        if table in PARTITIONS:
            out = out.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[table])
        out.parquet(self._path(table))

    def delete(self, experiment: int, volume: str | None = None) -> bool:
        """Remove an experiment, or one volume of it: first its runs, then the rest; False if there was
        nothing. Only folders of this experiment are touched."""
        found = False
        for table in ("runs", "voxels", "features", "scores", "candidates", *(["experiments"] if volume is None else [])):
            fs, at = self._fs(self._path(table, experiment, volume))
            found = bool(fs.delete(at, True)) or found
        return found

    def record(self, experiment: int, volume: str, candidates: DataFrame, voxels: DataFrame) -> None:
        """A volume's candidates, their features (those columns that candidates has) and voxels (joined by peak), then
        its completion marker; a volume without candidates still gets one. Recorded again, it replaces what was there."""
        peak = ["peak_z", "peak_y", "peak_x"]
        place = [F.lit(experiment).cast("long").alias("experiment_id"), F.lit(volume).alias("volume_name")]
        self.delete(experiment, volume)
        known = self.read("candidates").select("candidate_id").unionByName(self.read("label_events").select("candidate_id"))  # an id is never used again
        new = minted(candidates.select(*[c for c in candidates.columns if c not in PLACE]), known, "candidate_id", peak)
        new = cut(new.select("*", *place, *([] if "particle" in new.columns else [F.lit(None).cast("int").alias("particle")])), "recorded")
        self.write("candidates", new, "overwrite")
        known = {c: k for c, k in (f.split() for f in self._schema("features").split(", ")) if c not in ("candidate_id", *PLACE)}
        if any(c in new.columns for c in known):
            values = [(F.col(c) if c in new.columns else F.lit(None)).cast("long" if k == "long" else k).alias(c) for c, k in known.items()]
            self.write("features", new.select("candidate_id", *values, *PLACE), "overwrite")
        held = voxels.join(new.select("candidate_id", *peak), peak)
        self.write("voxels", held.select("*", *place), "overwrite")
        counts = new.agg(F.count("*").alias("n_candidates")).crossJoin(voxels.agg(F.count("*").alias("n_voxels")))
        self.write("runs", counts.select("*", *place), "overwrite")

    def visible(self, table: str = "candidates") -> DataFrame:
        """Rows of volumes whose recording was completed."""
        return self.read(table).join(self.read("runs").select(*PLACE).distinct(), [*PLACE], "left_semi")

    def pending(self, volumes: DataFrame, experiment: int) -> DataFrame:
        """Volumes (column volume_name) that have no run yet."""
        return volumes.join(self.read("runs").where(F.col("experiment_id") == experiment).select("volume_name"), "volume_name", "left_anti")

    def labels(self) -> DataFrame:
        """(candidate_id, label): the latest event of each candidate that is still there."""
        latest = self.read("label_events").groupBy("candidate_id").agg(F.max_by("label", "at").alias("label"))
        return latest.join(self.read("candidates").select("candidate_id"), "candidate_id", "left_semi")

    def flat(self) -> DataFrame:
        """Visible candidates with their experiment's settings, latest label and score; what is missing is null."""
        return (
            self.visible().join(self.read("experiments"), "experiment_id").join(self.labels(), "candidate_id", "left")
            .join(self.read("scores").drop(*PLACE), "candidate_id", "left")
        )
