"""A volume through switchable steps, each written and timed, with a log of runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.storage import cut, dropped, scratch
from voxelweave.jobs.registry import query
from voxelweave.jobs.scans import SCAN
from voxelweave.operators import windows
from voxelweave.sources.tables import scan

LOG = "input string, output string, settings map<string, string>, seconds map<string, double>, total double"


class Invalid(ValueError):
    """Raised by a step whose input cannot be processed."""


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]
    on: bool = True


def staged(volume: DataFrame, steps: list[Step], source: str, target: str, log: str, settings: dict[str, object] | None = None) -> tuple[int, DataFrame | None]:
    """(0, result) of all steps that are on, in order, written to target as Parquet; (1, None) if one finds its input Invalid.

    A step's result is a table in shared scratch that the next one reads, so a lost executor costs tasks of one step;
    it is removed once the next is written. A target that exists is an error. When the result is
    there, one row of seconds by step is added to the log; steps that are off have none.
    """
    spark, seconds, begun = volume.sparkSession, {}, time.time()
    before = None
    try:
        for step in steps:
            if step.on:
                start = time.time()
                volume = cut(step.run(volume), step.name)
                seconds[step.name] = time.time() - start
                if before is not None:
                    dropped(before)
                before = volume
    except Invalid:
        return 1, None
    start = time.time()
    volume.write.parquet(target)
    seconds["save"] = time.time() - start
    row = (source, target, {k: str(v) for k, v in (settings or {}).items()}, seconds, time.time() - begun)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)
    return 0, spark.read.parquet(target)


def _stretched(v: DataFrame) -> DataFrame:
    ends = v.groupBy("volume").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    return v.join(F.broadcast(ends), "volume").select("volume", "z", "y", "x", F.expr("CASE WHEN hi > lo THEN 255 * (g - lo) div (hi - lo) ELSE 0 END").alias("g"))  # one row a volume


def _cropped(v: DataFrame) -> DataFrame:
    edge = windows.strongest_edge(v.groupBy("volume", "z").agg(F.avg("g").alias("m")), ["volume"], "z", "m").select("volume", "at")
    near = v.join(F.broadcast(edge), "volume").where(F.col("z").between(F.col("at") - 10, F.col("at") + 10))
    return near.select("volume", (F.col("z") - F.col("at") + 10).alias("z"), "y", "x", "g")


STEPS = [
    Step("stretch", _stretched),
    Step("invert", lambda v: v.withColumn("g", 255 - F.col("g")), on=False),
    Step("mask", lambda v: v.withColumn("g", F.when((2 * F.col("y") - 7) ** 2 + (2 * F.col("x") - 7) ** 2 <= 49, F.col("g")).otherwise(F.lit(0).cast("long")))),
    Step("crop", _cropped),
    Step("flip", lambda v: v.withColumn("y", 7 - F.col("y"))),
]


@query(f"""WITH {SCAN}, a AS (SELECT volume, z, y, x, CASE WHEN (2 * y - 7) * (2 * y - 7) + (2 * x - 7) * (2 * x - 7) <= 49 AND hi > lo THEN 255 * (g - lo) // (hi - lo) ELSE 0 END g FROM scan JOIN (SELECT volume, min(g) lo, max(g) hi FROM scan GROUP BY 1) USING (volume)),
       p AS (SELECT volume, z, avg(g) m FROM a GROUP BY 1, 2), f AS (SELECT volume, z, abs(lead(m) OVER w - lag(m) OVER w) d FROM p WINDOW w AS (PARTITION BY volume ORDER BY z)),
       e AS (SELECT volume, z AS mid FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY d DESC, z) r FROM f WHERE d IS NOT NULL) WHERE r = 1)
       SELECT volume, z - mid + 10 z, 7 - y y, x, g FROM a JOIN e USING (volume) WHERE z BETWEEN mid - 10 AND mid + 10""")
def staged_scan(spark, d):
    """Volumes stretched, masked, cropped around their strongest edge and turned over, step by step."""
    at = f"{scratch(spark)}/stages-{uuid.uuid4().hex}"
    code, out = staged(scan(spark, d), STEPS, d, f"{at}/out", f"{at}/log")
    if code:
        raise RuntimeError("the steps did not finish")
    return out
