"""Headerless raw volumes as slice rows: a Python data source that reads runs of slices, skips those that a filter
excludes, and writes volumes as files of slices that one commit puts in order."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

# Bytes per voxel and the type they stand for.
DTYPES = {1: "uint8", 2: "uint16", 4: "float32"}


def infer_dtype(n_bytes: int, n_voxels: int) -> str:
    """Voxel type from file size; an error unless a whole 1, 2 or 4 bytes fall to each voxel."""
    size, rest = divmod(n_bytes, n_voxels)
    if rest or size not in DTYPES:
        raise ValueError(f"{n_bytes} bytes do not fit {n_voxels} voxels")
    return DTYPES[size]


#: The file that names a written volume's parts; parts that it does not name don't exist.
MANIFEST = "manifest.json"


@dataclass
class Slab(InputPartition):
    """Slices of one file: their numbers, and the place of the first in the file, in slices."""

    path: str
    volume: str
    slices: list[int]
    place: int
    height: int
    width: int
    dtype: str


class RawVolume(DataSource):
    """Options: path (a file every executor sees, or the folder of a written volume), slices (of a partition), first and
    last (slices to read, both included), push; for a single file also volume, height, width and itemsize.

    Rows are (volume, z, h, w, dtype, bytes). With push=true and spark.sql.python.filterPushdown.enabled, filters on z
    (equal, in, ranges) and volume choose partitions too, and Spark checks the rows again. Spark keeps what was
    pushed last with the loaded table, so a table loaded with push serves one query: two different filters
    on it would disturb each other. That is why it is off by default, where the range options do the same safely.
    """

    @classmethod
    def name(cls) -> str:
        return "rawvolume"

    def schema(self) -> str:
        return "volume string, z int, h int, w int, dtype string, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("slices", 64))
        self.options = {k: options.get(k) for k in ("volume", "height", "width", "itemsize")}
        self.low, self.high = (int(options[k]) if k in options else None for k in ("first", "last"))
        self.push = str(options.get("push", "false")).lower() == "true"
        self.among, self.volumes = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows what partitions() gives; all filters go back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None) if self.push else None
            if column == ("z",):
                if isinstance(f, EqualTo):
                    self.among = {f.value} if self.among is None else self.among & {f.value}
                elif isinstance(f, In):
                    self.among = set(f.value) if self.among is None else self.among & set(f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(x for x in (self.low, f.value + isinstance(f, GreaterThan)) if x is not None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(x for x in (self.high, f.value - isinstance(f, LessThan)) if x is not None)
            elif column == ("volume",) and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.volumes = found if self.volumes is None else self.volumes & found
            yield f

    def _wanted(self, z: int) -> bool:
        return (self.among is None or z in self.among) and (self.low is None or z >= self.low) and (self.high is None or z <= self.high)

    def _files(self) -> list[dict]:
        if os.path.isdir(self.path):
            with open(os.path.join(self.path, MANIFEST)) as f:
                return [{**part, "path": os.path.join(self.path, part["file"])} for part in json.load(f)]
        h, w, size = (int(self.options[k] or 1) for k in ("height", "width", "itemsize"))
        depth, rest = divmod(os.path.getsize(self.path), h * w * size)
        if rest:
            raise ValueError("the file does not hold whole slices")
        return [{"path": self.path, "volume": self.options["volume"] or "", "slices": range(depth), "height": h, "width": w, "dtype": DTYPES[size]}]

    def partitions(self) -> list[Slab]:
        found = []
        for f in self._files():
            if self.volumes is not None and f["volume"] not in self.volumes:
                continue
            for place in range(0, len(f["slices"]), self.step):
                run = list(f["slices"][place : place + self.step])
                keep = [i for i, z in enumerate(run) if self._wanted(z)]
                if keep:
                    run = run[keep[0] : keep[-1] + 1]
                    found.append(Slab(f["path"], f["volume"], run, place + keep[0], f["height"], f["width"], f["dtype"]))
        return found or [Slab("", "", [], 0, 0, 0, "")]

    def read(self, part: Slab) -> Iterator[tuple]:
        if not part.slices:
            return
        plane = part.height * part.width * np.dtype(part.dtype).itemsize
        with open(part.path, "rb") as f:
            f.seek(part.place * plane)
            for z in part.slices:
                data = f.read(plane)
                if self._wanted(z):
                    yield part.volume, z, part.height, part.width, part.dtype, data


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class _Writer(DataSourceWriter):
    """Every attempt of a task writes files of its own, one a volume, and names them in its message; the commit checks
    the slices of all parts, orders them and writes the manifest last, under its final name in one step.
    What a failed or repeated attempt left is never read."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, files = Written(), {}
        try:
            for r in rows:
                kind = (r["h"], r["w"], r["dtype"])
                if len(r["bytes"]) != r["h"] * r["w"] * np.dtype(r["dtype"]).itemsize:
                    raise ValueError(f"slice {r['z']} has {len(r['bytes'])} bytes")
                if r["volume"] not in files:
                    part = {"file": f"part-{uuid.uuid4().hex}.raw", "volume": r["volume"], "slices": [], "height": r["h"], "width": r["w"], "dtype": r["dtype"]}
                    files[r["volume"]] = open(os.path.join(self.path, part["file"]), "wb"), part
                    done.parts.append(part)
                f, part = files[r["volume"]]
                if kind != (part["height"], part["width"], part["dtype"]):
                    raise ValueError("slices of a volume differ in size or type")
                f.write(r["bytes"])
                part["slices"].append(r["z"])
        finally:
            for f, _ in files.values():
                f.close()
        return done

    def commit(self, messages: list) -> None:
        parts = [p for m in messages if m is not None for p in m.parts]
        target = os.path.join(self.path, MANIFEST)
        if os.path.exists(target) and not self.overwrite:
            with open(target) as f:
                parts = json.load(f) + parts
        seen: set[tuple] = set()
        for p in parts:
            for z in p["slices"]:
                if (p["volume"], z) in seen:
                    raise ValueError(f"slice {z} of volume {p['volume']} was written twice")
                seen.add((p["volume"], z))
        if len({(p["volume"], p["height"], p["width"], p["dtype"]) for p in parts}) > len({p["volume"] for p in parts}):
            raise ValueError("slices of a volume differ in size or type")
        os.makedirs(self.path, exist_ok=True)
        fresh = f"{target}.{uuid.uuid4().hex}"
        with open(fresh, "w") as f:
            json.dump(sorted(parts, key=lambda p: (p["volume"], p["slices"][:1])), f)
        os.replace(fresh, target)

    def abort(self, messages: list) -> None:
        for p in [p for m in messages if m is not None for p in m.parts]:
            if os.path.exists(os.path.join(self.path, p["file"])):
                os.remove(os.path.join(self.path, p["file"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawVolume)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_slices(voxels: DataFrame, value: str, height: int, width: int, dtype: str = "uint8") -> DataFrame:
    """(volume, z, h, w, dtype, bytes): one dense slice a group of voxels (volume, z, y, x, value); what is missing is 0."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((height, width), dtype)
        plane[pdf["y"], pdf["x"]] = pdf[value]
        return pd.DataFrame({"volume": [pdf["volume"].iloc[0]], "z": [int(pdf["z"].iloc[0])], "h": [height], "w": [width], "dtype": [dtype], "bytes": [plane.tobytes()]})

    return voxels.groupBy("volume", "z").applyInPandas(fill, RawVolume.schema(None))


def as_voxels(slices: DataFrame) -> DataFrame:
    """(volume, z, y, x, v): the voxels of slice rows, as doubles."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for r in t.itertuples():
                y, x = np.divmod(np.arange(r.h * r.w), r.w)
                yield pd.DataFrame({"volume": r.volume, "z": r.z, "y": y, "x": x, "v": np.frombuffer(r.bytes, r.dtype).astype(float)})

    return slices.mapInPandas(spread, "volume string, z long, y long, x long, v double")


def write_volume(slices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """slices as a written volume in the folder path. Slices are range-sorted first, so every part holds a run of them."""
    register(slices.sparkSession)
    slices.repartitionByRange("volume", "z").sortWithinPartitions("volume", "z").write.format("rawvolume").mode(mode).save(path)


def read_volume(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Slice rows; options as of RawVolume, such as first and last."""
    register(spark)
    return spark.read.format("rawvolume").options(**{k: str(v) for k, v in options.items()}).load(path)


def local_path(folder: str) -> str:
    """A shared folder as a path that open() takes; an error if it is none."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"raw volumes need a mounted folder, not {folder}")
    return folder.removeprefix("file://")
