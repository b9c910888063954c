"""Embedding near-dedup: collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.operators.linking import reachable

from .tables import checked_broadcast, small_batches, stored
from .vectors import as_bytes, matrix

#: Steps of the sorted line to the distance at the threshold, in which vectors are counted for cells.
STEPS = 64


@dataclass(frozen=True)
class Projections:
    """lines: Gaussian projections counted for each pair; half: half-width of the window around a
    query, in standard deviations of the difference of a pair just at the threshold; miss: largest
    probability that such a pair collides too rarely (calibrates the count) or leaves the window of
    the first, sorted projection (calibrates that window). cell: vectors of a block."""

    cosine: float = 0.93
    lines: int = 32
    half: float = 1.5
    miss: float = 1e-6
    cell: int = 1000
    seed: int = 11

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def window(self) -> float:
        return self.half * self.distance

    @property
    def least(self) -> int:
        """Largest count that a pair at the threshold reaches with probability 1 - miss."""
        p = math.erf(self.half / math.sqrt(2))
        below = 0.0
        for k in range(self.lines + 1):
            below += math.comb(self.lines, k) * p**k * (1 - p) ** (self.lines - k)
            if below > self.miss:
                return k
        return self.lines

    @property
    def reach(self) -> float:
        """Half-width of the sorted projection's window, wide enough for all but `miss`."""
        z = 1.0
        while math.erfc(z / math.sqrt(2)) > self.miss:
            z += 0.01
        return z * self.distance


@cache
def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, n + 1))


def _prepare(cfg: Projections) -> Callable:
    """Unit vectors as raw doubles with their place on the first line; unusable vectors: null."""
    usable = as_bytes(np.asarray, zeros=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in usable(batches):
            raw: list = [None] * len(batch)
            at = np.full(len(batch), np.nan)
            good = np.flatnonzero(np.asarray(batch.column("u").is_valid()))
            for dim, (rows, x) in matrix(batch.column("u").take(pa.array(good)), np.float64).items():
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
                u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                at[good[rows]] = u @ _lines(dim, cfg.lines, cfg.seed)[:, -1]
                for i, v in zip(good[rows], u):
                    raw[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(at, mask=np.isnan(at))], ["vec_id", "label", "u", "at"])

    return run


def _least_reachable(known: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position over the links (i, j) and those that gave
    `known`, the smallest reachable ones so far."""
    label = np.arange(len(known))
    a, b = np.concatenate([i, j, label, known]), np.concatenate([j, i, known, label])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    while len(a):
        new = label.copy()
        new[a[first]] = np.minimum(label[a[first]], np.minimum.reduceat(label[b], first))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _windows(queries: np.ndarray, others: np.ndarray, half: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every line sorted: (each other vector's rank on each line; where each query's window of +-half begins among
    the ranks and how many it holds). Unsigned, so that a rank before the window wraps to a large one."""
    kind = np.uint16 if len(others) < 1 << 15 else np.uint32
    rank = np.empty((others.shape[1], len(others)), kind)
    first, width = np.empty((others.shape[1], len(queries)), kind), np.empty((others.shape[1], len(queries)), kind)
    for k in range(others.shape[1]):
        order = np.argsort(others[:, k], kind="stable")
        line = others[order, k]
        rank[k, order] = np.arange(len(others))
        first[k] = np.searchsorted(line, queries[:, k] - half, "left")
        width[k] = np.searchsorted(line, queries[:, k] + half, "right") - first[k]
    return rank, first, width


def _linked(cfg: Projections) -> Callable:
    """Of one pair of cells: for each vector with a link, how many vectors it links with there (copies
    counted) and the smallest id it reaches. Links are added up by blocks of 256 queries, so that no
    more of them are held at a time, however many pairs are linked."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").combine_chunks())
        own = bool(table.column("own")[0].as_py())
        order = np.argsort(np.asarray(table.column("vec_id").combine_chunks()), kind="stable")
        ids, copies = (np.asarray(table.column(c).combine_chunks())[order] for c in ("vec_id", "copies"))
        side, raw = side[order], [table.column("u")[int(k)].as_py() for k in order]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for dim in {len(r) // 8 for r in raw}:
            some = np.array([k for k, r in enumerate(raw) if len(r) // 8 == dim])
            q, x = some[side[some] == 0], some[side[some] == 1]
            if own:
                x = q
            if not len(q) or not len(x):
                continue
            U = np.frombuffer(b"".join(raw[k] for k in q), np.float64).reshape(len(q), dim)
            V = U if own else np.frombuffer(b"".join(raw[k] for k in x), np.float64).reshape(len(x), dim)
            lines = _lines(dim, cfg.lines, cfg.seed)[:, :-1].astype(np.float32)
            rank, first, width = _windows(U.astype(np.float32) @ lines, V.astype(np.float32) @ lines, np.float32(cfg.window))
            for s in range(0, len(q), 256):
                count = np.zeros((min(256, len(q) - s), len(x)), np.uint8)
                for k in range(cfg.lines):
                    count += rank[k, None] - first[k, s : s + 256, None] < width[k, s : s + 256, None]
                i, j = np.nonzero(count >= cfg.least)
                ok = np.zeros(len(i), bool)
                for c in range(0, len(i), 1 << 15):
                    d = slice(c, c + (1 << 15))
                    ok[d] = np.einsum("ij,ij->i", U[s + i[d]], V[j[d]]) >= cfg.cosine
                i, j = q[s + i[ok]], x[j[ok]]
                if own:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = _least_reachable(root, i, j)
        hit = links > 0
        return pa.table({"vec_id": pa.array(ids[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "least": pa.array(ids[root[hit]], pa.int64())})

    return run


def _cells(vectors: DataFrame, cfg: Projections) -> DataFrame:
    """(label, vec_id, u, at, copies, cell): cells of fewer than twice cfg.cell vectors (but for the
    hash's chance), wherever these lie, numbered along the line.

    The vectors of each label are counted in short steps along the line (a few thousand a label). Steps
    of at most cfg.cell vectors make up common cells in order; a larger one, all of whose vectors
    are within reach of each other, is dealt to several cells by a hash of vec_id.
    """
    placed = vectors.withColumn("step", F.floor(F.col("at") / (cfg.distance / STEPS)).cast("long"))
    counts = placed.groupBy("label", "step").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("q", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / cfg.cell).cast("long")), "steps")
    share = F.pmod(F.xxhash64("vec_id"), F.floor(F.col("n") / cfg.cell).cast("long"))
    # small steps have even numbers; a large step takes as many odd ones as the counts pass over
    cell = F.when(F.col("n") <= cfg.cell, 2 * F.col("q")).otherwise(2 * (F.col("q") + share) + 1)
    return placed.join(checked_broadcast(counts), ["label", "step"]).select("label", "vec_id", "u", "at", "copies", cell.alias("cell"))


def embedding_links(vectors: DataFrame, cfg: Projections = Projections()) -> DataFrame:
    """(vec_id, links, least) for distinct usable vectors (vec_id, label, u, at, copies): for each pair of
    cells that holds links of a vector, how many vectors it links with there and the smallest id that
    it reaches there.

    Each label's vectors are sorted along the first line into cells (`_cells`); two cells meet only if
    they come within the calibrated reach. A cell pair is one group, so a hot label becomes many
    groups of bounded size.
    """
    cut = stored(_cells(vectors, cfg), "cells")
    ranges = stored(cut.groupBy("label", "cell").agg(F.min("at").alias("lo"), F.max("at").alias("hi")), "ranges")
    x, y = ranges.alias("x"), ranges.alias("y")
    meets = x.join(y, F.expr(f"x.label = y.label and x.cell <= y.cell and y.lo - x.hi <= {cfg.reach}")).select(
        F.col("x.label").alias("label"), F.col("x.cell").alias("cx"), F.col("y.cell").alias("cy")
    )
    meets = stored(meets, "meets")
    left = cut.join(meets.withColumnRenamed("cx", "cell"), ["label", "cell"]).select("label", F.col("cell").alias("cx"), "cy", "vec_id", "u", "copies", F.lit(0).alias("side"))
    right = cut.join(meets.where("cx <> cy").withColumnRenamed("cy", "cell"), ["label", "cell"]).select("label", "cx", F.col("cell").alias("cy"), "vec_id", "u", "copies", F.lit(1).alias("side"))
    both = left.unionByName(right).withColumn("own", F.col("cx") == F.col("cy"))
    return both.groupBy("label", "cx", "cy").applyInArrow(_linked(cfg), "vec_id long, links long, least long")


def embedding_dedup(
    table: DataFrame, cfg: Projections = Projections(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors of a label are one numbered node, compared once and counted in full. Vectors
    that are null, empty, zero or hold null or non-finite components, or have a null label or id, link
    with nothing. Vectors of different length never link. Rows that repeat an id are
    separate vectors, each with its own links; all of a component's rows with its smallest id are kept. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(rows.mapInArrow(_prepare(cfg), "vec_id long, label string, u binary, at double"), "vectors")
    usable = F.col("u").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.withColumn("h", F.when(usable, F.sha2("u", 256)))
    classes = stored(
        keyed.where(usable).groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("u").alias("u"), F.first("at").alias("at"))
        .withColumn("node", F.monotonically_increasing_id()), "classes"
    )
    links = stored(embedding_links(classes.select(F.col("node").alias("vec_id"), "label", "u", "at", "copies"), cfg), "links")
    direct = links.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("others"))
    comp = reachable(links, "vec_id", "least").withColumnRenamed("id", "node")
    nodes = classes.select("node", "label", "h", "rep", "copies").join(direct, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    per = nodes.join(least, "root").select("label", "h", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "label", "h").join(per, ["label", "h"], "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))
