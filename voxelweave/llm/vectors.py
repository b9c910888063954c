"""What searches among vectors share: vectors as bytes, copies collapsed, queries against blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a chunk: what one group of the search kernels holds at most, some 40 MB each
#: with 64 dimensions. Smaller tables are dealt to BLOCKS blocks, so that the work still spreads.
BLOCK_ROWS = 1 << 16
BLOCKS = 16


def as_bytes(make: Callable[[np.ndarray], np.ndarray], zeros: bool) -> Callable:
    """Vectors of the last column as raw bytes of make(all components); unusable ones: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten().cast(pa.float64()), math.nan))
            row = np.repeat(np.arange(len(size)), size)
            good = (size > 0) & (np.bincount(row, ~np.isfinite(flat), len(size)) == 0)
            if not zeros:
                good &= np.bincount(row, flat != 0, len(size)) > 0
            data = make(np.where(np.isfinite(flat), flat, 0))
            ends = np.concatenate([[0], np.cumsum(size) * data.itemsize]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
            raw = pc.if_else(pa.array(good), raw, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], [*batch.schema.names[:-1], "u"])

    return run


def raw_vectors(table: DataFrame, carry: dict[str, Column], vector: Column, make: Callable = np.asarray, zeros: bool = True) -> DataFrame:
    """carry's columns (long) and u: a vector's components as raw bytes of make(doubles). Vectors that are null, empty,
    or hold null or non-finite components (or only zeros, unless `zeros`) are left out."""
    rows = table.select(*[c.cast("long").alias(n) for n, c in carry.items()], vector.cast("array<double>").alias("v"))
    return rows.mapInArrow(as_bytes(make, zeros), ", ".join(f"{n} long" for n in carry) + ", u binary").where("u is not null")


def collapsed(rows: DataFrame, same: list[str], k: int) -> DataFrame:
    """(same, ids): one row for all of equal `same`, with the k smallest distinct vec_id among them, ascending. Where
    ties go to the smaller id and k are asked for, the others cannot matter. Spark limits each group
    before the shuffle, so a hot vector costs k rows a task."""
    w = Window.partitionBy(*same).orderBy("vec_id")
    few = rows.select("vec_id", *same).withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k)
    return few.groupBy(*same).agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def block_count(n: int) -> int:
    return max(BLOCKS, math.ceil(n / BLOCK_ROWS))


def against(queries: DataFrame, rows: DataFrame, n_queries: int, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """kernel(queries, rows) for every block that queries name (column block) with the rows of that block. Of many
    queries, chunks of about BLOCK_ROWS meet a block one at a time; kernels return a few rows a query."""
    chunks = max(1, math.ceil(n_queries / BLOCK_ROWS))
    q = queries.withColumn("chunk", F.pmod(F.xxhash64("id", "key"), F.lit(chunks)))
    r = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(left.combine_chunks(), right.combine_chunks())

    return q.groupBy("block", "chunk").cogroup(r.groupBy("block", "chunk")).applyInArrow(run, schema)


def matrix(column: pa.ChunkedArray, kind: type) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Raw vectors by length: {dimensions: (positions, matrix of doubles)}."""
    raw = [v.as_py() for v in column]
    found: dict[int, list[int]] = {}
    for i, v in enumerate(raw):
        found.setdefault(len(v), []).append(i)
    width = np.dtype(kind).itemsize
    return {
        size // width: (np.array(at), np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)) for size, at in found.items()
    }


def best_ids(query: np.ndarray, score: np.ndarray, row: np.ndarray, ids: list[list[int]], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k highest scores, ties to the smaller id, without the query's own id.
    Pairs name collapsed rows; first k + 1 of these a query are opened into their ids."""
    least = np.array([i[0] for i in ids], np.int64)
    order = np.lexsort((least[row], -score, query))
    order = order[_rank(query[order]) <= k]
    query, score, row = query[order], score[order], row[order]
    many = np.array([len(ids[r]) for r in row], np.int64)
    found = np.array([i for r in row for i in ids[r]], np.int64)
    query, score = np.repeat(query, many), np.repeat(score, many)
    other = found != own[query]
    query, score, found = query[other], score[other], found[other]
    order = np.lexsort((found, -score, query))
    order = order[_rank(query[order]) < k]
    return query[order], found[order], score[order]


def _rank(group: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal ones."""
    if not len(group):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """found with rank from 1 within keys by score, highest first, then the smaller id; the first k only."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
