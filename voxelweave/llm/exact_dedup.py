"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .tables import small_batches

#: Characters of a text that the splitters are sampled from, before its 64-bit hash.
SPLIT_CHARS = 32


@th.lean
def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one batch become one row: a hot text leaves a map task as a few rows."""
    for batch in batches:
        t = pa.table({"text": batch.column("text").cast(pa.large_string()), "id": batch.column("id")})
        g = t.group_by("text").aggregate([("id", "max"), ("id", "min"), ("text", "count")])
        yield from pa.table(
            {"text": g["text"].cast(pa.string()), "hi": g["id_max"], "lo": g["id_min"], "n": g["text_count"]}
        ).combine_chunks().to_batches()


@th.lean
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row per run of equal texts out: each text is compared in full with the
    one before it. Only the run still open is carried from batch to batch."""
    open_text = None
    hi = lo = None
    n = 0
    schema = pa.schema([("text", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)], schema=schema)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column("text")
        new = [open_text is None or text[0].as_py() != open_text]
        if batch.num_rows > 1:
            new += pc.not_equal(text.slice(1), text.slice(0, batch.num_rows - 1)).to_pylist()
        his, los, ns = (batch.column(c).to_pylist() for c in ("hi", "lo", "n"))
        done = []
        for i, fresh in enumerate(new):
            if fresh:
                if open_text is not None:
                    done.append((open_text, hi, lo, n))
                open_text, hi, lo, n = text[i].as_py(), his[i], los[i], ns[i]
            else:
                hi = his[i] if hi is None else hi if his[i] is None else max(hi, his[i])
                lo = los[i] if lo is None else lo if los[i] is None else min(lo, los[i])
                n += ns[i]
        if done:
            yield flush(done)
    if open_text is not None:
        yield flush([(open_text, hi, lo, n)])


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, hi, lo, n): every distinct text with its largest and smallest id and its row count.

    Rows are collapsed within a batch, range-partitioned by splitters that Spark samples from a
    short prefix and a hash (never from whole texts), sorted with Spark's spilling sort, and
    neighbours are compared in full.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    few = rows.mapInArrow(_collapse, "text string, hi long, lo long, n long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = few.withColumn("p", F.substring("text", 1, SPLIT_CHARS)).withColumn("h", F.xxhash64("text"))
    sorted_ = key.repartitionByRange(parts, "p", "h").sortWithinPartitions("p", "h", "text").select("text", "hi", "lo", "n")
    return sorted_.mapInArrow(_neighbours, "text string, hi long, lo long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    keep: which id of equal texts stays, "largest" or "smallest". Null and empty texts are equal.
    A null id never wins over another; if a group has only null ids, keep_id is null and all its
    rows are kept (nothing tells them apart). Repeated rows of the winning id are all kept and all
    counted. An empty table gives an empty result; other columns are ignored.
    """
    groups = equal_groups(docs, id_col, text_col).select(
        F.unhex(F.sha2("text", 256)).alias("sha"), F.col("hi" if keep == "largest" else "lo").alias("keep_id"), F.col("n").alias("group_size")
    )
    mine = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha")
    )
    return mine.join(groups, "sha").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
