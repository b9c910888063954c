"""Removal of repeated byte strings across documents.

Sorting every suffix externally writes many bytes per byte of text. Only strings of at least LENGTH
bytes matter here, so - as in the reduction step of induced sorting - a sample of suffixes stands for
all: the leftmost least k-gram of each LENGTH-byte string. Equal strings have equal samples at equal
distances, so the samples' sorted tuples (name of the k-gram, distance to the string's start, digest
of the string) bring equal strings together; Spark's spilling sorts and aggregates are the
disk-backed queues. Whole runs of strings that share a sample are named first, and only runs that
differ are induced further: in blocks of strings, then string by string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .tables import checked_broadcast, dropped, is_small, small_batches, stored

U = np.uint64
LENGTH = 400
#: Bytes of the k-grams that are sampled.
GRAM = 32
#: Neighbouring strings named together, level by level.
BLOCKS = (64, 8, 1)
#: String starts looked at in one go; positions must fit the low 20 bits of a packed hash.
SEGMENT = 1 << 19


def _samples(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first start, last start, sample position, name) of every run of strings that share
    a sample; positions count from the start of data."""
    n, width = len(data), length - GRAM + 1
    last = np.repeat(offsets[1:] - length, np.diff(offsets))  # last start in the position's document
    for at in range(0, max(n - length + 1, 0), SEGMENT):
        end = min(at + SEGMENT + length - 1, n)
        b = data[at:end]
        power, inverse = th._power_tables(len(b) + 1)
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(th._BYTE[b] * power[: len(b)], out=total[1:])
        grams = len(b) - GRAM + 1
        h = th.mix((total[GRAM:] - total[:grams]) * inverse[:grams])
        packed = (h & ~U((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
        least, span = packed, 1
        while span * 2 <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        starts = grams - width + 1
        least = np.minimum(least[:starts], least[width - span : width - span + starts])
        p = np.flatnonzero(np.arange(at, at + starts) <= last[at : at + starts])
        if not len(p):
            continue
        sample = (least[p] & U((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (p[1:] != p[:-1] + 1)]))
        stop = np.concatenate([new[1:], [len(p)]]) - 1
        name = h[sample[new]]
        doc = np.searchsorted(offsets, p[new] + at, "right") - 1
        yield doc, p[new] + at, p[stop] + at, sample[new] + at, name


def _digests(view: memoryview, first: list[int], end: list[int]) -> np.ndarray:
    """128-bit digests of view[first:end] as rows of two integers."""
    out = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first, end)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _runs(length: int) -> Callable:
    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = th.text_bytes(batch.column("text"))
            key = [np.asarray(batch.column(c)) for c in ("t1", "t2")]
            for i, j in th.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                view = memoryview(part)
                for doc, lo, hi, pos, name in _samples(part, at, length):
                    s = _digests(view, lo.tolist(), (hi + length).tolist())
                    base = at[doc]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[0][i + doc]), pa.array(key[1][i + doc]), pa.array(pos - base), pa.array(pos - hi), pa.array(pos - lo),
                            pa.array(name.view(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1]),
                        ],
                        ["t1", "t2", "pos", "dmin", "dmax", "name", "s1", "s2"],
                    )

    return run


def _blocks(length: int, block: int) -> Callable:
    """Digest of each aligned block of `block` distances of each run in the rows' lists, and of the
    core: the bytes that all strings of the block hold. Strings of two blocks can only be equal if
    the cores are."""

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column("text"), batch.column("runs")
            t1, t2 = (batch.column(c).to_pylist() for c in ("t1", "t2"))
            for k in range(batch.num_rows):
                view = memoryview((texts[k].as_py() or "").encode())
                r = runs[k].values
                pos, dmin, dmax, name = (np.asarray(r.field(c)) for c in ("pos", "dmin", "dmax", "name"))
                multi = r.field("multi").to_numpy(zero_copy_only=False)
                low = dmin // block
                n = dmax // block - low + 1
                which = np.repeat(np.arange(len(pos)), n)
                number = th.ragged(low, n)
                lo, hi = np.maximum(number * block, dmin[which]), np.minimum(number * block + block - 1, dmax[which])
                at = pos[which]
                s = _digests(view, (at - hi).tolist(), (at - lo + length).tolist())
                core = _digests(view, (at - number * block).tolist(), (at - number * block - block + 1 + length).tolist()) if block > 1 else s
                g = th.mix(core[:, 0].view(np.uint64) ^ th.mix(name[which].view(np.uint64) + number.astype(np.uint64)))
                m = len(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, t1[k])), pa.array(np.full(m, t2[k])), pa.array(at), pa.array(lo), pa.array(hi), pa.array(name[which]),
                        pa.array(g.view(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(multi[which]),
                    ],
                    ["t1", "t2", "pos", "dmin", "dmax", "name", "g", "s1", "s2", "multi"],
                )

    return run


RUN = "t1 long, t2 long, pos long, dmin long, dmax long, name long, s1 long, s2 long"


def _resolved(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Of runs with column multi (others elsewhere equal this one and are settled): (ranges of
    repeated strings, one run of each class whose group holds several classes).

    Rows may repeat: a class is repeated if its smallest and largest place differ.
    """
    keys = [group, "dmin", "dmax", "s1", "s2"]
    place = F.xxhash64("t1", "t2", "pos")
    classes = rows.groupBy(*keys).agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("multi").alias("m"))
    classes = stored(classes, "classes")
    kinds = stored(classes.groupBy(group).agg(F.count("*").alias("kinds")).where("kinds > 1").select(group, F.lit(True).alias("open")), "kinds")
    useful = stored(classes.join(checked_broadcast(kinds), group, "left").where("p <> q or open"), "useful")
    # both sides are written, so Spark can split a class that very many texts hold
    both = stored(rows.join(checked_broadcast(useful), keys).select(*rows.columns, "p", "q", "m", "open", place.alias("here")), "both")
    dropped(classes, kinds, useful)
    ranges = both.where("p <> q and not multi").select("t1", "t2", (F.col("pos") - F.col("dmax")).alias("lo"), (F.col("pos") - F.col("dmin")).alias("hi"))
    one = both.where("open and here = p").select("name", "t1", "t2", "pos", "dmin", "dmax", (F.col("m") | (F.col("p") != F.col("q"))).alias("multi"))
    return ranges, one.distinct()


def _finer(docs: DataFrame, runs: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of the given runs, read off their texts."""
    lists = stored(runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "dmin", "dmax", "name", "multi")).alias("runs")), "lists")
    keys = lists.select("t1", "t2")
    some = docs.join(F.broadcast(keys), ["t1", "t2"], "left_semi") if is_small(keys) else docs
    rows = some.join(lists, ["t1", "t2"]).select("t1", "t2", "text", "runs")
    return stored(
        rows.mapInArrow(
            _blocks(length, block), "t1 long, t2 long, pos long, dmin long, dmax long, name long, g long, s1 long, s2 long, multi boolean"
        ),
        "blocks",
    )


def _cut(length: int) -> Callable:
    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = th.text_bytes(batch.column("text"))
            copied = batch.column("copied").to_pylist()
            ranges = batch.column("ranges")
            kept, spans = [], []
            for k in range(batch.num_rows):
                raw, n = data[offsets[k] : offsets[k + 1]], int(offsets[k + 1] - offsets[k])
                mine: list[dict] = []
                if copied[k] and n >= length:
                    mine = [{"first": 0, "end": n}]
                elif ranges.is_valid()[k].as_py():
                    v = ranges[k].values
                    lo, hi = np.asarray(v.field("lo")), np.asarray(v.field("hi")) + length
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                    stop = np.concatenate([new[1:], [len(lo)]]) - 1
                    mine = [{"first": a, "end": b} for a, b in zip(lo[new].tolist(), hi[stop].tolist())]
                if mine:
                    edges = [0, *[x for s in mine for x in (s["first"], s["end"])], n]
                    kept.append(b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                else:
                    kept.append(raw.tobytes())
                spans.append(mine)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: spans are the maximal byte runs covered by
    `length`-byte strings that also start elsewhere, in the same or another document; kept holds the
    other bytes.

    Texts count as UTF-8 bytes (null: empty); shorter ones keep all. Equal texts are found first:
    all their bytes repeat, and one of them is searched for all. Strings are compared by 128-bit digests. Rows
    need no distinct ids; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    half = lambda i: F.conv(F.hex(F.substring(digest, i, 8)), 16, -10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("*", half(1).alias("t1"), half(9).alias("t2"))
    long_ = rows.where(F.octet_length("text") >= length)
    copied = stored(long_.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2", F.lit(True).alias("copied")), "copied")

    # one of equal texts stands for all
    again = checked_broadcast(copied.select("t1", "t2"))
    one = long_.join(again, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = long_.join(again, ["t1", "t2"], "left_anti").select("t1", "t2", "text").unionByName(stored(one, "texts"))

    runs = stored(texts.mapInArrow(_runs(length), RUN), "runs")
    place = F.xxhash64("t1", "t2", "pos")
    names = stored(runs.groupBy("name").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p <> q").select("name"), "names")
    level = stored(runs.join(checked_broadcast(names), "name").select(*runs.columns, F.lit(False).alias("multi")), "shared")
    dropped(runs)
    found, open_ = _resolved(level, "name")
    ranges = found
    for block in BLOCKS:
        found, open_ = _resolved(_finer(texts, open_, length, block), "g")
        ranges = ranges.unionByName(found)
    # a copied text is removed whole
    per = stored(
        ranges.distinct().join(copied, ["t1", "t2"], "left_anti").groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges"
    )
    marks = per.join(copied, ["t1", "t2"], "full")
    marks = stored(marks, "marks")
    keys = marks.select("t1", "t2")
    if is_small(keys):  # texts without a repeat stay where they are
        rest = rows.join(F.broadcast(keys), ["t1", "t2"], "left_anti").withColumn("copied", F.lit(None).cast("boolean"))
        rest = rest.withColumn("ranges", F.lit(None).cast(marks.schema["ranges"].dataType))
        some = rows.join(F.broadcast(keys), ["t1", "t2"], "left_semi").join(marks, ["t1", "t2"])
        out = some.unionByName(rest)
    else:
        out = rows.join(marks, ["t1", "t2"], "left")
    return out.select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "ranges").mapInArrow(
        _cut(length), f"doc_id {kind}, n_bytes long, spans array<struct<first:long,end:long>>, kept binary"
    )
