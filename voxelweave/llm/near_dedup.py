"""Near-duplicate documents: HyperMinHash registers, banding, estimate, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.linking import reachable

from . import texthash as th
from .tables import checked_broadcast, dropped, small_batches, stored

U = np.uint64


@dataclass(frozen=True)
class HyperMinHash:
    """2**p registers, each the leading-zero count (6 bits) and first r bits after the leading one
    of the least hash in its slot; `bands` bands of consecutive registers.

    With 128 registers in 32 bands of 4, a pair at similarity 0.75 shares no band with
    probability (1 - 0.75**4)**32 = 5e-6.
    """

    p: int = 7
    r: int = 10
    bands: int = 32
    percent: int = 75
    #: Pairs whose corrected estimate is lower than the threshold by more standard errors than this
    #: are not verified.
    errors: float = 4.7

    @property
    def registers(self) -> int:
        return 1 << self.p


@cache
def _orders(n: int) -> np.ndarray:
    """Row i: the place of each slot in the random order of slot i."""
    rng = np.random.default_rng(31)
    return np.stack([rng.permutation(n) for _ in range(n)]).astype(np.int16)


def _registers(hashes: np.ndarray, cfg: HyperMinHash) -> np.ndarray:
    """Registers of one document from its sorted distinct shingle hashes (all 0 without any).

    An empty slot takes over the register of the first filled slot in a fixed random order of its
    own, so that each register of a short text, too, agrees with another's with the probability
    of their similarity, and no band rests on one shingle alone.
    """
    out = np.zeros(cfg.registers, np.uint16)
    if len(hashes):
        slot = (hashes >> U(64 - cfg.p)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rest = (hashes[first] << U(cfg.p)) | U((1 << cfg.p) - 1)
        _, exponent = np.frexp(rest.astype(np.float64))
        zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
        # a float may round up to the next power of two
        zeros = np.where((rest << zeros) >> U(63) == 0, zeros + U(1), zeros)
        mantissa = (rest << zeros << U(1)) >> U(64 - cfg.r)
        filled = slot[first]
        out[filled] = ((zeros + U(1)) << U(cfg.r) | mantissa).astype(np.uint16)
        empty = np.flatnonzero(out == 0)
        if len(empty):
            order = _orders(cfg.registers)[empty[:, None], filled[None, :]]
            out[empty] = out[filled[order.argmin(axis=1)]]
    return out


def _documents(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for i, j in th.slices(offsets):
        words, counts = th.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        shingles, per = th.shingle_hashes(words, counts)
        ends = np.cumsum(per)
        for a, b in zip(ends - per, ends):
            yield np.unique(shingles[a:b])


def _sketch(cfg: HyperMinHash) -> Callable:
    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, regs = [], [], [], []
            for h in _documents(*th.text_bytes(batch.column(1))):
                n.append(len(h))
                d1.append(int(th.mix(h * U(3) + U(1)).sum().astype(np.int64)) if len(h) else 0)
                d2.append(int(th.mix(h ^ U(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(h) else 0)
                regs.append(_registers(h, cfg).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "n", "d1", "d2", "regs"],
            )

    return run


def _sets(cfg: HyperMinHash) -> Callable:
    """Registers and sorted shingle hashes of each text."""

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_documents(*th.text_bytes(batch.column(1))))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            regs = pa.array([_registers(s, cfg).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), regs, lists], ["doc_id", "regs", "s"])

    return run


def _band_keys(regs: np.ndarray, cfg: HyperMinHash) -> np.ndarray:
    """64-bit key of each band of register rows (document, band, register)."""
    weight = th.mix(np.arange(1, regs.shape[2] + 1, dtype=np.uint64)) | U(1)
    return th.mix((regs.astype(np.uint64) * weight).sum(axis=2) + th.mix(np.arange(cfg.bands, dtype=np.uint64))[None, :])


def _bands(cfg: HyperMinHash) -> Callable:
    """One row per non-empty band of rows (doc_id, n, regs): its key."""

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, cfg.bands, -1)
            key, full = _band_keys(regs, cfg), regs.any(axis=2)
            doc, n = (np.repeat(np.asarray(batch.column(c)), full.sum(axis=1)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key[full].view(np.int64)), pa.array(doc), pa.array(n)], ["key", "doc_id", "n"])

    return run


def _corrected(same: np.ndarray, cfg: HyperMinHash) -> np.ndarray:
    """Two unequal minima share a register with probability of about 2**-r / 3 (equal zero counts,
    equal mantissas)."""
    chance = 2.0**-cfg.r / 3
    return np.clip((same - chance) / (1 - chance), 0, 1)


def estimate(a: np.ndarray, b: np.ndarray, cfg: HyperMinHash) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for accidental equality."""
    used = (a > 0) | (b > 0)
    return _corrected(((a == b) & used).sum(axis=-1) / np.maximum(used.sum(axis=-1), 1), cfg)


def possible(similarity: np.ndarray, least: np.ndarray, cfg: HyperMinHash) -> np.ndarray:
    """Whether an estimate leaves a link possible; least: size of the smaller set. The registers draw
    from the shingles, so both their numbers limit what an estimate can tell."""
    t = cfg.percent / 100
    return similarity >= t - cfg.errors * np.sqrt(t * (1 - t) * (1 / cfg.registers + 1 / np.maximum(least, 1)))


def _likely(cfg: HyperMinHash) -> Callable:
    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, cfg.registers) for c in ("ra", "rb"))
            ok = possible(estimate(a, b, cfg), np.asarray(batch.column("least")), cfg)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "nb")], ["a", "b", "nb"]).filter(pa.array(ok))

    return run


#: Members of a bucket and partners of one document whose pairs Spark may simply join; more go in blocks.
SMALL_BUCKET, SMALL_HUB = 16, 64
#: Bytes of shingle sets of a block of outliers and of a block of members.
OUTLIERS, MEMBERS = 4 << 20, 8 << 20


def _block_links(cfg: HyperMinHash) -> Callable:
    """Of one block of a bucket (or of one document and its partners, if there is no key): links between
    its outliers and its members, confirmed on the full sets; one joins two components, and their other
    pairs are then left out.

    Pairs that the estimate rules out are not verified, nor are those that share an earlier band: they
    meet in the bucket of that band. The likeliest are verified first.
    """

    def run(table: pa.Table) -> pa.Table:
        out = np.asarray(table.column("outlier").combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids, comp = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "comp"))
        sets = table.column("s").combine_chunks()
        flat, n = np.asarray(sets.flatten()), np.diff(np.asarray(sets.offsets).astype(np.int64))
        start = np.concatenate([[0], np.cumsum(n)])
        flat = np.unique(flat, return_inverse=True)[1]
        now = np.unique(comp, return_inverse=True)[1]
        banded = "regs" in table.column_names
        if banded:
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(len(ids), cfg.bands, -1)
            band = int((_band_keys(regs, cfg).view(np.int64) == table.column("key")[0].as_py()).any(axis=0).argmax())
        members = np.flatnonzero(~out)
        has = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
        a, b = [], []
        for x in np.flatnonzero(out):
            y = members[(now[members] != now[x]) & (100 * np.minimum(n[members], n[x]) >= cfg.percent * np.maximum(n[members], n[x]))]
            if banded and len(y):
                same = regs[y] == regs[x][None]
                e = _corrected(same.mean(axis=(1, 2)), cfg)
                ok = possible(e, np.minimum(n[y], n[x]), cfg) & ~same[:, :band].all(axis=2).any(axis=1)
                y = y[ok][np.argsort(-e[ok], kind="stable")]
            mine = flat[start[x] : start[x + 1]]
            has[mine] = True
            size = 16
            while len(y):
                some, y = y[:size], y[size:]
                shared = np.concatenate([[0], np.cumsum(has[flat[th.ragged(start[some], n[some])]])])[np.cumsum(n[some])]
                shared = np.diff(np.concatenate([[0], shared]))
                for k in some[100 * shared >= cfg.percent * (n[some] + n[x] - shared)]:
                    if now[k] != now[x]:
                        a.append(min(ids[k], ids[x]))
                        b.append(max(ids[k], ids[x]))
                        now[now == now[k]] = now[x]
                y = y[now[y] != now[x]]
                size *= 4
            has[mine] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, cfg: HyperMinHash) -> DataFrame:
    """The pairs (a, b) that are links by their full shingle sets. A document with very many partners is
    compared with them in blocks, so its set isn't copied for each."""
    r = nodes.select("doc_id", "n", "regs")
    likely = (
        pairs.join(r.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        .join(r.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * cfg.percent)
        .select("a", "b", "nb", "ra", "rb", F.least("na", "nb").alias("least"))
        .mapInArrow(_likely(cfg), "a long, b long, nb long")
    )
    likely = stored(likely, "likely")
    hubs = likely.groupBy("a").agg(F.count("*").alias("partners"), F.sum("nb").alias("n")).where(F.col("partners") > SMALL_HUB)
    hubs = stored(hubs.select("a", F.ceil(F.col("n") * 8 / MEMBERS).cast("long").alias("blocks")), "hubs")
    few = likely.join(checked_broadcast(hubs), "a", "left_anti")
    both = few.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    checked = both.select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("t"), shared.alias("i"))
    links = checked.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * cfg.percent).select("a", "b")
    if not hubs.isEmpty():
        partner = likely.join(checked_broadcast(hubs), "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.col("b").alias("doc_id"), F.lit(False).alias("outlier"))
        hub = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc_id"), F.lit(True).alias("outlier"))
        rows = partner.unionByName(hub).join(sets.drop("regs"), "doc_id").withColumn("comp", F.col("doc_id"))
        links = links.unionByName(rows.groupBy("a", "block").applyInArrow(_block_links(cfg), "a long, b long"))
    return links.distinct()


def _across(open_: DataFrame, nodes: DataFrame, sets: DataFrame, cfg: HyperMinHash) -> DataFrame:
    """Links (a, b) between the components of buckets that hold several: rows (key, doc_id, n, comp,
    outlier, size). Small buckets are joined with themselves, large ones compared in blocks of bounded
    bytes; each pair of different components that shares a band is looked at."""
    small = open_.where(F.col("size") <= SMALL_BUCKET).select("key", "doc_id", "comp")
    x, y = small.alias("x"), small.alias("y")
    near = x.join(y, F.expr("x.key = y.key and x.doc_id < y.doc_id and x.comp <> y.comp"))
    links = _verified(near.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), nodes, sets, cfg)
    large = open_.where(F.col("size") > SMALL_BUCKET)
    plan = large.groupBy("key").agg(
        F.ceil(F.sum(F.when(F.col("outlier"), F.col("n"))) * 8 / OUTLIERS).cast("long").alias("obs"), F.ceil(F.sum("n") * 8 / MEMBERS).cast("long").alias("mbs")
    )
    plan = stored(plan, "plan")
    if plan.isEmpty():
        return links
    large = large.join(checked_broadcast(plan), "key")
    all_ = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cols = ["key", "ob", "mb", "doc_id", "comp", "outlier"]
    o = large.where("outlier").withColumn("ob", F.pmod(F.xxhash64("doc_id"), "obs")).withColumn("mb", all_("mbs"))
    m = large.withColumn("mb", F.pmod(F.xxhash64("doc_id", F.lit(1)), "mbs")).withColumn("ob", all_("obs")).withColumn("outlier", F.lit(False))
    rows = o.select(*cols).unionByName(m.select(*cols)).join(sets, "doc_id")
    return links.unionByName(rows.groupBy("key", "ob", "mb").applyInArrow(_block_links(cfg), "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: HyperMinHash = HyperMinHash()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text's set holds its
    distinct runs of five words (its whole word sequence if it has fewer). Texts without words
    link with nothing. Texts with equal sets form one node. Nodes that share a band are candidates:
    first each with the smallest id of its bucket, then - where a bucket still holds several
    components - each member outside the largest one with all members of the others, in blocks that
    return links only. Links are confirmed on full sets, so only banding can miss a pair.

    A row with a null id stands alone (component_id null, kept). Rows that repeat an id belong to one
    document, whatever their texts; one of them without words stands alone. Long texts are hashed in
    chunks; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(texts.mapInArrow(_sketch(cfg), "doc_id long, n long, d1 long, d2 long, regs binary"), "sketch")
    usable = sketch.where("n > 0 and doc_id is not null")
    groups = usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("regs").alias("regs"))
    nodes = stored(groups.select("n", "d1", "d2", F.col("rep").alias("doc_id"), "regs"), "nodes")

    bands = nodes.select("doc_id", "n", "regs").mapInArrow(_bands(cfg), "key long, doc_id long, n long")
    buckets = bands.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("key", "first")
    members = stored(bands.join(buckets, "key"), "members")
    wanted = stored(members.select("doc_id").distinct(), "wanted")
    sets = texts.join(checked_broadcast(wanted), "doc_id", "left_semi").mapInArrow(_sets(cfg), "doc_id long, regs binary, s array<long>")
    sets = stored(sets, "sets")

    pairs = members.where("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    # an id with several texts links the nodes that stand for these
    several = usable.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    own = usable.join(several, "doc_id").join(nodes.select("n", "d1", "d2", F.col("doc_id").alias("rep")), ["n", "d1", "d2"])
    links = _verified(pairs, nodes, sets, cfg).unionByName(own.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    links = stored(links, "links")
    comp = stored(reachable(links), "labels")
    labelled = members.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("size"), F.count("*").alias("parts"))
    open_ = labelled.join(mixed.where("parts > 1 and size > 2"), "key")
    open_ = stored(open_.select("key", "doc_id", "n", "comp", (F.col("comp") != F.col("main")).alias("outlier"), "size"), "open")
    dropped(members)
    if not open_.isEmpty():
        new = stored(_across(open_, nodes, sets, cfg), "links")
        if not new.isEmpty():
            comp = stored(reachable(links.unionByName(new)), "labels")
    dropped(sets, wanted, open_, links)
    label = nodes.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("n", "d1", "d2", F.coalesce("component", "doc_id").alias("component_id"))
    root = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = sketch.join(label, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
