"""Quality classifier: interpolated modified Kneser-Ney byte n-grams trained on trusted text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.storage import scratch

from . import texthash as th
from .tables import checked_broadcast, dropped, small_batches, stored

#: Bytes before a text begins, in the place of its context.
START = 0
#: Bytes of an n-gram.
ORDER = 5
#: One in so many trusted texts, by a hash of the text, is not trained on; thresholds come from these.
HELD_OUT = 2
#: Bytes of text that ask together for the probabilities of their distinct n-grams, and that are
#: compressed together.
PACK_BYTES, PART_BYTES = 32 << 20, 1 << 20
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_CODES = 1 << 21
#: Pseudo-bytes at the language's mean rate added to each text, so that a few odd letters in a
#: very short text don't reject it.
PRIOR_BYTES = 60
#: Share of a language's held-out texts that its threshold accepts, and the margin in nats a byte.
ACCEPT, MARGIN = 0.999, 0.02
#: The highest of few texts lies below what others reach; the threshold is raised by so many times its distance
#: from the mean, divided by the root of their number.
SHORTFALL = 5.0
#: Trusted texts of a language as many as these give its own mean and limit the same weight as those of
#: all languages together.
PRIOR_TRUSTED = 5
#: Nats a byte are binned this finely for quantiles.
BINS = 1000


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """N-gram code of every byte: itself and the order - 1 bytes before it, START before a text."""
    size = np.diff(offsets)
    into = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    code = data.astype(np.int64)
    for k in range(1, order):
        before = np.full(len(data), START, np.int64)
        before[k:] = data[: len(data) - k]
        before[into < k] = START
        code |= before << np.int64(8 * k)
    return code


def _count(order: int) -> Callable:
    """Counts of a task's n-grams, summed over its batches."""

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = th.text_bytes(batch.column(0))
            for i, j in th.slices(offsets):
                new, n = np.unique(_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order), return_counts=True)
                code, at = np.unique(np.concatenate([code, new]), return_inverse=True)
                count = np.bincount(at, weights=np.concatenate([count, n]), minlength=len(code)).astype(np.int64)
                if len(code) > HELD_CODES:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "c"])
                    code, count = code[:0], count[:0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "c"])

    return run


def _discount(table: DataFrame) -> Column:
    """Modified Kneser-Ney discount of a count c, from the counts of counts."""
    k = [0] * 5
    for row in table.where("c between 1 and 4").groupBy("c").count().collect():  # four rows at most
        k[row["c"]] = row["count"]
    y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
    d = [min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.05), i - 0.05) if k[i] else 0.5 * i for i in (1, 2, 3)]
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _low(n: int) -> str:
    """The n-gram code without its first byte."""
    return f"code & {(1 << 8 * (n - 1)) - 1}L"


def train(trusted: DataFrame, text_col: str = "text", order: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    """Levels 1 .. order of the model: (code, p) of the n-grams seen, (context, gamma) of the contexts seen.

    Counts come per task, then by n-gram shards; lower orders count distinct left neighbours
    (continuations); the joins are by n-gram and context. The tables grow with the text.
    """
    small_batches(trusted.sparkSession)
    raw = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count(order), "code long, c long")
    grams = {order: stored(raw.groupBy("code").agg(F.sum("c").alias("c")), "grams")}
    for n in range(order, 1, -1):
        grams[n - 1] = stored(grams[n].groupBy(F.expr(_low(n)).alias("code")).agg(F.count("*").alias("c")), "grams")
    levels = []
    for n in range(1, order + 1):
        table = grams[n].select("code", "c", F.expr("shiftright(code, 8) context"), _discount(grams[n]).alias("d"))
        left = table.groupBy("context").agg(F.sum("c").alias("all"), (F.sum("d") / F.sum("c")).alias("gamma"))
        share = table.join(left, "context")
        if n == 1:
            p = share.select("code", ((F.col("c") - F.col("d")) / F.col("all") + F.col("gamma") / 256).alias("p"))
        else:
            below = levels[-1][0].select(F.col("code").alias("low"), F.col("p").alias("q"))
            p = share.withColumn("low", F.expr(_low(n))).join(below, "low").selectExpr("code", "(c - d) / all + gamma * q p")
        levels.append((stored(p, "level"), stored(left.select("context", "gamma"), "gamma")))
    dropped(*grams.values())
    return levels


def _resolve(need: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(code, p) of distinct n-grams (code), backed off to lower orders where not seen."""
    if not model:
        return need.select("code", F.lit(1 / 256).alias("p"))
    p, gamma = model[-1]
    got = stored(need.join(p, "code", "left"), "found")
    rest = got.where("p is null").select("code", F.expr("shiftright(code, 8) context"), F.expr(f"{_low(len(model))} low"))
    below = _resolve(rest.select(F.col("low").alias("code")).distinct(), model[:-1])
    rest = rest.join(below.select(F.col("code").alias("low"), F.col("p").alias("q")), "low").join(gamma, "context", "left")
    return got.where("p is not null").unionByName(rest.select("code", (F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p")))


def _pack(order: int) -> Callable:
    """Rows, text last, as compressed parts of packs, and the distinct n-grams of each pack. A pack is what one
    task reads, or PACK_BYTES of it; a longer text stands alone."""

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, size, code = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)
        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))

        def out(blob: bytes | None, codes: np.ndarray | None) -> pa.RecordBatch:
            lists = pa.array([codes], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([blob], pa.binary()), lists], ["pack", "blob", "codes"])

        for batch in batches:
            data, offsets = th.text_bytes(batch.column(batch.num_columns - 1))
            for i, j in th.slices(offsets, PART_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=how) as writer:
                    writer.write_batch(batch.slice(i, j - i))
                yield out(sink.getvalue().to_pybytes(), None)
                code = np.union1d(code, _codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order))
                size += int(offsets[j] - offsets[i])
                if size >= PACK_BYTES:
                    yield out(None, code)
                    pack, size, code = pack + 1, 0, code[:0]
        if size:
            yield out(None, code)

    return run


def _score(order: int) -> Callable:
    """Of one pack: its rows with the cost of their text instead of it."""

    def scored(packs: pa.Table, probabilities: pa.Table) -> pa.Table:
        code, p = (np.asarray(probabilities.column(c).combine_chunks()) for c in ("code", "p"))
        by = np.argsort(code)
        code, cost = code[by], -np.log(p[by].astype(np.float64))
        parts = []
        for blob in packs.column("blob"):
            rows = pa.ipc.open_stream(blob.as_py()).read_all()
            data, offsets = th.text_bytes(rows.column(rows.num_columns - 1).combine_chunks())
            here = cost[np.searchsorted(code, _codes(data, offsets, order))] if len(data) else np.zeros(0)
            v = np.concatenate([[0.0], np.cumsum(here)])
            nll = np.round(v[offsets[1:]] - v[offsets[:-1]], 6)
            rows = rows.drop_columns(rows.column_names[-1:])
            parts.append(rows.append_column("nll", pa.array(nll)).append_column("n_bytes", pa.array(np.diff(offsets), pa.int64())))
        return pa.concat_tables(parts)

    def run(packs: pa.Table, probabilities: pa.Table) -> pa.Table:
        out = scored(packs, probabilities)
        th.released()  # once its arrays are free
        return out

    return run


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, nll (nats of the whole text) and n_bytes of every row; written before it returns.

    Texts stay with their task: each compresses them into packs, which are written once, bucketed by
    pack, and asks for the packs' distinct n-grams. These are looked up by shards; the answers go to
    the packs' buckets, so no text is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"voxelweave_packs_{uuid.uuid4().hex}"
    made = rows.mapInArrow(_pack(len(model)), "pack long, blob binary, codes array<long>")
    made.write.bucketBy(n, "pack").option("path", f"{scratch(spark)}/{name}").saveAsTable(name)
    packs = spark.table(name)
    asked = packs.where("codes is not null").select("pack", F.explode("codes").alias("code"))
    known = _resolve(asked.select("code").distinct(), model)
    answers = asked.join(known, "code").select(F.col("pack").alias("of"), "code", F.col("p").cast("float").alias("p"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    texts = packs.where("blob is not null").select("pack", "blob")
    out = stored(texts.groupBy("pack").cogroup(answers.groupBy("of")).applyInArrow(_score(len(model)), f"{schema}, nll double, n_bytes long"), "scores")
    dropped(packs)
    spark.sql(f"DROP TABLE {name}")
    return out


def _blend(own: Column, every: Column) -> Column:
    return (F.col("docs") * own + PRIOR_TRUSTED * every) / (F.col("docs") + PRIOR_TRUSTED)


def _thresholds(scored: DataFrame) -> DataFrame:
    """(lang, mean, limit) from scored trusted rows: mean nats a byte, and the ACCEPT quantile of
    the smoothed rate plus MARGIN and what SHORTFALL adds. lang null stands for all languages together; each language's
    values are blended with those, which count as PRIOR_TRUSTED texts."""
    per = scored.groupBy("lang").agg(F.sum("nll").alias("s"), F.sum("n_bytes").alias("b"), F.count("*").alias("docs"))
    rate = F.col("s") / F.nullif(F.col("b"), F.lit(0))
    every = per.agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("docs").alias("docs")).where("docs > 0").select("docs", F.coalesce(rate, F.lit(0.0)).alias("mean0"))
    own = per.where("lang is not null").join(F.broadcast(every.select("mean0")), F.lit(True))
    mean = own.select("lang", "docs", _blend(F.coalesce(rate, "mean0"), F.col("mean0")).alias("mean")).unionByName(
        every.select(F.lit(None).cast("string").alias("lang"), "docs", F.col("mean0").alias("mean"))
    )
    mean = stored(mean, "means")
    rows = scored.where("lang is not null").select("lang", "nll", "n_bytes").unionByName(scored.select(F.lit(None).cast("string").alias("lang"), "nll", "n_bytes"))
    rate = rows.join(F.broadcast(mean), rows.lang.eqNullSafe(mean.lang)).select(
        rows.lang, "docs", "mean", F.ceil((F.col("nll") + PRIOR_BYTES * F.col("mean")) / (F.col("n_bytes") + PRIOR_BYTES) * BINS).alias("bin")
    )
    bins = rate.groupBy("lang", "docs", "mean", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("bin")
    run = bins.select("*", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy("lang")).alias("all"))
    at = F.min("bin") / BINS
    raised = at + MARGIN + SHORTFALL * F.greatest(at - F.col("mean"), F.lit(0.0)) / F.sqrt("docs")
    limit = run.where(F.col("upto") >= F.col("all") * ACCEPT).groupBy("lang", "docs", "mean").agg(raised.alias("limit"))
    limit = stored(limit, "blend")
    all_limit = limit.where("lang is null").select(F.col("limit").alias("limit0"))
    blended = F.when(F.col("lang").isNull(), F.col("limit")).otherwise(_blend(F.col("limit"), F.col("limit0")))
    return limit.join(F.broadcast(all_limit), F.lit(True)).select("lang", "mean", blended.alias("limit"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) and the carry columns for every row of docs.

    Trusted text: documents that labels marks with quality 1. perplexity is per byte, smoothed by
    PRIOR_BYTES at the language's mean rate. One in HELD_OUT trusted texts, by a hash of the text, is not
    trained on; the thresholds are quantiles of these, so that they hold for texts that the model has
    not seen. A document is kept if it is at most the threshold of its language, which is blended with the
    overall one the more the fewer held-out texts the language has; a null language, or one without
    any, has the overall threshold. Null and empty texts have the mean rate of their language and are
    kept. Without any held-out text everything is kept (threshold null). Repeated rows are
    scored alike; a label repeated for a document counts once; an empty table gives an empty result.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    good = checked_broadcast(stored(good, "trusted"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), *carry, F.col(text_col).alias("_text"))
    fold = F.pmod(F.xxhash64(F.coalesce("_text", F.lit(""))), F.lit(HELD_OUT)).cast("int")
    slim = slim.join(good, slim["doc_id"] == good["_good"], "left").withColumn("_fold", F.when(F.col("_good").isNotNull(), fold)).drop("_good")
    model = train(slim.where("_fold > 0"), "_text", order=ORDER)
    scored = score(slim, model, "_text", keep=("doc_id", "lang", *carry, "_fold"))
    limits = stored(_thresholds(scored.where("_fold = 0")), "limits")
    for level in model:
        dropped(*level)
    own = limits.where("lang is not null").select(F.col("lang").alias("_lang"), F.col("mean").alias("_mean"), F.col("limit").alias("_limit"))
    every = limits.where("lang is null").select(F.col("mean").alias("_mean0"), F.col("limit").alias("_limit0"))
    out = scored.join(checked_broadcast(own), F.col("lang") == F.col("_lang"), "left").join(F.broadcast(every), F.lit(True), "left")
    mean, limit = F.coalesce("_mean", "_mean0", F.lit(0.0)), F.coalesce("_limit", "_limit0")
    rate = (F.col("nll") + PRIOR_BYTES * mean) / (F.col("n_bytes") + PRIOR_BYTES)
    return out.select(
        "doc_id", "lang", *carry, F.exp(rate).alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(rate <= limit, F.lit(True)).alias("kept")
    )
