"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .tables import checked_broadcast, small_batches, stored

U = np.uint64


@dataclass(frozen=True)
class Ftrl:
    """bits: log2 of the weight table. alpha, beta: per-coordinate rates; l1, l2: penalties.
    rows: labelled documents of each label learned from at most, those of least hashed id. trials: values of l1, of
    which inner folds of the learned rows choose one; false: share of their clean documents that may score
    0.5 or more when they are held out, which sets the constant. Without trials l1 and the constant stay."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 5
    rows: int = 6000
    trials: tuple[float, ...] = (4.0, 8.0, 16.0)
    folds: int = 3
    false: float = 0.005


def features(words: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the n-grams of all texts in a row, features in each text): words, pairs of
    neighbours, pairs with one word between, a constant; repeats included."""
    n = len(words)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(ends, counts)
    at = np.arange(n)
    slots, owner = [words], [doc]
    for gap, salt in ((1, 0x1F123BB5), (2, 0x6C8E9CF5)):
        ok = at + gap < stop
        left = at[ok]
        slots.append(th.mix(words[left] * U(3) + words[left + gap] * U(0x9E3779B97F4A7C15) + U(salt)))
        owner.append(doc[left])
    slot = (np.concatenate(slots) >> U(64 - bits)).astype(np.int64)
    return slot, np.concatenate(owner)


def _slots(bits: int) -> Callable:
    """Distinct feature slots of each text, in order."""

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = th.text_bytes(batch.column("text"))
            parts, ends = [np.zeros(0, np.int32)], [0]
            for i, j in th.slices(offsets):
                words, counts = th.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], punctuation=True)
                slot, owner = features(words, counts, bits)
                code = np.unique(owner << bits | slot)
                ends += (ends[-1] + np.searchsorted(code >> bits, np.arange(1, j - i + 1))).tolist()
                parts.append((code & ((1 << bits) - 1)).astype(np.int32))
            slots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), slots], ["doc_id", "toxic", "slots"])

    return run


def _fit(docs: list[np.ndarray], labels: list[int], cfg: Ftrl) -> np.ndarray:
    """Weights by FTRL-proximal over the rows in order, epochs times, each time in another fixed order."""
    size = (1 << cfg.bits) + 1  # the last is the constant
    z, n = np.zeros(size), np.zeros(size)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= cfg.l1, 0.0, (np.sign(z) * cfg.l1 - z) / ((cfg.beta + np.sqrt(n)) / cfg.alpha + cfg.l2))

    rng = np.random.default_rng(7)
    for _ in range(cfg.epochs):
        for d in rng.permutation(len(docs)):
            x = np.append(docs[d], size - 1)
            zi, ni = z[x], n[x]
            wi = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -30, 30))) - labels[d]
            z[x] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / cfg.alpha * wi
            n[x] += g * g
    return weights(z, n)


def _train(cfg: Ftrl, shift: float = 0.0) -> Callable:
    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels = [], []
        for batch in batches:
            labels += batch.column("toxic").to_pylist()
            docs += [x.values.to_numpy() for x in batch.column("slots")]
        w = _fit(docs, labels, cfg)
        w[-1] += shift
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["slot", "weight"])

    return run


def _trial(cfg: Ftrl) -> Callable:
    """Scores of one fold by weights of the others, with one penalty."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("o", "ascending")]).combine_chunks()
        number = rows["trial"][0].as_py()
        penalty, fold = divmod(number, cfg.folds)
        held = np.asarray(rows["fold"]) == fold
        docs = [x.values.to_numpy() for x in rows["slots"].chunk(0)]
        labels = rows["toxic"].to_pylist()
        w = _fit([d for d, h in zip(docs, held) if not h], [y for y, h in zip(labels, held) if not h], replace(cfg, l1=cfg.trials[penalty]))
        logit = [float(w[d].sum() + w[-1]) for d, h in zip(docs, held) if h]
        return pa.table({"penalty": pa.array([penalty] * len(logit), pa.int32()), "toxic": pa.array([y for y, h in zip(labels, held) if h], pa.int32()), "logit": pa.array(logit, pa.float64())})

    return run


def _chosen(tried: pa.Table, cfg: Ftrl) -> tuple[Ftrl, float]:
    """(cfg with the penalty that finds most toxic rows while it flags at most cfg.false of the clean ones, the first of
    equals; what its constant gains for that)."""
    best: tuple[float, int, float] | None = None
    penalty, toxic, logit = (np.asarray(tried[c]) for c in ("penalty", "toxic", "logit"))
    for p in range(len(cfg.trials)):
        clean, bad = np.sort(logit[(penalty == p) & (toxic == 0)])[::-1], logit[(penalty == p) & (toxic == 1)]
        if not len(clean) or not len(bad):
            continue
        allowed = int(cfg.false * len(clean))
        limit = clean[allowed] if allowed < len(clean) else clean[-1]  # scores above this one flag `allowed` clean rows
        above = bad[bad > limit]
        # no clean row more than these toxic ones need
        middle = (clean[clean < above.min()].max(initial=above.min() - 1) + above.min()) / 2 if len(above) else limit
        found = (float(np.mean(bad > middle)), -p, float(-middle))
        best = found if best is None or found[:2] > best[:2] else best
    return (cfg, 0.0) if best is None else (replace(cfg, l1=cfg.trials[-best[1]]), best[2])


def train(docs: DataFrame, labels: DataFrame, cfg: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, weight): the non-zero weights, learned from cfg.rows documents of each label at most. labels:
    (doc_id, toxic), already without held-out rows.

    Features are made where the texts are; one task learns from their slots, at most 2**bits of a
    document. Before, each fold of these rows is scored by weights learned from the other folds, one task for each
    fold and penalty; these scores choose the penalty and the constant. Rows that repeat an id are all learned from, in the order of a hash of their slots.
    """
    small_batches(docs.sparkSession)
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = stored(y.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("h")), "labels")
    all_ = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}  # two rows
    some = None
    for k, n in sorted(all_.items()):
        # about twice as many as wanted pass the filter, so a task sends a few rows only
        one = y.where((F.col("toxic") == k) & (F.col("h") < int(min(1.0, (2 * cfg.rows + 1000) / n) * (1 << 32)))).orderBy("h", "doc_id").limit(cfg.rows)
        some = one if some is None else some.unionByName(one)
    some = y.limit(0) if some is None else some
    picked = F.broadcast(stored(some.select(F.col("doc_id").alias("_id"), "toxic"), "labelled"))  # 2 * cfg.rows rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(picked, F.col("doc_id") == F.col("_id"))
    slots = stored(rows.select("doc_id", "toxic", "text").mapInArrow(_slots(cfg.bits), "doc_id long, toxic int, slots array<int>"), "sample")
    shift = 0.0
    if cfg.trials:
        fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(cfg.folds)).cast("int")
        trial = F.explode(F.sequence(F.lit(0), F.lit(len(cfg.trials) * cfg.folds - 1)))
        rows = slots.select("doc_id", "toxic", "slots", F.xxhash64("slots").alias("o"), fold.alias("fold"), trial.alias("trial"))
        tried = rows.groupBy("trial").applyInArrow(_trial(cfg), "penalty int, toxic int, logit double")
        cfg, shift = _chosen(tried.toArrow(), cfg)  # a few numbers for each of 2 * cfg.rows documents
    one = slots.coalesce(1).sortWithinPartitions("doc_id", F.xxhash64("slots"))  # 2 * cfg.rows documents
    return one.mapInArrow(_train(cfg, shift), "slot long, weight double")


def _score(weights, bits: int) -> Callable:
    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1, np.float32)
        w[weights.value[0]] = weights.value[1]
        for batch in batches:
            data, offsets = th.text_bytes(batch.column(1))
            out = np.empty(batch.num_rows)
            for i, j in th.slices(offsets):
                words, counts = th.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], punctuation=True)
                slot, owner = features(words, counts, bits)
                hit = w[slot] != 0
                code = np.unique(owner[hit] << bits | slot[hit])  # a feature counts once in a text
                total = np.bincount(code >> bits, weights=w[code & ((1 << bits) - 1)], minlength=j - i)
                out[i:j] = 1 / (1 + np.exp(-np.clip(total + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(out, 9))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: DataFrame, cfg: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1 for the whole text.

    A null or empty text gets the score of the constant alone. Rows are independent of each other;
    a null id stays null; other columns are ignored; an empty table gives an empty result. Without
    any labelled rows all scores are 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    got = weights.toArrow()  # at most 2**bits + 1 rows
    shared = spark.sparkContext.broadcast((got.column(0).to_numpy(), got.column(1).to_numpy().astype(np.float32)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared, cfg.bits), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
