"""Hard-negative mining: windows of scores, with angles to reference directions to tell what can lie inside."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, stored
from .vectors import against, best_ids, block_count, collapsed, matrix, ranked, raw_vectors

#: Reference directions, chosen far apart among about SAMPLE vectors (by a hash).
REFERENCES = 8
SAMPLE = 4096
#: Widens every interval of an angle: far more than the error of an arc cosine in doubles.
SLACK = 1e-6
#: Rows whose quantised norm is larger take no part: 100 times a score of two of them may leave the long type.
LARGEST = 1 << 28
#: Norms whose products stay below this are multiplied in doubles without any rounding.
EXACT = 2.0**52


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(256 * x), -(2**31), 2**31 - 1).astype(np.int32)


def references(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Up to n unit vectors of the sample, each as far as possible from those before."""
    norm = np.sqrt(np.einsum("ij,ij->i", sample, sample))
    x = sample[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angle of every vector to every reference; 0 for a zero vector, whose scores are 0 at any angle."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.where(norm[:, None] > 0, np.arccos(np.clip(x @ refs.T / np.maximum(norm, 1)[:, None], -1, 1)), 0.0)


def _placed(refs: dict[int, np.ndarray]) -> Callable:
    """Adds norm, angles (REFERENCES of them; without references for a length: 0, with `blind`) and the nearest reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, theta, blind = np.zeros(len(batch)), np.zeros((len(batch), REFERENCES)), np.ones(len(batch), bool)
            for dim, (at, x) in matrix(batch.column("u"), np.int32).items():
                norm[at] = np.sqrt(np.einsum("ij,ij->i", x, x))
                r = refs.get(dim, np.zeros((0, dim)))
                if len(r):
                    theta[at] = angles(x, np.resize(r, (REFERENCES, dim)))
                    blind[at] = False
            ok = pa.array(norm < LARGEST)
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norm), pa.FixedSizeListArray.from_arrays(pa.array(theta.ravel()), REFERENCES).cast(pa.list_(pa.float64())), pa.array(blind)],
                [*batch.schema.names, "norm", "angles", "blind"],
            )
            yield out.filter(ok)

    return run


def _interval(own: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines that the angles to the references allow, by the triangle inequality on the sphere: (least, largest)."""
    low = np.abs(theirs - own).max(axis=1) - SLACK
    high = np.minimum(theirs + own, 2 * math.pi - theirs - own).min(axis=1) + SLACK
    return np.cos(np.minimum(high, math.pi)), np.cos(np.maximum(low, 0))


def _scores(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products of a with the rows of x."""
    return (x @ a).astype(np.int64) if most < EXACT else x.astype(np.int64) @ a.astype(np.int64)


class _Block:
    """Rows of one length in a block, sorted along each reference when first asked."""

    def __init__(self, rows: pa.Table, at: np.ndarray, x: np.ndarray) -> None:
        self.at, self.x = at, x
        self.label = np.asarray(rows["label"])[at]
        self.norm, self.blind = np.asarray(rows["norm"])[at], np.asarray(rows["blind"])[at]
        self.theta = np.asarray(rows["angles"].combine_chunks().flatten()).reshape(-1, REFERENCES)[at]
        self.lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def line(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        if r not in self.lines:
            order = np.argsort(self.theta[:, r], kind="stable")
            self.lines[r] = order, self.theta[order, r]
        return self.lines[r]

    def between(self, a: np.ndarray, theta: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): all rows with a score in [low, high], and maybe others. The anchor's nearest reference
        gives a window of the sorted angles, all references an interval of scores; the rows left are
        multiplied."""
        norm = math.sqrt(a @ a)
        some = np.arange(len(self.x))
        if norm > 0 and not self.blind.any():
            r = int(theta.argmin())
            order, line = self.line(r)
            longest, shortest = norm * self.norm.max(), norm * self.norm.min()
            # a score >= low needs a cosine >= low / (product of norms), so an angle of at most `far`
            far = math.pi if low == -math.inf or longest == 0 else math.acos(min(1.0, max(-1.0, (low - 1) / (longest if low > 1 else max(shortest, 1e-9)))))
            near = 0.0 if high == math.inf or high < 0 else math.acos(min(1.0, (high + 1) / max(shortest, 1e-9)))
            first = np.searchsorted(line, max(theta[r] - far, near - theta[r]) - SLACK, "left")
            last = np.searchsorted(line, theta[r] + far + SLACK, "right")
            some = order[first:last]
            least, most = _interval(theta, self.theta[some])
            size = norm * self.norm[some]
            some = some[(np.floor(size * least * (1 + np.sign(-least) * 1e-12)) - 1 <= high) & (np.ceil(size * most * (1 + np.sign(most) * 1e-12)) + 1 >= low)]
        if not len(some):
            return some, np.zeros(0, np.int64)
        return some, _scores(a, self.x[some], norm * float(self.norm[some].max()))


def _blocks(queries: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, _Block]]:
    """(positions of anchors, their vectors, their angles, block) for each length of vectors."""
    theirs = matrix(rows["u"], np.int32)
    theta = np.asarray(queries["angles"].combine_chunks().flatten()).reshape(-1, REFERENCES)
    for dim, (qa, q) in matrix(queries["u"], np.int32).items():
        if dim in theirs:
            yield qa, q, theta[qa], _Block(rows, *theirs[dim])


def _positives(k: int) -> Callable:
    """Each anchor's k best rows of its own label with a score of at least `least`."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, label, ids = np.asarray(queries["id"]), np.asarray(queries["label"]), rows["ids"].to_pylist()
        least = np.asarray(queries["least"])
        got: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for qa, q, theta, block in _blocks(queries, rows):
            for i, a, t in zip(qa, q, theta):
                some, score = block.between(a, t, least[i], math.inf)
                good = (block.label[some] == label[i]) & (score >= least[i])
                got.append(best_ids(np.full(good.sum(), i), score[good], block.at[some[good]], ids, own, k))
        query, found, score = (np.concatenate(c) for c in zip(*got))
        return pa.table({
            "id": pa.array(own[query], pa.int64()), "key": pa.array(np.asarray(queries["key"])[query], pa.int64()),
            "found": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64()),
        })

    return run


def _negatives(k: int, percent: int) -> Callable:
    """For each positive of an anchor, its k best rows of other labels in the positive's window."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, label, ids = np.asarray(queries["id"]), np.asarray(queries["label"]), rows["ids"].to_pylist()
        names, tops = queries["positive_ids"].to_pylist(), queries["positive_scores"].to_pylist()
        got: list[tuple] = []
        for qa, q, theta, block in _blocks(queries, rows):
            for i, a, t in zip(qa, q, theta):
                some, score = block.between(a, t, -(-percent * min(tops[i]) // 100), max(tops[i]))
                good = block.label[some] != label[i]
                some, score = some[good], score[good]
                for name, top in zip(names[i], tops[i]):
                    fits = (100 * score >= percent * top) & (score <= top)
                    if fits.any():
                        at, found, s = best_ids(np.full(fits.sum(), i), score[fits], block.at[some[fits]], ids, own, k)
                        got.extend((i, name, top, f, x) for f, x in zip(found.tolist(), s.tolist()))
        i, name, top, found, score = (np.array(c, np.int64) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 5
        columns = {"id": own[i], "key": np.asarray(queries["key"])[i], "positive_id": name, "positive_score": top, "found": found, "score": score}
        return pa.table({n: pa.array(c, pa.int64()) for n, c in columns.items()})

    return run


def _bound(upper: bool) -> Column:
    """Largest (or least) score of an anchor (norm, angles) with any row of a block whose angles and norms lie in the
    ranges (low, high) and (shortest, longest)."""
    each = F.arrays_zip("angles", "low", "high")
    if upper:
        apart = F.array_max(F.transform(each, lambda e: F.greatest(F.lit(0.0), e["low"] - e["angles"], e["angles"] - e["high"]))) - SLACK
    else:
        apart = F.array_min(F.transform(each, lambda e: F.least(F.lit(math.pi), e["angles"] + e["high"], 2 * math.pi - e["angles"] - e["low"]))) + SLACK
    cosine = F.when(F.col("blind") | F.col("any_blind"), 1.0 if upper else -1.0).otherwise(F.cos(F.least(F.lit(math.pi), F.greatest(F.lit(0.0), apart))))
    long = (cosine > 0) if upper else (cosine < 0)
    size = F.col("norm") * F.when(long, F.col("longest")).otherwise(F.col("shortest"))
    return size * cosine + (1 if upper else -1) * (1 + 1e-12 * F.col("norm") * F.col("longest"))


def hard_negatives(
    table: DataFrame, labels: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (an id divisible by
    `every`) and each of its `positives` best rows of the same label, the first `negatives` rows of another label
    that score at most as high as the positive and at least `percent` per cent of it.

    Components are floor(256 x); scores are exact integer inner products; ties go to the smaller id. Rows are sorted by
    label and nearest reference direction into blocks whose angles and norms span ranges. An anchor's positives
    are first sought in its own block, which bounds what others must reach; then it meets only blocks whose
    ranges allow such a score. Negatives are sought alike, in blocks that reach the window of a positive.

    Rows with a null id, label or vector, or any null or non-finite component, or an empty vector, take no part, nor do
    those whose components are so large (about a million) that 100 scores leave the long type. Zero vectors score 0.
    Vectors of different length are not compared. A row is no positive or negative of its own id; an id
    with several vectors or labels is several anchors and rows; equal rows count once. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    small_batches(spark, rows=4000)
    label = F.col("label") if labels is None else labels
    rows = raw_vectors(table, {"vec_id": F.col(id_col), "label": label}, F.col(vector_col), quantised).where("vec_id is not null and label is not null")
    rows = stored(rows, "rows")
    distinct = stored(collapsed(rows, ["label", "u"], max(positives, negatives) + 1), "vectors")
    n = distinct.count()
    chosen = F.pmod(F.xxhash64("u"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 40))
    sample: dict[int, list[bytes]] = {}
    for r in distinct.where(chosen).select("u").distinct().toLocalIterator():
        sample.setdefault(len(r["u"]) // 4, []).append(bytes(r["u"]))
    refs = {dim: references(np.frombuffer(b"".join(sorted(raw)), np.int32).reshape(-1, dim).astype(np.float64)) for dim, raw in sample.items()}

    placed = distinct.mapInArrow(_placed(refs), "label long, u binary, ids array<long>, norm double, angles array<double>, blind boolean")
    least = F.array_min("angles")
    order = [F.octet_length("u"), F.col("label"), F.array_position("angles", least), least, F.xxhash64("u")]
    blocks = block_count(n)
    rowed = stored(placed.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "blocks")
    ranges = [F.array(*[f(F.col("angles")[i]) for i in range(REFERENCES)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    spans = stored(rowed.groupBy("block").agg(
        *ranges, F.min("norm").alias("shortest"), F.max("norm").alias("longest"), F.max("blind").alias("any_blind"),
        F.min("label").alias("first_label"), F.max("label").alias("last_label"),
    ), "spans")
    dealt = int(spans.agg(F.max("block")).first()[0] or 0) + 1
    anchors = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("own", F.xxhash64("u", "label"))
    home = rowed.select(F.xxhash64("u", "label").alias("own"), "label", "u", "norm", "angles", "blind", F.col("block").alias("home"))
    anchors = stored(anchors.join(home, ["own", "label", "u"]).select(F.col("vec_id").alias("id"), F.col("own").alias("key"), "label", "u", "norm", "angles", "blind", "home"), "anchors")
    m = anchors.count()

    found = "id long, key long, found long, score long"
    near = stored(against(anchors.withColumn("block", F.col("home")).withColumn("least", F.lit(-math.inf)), rowed, m, _positives(positives), found), "near")
    reach = near.groupBy("id", "key").agg(F.when(F.count("*") >= positives, F.min("score")).cast("double").alias("least"))
    everywhere = anchors.join(reach, ["id", "key"], "left").withColumn("least", F.coalesce("least", F.lit(-math.inf)))
    everywhere = everywhere.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)))).where("block <> home")
    some = everywhere.join(spans, "block").where(F.col("label").between(F.col("first_label"), F.col("last_label")) & (_bound(True) >= F.col("least")))
    rest = against(some.select("block", "id", "key", "label", "u", "norm", "angles", "blind", "least"), rowed, m, _positives(positives), found)
    best = ranked(near.unionByName(rest), ["id", "key"], positives)
    pairs = best.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "found", "score"))).alias("p"))
    pairs = stored(pairs.select("id", "key", F.col("p.found").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "positives")

    worst, top = F.array_min("positive_scores"), F.array_max("positive_scores")
    asked = anchors.join(pairs, ["id", "key"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)))).join(spans, "block")
    asked = asked.where(top >= 0).where((_bound(True) >= F.ceil(worst * percent / 100)) & (_bound(False) <= top))
    asked = asked.where("label <> first_label or label <> last_label")
    hard = against(
        asked.select("block", "id", "key", "label", "u", "angles", "positive_ids", "positive_scores"), rowed, m, _negatives(negatives, percent),
        "id long, key long, positive_id long, positive_score long, found long, score long",
    )
    return ranked(hard, ["id", "key", "positive_id", "positive_score"], negatives).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
