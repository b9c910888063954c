"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, stored
from .vectors import against, best_ids, block_count, collapsed, matrix, ranked, raw_vectors

BITS = 256
#: Bits of a substring, which index one table each.
SUB = 16
#: Vectors on which rotations are learned and radii calibrated: about so many, chosen by a hash (all of fewer).
SAMPLE = 20_000
#: Standard deviations by which a radius exceeds the mean distance of a pair at the score to reach: such a
#: pair is missed with probability 0.03, better ones less often.
MARGIN = 1.9


@dataclass
class Codes:
    """Learned codes of vectors of one length. Vectors are divided by the largest norm and get one more component that
    fills their norm up to one; queries are unit vectors with none. Their angle then orders pairs as
    the inner product does. turn: projections whose signs are the bits; shift, spread: mean and
    standard deviation, in binomial ones, of the Hamming distance about angle/pi of all bits."""

    turn: np.ndarray
    shift: float = 0.0
    spread: float = 1.0

    def of(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(lifted @ self.turn > 0, axis=1)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """Hamming radius that holds nearly every pair of this cosine or a larger one."""
        p = np.arccos(np.clip(cosine, -1, 1)) / math.pi
        sd = np.sqrt(BITS * p * (1 - p))
        r = np.floor(BITS * p + sd * self.shift + np.maximum(MARGIN * self.spread * sd, 2)).astype(np.int64)
        return np.where(cosine <= -1, BITS, np.clip(r, 0, BITS))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    y = x / most
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", y, y)))])


def unit(q: np.ndarray) -> np.ndarray:
    y = q / np.abs(q).max(axis=1, keepdims=True)
    return np.column_stack([y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None], np.zeros(len(q))])


def learn(sample: np.ndarray, dim: int, most: float, seed: int = 7, rounds: int = 15) -> Codes:
    """Codes learned by iterative quantisation: the sample's main axes, rotated so that signs of the coordinates are
    closest to these; several rotations from different random starts make up the bits. Without a
    sample, random rotations."""
    rng = np.random.default_rng(seed + dim)
    x = lifted(sample, most) if len(sample) else np.zeros((0, dim + 1))
    width = min(dim + 1, 64)
    axes = np.eye(dim + 1)[:, :width] if len(x) <= width else np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]
    turns = []
    for _ in range(math.ceil(BITS / width)):
        rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        v = x @ axes
        for _ in range(rounds if len(x) > width else 0):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ rotation > 0, 1.0, -1.0))
            rotation = left @ right
        turns.append(axes @ rotation)
    codes = Codes(np.concatenate(turns, axis=1)[:, :BITS])
    if len(x) > 64:
        some = rng.permutation(len(x))[:1500]
        a, b = some[: len(some) // 2], some[len(some) // 2 :]
        q = unit(sample[a])
        p = np.clip(np.arccos(np.clip(q @ x[b].T, -1, 1)) / math.pi, 1e-3, 1 - 1e-3)
        apart = np.bitwise_count(codes.of(q)[:, None, :] ^ codes.of(x[b])[None]).sum(axis=2, dtype=np.int64)
        z = (apart - BITS * p) / np.sqrt(BITS * p * (1 - p))
        codes.shift, codes.spread = float(z.mean()), max(1.0, float(z.std()))
    return codes


@dataclass
class Index:
    most: float
    codes: dict[int, Codes] = field(default_factory=dict)

    def of(self, dim: int) -> Codes:
        if dim not in self.codes:
            self.codes[dim] = learn(np.zeros((0, dim)), dim, self.most)
        return self.codes[dim]


def _coded(index: Index, query: bool) -> Callable:
    """Adds the code of every vector (last column, raw doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * len(batch)
            for dim, (at, x) in matrix(batch.column("u"), np.float64).items():
                codes = index.of(dim).of(unit(x) if query else lifted(x, index.most))
                for i, c in zip(at, codes):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "code"])

    return run


def _words(column: pa.ChunkedArray, at: np.ndarray, kind: type) -> np.ndarray:
    raw = [v.as_py() for v in column]
    return np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)


def likely_rank(k: int, blocks: int) -> int:
    """The least rank within one of so many random blocks whose row is seldom (one query in a hundred) among the k best of
    all blocks, so that k rows of all blocks are likely to reach its score; k at most."""
    p = 1 / blocks
    beyond = [sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(r, k + 1)) for r in range(1, k + 1)]
    return next((r for r, x in enumerate(beyond, 1) if x <= 0.01), k)


def _first_scores(index: Index, rank: int, looked: int = 128) -> Callable:
    """Of queries with one block of rows: the score of that rank among the `looked` rows whose codes come nearest; with
    fewer rows than that, minus infinity."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        reach = np.full(len(queries), -math.inf)
        own, ids = np.asarray(queries["id"]), rows["ids"].to_pylist()
        theirs = matrix(rows["u"], np.float64)
        for dim, (qa, q) in matrix(queries["u"], np.float64).items():
            if dim not in theirs or len(theirs[dim][0]) < rank:
                continue
            ra, x = theirs[dim]
            qc, rc = _words(queries["code"], qa, np.uint64), _columns(_words(rows["code"], ra, np.uint64))
            alone = np.array([ids[r][0] if len(ids[r]) == 1 else -1 for r in ra], np.int64)
            many = np.array([len(ids[r]) > 1 for r in ra])
            near = min(looked, len(ra))
            step = _step(len(ra))
            for s in range(0, len(qa), step):
                part = slice(s, s + step)
                apart = _apart(qc[part], rc)
                apart[(alone[None] == own[qa[part], None]) & ~many[None]] = BITS + 1  # the query itself
                at = np.argpartition(apart, near - 1, axis=1)[:, :near]
                score = np.einsum("qd,qkd->qk", q[part], x[at])
                score[np.take_along_axis(apart, at, 1) > BITS] = -math.inf
                reach[qa[part]] = np.partition(score, near - rank, axis=1)[:, near - rank]
        return pa.table({"id": queries["id"], "key": queries["key"], "reach": pa.array(reach)})

    return run


def _columns(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes.T)


def _step(rows: int) -> int:
    """Queries that are compared with so many codes at a time: working arrays of 2 MB, which stay in the cache."""
    return max(1, min(64, (1 << 18) // max(1, rows)))


def _apart(queries: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Hamming distances of queries (rows of words) to codes (columns of words)."""
    out = np.zeros((len(queries), columns.shape[1]), np.int16)
    for w, words in enumerate(columns):
        out += np.bitwise_count(queries[:, w, None] ^ words[None])
    return out


def _probe(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """One table a substring: its distinct values and, of every code, the number of its value."""
    return [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]


def _buckets(limit: np.ndarray) -> np.ndarray:
    """Values of a substring that differ from a given one in up to `limit` bits."""
    upto = np.cumsum([0, *[math.comb(SUB, i) for i in range(SUB + 1)]])
    return upto[np.clip(limit + 1, 0, SUB + 1)]


def _search(index: Index, k: int) -> Callable:
    """Each query's k best of a block. A code within radius r of a query agrees with it up to r // n bits in one of the
    first r % n + 1 of n substrings, or up to one fewer in one of the others (pigeonhole); rows of all
    buckets that near are checked on whole codes, those inside the radius on their vectors. A query
    whose radius asks for more buckets than the block has codes looks at each code once instead:
    the same ones are inside."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, reach = np.asarray(queries["id"]), np.asarray(queries["reach"])
        ids, theirs = rows["ids"].to_pylist(), matrix(rows["u"], np.float64)
        got: list[tuple] = []
        for dim, (qa, q) in matrix(queries["u"], np.float64).items():
            if dim not in theirs:
                continue
            ra, x = theirs[dim]
            norm = np.sqrt(np.einsum("ij,ij->i", q, q))
            radius = index.of(dim).radius(reach[qa] / (norm * index.most))
            qs, rs = _words(queries["code"], qa, np.uint16), _words(rows["code"], ra, np.uint16)
            qc, rc = _words(queries["code"], qa, np.uint64), _columns(_words(rows["code"], ra, np.uint64))
            n = rs.shape[1]
            limit = radius[:, None] // n - (np.arange(n)[None] > radius[:, None] % n)
            every = _buckets(limit).sum(axis=1) >= len(ra)
            tables = [] if every.all() else _probe(rs)
            step, order = _step(len(ra)), np.argsort(every, kind="stable")
            cuts = [*range(0, int((~every).sum()), step), *range(int((~every).sum()), len(qa), step), len(qa)]
            for first, end in zip(cuts[:-1], cuts[1:]):
                part = order[first:end]
                if every[part[0]]:
                    i, j = np.nonzero(_apart(qc[part], rc) <= radius[part, None])
                else:
                    hit = np.zeros((len(part), len(ra)), bool)
                    for t, (values, number) in enumerate(tables):
                        near = np.bitwise_count(qs[part, t, None] ^ values[None]) <= limit[part, t, None]
                        hit |= near[:, number]
                    i, j = np.nonzero(hit)
                    apart = sum(np.bitwise_count(qc[part[i], w] ^ rc[w, j]).astype(np.int64) for w in range(len(rc)))
                    inside = apart <= radius[part[i]]
                    i, j = i[inside], j[inside]
                i = part[i]
                score = np.empty(len(i))
                for c in range(0, len(i), 1 << 15):
                    d = slice(c, c + (1 << 15))
                    score[d] = np.einsum("ij,ij->i", q[i[d]], x[j[d]])
                good = score >= reach[qa[i]] - 1e-9 * index.most * norm[i]
                got.append(best_ids(qa[i[good]], score[good], ra[j[good]], ids, own, k))
        query, found, score = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        return pa.table({
            "id": pa.array(own[query], pa.int64()), "key": pa.array(np.asarray(queries["key"])[query], pa.int64()),
            "found": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64()),
        })

    return run


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each vector whose id is divisible by `every`, the k others with the largest
    inner product that are found.

    Rotations are learned on about SAMPLE vectors; all vectors are coded and indexed, dealt to blocks by a hash of
    their bytes. A query first takes, in one block, a score that k rows of all blocks are likely to reach;
    the radius that belongs to it then holds nearly every better row, and all codes within it are
    retrieved from every block. Queries that find fewer than k rows so search again, with a radius
    that holds every code. Codes choose only what is compared: scores are those of the vectors, in doubles.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part.
    Vectors of different length are not compared. Rows with a query's id are the query itself; an id
    with several vectors is several queries and candidates, equal rows count once. Ties go to the
    smaller id. An empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    small_batches(spark, rows=4000)
    rows = raw_vectors(table, {"vec_id": F.col(id_col)}, F.col(vector_col), zeros=False).where("vec_id is not null")
    distinct = stored(collapsed(rows, ["u"], k + 1), "vectors")
    facts = distinct.select(F.col("u"), F.octet_length("u").alias("n")).mapInArrow(_norms, "norm double, n long").agg(F.max("norm").alias("most"), F.count("*").alias("n")).first()
    index = Index(facts["most"] or 1.0)
    sample: dict[int, list[bytes]] = {}
    share = F.pmod(F.xxhash64("u", F.lit(2)), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(1, facts["n"])) * (1 << 40))
    for r in distinct.select("u").where(share).toLocalIterator():
        sample.setdefault(len(r["u"]) // 8, []).append(bytes(r["u"]))
    for dim, raw in sample.items():
        index.codes[dim] = learn(np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim), dim, index.most)

    blocks = block_count(facts["n"])
    home = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
    coded = distinct.mapInArrow(_coded(index, False), "u binary, ids array<long>, code binary")
    coded = stored(coded.withColumn("block", home), "codes")
    queries = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(_coded(index, True), "vec_id long, u binary, code binary")
    queries = stored(queries.select(F.col("vec_id").alias("id"), F.xxhash64("u", F.lit(1)).alias("key"), "u", "code"), "queries")
    n = queries.count()
    rank = likely_rank(k, blocks)
    first = against(queries.withColumn("block", home), coded, n, _first_scores(index, rank), "id long, key long, reach double")
    asked = stored(queries.join(stored(first, "first"), ["id", "key"], "left").withColumn("reach", F.coalesce("reach", F.lit(-math.inf))), "reach")

    def searched(asked: DataFrame, n: int) -> DataFrame:
        everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return ranked(against(everywhere, coded, n, _search(index, k), "id long, key long, found long, score double"), ["id", "key"], k)

    found = stored(searched(asked, n), "found")
    short = asked.where(F.col("reach") > -math.inf).join(found.where(F.col("rank") == k).select("id", "key"), ["id", "key"], "left_anti")
    short = stored(short.withColumn("reach", F.lit(-math.inf)), "short")
    few = short.count()
    if few:
        found = found.join(short.select("id", "key"), ["id", "key"], "left_anti").unionByName(searched(short, few))
    return found.select(F.col("id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norm = np.zeros(len(batch))
        for at, x in matrix(batch.column("u"), np.float64).values():
            norm[at] = np.sqrt(np.einsum("ij,ij->i", x, x))
        yield pa.RecordBatch.from_arrays([pa.array(norm), batch.column("n").cast(pa.int64())], ["norm", "n"])
