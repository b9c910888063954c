"""Byte-level BPE encoding and decoding with segment trees over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .tables import small_batches

NONE = np.int64(1) << np.int64(60)
#: Bytes of distinct pieces and their ids that a task remembers, PIECE more a piece for Python's objects; beyond
#: these it starts anew (speed only).
HELD, PIECE = 48 << 20, 150
#: Leaves of the segment trees built at a time.
LEAVES = 1 << 17


class Vocabulary:
    """Ranks of a .tiktoken file and the rank of every pair of tokens that forms another."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.byte = np.full(256, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
        if (self.byte < 0).any():
            raise ValueError("not a byte-level vocabulary: some byte has no rank")
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        keys, values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        # open addressing: a few vectorised probes find a pair or an empty slot
        self.mask = (1 << int(np.ceil(np.log2(max(len(keys), 1) * 4 + 16)))) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, NONE, np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at] == -1
            _, winner = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[winner]
            self.slot_key[at[won]], self.slot_rank[at[won]] = keys[todo[won]], values[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (th.mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that left + right forms, NONE if there is none."""
        key = left << np.int64(20) | right
        at = self._home(key)
        found = self.slot_key[at]
        rank = np.where(found == key, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return rank

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, ids in each)."""
        rank = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.where(rank < 0, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64), 0)
        counts, done = np.ones(len(pieces), np.int64), []
        for w in np.unique(width[width > 0]):
            which = np.flatnonzero(width == w)
            step = max(1, LEAVES // int(w))
            for i in range(0, len(which), step):
                part = which[i : i + step]
                ids, live = self._forest([pieces[k] for k in part], size[part], int(w))
                counts[part] = live.sum(axis=1)
                done.append((part, ids[live]))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        flat[starts[rank >= 0]] = rank[rank >= 0]
        for part, ids in done:
            flat[th.ragged(starts[part], counts[part])] = ids
        return flat, counts

    def _forest(self, pieces: list[bytes], size: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges many pieces in step, one segment tree each, w leaves (byte positions) a tree.

        Leaf i holds rank * w + i of the pair that starts at live position i, so the root is the
        leftmost pair of least rank. A merge changes three leaves (the merged position, its left
        live neighbour, the position swallowed) and their log2(w) ancestors.
        """
        k = len(pieces)
        raw = np.zeros((k, w), np.uint8)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(w)[None, :] < size[:, None]
        raw[inside] = flat
        ids = self.byte[raw]
        after = np.tile(np.arange(1, w + 1), (k, 1))
        before = np.tile(np.arange(-1, w - 1), (k, 1))
        live = inside.copy()
        tree = np.full((k, 2 * w), NONE, np.int64)
        r = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(k, w - 1)
        r[~inside[:, 1:]] = NONE
        tree[:, w : 2 * w - 1] = np.where(r < NONE, r * w + np.arange(w - 1), NONE)
        half = w // 2
        while half >= 1:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        act = np.flatnonzero(tree[:, 1] < NONE)
        while len(act):
            root = tree[act, 1]
            pos, rank = root % w, root // w
            gone = after[act, pos]
            ids[act, pos] = rank
            live[act, gone] = False
            nxt = after[act, gone]
            after[act, pos] = nxt
            ok = nxt < size[act]
            before[act[ok], nxt[ok]] = pos[ok]
            prev = before[act, pos]
            value = np.full(len(act), NONE, np.int64)
            if ok.any():
                q = self.pair(rank[ok], ids[act[ok], nxt[ok]])
                value[ok] = np.where(q < NONE, q * w + pos[ok], NONE)
            tree[act, w + gone] = NONE
            tree[act, w + pos] = value
            has = prev >= 0
            a, p = act[has], prev[has]
            q = self.pair(ids[a, p], rank[has])
            tree[a, w + p] = np.where(q < NONE, q * w + p, NONE)
            for rows, leaf in ((act, gone), (act, pos), (a, p)):
                node = (w + leaf) >> 1
                for _ in range(w.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            act = act[tree[act, 1] < NONE]
        return ids, live


class _Pieces(dict):
    """Piece -> number; a new piece gets the next one and waits for its ids."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Drops the remembered pieces."""
        self.pieces, self.held = _Pieces(), 0
        self.ids, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids in each)."""
        number = self.pieces.__getitem__
        found, per = [], []
        for text in texts:
            got = self.find(text or "")
            per.append(len(got))
            found.append(np.fromiter(map(number, got), np.int64, len(got)))
        if self.pieces.new:
            raw = [p.encode("utf-8", "surrogatepass") for p in self.pieces.new]
            ids, counts = self.v.merged(raw)
            self.held += sum(map(len, raw)) + PIECE * len(raw) + ids.nbytes + counts.nbytes
            self.ids, self.counts = [np.concatenate([*self.ids, ids])], [np.concatenate([*self.counts, counts])]
            self.pieces.new.clear()
        counts = self.counts[0]
        starts = np.cumsum(counts) - counts
        which = np.concatenate(found) if found else np.zeros(0, np.int64)
        flat = self.ids[0][th.ragged(starts[which], counts[which])]
        totals = np.concatenate([[0], np.cumsum(counts[which])])
        ends = np.cumsum(np.array(per, np.int64)) if per else np.zeros(0, np.int64)
        if self.held > HELD:
            self.forget()
        return flat, np.diff(np.concatenate([[0], totals[ends]])) if per else np.zeros(0, np.int64)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; the vocabulary file is part of the installation on every machine."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Encoder(Vocabulary(ranks), pattern)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    whole = data.tobytes()
    return pa.array([whole[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())


def _codec(path: str, pattern: str) -> Callable:
    def encoded(e: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            _, offsets = th.text_bytes(column)
            for i, j in th.slices(offsets):
                ids, n = e.encode(column.slice(i, j - i).to_pylist())
                size = e.v.lengths[ids]
                done = np.concatenate([[0], np.cumsum(size)])
                ends = np.cumsum(n)
                per = done[ends] - done[ends - n]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        _binary(ids.astype("<u4").view(np.uint8), n * 4),
                        _binary(e.v.flat[th.ragged(e.v.starts[ids], size)], per),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    @th.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        try:
            yield from encoded(e, batches)
        finally:
            e.forget()  # the worker goes on to other stages

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row: ids as little-endian unsigned 32-bit
    integers, decoded as the bytes the ids stand for.

    Every match of pattern is merged separately by the ranks in path, without special tokens. A
    null or empty text has no tokens. Rows are independent: repeated rows give repeated results, a
    null id stays null, other columns are ignored, an empty table gives an empty result. No shuffle.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _codec(path, pattern), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    )
