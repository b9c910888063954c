"""Vectorised hashing of words and word shingles of whole Arrow string columns (NumPy)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at a time; bounds the working arrays of a task whatever the texts' lengths.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For features of classifiers: everything but letters, digits and non-ASCII bytes separates.
_PUNCT = np.ones(256, bool)
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = _PUNCT[128:] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def released() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(kernel: Callable) -> Callable:
    """A kernel over batches that hands freed memory back to the system when it ends: Spark keeps Python
    workers for later stages, and several of them idle at a time."""

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            released()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets); a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `size` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, words in each text); A-Z is lower-cased.

    Works through the bytes in chunks that end between words, so a very long text costs no
    more working memory than many short ones (8 bytes a word remain).
    """
    n = len(data)
    blank = (_PUNCT if punctuation else _SPACE)[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    edge = cut.copy()  # a position before which no word is open
    edge[1:] |= blank if n else False
    edge[:-1] |= blank
    hashes, starts_all, at = [], [], 0
    while at < n:
        end = min(at + CHUNK, n)
        if end < n and not edge[end]:
            back = np.flatnonzero(edge[at + 1 : end])
            if len(back):
                end = at + 1 + int(back[-1])
            else:
                end = end + int(np.argmax(edge[end:]))
        b, open_ = data[at:end], ~blank[at:end]
        starts = np.flatnonzero(open_ & edge[at:end])
        ends = np.flatnonzero(open_ & edge[at + 1 : end + 1]) + 1
        power, inverse = _power_tables(end - at + 1)
        total = np.empty(end - at + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[_LOWER[b]] * power[: end - at], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64) * _STEP[15]))
        starts_all.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, shingles in each text), repeats included.

    A text of 1 to k-1 words gives its whole sequence as one shingle, one without words none.
    """
    n, first = len(words), np.concatenate([[0], np.cumsum(counts)])[:-1]
    many = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    out_counts = np.where(short, 1, many)
    if n == 0:
        return np.zeros(0, np.uint64), out_counts
    s = np.zeros(n, np.uint64)
    for j in range(k):
        if n > j:
            s[: n - j] += words[j:] * _STEP[j]
    last = np.repeat(first + many, counts)  # starts from here on run into the next text
    ok = np.arange(n) < last
    for i in np.flatnonzero(short):
        w = words[first[i] : first[i] + counts[i]]
        s[first[i] : first[i] + 1] = np.sum(w * _STEP[: len(w)], keepdims=True) + np.full(1, len(w), np.uint64) * _STEP[14]
        ok[first[i]] = True
    return mix(s[ok]), out_counts


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions offsets[i] .. offsets[i]+lengths[i]-1 for every i, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(offsets - (ends - lengths), lengths)
