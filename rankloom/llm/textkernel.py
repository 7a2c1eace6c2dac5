"""Vectorised work on Arrow text columns: words, 64-bit word hashes, per-document sums.

A text column is seen as one byte buffer with offsets, cut into chunks of whole documents so
that memory stays bounded by the chunk size (or by the longest document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
MOST_DOCS = 1 << 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of non-blank characters: everything but U+0020 and U+0009 to U+000D.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

#: Words of lower-case letters, digits and everything beyond ASCII, after A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK + 1)
        for name, base in (("_pow", _BASE), ("_inv", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``size`` bytes together, or one longer document."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(lo + MOST_DOCS, max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words and the first word of each document (length n + 1)."""
    w = is_word[data]
    begin = off[:-1][off[:-1] < off[1:]]
    start, end = w.copy(), w.copy()
    if len(w):
        start[1:] &= ~w[:-1]
        start[begin] = w[begin]
        end[:-1] &= ~w[1:]
        last = off[1:][off[:-1] < off[1:]] - 1
        end[last] = w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the lower-cased bytes, for :func:`spans`."""
    p, _ = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64, out=run[1:])
    return run


def spans(run: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal (A-Z lower-cased) bytes have equal hashes anywhere."""
    _, inv = _powers(len(run))
    return mix((run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return spans(running(data), s, e)


def hash_words(texts: list[bytes]) -> np.ndarray:
    """Hashes of single words given as bytes, equal to those of :func:`hashes`."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    e = np.cumsum(size)
    return hashes(data, e - size, e)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a document, and the first run of each document.

    A document of fewer words, but not none, has its whole sequence as its one run.
    """
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(runs)])
    where = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], runs)
    size = np.repeat(np.minimum(n, k), runs)
    c = np.cumprod(np.full(k + 1, 0xA24BAED4963EE407, dtype=np.uint64), dtype=np.uint64)
    out = size.astype(np.uint64) * c[k]
    for j in range(k):
        if len(h):
            out += np.where(j < size, h[np.minimum(where + j, len(h) - 1)] * c[j], np.uint64(0))
    return mix(out), at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[at[i]:at[i + 1]]`` for each i."""
    total = np.cumsum(values)
    run = np.zeros(len(values) + 1, dtype=total.dtype)
    run[1:] = total
    return run[at[1:]] - run[at[:-1]]


def repeats(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document (``first`` as in :func:`words`): distinct hashes, and the most frequent one's count."""
    n = len(first) - 1
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << np.uint64(48)) | (h >> np.uint64(16)))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    runs, owner = np.diff(np.append(begin, len(key))), (key[begin] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=n), most


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
