"""Words and word n-grams of Arrow string columns as numpy arrays.

A batch of texts is one byte array with offsets. Words are maximal runs of bytes other than space and
9..13. A word's hash is a polynomial over table values of its bytes, taken from prefix sums of the whole
block, so the work per word does not depend on Python objects. Blocks bound the memory for very long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time: the arrays made of them stay within a core's cache.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Every ASCII byte but letters and digits separates.
SYMBOLS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k, p = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(p)
        k, p = k + m, p * p % 2**64
    return out


_state: dict = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _state.get("n", 0) < n:
        n = max(n, 2 * BLOCK)
        _state.update(n=n, up=_powers(_BASE, n), down=_powers(pow(_BASE, -1, 2**64), n))
    return _state["up"], _state["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]], off - off[0]


def parts(off: np.ndarray, limit: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges of documents of at most limit bytes each (a longer document stands alone)."""
    out, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def slices(batches: Iterator[pa.RecordBatch], k: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most limit bytes in the k-th column (or one row)."""
    for batch in batches:
        _, off = view(batch.column(k))
        for i, j in parts(off, limit):
            yield batch.slice(i, j - i)


@dataclass
class Words:
    hash: np.ndarray  # uint64
    doc: np.ndarray  # int64, index in the batch
    start: np.ndarray  # byte positions in the batch
    end: np.ndarray
    count: np.ndarray  # words of each document


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte spans [start, end), which stand in order and do not overlap."""
    h = np.empty(len(start), np.uint64)
    table = _TABLE_LOWER if lower else _TABLE
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
            a, b = int(start[i]), int(end[j - 1])
            up, down = _power_tables(b - a + 1)
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
            s, e = start[i:j] - a, end[i:j] - a
            h[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(h)


def words(data: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """space: for each byte value, whether it separates words."""
    n, docs = len(data), len(off) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, np.zeros(docs, np.int64))
    space = space[data]
    first = ~space
    last = first.copy()
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[1:] &= space[:-1]
    first[inner] = ~space[inner]
    last[:-1] &= space[1:]
    last[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    h = span_hashes(data, start, end, lower)
    return Words(h, doc, start, end, np.bincount(doc, minlength=docs))


def ngrams(w: Words, gaps: tuple[int, ...], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the word groups (i, i + gaps[0], i + gaps[1], ...) that lie in one document."""
    reach = max(gaps, default=0)
    m = len(w.hash) - reach
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = w.hash[:m] + np.uint64(seed)
        for g in gaps:
            h = h * np.uint64(_BASE) + w.hash[g : g + m]
        ok = w.doc[:m] == w.doc[reach : reach + m]
        return mix(h[ok]), w.doc[:m][ok]


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each document, one after another, with offsets.

    A document of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    h, doc = ngrams(w, tuple(range(1, k)))
    docs = len(w.count)
    cut = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=docs))))
    at = np.concatenate(([0], np.cumsum(w.count)))
    out = []
    with np.errstate(over="ignore"):
        for d in range(docs):
            a = h[cut[d] : cut[d + 1]]
            if len(a):
                a = np.sort(a)
                a = a[np.concatenate(([True], a[1:] != a[:-1]))]
            elif w.count[d]:
                v = np.uint64(w.count[d])
                for x in w.hash[at[d] : at[d + 1]]:
                    v = v * np.uint64(_BASE) + x
                a = mix(np.array([v], np.uint64))
            out.append(a)
    sizes = np.array([len(a) for a in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def doc_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each document (values run along the bytes, words or n-grams that off delimits)."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[off[1:]] - total[off[:-1]]
