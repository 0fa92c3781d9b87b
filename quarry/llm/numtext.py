"""Vectorised work on Arrow string columns: blocks, words, lines, shingles.

Text stays in the UTF-8 buffer Arrow hands over. Spans (words, lines,
shingles) are hashed from one running sum: with an odd base ``P`` and a random
value per byte, ``sum(T[b_j] * P**j)`` over a span divided by ``P**start``
(mod 2**64) depends on the span's bytes alone, so any span costs two lookups.

White space is ASCII space and \\t..\\r throughout; nulls count as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, BLOCK_BYTES + 1)
        for name, base in (("_pow", _P), ("_inv", _PINV)):
            t = np.full(n, base, U)
            t[0] = 1
            globals()[name] = np.multiply.accumulate(t)
    return _pow, _inv


class Spans:
    """Hashes of byte spans of one buffer."""

    def __init__(self, data: np.ndarray):
        self.data = data
        p, self._i = _tables(len(data) + 1)
        self._c = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * p[: len(data)], out=self._c[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._c[end] - self._c[start]) * self._i[start] + (end - start).astype(U))

    def grams(self, chars: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the bytes from each of ``chars`` (ascending) to the k-th after it."""
        if len(chars) == len(self._c):  # one byte each
            c, inv = self._c, self._i[: len(chars)]
        else:
            c, inv = self._c[chars], self._i[chars]
        if len(chars) <= k:
            return np.zeros(0, U)
        h = c[k:] - c[:-k]
        h *= inv[:-k]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        return h


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]: o[-1]], o - o[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each block of a column."""
    data, offs = utf8(col)
    for i, j in blocks(offs):
        o = offs[i: j + 1]
        yield i, j, data[o[0]: o[-1]], o - o[0]


def _firsts(n: int, offs: np.ndarray) -> np.ndarray:
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    first[n] = True
    return first


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of non-white bytes within a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink, first = ~WHITE[data], _firsts(n, offs)
    before = np.concatenate(([False], ink[:-1]))
    after = np.concatenate((ink[1:], [False]))
    start = np.flatnonzero(ink & (first[:n] | ~before))
    end = np.flatnonzero(ink & (first[1:] | ~after)) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number in its row from 0) of each ``\\n``-split line;
    a row of k newlines has k + 1 lines, empty ones included."""
    nl = np.flatnonzero(data == 0x0A)
    rows = len(offs) - 1
    # where both begin at one place, the line after a feed belongs to the row before
    start = np.concatenate((nl + 1, offs[:-1]))
    row = np.concatenate((np.searchsorted(offs, nl, "right") - 1, np.arange(rows)))
    order = np.argsort(start, kind="stable")
    start, row = start[order], row[order]
    end = np.empty_like(start)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end[:-1] = start[1:] - 1
    end[last] = offs[1:][row[last]]
    head = np.searchsorted(row, np.arange(rows), "left")
    return start, end, row, np.arange(len(row)) - head[row]


def strip_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at their ends (empty spans: start = end)."""
    ink = np.flatnonzero(~WHITE[data])
    lo, hi = np.searchsorted(ink, start), np.searchsorted(ink, end)
    some = hi > lo
    s, e = start.copy(), start.copy()
    s[some] = ink[lo[some]]
    e[some] = ink[hi[some] - 1] + 1
    return s, e


def char_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ascending array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row index and position within the row, for rows of ``count`` entries."""
    idx = np.repeat(np.arange(len(count)), count)
    at = np.cumsum(count) - count
    return idx, np.arange(len(idx)) - at[idx]


def char_shingles(spans: Spans, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(span index, hash) of every k-character shingle; a span shorter than
    k characters is one shingle, an empty span has none."""
    chars = np.append(char_starts(spans.data), len(spans.data))
    lo, hi = np.searchsorted(chars, start), np.searchsorted(chars, end)
    n = hi - lo
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    idx, pos = expand(count)
    at = lo[idx] + pos
    grams = spans.grams(chars, k)
    if (n >= k).all():
        return idx, grams[at]
    short = np.flatnonzero((n < k) & (n > 0))
    out = grams[np.minimum(at, max(len(grams) - 1, 0))] if len(grams) else np.zeros(len(at), U)
    out[(np.cumsum(count) - count)[short]] = spans.hash(start[short], end[short])
    return idx, out


def word_shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, words of each row) of every k-word shingle; a row of fewer
    words has one shingle of all of them, a row without words none."""
    start, end, row = word_spans(data, offs)
    h = Spans(data).hash(start, end) if len(start) else np.zeros(0, U)
    words = np.bincount(row, minlength=len(offs) - 1)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    idx, pos = expand(count)
    head = np.cumsum(words) - words
    a, out = head[idx] + pos, np.zeros(len(idx), U)
    stop = head[idx] + words[idx]
    for j in range(k):
        at = a + j
        out = np.where(at < stop, mix(out * U(_P) + h[np.minimum(at, len(h) - 1)] + U(j + 1)), out) if len(h) else out
    return idx, out, words


def element_sets(row: np.ndarray, h: np.ndarray, rows: int) -> pa.Array:
    """The distinct upper halves of each row's hashes, ascending, as bytes."""
    key = (row.astype(U) << U(32)) | (h >> U(32))
    key.sort()  # np.unique hashes integers first, which takes ten times as long
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    ends = np.searchsorted(key, np.arange(rows + 1).astype(U) << U(32))
    sets = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(key.astype(np.uint32))])
    return sets.cast(pa.binary())


def jaccard(group_a: np.ndarray, hash_a: np.ndarray, group_b: np.ndarray, hash_b: np.ndarray,
            groups: int, weighted: bool) -> np.ndarray:
    """Jaccard similarity of the two shingle (multi)sets of each of ``groups``
    pairs (fewer than 65,536): sum of minima over sum of maxima of the counts
    if weighted, else of the sets. Two empty sets count as equal (1.0)."""
    def counted(g, h):
        key, n = np.unique((g.astype(U) << U(48)) | (h >> U(16)), return_counts=True)
        return key, n if weighted else np.ones(len(key), np.int64)
    ka, na = counted(group_a, hash_a)
    kb, nb = counted(group_b, hash_b)
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    size = lambda k, n: np.bincount((k >> U(48)).astype(np.int64), n, groups)
    inter = size(both, np.minimum(na[ia], nb[ib]))
    union = size(ka, na) + size(kb, nb) - inter
    return np.where(union > 0, inter / np.maximum(union, 1), 1.0)
