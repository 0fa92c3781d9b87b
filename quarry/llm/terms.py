"""Terms of Arrow text columns: maximal runs of the bytes of a class.

Both lexical operators cut terms at ASCII characters only, so a term is a run of
bytes whatever the script: a byte of 0x80 or more always belongs to it. Only
A-Z are lower-cased. Terms come as exact strings (dictionary-encoded), never as
hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.numtext import blocks, utf8

BLOCK = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
ALNUM = LETTERS.copy()
ALNUM[0x30:0x3A] = True


def term_runs(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, row of each) of the texts in ``data`` cut at ``offs``, in order."""
    rows = len(offs) - 1
    ink = wanted[data]
    first = np.zeros(len(data) + 1, bool)  # where a row begins
    first[offs[:-1]] = True
    start = np.flatnonzero(ink & (first[:-1] | np.append(True, ~ink[:-1])[: len(ink)]))
    kept = np.cumsum(ink) if len(data) else np.zeros(0, np.int64)
    at = (kept[start] - 1) if len(start) else np.zeros(0, np.int64)
    bounds = np.append(at, kept[-1] if len(kept) else 0)
    body = _LOWER[data[ink]]
    terms = pa.Array.from_buffers(pa.large_string(), len(start),
                                  [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(body)])
    return terms, np.searchsorted(offs[: rows + 1], start, "right") - 1


def count_terms(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many terms each row has, without making them."""
    ink = wanted[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    start = np.flatnonzero(ink & (first[:-1] | np.append(True, ~ink[:-1])[: len(ink)]))
    return np.diff(np.searchsorted(start, offs)).astype(np.int64)


def text_runs(col: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of about ``most`` bytes;
    nulls are empty, and a longer text is a run of its own."""
    data, offs = utf8(col)
    for i, j in blocks(offs, most):
        o = offs[i: j + 1]
        yield i, j, data[o[0]: o[-1]], o - o[0]


def counted(terms: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary, code, row, tf): the distinct (term, row) pairs, sorted by
    term code, then row."""
    d = terms.dictionary_encode()
    code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(row[-1]) + 1 if len(row) else 1
    key, tf = np.unique(code * width + row, return_counts=True)
    return d.dictionary, key // width, key % width, tf
