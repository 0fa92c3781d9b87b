"""Gradient-boosted trees over any number of rows.

Binary log loss, Newton leaf values, splits between quantiles of each feature.
Trees are full binary trees kept as arrays, so a prediction is a few gathers.

A tree is grown level by level from sums of its nodes' derivatives by feature and
bin, so rows are only ever summed: a few blocks by the caller (``fit``), a table
of blocks by Spark tasks (``fit_table``). The derivatives are whole multiples of 1 / UNIT
and their sums exact, so the trees do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import discard, materialise

TREES = 60
DEPTH = 4
RATE = 0.2
SPLITS = 32
LEAST = 0.2  # of the second derivatives' sum, on either side of a split
RIDGE = 1.0
UNIT = float(1 << 20)  # exact up to 2 ** 33 rows of mean weight 1
AGAIN = 10  # trees after which a table of blocks is written with its margins so far


@dataclass
class Trees:
    """For each tree: the feature and threshold of each inner node, level by
    level, and the values of the leaves."""
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of ``x``."""
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2 ** depth - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cuts_of(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Values between which rows are told apart, of a feature that has each ``value``
    (ascending) ``count`` times: its quantiles but the largest value."""
    if not len(value):
        return np.zeros(0)
    ends = np.cumsum(count)
    at = np.floor(np.linspace(0, 1, SPLITS + 1)[1:-1] * (ends[-1] - 1)).astype(np.int64)
    v = np.unique(value[np.searchsorted(ends, at, "right")])
    return v[v < value[-1]]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(features x rows) numbers of the bins between the cuts."""
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.uint8)


@dataclass
class Grown:
    """Trees over bins: a row goes right at a node if its bin is above ``bin``."""
    feature: list[np.ndarray]
    bin: list[np.ndarray]
    leaf: list[np.ndarray]

    def since(self, t: int) -> Grown:
        return Grown(self.feature[t:], self.bin[t:], self.leaf[t:])


def _descend(x: np.ndarray, feature: np.ndarray, bin_: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row of ``x`` (features x rows) after so many levels."""
    at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    for _ in range(levels):
        at = 2 * at + 1 + (x[feature[at], rows] > bin_[at])
    return at


def _margin(x: np.ndarray, z: np.ndarray, trees: Grown) -> np.ndarray:
    for f, b, v in zip(trees.feature, trees.bin, trees.leaf, strict=True):
        inner = len(f)
        z = z + v[_descend(x, f, b, inner.bit_length()) - inner]
    return z


def _level(x: np.ndarray, y: np.ndarray, w: np.ndarray, z: np.ndarray, feature: np.ndarray, bin_: np.ndarray,
           level: int, width: int) -> np.ndarray:
    """(features, 2, nodes, bins): sums of first and second derivatives at a tree's level."""
    p = sigmoid(z)
    g, h = np.rint(w * (y - p) * UNIT), np.rint(w * p * (1 - p) * UNIT)
    nodes = 2 ** level
    slot = (_descend(x, feature, bin_, level) - (nodes - 1)) * width
    out = np.empty((len(x), 2, nodes, width))
    for j, b in enumerate(x):
        key = slot + b
        for i, v in enumerate((g, h)):
            out[j, i] = np.bincount(key, v, nodes * width).reshape(nodes, width)
    return out


def _grow(cuts: list[np.ndarray], start: float, trees: int, depth: int,
          sums: Callable[[Grown, np.ndarray, np.ndarray, int, int], np.ndarray]) -> Trees:
    """Trees from ``sums`` (trees so far, the open tree's features and bins, level, width)."""
    width, inner = max(map(len, cuts), default=0) + 1, 2 ** depth - 1
    grown = Grown([], [], [])
    score = lambda v: v[:, 0] ** 2 / (v[:, 1] + RIDGE)
    for _ in range(trees):
        feature, bin_, ends = np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(0)
        for level in range(depth):
            nodes, base = 2 ** level, 2 ** level - 1
            s = sums(grown, feature, bin_, level, width) / UNIT  # feature, (g, h), node, bin
            total = s.sum(axis=3, keepdims=True)
            low = np.cumsum(s, axis=3)
            gain = score(low) + score(total - low) - score(total)
            gain[(low[:, 1] < LEAST) | (total[:, 1] - low[:, 1] < LEAST)] = -1.0
            for j, c in enumerate(cuts):
                gain[j, :, len(c):] = -1.0
            best = gain.transpose(1, 0, 2).reshape(nodes, -1)
            pick = best.argmax(axis=1)
            some = best[np.arange(nodes), pick] > 1e-9
            f, b = pick // width, np.where(some, pick % width, 255)
            feature[base: base + nodes], bin_[base: base + nodes] = f, b
            # a node that is not divided sends all its rows to the left
            left = np.where(some, low[f, :, np.arange(nodes), pick % width].T, total[0, :, :, 0])
            ends = np.stack([left, total[0, :, :, 0] - left], axis=2).reshape(2, -1)
        grown.feature.append(feature)
        grown.bin.append(bin_)
        grown.leaf.append(RATE * ends[0] / (ends[1] + RIDGE))
    cut = [[np.inf if k == 255 else cuts[i][k] for i, k in zip(f, b, strict=True)] for f, b in zip(grown.feature, grown.bin, strict=True)]
    return Trees(start, np.array(grown.feature), np.array(cut, float), np.array(grown.leaf))


def start_of(y: np.ndarray, w: np.ndarray) -> float:
    """Log odds of the weighted share of label 1."""
    mean = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
    return float(np.log(mean / (1 - mean)))


def fit_binned(x: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], start: float,
               trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for rows at hand: ``x`` (features x rows) in bins."""
    z, done = np.full(len(y), start), 0

    def sums(grown: Grown, *where) -> np.ndarray:
        nonlocal z, done
        z, done = _margin(x, z, grown.since(done)), len(grown.leaf)
        return _level(x, y, w, z, *where)

    return _grow(cuts, start, trees, depth, sums)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for rows ``x`` with labels ``y`` (0, 1) and weights ``w``."""
    cuts = [cuts_of(*np.unique(c, return_counts=True)) for c in x.T]
    return fit_binned(binned(x, cuts), y, w, cuts, start_of(y, w), trees, depth)


BLOCK = "x binary, y binary, w binary, z binary"


def block(x: np.ndarray, y: np.ndarray, w: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    """One row of a table of blocks, of ``x`` (features x rows) in bins."""
    parts = (x.astype(np.uint8), y.astype(np.uint8), w.astype(float), z.astype(float))
    return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["x", "y", "w", "z"])


def unpacked(batch: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, y, w, z = (np.frombuffer(batch.column(i)[row].as_py(), t) for i, t in enumerate((np.uint8, np.uint8, float, float)))
    return x.reshape(-1, len(y)), y, w, z


def fit_table(blocks: DataFrame, cuts: list[np.ndarray], start: float, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for the rows of a table of blocks (``BLOCK``), summed by Spark at each level:
    as many tasks as run at once, each sending the sums of its blocks."""
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    held, done = blocks, 0

    def sums(grown: Grown, *where) -> np.ndarray:
        nonlocal held, done
        if len(grown.leaf) == done + AGAIN:
            fresh = grown.since(done)

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(b.num_rows):
                        x, y, w, z = unpacked(b, i)
                        yield block(x, y, w, _margin(x, z, fresh))

            before, held, done = held, materialise(held.coalesce(tasks).mapInArrow(moved, BLOCK), "blocks"), len(grown.leaf)
            if before is not blocks:
                discard(before)
        mine = grown.since(done)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for i in range(b.num_rows):
                    x, y, w, z = unpacked(b, i)
                    s = _level(x, y, w, _margin(x, z, mine), *where)
                    total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        level, width = where[2:]
        out = held.coalesce(tasks).mapInArrow(part, "sums binary").toArrow()
        return sum(np.frombuffer(v.as_py()) for v in out["sums"]).reshape(len(cuts), 2, 2 ** level, width)

    out = _grow(cuts, start, trees, depth, sums)
    if held is not blocks:
        discard(held)
    return out
