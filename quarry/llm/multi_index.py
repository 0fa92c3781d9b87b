"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, by ``CENTROIDS`` centroids each,
so an entry belongs to one cell of a square of centroid pairs. A query walks
the pairs by the sum of its two distances, with a heap over the two sorted
lists, until the cells it took hold its budget of entries; those are reranked
by their true distance to the original vectors.

Centroids (Lloyd) and the budget, a share of all entries, are fitted on a bounded
sample, the ``SAMPLE`` rows of smallest hash: the share is the smallest that
finds ``TARGET`` of the sample's own nearest neighbours. Every row is indexed.
Cells are laid into blocks of about ``BLOCK`` entries, large cells over several
blocks by a hash of the id, and queries are dealt likewise, so no task holds more
than a block of entries and a share of the queries, whatever a cell holds.

Defined cases: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite components take no part, nor do null ids. Rows
that repeat an id and its vector are one entry. Rows that repeat an id count once as
a query, and once in a result and towards its k, at their least distance. With fewer than k candidates all are returned; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, exact, materialise

CENTROIDS = 64
SAMPLE = 8192
PROBES = 256
ROUNDS = 12
TARGET = 0.97
BLOCK = 4096
QUERIES = 4096


@dataclass
class Index:
    """The bounded parts of an index: centroids of the halves and the budget's share."""
    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sq = lambda a, c: (a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1)[None, :]
        return sq(x[:, : self.half], self.first), sq(x[:, self.half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells by the sum of a query's distances to their two centroids."""
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[oa].tolist(), b[ob].tolist()
        heap, width = [(da[0] + db[0], 0, 0)], len(self.second)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(oa[i]) * width + int(ob[j])
            # (i, j) is entered from (i, j - 1), and the first of a row from the row above
            if j + 1 < len(db):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, k: int, seed: int = 0) -> Index:
    """Centroids and budget from a sample (rows x dimensions)."""
    rng, n = np.random.default_rng(seed), len(sample)
    half = sample.shape[1] // 2
    m = int(np.clip(np.sqrt(n / 2), 1, CENTROIDS))
    index = Index(_lloyd(sample[:, :half], m, rng), _lloyd(sample[:, half:], m, rng), 1.0)
    if n <= 2 * k:
        return index
    probe = sample[:PROBES]
    dist = (probe * probe).sum(1)[:, None] - 2 * probe @ sample.T + (sample * sample).sum(1)[None, :]
    dist[np.arange(len(probe)), np.arange(len(probe))] = np.inf
    best = np.argsort(dist, axis=1)[:, :k]
    cell = index.cells(sample)
    size = np.bincount(cell, minlength=m * m)
    a, b = index.distances(probe)
    need = []
    for q in range(len(probe)):
        order = np.fromiter(index.walk(a[q], b[q]), np.int64, m * m)
        seen = np.empty(m * m)
        seen[order] = np.cumsum(size[order])
        need.append(seen[cell[best[q]]])
    index.share = float(np.quantile(np.concatenate(need), TARGET)) / n
    return index


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are valid vectors, their values in double precision)."""
    size = pc.list_value_length(col).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = col.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[ok], x[ok]


def _blocks(counts: dict[int, int], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first block and how many blocks it is spread over."""
    first, spread = np.zeros(cells, np.int64), np.ones(cells, np.int64)
    block, held = 0, 0
    for c in range(cells):
        n = counts.get(c, 0)
        parts = -(-n // BLOCK)
        if parts > 1:
            block += held > 0
            first[c], spread[c] = block, parts
            block, held = block + parts, 0
            continue
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        first[c] = block
        held += n
    return first, spread


def _nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest entries (left) of each query (right) among the query's cells."""
    out_q, out_v, out_s = [], [], []
    left = left.sort_by("vec_id")
    ids = left["vec_id"].to_numpy()
    cell = left["cell"].to_numpy()
    if len(ids) and right.num_rows:
        x = left["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        y = right["v"].combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
        own, wanted = right["query_id"].to_numpy(), right["cells"].to_pylist()
        norm = (x * x).sum(1)
        for at in range(0, len(own), 256):
            part = y[at: at + 256]
            rough = (part * part).sum(1)[:, None] - 2 * part @ x.T + norm[None, :]
            for i in range(len(part)):
                ok = np.flatnonzero(np.isin(cell, wanted[at + i]) & (ids != own[at + i]))
                d = rough[i, ok]
                head = np.flatnonzero(np.append(True, ids[ok][1:] != ids[ok][:-1])) if len(ok) else ok
                if len(head) > k:  # all that rounding may have put behind the k-th id stay
                    edge = np.partition(np.minimum.reduceat(d, head), k - 1)[k - 1]
                    ok = ok[d <= edge + 1e-9 * (1 + abs(edge) + norm.max())]
                true = np.sqrt(((x[ok] - part[i]) ** 2).sum(1))
                _, one = np.unique(ids[ok[np.lexsort((true, ids[ok]))]], return_index=True)
                pick = np.lexsort((true, ids[ok]))[one]
                best = pick[np.lexsort((ids[ok][pick], true[pick]))][:k]
                out_q.append(np.full(len(best), own[at + i]))
                out_v.append(ids[ok][best])
                out_s.append(true[best])
    cat = lambda a, kind: pa.array(np.concatenate(a) if a else [], kind)
    return pa.table([cat(out_q, pa.int64()), cat(out_v, pa.int64()), cat(out_s, pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest ``vectors`` found for each of
    ``queries`` (same columns), the query's own id excepted."""
    spark = vectors.sparkSession
    tidy = lambda df: df.select(exact(vec_id).cast("long").alias("vec_id"), exact(embedding).alias("e")).filter(
        "vec_id is not null and e is not null")
    entries, asked = materialise(tidy(vectors).distinct(), "entries"), tidy(queries)
    # by the whole row, so an id of many vectors takes no more than its share
    sample = (entries.orderBy(F.xxhash64("vec_id", "e"), "vec_id", "e").limit(SAMPLE).toArrow())
    kind = "query_id long, vec_id long, score double"
    size = pc.list_value_length(sample["e"]).to_numpy() if sample.num_rows else np.zeros(0, np.int64)
    dim = int(np.bincount(size).argmax()) if len(size) else 0
    x = _matrix(sample["e"].combine_chunks(), dim)[1] if dim else np.zeros((0, 0))
    if not len(x):
        discard(entries)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(x, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = _matrix(b.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.cells(v)), b.column(0).take(pa.array(rows)),
                     pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * dim, v.ravel())], ["cell", "vec_id", "v"])

    indexed = materialise(entries.mapInArrow(assign, "cell long, vec_id long, v array<double>"), "index")
    discard(entries)
    # one count for each pair of centroids at most
    counts = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    cells = len(index.first) * len(index.second)
    first, spread = _blocks(counts, cells)
    budget = max(index.share * total, k + 1)
    shares = max(1, -(-asked.count() // QUERIES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            block = first[c] + (ids * 0x9E3779B1 >> 7) % spread[c]
            yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], ["block", "cell", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = _matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(rows)).to_numpy()
            out = []
            if len(rows):
                a, b = index.distances(v)
                for q in range(len(rows)):
                    held, by_block = 0, {}
                    for c in index.walk(a[q], b[q]):
                        n = counts.get(c, 0)
                        if n:
                            for s in range(spread[c]):
                                by_block.setdefault(int(first[c]) + s, []).append(c)
                            held += n
                            if held >= budget:
                                break
                    out += [{"block": m, "query_id": int(ids[q]), "v": v[q], "cells": cs} for m, cs in by_block.items()]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("block", pa.int64()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))]))

    left = (indexed.mapInArrow(place, "block long, cell long, vec_id long, v array<double>")
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))))
    right = (asked.dropDuplicates(["vec_id"]).mapInArrow(probe, "block long, query_id long, v array<double>, cells array<long>")
             .withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")))
    found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(
        lambda a, b: _nearest(a, b, k), kind)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (once.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
