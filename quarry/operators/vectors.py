"""Vector operators: pooling, normalisation, exact and cell-pruned
inner-product search (D2-D5, E1-E3), and the stored collection (A15).

Dense top-k never materialises (question, item) pairs as rows and never
plans a cross join. Questions are hashed into ``qb`` blocks and items into
``ib`` blocks *per group* (a group is the whole collection, or one IVF
cell); a question is copied to each item block of its group and an item to
each question block, so every ``(group, qblock, iblock)`` cell of the grid
holds about ``q_rows`` questions and ``i_rows`` items at most. Block counts come
from the group sizes, so a cell holding a third of all vectors is simply
split into more blocks. ``cogroup().applyInPandas`` runs one matrix
product per grid cell and emits only each question's top-k; a final
``row_number() <= k`` (partial WindowGroupLimit before the exchange)
merges the blocks. Work is exact: O(|Q|·|I|·dim) multiply-adds, spread
over ``Σ qb·ib`` tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.fixed import CHUNKS_PER_DOC, EMBED_DIM
from quarry.functions.text import terms, text_hash
from quarry.plans.strategy import top_k
from quarry.session import shared_dir
from quarry.sources.segments import Segments

Q_ROWS = 16384
I_ROWS = 32768
SPREAD = 16
TILE = 256


def _blocks(rows: int, spread: int = 1) -> Column:
    """Blocks of at most ``rows`` rows, up to ``spread`` of a thousand rows where fewer would
    do: the copies, one for each block of the other side, do not grow with a table
    below ``spread`` times ``rows``."""
    n = F.count(F.lit(1))
    return F.greatest(F.ceil(n / rows), F.least(F.lit(spread), F.ceil(n / 1024))).cast("int")


def _block_topk(k: int, exclude_self: bool, qid: str, iid: str, qvec: str, ivec: str, finite: bool = False):
    def run(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or ipdf.empty:
            return pd.DataFrame({qid: pd.Series([], dtype="int64"), iid: pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        qids = qpdf[qid].to_numpy(dtype=np.int64)
        iids = ipdf[iid].to_numpy(dtype=np.int64)
        order = np.argsort(iids, kind="stable")
        iids = iids[order]
        Q = np.stack(qpdf[qvec].to_numpy()).astype(np.float64)
        I = np.stack(ipdf[ivec].to_numpy()).astype(np.float64)[order]
        kk = min(k, len(iids))
        out_q, out_i, out_s = [], [], []
        for lo in range(0, len(qids), TILE):  # a block's scores are never held whole
            S = np.round(Q[lo: lo + TILE] @ I.T, 6)
            if exclude_self:
                S[qids[lo: lo + TILE, None] == iids[None, :]] = -np.inf
            if finite:
                S[np.isnan(S)] = -np.inf
            kth = np.partition(S, S.shape[1] - kk, axis=1)[:, S.shape[1] - kk]
            for r in range(S.shape[0]):
                cand = np.nonzero(S[r] >= kth[r])[0]
                # candidates are in ascending item-id order: a stable sort on
                # score keeps ties by item id
                cand = cand[np.argsort(-S[r, cand], kind="stable")][:kk]
                cand = cand[np.isfinite(S[r, cand])]
                out_q.append(np.full(len(cand), qids[lo + r], dtype=np.int64))
                out_i.append(iids[cand])
                out_s.append(S[r, cand])
        return pd.DataFrame({qid: np.concatenate(out_q), iid: np.concatenate(out_i),
                             "score": np.concatenate(out_s)})
    return run


def dense_topk(queries: DataFrame, items: DataFrame, k: int, qid: str = "qid", iid: str = "iid",
               qvec: str = "qvec", ivec: str = "ivec", group: str | None = None,
               exclude_self: bool = False, q_rows: int = Q_ROWS, i_rows: int = I_ROWS, finite: bool = False) -> DataFrame:
    """Exact top-k items per question by inner product, within ``group``.

    ``queries(qid, qvec[, group])`` may repeat a question in several groups
    (IVF probing); ``items(iid, ivec[, group])``. Output
    ``(qid, iid, score, rank)``, score rounded to 6 places, ties by item id.
    ``finite`` leaves pairs without a score out.
    """
    g = group or "_grp"
    q = queries.select(qid, qvec, *([F.col(group)] if group else [])).filter(F.col(qvec).isNotNull())
    it = items.select(iid, ivec, *([F.col(group)] if group else [])).filter(F.col(ivec).isNotNull())
    if group is None:
        # one group: block counts are scalar subqueries, so no join at all
        qb = q.agg(_blocks(q_rows, SPREAD)).scalar()
        ib = it.agg(_blocks(i_rows)).scalar()
        qx = q.select(qid, qvec, F.lit(0).alias(g), F.pmod(F.xxhash64(qid), qb).cast("int").alias("_qblk"),
                      F.explode(F.sequence(F.lit(0), ib - 1)).alias("_iblk"))
        ix = it.select(iid, ivec, F.lit(0).alias(g), F.pmod(F.xxhash64(iid), ib).cast("int").alias("_iblk"),
                       F.explode(F.sequence(F.lit(0), qb - 1)).alias("_qblk"))
    else:
        qs = q.groupBy(g).agg(_blocks(q_rows).alias("qb"))
        isz = it.groupBy(g).agg(_blocks(i_rows).alias("ib"))
        # one row per group; the groups are the cells of an index (``nlist``),
        # so the table is bounded by a parameter
        blocks = F.broadcast(qs.join(isz, g))
        qx = (q.join(blocks, g)
              .select(qid, qvec, g, F.pmod(F.xxhash64(qid), F.col("qb")).cast("int").alias("_qblk"),
                      F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("_iblk")))
        ix = (it.join(blocks, g)
              .select(iid, ivec, g, F.pmod(F.xxhash64(iid), F.col("ib")).cast("int").alias("_iblk"),
                      F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("_qblk")))
    schema = T.StructType([T.StructField(qid, T.LongType()), T.StructField(iid, T.LongType()),
                           T.StructField("score", T.DoubleType())])
    fn = _block_topk(k, exclude_self, qid, iid, qvec, ivec, finite)
    part = (qx.groupBy(g, "_qblk", "_iblk")
            .cogroup(ix.groupBy(g, "_qblk", "_iblk"))
            .applyInPandas(lambda a, b: fn(a, b), schema))
    return top_k(part, [qid], [F.desc("score"), iid], k)


def threshold(hits: DataFrame, min_score: float) -> DataFrame:
    """Keep hits with score strictly above ``min_score`` (after top-k)."""
    return hits.filter(F.col("score") > F.lit(min_score))


# --- pooling and normalisation ---------------------------------------------

def unpivot(df: DataFrame, keys, vec: str, value: str = "value") -> DataFrame:
    """``(keys..., pos, value)``: one row per vector element, 0-based pos."""
    return df.select(*keys, F.posexplode(vec).alias("pos", value)).withColumn(
        "pos", F.col("pos").cast("bigint"))


def first_pool(df: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """The vector of the first row of each group (CLS pooling)."""
    return df.groupBy(group).agg(F.min_by(vec, order).alias(vec), F.min(order).alias(order))


def mean_pool(df: DataFrame, group: str, vec: str, mask: str | None = None) -> DataFrame:
    """Element-wise mean of each group's vectors (masked rows excluded)
    (D3). Whole vectors are summed map-side, so a large group ships one partial
    mean per task, and no vector is taken apart into rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    src = (df if mask is None else df.filter(F.col(mask) != 0)).filter(F.col(vec).isNotNull())
    v = array_to_vector(F.col(vec).cast("array<double>"))
    return src.groupBy(group).agg(vector_to_array(Summarizer.mean(v)).alias(vec))


def normalize(df: DataFrame, vec: str) -> DataFrame:
    from quarry.functions.vectors import l2_normalize
    return df.withColumn(vec, l2_normalize(vec))


# --- coarse index (IVF) -----------------------------------------------------

def label_centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """Cells from a grouping column: centroid = mean vector of the group."""
    c = mean_pool(vectors, label, vec)
    return c.select(F.col(label).cast("bigint").alias("cell"), F.col(vec).alias("centroid"))


def kmeans_centroids(vectors: DataFrame, vec: str, k: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Cells from ``pyspark.ml`` KMeans with cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    feats = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(feats)
    spark = vectors.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    # k centroids of dim floats: bounded by the index parameters
    return spark.createDataFrame(rows, "cell long, centroid array<double>").select(
        "cell", vector_to_array(array_to_vector("centroid")).alias("centroid"))


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a column as rows (no nulls)."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cells ascending, their centroids): ``nlist`` rows of one width, which the
    index's parameters bound."""
    rows = sorted(map(tuple, centroids.select("cell", "centroid").collect()))
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of each vector's centroid of largest inner product, the first of equals."""
    s = np.round(vectors @ centroids.T, 6)
    at = s.argmax(axis=1)
    return at, s[np.arange(len(s)), at]


def assign_cells(vectors: DataFrame, centroids: DataFrame, iid: str, vec: str) -> DataFrame:
    """Nearest cell by inner product for every vector: ``(iid, cell, score)``, map-side
    against the centroids (a few rows of a bounded index)."""
    cells, matrix = centroid_matrix(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, score = _nearest(_matrix(b.column(1)), matrix)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells[at]), pa.array(score)], [iid, "cell", "score"])

    kind = vectors.select(iid).schema[0].dataType.simpleString()
    return vectors.filter(F.col(vec).isNotNull()).select(iid, vec).mapInArrow(run, f"{iid} {kind}, cell long, score double")


class CellStore:
    """A vector collection laid out by coarse cells (D5, A15) that grows by appends.

    Centroids are fitted once and kept with the store; an append finds each
    vector's cell map-side and writes the rows partitioned by cell, a cell over
    ``spread`` files, so the hot cell is many files too. A search sends a block of
    questions with the cells they probe to the tasks that scan those cells' files
    (other cells are not read) and keeps the k best of each question in the task:
    no item is shuffled or copied. ``nprobe`` of all cells is the exact search."""

    QUERIES = 4096

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.segments = spark, Segments(spark, path)
        facts = self.segments.manifest()["facts"]
        self.id_type, self.vec_type, self.spread = facts["id_type"], facts["vec_type"], facts["spread"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: DataFrame, iid: str, vec: str,
               centroids: DataFrame | None = None, spread: int = 4) -> CellStore:
        """An empty store for vectors like those of ``like``; without centroids it has one cell."""
        s = Segments(spark, path)
        if centroids is not None:
            centroids.select("cell", "centroid").write.parquet(f"{s.path}/centroids")
        kinds = [like.select(c).schema[0].dataType.simpleString() for c in (iid, vec)]
        s.commit(s.manifest(), facts={"id_type": kinds[0], "vec_type": kinds[1], "spread": spread, "cells": centroids is not None})
        return cls(spark, path)

    def centroids(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.segments.manifest()["facts"]["cells"]:
            return None
        return centroid_matrix(self.spark.read.schema("cell long, centroid array<double>").parquet(f"{self.segments.path}/centroids"))

    def append(self, items: DataFrame, iid: str, vec: str, batch: str | None = None) -> bool:
        """Add vectors without a new fit; False if a batch of this name is live already."""
        at = self.segments.manifest()
        if batch is not None and any(batch in f["batches"] for f in at["segments"].values()):
            return False
        rows = items.filter(F.col(vec).isNotNull()).select(F.col(iid).alias("iid"), F.col(vec).alias("vec"))
        known = self.centroids()
        if known is None:
            placed = rows.withColumn("cell", F.lit(0).cast("long"))
        else:
            cells, matrix = known

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    near, _ = _nearest(_matrix(b.column(1)), matrix)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells[near])], ["iid", "vec", "cell"])

            placed = (rows.mapInArrow(run, f"iid {self.id_type}, vec {self.vec_type}, cell long")
                      .repartition("cell", F.pmod(F.xxhash64("iid"), F.lit(self.spread))))
        name = self.segments.new_name()
        placed.write.partitionBy("cell").parquet(self.segments.folder("rows", name))
        self.segments.commit(at, {name: {"batches": [batch or name]}})
        return True

    def rows(self) -> DataFrame:
        """(iid, vec, cell, segment) of every vector."""
        return self.segments.read("rows", f"iid {self.id_type}, vec {self.vec_type}, cell long")

    def drop(self) -> None:
        self.segments.drop()

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, qid: str = "qid", qvec: str = "qvec",
               iid: str = "iid", exclude_self: bool = False) -> DataFrame:
        """(qid, iid, score, rank): the k items of largest inner product in the ``nprobe``
        best cells of each question (all, if None); score to 6 places, ties by item id."""
        known, out = self.centroids(), None
        schema = f"{qid} long, {iid} long, score double"
        asked = queries.filter(F.col(qvec).isNotNull()).select(F.col(qid).cast("long"), F.col(qvec).cast("array<double>"))
        for ids, vectors in _query_blocks(asked, self.QUERIES):
            scan, probes = self.rows().select("iid", "vec", "cell"), None
            if known is not None and nprobe is not None and nprobe < len(known[0]):
                s = np.round(vectors @ known[1].T, 6)
                best = np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
                probes = {int(known[0][c]): np.flatnonzero((best == c).any(axis=1)) for c in np.unique(best)}
                scan = scan.filter(F.col("cell").isin(sorted(probes)))  # the files of other cells are not listed
            sent = self.spark.sparkContext.broadcast((ids, vectors, probes))
            part = scan.mapInArrow(_scan_best(sent, k, exclude_self, qid, iid), schema)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], schema)
        return top_k(out, [qid], [F.desc("score"), iid], k)


def _query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == most:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def _scan_best(sent, k: int, exclude_self: bool, qid: str, iid: str):
    """A task's items against a block of questions: the k best of each question."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, probes = sent.value
        best_s = np.full((len(ids), k), -np.inf)
        best_i = np.zeros((len(ids), k), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                cell = b.column(2).to_numpy()
                item = b.column(0).to_numpy()
                x = _matrix(b.column(1))
                for c in np.unique(cell):
                    asking = np.arange(len(ids)) if probes is None else probes.get(int(c))
                    if asking is None:
                        continue
                    mine = np.flatnonzero(cell == c)
                    mine = mine[np.argsort(item[mine], kind="stable")]  # ties go by item id
                    s = np.round(vectors[asking] @ x[mine].T, 6)
                    if exclude_self:
                        s[ids[asking][:, None] == item[mine][None, :]] = -np.inf
                    better = s >= best_s[asking, -1][:, None]
                    for r in np.flatnonzero(better.any(axis=1)):
                        q, at = asking[r], np.flatnonzero(better[r] & np.isfinite(s[r]))
                        if len(at) > k:
                            kth = np.partition(s[r, at], len(at) - k)[len(at) - k]
                            at = at[s[r, at] >= kth]
                        score, found = np.append(best_s[q], s[r, at]), np.append(best_i[q], item[mine[at]])
                        top = np.lexsort((found, -score))[:k]
                        best_s[q], best_i[q] = score[top], found[top]
        q, at = np.nonzero(np.isfinite(best_s))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, at]), pa.array(best_s[q, at])], [qid, iid, "score"])
    return run


def _probes(vectors: DataFrame, vec: str, known: tuple[np.ndarray, np.ndarray], nprobe: int) -> DataFrame:
    """A row for each of the ``nprobe`` best cells of a vector, with the ``cell``, map-side."""
    cells, matrix = known
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType())])
    at = vectors.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                s = np.round(_matrix(b.column(at)) @ matrix.T, 6)
                best = s.argmax(axis=1)[:, None] if nprobe == 1 else np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
                rows = pa.array(np.repeat(np.arange(len(b)), best.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array(cells[best.ravel()])], schema.names)

    return vectors.filter(F.col(vec).isNotNull()).mapInArrow(run, schema)


def ivf_search(queries: DataFrame, items: DataFrame, centroids: DataFrame, k: int, nprobe: int,
               qid: str = "qid", iid: str = "iid", qvec: str = "qvec", ivec: str = "ivec",
               exclude_self: bool = False) -> DataFrame:
    """Cell-pruned search (E3) of a collection that is indexed for this call (see
    ``CellStore`` for one that is kept, asked a few questions): any number of questions,
    which go to their cells' tasks and not through the driver."""
    known = centroid_matrix(centroids)
    asked = _probes(queries.select(F.col(qid).cast("long"), F.col(qvec).cast("array<double>")), qvec, known, nprobe)
    placed = _probes(items.select(iid, ivec), ivec, known, 1)
    return dense_topk(asked, placed, k, qid, iid, qvec, ivec, "cell", exclude_self, finite=True)


# --- D1 -------------------------------------------------------------------------
def embed(df: DataFrame, text_col: str, out: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """Stand-in for the sentence encoder (D1): the analyser's terms, hashed
    to ``dim`` features by a portable hash, counted and L2-normalised, so
    chunks and questions lie in one space. Adds ``out`` (array<double>); a
    text without terms gets the zero vector. Map-only. Vectors made by a
    real model come in as a column instead."""
    names = [*df.columns, out]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                features, n = part.column(part.num_columns - 1), part.num_rows
                row = np.repeat(np.arange(n), np.diff(features.offsets.to_numpy()))
                v = np.bincount(row * dim + features.flatten().to_numpy(), minlength=n * dim).reshape(n, dim)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                unit = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, (v / np.maximum(norm, 1)).ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], unit], names)

    features = F.transform(F.coalesce(terms(text_col), F.array()), lambda t: (text_hash(t) % dim).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.withColumn("_features", features).mapInArrow(dense, schema)


def chunk_key(doc_id="doc_id", cont_id="cont_id") -> Column:
    """One BIGINT for a chunk, in (doc_id, cont_id) order; a document of 2**20
    chunks or more is an error, not a key of the next document."""
    key = (F.col(doc_id) * CHUNKS_PER_DOC + F.col(cont_id)).cast("bigint")
    return F.when(F.col(cont_id) < CHUNKS_PER_DOC, key).otherwise(F.raise_error(F.lit("a document has too many chunks for a key")))
