"""The stores that queries over one corpus share: built once, searched many times.

A store belongs to a data folder in the state it was read in: its key holds the
files' names, sizes and times, so changed tables get stores of their own. It
lives under the shared folder for as long as that does (``release_intermediates``
deletes it, and the next query builds it anew).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.fixed import CHUNK_SIZE
from quarry.operators import chunk
from quarry.operators import vectors as V
from quarry.operators.lexical import LexicalStore
from quarry.session import load_table, passing, shared_dir, write_once

_OPEN: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = list(fs.listStatus(p))
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in status))


def _alive(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def stored(spark: SparkSession, sf_dir: str, what: str, tables: tuple[str, ...], build: Callable[[str], None]) -> str:
    """The folder of the store ``what`` for the present state of ``tables``; ``build``
    fills a fresh folder if there is none yet."""
    state = tuple(_files(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, what, sf_dir, state)
    path = _OPEN.get(key)
    if path is None or not _alive(spark, path):
        path = shared_dir(spark, what)
        build(path)
        _OPEN[key] = path
    return path


def stored_table(spark: SparkSession, sf_dir: str, what: str, tables: tuple[str, ...], rows: Callable[[], DataFrame]) -> DataFrame:
    """``rows()`` as a stored table; what ``rows`` materialised on the way goes once it is written."""
    def build(path: str) -> None:
        with passing(spark):
            write_once(rows(), path)
    return spark.read.parquet(stored(spark, sf_dir, what, tables, build))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, cont_id, content, chunk_id) of every window of every document: cut where
    the documents are read, so that no second copy of their texts is kept."""
    return chunk.chunk_windows(load_table(spark, sf_dir, "documents"), size=CHUNK_SIZE).withColumn("chunk_id", V.chunk_key())


def lexical_store(spark: SparkSession, sf_dir: str) -> LexicalStore:
    """Posting lists of the chunk table."""
    def build(path: str) -> None:
        chunks = chunk_table(spark, sf_dir)
        LexicalStore.create(spark, path, chunks).append(chunks, batch="documents")
    return LexicalStore(spark, stored(spark, sf_dir, "lexical-store", ("documents",), build))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> V.CellStore:
    """The encoded chunks, by chunk_id."""
    def build(path: str) -> None:
        items = V.embed(chunk_table(spark, sf_dir).select("chunk_id", "content"), "content", "vec").select("chunk_id", "vec")
        V.CellStore.create(spark, path, items, "chunk_id", "vec").append(items, "chunk_id", "vec", batch="documents")
    return V.CellStore(spark, stored(spark, sf_dir, "chunk-vectors", ("documents",), build))


def label_cells(spark: SparkSession, sf_dir: str) -> V.CellStore:
    """The ``embeddings`` table by cells whose centroids are the labels' mean vectors."""
    def build(path: str) -> None:
        e = load_table(spark, sf_dir, "embeddings")
        store = V.CellStore.create(spark, path, e, "vec_id", "embedding", V.label_centroids(e, "label", "embedding"))
        store.append(e, "vec_id", "embedding", batch="embeddings")
    return V.CellStore(spark, stored(spark, sf_dir, "label-cells", ("embeddings",), build))
