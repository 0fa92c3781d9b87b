"""Conflict-constrained best-fit packing.

Documents fill sequences (bins) of ``CAPACITY`` words. No bin holds two pieces of
one source or of one duplicate cluster. A document longer than a bin is cut
into full bins and a rest. Pieces are placed by decreasing size into the open
bin with the least room that fits and has no conflict; else a bin is opened.

Bins carry a bitmap of their sources and clusters, and are ordered by the room left
in a tree whose nodes hold the intersection of the bitmaps below. The successor
search goes to the tightest bin with room enough and on to the next one until
one is compatible, stepping over any subtree all of whose bins have the conflict.

Rows are dealt into shards of about ``SHARD_ROWS`` by a hash of the row, whatever
their source, so a hot source or cluster meets only a bounded share of itself;
the number of shards grows with the rows. Lengths and keys are shuffled, texts not.

Defined cases: null and wordless texts are one piece of 0 words in no bin (null
bin_id). A null source or cluster conflicts with nothing. Repeated rows are
packed each on its own. Ties are broken by doc_id, nulls last.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import exact

CAPACITY = 2048
SHARD_ROWS = 4096


class Bins:
    """Open bins, ordered by the room they have left."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.all = [-1] * (2 * self.n)  # intersection of the bitmaps below; no bin: every bit
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # room: bitmap: bins

    def _update(self, room: int) -> None:
        both = -1
        for bits in self.at[room]:
            both &= bits
        i = room + self.n
        self.all[i] = both
        i >>= 1
        while i:
            self.all[i] = self.all[2 * i] & self.all[2 * i + 1]
            i >>= 1

    def add(self, room: int, bits: int, name: int) -> None:
        if room:  # a full bin is closed
            self.at[room].setdefault(bits, []).append(name)
            self._update(room)

    def take(self, size: int, bits: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Remove and return (room, bitmap, bin) of the tightest bin with room
        for ``size`` whose bitmap has none of the single bits ``bits``."""
        stack = [(1, 0, self.n)]
        while stack:
            node, lo, width = stack.pop()
            both = self.all[node]
            if lo + width <= size or both == -1 or any(both & b for b in bits):
                continue
            if width > 1:
                half = width // 2
                stack.append((2 * node + 1, lo + half, half))
                stack.append((2 * node, lo, half))
                continue
            for have, names in self.at[lo].items():
                if not any(have & b for b in bits):
                    name = names.pop()
                    if not names:
                        del self.at[lo][have]
                        self._update(lo)
                    return lo, have, name
        return None


def pack(size: np.ndarray, source: list, cluster: list, order: np.ndarray, capacity: int = CAPACITY):
    """Arrays (row, piece, start, words, bin, offset) of the packing of one shard;
    ``order`` ranks the rows among equal sizes. The bin is -1 for empty rows."""
    full, rest = size // capacity, size % capacity
    row = np.repeat(np.arange(len(size)), full)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    out = [row, piece, piece * capacity, np.full(len(row), capacity), np.arange(len(row)), np.zeros(len(row), np.int64)]
    bins, count = Bins(capacity), len(row)
    bit: dict = {}
    for s in source:
        if s is not None:
            bit.setdefault(("source", s), 1 << len(bit))
    for c, k in Counter(c for c, r in zip(cluster, rest, strict=True) if c is not None and r).items():
        if k > 1:  # a cluster of one conflicts with nothing
            bit.setdefault(("cluster", c), 1 << len(bit))
    more = []
    for i in sorted(range(len(size)), key=lambda i: (-rest[i], order[i])):
        n, start = int(rest[i]), int(full[i] * capacity)
        if not n:
            if not size[i]:
                more.append((i, 0, 0, 0, -1, 0))
            continue
        mine = tuple(b for b in (bit.get(("source", source[i])), bit.get(("cluster", cluster[i]))) if b)
        got = bins.take(n, mine)
        room, bits, name = got if got else (capacity, 0, count)
        count += got is None
        more.append((i, int(full[i]), start, n, name, capacity - room))
        bins.add(room - n, bits | sum(mine), name)
    extra = np.array(more, np.int64).reshape(-1, 6)
    return [np.concatenate([a, extra[:, k]]) for k, a in enumerate(out)]


def words(text: Column) -> Column:
    """Runs of non-white characters of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_fit(docs: DataFrame, doc_id: str = "doc_id", size: Column | None = None, source: str | None = "source",
             cluster: Column | None = None, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start (first word), n_words, bin_id (null
    for empty rows), bin_offset, content (hash of the whole text, null for null). ``size`` defaults to the words of ``text``,
    ``cluster`` to its content hash (copies conflict)."""
    t = exact(text)
    src = docs.select(
        exact(doc_id).alias("doc_id"), (words(t) if size is None else size).alias("size"),
        (exact(source).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        _content(t).alias("content"), (_content(t) if cluster is None else cluster).alias("cluster"))
    rows = docs.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    # of equal ids the cluster and size decide, so a task run anew deals alike
    src = src.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "size"), F.lit(shards)))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "cluster", "size", "content")])
        got = pack(t["size"].to_numpy(), t["source"].to_pylist(), t["cluster"].to_pylist(), np.arange(t.num_rows), capacity)
        row, piece, start, n, bin_, off = (pa.array(x.astype(np.int64)) for x in got)
        name = pa.array((key[0].as_py() << 32) + got[4], pa.int64(), mask=got[4] < 0)
        return pa.table([t["doc_id"].take(row), piece, start, n, name, off, t["content"].take(row)],
                        ["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset", "content"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.groupBy("shard").applyInArrow(
        run, f"doc_id {kind}, piece long, start long, n_words long, bin_id long, bin_offset long, content long")


def _content(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def sequences(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bin_id, doc_ids, text) of the bins: their pieces' words in order, by one
    space. A bin is bounded by its capacity. A piece finds its text by doc_id and content, so
    rows that repeat a doc_id, with the same text or another, and null doc_ids are each themselves."""
    w = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w")
    texts = (docs.select(exact(doc_id).alias("id"), _content(exact(text)).alias("hash"), exact(text).alias("t"))
             .filter("hash is not null").dropDuplicates(["id", "hash"]).select("id", "hash", w))
    part = (placed.filter("bin_id is not null")
            .join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("hash")))
            .select("bin_id", "bin_offset", "doc_id", F.array_join(F.expr("slice(w, cast(start + 1 as int), cast(n_words as int))"), " ").alias("t")))
    whole = part.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "t"))).alias("p"))
    return whole.select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.array_join(F.col("p.t"), " ").alias("text"))
