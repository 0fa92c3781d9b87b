"""MinHash near-dedup by DartMinHash.

A document is a weighted set: its five-word shingles, weighted by how often
they occur. Darts are thrown on (weight, rank) half-planes, one for each
shingle, as a Poisson process of unit density that depends on the shingle
alone. A dart hits if it lands under the shingle's weight; it belongs to a
random coordinate, and each of the ``COORDS`` coordinates keeps the earliest
hit. Two documents agree in a coordinate with probability equal to their
weighted Jaccard similarity. Only darts of rank below ``(t ln t + 2t) / total
weight`` are looked at (further ones only where a coordinate was missed), so
work is proportional to the shingles plus t log t, not their product.

Weights are cut into layers [0,1), [1,2), [2,4), ...; each layer's darts come in
rank order by exponential gaps, so a layer that is not hit costs one hash.

Coordinates are joined in ``BANDS`` bands of ``ROWS``; ``linkage`` verifies
pairs by exact weighted Jaccard and joins similar ones into classes.

Defined cases: null or wordless texts have an empty set; they are equal to each
other only if their texts are (null counts as empty) and near to nothing else.
Equal texts are always one class. Fewer than five words are one shingle. Words
are runs of non-white bytes, case kept. Repeated rows are one class; a null
doc_id sorts after all others. Extra columns are kept untouched by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import exact, free_name
from quarry.llm.linkage import classes, in_bloom
from quarry.llm.numtext import U, element_sets, expand, jaccard, mix, text_blocks, word_shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
COORDS = BANDS * ROWS


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 random bits."""
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _throw(row: np.ndarray, item: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray,
           coords: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, coordinate, rank, dart id) of all hits with low <= rank < high (both by row)."""
    layer = np.zeros(len(item), np.int64)
    while len(item):
        # layer 0 is the weight [0, 1); layer i from 1 on is [2**(i-1), 2**i)
        base = np.where(layer == 0, 0.0, 2.0 ** (layer - 1.0))
        width = np.where(layer == 0, 1.0, base)
        state = mix(item ^ mix(layer.astype(U) + U(1)))
        rank = np.zeros(len(item))
        alive = np.arange(len(item))
        while len(alive):
            rank[alive] -= np.log(_unit(state[alive])) / width[alive]
            alive = alive[rank[alive] < high[row[alive]]]
            if not len(alive):
                break
            dart = mix(state[alive] + U(0x51ED270B))
            hit = (base[alive] + width[alive] * _unit(mix(dart ^ U(0xA5A5A5A5))) < weight[alive]) & (rank[alive] >= low[row[alive]])
            at = alive[hit]
            yield row[at], (dart[hit] % U(coords)).astype(np.int64), rank[at], dart[hit]
            state[alive] = mix(state[alive])
        more = weight > np.where(layer == 0, 1.0, 2.0 * base)
        row, item, weight, layer = row[more], item[more], weight[more], layer[more] + 1


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, coords: int = COORDS) -> np.ndarray:
    """DartMinHash signature (rows x coords, 64-bit dart ids) of weighted sets
    given as (row, item hash, weight > 0) triples; a row without items is all 0."""
    best = np.full((rows, coords), np.inf)
    out = np.zeros((rows, coords), U)
    total = np.bincount(row, weight, rows)
    step = np.where(total > 0, (coords * np.log(coords) + 2 * coords) / np.where(total > 0, total, 1), 0.0)
    low, high = np.zeros(rows), step
    while len(row):
        hits = list(_throw(row, item, weight, low, high, coords))
        if hits:
            r, c, rank, dart = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(rank)[::-1]  # the earliest is written last
            r, c = r[order], c[order]
            seen = np.isfinite(best[r, c])  # from an earlier, lower range of ranks
            r, c, order = r[~seen], c[~seen], order[~seen]
            out[r, c] = dart[order]
            best[r, c] = rank[order]
        again = ~np.isfinite(best).all(axis=1)
        mine = again[row]
        row, item, weight = row[mine], item[mine], weight[mine]
        low, high = high, high + step
    return out


def _weighted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with counts, and the words of each row."""
    row, h, words = word_shingles(data, offs, SHINGLE)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(row))).astype(np.float64), words


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to the (key, node) of its bands."""
    for b in batches:
        node = b.column(0).to_numpy()
        _, once = np.unique(node, return_index=True)  # of a batch's copies one is enough
        once = np.sort(once)
        for i, j, data, offs in text_blocks(b.column(1)):
            pick = once[(once >= i) & (once < j)] - i
            row, item, weight, words = _weighted(data, offs)
            ok = np.zeros(j - i, bool)
            ok[pick] = True
            ok &= words > 0
            to = np.cumsum(ok) - 1
            mine = ok[row]
            sig = signatures(to[row[mine]], item[mine], weight[mine], int(ok.sum()))
            key = np.repeat(np.arange(1, BANDS + 1, dtype=U)[None, :], len(sig), axis=0)
            for r in range(ROWS):
                key = mix(key ^ sig[:, r::ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node[i:j][ok], BANDS))], ["key", "node"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of shingles as a set: the n-th copy of a shingle is an element of its own."""
    for b in batches:
        for i, j, data, offs in text_blocks(b.column(1)):
            row, item, weight, _ = _weighted(data, offs)
            of, copy = expand(weight.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), element_sets(row[of], mix(item[of] + copy.astype(U)), j - i)], ["node", "elements"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        ta, tb = b.column(2), b.column(3)
        at = 0
        size = pc.add(pc.binary_length(ta), pc.binary_length(tb)).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        while at < len(a):  # blocks of pairs by bytes, fewer than 65,536 each
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right"))
            stop = min(max(stop, at + 1), at + 60_000)
            sides = []
            for col in (ta, tb):
                g, h = [], []
                for i, j, data, offs in text_blocks(col.slice(at, stop - at)):
                    row, item, _ = word_shingles(data, offs, SHINGLE)
                    g.append(row + i)
                    h.append(item)
                sides += [np.concatenate(g), np.concatenate(h)]
            sim = jaccard(*sides, groups=stop - at, weighted=True)
            keep = sim >= SIMILARITY
            yield pa.RecordBatch.from_arrays([pa.array(a[at:stop][keep]), pa.array(c[at:stop][keep])], ["a", "b"])
            at = stop


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(node, root) of texts that are not their class's root, and the verified
    links (a, b); a node is the xxhash64 of a text."""
    nodes = docs.select(_node(exact(text)).alias("node"), exact(text).alias("text"))

    def texts(bloom: np.ndarray) -> DataFrame:
        def part(batches):
            for b in batches:
                node = b.column(0).to_numpy()
                yield b.filter(pa.array(in_bloom(bloom, node)))
        return nodes.filter("text is not null").mapInArrow(part, "node long, text string")

    return classes(nodes.filter("text is not null").mapInArrow(_band_rows, "key long, node long"), texts,
                   lambda p: p.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long"),
                   _elements)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class),
    class_size (rows), kept (the first row of its class; one of equal rows only)."""
    root, _ = text_classes(docs, text)
    rows = docs.select(exact(doc_id).alias("doc_id"), _node(exact(text)).alias("node"))
    # rows of a text are counted before anything is joined, so copies cost one row each map task
    by_text = (rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
               .join(root, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    by_class = by_text.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    known = by_text.select("node", "root").join(by_class, "root")
    out = rows.join(known, "node").select(
        "doc_id", "class_id", "class_size", "root",
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("top"))
    # only a class's rows of the smallest doc_id, repeated rows, are numbered
    nth = F.row_number().over(Window.partitionBy("root", F.when(~F.col("top"), F.xxhash64("doc_id", F.rand(7))))
                              .orderBy("doc_id"))
    return out.withColumn("kept", F.col("top") & (nth == 1)).drop("root", "top")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class left: the one of the smallest doc_id
    (of equal doc_ids, any one row). All columns are kept."""
    root, _ = text_classes(docs, text)
    node, rid, top = (free_name(docs, x) for x in ("node", "root", "top"))
    rows = docs.withColumn(node, _node(exact(text)))
    per_text = (rows.groupBy(exact(node).alias("node"))
                .agg(F.min(F.struct(exact(doc_id).isNull().alias("z"), exact(doc_id).alias("d"))).alias("f"))
                .join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = per_text.groupBy("root").agg(F.min(F.struct("f", "node")).alias("best"))
    keep = best.select(F.col("best.node").alias(node), F.col("best.f.d").alias(top))
    left = rows.join(keep, node).filter(exact(doc_id).eqNullSafe(exact(top))).drop(top)
    # rows alike in doc_id and text: one stays
    return left.dropDuplicates([doc_id, node]).select(*[exact(c) for c in docs.columns])
