"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes, each ``OVERLAP`` bytes over the
one before, so that they cover it whole. Bytes are embedded, ``FILTERS`` learned
filters of ``KERNEL`` bytes slide over each chunk, and each keeps its maximum.
The largest and the mean value over the chunks feed one logistic output.

Training: labelled rows are picked by the order of a hash of doc_id, half of
them of either label, ``SAMPLE`` rows and ``SAMPLE_CHUNKS`` chunks in all at most; rows of
over ``ROW_CHUNKS`` chunks are not picked. A picked text is learned from whole, so that the
mean over its chunks is the same measure as in scoring. This bounded sample is all that the
driver gets, and a step holds ``STEP_CHUNKS`` chunks at once. Of repeated ids with different
texts the first by hash is taken. Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from. The score
is corrected from the sample's share of labels to that of all labelled rows.
Scoring reads every text whole.

Defined cases: null and empty texts are one chunk of padding and get a score.
Labels that are null, neither 0 nor 1, or contradictory for one doc_id are not
used. With no labels every score is 0.5; with labels of one kind it is their
smoothed share. A null doc_id is not held out. Repeated rows get equal
scores. Other columns are never inputs; ``filter_quality`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import exact
from quarry.llm.numtext import expand, text_blocks

CHUNK, OVERLAP = 512, 64
KERNEL, STRIDE = 16, 4
WIDTH, FILTERS = 8, 32
SAMPLE = 4096
SAMPLE_CHUNKS = 32768
ROW_CHUNKS = 512
STEP_CHUNKS = 1024
EPOCHS, BATCH, RATE, DECAY = 24, 64, 0.005, 1e-4
THRESHOLD = 0.7

_POSITIONS = (CHUNK - KERNEL) // STRIDE + 1
_HOP = CHUNK - OVERLAP


def chunk_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start in the row) of every chunk of rows of ``size`` bytes."""
    count = np.maximum(1, -(-(size - OVERLAP) // _HOP))
    row, at = expand(count)
    return row, at * _HOP


def cut(data: np.ndarray, offs: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The chunks as a matrix of bytes, 0 beyond a row's end."""
    at = (offs[row] + start)[:, None] + np.arange(CHUNK)
    inside = at < offs[row + 1][:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class Network:
    """Parameters, forward pass and gradient steps (Adam)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
            "filter": rng.normal(0, (2 / (KERNEL * WIDTH)) ** 0.5, (KERNEL * WIDTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0
        self.shift = 0.0
        self.constant: float | None = None

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        flat = self.p["embed"][chunks].reshape(len(chunks), CHUNK * WIDTH)
        view = np.lib.stride_tricks.sliding_window_view(flat, KERNEL * WIDTH, axis=1)
        return view[:, :: STRIDE * WIDTH]

    def pooled(self, chunks: np.ndarray, keep: bool = False):
        """Each filter's largest value in each chunk, and its place."""
        w = self.windows(chunks)
        act = np.ascontiguousarray(w).reshape(-1, KERNEL * WIDTH) @ self.p["filter"] + self.p["bias"]
        act = act.reshape(len(chunks), _POSITIONS, FILTERS)
        if not keep:
            return np.maximum(act.max(axis=1), 0)
        at = act.argmax(axis=1)
        return np.maximum(np.take_along_axis(act, at[:, None, :], 1)[:, 0], 0), at, w

    def logit(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.concatenate([top, mean], axis=1) @ self.p["out"] + self.p["base"][0]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of a block."""
        rows = len(offs) - 1
        if self.constant is not None:
            return np.full(rows, self.constant)
        row, start = chunk_starts(np.diff(offs))
        top = np.zeros((rows, FILTERS), np.float32)
        total = np.zeros((rows, FILTERS), np.float64)
        for i in range(0, len(row), 256):
            r = row[i: i + 256]
            h = self.pooled(cut(data, offs, r, start[i: i + 256]))
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            top[r[first]] = np.maximum(top[r[first]], np.maximum.reduceat(h, first))
            total[r[first]] += np.add.reduceat(h.astype(np.float64), first)
        mean = total / np.bincount(row, minlength=rows)[:, None]
        return 1 / (1 + np.exp(-np.clip(self.logit(top, mean.astype(np.float32)) + self.shift, -30, 30).astype(np.float64)))

    def fit(self, chunks: np.ndarray, row: np.ndarray, label: np.ndarray, seed: int = 0) -> None:
        """chunks of row[i] (ascending), label by row (0 or 1)."""
        rng, n = np.random.default_rng(seed), len(label)
        first = np.searchsorted(row, np.arange(n + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, BATCH):
                docs = order[i: i + BATCH]
                sizes = first[docs + 1] - first[docs]
                grad: dict[str, np.ndarray] = {}
                # documents add up, so a batch of long ones is gone through in parts
                for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(np.cumsum(sizes) // STEP_CHUNKS)) + 1):
                    idx, pos = expand(sizes[part])
                    one = self.gradients(chunks[first[docs[part]][idx] + pos], idx, label[docs[part]])
                    for k, g in one.items():
                        grad[k] = grad.get(k, 0) + g * np.float32(len(part) / len(docs))
                t += 1
                for k, g in grad.items():
                    g = g + DECAY * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
                self.p["embed"][0] = 0

    def gradients(self, chunks: np.ndarray, row: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        h, at, w = self.pooled(chunks, keep=True)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        count = np.diff(np.append(first, len(row)))[:, None]
        top = np.maximum.reduceat(h, first)
        mean = np.add.reduceat(h, first) / count
        x = np.concatenate([top, mean], axis=1)
        err = ((1 / (1 + np.exp(-np.clip(self.logit(top, mean), -30, 30)))) - label).astype(np.float32) / len(label)
        back = err[:, None] * self.p["out"][None, :]
        is_top = h == top[row]
        ties = np.maximum(np.add.reduceat(is_top.astype(np.float32), first), 1)
        gh = back[row, :FILTERS] * is_top / ties[row] + (back[:, FILTERS:] / count)[row]
        gh = np.where(h > 0, gh, 0).astype(np.float32)
        n = np.arange(len(chunks))[:, None]
        won = w[n, at]  # chunk x filter x (kernel * width)
        g_embed = np.zeros_like(self.p["embed"])
        to = (gh[:, :, None] * self.p["filter"].T[None]).reshape(len(chunks), FILTERS, KERNEL, WIDTH)
        bytes_at = chunks[n[:, :, None], at[:, :, None] * STRIDE + np.arange(KERNEL)]
        for d in range(WIDTH):
            g_embed[:, d] = np.bincount(bytes_at.ravel(), to[..., d].ravel(), 256)
        return {"embed": g_embed, "filter": np.einsum("nf,nfk->kf", gh, won), "bias": gh.sum(axis=0),
                "out": err @ x, "base": err.sum(keepdims=True)}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to all chunks of each row, as bytes."""
    for b in batches:
        for i, j, data, offs in text_blocks(b.column(2)):
            row, start = chunk_starts(np.diff(offs))
            k = np.arange(len(row)) - np.searchsorted(row, np.arange(j - i))[row]
            for at in range(0, len(row), 4096):
                r = row[at: at + 4096]
                x, take = cut(data, offs, r, start[at: at + 4096]), pa.array(r + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(k[at: at + 4096].astype(np.int64)),
                     pa.array([c.tobytes() for c in x], pa.binary())], ["id", "label", "k", "chunk"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> Network:
    """Fit on the bounded sample of labelled rows that are not held out."""
    known = (labels.select(exact(doc_id).alias("id"), exact(label).alias("label"))
             .filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .filter("label = other").select("id", F.col("label").cast("int").alias("label")))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    net = Network()
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not n0 or not n1:
        net.constant = (n1 + 1) / (n0 + n1 + 2)
        return net
    order = [F.xxhash64("id"), F.col("id")]
    half = lambda k: known.filter(F.col("label") == k).orderBy(*order).limit(SAMPLE // 2)
    picked = half(0).unionByName(half(1))
    # at most SAMPLE ids, so the broadcast is bounded
    rows = (docs.select(exact(doc_id).alias("id"), exact(text).alias("text"))
            .join(F.broadcast(picked), "id").select("id", "label", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    chunks = F.greatest(F.lit(1), F.ceil((size - OVERLAP) / _HOP))
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    sizes = (rows.groupBy("id", "label").agg(F.min(F.struct(version.alias("version"), chunks.alias("n"))).alias("v"))
             .filter(F.col("v.n") <= ROW_CHUNKS))
    so_far = F.sum("v.n").over(Window.partitionBy("label").orderBy(*order))
    taken = (sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_CHUNKS // 2)
             .select("id", F.col("v.version").alias("version")))
    kind = rows.schema["id"].dataType.simpleString()
    got = (rows.withColumn("version", version).join(F.broadcast(taken), ["id", "version"])
           .select("id", "label", "text").mapInArrow(_whole, f"id {kind}, label int, k long, chunk binary")
           .dropDuplicates(["id", "k"]).toArrow().sort_by([("id", "ascending"), ("k", "ascending")]))
    if not got.num_rows:
        net.constant = (n1 + 1) / (n0 + n1 + 2)
        return net
    x = np.frombuffer(b"".join(got["chunk"].to_pylist()), np.uint8).reshape(-1, CHUNK)
    ids = got["id"].combine_chunks().dictionary_encode().indices.to_numpy()
    y = got["label"].to_numpy()[np.searchsorted(ids, np.arange(ids[-1] + 1))].astype(np.float32)
    net.fit(x, ids, y)
    m1 = float(y.sum())
    m0 = len(y) - m1
    if m0 and m1:
        net.shift = float(np.log(n1 / n0) - np.log(m1 / m0))
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [net.scores(data, offs) for _, _, data, offs in text_blocks(b.column(2))]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["doc_id", "held_out", "score"])

    src = docs.select(exact(doc_id).alias("doc_id"), held_out(exact(doc_id)).alias("held_out"), exact(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return (src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def filter_quality(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the network rejects; null and empty texts are
    scored like others, and repeated rows go or stay together."""
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [net.scores(data, offs) for _, _, data, offs in text_blocks(b.column(text_at))]
            yield b.filter(pa.array((np.concatenate(got) if got else np.zeros(0)) >= THRESHOLD))

    # columns go by place: their names may hold dots or clash but for case
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
