"""From banded signatures to verified classes, shared by the two MinHash operators.

Items are *nodes*: 64-bit content hashes, so equal items are one node from the
start and a group of exact copies never meets as a group. The steps:

1. ``first_pairs``: band rows are dealt by band key and streamed in the order of it;
   each node is paired with its bucket's first node (the hub) and with
   the node before it. Two pairs for each member, not all pairs, and the
   state is a bounded part of a bucket whatever it holds.
2. Pairs that cannot be similar go: a node has its number of shingles and a bitmap of them,
   and a bit that only one of a pair has is a shingle that only that one has
   (``possible``). What that leaves of the similarity is no less than the true one, so no
   similar pair goes; the texts are joined to the others alone.
   Exact similarity of these; then union-find over the pairs that hold.
3. Buckets whose members are not yet all in one component are streamed again, with
   its text to each node, of which the task makes the set of 32-bit shingle hashes: a node is held against
   the bucket's first ``HUBS`` nodes, by bitmaps and by an inverted list of many, and goes to the exact check
   with the most similar one of each other component (within ``CLOSE``, a little
   under the similarity sought). Nodes beyond the hubs form the bucket anew,
   under eight times as many, until none is left. No bucket, member or
   round is dropped, and no more than verified links and members are ever rows.

A fixed-size Bloom filter over the paired nodes spares the shuffle the texts of
unpaired items. It only saves work: joins decide, so at a scale where it
saturates the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, exact, free_name, materialise
from quarry.llm.numtext import U, expand, mix

BLOOM_BITS = 1 << 24
BLOOM_HASHES = 4
MAP_BITS = 1 << 26
CLOSE = 0.79
HUBS = 512
HUB_ELEMENTS = 1 << 22
HELD = 1 << 20
SKETCH = 12  # the power of two of a sketch's bits
LISTED = 256  # hubs from which they are held in an inverted list
EDGES = 200_000


def _positions(node: np.ndarray) -> np.ndarray:
    h = mix(node.view(U) if node.dtype == np.int64 else node)
    step = mix(h) | U(1)
    return np.concatenate([(h + step * U(i)) % U(BLOOM_BITS) for i in range(BLOOM_HASHES)]).astype(np.int64)


def in_bloom(bloom: np.ndarray, node: np.ndarray) -> np.ndarray:
    pos = _positions(node).reshape(BLOOM_HASHES, -1)
    return ((bloom[pos >> 6] >> (pos & 63).astype(U)) & U(1)).all(axis=0)


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """Bloom filter (2 MB, whatever the table's size) of the ``node`` column."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS >> 6, U)
        for b in batches:
            pos = _positions(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, pos >> 6, U(1) << (pos & 63).astype(U))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    words = (nodes.select("node").mapInArrow(part, "at long, bits long")
             .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(BLOOM_BITS >> 6, U)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(U)
    return out


def bitmap_of(rows: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a bitmap (8 MB, whatever the table's size) of the hashes of ``key``, for ``told_apart``."""
    at = F.pmod(F.xxhash64(exact(key)), F.lit(MAP_BITS))
    return (rows.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")))


def told_apart(rows: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two, without a shuffle: all whose ``key`` is in the bitmap's table, with a few others, and the rest."""
    bucket, held = free_name(rows, "bucket"), free_name(rows, "bits")
    at = F.pmod(F.xxhash64(exact(key)), F.lit(MAP_BITS))
    bit = F.bitmap_bit_position(at).cast("int")
    x = (rows.withColumn(bucket, F.bitmap_bucket_number(at))
         .join(F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held))), bucket, "left"))
    byte = F.conv(F.hex(F.substring(exact(held), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    return x.filter(one).drop(bucket, held), x.filter(~one).drop(bucket, held)


def _bucket_pairs(key: np.ndarray, node: np.ndarray, before: tuple[int, int, int] | None):
    """The pairs (key, hub, node) of rows in order of key, and (key, hub, last node) of the last bucket.
    ``before``: what this said of an earlier part of the first bucket."""
    goes_on = before is not None and len(key) > 0 and before[0] == key[0]
    same = key[1:] == key[:-1]
    several = np.append(False, same) | np.append(same, False)  # a bucket of one row has no pair
    if goes_on:
        several |= key == key[0]
    key, node = key[several], node[several]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    if len(key):
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node = key[new], node[new]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    hub = node[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(key) else node
    prev = np.append(node[:1], node[:-1])
    if goes_on:
        hub[key == key[0]], prev[0], head[0] = before[1], before[2], False
    x = np.flatnonzero(~head & (hub != node))
    y = np.flatnonzero(~head & (prev != hub) & (prev != node))
    pairs = pa.RecordBatch.from_arrays([pa.array(np.append(key[x], key[y])), pa.array(np.append(hub[x], prev[y])),
                                        pa.array(np.append(node[x], node[y]))], ["key", "hub", "node"])
    return pairs, (int(key[-1]), int(hub[-1]), int(node[-1])) if len(key) else None


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) rows in order of key to (key, hub, node): each node but the first of a
    bucket with the bucket's first and with the one before it. A bucket's nodes are put in order
    here, HELD distinct ones at a time: of a larger bucket, the first and the one before are
    those so far."""
    key, node, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for b in batches:
        key, node = (np.append(x, b.column(i).to_numpy()) for i, x in enumerate((key, node)))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
        if last:
            yield _bucket_pairs(key[:last], node[:last], before)[0]
            key, node, before = key[last:], node[last:], None
        if len(node) > HELD:
            node = np.sort(node)
            node = node[np.append(True, node[1:] != node[:-1])]
            key = np.full(len(node), key[0])
            if len(node) > HELD // 2:
                pairs, before = _bucket_pairs(key, node, before)
                yield pairs
                key, node = key[:0], node[:0]
    if len(key):
        yield _bucket_pairs(key, node, before)[0]


def first_pairs(bands: DataFrame) -> DataFrame:
    """(key, hub, node) pairs of each bucket; ``bands`` has (key, node), repeats allowed."""
    # Spark sorts by one number several times as fast as by two
    return (bands.select("key", "node").repartition("key").sortWithinPartitions("key")
            .mapInArrow(_first_pairs, "key long, hub long, node long"))


def _flat_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all rows, offsets of the rows) of a column of sets as bytes."""
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64) // 4 if len(col) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[4 * o[0]: 4 * o[-1]].view(np.uint32), o - o[0]


def _bit_rows(flat: np.ndarray, offs: np.ndarray, power: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, bytes) of the rows' bitmaps of 2 ** power bits, one after another, some rows at a time."""
    ends = np.cumsum(1 << power)
    at = 0
    while at < len(power):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 23), "right")))
        k, e = power[at:stop], flat[offs[at]: offs[stop]]
        n = np.diff(offs[at: stop + 1])
        start = np.cumsum(1 << k) - (1 << k)
        bits = np.zeros(int((1 << k).sum()), bool)
        bits[np.repeat(start, n) + (mix(e.astype(U)) >> np.repeat(64 - k, n).astype(U)).astype(np.int64)] = True
        yield at, stop, np.packbits(bits)
        at = stop


class _Hubs:
    """The first nodes of the open bucket, with their elements in one inverted list."""

    def __init__(self, most: int):
        self.most, self.nodes, self.roots, self.sets, self.elements = most, [], [], [], 0
        self._facts = np.zeros((8, 3), np.int64)  # root, size, bits of each hub's sketch
        self._bits = np.zeros((8, 1 << (SKETCH - 6)), U)
        self._list = None

    def full(self) -> bool:
        return len(self.nodes) >= self.most or self.elements >= HUB_ELEMENTS

    def add(self, node: int, root: int, elements: np.ndarray, sketch: np.ndarray, ones: int) -> None:
        n = len(self.nodes)
        if n == len(self._facts):
            self._facts, self._bits = (np.concatenate([x, np.zeros_like(x)]) for x in (self._facts, self._bits))
        self._facts[n], self._bits[n] = (root, len(elements), ones), sketch
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(elements)
        self.elements += len(elements)

    def _perhaps(self, known: int, root: int, mine: int, sketch: np.ndarray, ones: int) -> np.ndarray:
        """The hubs from ``known`` on, of other roots, that may be similar enough: a bit that one of two
        sketches has alone is an element that the other has not."""
        n = len(self.nodes)
        roots, size, theirs = self._facts[known:n].T
        at = np.flatnonzero((roots != root) & (np.minimum(size, mine) >= CLOSE * np.maximum(size, mine)))
        if not len(at):
            return at
        size, theirs = size[at], theirs[at]
        both = np.bitwise_count(self._bits[known + at] & sketch).sum(axis=1, dtype=np.int64) + np.minimum(mine - ones, size - theirs)
        return known + at[both >= CLOSE * (size + mine - both)]

    def similar(self, root: int, elements: np.ndarray, sketch: np.ndarray, ones: int) -> list[int]:
        """Of each other root, the hub most similar to a node, if that is similar enough. ``sketch``:
        a bitmap of the elements, of ``ones`` bits."""
        n, mine = len(self.sets), len(elements)
        known = self._list[3] if self._list else 0
        if n - known > LISTED + known // 8:  # fewer new hubs are held against one by one
            flat = np.concatenate(self.sets)
            of = np.repeat(np.arange(n), [len(x) for x in self.sets])
            order = np.argsort(flat, kind="stable")
            self._list = flat[order], of[order], np.array([len(x) for x in self.sets]), n
            known = n
        near: list[tuple[float, int]] = []
        if known:
            flat, of, size, _ = self._list
            lo, hi = np.searchsorted(flat, elements, "left"), np.searchsorted(flat, elements, "right")
            idx, pos = expand(hi - lo)
            both = np.bincount(of[lo[idx] + pos], minlength=known)
            sim = both / np.maximum(size + mine - both, 1)
            near = [(sim[j], int(j)) for j in np.flatnonzero(sim >= CLOSE)]
        for j in self._perhaps(known, root, mine, sketch, ones).tolist():
            size = len(self.sets[j])
            at = np.minimum(np.searchsorted(self.sets[j], elements), size - 1)
            both = int((self.sets[j][at] == elements).sum())
            if both >= CLOSE * (size + mine - both):
                near.append((both / (size + mine - both), j))
        best: dict[int, tuple[float, int]] = {}
        for sim, j in near:
            r = self.roots[j]
            if r != root and (r not in best or sim > best[r][0]):
                best[r] = sim, j
        return [self.nodes[j] for _, j in best.values()]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, elements) to (node, n, bits): how many elements, and a bitmap of two to four
    bits for each; a bitmap of half as many bits is that of its neighbouring bits."""
    for b in batches:
        flat, offs = _flat_sets(b.column(1))
        n = np.diff(offs)
        power = np.clip(np.ceil(np.log2(2 * n + 1)).astype(np.int64), 6, 16)
        bits = [x for _, _, x in _bit_rows(flat, offs, power)]
        ends = np.append(0, np.cumsum(1 << power) >> 3).astype(np.int64)
        bits = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *bits]))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), bits.cast(pa.binary())], ["node", "n", "bits"])


def _unpacked(col: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """0 and 1 of the bitmaps of ``size`` bits or twice as many."""
    raw = np.frombuffer(b"".join(col.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
    bits = np.unpackbits(raw, axis=1)
    return bits if bits.shape[1] == size else bits.reshape(len(at), size, 2).max(axis=2)


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n_a, bits_a, n_b, bits_b) the (a, b) whose similarity may reach ``CLOSE``."""
    for b in batches:
        n_a, n_b = (b.column(i).to_numpy().astype(np.int64) for i in (2, 4))
        size = [pc.multiply(pc.binary_length(b.column(i)), 8).to_numpy().astype(np.int64) for i in (3, 5)]
        keep = np.minimum(n_a, n_b) >= CLOSE * np.maximum(n_a, n_b)
        low, high = np.minimum(*size), np.maximum(*size)
        keep &= high <= 2 * low  # as n is alike
        for bits in np.unique(low[keep]).tolist():
            mine = np.flatnonzero(keep & (low == bits))
            # both of a size, or one of twice the size
            for wide in ((size[0] == bits) & (size[1] == bits), size[0] > bits, size[1] > bits):
                some = mine[wide[mine]]
                step = max(1, (1 << 22) // bits)
                for i in range(0, len(some), step):
                    at = some[i: i + step]
                    x, y = (_unpacked(b.column(c), at, bits) for c in (3, 5))
                    both = np.minimum(n_a[at] - (x > y).sum(axis=1), n_b[at] - (y > x).sum(axis=1))
                    keep[at] = both >= CLOSE * (n_a[at] + n_b[at] - both)
        yield b.select([0, 1]).filter(pa.array(keep))


def _close_pairs(hubs: int):
    """Sorted (key, node, root, elements) rows to (key, hub, node, rest): a node with
    the most similar of its bucket's first ``hubs`` nodes, one of each other
    root; and, as rest, the nodes after those, which are still to be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, _Hubs(hubs)
        for b in batches:
            out: list[tuple[int, int, int, bool]] = []
            flat, offs = _flat_sets(b.column(3))
            names = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for lo, hi, packed in _bit_rows(flat, offs, np.full(len(names), SKETCH)):
                packed = packed.view(U).reshape(hi - lo, -1)
                ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64).tolist()
                for i in range(lo, hi):
                    key, node, root = names[i]
                    if key != open_key:
                        open_key, held = key, _Hubs(hubs)
                    mine = flat[offs[i]: offs[i + 1]], packed[i - lo], ones[i - lo]
                    out += [(key, h, node, False) for h in held.similar(root, *mine)] if held.nodes else []
                    if held.full():
                        out.append((key, node, node, True))
                    else:
                        held.add(node, root, *mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "hub", "node", "rest"])
    return run


def _star(small: bool):
    """One star step over (a, b) rows sorted by both: the first b of an a is the
    smallest, so a and its other neighbours are joined to min(a, b) as they
    pass. A large star joins only the neighbours above a; a small star,
    whose rows all point down, joins a too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)  # a, b, root of the last row
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(a):
                continue
            new = np.append((a[0], b[0]) != last[:2], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            a, b = a[new], b[new]
            if not len(a):
                continue
            head = np.append(a[0] != last[0], a[1:] != a[:-1])
            start = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            root = np.minimum(a, b)[start]
            if not head[0]:
                root[: int(np.argmax(head)) if head.any() else len(a)] = last[2]
            last = (a[-1], b[-1], root[-1])
            if small:
                child, top = np.append(b, a[head]), np.append(root, root[head])
            else:
                child, top = b[b > a], root[b > a]
            keep = child != top
            yield pa.RecordBatch.from_arrays([pa.array(child[keep]), pa.array(top[keep])], ["a", "b"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """Union-find by alternating large and small stars: (node, root) for each
    node of ``edges`` (a, b), roots themselves excepted; the root is the
    component's smallest node. A step is one shuffle and a stream of constant
    state, whatever a node's degree; each round is written to the shared folder,
    and takes a task for every EDGES rows."""
    def step(e: DataFrame, small: bool, tasks: int) -> DataFrame:
        return (e.repartition("a").coalesce(tasks).sortWithinPartitions("a", "b")
                .mapInArrow(_star(small), "a long, b long"))

    e, state, made = edges.select("a", "b"), (edges.count(), None), False
    while True:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
                                  ).alias("p")).select("p.a", "p.b")
        tasks = 1 + state[0] // EDGES
        after = materialise(step(step(both, False, tasks), True, tasks), "edges")
        if made:
            discard(e)
        e, made = after, True
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._llm_path = e._llm_path
            return out
        state = now


def classes(bands: DataFrame, texts: Callable[[np.ndarray], DataFrame], similar: Callable[[DataFrame], DataFrame],
            elements: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> tuple[DataFrame, DataFrame]:
    """Classes of nodes linked by similar pairs that share a band.

    bands: (key, node). texts(bloom): a (node, text) table, a row for each node in the
    filter at least. similar: keeps the similar rows of (a, b, text_a, text_b), as (a, b).
    elements: batches of (node, text) to (node, elements), in order: the distinct 32-bit hashes
    of the set whose Jaccard similarity is meant, ascending, as bytes.

    Returns (node, root) of nodes whose root is another node, and the verified
    links (a, b)."""
    members = materialise(first_pairs(bands), "members")
    pairs = lambda m: (m.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
                       .distinct())
    todo = materialise(pairs(members), "pairs")
    nodes = todo.select(F.explode(F.array("a", "b")).alias("node"))
    held = materialise(texts(bloom_of(nodes)).groupBy("node").agg(F.first("text").alias("text"))
                       .join(nodes.distinct(), "node", "left_semi"), "texts")

    def verified(p: DataFrame) -> DataFrame:
        side = lambda s: held.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
        return materialise(similar(p.join(side("b"), "b").join(side("a"), "a")), "links")

    def alike(p: DataFrame) -> DataFrame:
        bits = materialise(held.select("node", "text").mapInArrow(elements, "node long, elements binary")
                           .mapInArrow(_bitmaps, "node long, n int, bits binary"), "bits")
        side = lambda s: bits.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
        out = materialise(p.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
                          .mapInArrow(possible, "a long, b long"), "pairs")
        discard(bits)
        discard(p)
        return out

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, node, root, text) to (key, node, root, elements)."""
        for b in batches:
            at = 0
            for e in elements(iter([b.select([1, 3])])):
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(e)) for i in range(3)), e.column(1)],
                                                 ["key", "node", "root", "elements"])
                at += len(e)

    def divided(rows: DataFrame, least: int) -> DataFrame:
        """(key, node, root) rows of the buckets of ``least`` nodes or more that have several roots."""
        rows = rows.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        several = (rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
                   .filter(f"low != high and n >= {least}"))
        return rows.join(several.select("key"), "key", "left_semi")

    todo = alike(todo)
    links = verified(todo)
    discard(todo)
    root = components(links)
    # of two or three nodes every pair has been checked: hub, and node before
    left = divided(members.select("key", F.explode(F.array("hub", "node")).alias("node")).distinct(), 4)
    hubs, source = HUBS, members
    while True:
        left = materialise(left, "divided")
        discard(source)  # all that ``left`` was made of, but for the links and roots
        if left.isEmpty():
            break
        # a text is fewer bytes than its hashes, so these are made where they are held against others
        closest = _close_pairs(hubs)
        close = materialise(left.join(held, "node").select("key", "node", "root", "text")
                            .repartition("key").sortWithinPartitions("key", "node")
                            .mapInArrow(lambda rows: closest(with_sets(rows)),  # noqa: B023
                                        "key long, hub long, node long, rest boolean"), "members")
        discard(left)
        found = verified(pairs(close.filter("not rest")))
        if not found.isEmpty():
            links, before = links.unionByName(found), root
            root = components(links)
            discard(before)
        source, left, hubs = close, divided(close.filter("rest").select("key", "node"), 2), hubs * 8
    for done in (left, held):
        discard(done)
    return root, links
