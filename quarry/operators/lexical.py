"""Full-text ranking over a chunk table (E4-E7), from a store that is built once
and appended to (A14, A16).

``LexicalStore`` keeps posting lists. The terms of each run of up to ``SHARD``
chunks of a task are turned into one shard: a row for each of its terms with the places of the
chunks that hold it, and one row without a term that holds the chunks' lengths and keys, once. An append tokenizes the new chunks only and shuffles
nothing; a long document's chunks are simply several shards. Everything that
ranking needs merges over shards and segments: N and the length sum are kept in the
manifest, ``df`` and ``cf`` are sums of columns. ``compact`` merges small shards.
A shard is a file of one row group, so the task that reads it has it whole.

A search runs no tokenizer on the corpus and shuffles no postings: the question
terms (in blocks of bounded size) select posting lists where they are read, and each
question's sums stay in that task; only its k best chunks of a task's shards leave,
and many questions are searched by few tasks.
A shard holds a bounded number of chunks and terms however hot a term or a document is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.fixed import LEXICAL_TOPK
from quarry.functions.text import terms
from quarry.plans.strategy import _checkpointed, top_k
from quarry.session import shared_dir
from quarry.sources.segments import Segments

K1 = 1.2
B = 0.75
SHARD = 8192
SHARD_TERMS = 1 << 21
ROW_GROUP = 1 << 30  # far beyond a shard's bytes
BLOCK_TERMS = 1_000_000
GROUP_POSTS = 1 << 20  # postings a task searches at a time
SEARCH_TASKS = 16  # of a block, at least
SEARCH_ROWS = 1 << 20  # that a block's tasks let out, if those are more
BITS = 1 << 26


def query_terms(questions: DataFrame, qid: str, text_col: str) -> DataFrame:
    return (questions.select(qid, F.explode_outer(terms(text_col)).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy(qid, "term").agg(F.count(F.lit(1)).alias("qtf")))


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each run, one run after another."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(int(count.sum()))


def _runs(dl: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of at most SHARD chunks and SHARD_TERMS terms; a longer chunk is a run of its own."""
    ends, lo = np.cumsum(dl), 0
    while lo < len(dl):
        most = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARD_TERMS, "right"))
        hi = max(lo + 1, min(most, lo + SHARD))
        yield lo, hi
        lo = hi


def _postings(n_keys: int):
    """(keys.., terms) rows to the posting lists of each run of chunks, and a row of the run itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId() << 24
        for whole in batches:
            all_dl = pc.fill_null(pc.list_value_length(whole.column(n_keys)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _runs(all_dl):
                b, dl = whole.slice(lo, hi - lo), all_dl[lo:hi]
                lists = b.column(n_keys)  # null for a null text
                words = lists.flatten().dictionary_encode()
                if not len(words):
                    continue
                row = np.repeat(np.arange(len(dl)), dl)
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pair, tf = np.unique(code * len(dl) + row, return_counts=True)
                code, row = pair // len(dl), pair % len(dl)
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                # the first row, without a term, holds the shard's counts and chunks
                ends = pa.array(np.concatenate([[0], first, [len(code)]]).astype(np.int32))
                posts = pa.StructArray.from_arrays([pa.array(row.astype(np.int32)), pa.array(tf.astype(np.int32))], ["pos", "tf"])
                held = pa.StructArray.from_arrays([pa.array(dl.astype(np.int32)), *(b.column(i) for i in range(n_keys))],
                                                  ["dl", *(f"k{i}" for i in range(n_keys))])
                n = len(first)
                once = lambda v: pa.array(np.append(v, np.zeros(n, np.int64)))  # noqa: E731, B023
                after = lambda v: pa.array(np.append(0, v))
                chunks = pa.ListArray.from_arrays(pa.array([0] + [len(dl)] * (n + 1), pa.int32()), held,
                                                  mask=pa.array(np.append(False, np.ones(n, bool))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + 1, shard)),
                     words.dictionary.take(pa.array(np.append(0, code[first]), mask=np.append(True, np.zeros(n, bool)))),
                     after(np.diff(np.append(first, len(code)))), after(np.add.reduceat(tf, first).astype(np.int64)),
                     once(int((dl > 0).sum())), once(int(dl.sum())), pa.ListArray.from_arrays(ends, posts), chunks],
                    ["shard", "term", "df", "cf", "n_chunks", "n_terms", "posts", "chunks"])
                shard += 1
    return run


class LexicalStore:
    """Posting lists of a growing chunk table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.segments = spark, Segments(spark, path)
        facts = self.segments.manifest()["facts"]
        self.keys: list[str] = facts["keys"]
        self.key_types: list[str] = facts["key_types"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: DataFrame, keys=("doc_id", "cont_id")) -> LexicalStore:
        """An empty store for chunks with the key columns of ``like``."""
        s = Segments(spark, path)
        types = [like.select(k).schema[0].dataType.simpleString() for k in keys]
        s.commit(s.manifest(), facts={"keys": list(keys), "key_types": types})
        return cls(spark, path)

    def _schema(self) -> str:
        fields = ", ".join(f"k{i}: {t}" for i, t in enumerate(self.key_types))
        return ("shard long, term string, df long, cf long, n_chunks long, n_terms long, "
                f"posts array<struct<pos: int, tf: int>>, chunks array<struct<dl: int, {fields}>>")

    def postings(self) -> DataFrame:
        return self.segments.read("postings", self._schema())

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").partitionBy("shard").parquet(self.segments.folder("postings", name))

    def _commit(self, at: dict, name: str, batches: list[str], drop=()) -> None:
        path = self.segments.folder("postings", name)
        n, total = self.spark.read.schema("n_chunks long, n_terms long").parquet(path).agg(
            F.coalesce(F.sum("n_chunks"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        self.segments.commit(at, {name: {"batches": batches, "n_chunks": n, "n_terms": total}}, drop)

    def append(self, chunks: DataFrame, text_col: str = "content", batch: str | None = None) -> bool:
        """Tokenize and add chunks; False if a batch of this name is live already."""
        at = self.segments.manifest()
        if batch is not None and any(batch in f["batches"] for f in at["segments"].values()):
            return False
        name = self.segments.new_name()
        self._write(chunks.select(*self.keys, terms(text_col).alias("_t")).mapInArrow(_postings(len(self.keys)), self._schema()), name)
        self._commit(at, name, [batch or name])
        return True

    def stats(self) -> tuple[int, float]:
        """(N, mean length) over chunks with a term, from the manifest alone."""
        live = self.segments.manifest()["segments"].values()
        n, total = sum(f["n_chunks"] for f in live), sum(f["n_terms"] for f in live)
        return n, total / n if n else 0.0

    def term_stats(self) -> DataFrame:
        """(term, df, cf), summed over shards."""
        return self.postings().filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def compact(self, shard: int = SHARD) -> None:
        """One segment in place of all, its shards merged up to about ``shard`` chunks."""
        at = self.segments.manifest()
        live = at["segments"]
        bins = max(1, -(-sum(f["n_chunks"] for f in live.values()) // shard), -(-sum(f["n_terms"] for f in live.values()) // SHARD_TERMS))
        rows = self.postings()
        sizes = (rows.filter("term is null").select("segment", "shard", F.size("chunks").alias("n"))
                 .withColumn("bin", F.pmod(F.xxhash64("segment", "shard"), F.lit(bins)).cast("long")))
        # where a shard's chunks begin in its bin: a bin has a few shards
        before = F.expr("sum(n) over (partition by bin order by segment, shard rows between unbounded preceding and 1 preceding)")
        # a row for each shard, so the postings stay where they are until they go to their bin
        placed = rows.join(F.broadcast(sizes.select("segment", "shard", "bin", F.coalesce(before, F.lit(0)).cast("int").alias("base"))),
                           ["segment", "shard"])
        moved = F.transform("posts", lambda p: p.withField("pos", p["pos"] + F.col("base")))
        held = F.when(F.col("term").isNull(), F.struct("base", "chunks"))
        in_order = F.flatten(F.transform(F.array_sort(F.collect_list("held")), lambda x: x["chunks"]))
        merged = (placed.select("bin", "term", "df", "cf", "n_chunks", "n_terms", moved.alias("posts"), held.alias("held"))
                  .repartition("bin").groupBy(F.col("bin").alias("shard"), "term")
                  .agg(*[F.sum(c).alias(c) for c in ("df", "cf", "n_chunks", "n_terms")],
                       F.flatten(F.collect_list("posts")).alias("posts"),
                       F.when(F.col("term").isNull(), in_order).alias("chunks")))
        name = self.segments.new_name()
        self._write(merged, name)
        self._commit(at, name, [b for f in live.values() for b in f["batches"]], drop=list(live))
        self.segments.vacuum("postings")

    def drop(self) -> None:
        self.segments.drop()

    def _blocks(self, questions: DataFrame, qid: str, qtext: str) -> Iterator[tuple[list, list[str], list[np.ndarray], list[np.ndarray]]]:
        """(question ids, the terms they have, each one's as numbers of these, their counts), about BLOCK_TERMS terms at a time."""
        rows = (query_terms(questions, qid, qtext).groupBy(qid)
                .agg(F.collect_list("term").alias("t"), F.collect_list("qtf").alias("n")))
        ids, known, codes, counts, held = [], {}, [], [], 0
        for r in rows.toLocalIterator():
            ids.append(r[0])
            codes.append(np.array([known.setdefault(w, len(known)) for w in r[1]], np.int64))
            counts.append(np.array(r[2], np.float64))
            held += len(r[1])
            if held >= BLOCK_TERMS:
                yield ids, list(known), codes, counts
                ids, known, codes, counts, held = [], {}, [], [], 0
        if ids:
            yield ids, list(known), codes, counts

    def search(self, questions: DataFrame, k: int = LEXICAL_TOPK, qid: str = "item_id", qtext: str = "text",
               k1: float = K1, b: float = B) -> DataFrame:
        """(qid, keys.., score, rank): Okapi BM25, any-term match, repeated question terms
        counted; score to 6 places, ties by the keys."""
        n, avgdl = self.stats()
        q_type = questions.select(qid).schema[0].dataType.simpleString()
        names = ", ".join(f"{c} {t}" for c, t in zip(self.keys, self.key_types, strict=True))
        schema, out = f"{qid} {q_type}, {names}, score double", None
        for ids, known, codes, counts in self._blocks(questions, qid, qtext):
            asked = self.spark.createDataFrame([(w,) for w in known], "term string")
            # a block's terms are bounded, so they are broadcast; a shard's row without a term goes with them
            matched = (self.postings().join(F.broadcast(asked.withColumn("asked", F.lit(True))), "term", "left")
                       .filter("asked or term is null"))
            df = dict(map(tuple, matched.filter("asked").groupBy("term").agg(F.sum("df").alias("df")).collect()))
            idf = np.array([math.log(1.0 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in known])
            weights = [c * idf[at] for c, at in zip(counts, codes, strict=True)]
            sent = self.spark.sparkContext.broadcast((ids, known, codes, weights))
            q_arrow = to_arrow_type(questions.select(qid).schema[0].dataType)
            # each task lets out k rows a question, so many questions are searched by few tasks
            tasks = max(SEARCH_TASKS, SEARCH_ROWS // (len(ids) * k))
            # lists of plain values and no nulls: at each row Spark goes through an Arrow batch's last run of null lists anew
            held = F.coalesce("chunks", F.array().cast(self.postings().schema["chunks"].dataType))
            lists = [F.col("posts.pos").alias("pos"), F.col("posts.tf").alias("tf"), held["dl"].alias("dl"),
                     *(held[f"k{i}"].alias(f"k{i}") for i in range(len(self.keys)))]
            part = matched.select("segment", "shard", "term", *lists).coalesce(tasks).mapInArrow(
                _filled(_best_chunks(sent, self.keys, qid, q_arrow, k, k1, b, avgdl)), schema)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], schema)
        return top_k(out, [qid], [F.desc("score"), *self.keys], k)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows (segment, shard, ..) of each shard; a shard's rows follow one another."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        segment, shard = b.column(0).dictionary_encode(), b.column(1).to_numpy(zero_copy_only=False)
        code = segment.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (shard[1:] != shard[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            here = segment.dictionary[int(code[lo])].as_py(), int(shard[lo])
            if held and here != now:
                yield pa.Table.from_batches(held)
                held = []
            now = here
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _filled(search):
    """``search`` of shards as they are stored: each posting gets its chunk's length and keys."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            held = shard.filter(pc.is_null(shard["term"])).combine_chunks()
            lists = shard.filter(pc.is_valid(shard["term"])).combine_chunks()
            if not len(lists):
                continue
            names = shard.column_names[3:]  # pos, tf, and what the shard holds of its chunks
            ends = np.append(0, np.cumsum(pc.list_value_length(lists["pos"]).to_numpy()))
            pos, tf = (pc.list_flatten(lists[c]).combine_chunks() for c in names[:2])
            mine = [pc.list_flatten(held[c]).combine_chunks().take(pos) for c in names[2:]]
            p = pa.StructArray.from_arrays([pos, tf, *mine], names)
            yield from pa.table({**{c: lists[c] for c in ("segment", "shard", "term")},
                                 "posts": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), p)}).to_batches()
    return lambda batches: search(whole(batches))


def _best_rows(found: list[pa.Table], keys: list[str], k: int) -> pa.Table:
    """The ``k`` best rows (_q, keys.., score) of each question."""
    rows = pa.concat_tables(found)
    order = [("_q", "ascending"), ("score", "descending"), *((c, "ascending") for c in keys)]
    rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start"))
    q = rows["_q"].to_numpy()
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(q)))
    return rows.filter(pa.array(np.arange(len(q)) - np.repeat(first, size) < k))


def _groups(shards: Iterator[pa.Table]) -> Iterator[list[pa.Table]]:
    """Shards that are searched together: one by itself, which gives each question a score
    to beat, then several, about GROUP_POSTS postings at a time."""
    held, posts, most = [], 0, 0
    for shard in shards:
        size = pc.sum(pc.list_value_length(shard["posts"])).as_py() or 0
        if held and posts + size > most:
            yield held
            held, posts, most = [], 0, GROUP_POSTS
        held.append(shard)
        posts += size
    if held:
        yield held


def _best_chunks(sent, keys: list[str], qid: str, q_type: pa.DataType, k: int, k1: float, b: float, avgdl: float):
    """A task's shards of matched posting lists to the ``k`` best chunks of each question.

    ``best[q]`` holds a question's k best scores so far: what is below them is neither ranked
    nor kept."""
    def search(tables: list[pa.Table], best: np.ndarray) -> pa.Table:
        _, known, codes, weights = sent.value
        words, code, pos, dl, tf, posts, base = pa.array(known), [], [], [], [], [], 0
        for table in tables:
            lists = table["posts"].combine_chunks()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            p = lists.flatten()
            code.append(np.repeat(pc.index_in(table["term"], words).to_numpy(zero_copy_only=False).astype(np.int64), size))
            pos.append(p.field("pos").to_numpy(zero_copy_only=False).astype(np.int64) + base)
            base = int(pos[-1].max(initial=base - 1)) + 1
            dl.append(p.field("dl").to_numpy(zero_copy_only=False))
            tf.append(p.field("tf").to_numpy(zero_copy_only=False))
            posts.append(p)
        code, pos, dl, tf = map(np.concatenate, (code, pos, dl, tf))
        part = tf / (tf + k1 * (1.0 - b + b * dl / avgdl))
        at, held = np.zeros(base, np.int64), np.zeros(base, bool)
        at[pos], held[pos] = np.arange(len(pos)), True
        # the chunks that are held, one posting of each, and each posting's chunk among them
        chunk, at, pos = np.flatnonzero(held), at[held], (np.cumsum(held) - 1)[pos]
        # a chunk's place among the chunks in key order settles ties
        columns = {c: pa.chunked_array([p.field(f"k{i}") for p in posts]).take(pa.array(at)).combine_chunks() for i, c in enumerate(keys)}
        order = pc.sort_indices(pa.table(columns), [(c, "ascending") for c in keys], null_placement="at_start").to_numpy()
        rank = np.empty(len(chunk), np.int64)
        rank[order] = np.arange(len(chunk))
        by_term = np.argsort(code, kind="stable")
        pos, part = pos[by_term], part[by_term]
        count = np.bincount(code, minlength=len(known))
        start = np.cumsum(count) - count
        which, found, scores = [], [], []
        for q, (mine, w) in enumerate(zip(codes, weights, strict=True)):
            size = count[mine]
            runs = [slice(lo, lo + n) for lo, n in zip(start[mine].tolist(), size.tolist(), strict=True)]
            add = np.concatenate([part[r] for r in runs])
            add *= np.repeat(w, size)
            total = np.bincount(np.concatenate([pos[r] for r in runs]), add, len(chunk))
            # what is below the k best so far by more than a score's last place is not looked at
            some = np.flatnonzero(total > max(0.0, best[q, 0] - 1e-5))
            s = np.round(total[some], 6)
            if len(some) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                some, s = some[keep], s[keep]
            if not len(some):
                continue
            top = np.lexsort((rank[some], -s))[:k]
            which += [q] * len(top)
            found.append(some[top])
            scores.append(s[top])
            best[q] = np.sort(np.append(best[q], s[top]))[-k:]
        rows = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        return pa.table({"_q": pa.array(np.array(which, np.int64)), **{c: v.take(rows) for c, v in columns.items()},
                         "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ids = sent.value[0]
        most = max(1 << 16, 2 * len(ids) * k)
        best = np.full((len(ids), k), -np.inf)
        for group in _groups(_shards(batches)):
            held.append(search(group, best))
            if len(held) > 1 and sum(map(len, held)) > most:
                held = [_best_rows(held, keys, k)]
        if held:
            rows = _best_rows(held, keys, k)
            asked = pa.array([ids[i] for i in rows["_q"].to_pylist()], q_type)
            yield from pa.table({qid: asked, **{c: rows[c] for c in keys}, "score": rows["score"]}).to_batches(max_chunksize=1 << 16)
    return run


def _perhaps_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys' hash is that of a wanted row: all that a join can match, and
    few others, told by a bitmap of BITS (8 MB) so that the others' texts are not shuffled."""
    at = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    bits = (wanted.groupBy(F.bitmap_bucket_number(at).alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
            .join(F.broadcast(bits), "_bucket").filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
            .drop("_bucket", "_bit", "_bits"))


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int = LEXICAL_TOPK,
              qid: str = "item_id", qtext: str = "text", keys=("doc_id", "cont_id"),
              text_col: str = "content", carry=("source", "content"),
              k1: float = K1, b: float = B, store: LexicalStore | None = None) -> DataFrame:
    """Top-k chunks per question by BM25; ties broken by chunk key. ``store`` holds
    the chunks' postings; without one they are indexed for this call.
    Output ``(qid, keys..., score, rank, carry...)``."""
    keys = list(keys)
    if store is None:
        store = LexicalStore.create(chunks.sparkSession, shared_dir(chunks.sparkSession, "lexical-store"), chunks, keys)
        store.append(chunks, text_col)
    top = store.search(questions, k, qid, qtext, k1, b)
    carry = [c for c in carry if c not in keys]
    if not carry:
        return top
    top = _checkpointed(top)
    attrs = _perhaps_in(chunks.select(*keys, *carry), top, keys)
    return attrs.join(top, keys).select(qid, *keys, "score", "rank", *carry)


def distinct_first(hits: DataFrame, qid: str = "item_id", content: str = "content",
                   keep: int = 5) -> DataFrame:
    """Distinct contents in first-seen (rank) order, first ``keep``."""
    firsts = hits.groupBy(qid, content).agg(F.min("rank").alias("first_rank"))
    return top_k(firsts, [qid], ["first_rank", content], keep, "pos")
