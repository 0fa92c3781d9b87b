"""Ranked lexical search over a length-stratified index.

A document's normaliser ``m = 10 + (90 * n * N) div L`` depends on its length alone, so
documents of equal m form a *stratum*, and within it a term's score depends on
its tf alone. The index is a table of strata: m, the stratum's documents, and its
postings by (term, tf), each a list of places in the stratum. Searching:

* the impact of (term, tf) is computed once for a whole posting list;
* a stratum's bound for an item is the sum, over the item's terms, of the impact of
  the largest tf that the stratum holds; strata are visited in falling order of
  bound, in waves, and an item is done once the next bound is below the
  k-th score it has. That score is carried on through a task;
* each task returns k rows for each item at most, and a partial and final
  limit by rank merges them.

Strata are cut where texts are cut for memory (``SEGMENT`` bytes), so a stratum,
however common its m, is many rows of bounded size, spread as the texts were, and
small strata have tight bounds. A search takes up ``STRATA`` of them at once, whatever a
batch holds. The build shuffles nothing: one pass
counts terms (N and L), one writes the index. An index to keep (``build``, ``search``) holds
every term of every document; ``rank`` answers given items at once, and for each
block of them writes the postings of the block's terms only. ``df`` is
summed over posting lists.

Items are answered in blocks of about ``ITEM_TERMS`` terms: what is sent to the
tasks has that bound (one item's own terms at least), however many items there are.

Defined cases: null and empty texts have no terms and are not counted in N; each
row is a document of its own, so repeated rows are repeated results (of equal
score, by doc_id; null doc_ids last). An item of null text, or whose terms no
document has, has no rows. Items are rows too: a repeated item_id is answered for
each of its texts. Without documents there are no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import exact, materialise
from quarry.llm.numtext import expand
from quarry.llm.terms import ALNUM, count_terms, counted, term_runs, text_runs

SEGMENT = 1 << 21
STRATA = 64
ITEM_TERMS = 1 << 18
WAVE = 4
SCALE = 1_000_000_000

_POSTINGS = "array<struct<term: string, tf: long, docs: array<int>>>"


@dataclass
class Index:
    """The strata (m, docs, postings), and the counts of documents and terms."""
    strata: DataFrame
    n_docs: int
    n_terms: int


def normalisers(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with ``n`` terms each; the product is taken in whole numbers of any size."""
    lengths, at = np.unique(n, return_inverse=True)
    m = np.array([100 - 90 + (90 * int(x) * n_docs) // max(n_terms, 1) for x in lengths], np.int64)
    return m[at] if len(m) else np.zeros(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for _, _, data, offs in text_runs(b.column(0)):
            n = count_terms(data, offs, ALNUM)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def _segment(ids: pa.Array, data: np.ndarray, offs: np.ndarray, n_docs: int, n_terms: int, only: pa.Array | None) -> pa.RecordBatch:
    """The strata of one run of texts, with the postings of ``only`` if that is given."""
    terms, row = term_runs(data, offs, ALNUM)
    names, code, row, tf = counted(terms, row)
    n = np.bincount(row, tf, minlength=len(offs) - 1).astype(np.int64)
    if only is not None:
        asked = pc.is_in(names, only).to_numpy(zero_copy_only=False)[code]
        code, row, tf = code[asked], row[asked], tf[asked]
    m = normalisers(n, n_docs, n_terms)
    some = np.flatnonzero(n > 0)
    by_m = some[np.argsort(m[some], kind="stable")]  # documents by stratum
    strata, head, size = np.unique(m[by_m], return_index=True, return_counts=True)
    place = np.zeros(len(n), np.int64)  # of a document in its stratum
    place[by_m] = np.arange(len(by_m)) - np.repeat(head, size)
    stratum = np.zeros(len(n), np.int64)
    stratum[by_m] = np.repeat(np.arange(len(strata)), size)
    s = stratum[row]
    order = np.lexsort((place[row], tf, code, s))
    s, code, tf, place = s[order], code[order], tf[order], place[row][order]
    new = np.append(True, (s[1:] != s[:-1]) | (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(s)).astype(np.int32)), pa.array(place.astype(np.int32)))
    posting = pa.StructArray.from_arrays([names.cast(pa.string()).take(pa.array(code[at])), pa.array(tf[at].astype(np.int64)), lists],
                                         ["term", "tf", "docs"])
    ends = np.append(np.searchsorted(s[at], np.arange(len(strata))), len(at)).astype(np.int32)
    docs = pa.ListArray.from_arrays(pa.array(np.append(head, len(by_m)).astype(np.int32)), ids.take(pa.array(by_m)))
    return pa.RecordBatch.from_arrays([pa.array(strata), docs, pa.ListArray.from_arrays(pa.array(ends), posting)],
                                      ["m", "docs", "postings"])


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(N, L): documents with a term, and all their terms."""
    return tuple(docs.select(exact(text)).mapInArrow(_counts, "docs long, terms long").agg(
        F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: pa.Array | None = None,
          counts: tuple[int, int] | None = None) -> Index:
    """Index every document (of the terms ``only``, if given), without a shuffle."""
    n_docs, n_terms = counts or totals(docs, text)
    kind = docs.select(exact(doc_id)).schema[0].dataType.simpleString()
    asked = None if only is None else only.cast(pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_runs(b.column(1), SEGMENT):
                out = _segment(b.column(0).slice(i, j - i), data, offs, n_docs, n_terms, asked)
                if len(out):
                    yield out

    strata = docs.select(exact(doc_id), exact(text)).mapInArrow(run, f"m long, docs array<{kind}>, postings {_POSTINGS}")
    return Index(materialise(strata, "strata"), n_docs, n_terms)


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(b), STRATA):
        yield b.slice(at, STRATA)


def document_frequency(index: Index, terms: list[str]) -> dict[str, int]:
    """In how many documents each of ``terms`` is (those in any)."""
    known = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for b in (r for whole in batches for r in _runs(whole)):
            p = b.column(0).flatten()
            code = pc.index_in(p.field("term"), known).fill_null(-1).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(p.field("docs")).to_numpy(zero_copy_only=False)
            total += np.bincount(code[code >= 0], size[code >= 0], minlength=len(known)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([known.take(pa.array(some)), pa.array(total[some])], ["term", "df"])

    rows = index.strata.select("postings").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.toLocalIterator()}


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 8 * m)


class _Best:
    """The k best (score, doc_id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), pa.nulls(0)

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: pa.Array) -> None:
        if not len(score):
            return
        score = np.append(self.score, score)
        doc = pa.concat_arrays([self.doc, doc]) if len(self.doc) else doc
        rank = pc.sort_indices(pa.table({"s": score, "d": doc}), [("s", "descending"), ("d", "ascending")],
                               null_placement="at_end").slice(0, self.k)
        self.score, self.doc = score[rank.to_numpy()], doc.take(rank)


def _visit(batch: pa.RecordBatch, terms: pa.Array, items: list[np.ndarray], w: np.ndarray, best: list[_Best]) -> None:
    """Search the strata of one batch for every item of a block."""
    m = batch.column(0).to_numpy(zero_copy_only=False)
    docs, post = batch.column(1), batch.column(2)
    # flatten() leaves out what lies before a sliced list, so offsets begin at 0
    ends = np.append(0, np.cumsum(pc.list_value_length(post).to_numpy(zero_copy_only=False))).astype(np.int64)
    post = post.flatten()
    code = pc.index_in(post.field("term"), terms).fill_null(-1).to_numpy(zero_copy_only=False)
    mine = np.flatnonzero(code >= 0)
    if not len(mine):
        return
    stratum = np.searchsorted(ends, mine, "right") - 1
    code, tf = code[mine].astype(np.int64), post.field("tf").to_numpy(zero_copy_only=False)[mine]
    impact = _impacts(tf, m[stratum])  # once for a posting list
    lists = post.field("docs").take(pa.array(mine))
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    list_at = np.cumsum(count) - count
    doc_count = pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_at, ids = np.cumsum(doc_count) - doc_count, docs.flatten()
    by_term = np.argsort(code, kind="stable")
    t_lo, t_hi = (np.searchsorted(code[by_term], np.arange(len(terms)), side) for side in ("left", "right"))
    for item, top in zip(items, best, strict=True):
        idx, pos = expand(t_hi[item] - t_lo[item])
        if not len(idx):
            continue
        lists_of = by_term[t_lo[item][idx] + pos]
        weighted = w[item][idx] * impact[lists_of]
        s = stratum[lists_of]
        # of each (stratum, term) the largest impact, then its sum over the stratum's terms
        order = np.lexsort((weighted, idx, s))
        last = np.append((s[order][1:] != s[order][:-1]) | (idx[order][1:] != idx[order][:-1]), True)
        bound = np.zeros(len(m), np.int64)
        np.add.at(bound, s[order][last], weighted[order][last])
        visits = np.flatnonzero(bound)
        visits = visits[np.argsort(-bound[visits], kind="stable")]
        by_stratum = np.argsort(s, kind="stable")
        s_lo, s_hi = (np.searchsorted(s[by_stratum], visits, side) for side in ("left", "right"))
        at, wave = 0, WAVE
        while at < len(visits):
            stop = at + int((bound[visits[at: at + wave]] >= max(top.floor(), 1)).sum())
            if stop == at:
                break
            i2, p2 = expand(s_hi[at:stop] - s_lo[at:stop])
            chosen = by_stratum[s_lo[at:stop][i2] + p2]
            li = lists_of[chosen]
            i3, p3 = expand(count[li])
            doc = doc_at[s[chosen]][i3] + place[list_at[li][i3] + p3]
            found, inverse = np.unique(doc, return_inverse=True)
            score = np.zeros(len(found), np.int64)
            np.add.at(score, inverse, weighted[chosen][i3])
            good = score >= max(top.floor(), 1)
            top.add(score[good], ids.take(pa.array(found[good])))
            at, wave = stop, wave * 2


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[pa.Array]]]:
    """Blocks of (item ids, distinct terms of each), of about ITEM_TERMS terms."""
    ids, terms, held = [], [], 0
    for r in items.select(exact(item_id).alias("i"), exact(text).alias("t")).toLocalIterator():
        raw = np.frombuffer((r["t"] or "").encode(), np.uint8)
        found = term_runs(raw, np.array([0, len(raw)]), ALNUM)[0].unique().cast(pa.string())
        if not len(found):
            continue
        ids.append(r["i"])
        terms.append(found)
        held += len(found)
        if held >= ITEM_TERMS:
            yield ids, terms
            ids, terms, held = [], [], 0
    if ids:
        yield ids, terms


def _answers(index: Index, ids: list, texts: list[pa.Array], number: int, k: int, item_type: str) -> DataFrame:
    """(n, item_id, doc_id, score): for each task, the ``k`` best of each item of a
    block; n numbers the items, from ``number``."""
    sc = index.strata.sparkSession.sparkContext
    terms = pa.concat_arrays(texts).unique()
    df = document_frequency(index, terms.to_pylist())
    terms = sorted(df)  # a term of no document adds nothing
    known = pa.array(terms, pa.string())
    w = np.array([weight(df[t], index.n_docs) for t in terms], np.int64)
    codes = [pc.index_in(t, known).drop_null().to_numpy(zero_copy_only=False).astype(np.int64) for t in texts]
    sent = sc.broadcast((ids, codes, terms, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, terms, w = sent.value
        known, best = pa.array(terms, pa.string()), [_Best(k) for _ in ids]
        for b in (r for whole in batches for r in _runs(whole)):
            _visit(b, known, codes, w, best)
        rows = [len(x.score) for x in best]
        if sum(rows):
            of = np.repeat(np.arange(len(ids)), rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of + number), pa.array([ids[i] for i in of]),
                 pa.concat_arrays([x.doc for x in best if len(x.doc)]), pa.array(np.concatenate([x.score for x in best]))],
                ["n", "item_id", "doc_id", "score"])

    doc_type = index.strata.schema["docs"].dataType.elementType.simpleString()
    return index.strata.mapInArrow(run, f"n long, item_id {item_type}, doc_id {doc_type}, score long")


def _ranked(index_of: Callable[[pa.Array], Index], docs_type: str, items: DataFrame, k: int, item_id: str, text: str) -> DataFrame:
    """Answer items block by block, each from the index that ``index_of`` gives for its terms."""
    item_type = items.select(exact(item_id)).schema[0].dataType.simpleString()
    out, number = None, 0
    for ids, texts in _item_blocks(items, item_id, text):
        part = _answers(index_of(pa.concat_arrays(texts).unique()), ids, texts, number, k, item_type)
        out, number = part if out is None else out.unionByName(part), number + len(ids)
    if out is None:
        return items.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {docs_type}, score long")
    best = Window.partitionBy("n").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of score above 0."""
    kind = index.strata.schema["docs"].dataType.elementType.simpleString()
    return _ranked(lambda _: index, kind, items, k, item_id, text)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """As ``search`` of an index of ``docs``, which holds the terms of ``items`` alone."""
    counts = totals(docs, text)
    kind = docs.select(exact(doc_id)).schema[0].dataType.simpleString()
    return _ranked(lambda terms: build(docs, doc_id, text, terms, counts), kind, items, k, item_id, text)


def oracle() -> str:
    """DuckDB SQL for ``search`` of the benchmark's items over documents."""
    terms = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
    return f"""
WITH tok AS (SELECT doc_id, {terms} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2),
doc AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
tot AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM doc),
norm AS (SELECT doc_id, 100 - 90 + ((90 * n * nn) // ll) AS m FROM doc, tot),
want AS (SELECT DISTINCT item_id, {terms} AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, tot WHERE term IN (SELECT term FROM want) GROUP BY 1),
hit AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM want JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM hit WHERE score > 0 QUALIFY rank <= 10
"""
