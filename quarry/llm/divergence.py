"""Source divergence audit: how far the term shares of the sources of a language differ.

Pass 1 over the texts counts, exactly, in how many documents of its language each
term is; those in ``LEAST`` or more are kept. The kept terms of a language are cut
into shards of about ``SHARD`` terms by hash, and each shard gets a *minimal perfect hash*:
levels of bit arrays in which a term has a bit of its own or goes on to the next
level, a term's slot being the rank of its bit. The terms are stored in slot order,
so a term that was never kept, which the hash would send anywhere, is known by comparison.

Pass 2 counts again with those hashes: a task holds dense counters, one array of
slots for each (group, shard) it has met, writes their entries out when they
reach ``DENSE`` bytes, and starts afresh. Arrays of one (group, shard) are summed in a
stream. The hashes are broadcast in rounds of at most ``SENT`` bytes (a round
holds one shard at least); one round is the rule, and a vocabulary beyond it
costs a further pass, not more memory.

Shares are whole numbers, ``1 + floor(1e9 * (count + 5) / (N + 5 * V))``, taken exactly.
Distances of pairs come from tiles of two blocks of about ``TILE`` sources over one
shard, summed over the shards; every pair is met once.

Defined cases: null text, lang and source count as ''. A (lang, source) without kept
terms has count 0 for each of them; a language without kept terms has distance 0
between its sources and no terms listed. A lang with one source has no pairs.
Repeated rows are documents of their own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm.common import exact, materialise
from quarry.llm.numtext import Spans, U, mix, utf8
from quarry.llm.terms import LETTERS, counted, term_runs, text_runs

LEAST = 30
SHARD = 1 << 12
LEVELS = 32
SENT = 1 << 26
DENSE = 1 << 26
TILE = 64
TOP = 50
PPB = 1_000_000_000


def term_hash(terms: pa.Array) -> np.ndarray:
    data, offs = utf8(terms)
    return Spans(data).hash(offs[:-1], offs[1:])


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h ^ mix(np.array([level + 1], U))) % U(size)).astype(np.int64)


def part_of(h: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """The shard of the terms of these hashes, of so many."""
    return (mix(h + U(1)) % np.asarray(parts).astype(U)).astype(np.int64)


@dataclass
class PerfectHash:
    """Bits of each level and, in slot order, the terms; those whose 64-bit
    hashes are equal find no bit and stand last, found by comparison."""
    levels: list[np.ndarray]
    terms: pa.Array
    rest: int

    @classmethod
    def of(cls, terms: pa.Array) -> PerfectHash:
        h, left, levels, order = term_hash(terms), np.arange(len(terms)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            at = _place(h[left], level, 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left))[at] == 1
            bits = np.zeros(2 * len(left), bool)
            bits[at[alone]] = True
            levels.append(bits)
            mine = left[alone]
            order.append(mine[np.argsort(at[alone])])
            left = left[~alone]
        order.append(left)
        return cls(levels, terms.take(pa.array(np.concatenate(order))), len(left))

    def __post_init__(self) -> None:
        self._before, n = [], 0
        for bits in self.levels:
            self._before.append(n + np.cumsum(bits) - bits)
            n += int(bits.sum())
        self._tail = self.terms.slice(n)
        self._known = n

    def slots(self, terms: pa.Array, h: np.ndarray | None = None) -> np.ndarray:
        """The slot of each of ``terms`` (whose hashes are ``h``), -1 for those not held."""
        h, slot = term_hash(terms) if h is None else h, np.full(len(terms), -1, np.int64)
        open_ = np.arange(len(terms))
        for level, (bits, before) in enumerate(zip(self.levels, self._before, strict=True)):
            at = _place(h[open_], level, len(bits))
            hit = bits[at]
            slot[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        same = pc.equal(self.terms.take(pa.array(np.maximum(slot, 0))), terms) if len(self.terms) else None
        slot = np.where(same.to_numpy(zero_copy_only=False) & (slot >= 0), slot, -1) if same is not None else slot
        if self.rest:
            tail = pc.index_in(terms, self._tail).fill_null(-1).to_numpy(zero_copy_only=False)
            slot = np.where(tail >= 0, self._known + tail, slot)
        return slot


def _clean(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    blank = lambda c, n: F.coalesce(exact(c).cast("string"), F.lit("")).alias(n)
    return docs.select(blank(lang, "lang"), blank(source, "source"), exact(text).alias("text"))


def _codes(col: pa.Array) -> tuple[np.ndarray, list]:
    d = col.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, term, docs): in how many of a run's texts a term is."""
    for b in batches:
        lang, names = _codes(b.column(0))
        for i, _, data, offs in text_runs(b.column(1)):
            terms, row = term_runs(data, offs, LETTERS)
            if not len(terms):
                continue
            known, code, row, _ = counted(terms, row)
            key, n = np.unique(code * len(names) + lang[i + row], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(key % len(names))),
                 known.cast(pa.string()).take(pa.array(key // len(names))), pa.array(n)], ["lang", "term", "docs"])


def frequent_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of terms in at least ``least`` documents of the language."""
    return (rows.select("lang", "text").mapInArrow(_presence, "lang string, term string, docs long")
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term"))


def _build(table: pa.Table) -> pa.Table:
    """One shard's terms to its perfect hash, as one row."""
    terms = table["term"].combine_chunks()
    terms = terms.take(pc.sort_indices(terms))  # the rows' order is the shuffle's
    p = PerfectHash.of(terms)
    return pa.table({"lang": table["lang"][:1], "part": table["part"][:1],
                     "levels": pa.array([[np.packbits(x).tobytes() for x in p.levels]], pa.list_(pa.binary())),
                     "sizes": pa.array([[len(x) for x in p.levels]], pa.list_(pa.int32())),
                     "terms": pa.array([p.terms.to_pylist()], pa.list_(pa.string())), "rest": pa.array([p.rest], pa.int32())})


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, parts) to (lang, part, term)."""
    for b in batches:
        part = part_of(term_hash(b.column(1)), b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part.astype(np.int32)), b.column(1)], ["lang", "part", "term"])


def perfect_hashes(kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, part, levels, sizes, terms, rest) of each shard of kept terms (lang, term),
    with ``parts``, the language's shards, and ``vocabulary``, its kept terms."""
    per = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary")).withColumn(
        "parts", F.ceil(F.col("vocabulary") / shard).cast("int"))
    dealt = kept.join(per, "lang").select("lang", "term", "parts").mapInArrow(_dealt, "lang string, part int, term string")
    built = dealt.groupBy("lang", "part").applyInArrow(
        _build, "lang string, part int, levels array<binary>, sizes array<int>, terms array<string>, rest int")
    return built.join(per, "lang")


def _rounds(hashes: DataFrame, sent: int) -> list[DataFrame]:
    """``hashes`` in rounds of at most ``sent`` bytes of terms (or of one shard)."""
    size = hashes.select(F.xxhash64("lang", "part").alias("h"),
                         F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 24).alias("b"))
    total = size.agg(F.sum("b")).first()[0] or 0
    n = max(1, -(-total // sent))
    while True:
        worst = (size.groupBy(F.pmod("h", F.lit(n)).alias("r")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("k"))
                 .filter((F.col("b") > sent) & (F.col("k") > 1)))
        if worst.isEmpty():
            return [hashes.filter(F.pmod(F.xxhash64("lang", "part"), F.lit(n)) == r) for r in range(n)]
        n *= 2


def _recount(sent) -> object:
    """(lang, source, text) to (lang, part, source, size, at, n): entries of dense counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, PerfectHash]] = {}
        parts: dict[str, int] = {}
        for r in sent.value:
            levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
                      for x, n in zip(r["levels"], r["sizes"], strict=True)]
            held.setdefault(r["lang"], {})[r["part"]] = PerfectHash(levels, pa.array(r["terms"], pa.large_string()), r["rest"])
            parts[r["lang"]] = r["parts"]
        dense: dict[tuple[str, int, str], np.ndarray] = {}
        used = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, part, source), counts in dense.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([part], pa.int32()), pa.array([source]), pa.array([len(counts)], pa.int32()),
                     pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.int64()))],
                    ["lang", "part", "source", "size", "at", "n"])

        for b in batches:
            lang, langs = _codes(b.column(0))
            source, sources = _codes(b.column(1))
            group, inverse = np.unique(lang * len(sources) + source, return_inverse=True)
            for i, _, data, offs in text_runs(b.column(2)):
                terms, row = term_runs(data, offs, LETTERS)
                if not len(terms):
                    continue
                known, code, row, tf = counted(terms, row)
                key, at = np.unique(code * len(group) + inverse[i + row], return_inverse=True)
                n = np.bincount(at, tf).astype(np.int64)
                code, of = key // len(group), key % len(group)
                of_lang = group[of] // len(sources)
                for li in np.unique(of_lang):
                    name = langs[li]
                    if name not in held:
                        continue
                    mine = np.flatnonzero(of_lang == li)
                    own, back = np.unique(code[mine], return_inverse=True)
                    words = known.take(pa.array(own))
                    h = term_hash(words)
                    part, slot = part_of(h, parts[name]), np.full(len(own), -1, np.int64)
                    for p in np.unique(part):
                        if p in held[name]:
                            some = np.flatnonzero(part == p)
                            slot[some] = held[name][p].slots(words.take(pa.array(some)), h[some])
                    hit = np.flatnonzero(slot[back] >= 0)
                    # entries by (group, shard); a slot is once in each
                    order = hit[np.lexsort((part[back][hit], of[mine][hit]))]
                    g, q = of[mine][order], part[back][order]
                    cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (q[1:] != q[:-1]))) if len(g) else []
                    for lo, hi in zip(cuts, [*cuts[1:], len(g)], strict=True):
                        where = name, int(q[lo]), sources[group[g[lo]] % len(sources)]
                        if where not in dense:
                            dense[where] = np.zeros(len(held[name][q[lo]].terms), np.int64)
                            used += dense[where].nbytes
                        dense[where][slot[back][order[lo:hi]]] += n[mine][order[lo:hi]]
                if used > DENSE:
                    yield from flush()
                    dense, used = {}, 0
        yield from flush()
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (lang, part, source) to the dense counts of each."""
    where, counts = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([where[0]]), pa.array([where[1]], pa.int32()), pa.array([where[2]]), pa.array([counts], pa.list_(pa.int64()))],
            ["lang", "part", "source", "counts"])

    for b in batches:
        lang, part, source, size = (b.column(i).to_pylist() for i in range(4))
        for j in range(len(b)):
            here = lang[j], part[j], source[j]
            if here != where:
                if where is not None:
                    yield out()
                where, counts = here, np.zeros(size[j], np.int64)
            at = b.column(4)[j].values.to_numpy(zero_copy_only=False)
            counts[at] += b.column(5)[j].values.to_numpy(zero_copy_only=False)
    if where is not None:
        yield out()


def recount(rows: DataFrame, hashes: DataFrame, sent: int = SENT) -> DataFrame:
    """(lang, part, source, counts): dense counts of each group and shard it has terms of."""
    sc, found = rows.sparkSession.sparkContext, None
    for part in _rounds(hashes, sent):
        one = rows.mapInArrow(_recount(sc.broadcast(part.toArrow().to_pylist())),
                              "lang string, part int, source string, size int, at array<int>, n array<long>")
        found = one if found is None else found.unionByName(one)
    return (found.repartition("lang", "part", "source").sortWithinPartitions("lang", "part", "source")
            .mapInArrow(_summed, "lang string, part int, source string, counts array<long>"))


def shares(count: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """1 + floor(PPB * (count + 5) / (total + 5 * vocabulary)), by three digits at a
    time: no step leaves 64 bits while the divisor is below 9e15."""
    by = total + 5 * vocabulary
    whole, rest = np.divmod(count + 5, by)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + more
    return whole + 1


def _tile(table: pa.Table) -> pa.Table:
    """The sources of two blocks over one shard to the part of each pair's distance."""
    table = table.sort_by("source")  # the rows' order is the shuffle's; a pair is named alike in every shard
    a, size = table["a"][0].as_py(), table["size"][0].as_py()
    same = a == table["b"][0].as_py()
    source, block = table["source"].to_pylist(), table["block"].to_pylist()
    p = np.stack([shares(np.zeros(size, np.int64) if c is None else c, n, v) for c, n, v in zip(
        (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in table["counts"]),
        table["total"].to_pylist(), table["vocabulary"].to_pylist(), strict=True)]) if size else np.zeros((len(source), 0), np.int64)
    one, two, f = [], [], []
    left = [i for i in range(len(source)) if block[i] == a]
    right = np.array([i for i in range(len(source)) if same or block[i] != a], np.int64)
    for i in left:
        others = right[right > i] if same else right
        d = np.abs(p[others] - p[i]).sum(axis=1)
        one += [source[i]] * len(others)
        two += [source[j] for j in others]
        f.append(d)
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(one), pa.string()), "one": pa.array(one, pa.string()),
                     "two": pa.array(two, pa.string()), "f": pa.array(np.concatenate(f) if f else np.zeros(0, np.int64))})


def _distances(dense: DataFrame, groups: DataFrame, langs: DataFrame, shard_sizes: DataFrame, tile: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    blocks = F.ceil(F.col("sources") / tile).cast("int")
    g = (groups.join(langs, "lang").withColumn("blocks", blocks)
         .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
         .withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))))
         .join(shard_sizes, ["lang", "part"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
         .join(dense, ["lang", "part", "source"], "left"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = (g.select("lang", "part", "source", "block", "size", "total", "vocabulary", "counts", other)
             .withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other"))
    partial = tiles.groupBy("lang", "part", "a", "b").applyInArrow(_tile, "lang string, one string, two string, f long")
    whole = partial.groupBy("lang", "one", "two").agg(F.sum("f").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                             F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("way")
    return whole.select("lang", ways, "value").select("lang", "way.source", "way.item", "value")


def _share(count: str, total: str) -> F.Column:
    return F.expr(f"1 + ((cast({count} + 5 as decimal(28,0)) * {PPB}) div (cast({total} as decimal(28,0)) + 5 * vocabulary))")


def _risen(dense: DataFrame, groups: DataFrame, langs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms with a larger share in a group than in its language."""
    cells = (dense.select("lang", "part", "source", F.posexplode("counts").alias("slot", "count")).filter("count > 0"))
    names = hashes.select("lang", "part", F.posexplode("terms").alias("slot", "item"))
    whole = cells.groupBy("lang", "part", "slot").agg(F.sum("count").alias("all"))
    info = groups.join(langs.select("lang", "lang_total", "vocabulary"), "lang")
    return (cells.join(whole, ["lang", "part", "slot"]).join(names, ["lang", "part", "slot"]).join(info, ["lang", "source"])
            .withColumn("value", _share("count", "total") - _share("all", "lang_total"))
            .filter("value > 0").select("lang", "source", "item", "value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, sent: int = SENT, tile: int = TILE,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source from every
    other of its language (``pair``), and the ``top`` terms whose share is most above
    the language's (``term``)."""
    rows = _clean(docs, lang, source, text)
    kept = materialise(frequent_terms(rows, least), "kept_terms")
    hashes = materialise(perfect_hashes(kept, shard), "perfect_hashes")
    dense = materialise(recount(rows, hashes, sent), "dense_counts")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    groups = (rows.select("lang", "source").distinct()
              .join(dense.groupBy("lang", "source").agg(F.sum(total).alias("total")), ["lang", "source"], "left")
              .withColumn("total", F.coalesce("total", F.lit(0).cast("long"))))
    groups = materialise(groups, "groups")
    shards = hashes.groupBy("lang").agg(F.first("parts").alias("parts"), F.first("vocabulary").alias("vocabulary"))
    langs = (groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total"))
             .join(shards, "lang", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
             .withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0).cast("long"))))
    langs = materialise(langs, "langs")
    sizes = hashes.select("lang", "part", F.size("terms").alias("size"))
    pairs = _distances(dense, groups, langs, sizes, tile)
    risen = _risen(dense, groups, langs, hashes)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(order)
    ranked = lambda x, part: x.withColumn("rank", rank).withColumn("part", F.lit(part))
    return (ranked(pairs, "pair").unionByName(ranked(risen, "term").filter(F.col("rank") <= top))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))


def oracle() -> str:
    """DuckDB SQL for ``audit`` of documents."""
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM tok GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST}),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT lang, source, term, coalesce(c, 0)::HUGEINT AS c FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
voc AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
share AS (SELECT lang, source, term, c,
  (1 + ({PPB}::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT)::BIGINT AS p FROM cell JOIN voc USING (lang)),
total AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM cell GROUP BY 1, 2),
base AS (SELECT lang, term, (1 + ({PPB}::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v)::HUGEINT)::BIGINT AS q
  FROM total JOIN voc USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
everyone AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM share JOIN base USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM everyone UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= {TOP}
"""
