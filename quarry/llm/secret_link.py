"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are strong on their own: ``assign`` (a secret given a value), ``access``
(an access key id) and ``hex`` (a long hexadecimal run). Three more kinds are weak: a
``secret`` (a run of 32 to 66 letters and digits of both cases), an ``ident`` (a user
or client name given a value) and an ``endpoint`` (a web address). A credential has
several parts, so a weak span is reported only if what completes it lies in its
scope, ``SCOPE`` code points to either side: for a secret an identifier
(``access`` or ``ident``), for an identifier a secret (``assign``, ``hex`` or
``secret``), for an endpoint both. Weak spans that overlap a base span are not
reported again.

Spans and scopes meet in an interval join on (document, stretch of ``SCOPE`` code
points): a stretch holds a bounded number of spans, so dense documents cost in
proportion to their length. Matches' places come from the lengths of what
``split`` leaves between them, summed in a window over one row's matches.

Defined cases: null and empty texts have no spans. Rows of equal doc_id and
text get equal results, each its own row; null doc_ids are allowed. Extra
columns are not read by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import exact, free_name, materialise

SCOPE = 200
BLOCK = 4096

# fixed values: the patterns of the base kinds
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
SECRET = r"[A-Za-z0-9+/_-]{32,}={0,2}"
IDENT = (r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]"""
         r"""|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""")
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"

#: Kind, pattern, place in the order of kinds, and the role it plays.
KINDS = [("assign", ASSIGN, 0, "secret"), ("access", ACCESS, 1, "ident"), ("hex", HEX, 2, "secret"),
         ("secret", SECRET, 3, "secret"), ("ident", IDENT, 4, "ident"), ("endpoint", ENDPOINT, 5, "endpoint")]
BASE = ("assign", "access", "hex")
_KEY = ["key", "key2"]


def holds(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 1)) >= 6
    if kind == "access":
        return F.length(match) >= 20
    if kind == "secret":
        return ((F.length(match) <= 66) & match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]"))
    return F.lit(True)


def _keys(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    d, t = exact(doc_id), F.coalesce(exact(text), F.lit(""))
    return [F.xxhash64(d, t).alias("key"), F.xxhash64(t, d, F.lit(1)).alias("key2")]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, key2, kind, ord, role, match, start, end) of every strong and weak span."""
    t = exact(text)
    parts = [F.when(t.rlike(p), F.struct(
        F.lit(k).alias("kind"), F.lit(o).alias("ord"), F.lit(r).alias("role"),
        F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("m"),
        F.transform(F.split(t, p, -1), lambda g: F.length(g).cast("long")).alias("g"))) for k, p, o, r in KINDS]
    by_kind = (docs.select(*_keys(docs, doc_id, text), F.explode(F.array_compact(F.array(*parts))).alias("k"))
               .select(*_KEY, "k.*"))
    flat = (by_kind.select(*_KEY, "kind", "ord", "role", F.posexplode(F.arrays_zip("m", "g")).alias("i", "x"))
            .select(*_KEY, "kind", "ord", "role", "i", F.col("x.m").alias("match"), F.col("x.g").alias("gap"))
            .filter("match is not null").dropDuplicates([*_KEY, "kind", "i"]))
    before = Window.partitionBy(*_KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    end = F.sum(F.col("gap") + size).over(before)
    ok = F.lit(False)
    for k, *_ in KINDS:
        ok = ok | ((F.col("kind") == k) & holds(k, F.col("match")))
    return flat.select(*_KEY, "kind", "ord", "role", "match", (end - size).alias("start"), end.alias("end")).filter(ok)


def linked(spans: DataFrame) -> DataFrame:
    """The weak spans that their complementary parts confirm, with the columns of ``spans``."""
    base = F.col("kind").isin(*BASE)
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / SCOPE), F.floor(hi / SCOPE)))
    weak = spans.filter(~base).withColumn("bin", bins(F.col("start"), F.col("end")))
    part = (spans.filter("role in ('ident', 'secret')")
            .select(*_KEY, F.col("role").alias("p_role"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
                    base.alias("p_base"))
            .withColumn("bin", bins(F.greatest(F.col("p_start") - SCOPE, F.lit(0)), F.col("p_end") + SCOPE)))
    near = (F.col("p_start") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("p_end") + SCOPE)
    has = lambda r: F.bool_or(F.col("p_role") == r)
    met = (weak.join(part, [*_KEY, "bin"]).filter(near)
           .groupBy(*[c for c in spans.columns])
           .agg(has("ident").alias("with_ident"), has("secret").alias("with_secret"),
                F.bool_or(F.col("p_base") & (F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end"))).alias("known")))
    complete = (((F.col("role") == "secret") & F.col("with_ident")) | ((F.col("role") == "ident") & F.col("with_secret"))
                | ((F.col("role") == "endpoint") & F.col("with_ident") & F.col("with_secret")))
    return met.filter(complete & ~F.col("known")).select(*spans.columns)


def _listed(spans: Column) -> Column:
    """kind:start:end, by start, then kind as listed, joined by commas."""
    each = F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    spans = materialise(candidates(docs, doc_id, text), "spans")
    base = spans.filter(F.col("kind").isin(*BASE))
    all_spans = base.withColumn("base", F.lit(True)).unionByName(linked(spans).withColumn("base", F.lit(False)))
    one = F.struct("start", "ord", "end", "kind")
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    by_doc = all_spans.groupBy(*_KEY).agg(*[n(k) for k in BASE], F.collect_list(F.when(F.col("base"), one)).alias("b"),
                                          F.collect_list(one).alias("a"))
    rows = docs.select(exact(doc_id).alias("doc_id"), *_keys(docs, doc_id, text))
    return rows.join(by_doc, _KEY, "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(_listed(F.col("b")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("a")), F.lit("")).alias("spans"))


def _cuts(spans: DataFrame) -> DataFrame:
    """(key, key2, cuts) of the documents with reported spans: for each block of ``BLOCK`` code
    points that they reach, what to leave out (from, to) and what to put there.

    Spans that overlap are one, of the kind that begins first, then of the longest."""
    sure = linked(spans).select(*_KEY, "kind", "match").distinct()
    told = (spans.filter(F.col("kind").isin(*BASE))
            .unionByName(spans.join(sure, [*_KEY, "kind", "match"], "left_semi")))
    order = Window.partitionBy(*_KEY).orderBy("start", F.desc("end"), "ord")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = (told.withColumn("first", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
           .withColumn("place", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
           .groupBy(*_KEY, "place").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                        F.max(F.when(F.col("first") == 1, F.col("kind"))).alias("kind")))
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block")
    at = F.col("block") * BLOCK
    return (one.select(*_KEY, "start", "end", "kind", block)
            .select(*_KEY, "block", F.struct(
                F.greatest(F.col("start") - at, F.lit(0)).cast("int").alias("lo"),
                F.least(F.col("end") - at, F.lit(BLOCK)).cast("int").alias("hi"),
                F.when(F.col("start") >= at, F.concat(F.lit("["), "kind", F.lit("]"))).otherwise("").alias("put")).alias("cut"))
            .groupBy(*_KEY, "block").agg(F.sort_array(F.collect_list("cut")).alias("cut"))
            .groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("block", "cut"))).alias("cuts")))


def _without(block: Column, cut: Column) -> Column:
    """A block of text with its cuts made."""
    def piece(c: Column, i: Column) -> Column:
        from_ = F.coalesce(F.get(cut, i - 1)["hi"], F.lit(0))
        return F.concat(F.substr(block, from_ + 1, c["lo"] - from_), c["put"])
    tail = F.substr(block, F.element_at(cut, -1)["hi"] + 1)
    return F.when(cut.isNull(), block).otherwise(F.concat(F.array_join(F.transform(cut, piece), ""), tail))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in
    square brackets; a confirmed weak match is replaced wherever its text has it.

    Spans are cut out by their places in the text as it was, so one kind's mask hides nothing
    of another's. A text is gone through block by block, in proportion to its length."""
    spans = materialise(candidates(docs, doc_id, text), "spans")
    names = {c: free_name(docs, c) for c in [*_KEY, "cuts"]}
    rows = docs.withColumns({names[c]: e for c, e in zip(_KEY, _keys(docs, doc_id, text), strict=True)})
    rows = rows.join(_cuts(spans).withColumnsRenamed(names), [names[k] for k in _KEY], "left")
    cuts = exact(names["cuts"])
    blocks = F.regexp_extract_all(exact(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = F.array_join(F.transform(blocks, lambda b, i: _without(b, F.try_element_at(cuts, i.cast("long")))), "")
    rows = rows.withColumn(text, F.when(cuts.isNull(), exact(text)).otherwise(whole))
    return rows.select(*[exact(c) for c in docs.columns])


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle() -> str:
    """DuckDB SQL for ``scan`` over documents (doc_id unique)."""
    found = "\nUNION ALL\n".join(
        f"SELECT doc_id, '{k}' AS kind, {o} AS ord, '{r}' AS role, regexp_extract_all(text, '{_re2(p)}') AS ms, "
        f"string_split_regex(text, '{_re2(p)}') AS gs FROM documents WHERE regexp_matches(text, '{_re2(p)}')"
        for k, p, o, r in KINDS)
    return f"""
WITH found AS (
{found}
), flat AS (
SELECT doc_id, kind, ord, role, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM found
), placed AS (
SELECT doc_id, kind, ord, role, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM flat
), span AS (
SELECT doc_id, kind, ord, role, e - length(m) AS s, e, kind IN ('assign', 'access', 'hex') AS base FROM placed
WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{_re2(ASSIGN)}', 1)) >= 6
  WHEN 'access' THEN length(m) >= 20
  WHEN 'secret' THEN length(m) <= 66 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
  ELSE true END
), met AS (
SELECT w.doc_id, w.kind, w.ord, w.role, w.s, w.e, bool_or(p.role = 'ident') AS with_ident,
  bool_or(p.role = 'secret') AS with_secret, bool_or(p.base AND p.s < w.e AND w.s < p.e) AS known
FROM span w JOIN span p ON w.doc_id = p.doc_id AND p.s <= w.e + {SCOPE} AND w.s <= p.e + {SCOPE}
WHERE NOT w.base AND p.role IN ('ident', 'secret') GROUP BY ALL
), reported AS (
SELECT doc_id, kind, ord, s, e, base FROM span WHERE base
UNION ALL
SELECT doc_id, kind, ord, s, e, false FROM met WHERE NOT known AND CASE role WHEN 'secret' THEN with_ident
  WHEN 'ident' THEN with_secret ELSE with_ident AND with_secret END
), by_doc AS (
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (base) AS b,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) AS a
FROM reported GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""
