"""Registered queries: sources, sinks and preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.fixed import (EVAL_PER_SOURCE, QUERY_INSTRUCTION, SAMPLE_CAP, SOURCE_MAX,
                                    TASK_INSTRUCTIONS, TEXT_MAX)
from quarry.functions.text import normalize_newlines_sql, text_hash, text_hash_sql
from quarry.operators import chunk
from quarry.operators import prepare as P
from quarry.operators import vectors as V
from quarry.plans.registry import register
from quarry.plans.sqlparts import chunks_cte, lit, values
from quarry.plans.strategy import _checkpointed
from quarry.session import load_table, shared_dir
from quarry.sources import files

# Hand-made inputs (FIXTURES §3) appended to driver rows.
NAME_ROWS = [(-1, "a.txt"), (-2, "a.PDF"), (-3, "noext"), (-4, "http://x/y.pdf"), (-5, "http://x/y"),
             (-6, ""), (-7, "report.docx"), (-8, "a."), (-9, "archive.tar.txt")]
NEWLINE_ROWS = [(-1, "a\n\n\nb"), (-2, "a\r\n\r\nb"), (-3, "a\r\r\nb"), (-4, ""), (-5, "a\n\r\nb")]
PROPS_ROWS = [(-1, '{"a": "x", "b": 1.5, "c": true, "d": null, "e": [1], "f": 7, "h": {"z": 1}}'),
              (-2, '{"title": "t", "pages": 12}')]
LITERAL_ROWS = [(-1, "简介:nan景点;门票;简介:nan"), (-2, "简介:nan")]
LIST_ROWS = [(-1, "['a','b']"), (-2, "['a\\'s', \"b\"]"), (-3, "[\"it's\", 'x']"), (-4, "['a', b")]


def pages_with_names(spark, sf_dir):
    extra = spark.createDataFrame(NAME_ROWS, "page_id long, url string")
    return load_table(spark, sf_dir, "pages").select("page_id", "url").unionByName(extra)


PAGES_NAMES_SQL = (f"(SELECT page_id, url FROM pages UNION ALL "
                   f"{values(NAME_ROWS, ['page_id', 'url'], ['BIGINT', 'VARCHAR'])})")


# --- A1 / A2 -------------------------------------------------------------------
@register("route_source", sql=f"""SELECT page_id, url,
  CASE WHEN suffix(url, '.txt') THEN 'txt' WHEN suffix(url, '.pdf') THEN 'pdf'
       WHEN suffix(url, '.docx') THEN 'docx' WHEN contains(url, 'http') THEN 'url' ELSE '' END AS route
FROM {PAGES_NAMES_SQL}""")
def q_route_source(spark, sf_dir):
    return P.route_source(pages_with_names(spark, sf_dir), "url")


@register("route_inline", sql="""SELECT doc_id, source,
  CASE WHEN coalesce(length(text), 0) > 0 THEN 'string'
       WHEN suffix(source, '.txt') THEN 'txt' WHEN suffix(source, '.pdf') THEN 'pdf'
       WHEN suffix(source, '.docx') THEN 'docx' WHEN contains(source, 'http') THEN 'url' ELSE '' END AS route
FROM documents""")
def q_route_inline(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return P.route_source(d.select("doc_id", "source", "text"), "source", "text").drop("text")


# --- A3 --------------------------------------------------------------------------
TEXT_PART = 20_000


@register("read_text_files", sql=f"""WITH t AS (SELECT source, doc_id, text, (coalesce(sum(length(text) + 1) OVER (
  PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {TEXT_PART})::BIGINT AS part FROM documents)
SELECT source AS src, part, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM t GROUP BY source, part""")
def q_read_text_files(spark, sf_dir):
    """Text files of bounded size: a row for each file, however large its source."""
    d = load_table(spark, sf_dir, "documents")
    path = shared_dir(spark, "text-files")
    files.write_text_files(d, path, "source", "text", "doc_id", TEXT_PART)
    r = files.read_text_files(spark, path)
    return r.select(F.regexp_extract("source", r"source=([^/]+)/", 1).alias("src"),
                    F.regexp_extract("source", r"part=([0-9]+)/", 1).cast("long").alias("part"), "content")


# --- A2: inline text as documents ------------------------------------------------
@register("inline_documents", sql="""SELECT text AS content, 'inline-' || doc_id::VARCHAR AS source FROM documents
WHERE coalesce(length(text), 0) > 0""")
def q_inline_documents(spark, sf_dir):
    """Inputs that route to the inline loader, as documents with the source they are given."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    inline = P.route_source(d, "source", "text").filter("route = 'string'")
    return P.string_documents(inline.withColumn("given", F.concat(F.lit("inline-"), F.col("doc_id").cast("string"))), "text", "given")


# --- A10 / M7: arrays of records and strings ---------------------------------------
# Arrays of up to 50 elements: strings, records, a null, a number and a record without content.
JSON_SQL = """WITH e AS (SELECT doc_id, source, text, doc_id // 50 AS blk, doc_id % 7 AS m,
  (row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1)::INT AS pos FROM documents)"""


def json_arrays(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    one = F.to_json(F.array("text"))
    m = F.col("doc_id") % 7
    e = (F.when(m < 2, F.expr("substring(one, 2, length(one) - 2)")).when(m == 4, F.lit("null")).when(m == 5, F.col("doc_id").cast("string"))
         .when(m == 6, F.to_json(F.struct(F.col("source").alias("title"))))
         .otherwise(F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content")))))
    g = d.withColumn("one", one).withColumn("e", e).groupBy(F.floor(F.col("doc_id") / 50).cast("long").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "e"))).alias("l"))
    lines = g.select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]")).alias("value"))
    broken = spark.createDataFrame([("[1, ",), ("{\"title\": \"x\"}",), ("[]",)], "value string")
    path = shared_dir(spark, "json-arrays")
    lines.unionByName(broken).write.text(path)
    return files.json_array_elements(spark.read.text(path), "value")


@register("json_array_elements", sql=JSON_SQL + """
SELECT pos, CASE WHEN m < 2 THEN 'string' ELSE 'record' END AS kind, CASE WHEN m >= 2 THEN source END AS title, text AS content
FROM e WHERE m < 4""")
def q_json_array_elements(spark, sf_dir):
    return json_arrays(spark, sf_dir)[0].select("pos", "kind", "title", "content")


@register("json_array_rejects", sql=JSON_SQL + """
SELECT pos, CASE WHEN m = 6 THEN 'no content' ELSE 'neither string nor record' END AS reason FROM e WHERE m >= 4
UNION ALL SELECT NULL, 'not an array' FROM range(2)""")
def q_json_array_rejects(spark, sf_dir):
    return json_arrays(spark, sf_dir)[1].select("pos", "reason")


# --- A4 --------------------------------------------------------------------------
def _html_to_text_sql(c: str) -> str:
    c = f"regexp_replace({c}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&amp;", "&")):
        c = f"replace({c}, {lit(ent)}, {lit(ch)})"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@register("page_text", sql=f"""SELECT page_id, url, {_html_to_text_sql('html')} AS content FROM pages""")
def q_page_text(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages")
    return p.select("page_id", "url", P.html_to_text("html").alias("content"))


# --- A5 --------------------------------------------------------------------------
@register("docx_text", sql="""SELECT doc_id, coalesce(text, '') AS content FROM documents""")
def q_docx_text(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    path = shared_dir(spark, "docx")
    files.write_docx_rows(d, path, "doc_id", "text")
    r = files.read_docx_rows(spark, path)
    return r.select(F.regexp_extract("source", r"^(-?\d+)\.docx$", 1).cast("bigint").alias("doc_id"), "content")


# --- A6 / A7 / A8 ------------------------------------------------------------------
@register("page_documents", sql="""SELECT conv_id, turn, role,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS page_no,
  count(*) OVER (PARTITION BY conv_id)::BIGINT AS total_pages
FROM conversations""")
def q_page_documents(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return P.page_documents(c, "conv_id", "turn")


@register("concat_pages", sql="""SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS content,
       count(*)::BIGINT AS pages
FROM conversations GROUP BY conv_id""")
def q_concat_pages(spark, sf_dir):
    return P.concat_pages(load_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@register("join_lines", sql="""SELECT doc_id, array_to_string(string_split(text, chr(10)), ' ') AS content
FROM documents""")
def q_join_lines(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", P.join_lines("text").alias("content"))


# --- A9 --------------------------------------------------------------------------
EVENTS_PROPS_SQL = (f"(SELECT event_id, props FROM events UNION ALL "
                    f"{values(PROPS_ROWS, ['event_id', 'props'], ['BIGINT', 'VARCHAR'])})")


@register("meta_filter", sql=f"""SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM {EVENTS_PROPS_SQL})
WHERE json_type(props, '$."' || key || '"') IN ('VARCHAR', 'BIGINT', 'UBIGINT')""")
def q_meta_filter(spark, sf_dir):
    extra = spark.createDataFrame(PROPS_ROWS, "event_id long, props string")
    ev = load_table(spark, sf_dir, "events").select("event_id", "props").unionByName(extra)
    return P.typed_metadata(ev, "props", ["event_id"])


# --- A10 / A13 -------------------------------------------------------------------------
@register("read_json_records", sql="""SELECT doc_id, array_to_string(string_split(text, ';')[1:2], '') AS title,
       text AS content FROM documents""")
def q_read_json_records(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    recs = d.select("doc_id", P.derive_title("text").alias("title"), F.col("text").alias("content"))
    path = shared_dir(spark, "json-records")
    files.write_json_records(recs, path)
    return files.read_json_records(spark, path, "doc_id long, title string, content string")


# --- A11 / A12 -------------------------------------------------------------------------
PAIRS_SQL = """SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


@register("eval_csv_roundtrip", sql=PAIRS_SQL)
def q_eval_csv_roundtrip(spark, sf_dir):
    from quarry.operators.prompt import dialogue_pairs
    pairs = dialogue_pairs(load_table(spark, sf_dir, "conversations"))
    csv_path, tsv_path = shared_dir(spark, "eval-csv"), shared_dir(spark, "eval-tsv")
    schema = "conv_id long, turn long, question string, answer string"
    files.write_delimited(pairs, csv_path, ",")
    back = files.read_delimited(spark, csv_path, ",", schema)
    files.write_delimited(back, tsv_path, "\t")
    return files.read_delimited(spark, tsv_path, "\t", schema)


# --- A14-A17 ------------------------------------------------------------------------------
@register("table_lifecycle", sql=f"""WITH {chunks_cte()}
SELECT store, source, count(*)::BIGINT AS n_rows, sum(length(content))::BIGINT AS n_chars,
       sum({text_hash_sql('content')})::BIGINT AS hash_sum, CASE store WHEN 'docs' THEN 6 ELSE 4 END::BIGINT AS n_columns
FROM chunks, (VALUES ('docs'), ('vectors')) AS s(store) GROUP BY store, source""")
def q_table_lifecycle(spark, sf_dir):
    chunks = chunk.chunk_windows(load_table(spark, sf_dir, "documents"))
    prefix = "quarry_" + uuid.uuid4().hex[:10]
    lex, vec = files.create_store_tables(spark, prefix, shared_dir(spark, "stores"))
    files.create_store_tables(spark, prefix, shared_dir(spark, "stores-again"))  # exists: no-op
    files.append_chunks(chunks, lex, "string")
    files.append_vectors(V.embed(chunks, "content", "embeddings").select(
        V.chunk_key().alias("pk"), "source", F.col("content").alias("text"), "embeddings"), vec)
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith(prefix)}
    assert names == {lex, vec}, names

    def summary(store, table, text):
        ncols = len(files.describe(spark, table).filter(~F.col("col_name").startswith("#")).collect())
        return spark.table(table).groupBy("source").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text)).cast("bigint").alias("n_chars"),
            F.sum(text_hash(text)).alias("hash_sum")).select(
            F.lit(store).alias("store"), "source", "n_rows", "n_chars", "hash_sum", F.lit(ncols).cast("bigint").alias("n_columns"))
    out = _checkpointed(summary("docs", lex, "content").unionByName(summary("vectors", vec, "text")))
    for t in (lex, vec):
        files.drop_table(spark, t)
    left = {t.name for t in spark.catalog.listTables() if t.name.startswith(prefix)}
    assert not left, left
    return out


# --- B1 / B2 -------------------------------------------------------------------------------
@register("allowed_files", sql=f"""SELECT page_id, url,
  (instr(url, '.') > 0 AND string_split(url, '.')[-1] IN ('txt', 'pdf', 'docx')) AS allowed
FROM {PAGES_NAMES_SQL}""")
def q_allowed_files(spark, sf_dir):
    return pages_with_names(spark, sf_dir).withColumn("allowed", P.allowed_file("url"))


@register("new_documents", sql="""SELECT doc_id, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_new_documents(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.new_only(d, load_table(spark, sf_dir, "labels"), ["doc_id"])


# --- B4 / B5 / B6 -----------------------------------------------------------------------------
DOCS_NL_SQL = (f"(SELECT doc_id, text FROM documents UNION ALL "
               f"{values(NEWLINE_ROWS, ['doc_id', 'text'], ['BIGINT', 'VARCHAR'])})")


@register("normalize_newlines", sql=f"""SELECT doc_id, {normalize_newlines_sql('text')} AS text
FROM {DOCS_NL_SQL}""")
def q_normalize_newlines(spark, sf_dir):
    extra = spark.createDataFrame(NEWLINE_ROWS, "doc_id long, text string")
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    return P.normalized(d, "text")


@register("strip_newlines", sql=f"""WITH {chunks_cte()}
SELECT doc_id, cont_id, replace(content, chr(10), '') AS content FROM chunks""")
def q_strip_newlines(spark, sf_dir):
    c = chunk.chunk_windows(load_table(spark, sf_dir, "documents"))
    return c.select("doc_id", "cont_id", F.replace("content", F.lit("\n"), F.lit("")).alias("content"))


@register("truncate_text", sql=f"""SELECT doc_id, substring(text, 1, {TEXT_MAX}) AS content FROM documents""")
def q_truncate_text(spark, sf_dir):
    return load_table(spark, sf_dir, "documents").select("doc_id", P.truncate("text").alias("content"))


# --- B7 -------------------------------------------------------------------------------------
FIXTURE_DIM = 64


@register("schema_rejects", sql=f"""SELECT 'document' AS kind, doc_id AS id,
  array_to_string(list_filter([CASE WHEN length(source) > {SOURCE_MAX} THEN 'source_too_long' END,
                               CASE WHEN length(text) > {TEXT_MAX} THEN 'text_too_long' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents
UNION ALL
SELECT 'vector' AS kind, vec_id AS id,
  array_to_string(list_filter([CASE WHEN len(embedding) <> {FIXTURE_DIM} THEN 'bad_width' END], lambda x: x IS NOT NULL), ',')
FROM embeddings""")
def q_schema_rejects(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    e = load_table(spark, sf_dir, "embeddings")
    dr = P.store_rejects(d, [("source_too_long", F.length("source") > SOURCE_MAX),
                             ("text_too_long", F.length("text") > TEXT_MAX)])
    er = P.store_rejects(e, [("bad_width", F.size("embedding") != FIXTURE_DIM)])
    return (dr.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "reasons")
            .unionByName(er.select(F.lit("vector").alias("kind"), F.col("vec_id").alias("id"), "reasons")))


# --- B8 / B9 ---------------------------------------------------------------------------------
DOCS_LIT_SQL = (f"(SELECT doc_id, text FROM documents UNION ALL "
                f"{values(LITERAL_ROWS, ['doc_id', 'text'], ['BIGINT', 'VARCHAR'])})")


@register("format_records", sql=f"""SELECT doc_id, replace(text, '简介:nan', '') AS title,
       replace(text, '简介:nan', '') AS content FROM {DOCS_LIT_SQL}""")
def q_format_records(spark, sf_dir):
    extra = spark.createDataFrame(LITERAL_ROWS, "doc_id long, text string")
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    return d.select("doc_id", P.clean_literal("text").alias("title"), P.clean_literal("text").alias("content"))


@register("derive_title", sql=f"""SELECT doc_id, array_to_string(string_split(text, ';')[1:2], '') AS title
FROM {DOCS_LIT_SQL}""")
def q_derive_title(spark, sf_dir):
    extra = spark.createDataFrame(LITERAL_ROWS, "doc_id long, text string")
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    return d.select("doc_id", P.derive_title("text").alias("title"))


# --- B10 / B11 / B12 ----------------------------------------------------------------------------
def _sample_sql(cap: int) -> str:
    return f"""SELECT doc_id, source, sample_rank FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id::VARCHAR), doc_id)::BIGINT
         AS sample_rank FROM documents) WHERE sample_rank <= {cap}"""


# The fixture has 50 documents per source at sf0.01, under both of the
# original caps; the *_small queries use caps that bind on it.
@register("stratified_sample", sql=_sample_sql(SAMPLE_CAP))
def q_stratified_sample(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.stratified_sample(d, "source", "doc_id", SAMPLE_CAP)


@register("eval_split", sql=_sample_sql(EVAL_PER_SOURCE))
def q_eval_split(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.stratified_sample(d, "source", "doc_id", EVAL_PER_SOURCE)


@register("stratified_sample_small", sql=_sample_sql(30))
def q_stratified_sample_small(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.stratified_sample(d, "source", "doc_id", 30)


@register("eval_split_small", sql=_sample_sql(10))
def q_eval_split_small(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.stratified_sample(d, "source", "doc_id", 10)


@register("first_n", sql="""SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100""")
def q_first_n(spark, sf_dir):
    return P.first_n(load_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@register("embedding_key", sql="""SELECT doc_id,
  CASE WHEN length(text) > 128 THEN array_to_string(string_split(text, ';')[1:2], '') ELSE text END AS embed_text
FROM documents""")
def q_embedding_key(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", P.embedding_key("text", P.derive_title("text")).alias("embed_text"))


# --- B13 / B14 ---------------------------------------------------------------------------------
@register("instruct_queries", sql=f"""SELECT item_id, {lit(QUERY_INSTRUCTION)} || text AS query FROM benchmark""")
def q_instruct_queries(spark, sf_dir):
    b = load_table(spark, sf_dir, "benchmark")
    return b.select("item_id", P.instruct("text", QUERY_INSTRUCTION).alias("query"))


_INSTR_SQL = values(TASK_INSTRUCTIONS, ["task", "side", "prefix"], ["VARCHAR"] * 3)


@register("task_instructions", sql=f"""SELECT c.conv_id, c.turn, 'chat' AS task,
  CASE c.role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'key' ELSE 'none' END AS side,
  coalesce(i.prefix, '') || c.text AS instructed
FROM conversations c LEFT JOIN {_INSTR_SQL} i
  ON i.task = 'chat' AND i.side = CASE c.role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'key' ELSE 'none' END""")
def q_task_instructions(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    side = F.when(F.col("role") == "user", "query").when(F.col("role") == "assistant", "key").otherwise("none")
    out = P.task_instructed(c, P.instruction_table(spark), F.lit("chat"), side, "text")
    return out.select("conv_id", "turn", "task", "side", "instructed")


# --- B15 / B16 ---------------------------------------------------------------------------------
@register("parse_contexts", sql="""SELECT conv_id, list(text ORDER BY turn)[1] AS first_context,
       list(text ORDER BY turn)[-1] AS last_context, count(*)::BIGINT AS n_contexts
FROM conversations GROUP BY conv_id""")
def q_parse_contexts(spark, sf_dir):
    """Contexts of each conversation are written as a Python list literal
    (as the eval file holds them), parsed back without eval, then the
    literal column is dropped and the parsed one renamed (B15)."""
    c = load_table(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.getField("text"))
        .alias("ctx"))
    lit_df = lists.select("conv_id", P.python_list_literal(F.col("ctx")).alias("truth_contexts"))
    parsed = (lit_df.withColumn("contexts", P.parse_list_literal("truth_contexts"))
              .drop("truth_contexts"))
    return parsed.select("conv_id", F.element_at("contexts", 1).alias("first_context"),
                         F.element_at("contexts", -1).alias("last_context"),
                         F.size("contexts").cast("bigint").alias("n_contexts"))


@register("parse_list_literals")
def q_parse_list_literals(spark, sf_dir):
    """Hand-made literals of FIXTURES §3 (mixed quotes, escaped quote,
    malformed) appended to literals rendered from the benchmark table."""
    b = load_table(spark, sf_dir, "benchmark")
    rendered = b.select(F.col("item_id").alias("id"),
                        P.python_list_literal(F.array(F.col("text"), F.lit("x"))).alias("lit"))
    extra = spark.createDataFrame(LIST_ROWS, "id long, lit string")
    out = rendered.unionByName(extra).withColumn("parsed", P.parse_list_literal("lit"))
    return out.select("id", F.size("parsed").cast("bigint").alias("n"),
                      F.element_at("parsed", 1).alias("first"))
