"""Routing, extraction and preparation of input rows (A1, A2, A4, A6-A9,
B1-B16). All are per-row expressions or skew-safe aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import (ALLOWED_EXTENSIONS, EMBED_TITLE_OVER, EMPTY_INTRO_LITERAL,
                                    TASK_INSTRUCTIONS, TEXT_MAX)
from quarry.functions.text import normalize_newlines
from quarry.plans.strategy import global_row_number, top_k


# --- A1 / A2 -------------------------------------------------------------------
def route_source(df: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    """Loader route per input, first match wins: inline content → 'string';
    suffix .txt/.pdf/.docx (case-sensitive) → that type; 'http' anywhere →
    'url'; otherwise '' (unsupported, no document)."""
    p = F.col(path)
    r = F.when(p.endswith(".txt"), "txt").when(p.endswith(".pdf"), "pdf") \
        .when(p.endswith(".docx"), "docx").when(p.contains("http"), "url").otherwise("")
    if content is not None:
        r = F.when(F.coalesce(F.length(content), F.lit(0)) > 0, F.lit("string")).otherwise(r)
    return df.withColumn("route", r)


def string_documents(df: DataFrame, content: str, source: str) -> DataFrame:
    """Inline text as one document with the given source (A2)."""
    return df.select(F.col(content).alias("content"), F.col(source).alias("source"))


# --- A4 ------------------------------------------------------------------------
def html_to_text(col) -> Column:
    """Visible text of a fetched page: drop script/style blocks and
    comments, replace tags with spaces, decode the common entities,
    collapse whitespace."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# --- A6 / A7 / A8 --------------------------------------------------------------
def page_documents(pages: DataFrame, source: str, page: str) -> DataFrame:
    """0-based page number and page count per source (A6), without a
    per-source window: a distributed global row number over (source, page)
    minus the first number of the source, and counts from a partial
    aggregate. A source holding a third of all pages is still split."""
    numbered = global_row_number(pages, [source, page], "_g")
    firsts = numbered.groupBy(F.col(source).alias("_s")).agg(
        F.min("_g").alias("_first"), F.count(F.lit(1)).cast("bigint").alias("total_pages"))
    # pages without a source are one source
    return (numbered.join(firsts, numbered[source].eqNullSafe(firsts["_s"]))
            .withColumn("page_no", (F.col("_g") - F.col("_first")).cast("bigint"))
            .drop("_g", "_first", "_s"))


def concat_pages(pages: DataFrame, source: str, page: str, text: str, sep: str = "\f") -> DataFrame:
    """All pages of a source as one document, in page order (A7). The
    output row is the whole document, so its size is the document's."""
    return pages.groupBy(source).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))),
                                 lambda x: x.getField(text)), sep).alias("content"),
        F.count(F.lit(1)).cast("bigint").alias("pages"))


def join_lines(col) -> Column:
    """A page's lines joined with one space."""
    return F.array_join(F.split(F.col(col) if isinstance(col, str) else col, "\n"), " ")


# --- A9 --------------------------------------------------------------------------
def typed_metadata(df: DataFrame, json_col: str, keys) -> DataFrame:
    """Keep only string and integer entries of a JSON object column (A9):
    ``(keys..., key, value)``. Values are parsed as VARIANT so the JSON
    type survives (floats, booleans, nulls, arrays and objects drop)."""
    m = F.from_json(F.col(json_col), "map<string,variant>")
    kept = F.map_filter(m, lambda k, v: F.schema_of_variant(v).isin("STRING", "BIGINT"))
    return (df.select(*keys, F.explode_outer(kept).alias("key", "v"))
            .filter(F.col("key").isNotNull())
            .select(*keys, "key", F.col("v").cast("string").alias("value")))


# --- B1 / B2 ---------------------------------------------------------------------
def allowed_file(col, allowed=ALLOWED_EXTENSIONS) -> Column:
    """A dot in the name and the text after the last dot in the allow-list
    (case-sensitive)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.instr(c, ".") > 0) & F.element_at(F.split(c, r"\."), -1).isin(*allowed)


def new_only(new: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """Rows whose key is not already ingested (B2): a left-anti join."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


# --- B4-B9 -----------------------------------------------------------------------
def normalized(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, normalize_newlines(col))


def truncate(col, n: int = TEXT_MAX) -> Column:
    return F.substring(F.col(col) if isinstance(col, str) else col, 1, n)


def store_rejects(df: DataFrame, checks) -> DataFrame:
    """Split rows by store limits (B7): ``checks`` is ``[(reason, Column
    that is true when violated)]``; adds ``reasons`` (comma-joined) and
    ``valid``."""
    arr = F.array(*[F.when(cond, F.lit(reason)) for reason, cond in checks])
    reasons = F.filter(arr, lambda x: x.isNotNull())
    return df.withColumn("reasons", F.array_join(reasons, ",")).withColumn(
        "valid", F.size(reasons) == 0)


def clean_literal(col, literal: str = EMPTY_INTRO_LITERAL) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(c, F.lit(literal), F.lit(""))


def derive_title(col, sep: str = ";", fields: int = 2) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.slice(F.split(c, sep), 1, fields), "")


# --- B10 / B11 / B12 -----------------------------------------------------------------
def hash_order(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def stratified_sample(df: DataFrame, group: str, id_col: str, cap: int, seed: str = "42") -> DataFrame:
    """All rows of a group if it has fewer than ``cap``, else ``cap`` rows
    in a seeded hash order (B10). ``row_number() <= cap`` is planned with a
    partial WindowGroupLimit, so at most ``cap`` rows per group leave each
    map task even for a group holding a third of the table."""
    return top_k(df.withColumn("_h", hash_order(seed, id_col)), [group], ["_h", id_col], cap,
                 "sample_rank").drop("_h")


def first_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """Stop after the first ``n`` records (B11); a global top-n."""
    return df.orderBy(order_col).limit(n)


def embedding_key(content: str, title: Column, over: int = EMBED_TITLE_OVER) -> Column:
    """Text to embed: the title when the content is longer than ``over``
    characters, else the content (B12)."""
    return F.when(F.length(content) > over, title).otherwise(F.col(content))


# --- B13 / B14 -------------------------------------------------------------------------
def instruct(col, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col) if isinstance(col, str) else col)


def instruction_table(spark) -> DataFrame:
    return spark.createDataFrame(TASK_INSTRUCTIONS, "task string, side string, prefix string")


def task_instructed(df: DataFrame, instructions: DataFrame, task: Column, side: Column,
                    text: str) -> DataFrame:
    """Prefix each text with the instruction of its (task, side).
    The instruction table is a fixed list (12 rows): broadcast by bound."""
    x = df.withColumn("task", task).withColumn("side", side)
    return (x.join(F.broadcast(instructions), ["task", "side"], "left")
            .withColumn("instructed", F.concat(F.coalesce("prefix", F.lit("")), F.col(text)))
            .drop("prefix"))


# --- B15 / B16 -------------------------------------------------------------------------
def python_list_literal(arr) -> Column:
    """Render an array<string> as a Python list literal with single quotes
    (backslash, quote and newline escaped), as a CSV cell would hold it."""
    def esc(x):
        x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        x = F.replace(x, F.lit("'"), F.lit("\\'"))
        x = F.replace(x, F.lit("\n"), F.lit("\\n"))
        return F.concat(F.lit("'"), x, F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(arr, esc), ", "), F.lit("]"))


def parse_list_literal(col) -> Column:
    """Parse a Python list literal (single or double quotes) to
    array<string> without evaluating it; malformed input gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, "array<string>", {"allowSingleQuotes": "true",
                                             "allowBackslashEscapingAnyCharacter": "true"})


# --- convenience ----------------------------------------------------------------------------
__all__ = [n for n in dir() if not n.startswith("_")]
