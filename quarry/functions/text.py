"""Text column expressions (JVM-side built-ins and higher-order functions).

Each builder returns a ``Column``; the ``*_sql`` twin returns the same
computation as a DuckDB SQL fragment, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.fixed import STOP_WORDS

# Han ideographs are segmented into overlapping character bigrams; all other
# letter/digit runs are whole terms.
CJK_CHAR = r"[\x{4e00}-\x{9fff}]"
WORD_RUN = r"[\p{L}\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _has_cjk(col) -> Column:
    return _c(col).rlike(CJK_CHAR)


def word_terms(col) -> Column:
    """Lower-cased letter/digit runs with Han characters blanked out."""
    low = F.lower(_c(col))
    src = F.when(_has_cjk(col), F.regexp_replace(low, CJK_CHAR, " ")).otherwise(low)
    return F.regexp_extract_all(src, F.lit(WORD_RUN), 0)


def cjk_bigrams(col) -> Column:
    """Overlapping bigrams of each Han run (a one-character run is itself)."""
    runs = F.regexp_extract_all(_c(col), F.lit(CJK_CHAR + "+"), 0)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))),
        lambda i: F.substring(r, i, 2))))
    return F.when(_has_cjk(col), grams).otherwise(F.array().cast("array<string>"))


def terms(col, drop_stop_words: bool = True) -> Column:
    """Analyse text to index/search terms (array<string>, with repeats).

    Text without Han characters takes one regex pass plus one scan; the
    stop-word test is a hash-set ``IN``.
    """
    t = F.concat(word_terms(col), cjk_bigrams(col))
    if drop_stop_words:
        t = F.filter(t, lambda x: ~x.isin(*STOP_WORDS))
    return t


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def terms_sql(col: str, drop_stop_words: bool = True) -> str:
    words = (f"regexp_extract_all(regexp_replace(lower({col}), '{CJK_CHAR}', ' ', 'g'), "
             f"'{WORD_RUN}')")
    bigrams = (f"flatten(list_transform(regexp_extract_all({col}, '{CJK_CHAR}+'), "
               f"lambda r: list_transform(range(1, greatest(length(r) - 1, 1) + 1), "
               f"lambda i: substring(r, i, 2))))")
    t = f"list_concat({words}, {bigrams})"
    if drop_stop_words:
        t = f"list_filter({t}, lambda x: NOT list_contains({_sql_list(STOP_WORDS)}, x))"
    return t


def text_hash(col) -> Column:
    """32 bits of a string's MD5 as BIGINT: the same number in any engine."""
    return F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("bigint")


def text_hash_sql(col: str) -> str:
    return f"('0x' || substring(md5({col}), 1, 8))::BIGINT"


def normalize_newlines(col) -> Column:
    """Blank-line collapse first, then CRLF to LF, each to a fixpoint.

    Doing the two rewrites in this order keeps ``\\r\\n\\r\\n`` as a blank
    line, exactly as the upload handler does.
    """
    return F.regexp_replace(F.regexp_replace(_c(col), r"\n{2,}", "\n"), r"\r+\n", "\n")


def normalize_newlines_sql(col: str) -> str:
    return (f"regexp_replace(regexp_replace({col}, '\\n{{2,}}', chr(10), 'g'), "
            f"'\\r+\\n', chr(10), 'g')")


def char_set(col) -> Column:
    """Distinct characters of a string; empty string gives an empty array."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(c, "")))


def char_set_sql(col: str) -> str:
    return (f"(CASE WHEN length({col}) = 0 THEN []::VARCHAR[] "
            f"ELSE list_distinct(string_split({col}, '')) END)")


def char_jaccard(a, b) -> Column:
    """|chars(a) & chars(b)| / |chars(a) | chars(b)|, 0.0 when both empty."""
    sa, sb = char_set(a), char_set(b)
    union = F.size(F.array_union(sa, sb))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(sa, sb)).cast("double") / union)


def char_jaccard_sql(a: str, b: str) -> str:
    sa, sb = char_set_sql(a), char_set_sql(b)
    union = f"length(list_distinct(list_concat({sa}, {sb})))"
    inter = f"length(list_intersect({sa}, {sb}))"
    return f"(CASE WHEN {union} = 0 THEN 0.0 ELSE {inter}::DOUBLE / {union} END)"


def token_overlap(a_terms: Column, b_terms: Column) -> Column:
    """Share of distinct terms of ``a`` that also occur in ``b`` (0 if none)."""
    da = F.array_distinct(a_terms)
    return F.when(F.size(da) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(da, b_terms)).cast("double") / F.size(da))


def token_overlap_sql(a_terms: str, b_terms: str) -> str:
    da = f"list_distinct({a_terms})"
    return (f"(CASE WHEN length({da}) = 0 THEN 0.0 ELSE "
            f"length(list_intersect({da}, {b_terms}))::DOUBLE / length({da}) END)")
