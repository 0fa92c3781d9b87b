"""Text analysis: terms, stop words, dictionary hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.fixed import STOP_WORDS
from quarry.functions.text import terms


def stop_word_table(spark: SparkSession, words=STOP_WORDS) -> DataFrame:
    """The fixed stop-word list as a one-column DataFrame (33 rows)."""
    return spark.createDataFrame([(w,) for w in words], "term string")


def term_rows(df: DataFrame, text_col: str, keys, drop_stop_words: bool = False) -> DataFrame:
    """One row per term occurrence: ``(keys..., term)``. Map-only."""
    return (df.select(*keys, F.explode_outer(terms(text_col, drop_stop_words)).alias("term"))
            .filter(F.col("term").isNotNull()))


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus term frequencies ``(term, n)``; partial aggregation combines
    counts map-side so even a term in every row ships one row per task."""
    return (df.select(F.explode_outer(terms(text_col, False)).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def drop_stop_words(term_df: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Left-anti join against a word table. The table is a fixed list, so
    broadcasting it is bounded by construction."""
    return term_df.join(F.broadcast(stop_words), "term", "left_anti")


def dictionary_hits(df: DataFrame, text_col: str, words, keys) -> DataFrame:
    """Dictionary words contained in each text: ``(keys..., word)``.

    ``words`` is a bounded list (a user dictionary); it is inlined as an
    array literal and tested with ``contains`` per row, so no join is
    planned and the corpus side is never shuffled.
    """
    lits = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    hits = F.filter(lits, lambda w: F.contains(F.col(text_col), w))
    return df.select(*keys, F.explode_outer(hits).alias("word")).filter(F.col("word").isNotNull())


def trie_pattern(words) -> str:
    """A regular expression for the longest of ``words`` at a place: the words'
    prefix tree, where a node tries its children before it ends. What a place
    costs is the depth of the tree, not the number of words."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def quoted(c: str) -> str:
        return "\\" + c if c in r"\.[]{}()<>*+-=!?^$|&#~" else c

    def tree(node: dict) -> str:
        # single children are one run of characters: no deep nesting for long words
        ends, parts = "" in node, []
        for c, child in sorted((c, n) for c, n in node.items() if c):
            run = quoted(c)
            while len(child) == 1 and "" not in child:
                (c, child), = child.items()
                run += quoted(c)
            rest = tree(child) if set(child) != {""} else ""
            parts.append(run + rest)
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + "?" if ends else body

    heads = "".join(sorted(quoted(c) for c in root))
    return f"(?=[{heads}]){tree(root)}" if root else "(?!)"


def dictionary_matches(df: DataFrame, text_col: str, lists: DataFrame, keys) -> DataFrame:
    """Forward maximum matches of all categories of word lists (C8, C9):
    ``(keys..., category, word, n)``.

    From left to right, the longest word of any list that starts at a place is
    taken and the scan goes on behind it; where none starts, at the next character. A word
    of several lists counts for each. ``lists(category, term)`` is a dictionary, so it
    is bounded: it is read by the driver and becomes one expression, and each
    text is scanned once whatever the number of words.
    """
    by: dict[str, list[str]] = {}
    for r in lists.select("category", "term").distinct().collect():
        by.setdefault(r["term"], []).append(r["category"])
    found = F.regexp_extract_all(F.col(text_col), F.lit(trie_pattern(by)), F.lit(0))
    hits = (df.select(*keys, F.explode_outer(found).alias("word")).filter(F.col("word").isNotNull())
            .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")))
    return hits.join(F.broadcast(lists.select("category", F.col("term").alias("word")).distinct()), "word").select(
        *keys, "category", "word", "n")


def write_word_lists(spark: SparkSession, path: str, lists: dict) -> None:
    """Write word lists as one-word-per-line ``<category>.dic`` files."""
    for category, words in lists.items():
        (spark.createDataFrame([(w,) for w in words], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{path}/{category}"))


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(category, term)`` from ``<path>/<category>/`` text files (C9):
    one word per line, blank lines and a leading BOM dropped."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    cat = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    term = F.trim(F.regexp_replace(F.col("value"), r"^\x{feff}", ""))
    return raw.select(cat.alias("category"), term.alias("term")).filter(F.length("term") > 0)
