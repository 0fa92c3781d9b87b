"""The registered queries: each operator over its whole table, with production
parameters, and its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import (bestfit, dart_minhash, divergence, fertility, html_extract, line_dedup, multi_index, pii,
                        quality_cnn, secret_link, sp_encode, strata_index, url_tree)
from quarry.llm.common import table

#: The vocabulary that operators 2 and 6 take; its path is a parameter of theirs.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its bin and its place there."""
    return bestfit.best_fit(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: tokens, hash of the ids and of the decoded text."""
    return sp_encode.encode_decode(table(spark, sf_dir, "documents"), sp_encode.read_model(PIECES))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of near copies."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the text that stays, lines before and after."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base counts, token measures, and whether it is kept."""
    return fertility.judge(table(spark, sf_dir, "documents"), sp_encode.read_model(PIECES))


def op7_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, rule and verdict."""
    return url_tree.judge(table(spark, sf_dir, "pages"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its score and the prediction."""
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op9_secret_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its base spans and all spans."""
    return secret_link.scan(table(spark, sf_dir, "documents"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_candidate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its base spans and all spans of personal data."""
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.train(docs))


def op12_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return strata_index.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances between the sources of each language, and their risen terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_sentencepiece, op3_dart_minhash, op4_html_extract,
                            op5_line_dedup, op6_fertility, op7_url_tree, op8_quality_cnn, op9_secret_link,
                            op10_multi_index, op11_candidate_pii, op12_strata_search, op13_divergence_audit)
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {"op7_url_tree": url_tree.oracle(), "op9_secret_link": secret_link.oracle(),
                              "op12_strata_search": strata_index.oracle(), "op13_divergence_audit": divergence.oracle()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
