"""Merging, deduplication and reranking of retrieved contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.fixed import RERANK_KEEP
from quarry.functions.text import terms, token_overlap
from quarry.plans.strategy import rounded, top_k


def hybrid_context(vector_hits: DataFrame, lexical_hits: DataFrame, qid: str = "item_id",
                   content: str = "content", source: str = "source") -> DataFrame:
    """Vector hits first, then lexical hits; exact (content, source)
    duplicates keep their first position. Output
    ``(qid, content, source, leg, leg_rank, pos)`` with ``pos`` 1-based.

    Each question has at most k hits per leg, so the per-question window
    is bounded by 2k rows regardless of corpus size.
    """
    both = (vector_hits.select(qid, content, source, F.lit(0).alias("leg"), F.col("rank").alias("leg_rank"))
            .unionByName(lexical_hits.select(qid, content, source, F.lit(1).alias("leg"),
                                             F.col("rank").alias("leg_rank"))))
    # dealt by question once: what follows, here and in a rerank or a prompt, needs no other shuffle of the texts
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), qid)
    first = (both.groupBy(qid, content, source)
             .agg(F.min(F.struct("leg", "leg_rank")).alias("f"))
             .select(qid, content, source, F.col("f.leg").cast("bigint").alias("leg"),
                     F.col("f.leg_rank").alias("leg_rank")))
    pos = F.row_number().over(Window.partitionBy(qid).orderBy("leg", "leg_rank"))
    return first.withColumn("pos", pos.cast("bigint"))


def exact_dedup(df: DataFrame, cols, order_col: str, carry=()) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each exact ``cols``
    value.

    Two phases so that the text itself is shuffled only for rows that may
    be duplicates: first only 64-bit hashes of the key are shuffled
    (partially aggregated) to find hashes seen more than once; rows with a
    unique hash are unique by key and pass through map-side. The rest are
    grouped exactly on the full key with a partial ``min(struct)``, so a
    value repeated in a third of all rows never gathers in one task. The
    plan is the same at every size; how the hashes are joined is left to
    the measured sizes (adaptive execution).
    """
    cols, carry = list(cols), list(carry)
    keyed = df.withColumn("_h", F.xxhash64(*cols))
    dup = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h")

    def exact(rows):
        agg = F.min(F.struct(order_col, *carry)).alias("_f")
        return rows.groupBy(*cols).agg(agg).select(
            *cols, F.col(f"_f.{order_col}").alias(order_col), *[F.col(f"_f.{c}").alias(c) for c in carry])
    unique = keyed.join(dup, "_h", "left_anti").select(*cols, order_col, *carry)
    return unique.unionByName(exact(keyed.join(dup, "_h", "left_semi")))


def rerank(questions: DataFrame, contexts: DataFrame, keep: int = RERANK_KEEP,
           qid: str = "item_id", qtext: str = "text", content: str = "content",
           prior: str = "pos", score_col: str | None = None) -> DataFrame:
    """Score each (question, context) pair and keep the best ``keep``.

    The built-in score is the share of the question's distinct terms found
    in the context (a lexical stand-in for a cross-encoder); a supplied
    ``score_col`` on ``contexts`` replaces it. Ties keep the prior order.
    Zero candidates give zero rows. Output adds ``rerank_score``, ``rank``.
    """
    q = questions.select(F.col(qid), terms(qtext).alias("_qt"))
    pairs = contexts.join(q, qid)
    score = F.col(score_col) if score_col else token_overlap(F.col("_qt"), terms(content))
    scored = pairs.withColumn("rerank_score", rounded(score)).drop("_qt")
    return top_k(scored, [qid], [F.desc("rerank_score"), prior], keep)


def passthrough_rerank(contexts: DataFrame, keep: int | None = None, qid: str = "item_id",
                       prior: str = "pos") -> DataFrame:
    """Identity rerank (E11): prior order, optionally cut at ``keep``."""
    if keep is None:
        return contexts.withColumn("rank", F.col(prior).cast("bigint"))
    return top_k(contexts, [qid], [prior], keep)
