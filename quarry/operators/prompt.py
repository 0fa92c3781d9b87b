"""Prompt assembly and batch answering.

Per-question lists are bounded by the rerank ``keep`` (3 by default), so
gathering a question's contexts into one row is a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.fixed import (CONTEXT_JOINER, PROMPT_ANSWER_LABEL, PROMPT_PREFIX,
                                    PROMPT_QUESTION_LABEL)


def _ordered(rank: str, *cols: str):
    return F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), *[F.col(c) for c in cols])))


def build_prompt(ranked: DataFrame, questions: DataFrame, qid: str = "item_id",
                 qtext: str = "text", rank: str = "rank", content: str = "content",
                 source: str = "source") -> DataFrame:
    """One row per question: numbered prompt, ``<i>: ...`` context and
    source strings, and the context list (F1, F2). Questions without any
    context still get a prompt with an empty context block."""
    g = ranked.groupBy(qid).agg(_ordered(rank, content, source).alias("_l"))
    items = F.coalesce(F.col("_l"), F.array().cast("array<struct<r:bigint,content:string,source:string>>"))
    numbered = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "),
                                                       x.getField(content), F.lit("\n")))
    ctx = F.transform(items, lambda x, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit(">: "),
                                                  x.getField(content)))
    src = F.transform(items, lambda x, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit(">: "),
                                                  x.getField(source)))
    q = questions.select(qid, F.col(qtext).alias("question"))
    return (q.join(g, qid, "left").select(
        qid, "question",
        F.concat(F.lit(PROMPT_PREFIX), F.array_join(numbered, ""), F.lit(PROMPT_QUESTION_LABEL),
                 F.col("question"), F.lit(PROMPT_ANSWER_LABEL)).alias("prompt"),
        F.array_join(ctx, CONTEXT_JOINER).alias("contexts"),
        F.array_join(src, CONTEXT_JOINER).alias("sources"),
        F.transform(items, lambda x: x.getField(content)).alias("contexts_list"),
        F.array_join(numbered, "").alias("contexts_body"),
        F.size(items).cast("bigint").alias("n_contexts")))


# --- F3-F10 ------------------------------------------------------------------

SENTENCE_END = r"[.!?。！？]+"


def compression_route(prompts: DataFrame, over: int = 500, qid: str = "item_id") -> DataFrame:
    """Route a prompt to compression when its numbered context block is
    longer than ``over`` characters (F3; off in the original flow)."""
    body = F.length(F.col("contexts_body"))
    return prompts.select(qid, body.cast("bigint").alias("body_len"),
                          F.when(body > over, F.lit("compress")).otherwise(F.lit("direct")).alias("route"))


def denoise(contexts: DataFrame, questions: DataFrame, min_overlap: float, qid: str = "item_id",
            qtext: str = "text", content: str = "content") -> DataFrame:
    """Drop contexts unrelated to the question (F4): keep those whose share
    of the question's distinct terms is above ``min_overlap``."""
    from quarry.functions.text import terms, token_overlap
    q = questions.select(qid, terms(qtext).alias("_qt"))
    scored = contexts.join(q, qid).withColumn(
        "overlap", F.round(token_overlap(F.col("_qt"), terms(content)), 6)).drop("_qt")
    return scored.filter(F.col("overlap") > F.lit(min_overlap))


def sentences(df: DataFrame, text_col: str, keys) -> DataFrame:
    """``(keys..., sent_pos, sentence)``: split on end punctuation, trimmed,
    empty pieces dropped; ``sent_pos`` is 1-based over kept pieces' slots."""
    return (df.select(*keys, F.posexplode(F.split(F.col(text_col), SENTENCE_END)).alias("p", "s"))
            .select(*keys, (F.col("p") + 1).cast("bigint").alias("sent_pos"), F.trim("s").alias("sentence"))
            .filter(F.length("sentence") > 0))


def compress(contexts: DataFrame, questions: DataFrame, budget: int, qid: str = "item_id",
             qtext: str = "text", rank: str = "rank", content: str = "content") -> DataFrame:
    """Keep the sentences most related to the question until ``budget``
    characters (F5), then restore reading order. One row per question.
    A question's sentences come from its reranked contexts (bounded)."""
    from quarry.functions.text import terms, token_overlap
    s = sentences(contexts, content, [qid, rank])
    q = questions.select(qid, terms(qtext).alias("_qt"))
    scored = s.join(q, qid).withColumn("overlap", F.round(token_overlap(F.col("_qt"), terms("sentence")), 6))
    w = (Window.partitionBy(qid).orderBy(F.desc("overlap"), rank, "sent_pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = (scored.withColumn("_run", F.sum(F.length("sentence")).over(w))
            .filter(F.col("_run") <= budget))
    text = kept.groupBy(qid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "sent_pos", "sentence"))),
                                 lambda x: x.getField("sentence")), " ").alias("compressed"),
        F.count(F.lit(1)).cast("bigint").alias("kept_sentences"))
    # a question whose best sentence is over the budget keeps its row, with nothing in it
    return (contexts.select(qid).distinct().join(text, qid, "left")
            .select(qid, F.coalesce("compressed", F.lit("")).alias("compressed"),
                    F.coalesce("kept_sentences", F.lit(0)).cast("bigint").alias("kept_sentences")))


def chat_messages(prompts: DataFrame, models, system_role: str, qid: str = "item_id",
                  glm_temperature: float = 0.8, other_temperature: float = 0.0,
                  max_tokens: int = 300) -> DataFrame:
    """Chat payload per (question, model) (F6, F7): a system and a user
    message; sampling by model. The model list is a bounded parameter and
    is exploded from a literal array, so no join is planned."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_role).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return (prompts.select(qid, "prompt", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
            .select(qid, "model", F.to_json(msgs).alias("messages"),
                    F.when(F.col("model") == "glm-4", F.lit(glm_temperature))
                    .otherwise(F.lit(other_temperature)).alias("temperature"),
                    F.lit(max_tokens).cast("bigint").alias("max_tokens")))


def dialogue_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Each user turn with the assistant turn that directly follows it
    (F8). An equi-join on ``(conv, turn + 1)`` instead of a per-conversation
    window, so one very long conversation is spread over many tasks."""
    users = turns.filter(F.col(role) == "user").select(conv, turn, F.col(text).alias("question"))
    nxt = turns.filter(F.col(role) == "assistant").select(
        F.col(conv), (F.col(turn) - 1).alias(turn), F.col(text).alias("answer"))
    return users.join(nxt, [conv, turn], "left")


def envelope(pairs: DataFrame) -> DataFrame:
    """Response status per answered question."""
    ok = F.col("answer").isNotNull()
    return pairs.select("*", F.when(ok, F.lit("success")).otherwise(F.lit("fail")).alias("status"),
                        F.when(ok, F.lit("")).otherwise(F.lit("no answer")).alias("error"))


def next_event(requests: DataFrame, responses: DataFrame, key: str, ts: str, eid: str, within: int) -> DataFrame:
    """Each request with the first response of its key at or after it, no more than
    ``within`` seconds later (the smaller id of equal times): the columns of
    ``requests`` and ``response_id``, ``response_ts``, ``response_type`` (null if none).

    A sorted merge within (key, stretch of ``within`` seconds): a stretch is a group of
    bounded time however hot the key. A request whose stretch holds no later response
    looks at the first one of the next stretch, which is joined by key and stretch.
    """
    stretch = lambda: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(within * 1_000_000)).cast("long")
    reply = F.struct(F.col(ts).alias("ts"), F.col(eid).alias("id"), F.col("event_type").alias("type"))
    rsp = responses.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), stretch().alias("_b"), F.lit(1).alias("_kind"), reply.alias("_r"))
    req = requests.select("*", F.col(key).alias("_k"), F.col(ts).alias("_t"), stretch().alias("_b"), F.lit(0).alias("_kind"))
    w = (Window.partitionBy("_k", "_b").orderBy("_t", "_kind", F.col("_r.id"))
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    merged = req.unionByName(rsp, allowMissingColumns=True).withColumn("_in", F.first("_r", True).over(w)).filter("_kind = 0")
    nxt = rsp.groupBy("_k", (F.col("_b") - 1).alias("_b")).agg(F.min("_r").alias("_next"))
    x = merged.join(nxt, (merged["_k"].eqNullSafe(nxt["_k"])) & (merged["_b"] == nxt["_b"]), "left")
    hit = F.coalesce("_in", "_next")
    near = F.unix_micros(hit["ts"].cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) <= within * 1_000_000
    hit = F.when(near, hit)
    return x.select(*requests.columns, hit["id"].alias("response_id"), hit["ts"].alias("response_ts"), hit["type"].alias("response_type"))


def timed_envelope(paired: DataFrame, ts: str = "ts", eid: str = "event_id") -> DataFrame:
    """The response envelope (F9, M11) of requests paired by ``next_event`` and joined to
    their answers: status, error text, elapsed milliseconds, contexts and sources."""
    error = (F.when(F.col("response_id").isNull(), "no response").when(F.col("response_type") == "error", "error response")
             .when(F.col("answer").isNull(), "no answer").otherwise(""))
    return paired.withColumn("error", error).select(
        "qa_id", F.col(eid).alias("request_id"), "response_id", "question", F.when(F.col("error") == "", F.col("answer")).alias("answer"),
        F.when(F.col("error") == "", "success").otherwise("fail").alias("status"), "error",
        F.expr(f"(unix_micros(cast(response_ts as timestamp)) - unix_micros(cast({ts} as timestamp))) div 1000").alias("elapsed_ms"),
        F.coalesce("contexts", F.lit("")).alias("contexts"), F.coalesce("sources", F.lit("")).alias("sources"))


def progress_batches(questions: DataFrame, order_col: str, every: int = 50) -> DataFrame:
    """Batch number of each question for partial results every ``every``
    rows (F10), from a distributed global row number."""
    from quarry.plans.strategy import global_row_number
    return (global_row_number(questions, [order_col])
            .withColumn("batch", F.floor((F.col("rn") - 1) / every).cast("bigint")))
