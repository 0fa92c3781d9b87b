"""Registered queries: hybrid retrieval with both legs, leg counts and
batch answering (E8, I4, F3-F10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fixed import (COMPRESS_OVER, LEXICAL_TOPK, PROGRESS_EVERY, RERANK_KEEP,
                                    SYSTEM_ROLE, VECTOR_TOPK)
from quarry.functions.text import terms, terms_sql
from quarry.operators import prompt, retrieve
from quarry.operators import vectors as V
from quarry.plans.corpus import chunk_table, chunk_vectors
from quarry.plans.registry import register
from quarry.plans.retrieval import PROMPT_CTES, flagship, lexical_contexts, lexical_hits
from quarry.plans.sqlparts import bm25_ctes, chunks_cte, feature_sql, lit, rerank_ctes
from quarry.plans.strategy import _checkpointed
from quarry.plans.vector_search import FIXTURE_THRESHOLD
from quarry.session import load_table

FANOUT_MODELS = ["glm-4", "qwen-turbo"]
DENOISE_MIN = 0.2


def vector_leg(spark, sf_dir, k=VECTOR_TOPK, min_score=FIXTURE_THRESHOLD):
    """Vector hits per benchmark question: every chunk and every question is
    encoded into one space, and a hit is the chunk that matched, whole. The
    chunks' vectors are stored, so a search encodes the questions only."""
    q = V.embed(load_table(spark, sf_dir, "benchmark"), "text", "qvec").select("item_id", "qvec")
    found = chunk_vectors(spark, sf_dir).search(q, k, qid="item_id", iid="chunk_id")
    hits = V.threshold(found, min_score)
    return chunk_table(spark, sf_dir).join(hits, "chunk_id").select(
        "item_id", "doc_id", "cont_id", "content", "source", "score", "rank")


def hybrid(spark, sf_dir):
    return retrieve.hybrid_context(vector_leg(spark, sf_dir), lexical_hits(spark, sf_dir))


VEC_SQL = f"""vq AS ({feature_sql("item_id", "text", "benchmark")}),
vc AS ({feature_sql("doc_id, cont_id", "content", "chunks")}),
vs AS (SELECT vq.item_id, vc.doc_id, vc.cont_id, round(sum(vq.w * vc.w), 6) AS score
       FROM vq JOIN vc ON vq.pos = vc.pos GROUP BY vq.item_id, vc.doc_id, vc.cont_id),
vec AS (SELECT v.item_id, v.doc_id, v.cont_id, c.content, c.source, v.score, v.rank
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, cont_id)::BIGINT AS rank FROM vs) v
        JOIN chunks c ON c.doc_id = v.doc_id AND c.cont_id = v.cont_id
        WHERE v.rank <= {VECTOR_TOPK} AND v.score > {FIXTURE_THRESHOLD})"""

HYBRID_SQL = f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK)},
{VEC_SQL},
legs AS (
  SELECT item_id, content, source, 0::BIGINT AS leg, rank AS leg_rank FROM vec
  UNION ALL
  SELECT item_id, content, source, 1::BIGINT AS leg, rank AS leg_rank FROM lex
),
firsts AS (
  SELECT item_id, content, source, leg, leg_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, content, source ORDER BY leg, leg_rank) AS k FROM legs)
  WHERE k = 1
),
ctx AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY leg, leg_rank)::BIGINT AS pos FROM firsts
)"""


# --- E1 leg of E8 ------------------------------------------------------------
@register("vector_leg", sql=f"""WITH {chunks_cte()},
{VEC_SQL}
SELECT item_id, doc_id, cont_id, content, source, score, rank FROM vec""")
def q_vector_leg(spark, sf_dir):
    return vector_leg(spark, sf_dir)


# --- E8 ----------------------------------------------------------------------
@register("hybrid_context", sql=HYBRID_SQL + """
SELECT item_id, content, source, leg, leg_rank, pos FROM ctx""")
def q_hybrid_context(spark, sf_dir):
    return hybrid(spark, sf_dir)


# --- I4 ----------------------------------------------------------------------
@register("leg_counts", sql=HYBRID_SQL + """,
vcount AS (SELECT item_id, count(*)::BIGINT AS n FROM vec GROUP BY item_id),
lc AS (SELECT item_id, count(*)::BIGINT AS n FROM lex GROUP BY item_id),
mc AS (SELECT item_id, count(*)::BIGINT AS n, sum(len(""" + terms_sql("content", False) + """))::BIGINT AS tokens FROM ctx GROUP BY item_id)
SELECT b.item_id, coalesce(vcount.n, 0)::BIGINT AS vector_hits, coalesce(lc.n, 0)::BIGINT AS lexical_hits,
       coalesce(mc.n, 0)::BIGINT AS merged, (coalesce(mc.tokens, 0) + len(""" + terms_sql("b.text", False) + """))::BIGINT AS tokens
FROM benchmark b LEFT JOIN vcount ON vcount.item_id = b.item_id LEFT JOIN lc ON lc.item_id = b.item_id
LEFT JOIN mc ON mc.item_id = b.item_id""")
def q_leg_counts(spark, sf_dir):
    """Hits of each leg, merged contexts, and the tokens of question and contexts."""
    b = load_table(spark, sf_dir, "benchmark")
    # k rows a question, looked at twice: by themselves and merged
    vec, lex = _checkpointed(vector_leg(spark, sf_dir)), _checkpointed(lexical_hits(spark, sf_dir))
    merged = retrieve.hybrid_context(vec, lex)

    def n(df, name, *more):
        return df.groupBy("item_id").agg(F.count(F.lit(1)).cast("bigint").alias(name), *more)
    used = F.sum(F.size(terms("content", False))).alias("used")
    out = (b.join(n(vec, "vector_hits"), "item_id", "left").join(n(lex, "lexical_hits"), "item_id", "left")
           .join(n(merged, "merged", used), "item_id", "left"))
    tokens = (F.coalesce("used", F.lit(0)) + F.size(terms("text", False))).cast("bigint").alias("tokens")
    return out.select("item_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                   for c in ("vector_hits", "lexical_hits", "merged")], tokens)


# --- E8 + E10 + F1 with both legs -------------------------------------------------
@register("hybrid_prompt", sql=HYBRID_SQL + f""",
{rerank_ctes(RERANK_KEEP, 'ctx')},
agg AS (
  SELECT item_id, string_agg(rank::VARCHAR || ': ' || content || chr(10), '' ORDER BY rank) AS body,
         count(*)::BIGINT AS n_contexts
  FROM rr GROUP BY item_id
)
SELECT b.item_id,
       '<文本片段>:' || chr(10) || chr(10) || coalesce(a.body, '') || chr(10) || '<问题>: ' || b.text
         || chr(10) || '<回答>: ' AS prompt,
       coalesce(a.n_contexts, 0)::BIGINT AS n_contexts
FROM benchmark b LEFT JOIN agg a ON a.item_id = b.item_id""")
def q_hybrid_prompt(spark, sf_dir):
    questions = load_table(spark, sf_dir, "benchmark")
    rr = retrieve.rerank(questions, hybrid(spark, sf_dir), keep=RERANK_KEEP)
    return prompt.build_prompt(rr, questions).select("item_id", "prompt", "n_contexts")


# --- F3 ----------------------------------------------------------------------
@register("compression_route", sql=PROMPT_CTES + f"""
SELECT item_id, length(contexts_body)::BIGINT AS body_len,
       CASE WHEN length(contexts_body) > {COMPRESS_OVER} THEN 'compress' ELSE 'direct' END AS route
FROM prompts""")
def q_compression_route(spark, sf_dir):
    questions = load_table(spark, sf_dir, "benchmark")
    rr = retrieve.rerank(questions, lexical_contexts(spark, sf_dir), keep=RERANK_KEEP)
    return prompt.compression_route(prompt.build_prompt(rr, questions), COMPRESS_OVER)


# --- F4 ----------------------------------------------------------------------
_QT = f"list_distinct({terms_sql('q.text')})"
_OVERLAP = (f"(CASE WHEN len({_QT}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({_QT}, {terms_sql('x.content')}))::DOUBLE / len({_QT}) END)")


from quarry.plans.retrieval import LEX_CONTEXT_SQL  # noqa: E402


@register("denoise_contexts", sql=LEX_CONTEXT_SQL + f"""
SELECT x.item_id, x.content, x.source, x.pos, round({_OVERLAP}, 6) AS overlap
FROM ctx x JOIN benchmark q ON q.item_id = x.item_id
WHERE round({_OVERLAP}, 6) > {DENOISE_MIN}""")
def q_denoise_contexts(spark, sf_dir):
    d = prompt.denoise(lexical_contexts(spark, sf_dir), load_table(spark, sf_dir, "benchmark"), DENOISE_MIN)
    return d.select("item_id", "content", "source", "pos", "overlap")


# --- F5 ----------------------------------------------------------------------
_QS = f"list_distinct({terms_sql('q.text')})"
_SOVERLAP = (f"(CASE WHEN len({_QS}) = 0 THEN 0.0 ELSE "
             f"len(list_intersect({_QS}, {terms_sql('s.sentence')}))::DOUBLE / len({_QS}) END)")


@register("compress_contexts", sql=LEX_CONTEXT_SQL + f""",
{rerank_ctes(RERANK_KEEP, 'ctx')},
sents AS (
  SELECT item_id, rank, sent_pos, trim(piece) AS sentence FROM (
    SELECT item_id, rank, unnest(regexp_split_to_array(content, '{prompt.SENTENCE_END}')) AS piece,
           generate_subscripts(regexp_split_to_array(content, '{prompt.SENTENCE_END}'), 1)::BIGINT AS sent_pos
    FROM rr)
  WHERE length(trim(piece)) > 0
),
sscored AS (
  SELECT s.*, round({_SOVERLAP}, 6) AS overlap FROM sents s JOIN benchmark q ON q.item_id = s.item_id
),
run AS (
  SELECT *, sum(length(sentence)) OVER (PARTITION BY item_id ORDER BY overlap DESC, rank, sent_pos
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM sscored
)
SELECT item_id, coalesce(string_agg(sentence, ' ' ORDER BY rank, sent_pos) FILTER (r <= {COMPRESS_OVER}), '') AS compressed,
       count(*) FILTER (r <= {COMPRESS_OVER})::BIGINT AS kept_sentences
FROM (SELECT DISTINCT item_id FROM rr) q LEFT JOIN run USING (item_id) GROUP BY item_id""")
def q_compress_contexts(spark, sf_dir):
    questions = load_table(spark, sf_dir, "benchmark")
    rr = retrieve.rerank(questions, lexical_contexts(spark, sf_dir), keep=RERANK_KEEP)
    return prompt.compress(rr, questions, COMPRESS_OVER)


# --- F6 / F7 -------------------------------------------------------------------
def _messages_sql(prompt_col: str) -> str:
    return (f"to_json([{{'role': 'system', 'content': {lit(SYSTEM_ROLE)}}}, "
            f"{{'role': 'user', 'content': {prompt_col}}}])::VARCHAR")


@register("chat_messages", sql=PROMPT_CTES + f""",
models AS (SELECT unnest(['glm-4']) AS model)
SELECT p.item_id, m.model, {_messages_sql('p.prompt')} AS messages,
       CASE WHEN m.model = 'glm-4' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS temperature, 300::BIGINT AS max_tokens
FROM prompts p CROSS JOIN models m""")
def q_chat_messages(spark, sf_dir):
    return prompt.chat_messages(flagship(spark, sf_dir), ["glm-4"], SYSTEM_ROLE)


@register("multi_model_fanout", sql=PROMPT_CTES + f""",
models AS (SELECT unnest({FANOUT_MODELS!r}) AS model)
SELECT p.item_id, m.model, CASE WHEN m.model = 'glm-4' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS temperature,
       md5({_messages_sql('p.prompt')}) AS messages_md5
FROM prompts p CROSS JOIN models m""")
def q_multi_model_fanout(spark, sf_dir):
    m = prompt.chat_messages(flagship(spark, sf_dir), FANOUT_MODELS, SYSTEM_ROLE)
    return m.select("item_id", "model", "temperature", F.md5("messages").alias("messages_md5"))


# --- F8 / F9 -------------------------------------------------------------------
PAIRS_SQL = """SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


@register("attach_answers", sql=PAIRS_SQL)
def q_attach_answers(spark, sf_dir):
    return prompt.dialogue_pairs(load_table(spark, sf_dir, "conversations"))


@register("response_envelope", sql=f"""SELECT *, CASE WHEN answer IS NULL THEN 'fail' ELSE 'success' END AS status,
       CASE WHEN answer IS NULL THEN 'no answer' ELSE '' END AS error
FROM ({PAIRS_SQL})""")
def q_response_envelope(spark, sf_dir):
    return prompt.envelope(prompt.dialogue_pairs(load_table(spark, sf_dir, "conversations")))


# --- F10 -----------------------------------------------------------------------
@register("batch_progress", sql=f"""SELECT item_id, rn, ((rn - 1) // {PROGRESS_EVERY})::BIGINT AS batch
FROM (SELECT item_id, row_number() OVER (ORDER BY item_id)::BIGINT AS rn FROM benchmark)""")
def q_batch_progress(spark, sf_dir):
    b = load_table(spark, sf_dir, "benchmark").select("item_id")
    return prompt.progress_batches(b, "item_id", PROGRESS_EVERY)
