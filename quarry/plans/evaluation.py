"""Registered queries: attribution and evaluation.

The question/answer rows are the user→assistant pairs of
``conversations``; their contexts come from the same lexical retrieval,
dedup and rerank as the flagship (top-10 → top-3), rendered as the
``<i>: ...`` context string that the attribution step parses back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fixed import LEXICAL_TOPK, RERANK_KEEP
from quarry.functions.text import char_jaccard_sql, char_set_sql, terms_sql
from quarry.operators import attribution as G
from quarry.operators import lexical, prompt, retrieve
from quarry.plans.corpus import chunk_table, lexical_store, stored_table
from quarry.plans.registry import register
from quarry.plans.sqlparts import chunks_cte, feature_sql, lexical_context_ctes, values
from quarry.plans.strategy import global_row_number
from quarry.session import load_table, shared_dir
from quarry.sources import files

# Hand-made attribution rows (FIXTURES §3): ten and more markers, a marker
# inside a context's text, an empty answer, tied candidates.
HAND_QA = [
    (-1, "Who?", "alpha beta", "<1>: alpha\n\n<2>: beta <3>: gamma\n\n<3>: delta\n\n<4>: e\n\n<5>: f\n\n"
                              "<6>: g\n\n<7>: h\n\n<8>: i\n\n<9>: j\n\n<10>: kappa\n\n<11>: lambda"),
    (-2, "Empty?", "", "<1>: x"),
    (-3, "Tie?", "ab", "<1>: ba\n\n<2>: ab"),
]
HAND_COLS = ["qa_id", "question", "answer", "contexts"]
HAND_TYPES = ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR"]
CORRECT_AT = 0.5
SUPPORTED_AT = 0.5
METRICS = ["faithfulness", "answer_relevancy", "context_relevancy", "context_entity_recall"]


def qa_rows(spark, sf_dir):
    pairs = prompt.dialogue_pairs(load_table(spark, sf_dir, "conversations")).filter(
        F.col("answer").isNotNull())
    return global_row_number(pairs, ["conv_id", "turn"], "qa_id").select("qa_id", "question", "answer")


def qa_contexts(spark, sf_dir):
    """(qa_id, question, answer, contexts, sources) for every answered user turn: one
    stored table, which every metric reads instead of running retrieval again."""
    return stored_table(spark, sf_dir, "qa-contexts", ("documents", "conversations"), lambda: _qa_contexts(spark, sf_dir))


def _qa_contexts(spark, sf_dir):
    # read four times below
    qa = stored_table(spark, sf_dir, "qa-rows", ("conversations",), lambda: qa_rows(spark, sf_dir))
    lex = lexical.bm25_topk(qa, chunk_table(spark, sf_dir), k=LEXICAL_TOPK, qid="qa_id", qtext="question",
                            store=lexical_store(spark, sf_dir))
    empty = lex.select("qa_id", "content", "source", "rank").limit(0)
    ctx = retrieve.hybrid_context(empty, lex, qid="qa_id")
    rr = retrieve.rerank(qa, ctx, keep=RERANK_KEEP, qid="qa_id", qtext="question")
    p = prompt.build_prompt(rr, qa, qid="qa_id", qtext="question")
    hand = spark.createDataFrame(HAND_QA, "qa_id long, question string, answer string, contexts string")
    # rows are few and heavy: they stay as hybrid_context has spread them, one file a task
    return qa.join(p.select("qa_id", "contexts", "sources"), "qa_id").unionByName(hand, allowMissingColumns=True)


QA_SQL = f"""WITH {chunks_cte()},
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
),
qa AS (SELECT row_number() OVER (ORDER BY conv_id, turn)::BIGINT AS qa_id, question, answer FROM pairs),
{lexical_context_ctes('qa', 'qa_id', 'question', LEXICAL_TOPK, RERANK_KEEP)},
qctx AS (
  SELECT qa.qa_id, qa.question, qa.answer, coalesce(qctx0.contexts, '') AS contexts
  FROM qa LEFT JOIN qctx0 ON qctx0.qa_id = qa.qa_id
  UNION ALL
  SELECT * FROM {values(HAND_QA, HAND_COLS, HAND_TYPES)}
),
pieces AS (
  SELECT qa_id, answer, (generate_subscripts(p, 1) - 1)::BIGINT AS sent_pos, unnest(p) AS sentence
  FROM (SELECT qa_id, answer, list_filter(regexp_split_to_array(contexts, '<\\d+>:'), lambda x: x <> '') AS p
        FROM qctx)
),
sims AS (
  SELECT qa_id, answer, sent_pos, sentence, round({char_jaccard_sql('answer', 'sentence')}, 6) AS sim,
         row_number() OVER (PARTITION BY qa_id ORDER BY round({char_jaccard_sql('answer', 'sentence')}, 6) DESC,
                            sent_pos) = 1 AS is_best
  FROM pieces
),
chars AS (
  SELECT qa_id, sent_pos, 0::BIGINT AS char_pos, '<' || (sent_pos + 1)::VARCHAR || '>' AS token, 'other' AS label
  FROM sims
  UNION ALL
  SELECT qa_id, sent_pos, char_pos, token,
         CASE WHEN is_best AND list_contains(ans, token) THEN 'same' ELSE 'other' END AS label
  FROM (SELECT qa_id, sent_pos, is_best, {char_set_sql('answer')} AS ans,
               unnest(string_split(sentence, '')) AS token,
               generate_subscripts(string_split(sentence, ''), 1)::BIGINT AS char_pos
        FROM sims)
)"""


def _containment_sql(a: str, b: str) -> str:
    da = f"list_distinct({terms_sql(a)})"
    return (f"(CASE WHEN len({da}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({da}, {terms_sql(b)}))::DOUBLE / len({da}) END)")


def _sentences_sql(src: str, keep: str, text: str) -> str:
    return f"""SELECT {keep}, trim(piece) AS sentence FROM (
    SELECT {keep}, unnest(regexp_split_to_array({text}, '{prompt.SENTENCE_END}')) AS piece FROM {src})
  WHERE length(trim(piece)) > 0"""


ENT = "(?:^|[^\\p{L}\\p{N}])(\\p{Lu}[\\p{L}\\p{N}]*)"

METRICS_SQL = QA_SQL + f""",
corr AS (SELECT qa_id, round({_containment_sql('answer', 'contexts')}, 6) AS containment FROM qctx),
faith AS (
  SELECT qa_id, round(avg(CASE WHEN {_containment_sql('sentence', 'contexts')} >= {SUPPORTED_AT} THEN 1.0 ELSE 0.0 END),
                      6) AS faithfulness
  FROM ({_sentences_sql('qctx', 'qa_id, contexts', 'answer')}) GROUP BY qa_id
),
crel AS (
  SELECT qa_id, round(avg(CASE WHEN len(list_intersect({terms_sql('question')}, {terms_sql('sentence')})) > 0
                               THEN 1.0 ELSE 0.0 END), 6) AS context_relevancy
  FROM ({_sentences_sql('qctx', 'qa_id, question', 'contexts')}) GROUP BY qa_id
),
ents AS (
  SELECT qa_id, list_distinct(regexp_extract_all(answer, '{ENT}', 1)) AS et,
         list_distinct(regexp_extract_all(contexts, '{ENT}', 1)) AS ec FROM qctx
),
erec AS (
  SELECT qa_id, CASE WHEN len(et) = 0 THEN NULL ELSE round(len(list_intersect(et, ec)) / len(et), 6) END
         AS entity_recall FROM ents
),
asent AS (
  SELECT qa_id, question, row_number() OVER () AS sn, sentence FROM ({_sentences_sql('qctx', 'qa_id, question', 'answer')})
),
fq AS ({feature_sql("qa_id", "question", "qctx")}),
fs AS ({feature_sql("qa_id, sn", "sentence", "asent")}),
sdot AS (SELECT fs.qa_id, fs.sn, sum(fs.w * fq.w) AS d FROM fs JOIN fq ON fq.qa_id = fs.qa_id AND fq.pos = fs.pos GROUP BY fs.qa_id, fs.sn),
arel AS (
  SELECT asent.qa_id, round(avg(coalesce(d, 0.0)), 6) AS answer_relevancy
  FROM asent LEFT JOIN sdot ON sdot.qa_id = asent.qa_id AND sdot.sn = asent.sn GROUP BY asent.qa_id
),
metrics AS (
  SELECT qctx.qa_id, qctx.question, qctx.answer, qctx.contexts, faith.faithfulness, arel.answer_relevancy, crel.context_relevancy,
         erec.entity_recall AS context_entity_recall
  FROM qctx LEFT JOIN faith ON faith.qa_id = qctx.qa_id LEFT JOIN arel ON arel.qa_id = qctx.qa_id
  LEFT JOIN crel ON crel.qa_id = qctx.qa_id LEFT JOIN erec ON erec.qa_id = qctx.qa_id
)"""


def metric_table(spark, sf_dir):
    """The answers with their contexts and the four named metrics."""
    base = qa_contexts(spark, sf_dir)
    faith = G.faithfulness(base, "qa_id", "answer", "contexts", SUPPORTED_AT)
    arel = G.embedded_relevancy(base, "qa_id", "question", "answer")
    crel = G.context_relevancy(base, "qa_id", "question", "contexts")
    erec = G.entity_recall(base, "answer", "contexts").select("qa_id", F.col("entity_recall").alias("context_entity_recall"))
    out = base.select("qa_id", "question", "answer", "contexts")
    for m in (faith, arel, crel, erec):
        out = out.join(m, "qa_id", "left")
    return out


# --- G3 --------------------------------------------------------------------------
@register("split_contexts", sql=QA_SQL + """
SELECT qa_id, sent_pos, sentence FROM pieces""")
def q_split_contexts(spark, sf_dir):
    return G.split_contexts(qa_contexts(spark, sf_dir), "qa_id", "contexts")


def _best(spark, sf_dir):
    base = qa_contexts(spark, sf_dir)
    return G.best_context(G.split_contexts(base, "qa_id", "contexts"), base, "qa_id")


# --- G1 / G2 ------------------------------------------------------------------------
@register("char_jaccard", sql=QA_SQL + """
SELECT qa_id, sent_pos, sim FROM sims""")
def q_char_jaccard(spark, sf_dir):
    return _best(spark, sf_dir).select("qa_id", "sent_pos", "sim")


@register("best_context", sql=QA_SQL + """
SELECT qa_id, sent_pos AS best_pos, sim FROM sims WHERE is_best""")
def q_best_context(spark, sf_dir):
    return _best(spark, sf_dir).filter("is_best").select("qa_id", F.col("sent_pos").alias("best_pos"), "sim")


# --- G4 / G5 ------------------------------------------------------------------------
@register("highlight_chars", sql=QA_SQL + """
SELECT qa_id, sent_pos, char_pos, token, label FROM chars""")
def q_highlight_chars(spark, sf_dir):
    return G.highlight_chars(_best(spark, sf_dir), "qa_id")


@register("highlight_spans", sql=QA_SQL + """,
isl AS (
  SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY sent_pos, char_pos) AS n,
         row_number() OVER (PARTITION BY qa_id ORDER BY sent_pos, char_pos)
         - row_number() OVER (PARTITION BY qa_id, label ORDER BY sent_pos, char_pos) AS isl
  FROM chars
),
spans AS (
  SELECT qa_id, label, min(n) AS start, string_agg(token, '' ORDER BY n) AS text FROM isl GROUP BY qa_id, label, isl
)
SELECT qa_id, row_number() OVER (PARTITION BY qa_id ORDER BY start)::BIGINT AS span_no, text, label FROM spans""")
def q_highlight_spans(spark, sf_dir):
    return G.highlight_spans(qa_contexts(spark, sf_dir), "qa_id")


# --- G6 -------------------------------------------------------------------------------
@register("correctness", sql=QA_SQL + f"""
SELECT qa_id, round({_containment_sql('answer', 'contexts')}, 6) AS containment,
       CASE WHEN round({_containment_sql('answer', 'contexts')}, 6) >= {CORRECT_AT} THEN 'CORRECT' ELSE 'INCORRECT' END
         AS verdict
FROM qctx""")
def q_correctness(spark, sf_dir):
    return G.correctness(qa_contexts(spark, sf_dir), "answer", "contexts", CORRECT_AT).select(
        "qa_id", "containment", "verdict")


# --- G7 / G9 / G10 ------------------------------------------------------------------------
@register("faithfulness", sql=METRICS_SQL + """
SELECT qa_id, faithfulness FROM faith""")
def q_faithfulness(spark, sf_dir):
    return G.faithfulness(qa_contexts(spark, sf_dir), "qa_id", "answer", "contexts", SUPPORTED_AT)


@register("context_relevancy", sql=METRICS_SQL + """
SELECT qa_id, context_relevancy FROM crel""")
def q_context_relevancy(spark, sf_dir):
    return G.context_relevancy(qa_contexts(spark, sf_dir), "qa_id", "question", "contexts")


@register("entity_recall", sql=METRICS_SQL + """
SELECT qa_id, entity_recall FROM erec""")
def q_entity_recall(spark, sf_dir):
    return G.entity_recall(qa_contexts(spark, sf_dir), "answer", "contexts").select("qa_id", "entity_recall")


# --- G8 -------------------------------------------------------------------------------------
@register("answer_relevancy", sql="""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS qv, min(vec_id) AS qo
           FROM embeddings GROUP BY label)
SELECT e.label, round(avg(list_dot_product(e.embedding::DOUBLE[], q.qv::DOUBLE[])
       / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))
          * sqrt(list_dot_product(q.qv::DOUBLE[], q.qv::DOUBLE[])))), 6) AS answer_relevancy
FROM embeddings e JOIN q ON q.label = e.label WHERE e.vec_id <> q.qo GROUP BY e.label""")
def q_answer_relevancy(spark, sf_dir):
    return G.answer_relevancy(load_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


# --- G11 ------------------------------------------------------------------------------------
def _fmt(c: str) -> str:
    return f"coalesce(format('{{:.4f}}', round({c}, 4)), 'null')"


@register("metric_report", sql=METRICS_SQL + f"""
SELECT qa_id, concat_ws(chr(10), {", ".join(f"'{m}: ' || {_fmt(m)}" for m in sorted(METRICS))}) AS report
FROM metrics""")
def q_metric_report(spark, sf_dir):
    m = metric_table(spark, sf_dir)
    return m.select("qa_id", G.metric_report(m, METRICS).alias("report"))


# --- G12 ------------------------------------------------------------------------------------
@register("eval_result", sql=METRICS_SQL + """
SELECT qa_id, question, answer, md5(contexts) AS contexts_md5, faithfulness, answer_relevancy, context_relevancy,
       context_entity_recall FROM metrics""")
def q_eval_result(spark, sf_dir):
    """The result table itself: an answer a row, with its contexts and metrics."""
    return metric_table(spark, sf_dir).select("qa_id", "question", "answer", F.md5("contexts").alias("contexts_md5"), *METRICS)


@register("eval_report", sql=METRICS_SQL + """
SELECT count(*)::BIGINT AS n, round(avg(faithfulness), 6) AS avg_faithfulness, round(avg(answer_relevancy), 6) AS avg_answer_relevancy,
       round(avg(context_relevancy), 6) AS avg_context_relevancy, round(avg(context_entity_recall), 6) AS avg_context_entity_recall
FROM metrics""")
def q_eval_report(spark, sf_dir):
    """Per-answer result table written as one TSV report, read back and
    summarised."""
    m = metric_table(spark, sf_dir)
    path = shared_dir(spark, "eval-report")
    files.write_delimited(m, path, "\t")
    back = files.read_delimited(spark, path, "\t", "qa_id long, question string, answer string, contexts string, "
                                + ", ".join(f"{c} double" for c in METRICS))
    return back.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                    *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in METRICS])


# --- F8 / M12: the answer grid ------------------------------------------------------------------
# Two models' answers to a question: the reply that follows it, and the one after that.
GRID_MODELS = ["glm-4", "qwen-turbo"]
GRID_SQL = QA_SQL + f""",
turns AS (SELECT row_number() OVER (ORDER BY u.conv_id, u.turn)::BIGINT AS qa_id, u.conv_id, u.turn
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
given AS (
  SELECT qa_id, 'glm-4' AS model, answer FROM qa
  UNION ALL
  SELECT t.qa_id, 'qwen-turbo', a.text FROM turns t LEFT JOIN conversations a ON a.conv_id = t.conv_id AND a.turn = t.turn + 3 AND a.role = 'assistant'
),
srcs AS (SELECT qa_id, string_agg('<' || rank::VARCHAR || '>: ' || source, chr(10) || chr(10) ORDER BY rank) AS sources FROM rr GROUP BY qa_id),
full_qa AS (
  SELECT qctx.qa_id, qctx.question, qctx.contexts, coalesce(srcs.sources, '') AS sources
  FROM qctx LEFT JOIN srcs ON srcs.qa_id = qctx.qa_id WHERE qctx.qa_id > 0
),
cell AS (
  SELECT f.qa_id, f.question, g.model, g.answer,
         list_filter(regexp_split_to_array(f.contexts, '<\\d+>:'), lambda x: x <> '') AS p,
         list_filter(regexp_split_to_array(f.sources, '<\\d+>:'), lambda x: x <> '') AS sp
  FROM full_qa f JOIN given g ON g.qa_id = f.qa_id
),
cand AS (
  SELECT qa_id, model, answer, unnest(p) AS piece, unnest(sp) AS src, generate_subscripts(p, 1) AS i FROM cell WHERE answer IS NOT NULL
),
top1 AS (
  SELECT qa_id, model, piece, src FROM (
    SELECT *, row_number() OVER (PARTITION BY qa_id, model ORDER BY round({char_jaccard_sql('answer', 'piece')}, 6) DESC, i) AS k FROM cand)
  WHERE k = 1
),
grid AS (
  SELECT c.qa_id, c.model, c.question, c.answer, trim(replace(t.piece, chr(10), ' ')) AS reference, trim(replace(t.src, chr(10), ' ')) AS source,
         CASE WHEN t.piece IS NOT NULL
              THEN 'containment: ' || format('{{:.4f}}', round({_containment_sql('c.answer', 't.piece')}, 4)) END AS metric
  FROM cell c LEFT JOIN top1 t ON t.qa_id = c.qa_id AND t.model = c.model
)"""


def grid_answers(spark, sf_dir):
    """(qa_id, model, answer): a row for every answered question and model, null where a model gave none."""
    c = load_table(spark, sf_dir, "conversations")
    pairs = prompt.dialogue_pairs(c).filter(F.col("answer").isNotNull())
    qa = global_row_number(pairs, ["conv_id", "turn"], "qa_id")
    later = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("later"))
    both = qa.join(later, ["conv_id", "turn"], "left")
    return both.select("qa_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(a).alias("answer"))
                                                    for m, a in zip(GRID_MODELS, ("answer", "later"), strict=True)])).alias("g")
                       ).select("qa_id", "g.model", "g.answer")


def answer_grid(spark, sf_dir):
    q = qa_contexts(spark, sf_dir).filter("qa_id > 0").select("qa_id", "question", "contexts", "sources")
    return G.answer_grid(q, grid_answers(spark, sf_dir), "qa_id")


@register("answer_grid", sql=GRID_SQL + """
SELECT qa_id, model, question, answer, reference, source, metric FROM grid""")
def q_answer_grid(spark, sf_dir):
    return answer_grid(spark, sf_dir)


@register("answer_grid_wide", sql=GRID_SQL + """
SELECT qa_id, question, max(answer) FILTER (model = 'glm-4') AS answer_glm_4, max(source) FILTER (model = 'glm-4') AS source_glm_4,
       max(answer) FILTER (model = 'qwen-turbo') AS answer_qwen_turbo, max(source) FILTER (model = 'qwen-turbo') AS source_qwen_turbo
FROM grid GROUP BY qa_id, question""")
def q_answer_grid_wide(spark, sf_dir):
    """A row for a question, the models' answers side by side (a fixed list, so the pivot plans no extra pass)."""
    g = answer_grid(spark, sf_dir).withColumn("model", F.regexp_replace("model", "[^a-z0-9]", "_"))
    names = [m.replace("-", "_") for m in GRID_MODELS]
    wide = g.groupBy("qa_id", "question").pivot("model", names).agg(F.max("answer").alias("answer"), F.max("source").alias("source"))
    return wide.select("qa_id", "question", *[F.col(f"{m}_{c}").alias(f"{c}_{m}") for m in names for c in ("answer", "source")])


# --- F9 / M11: the envelope with elapsed time -------------------------------------------------------
# The log's click events ask, in order of time, the questions of the answered turns; the user's next
# purchase, signup or error event within an hour is the response.
REPLY_WITHIN = 3600
ENVELOPE_SQL = QA_SQL + f""",
srcs AS (SELECT qa_id, string_agg('<' || rank::VARCHAR || '>: ' || source, chr(10) || chr(10) ORDER BY rank) AS sources FROM rr GROUP BY qa_id),
req AS (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts, event_id)::BIGINT AS qa_id FROM events WHERE event_type = 'click'),
resp AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
pairing AS (
  SELECT req.qa_id, req.event_id AS request_id, req.ts AS asked, r.event_id AS response_id, r.ts AS answered, r.event_type,
         row_number() OVER (PARTITION BY req.event_id ORDER BY r.ts, r.event_id) AS k
  FROM req LEFT JOIN resp r ON r.user_id = req.user_id AND r.ts >= req.ts AND r.ts <= req.ts + INTERVAL {REPLY_WITHIN} SECOND
)
SELECT p.qa_id, p.request_id, p.response_id, q.question,
       CASE WHEN p.response_id IS NULL OR p.event_type = 'error' OR q.answer IS NULL THEN NULL ELSE q.answer END AS answer,
       CASE WHEN p.response_id IS NULL OR p.event_type = 'error' OR q.answer IS NULL THEN 'fail' ELSE 'success' END AS status,
       CASE WHEN p.response_id IS NULL THEN 'no response' WHEN p.event_type = 'error' THEN 'error response'
            WHEN q.answer IS NULL THEN 'no answer' ELSE '' END AS error,
       (epoch_us(p.answered) - epoch_us(p.asked)) // 1000 AS elapsed_ms,
       coalesce(q.contexts, '') AS contexts, coalesce(srcs.sources, '') AS sources
FROM pairing p LEFT JOIN qctx q ON q.qa_id = p.qa_id LEFT JOIN srcs ON srcs.qa_id = p.qa_id
WHERE p.k = 1"""


@register("timed_envelope", sql=ENVELOPE_SQL)
def q_timed_envelope(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    asked = global_row_number(e.filter("event_type = 'click'"), ["ts", "event_id"], "qa_id")
    replies = e.filter("event_type in ('purchase', 'signup', 'error')")
    paired = prompt.next_event(asked.select("qa_id", "event_id", "user_id", "ts"), replies, "user_id", "ts", "event_id", REPLY_WITHIN)
    qa = qa_contexts(spark, sf_dir).select("qa_id", "question", "answer", "contexts", "sources")
    return prompt.timed_envelope(paired.join(qa, "qa_id", "left"))
