"""DuckDB SQL fragments shared by the oracle queries (the same
computations the Spark operators express with the DataFrame API)."""

from __future__ import annotations

from quarry.functions.fixed import CHUNK_SIZE, EMBED_DIM
from quarry.functions.text import terms_sql, text_hash_sql


def lit(s: str) -> str:
    """SQL string literal; newlines and CRs spelled with chr() so the
    statement text stays on one logical line per value."""
    if s is None:
        return "NULL"
    parts = []
    buf = ""
    for ch in s:
        if ch in "\n\r\t":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def values(rows, cols, types) -> str:
    """``(VALUES ...) AS v(cols)`` with explicit casts."""
    def one(v, t):
        if v is None:
            return f"NULL::{t}"
        if t == "VARCHAR":
            return f"{lit(v)}::VARCHAR"
        return f"{v}::{t}"
    body = ", ".join("(" + ", ".join(one(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


def chunks_cte(size: int = CHUNK_SIZE, docs: str = "documents") -> str:
    """Fixed character windows of ``docs(doc_id, source, text)``."""
    return f"""chunks AS (
  SELECT doc_id, source, (s // {size} + 1)::BIGINT AS cont_id, substring(text, s + 1, {size}) AS content
  FROM (SELECT doc_id, source, text, unnest(range(0, greatest(length(text), 1), {size})) AS s FROM {docs})
  WHERE length(substring(text, s + 1, {size})) > 0
)"""


def feature_sql(keys: str, text: str, table: str, dim: int = EMBED_DIM) -> str:
    """The non-zero elements (pos, w) of each row's embedding, by ``keys``."""
    return f"""SELECT {keys}, pos, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS w
FROM (SELECT {keys}, {text_hash_sql('term')} % {dim} AS pos, count(*)::DOUBLE AS n
      FROM (SELECT {keys}, unnest({terms_sql(text)}) AS term FROM {table}) GROUP BY ALL)"""


def bm25_ctes(k: int, questions: str = "benchmark", qid: str = "item_id", qtext: str = "text",
              k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs ``post, stats, qt, dfs, qs, sc, lex`` over a ``chunks`` CTE;
    ``lex`` has (qid, doc_id, cont_id, score, rank, source, content)."""
    return f"""ct AS (SELECT doc_id, cont_id, {terms_sql('content')} AS t FROM chunks),
post AS (
  SELECT doc_id, cont_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, cont_id, len(t)::BIGINT AS dl, unnest(t) AS term FROM ct)
  GROUP BY doc_id, cont_id, dl, term
),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM ct WHERE len(t) > 0),
qt AS (
  SELECT {qid}, term, count(*) AS qtf
  FROM (SELECT {qid}, unnest({terms_sql(qtext)}) AS term FROM {questions})
  GROUP BY {qid}, term
),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
qs AS (
  SELECT qt.{qid}, qt.term, qt.qtf, ln(1.0 + (stats.n - dfs.df + 0.5) / (dfs.df + 0.5)) AS idf
  FROM qt JOIN dfs ON qt.term = dfs.term CROSS JOIN stats
),
sc AS (
  SELECT qs.{qid}, post.doc_id, post.cont_id,
         round(sum(qs.qtf * qs.idf * post.tf / (post.tf + {k1} * (1.0 - {b} + {b} * post.dl / stats.avgdl))), 6) AS score
  FROM post JOIN qs ON post.term = qs.term CROSS JOIN stats
  GROUP BY qs.{qid}, post.doc_id, post.cont_id
),
lex AS (
  SELECT r.{qid}, r.doc_id, r.cont_id, r.score, r.rank, c.source, c.content
  FROM (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, doc_id, cont_id)::BIGINT AS rank
        FROM sc) r
  JOIN chunks c ON c.doc_id = r.doc_id AND c.cont_id = r.cont_id
  WHERE r.rank <= {k}
)"""


def rerank_ctes(keep: int, contexts: str, questions: str = "benchmark", qid: str = "item_id",
                qtext: str = "text") -> str:
    """``rr`` = top ``keep`` of ``contexts(qid, content, source, pos)`` by
    the share of distinct question terms found in the content."""
    qterms = f"list_distinct({terms_sql('q.' + qtext)})"
    cterms = terms_sql("x.content")
    score = (f"(CASE WHEN len({qterms}) = 0 THEN 0.0 ELSE "
             f"len(list_intersect({qterms}, {cterms}))::DOUBLE / len({qterms}) END)")
    return f"""scored AS (
  SELECT x.*, round({score}, 6) AS rerank_score
  FROM {contexts} x JOIN {questions} q ON q.{qid} = x.{qid}
),
rr AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY rerank_score DESC, pos)::BIGINT AS rank
    FROM scored) WHERE rank <= {keep}
)"""


def lexical_context_ctes(questions: str, qid: str, qtext: str, k: int = 10, keep: int = 3) -> str:
    """CTE chain (after ``chunks``): BM25 top-k for ``questions``, merged
    like the hybrid context (lexical leg only) as ``ctx``, reranked as
    ``rr``, and the ``<i>: ...`` context string per question as ``qctx``."""
    return f"""{bm25_ctes(k, questions, qid, qtext)},
merged AS (
  SELECT {qid}, content, source, min(rank) AS leg_rank FROM lex GROUP BY {qid}, content, source
),
ctx AS (
  SELECT {qid}, content, source, 1::BIGINT AS leg, leg_rank,
         row_number() OVER (PARTITION BY {qid} ORDER BY leg_rank)::BIGINT AS pos
  FROM merged
),
{rerank_ctes(keep, 'ctx', questions, qid, qtext)},
qctx0 AS (
  SELECT {qid}, string_agg('<' || rank::VARCHAR || '>: ' || content, chr(10) || chr(10) ORDER BY rank) AS contexts
  FROM rr GROUP BY {qid}
)"""
