"""Registered queries: chunking, analysis, lexical retrieval, merging,
reranking and prompt assembly (C2-C9, E4-E11, F1-F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fixed import (EXTRA_STOP_WORDS, LEXICAL_TOPK, LEXICAL_TOPK_EVAL, PREPOSITIONS, RERANK_KEEP, STOP_WORDS,
                                    SUFFIXES, SURNAMES, USER_WORDS)
from quarry.functions.text import terms_sql
from quarry.operators import analyze, chunk, lexical, prompt, retrieve
from quarry.plans.corpus import chunk_table, lexical_store
from quarry.plans.registry import register
from quarry.plans.sqlparts import bm25_ctes, chunks_cte, rerank_ctes, values
from quarry.session import load_table, shared_dir

# Hand-made rows (FIXTURES §3) appended to the driver's documents where the
# driver data lacks a case: Han text without spaces, mixed scripts.
CJK_ROWS = [
    (-1, "五一去厦门有什么好玩的地方值得推荐", "zh", "hand0"),
    (-2, "Mixed 中文abc 和 English文字 text", "zh", "hand1"),
    (-3, "单", "zh", "hand2"),
]
CJK_COLS = ["doc_id", "text", "lang", "source"]
CJK_TYPES = ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR"]


def docs_with_cjk(spark, sf_dir):
    extra = spark.createDataFrame(CJK_ROWS, "doc_id long, text string, lang string, source string")
    return load_table(spark, sf_dir, "documents").select(*CJK_COLS).unionByName(extra)


DOCS_WITH_CJK_SQL = (f"(SELECT doc_id, text, lang, source FROM documents UNION ALL "
                     f"{values(CJK_ROWS, CJK_COLS, CJK_TYPES)})")


def windows(spark, sf_dir):
    return chunk.chunk_windows(load_table(spark, sf_dir, "documents"))


# --- C3 / C5 ---------------------------------------------------------------
@register("chunk_windows", sql=f"""WITH {chunks_cte(docs=DOCS_WITH_CJK_SQL)}
SELECT doc_id, source, cont_id, content FROM chunks""")
def q_chunk_windows(spark, sf_dir):
    return chunk.chunk_windows(docs_with_cjk(spark, sf_dir))


# --- C2 / B5 ---------------------------------------------------------------
@register("chunk_lines", sql="""SELECT doc_id, source, line_no, replace(line, chr(10), '') AS content
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no
      FROM documents)
WHERE length(line) > 0""")
def q_chunk_lines(spark, sf_dir):
    return chunk.chunk_lines(load_table(spark, sf_dir, "documents"))


# --- C6 --------------------------------------------------------------------
@register("tokenize", sql=f"""SELECT term, count(*)::BIGINT AS n
FROM (SELECT unnest({terms_sql('text', False)}) AS term FROM {DOCS_WITH_CJK_SQL})
GROUP BY term""")
def q_tokenize(spark, sf_dir):
    return analyze.term_counts(docs_with_cjk(spark, sf_dir), "text")


# --- C7 --------------------------------------------------------------------
_STOP_SQL = values([(w,) for w in STOP_WORDS], ["term"], ["VARCHAR"])


@register("stopword_filter", sql=f"""SELECT term, count(*)::BIGINT AS n
FROM (SELECT unnest({terms_sql('text', False)}) AS term FROM documents)
WHERE term NOT IN (SELECT term FROM {_STOP_SQL})
GROUP BY term""")
def q_stopword_filter(spark, sf_dir):
    counts = analyze.term_counts(load_table(spark, sf_dir, "documents"), "text")
    return analyze.drop_stop_words(counts, analyze.stop_word_table(spark))


# --- C8 / C9 ---------------------------------------------------------------
# A user dictionary is a bounded word list; these entries stand in for one
# (the shipped dictionary files are empty) and occur in the fixture prose.
DICTIONARY = ["tion", "ment", "heit", "ción", "the", "und", "des"]


@register("dictionary_terms", sql=f"""SELECT d.doc_id, w.word
FROM documents d JOIN {values([(w,) for w in DICTIONARY], ['word'], ['VARCHAR'])} w
  ON contains(d.text, w.word)""")
def q_dictionary_terms(spark, sf_dir):
    return analyze.dictionary_hits(load_table(spark, sf_dir, "documents"), "text", DICTIONARY, ["doc_id"])


# --- E6 --------------------------------------------------------------------
@register("term_stats", sql=f"""WITH {chunks_cte()},
per_chunk AS (
  SELECT doc_id, cont_id, term, count(*) AS tf
  FROM (SELECT doc_id, cont_id, unnest({terms_sql('content')}) AS term FROM chunks)
  GROUP BY doc_id, cont_id, term
)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM per_chunk GROUP BY term""")
def q_term_stats(spark, sf_dir):
    return lexical_store(spark, sf_dir).term_stats()


# --- E4 / E5 ---------------------------------------------------------------
def lexical_hits(spark, sf_dir, k=LEXICAL_TOPK, carry=("source", "content")):
    """BM25 hits of the benchmark questions, from the stored postings and chunks."""
    return lexical.bm25_topk(load_table(spark, sf_dir, "benchmark"), chunk_table(spark, sf_dir), k=k, carry=carry,
                             store=lexical_store(spark, sf_dir))


@register("bm25_topk", sql=f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK)}
SELECT item_id, doc_id, cont_id, score, rank FROM lex""")
def q_bm25_topk(spark, sf_dir):
    return lexical_hits(spark, sf_dir, carry=())


@register("bm25_top30", sql=f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK_EVAL)}
SELECT item_id, doc_id, cont_id, score, rank, content FROM lex""")
def q_bm25_top30(spark, sf_dir):
    return lexical_hits(spark, sf_dir, LEXICAL_TOPK_EVAL, ("content",))


# --- E7 --------------------------------------------------------------------
@register("lexical_distinct_top5", sql=f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK_EVAL)},
firsts AS (SELECT item_id, content, min(rank) AS first_rank FROM lex GROUP BY item_id, content)
SELECT item_id, content, first_rank, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first_rank, content)::BIGINT AS pos FROM firsts)
WHERE pos <= 5""")
def q_lexical_distinct_top5(spark, sf_dir):
    return lexical.distinct_first(lexical_hits(spark, sf_dir, LEXICAL_TOPK_EVAL, ("content",)), keep=5)


# --- A14 / A16: a store that grows ------------------------------------------
def _grown(spark, sf_dir):
    """A store of all chunks from two appends, the second delivered twice."""
    chunks = chunk_table(spark, sf_dir)
    store = lexical.LexicalStore.create(spark, shared_dir(spark, "grown-store"), chunks)
    store.append(chunks.filter("doc_id % 2 = 0"), batch="even")
    store.append(chunks.filter("doc_id % 2 <> 0"), batch="odd")
    store.append(chunks.filter("doc_id % 2 <> 0"), batch="odd")
    return store


@register("store_append_topk", sql=f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK)}
SELECT item_id, doc_id, cont_id, score, rank FROM lex""")
def q_store_append_topk(spark, sf_dir):
    return _grown(spark, sf_dir).search(load_table(spark, sf_dir, "benchmark"))


@register("store_compact_topk", sql=f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK)}
SELECT item_id, doc_id, cont_id, score, rank FROM lex""")
def q_store_compact_topk(spark, sf_dir):
    store = _grown(spark, sf_dir)
    store.compact()
    return store.search(load_table(spark, sf_dir, "benchmark"))


@register("store_term_stats", sql=f"""WITH {chunks_cte()},
per_chunk AS (
  SELECT doc_id, cont_id, term, count(*) AS tf
  FROM (SELECT doc_id, cont_id, unnest({terms_sql('content')}) AS term FROM chunks)
  GROUP BY doc_id, cont_id, term
)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM per_chunk GROUP BY term""")
def q_store_term_stats(spark, sf_dir):
    return _grown(spark, sf_dir).term_stats()


# --- E9 --------------------------------------------------------------------
@register("exact_dedup", sql="""SELECT text, source, min(doc_id) AS doc_id
FROM documents GROUP BY text, source""")
def q_exact_dedup(spark, sf_dir):
    return retrieve.exact_dedup(load_table(spark, sf_dir, "documents"), ["text", "source"], "doc_id")


# --- E8 (lexical leg) + E10 + F1/F2: the flagship slice ---------------------
def lexical_contexts(spark, sf_dir, k=LEXICAL_TOPK):
    """Lexical leg merged and deduplicated like the hybrid context (no
    vector hits): (item_id, content, source, leg, leg_rank, pos)."""
    lex = lexical_hits(spark, sf_dir, k)
    empty = lex.select("item_id", "content", "source", "rank").limit(0)
    return retrieve.hybrid_context(empty, lex)


LEX_CONTEXT_SQL = f"""WITH {chunks_cte()},
{bm25_ctes(LEXICAL_TOPK)},
merged AS (
  SELECT item_id, content, source, min(rank) AS leg_rank FROM lex GROUP BY item_id, content, source
),
ctx AS (
  SELECT item_id, content, source, 1::BIGINT AS leg, leg_rank,
         row_number() OVER (PARTITION BY item_id ORDER BY leg_rank)::BIGINT AS pos
  FROM merged
)"""


@register("hybrid_context_lexical", sql=LEX_CONTEXT_SQL + """
SELECT item_id, content, source, leg, leg_rank, pos FROM ctx""")
def q_hybrid_context_lexical(spark, sf_dir):
    return lexical_contexts(spark, sf_dir)


@register("rerank_topn", sql=LEX_CONTEXT_SQL + f""",
{rerank_ctes(RERANK_KEEP, 'ctx')}
SELECT item_id, content, source, pos, rerank_score, rank FROM rr""")
def q_rerank_topn(spark, sf_dir):
    ctx = lexical_contexts(spark, sf_dir)
    rr = retrieve.rerank(load_table(spark, sf_dir, "benchmark"), ctx, keep=RERANK_KEEP)
    return rr.select("item_id", "content", "source", "pos", "rerank_score", "rank")


def flagship(spark, sf_dir):
    """benchmark questions → windows → BM25 top-10 → dedup → rerank top-3
    → numbered prompt, one row per question."""
    questions = load_table(spark, sf_dir, "benchmark")
    ctx = lexical_contexts(spark, sf_dir)
    rr = retrieve.rerank(questions, ctx, keep=RERANK_KEEP)
    return prompt.build_prompt(rr, questions).select(
        "item_id", "prompt", "contexts", "sources", "n_contexts")


PROMPT_CTES = LEX_CONTEXT_SQL + f""",
{rerank_ctes(RERANK_KEEP, 'ctx')},
agg AS (
  SELECT item_id,
         string_agg(rank::VARCHAR || ': ' || content || chr(10), '' ORDER BY rank) AS body,
         string_agg('<' || rank::VARCHAR || '>: ' || content, chr(10) || chr(10) ORDER BY rank) AS contexts,
         string_agg('<' || rank::VARCHAR || '>: ' || source, chr(10) || chr(10) ORDER BY rank) AS sources,
         count(*)::BIGINT AS n_contexts
  FROM rr GROUP BY item_id
),
prompts AS (
SELECT b.item_id, coalesce(a.body, '') AS contexts_body,
       '<文本片段>:' || chr(10) || chr(10) || coalesce(a.body, '') || chr(10) || '<问题>: ' || b.text
         || chr(10) || '<回答>: ' AS prompt,
       coalesce(a.contexts, '') AS contexts, coalesce(a.sources, '') AS sources,
       coalesce(a.n_contexts, 0)::BIGINT AS n_contexts
FROM benchmark b LEFT JOIN agg a ON a.item_id = b.item_id
)"""
PROMPT_SQL = PROMPT_CTES + """
SELECT item_id, prompt, contexts, sources, n_contexts FROM prompts"""


@register("build_prompt", sql=PROMPT_SQL)
def q_build_prompt(spark, sf_dir):
    return flagship(spark, sf_dir)


@register("passthrough_rerank", sql=LEX_CONTEXT_SQL + """
SELECT item_id, content, source, pos, pos AS rank FROM ctx""")
def q_passthrough_rerank(spark, sf_dir):
    return retrieve.passthrough_rerank(lexical_contexts(spark, sf_dir)).select(
        "item_id", "content", "source", "pos", "rank")


# --- C9 ---------------------------------------------------------------------
WORD_LISTS = {"stopword": STOP_WORDS, "main": DICTIONARY}


@register("word_list_hits", sql=f"""WITH lists AS (
  SELECT 'stopword' AS category, term FROM {_STOP_SQL}
  UNION ALL SELECT 'main', word FROM {values([(w,) for w in DICTIONARY], ['word'], ['VARCHAR'])}
),
t AS (SELECT unnest({terms_sql('text', False)}) AS term FROM documents)
SELECT l.category, l.term, count(*)::BIGINT AS n FROM t JOIN lists l ON l.term = t.term
GROUP BY l.category, l.term""")
def q_word_list_hits(spark, sf_dir):
    """Word lists written as .dic files, read back with their category and
    unioned (C9), then matched against the corpus terms."""
    path = shared_dir(spark, "word-lists")
    analyze.write_word_lists(spark, path, WORD_LISTS)
    lists = analyze.read_word_lists(spark, path)
    counts = analyze.term_counts(load_table(spark, sf_dir, "documents"), "text")
    # the lists are fixed and small: broadcast by construction
    return counts.join(F.broadcast(lists), "term").select("category", "term", "n")


# Categories as shipped; the fixture's prose is Latin, so a list of its syllables, with
# words inside words, and hand-made Han rows meet the matcher too.
CATEGORIES = {"stopword": STOP_WORDS, "extra_stopword": EXTRA_STOP_WORDS, "preposition": PREPOSITIONS, "suffix": SUFFIXES,
              "surname": SURNAMES, "user": USER_WORDS, "syllable": ["th", "the", "ther", "tion", "on", "ment", "men", "eau", "eaux", "ción"]}
HAN_ROWS = [(-11, "欧阳修从长江路到北海市的芯片厂", "zh", "hand3"), (-12, "司马光不是司徒，也不是公孙。", "zh", "hand4"), (-13, "", "zh", "hand5")]
_CATEGORY_SQL = values([(c, w) for c, ws in CATEGORIES.items() for w in dict.fromkeys(ws)], ["category", "term"], ["VARCHAR", "VARCHAR"])
_LONGEST_FIRST = "|".join(sorted({w for ws in CATEGORIES.values() for w in ws}, key=lambda w: (-len(w), w)))


@register("dictionary_matches", sql=f"""WITH docs AS (SELECT doc_id, text FROM documents UNION ALL
  SELECT doc_id, text FROM {values(HAN_ROWS, CJK_COLS, CJK_TYPES)}),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_LONGEST_FIRST}')) AS word FROM docs)
SELECT m.doc_id, l.category, m.word, count(*)::BIGINT AS n FROM m JOIN {_CATEGORY_SQL} l ON l.term = m.word
GROUP BY m.doc_id, l.category, m.word""")
def q_dictionary_matches(spark, sf_dir):
    """All categories written as word-list files, read back, and matched once a text."""
    path = shared_dir(spark, "word-lists")
    analyze.write_word_lists(spark, path, CATEGORIES)
    extra = spark.createDataFrame(HAN_ROWS, "doc_id long, text string, lang string, source string")
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    return analyze.dictionary_matches(docs, "text", analyze.read_word_lists(spark, path), ["doc_id"])
