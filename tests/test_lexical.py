import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from conftest import SF01
from quarry.functions.fixed import STOP_WORDS
from quarry.operators import chunk, lexical
from quarry.session import load_table


def py_terms(s):
    return [t for t in re.findall(r"[^\W_]+", s.lower()) if t not in STOP_WORDS]


def py_bm25(questions, docs, k1=1.2, b=0.75):
    toks = {d: py_terms(t) for d, t in docs.items()}
    toks = {d: t for d, t in toks.items()}
    n = sum(1 for t in toks.values() if t)
    avgdl = sum(len(t) for t in toks.values() if t) / n
    df = Counter(term for t in toks.values() for term in set(t))
    out = {}
    for q, text in questions.items():
        qtf = Counter(py_terms(text))
        scores = {}
        for d, t in toks.items():
            tf = Counter(t)
            s = 0.0
            for term, c in qtf.items():
                if tf[term]:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    s += c * idf * tf[term] / (tf[term] + k1 * (1 - b + b * len(t) / avgdl))
            if s > 0 or any(tf[x] for x in qtf):
                scores[d] = round(s, 6)
        out[q] = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    return out


def test_bm25_matches_brute_force(spark):
    docs = {1: "the cat sat on the mat", 2: "a dog sat", 3: "cat cat dog", 4: "birds fly", 5: ""}
    qs = {10: "cat on mat", 11: "dog", 12: "nothing here"}
    dd = spark.createDataFrame([(k, 1, v) for k, v in docs.items()], "doc_id long, cont_id long, content string")
    qd = spark.createDataFrame(list(qs.items()), "item_id long, text string")
    got = lexical.bm25_topk(qd, dd, k=3, carry=()).collect()
    want = py_bm25(qs, docs)
    for q in qs:
        g = sorted([(r.doc_id, r.score) for r in got if r.item_id == q], key=lambda kv: (-kv[1], kv[0]))
        assert g == want[q]


def test_benchmark_passages_are_found(spark):
    """Retrieval truth on the fixture: a benchmark passage copied verbatim
    into a document puts that document in the question's top 10."""
    con = duckdb.connect()
    truth = con.execute(f"""SELECT b.item_id, d.doc_id FROM '{SF01}/benchmark.parquet' b
        JOIN '{SF01}/documents.parquet' d ON contains(d.text, b.text) WHERE b.item_id < 20""").fetchall()
    items = {i for i, _ in truth}
    assert len(items) >= 5
    chunks = chunk.chunk_windows(load_table(spark, SF01, "documents"))
    q = load_table(spark, SF01, "benchmark")
    hits = lexical.bm25_topk(q, chunks, k=10, carry=()).select("item_id", "doc_id").collect()
    found = {(r.item_id, r.doc_id) for r in hits}
    for i in items:
        assert any((i, d) in found for j, d in truth if j == i), i


def test_same_rows_without_broadcasts(spark):
    """A term in every chunk, joined by term alone: the plan a large question table gets."""
    chunks = spark.createDataFrame([(i, 1, "s", f"hot word{i % 7} word{i % 11} hot") for i in range(300)],
                                   "doc_id long, cont_id long, source string, content string")
    questions = spark.createDataFrame([(1, "hot word3"), (2, "hot"), (3, "word5 word10")], "item_id long, text string")

    def top():
        rows = lexical.bm25_topk(questions, chunks, k=5).collect()
        return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in rows)
    small = top()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert top() == small and len(small) == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
