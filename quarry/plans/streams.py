"""Registered queries: streaming jobs (J1-J4), the recursive splitter
(C1, C4) and the corpus encoder stand-in (D1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fixed import CHUNK_SIZE, CHUNKS_PER_DOC
from quarry.functions.text import normalize_newlines_sql
from quarry.operators import chunk
from quarry.operators import vectors as V
from quarry.plans.registry import register
from quarry.plans.sqlparts import chunks_cte, feature_sql
from quarry.session import load_table, shared_dir
from quarry.streaming import ingest as J

NORMALIZED_DOCS_SQL = f"(SELECT doc_id, source, {normalize_newlines_sql('text')} AS text FROM documents)"


# --- J1 ---------------------------------------------------------------------------
@register("stream_ingest", sql=f"""WITH {chunks_cte(docs=NORMALIZED_DOCS_SQL)}
SELECT doc_id, source, cont_id, content FROM chunks""")
def q_stream_ingest(spark, sf_dir):
    return J.stream_ingest(spark, sf_dir).select("doc_id", "source", "cont_id", "content")


# --- J2 ---------------------------------------------------------------------------
@register("stream_dedup", sql="""SELECT DISTINCT source, md5(text) AS text_md5 FROM documents""")
def q_stream_dedup(spark, sf_dir):
    return J.stream_dedup(spark, sf_dir).select("source", "text_md5")


# --- J1 / J2 over two runs -----------------------------------------------------------
@register("stream_two_runs", sql="""SELECT source, md5(text) AS text_md5, CASE WHEN bool_or(doc_id % 2 = 0) THEN 0 ELSE 1 END::BIGINT AS run
FROM documents GROUP BY source, md5(text)""")
def q_stream_two_runs(spark, sf_dir):
    """A folder that grows between two runs with one checkpoint; the second delivery
    repeats all of the first."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    folder, sink, checkpoint = (shared_dir(spark, f"two-runs-{x}") for x in ("in", "out", "ckpt"))
    docs.filter("doc_id % 2 = 0").write.parquet(f"{folder}/first")
    J.ingest_run(spark, folder, sink, checkpoint, docs.schema)
    docs.write.parquet(f"{folder}/second")
    out = J.ingest_run(spark, folder, sink, checkpoint, docs.schema)
    return out.select("source", "text_md5", F.col("batch").cast("long").alias("run"))


# --- J3 ---------------------------------------------------------------------------
@register("stream_two_sinks", sql=f"""WITH {chunks_cte()},
f AS ({feature_sql("doc_id, cont_id", "content", "chunks")}),
v AS (SELECT doc_id, cont_id, round(sum(w), 6) AS weight FROM f GROUP BY ALL)
SELECT 'docs' AS store, doc_id * {CHUNKS_PER_DOC} + cont_id AS pk, source, content, NULL::DOUBLE AS weight FROM chunks
UNION ALL
SELECT 'vectors', doc_id * {CHUNKS_PER_DOC} + cont_id, source, content, coalesce(weight, 0)
FROM chunks LEFT JOIN v USING (doc_id, cont_id)""")
def q_stream_two_sinks(spark, sf_dir):
    lex, vec = J.stream_two_sinks(spark, sf_dir)
    weight = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return (lex.select(F.lit("docs").alias("store"), V.chunk_key().alias("pk"), "source", "content",
                       F.lit(None).cast("double").alias("weight"))
            .unionByName(vec.select(F.lit("vectors").alias("store"), "pk", "source", F.col("text").alias("content"),
                                    weight.alias("weight"))))


# --- J4 ---------------------------------------------------------------------------
@register("stream_daily_counts", sql="""SELECT ts::DATE AS day, event_type, count(*)::BIGINT AS n
FROM events GROUP BY 1, 2""")
def q_stream_daily_counts(spark, sf_dir):
    return J.stream_daily_counts(spark, sf_dir)


# --- C1 / C4 (no SQL twin: sequential packing; checked by property tests) ----------
@register("chunk_recursive", note="recursive character splitter, 250/0")
def q_chunk_recursive(spark, sf_dir):
    return chunk.chunk_recursive(load_table(spark, sf_dir, "documents"), size=CHUNK_SIZE)


@register("chunk_presplit", note="pages pre-split at 1000 characters, then split at 250")
def q_chunk_presplit(spark, sf_dir):
    pages = chunk.chunk_recursive(load_table(spark, sf_dir, "documents"), size=1000)
    pages = pages.select("doc_id", "source", F.col("cont_id").alias("page"), F.col("content").alias("text"))
    return chunk.chunk_recursive(pages, size=CHUNK_SIZE, keep=("doc_id", "source", "page"))


# --- D1: every chunk's vector, as its non-zero elements ------------------------------
@register("embed_corpus", sql=f"""WITH {chunks_cte()}
SELECT doc_id, cont_id, pos, round(w, 6) AS value FROM ({feature_sql("doc_id, cont_id", "content", "chunks")})""")
def q_embed_corpus(spark, sf_dir):
    e = V.embed(chunk.chunk_windows(load_table(spark, sf_dir, "documents")), "content")
    return (V.unpivot(e, ["doc_id", "cont_id"], "embedding").filter("value != 0")
            .withColumn("value", F.round("value", 6)))
