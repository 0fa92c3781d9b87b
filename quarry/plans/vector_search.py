"""Registered queries: vector normalisation, pooling, exact and
cell-pruned inner-product search (D2-D5, E1-E3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fixed import VECTOR_TOPK
from quarry.functions.vectors import l2_normalize, l2_normalize_sql
from quarry.operators import vectors as V
from quarry.plans.corpus import label_cells as label_store
from quarry.plans.registry import register
from quarry.session import load_table, shared_dir

# The fixture's unit vectors rarely pass the application's 0.5 cut (one
# pair at sf0.01); 0.3 keeps the threshold step meaningful on it.
FIXTURE_THRESHOLD = 0.3
NPROBE_FIXTURE = 3  # of the 10 label cells


def emb(spark, sf_dir):
    return load_table(spark, sf_dir, "embeddings")


def self_queries(spark, sf_dir):
    e = emb(spark, sf_dir)
    return (e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")),
            e.select("vec_id", F.col("embedding").alias("ivec")))


UNNEST_SQL = """SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos,
       unnest(embedding)::DOUBLE AS x FROM embeddings"""


# --- D4 --------------------------------------------------------------------
@register("l2_normalize", sql=f"""SELECT vec_id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos,
       round(unnest(v), 6) AS value
FROM (SELECT vec_id, {l2_normalize_sql('embedding')} AS v FROM embeddings)""")
def q_l2_normalize(spark, sf_dir):
    n = emb(spark, sf_dir).select("vec_id", l2_normalize("embedding").alias("v"))
    return V.unpivot(n, ["vec_id"], "v").withColumn("value", F.round("value", 6))


# --- D2 --------------------------------------------------------------------
@register("first_pool", sql=f"""WITH f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label)
SELECT f.label, f.vec_id, u.pos, round(u.x, 6) AS value
FROM f JOIN ({UNNEST_SQL}) u ON u.vec_id = f.vec_id""")
def q_first_pool(spark, sf_dir):
    p = V.first_pool(emb(spark, sf_dir), "label", "vec_id", "embedding")
    return (V.unpivot(p, ["label", "vec_id"], "embedding")
            .withColumn("value", F.round(F.col("value").cast("double"), 6)))


# --- D3 --------------------------------------------------------------------
@register("mean_pool", sql=f"""SELECT label, pos, round(avg(x), 6) AS value
FROM ({UNNEST_SQL}) GROUP BY label, pos""")
def q_mean_pool(spark, sf_dir):
    p = V.mean_pool(emb(spark, sf_dir), "label", "embedding")
    return V.unpivot(p, ["label"], "embedding").withColumn("value", F.round("value", 6))


# --- E1 / E2 ---------------------------------------------------------------
EXACT_SQL = """SELECT q.vec_id AS qid, i.vec_id,
       round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id"""


@register("vector_topk", sql=f"""SELECT qid, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::BIGINT AS rank
  FROM ({EXACT_SQL})) WHERE rank <= {VECTOR_TOPK}""")
def q_vector_topk(spark, sf_dir):
    q, it = self_queries(spark, sf_dir)
    return V.dense_topk(q, it, VECTOR_TOPK, qid="qid", iid="vec_id", qvec="qvec", ivec="ivec",
                        exclude_self=True)


@register("vector_threshold", sql=f"""SELECT qid, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::BIGINT AS rank
  FROM ({EXACT_SQL})) WHERE rank <= {VECTOR_TOPK} AND score > {FIXTURE_THRESHOLD}""")
def q_vector_threshold(spark, sf_dir):
    return V.threshold(q_vector_topk(spark, sf_dir), FIXTURE_THRESHOLD)


# --- D5 (label-mean cells) ----------------------------------------------------
CENTROID_SQL = f"""cent AS (
  SELECT label::BIGINT AS cell, list(x ORDER BY pos) AS centroid
  FROM (SELECT label, pos, avg(x) AS x FROM ({UNNEST_SQL}) GROUP BY label, pos) GROUP BY label
),
assign AS (
  SELECT vec_id, cell, score FROM (
    SELECT e.vec_id, c.cell, round(list_dot_product(e.embedding::DOUBLE[], c.centroid), 6) AS score,
           row_number() OVER (PARTITION BY e.vec_id
                              ORDER BY round(list_dot_product(e.embedding::DOUBLE[], c.centroid), 6) DESC, c.cell) AS rn
    FROM embeddings e CROSS JOIN cent c) WHERE rn = 1
)"""


def label_cells(spark, sf_dir):
    e = emb(spark, sf_dir)
    cents = V.label_centroids(e, "label", "embedding")
    return e, cents


@register("ivf_assign", sql=f"""WITH {CENTROID_SQL}
SELECT vec_id, cell, score FROM assign""")
def q_ivf_assign(spark, sf_dir):
    e, cents = label_cells(spark, sf_dir)
    return V.assign_cells(e, cents, "vec_id", "embedding")


# --- E3 --------------------------------------------------------------------
PROBE_SQL = f"""WITH {CENTROID_SQL},
probes AS (
  SELECT qid, cell FROM (
    SELECT q.vec_id AS qid, c.cell,
           row_number() OVER (PARTITION BY q.vec_id
                              ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.centroid), 6) DESC, c.cell) AS pr
    FROM embeddings q CROSS JOIN cent c) WHERE pr <= {NPROBE_FIXTURE}
),
cand AS (
  SELECT p.qid, a.vec_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
  FROM probes p JOIN assign a ON a.cell = p.cell
  JOIN embeddings q ON q.vec_id = p.qid JOIN embeddings i ON i.vec_id = a.vec_id
  WHERE a.vec_id <> p.qid
)
SELECT qid, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::BIGINT AS rank FROM cand)
WHERE rank <= {VECTOR_TOPK}"""


@register("ivf_probe", sql=PROBE_SQL)
def q_ivf_probe(spark, sf_dir):
    q, _ = self_queries(spark, sf_dir)
    return label_store(spark, sf_dir).search(q, VECTOR_TOPK, NPROBE_FIXTURE, iid="vec_id", exclude_self=True)


# --- A15: a collection that grows without a new fit ---------------------------
def _grown(spark, sf_dir):
    e = emb(spark, sf_dir)
    store = V.CellStore.create(spark, shared_dir(spark, "grown-cells"), e, "vec_id", "embedding",
                               V.label_centroids(e, "label", "embedding"))
    for batch, rows in (("even", "vec_id % 2 = 0"), ("odd", "vec_id % 2 <> 0"), ("odd", "vec_id % 2 <> 0")):
        store.append(e.filter(rows), "vec_id", "embedding", batch)
    return store


@register("cells_append_probe", sql=PROBE_SQL)
def q_cells_append_probe(spark, sf_dir):
    q, _ = self_queries(spark, sf_dir)
    return _grown(spark, sf_dir).search(q, VECTOR_TOPK, NPROBE_FIXTURE, iid="vec_id", exclude_self=True)


@register("cells_exact", sql=f"""SELECT qid, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::BIGINT AS rank
  FROM ({EXACT_SQL})) WHERE rank <= {VECTOR_TOPK}""")
def q_cells_exact(spark, sf_dir):
    """Every cell probed: the exact search, from the stored collection."""
    q, _ = self_queries(spark, sf_dir)
    return label_store(spark, sf_dir).search(q, VECTOR_TOPK, None, iid="vec_id", exclude_self=True)


# --- D5 / E3 with KMeans cells (no SQL twin: iterative training) -----------
@register("ivf_kmeans_recall", note="KMeans cells; recall@10 of IVF vs exact per question")
def q_ivf_kmeans_recall(spark, sf_dir):
    e = emb(spark, sf_dir)
    n = e.count()
    k = max(2, int(round(n ** 0.5)))
    cents = V.kmeans_centroids(e, "embedding", k)
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = e.select("vec_id", F.col("embedding").alias("ivec"))
    approx = V.ivf_search(q, it, cents, VECTOR_TOPK, min(10, k), qid="qid", iid="vec_id",
                          qvec="qvec", ivec="ivec", exclude_self=True)
    exact = V.dense_topk(q, it, VECTOR_TOPK, qid="qid", iid="vec_id", qvec="qvec", ivec="ivec",
                         exclude_self=True)
    hit = exact.join(approx.select("qid", "vec_id", F.lit(1).alias("found")), ["qid", "vec_id"], "left")
    return hit.groupBy("qid").agg(
        (F.sum(F.coalesce("found", F.lit(0))) / F.count(F.lit(1))).alias("recall_at_10"))
