import time

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import vectors as V


def make(spark, n=300, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 6, n))  # hot cell
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(n)]
    return x, label, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(x, k, exclude_self=True):
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 6)
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
    out = {}
    for q in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-s[q, j], j))[:k]
        out[q] = order
    return out


def test_dense_topk_blocks_equal_brute_force(spark):
    x, _, df = make(spark)
    q = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = df.select("vec_id", F.col("embedding").alias("ivec"))
    # small blocks force a 5x4 grid of cogroups
    got = V.dense_topk(q, it, 5, qid="qid", iid="vec_id", qvec="qvec", ivec="ivec", exclude_self=True,
                       q_rows=64, i_rows=80).toPandas()
    want = brute(x, 5)
    for qid, grp in got.groupby("qid"):
        assert grp.sort_values("rank")["vec_id"].tolist() == want[qid]


def test_ivf_all_cells_equals_exact(spark):
    x, label, df = make(spark)
    cents = V.label_centroids(df, "label", "embedding")
    q = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = df.select("vec_id", F.col("embedding").alias("ivec"))
    ncell = len(set(label.tolist()))
    got = V.ivf_search(q, it, cents, 5, ncell, qid="qid", iid="vec_id", qvec="qvec", ivec="ivec",
                       exclude_self=True).toPandas()
    want = brute(x, 5)
    for qid, grp in got.groupby("qid"):
        assert grp.sort_values("rank")["vec_id"].tolist() == want[qid]


def test_mean_pool_and_normalize(spark):
    x, label, df = make(spark)
    mp = {r.label: np.array(r.embedding) for r in V.mean_pool(df, "label", "embedding").collect()}
    for lab in set(label.tolist()):
        assert np.allclose(mp[lab], x[label == lab].astype(np.float64).mean(axis=0), atol=1e-9)
    n = V.normalize(df, "embedding").select(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v).alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in n.collect())


def test_chunks_and_questions_share_a_space(spark):
    rows = [(1, "厦门有什么好玩的地方"), (2, "推荐厦门好玩的地方"), (3, "股票市场今日上涨"), (4, ""), (5, None)]
    e = {r.id: np.array(r.embedding) for r in V.embed(spark.createDataFrame(rows, "id long, text string"), "text").collect()}
    assert e[1] @ e[2] > 0.3 > e[1] @ e[3]
    assert all(np.isclose(np.linalg.norm(e[i]), 1.0) for i in (1, 2, 3))
    assert not e[4].any() and not e[5].any()


def test_normalise_is_linear_in_width(spark):
    def seconds(width):
        df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda x: x.cast("double")).alias("v"))
        V.normalize(df, "v").write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        V.normalize(df, "v").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t
    assert seconds(1024) < 8 * seconds(256) + 0.5


def test_copies_of_an_all_pairs_search_do_not_grow(spark):
    blocks = lambda n: spark.range(n).agg(V._blocks(V.Q_ROWS, V.SPREAD), V._blocks(V.I_ROWS)).first()
    assert tuple(blocks(1000)) == (1, 1)
    assert tuple(blocks(50_000)) == (16, 2) and tuple(blocks(250_000)) == (16, 8)
    assert tuple(blocks(2_000_000)) == (123, 62)  # blocks stay bounded


def test_ivf_questions_do_not_pass_the_driver(spark, monkeypatch):
    x, label, df = make(spark)
    cents = V.label_centroids(df, "label", "embedding")
    q = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    it = df.select("vec_id", F.col("embedding").alias("ivec"))
    store = V.CellStore.create(spark, __import__("tempfile").mkdtemp() + "/s", it, "vec_id", "ivec", cents)
    store.append(it, "vec_id", "ivec")
    want = sorted(map(tuple, store.search(q, 5, 2, "qid", "qvec", "vec_id", True).collect()))
    monkeypatch.setattr(type(q), "toLocalIterator", None)
    got = V.ivf_search(q, it, cents, 5, 2, iid="vec_id", exclude_self=True)
    assert sorted(map(tuple, got.collect())) == want
