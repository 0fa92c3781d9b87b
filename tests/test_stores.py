"""Stores that are built once and appended to: postings, cells, and their manifest."""
import math
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import lexical
from quarry.operators import vectors as V
from quarry.plans import corpus
from quarry.sources.segments import Segments
from test_lexical import py_bm25, py_terms
from test_vectors import brute, make


def folder():
    return tempfile.mkdtemp(prefix="quarry-store-") + "/s"


CHUNKS = "doc_id long, cont_id long, source string, content string"


def chunks(spark, n=60):
    return spark.createDataFrame([(i, 1, "s", f"hot word{i % 7} word{i % 11} hot" if i % 13 else "") for i in range(n)]
                                 + [(900, 1, "s", None), (901, 1, "s", "a an the")], CHUNKS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_appended_equals_full(spark, monkeypatch):
    c = chunks(spark)
    q = spark.createDataFrame([(1, "hot word3"), (2, "word5 word10 word5"), (3, "nothing"), (4, None), (5, "")], "item_id long, text string")
    full = lexical.LexicalStore.create(spark, folder(), c)
    full.append(c)
    monkeypatch.setattr(lexical, "SHARD", 4)  # many shards in a task
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 2)  # many question blocks
    grown = lexical.LexicalStore.create(spark, folder(), c)
    assert grown.append(c.filter("doc_id < 25"), batch="a")
    assert grown.append(c.filter("doc_id >= 25"), batch="b")
    assert not grown.append(c.filter("doc_id >= 25"), batch="b")  # a repeated delivery
    want = rows(full.search(q, 5))
    assert rows(grown.search(q, 5)) == want and {r[0] for r in want} == {1, 2}
    assert rows(grown.term_stats()) == rows(full.term_stats())
    assert grown.stats() == full.stats()
    text = {(r.doc_id, r.cont_id): r.content or "" for r in c.collect()}
    truth = py_bm25({1: "hot word3", 2: "word5 word10 word5"}, text)
    for i in (1, 2):
        got = sorted([((r[1], r[2]), r[3]) for r in want if r[0] == i], key=lambda x: (-x[1], x[0]))
        assert got[:3] == truth[i]
    grown.compact(shard=32)
    assert len(grown.segments.manifest()["segments"]) == 1
    assert grown.postings().select("segment", "shard").distinct().count() <= 3
    assert rows(grown.search(q, 5)) == want and rows(grown.term_stats()) == rows(full.term_stats()) and grown.stats() == full.stats()
    assert not grown.append(c.filter("doc_id >= 25"), batch="b")  # names outlive compaction
    again = lexical.LexicalStore(spark, grown.segments.path)  # opened by its path alone
    assert rows(again.search(q, 5)) == want
    grown.drop()
    assert not grown.segments.exists()


def test_term_stats_by_hand(spark):
    c = chunks(spark)
    store = lexical.LexicalStore.create(spark, folder(), c)
    store.append(c)
    terms = [py_terms(r.content or "") for r in c.collect()]
    cf, df = Counter(t for x in terms for t in x), Counter(t for x in terms for t in set(x))
    assert {r.term: (r.df, r.cf) for r in store.term_stats().collect()} == {t: (df[t], cf[t]) for t in cf}
    n, avg = store.stats()
    assert n == sum(bool(x) for x in terms) and math.isclose(avg, sum(map(len, terms)) / n)


def test_empty_store_and_empty_append(spark):
    c = chunks(spark)
    store = lexical.LexicalStore.create(spark, folder(), c)
    q = spark.createDataFrame([(1, "hot")], "item_id long, text string")
    assert store.search(q).count() == 0 and store.term_stats().count() == 0
    store.append(c.limit(0))
    assert store.search(q).count() == 0
    store.append(c)
    assert store.search(q).count() == 10


def test_search_reads_no_chunk_text(spark):
    """The plan of a search scans postings; the analyser's regular expressions are the questions' only."""
    store = corpus.lexical_store(spark, SF001)
    q = spark.createDataFrame([(1, "the word")], "item_id long, text string")
    plan = store.search(q)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "posts#" in plan


def test_stores_are_built_once_for_a_state(spark, tmp_path):
    src = f"file://{tmp_path}"
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    d.limit(5).coalesce(1).write.parquet(f"{src}/documents.parquet")
    one = corpus.lexical_store(spark, src).segments.path
    assert corpus.lexical_store(spark, src).segments.path == one
    d.limit(7).coalesce(1).write.mode("overwrite").parquet(f"{src}/documents.parquet")
    assert corpus.lexical_store(spark, src).segments.path != one  # other files, another store


def test_manifest_is_seen_whole_or_not(spark):
    s = Segments(spark, folder())
    at = s.manifest()
    assert at["version"] == 0 and not s.exists()
    spark.range(3).write.parquet(s.folder("t", "one"))
    assert s.read("t", "id long").count() == 0  # written, not committed
    s.commit(at, {"one": {"batches": ["x"]}})
    assert s.read("t", "id long").count() == 3
    with pytest.raises(Exception, match="exist"):
        s.commit(at, {"two": {"batches": ["y"]}})  # another writer was first
    spark.range(5).write.parquet(s.folder("t", "left-over"))
    assert s.vacuum("t") == 1 and s.read("t", "id long").count() == 3


@pytest.mark.parametrize("nprobe", [None, 6, 2, 1])
def test_cells_against_brute_force(spark, nprobe, monkeypatch):
    x, label, df = make(spark)
    cents = V.label_centroids(df, "label", "embedding")
    store = V.CellStore.create(spark, folder(), df, "vec_id", "embedding", cents)
    for batch in ("a", "b", "b"):
        store.append(df.filter(f"vec_id % 2 = {int(batch == 'b')}"), "vec_id", "embedding", batch)
    assert store.rows().count() == len(x)
    monkeypatch.setattr(V.CellStore, "QUERIES", 70)  # several blocks of questions
    q = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = store.search(q, 5, nprobe, iid="vec_id", exclude_self=True).toPandas()
    ids, c = V.centroid_matrix(cents)
    s = np.round(x.astype(np.float64) @ c.T, 6)
    cell = ids[s.argmax(axis=1)]
    full = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 6)
    for i in range(len(x)):
        probed = set(ids[np.argsort(-s[i], kind="stable")[:nprobe or len(ids)]])
        may = [j for j in range(len(x)) if j != i and cell[j] in probed]
        want = sorted(may, key=lambda j: (-full[i, j], j))[:5]
        assert got[got.qid == i].sort_values("rank")["vec_id"].tolist() == want
    if nprobe is None:
        assert {i: got[got.qid == i].sort_values("rank")["vec_id"].tolist() for i in range(len(x))} == brute(x, 5)


def test_cells_not_probed_are_not_read(spark):
    _, _, df = make(spark)
    store = V.CellStore.create(spark, folder(), df, "vec_id", "embedding", V.label_centroids(df, "label", "embedding"))
    store.append(df, "vec_id", "embedding")
    q = df.limit(1).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    plan = store.search(q, 5, 1, iid="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_nulls_and_ties_in_cells(spark):
    data = [(i, [1.0, 0.0]) for i in (5, 3, 9, 1)] + [(7, None), (2, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    store = V.CellStore.create(spark, folder(), df, "vec_id", "embedding")
    store.append(df, "vec_id", "embedding")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, qvec array<double>")
    assert rows(store.search(q, 3, iid="vec_id")) == [(1, 1, 1.0, 1), (1, 3, 1.0, 2), (1, 5, 1.0, 3)]


def test_search_shuffles_no_postings(spark):
    """A shard is one file of one row group, read whole by one task: a search moves only its best rows."""
    import glob

    import pyarrow.parquet as pq
    c = chunks(spark)
    store = lexical.LexicalStore.create(spark, folder(), c)
    store.append(c.repartition(3))
    store.compact(shard=32)
    for d in glob.glob(f"{store.segments.path}/postings/segment=*/shard=*"):
        files = glob.glob(f"{d}/*.parquet")
        assert len(files) == 1 and pq.ParquetFile(files[0]).num_row_groups == 1
    found = store.search(spark.createDataFrame([(1, "hot word3")], "item_id long, text string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert not any("posts" in line for line in plan.splitlines() if "Exchange hash" in line)


def test_runs_are_bounded_by_terms(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 3)
    monkeypatch.setattr(lexical, "SHARD_TERMS", 10)
    assert list(lexical._runs(np.array([4, 4, 4, 50, 0, 0, 0, 0, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 9)]
    assert list(lexical._runs(np.zeros(0, np.int64))) == []


def test_a_task_merges_its_shards(monkeypatch):
    """A shard over several batches is one; of all shards a question has k rows."""
    import pyarrow as pa
    posts = pa.list_(pa.struct([("pos", pa.int32()), ("dl", pa.int32()), ("tf", pa.int32()), ("k0", pa.int64())]))
    one = lambda shard, term, ids: pa.RecordBatch.from_pylist(
        [{"segment": "s", "shard": shard, "term": term, "posts": [{"pos": i, "dl": 2, "tf": 1, "k0": 10 * shard + i} for i in ids]}],
        pa.schema([("segment", pa.string()), ("shard", pa.int64()), ("term", pa.string()), ("posts", posts)]))

    class Sent:
        value = [7], ["a", "b"], [np.array([0, 1])], [np.array([1.0, 1.0])]
    run = lexical._best_chunks(Sent, ["doc_id"], "q", pa.int64(), 2, 1.2, 0.75, 2.0)
    out = pa.Table.from_batches(run(iter([one(1, "a", [0, 1, 2]), one(1, "b", [2]), one(2, "a", [0]), one(2, "b", [0, 1])]))).to_pylist()
    assert [(r["q"], r["doc_id"]) for r in out] == [(7, 12), (7, 20)] and out[0]["score"] == out[1]["score"]


def test_a_search_lets_few_rows_out(spark, monkeypatch):
    """Tasks, and with them the k rows a question that each lets out, are bounded where questions are many."""
    c = chunks(spark, 240)
    store = lexical.LexicalStore.create(spark, folder(), c)
    for i in range(6):
        store.append(c.filter(F.col("doc_id") % 6 == i))
    q = spark.createDataFrame([(i, f"hot word{i}") for i in range(8)], "item_id long, text string")
    want = rows(store.search(q, 3))
    seen, real = [], lexical.top_k
    monkeypatch.setattr(lexical, "top_k", lambda df, *a: seen.append(df) or real(df, *a))
    monkeypatch.setattr(lexical, "SEARCH_TASKS", 2, raising=False)
    monkeypatch.setattr(lexical, "SEARCH_ROWS", 1, raising=False)
    monkeypatch.setattr(lexical, "GROUP_POSTS", 50, raising=False)  # several groups a task
    monkeypatch.setattr(lexical, "LONG", 2, raising=False)
    assert rows(store.search(q, 3)) == want
    assert seen[0].count() <= 2 * 3 * 8


def test_no_null_lists_are_handed_over(spark):
    """Spark goes through an Arrow batch's last run of null lists again at each row: posting lists come with empty ones."""
    c = chunks(spark, 40)
    store = lexical.LexicalStore.create(spark, folder(), c)
    store.append(c.filter("doc_id < 20"))
    store.append(c.filter("doc_id >= 20"))
    given, filled = [], lexical._filled
    try:
        lexical._filled = lambda search: given.append(search) or filled(search)
        found = store.search(spark.createDataFrame([(1, "hot word3"), (2, "word5")], "item_id long, text string"), 5)
    finally:
        lexical._filled = filled
    assert len(given) == 1
    step = found._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in step.nodeName():
        step = step.children().apply(0)
    rows_in = step.children().apply(0).output()
    lists = [rows_in.apply(i) for i in range(rows_in.size()) if rows_in.apply(i).dataType().typeName() == "array"]
    assert len(lists) >= 2 and not any("struct" in x.dataType().simpleString() for x in lists)
    want = lexical.bm25_topk(spark.createDataFrame([(1, "hot word3"), (2, "word5")], "item_id long, text string"), c, k=5, carry=())
    assert rows(found) == rows(want)


def test_a_task_begins_with_one_shard(monkeypatch):
    """What a question finds in a task's first shard is what the others have to beat."""
    import pyarrow as pa
    monkeypatch.setattr(lexical, "GROUP_POSTS", 50)
    shard = pa.table({"posts": pa.array([[1] * 10, [2] * 6], pa.list_(pa.int32()))})
    assert [len(g) for g in lexical._groups(iter([shard] * 8))] == [1, 3, 3, 1]


def test_only_wanted_chunks_are_joined(spark):
    c = chunks(spark, 200)
    found = lexical.bm25_topk(spark.createDataFrame([(1, "word3 word10")], "item_id long, text string"), c, k=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan
    text = {(r.doc_id, r.cont_id): r.content for r in c.collect()}
    assert found.count() == 4 and all(text[r.doc_id, r.cont_id] == r.content for r in found.collect())
    wanted = spark.createDataFrame([(5, 1), (199, 1), (900, 1), (None, 1)], "doc_id long, cont_id long")
    kept = {r.doc_id for r in lexical._perhaps_in(c, wanted, ["doc_id", "cont_id"]).collect()}
    assert {5, 199, 900} <= kept and len(kept) < 20


def test_a_chunk_is_described_once(spark):
    """A posting is a place and a count; a shard holds its chunks' lengths and keys in one row, compacted or not."""
    c = chunks(spark, 40)
    store = lexical.LexicalStore.create(spark, folder(), c)
    store.append(c.filter("doc_id < 20"))
    store.append(c.filter("doc_id >= 20"))
    q = spark.createDataFrame([(1, "hot word3 word5")], "item_id long, text string")
    want = rows(store.search(q, 30))
    for _ in range(2):
        p = store.postings()
        assert [f.name for f in p.schema["posts"].dataType.elementType.fields] == ["pos", "tf"]
        shards = p.select("segment", "shard").distinct().count()
        held = p.filter("chunks is not null")
        assert held.count() == shards and held.filter("term is not null").count() == 0
        keys = sorted(r[0] for r in held.selectExpr("explode(chunks.k0)").collect())
        assert keys == sorted(r.doc_id for r in c.collect())
        store.compact(shard=1000)
        assert rows(store.search(q, 30)) == want


def test_question_contexts_leave_one_table(spark, tmp_path):
    """No second copy of the documents is kept, and no step of the way outlives the stored contexts."""
    from quarry import session
    from quarry.plans import evaluation
    spark.createDataFrame([(i, f"hot word{i} text. " * 30, "en", "s") for i in range(9)],
                          "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, r, f"word{i} {r}") for i in range(5) for t, r in enumerate(("user", "assistant"))],
                          "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    before = set(session._CREATED)
    got = evaluation.qa_contexts(spark, str(tmp_path)).filter("qa_id > 0").collect()
    assert sorted(r.qa_id for r in got) == [1, 2, 3, 4, 5] and all("hot word" in r.contexts for r in got)
    made = {p.split("/")[-2] for p in session._CREATED if p not in before}
    assert made == {"lexical-store", "qa-rows", "qa-contexts"}
