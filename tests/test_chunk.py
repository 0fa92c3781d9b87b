import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.chunk import chunk_recursive, chunk_windows, split_recursive


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n中.", max_size=600), st.integers(min_value=5, max_value=60))
def test_split_properties(text, size):
    chunks = split_recursive(text, size, 0)
    assert all(0 < len(c) <= size for c in chunks)
    # non-space characters survive in order
    assert "".join("".join(c.split()) for c in chunks) == "".join(text.split())


def test_split_prefers_paragraphs():
    text = "a" * 100 + "\n\n" + "b" * 100 + "\n\n" + "c" * 100
    assert split_recursive(text, 250, 0) == ["a" * 100 + "\n\n" + "b" * 100, "c" * 100]
    assert split_recursive("中" * 600, 250, 0) == ["中" * 250, "中" * 250, "中" * 100]


def test_chunk_recursive_matches_python(spark):
    docs = [(1, "s1", "word " * 120), (2, "s2", ""), (3, "s3", "x\n\ny" * 90), (4, "s4", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.cont_id, r.content) for r in chunk_recursive(df).collect())
    want = sorted((d, i + 1, c) for d, _, t in docs for i, c in enumerate(split_recursive(t or "")))
    assert got == want


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, "s", "a" * 501), (2, "s", "")], "doc_id long, source string, text string")
    rows = sorted((r.doc_id, r.cont_id, len(r.content)) for r in chunk_windows(df).collect())
    assert rows == [(1, 1, 250), (1, 2, 250), (1, 3, 1)]


def test_chunk_windows_han_and_newlines(spark):
    texts = ["中" * 251, "a\nb\r\n" * 100, "é🙂" * 200, None]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.cont_id, r.content) for r in chunk_windows(df).collect())
    assert got == [(i, n // 250 + 1, t[n: n + 250]) for i, t in enumerate(texts) if t for n in range(0, len(t), 250)]


def test_chunk_windows_is_linear(spark):
    def seconds(n):
        df = spark.range(4).selectExpr("id AS doc_id", "'s' AS source", f"repeat('word ', {n // 5}) AS text")
        chunk_windows(df).write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        chunk_windows(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t
    assert seconds(800_000) < 4 * seconds(200_000) + 0.5


def test_recursive_chunks_are_held_for_a_few_documents():
    import pandas as pd
    from pyspark.sql import types as T

    class Docs:  # what chunk_recursive asks of a table
        schema = T.StructType([T.StructField("doc_id", T.LongType())])

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run
    from quarry.operators.chunk import RUN
    run = chunk_recursive(Docs(), size=10, overlap=0, keep=("doc_id",))
    whole = pd.DataFrame({"doc_id": range(500), "text": ["some words and more"] * 500})
    parts = list(run(iter([whole])))
    assert max(p["doc_id"].nunique() for p in parts) <= RUN < 500
    assert pd.concat(parts)["doc_id"].nunique() == 500
