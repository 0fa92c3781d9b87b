from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.text import char_jaccard, normalize_newlines, terms


def py_normalize(s):
    while "\n\n" in s:
        s = s.replace("\n\n", "\n")
    while "\r\n" in s:
        s = s.replace("\r\n", "\n")
    return s


def py_jaccard(a, b):
    s1, s2 = set(a), set(b)
    u = s1 | s2
    return 0.0 if not u else len(s1 & s2) / len(u)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab\r\n", max_size=12), min_size=1, max_size=20))
def test_normalize_newlines_matches_loop(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.n for r in df.select("id", normalize_newlines("t").alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_normalize(t), repr(t)


def test_fixture_newline_cases(spark):
    cases = ["a\n\n\nb", "a\r\n\r\nb", "a\r\r\nb", "", "a\n\r\nb"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.n for r in df.select(normalize_newlines("t").alias("n")).collect()]
    assert got == [py_normalize(c) for c in cases]
    assert got[1] == "a\n\nb"  # CRLF blank lines survive: rewrite order


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcé中 ", max_size=8), st.text(alphabet="abcé中 ", max_size=8)),
                min_size=1, max_size=15))
def test_char_jaccard_matches_sets(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = {r.id: r.j for r in df.select("id", char_jaccard("a", "b").alias("j")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - py_jaccard(a, b)) < 1e-12


def test_terms_cjk_and_stop_words(spark):
    df = spark.createDataFrame([("The 五一去厦门 and Café文字",)], "t string")
    t = df.select(terms("t").alias("x")).first().x
    assert "the" not in t and "and" not in t  # stop words dropped
    assert "café" in t
    for g in ["五一", "一去", "去厦", "厦门", "文字"]:
        assert g in t
    one = spark.createDataFrame([("单",)], "t string").select(terms("t").alias("x")).first().x
    assert one == ["单"]
