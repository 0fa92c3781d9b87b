import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import prepare as P
from quarry.sources import files
from quarry.streaming import ingest as J


def test_json_array_and_list_literals(spark):
    d = tempfile.mkdtemp(prefix="quarry-json-")
    with open(os.path.join(d, "recs.json"), "w", encoding="utf-8") as f:
        json.dump([{"title": "标题", "content": "内容"}, {"title": "t2", "content": "c2"}], f, ensure_ascii=False)
    got = files.read_json_records(spark, d, multiline=True).orderBy("title").collect()
    assert [(r.title, r.content) for r in got] == [("t2", "c2"), ("标题", "内容")]
    lits = ["['a','b']", "['a\\'s', \"b\"]", "[\"it's\", 'x']", "['a', b"]
    df = spark.createDataFrame([(x,) for x in lits], "s string")
    parsed = [r.p for r in df.select(P.parse_list_literal("s").alias("p")).collect()]
    assert parsed[:3] == [["a", "b"], ["a's", "b"], ["it's", "x"]]
    assert parsed[3] is None


def test_docx_roundtrip():
    text = "line one\nline <two> & \"three\"\n\tindented"
    assert files.docx_text(files.docx_bytes(text)) == text


def test_docx_query_writes_no_file_of_its_own(spark, monkeypatch):
    """Bytes go through Spark's writer, and read_docx reads given files."""
    d = tempfile.mkdtemp(prefix="quarry-docx-")
    df = spark.createDataFrame([(1, "a\nb"), (-2, None), (3, "<&>")], "doc_id long, text string")
    files.write_docx_rows(df, f"{d}/rows", "doc_id", "text")
    assert not [x for _, _, names in os.walk(d) for x in names if x.endswith(".docx")]
    want = {"1.docx": "a\nb", "-2.docx": "", "3.docx": "<&>"}
    assert {r.source: r.content for r in files.read_docx_rows(spark, f"{d}/rows").collect()} == want
    with open(os.path.join(d, "given.docx"), "wb") as f:
        f.write(files.docx_bytes("x\ny"))
    assert [(r.source.split("/")[-1], r.content) for r in files.read_docx(spark, d).collect()] == [("given.docx", "x\ny")]


def test_allowed_and_route(spark):
    names = ["a.txt", "a.PDF", "noext", "http://x/y.pdf", "http://x/y", "", "a.", "b.docx"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: (r.ok, r.route) for r in P.route_source(df, "path")
           .select("path", P.allowed_file("path").alias("ok"), "route").collect()}
    assert got["a.txt"] == (True, "txt") and got["a.PDF"] == (False, "")
    assert got["http://x/y.pdf"] == (True, "pdf") and got["http://x/y"] == (False, "url")
    assert got["noext"] == (False, "") and got["a."] == (False, "")


def test_stream_counts_equal_batch(spark):
    s = {(str(r.day), r.event_type): r.n for r in J.stream_daily_counts(spark, SF001).collect()}
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    b = {(str(r.day), r.event_type): r.n for r in
         ev.groupBy(F.to_date("ts").alias("day"), "event_type").count().withColumnRenamed("count", "n").collect()}
    assert s == b


def test_release_intermediates(spark):
    from quarry.session import release_intermediates, shared_dir
    release_intermediates(spark)  # forget folders of earlier tests
    p = shared_dir(spark, "release-test")
    spark.range(3).write.parquet(p)
    assert spark.read.parquet(p).count() == 3
    assert release_intermediates(spark) == 1
    assert not os.path.exists(p.replace("file:", ""))


def test_second_run_takes_only_new_files(spark):
    """The same checkpoint and sink: a second availableNow run adds the new file's rows."""
    d = tempfile.mkdtemp(prefix="quarry-inc-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.filter("doc_id < 100").coalesce(1).write.parquet(f"{d}/in/part=a")
    seen = []

    def note(batch, _):
        seen.extend(r.doc_id for r in batch.select("doc_id").collect())

    def run():
        stream = spark.readStream.schema(docs.schema).parquet(f"{d}/in/*")
        J.run_available(stream.writeStream.foreachBatch(note).option("checkpointLocation", f"{d}/ckpt"), "inc", spark)
    run()
    first = len(seen)
    docs.filter("doc_id >= 100").coalesce(1).write.parquet(f"{d}/in/part=b")
    run()
    assert first == docs.filter("doc_id < 100").count()
    assert sorted(seen) == sorted(r.doc_id for r in docs.collect())
