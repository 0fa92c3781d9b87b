"""Continued tables, answer spans, pairing of events, bounded files, arrays, histories, logs, word lists."""
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import analyze, attribution, dialogue, layout, prompt
from quarry.plans.strategy import group_running_sum, ordered_sessions
from quarry.sources import files
from quarry.streaming import ingest


def folder():
    return tempfile.mkdtemp(prefix="quarry-runs-")


@pytest.mark.parametrize("seed", range(3))
def test_continued_tables_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for doc in ["big", "a", "b", "c"]:
        page = 0
        for _ in range(90 if doc == "big" else rng.randrange(1, 25)):  # one document has over a third of the parts
            page += rng.choice([1, 1, 1, 1, 2])
            rows.append((doc, page, rng.choice(["h", "h", "h", "k"]), rng.choice([590.0, 550.0, 500.0, 499.0])))
    want, prev = {}, None
    for doc, page, head, y in sorted(rows):
        goes_on = prev and prev[0] == doc and prev[1] == page - 1 and prev[2] == head and 600 - prev[3] <= 100
        want[doc, page] = want[doc, page - 1] if goes_on else page
        prev = doc, page, head, y
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, page long, header string, y_bottom double").withColumn("page_height", F.lit(600.0))
    got = layout.merge_continued(df.repartition(7))
    assert {(r.doc, r.page): r.table_page for r in got.collect()} == want
    assert got.count() == len(rows)
    assert layout.merge_continued(df.limit(0)).count() == 0


def test_merged_rows_stay_in_order(spark):
    cells = [("d", p, r, f"v{p}.{r} x", None if r == 1 else 5) for p in range(1, 4) for r in range(3)]
    parts = [("d", 1, 1), ("d", 2, 1), ("d", 3, 1)]
    out = layout.merged_tables(spark.createDataFrame(cells, "doc string, page long, row long, a string, b int"),
                               spark.createDataFrame(parts, "doc string, page long, table_page long"), ["a", "b"], page_rows=5)
    got = {r.piece: (r.doc, r.page, r.markdown.split("\n")) for r in out.collect()}
    lines = [f"|v{p}.{r}x|{'' if r == 1 else 5}|" for p in range(1, 4) for r in range(3)]
    assert got == {0: ("d", 1, ["|a|b|", "|---|---|", *lines[:5]]), 1: ("d", 1, ["|a|b|", "|---|---|", *lines[5:]])}


def test_sessions_and_sums_do_not_depend_on_tasks(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 4}", i, rng.randrange(3)) for i in range(200)] + [(None, 1, 2), (None, 2, 1)]
    df = spark.createDataFrame(rows, "g string, t long, v int")
    seen = set()
    for n in (1, 3, 9):
        s = group_running_sum(df, ["g"], ["t"], F.col("v"), "before", n)
        got = sorted(((r.g or "", r.t, r.before) for r in s.collect()))
        total = {}
        for g, t, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            assert (g or "", t, total.get(g, 0)) in got
            total[g] = total.get(g, 0) + v
        x = ordered_sessions(df, ["g", "t"], lambda p: p["g"].eqNullSafe(F.col("g")) & (p["v"] == F.col("v")), ["g", "v"], "run", "t", n)
        seen.add(tuple(sorted((r.g or "", r.t, r.run, r.t_of_run) for r in x.collect())))
    assert len(seen) == 1


def loop_spans(answer, contexts):
    pieces = [p for p in re.split(r"<\d+>:", contexts) if p]
    def sim(p):
        a, b = set(answer), set(p)
        return round(len(a & b) / len(a | b), 6) if a | b else 0.0
    best = max(range(len(pieces)), key=lambda i: (sim(pieces[i]), -i), default=None)
    out = []
    for i, p in enumerate(pieces):
        for text, label in [(f"<{i + 1}>", "other"), *((c, "same" if i == best and c in answer else "other") for c in p)]:
            if out and out[-1][1] == label:
                out[-1][0] += text
            else:
                out.append([text, label])
    return [tuple(x) for x in out]


def test_spans_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randrange(0, 6))), "".join(
        f"<{j}>: " + "".join(rng.choices("abcdefgé<> \n", k=rng.randrange(0, 30))) for j in range(1, rng.randrange(1, 13)))) for i in range(80)]
    rows += [(100, "x", ""), (101, "", "<1>: x"), (102, "ab", "<1>: ba\n\n<2>: ab")]
    df = spark.createDataFrame(rows, "qa_id long, answer string, contexts string")
    out = attribution.highlight_spans(df, "qa_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # nothing leaves its row
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.qa_id, r.span_no)):
        got.setdefault(r.qa_id, []).append((r.text, r.label))
    for i, answer, contexts in rows:
        assert got.get(i, []) == loop_spans(answer, contexts), (answer, contexts)


def test_next_event_against_a_loop(spark):
    rng = random.Random(9)
    at = lambda: rng.randrange(0, 4000)
    users = ["hot"] * 6 + ["a", "b", None]
    req = [(i, rng.choice(users), at()) for i in range(150)]
    rsp = [(1000 + i, rng.choice(users), at(), rng.choice(["ok", "error"])) for i in range(120)]
    ts = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(s))
    q = spark.createDataFrame(req, "event_id long, user_id string, s long").withColumn("ts", ts("s"))
    r = spark.createDataFrame(rsp, "event_id long, user_id string, s long, event_type string").withColumn("ts", ts("s"))
    got = prompt.next_event(q, r.drop("s"), "user_id", "ts", "event_id", 300).collect()
    assert len(got) == len(req)
    for x in got:
        later = sorted((s, i, kind) for i, u, s, kind in rsp if u == x.user_id and x.s <= s <= x.s + 300)
        assert (x.response_id, x.response_type) == ((later[0][1], later[0][2]) if later else (None, None))


def test_text_parts_are_bounded(spark):
    rows = [("big", i, "x" * (i % 40)) for i in range(300)] + [("one", 1, "y" * 500), ("two", 1, None), ("two", 2, "é")]
    d = folder()
    files.write_text_files(spark.createDataFrame(rows, "source string, doc_id long, text string"), d, "source", "text", "doc_id", most=200)
    got = [(re.search(r"source=([^/]+)/part=(\d+)/", r.source).groups(), r.content) for r in files.read_text_files(spark, d).collect()]
    assert max(len(c) for (s, _), c in got if s == "big") < 200 + 41  # the bound and a row
    for s in ("big", "one", "two"):
        whole = "".join(c for _, c in sorted((int(p), c) for (x, p), c in got if x == s))
        assert whole == "".join((t or "") + "\n" for x, i, t in rows if x == s)
    assert len({p for (s, p), _ in got if s == "big"}) > 20


def test_small_text_files_are_few_tasks(spark):
    rows = [("s", i, "x" * 20) for i in range(80)]
    d = folder()
    files.write_text_files(spark.createDataFrame(rows, "source string, doc_id long, text string"), d, "source", "text", "doc_id", most=21)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a split, by its cost
        r = files.read_text_files(spark, d)
        assert r.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(x.content for x in r.collect()) == ["x" * 20 + "\n"] * 80 and r.select("source").distinct().count() == 80
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_arrays_mixed(spark):
    lines = ['["s", {"title": "t", "content": "c"}, null, 5, {"title": "t"}, {"content": "d", "x": [1]}, ["n"], true, ""]', "[]", "[1", "{}", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, v string")
    good, bad = files.json_array_elements(df, "v")
    assert sorted(map(tuple, good.collect())) == [(0, 0, "string", None, "s"), (0, 1, "record", "t", "c"), (0, 5, "record", None, "d"), (0, 8, "string", None, "")]
    assert sorted(((r.id, r.pos, r.reason) for r in bad.collect()), key=str) == sorted(
        [(0, 2, "neither string nor record"), (0, 3, "neither string nor record"), (0, 4, "no content"), (0, 6, "neither string nor record"),
         (0, 7, "neither string nor record"), (2, None, "not an array"), (3, None, "not an array"), (4, None, "not an array"), (5, None, "not an array")], key=str)


def test_recent_history_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 else "bot", "w" * rng.choice([0, 1, 5, 30, 90])) for c, n in ((1, 120), (2, 30), (3, 1)) for t in range(n)]
    got = {(r.conv_id, r.turn): (r.n_prev, r.history) for r in dialogue.recent_history(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 100).collect()}
    assert len(got) == len(rows)
    for c, t, _, _ in rows:
        mine = [f"{r}: {x}" for cc, tt, r, x in rows if cc == c and tt < t]
        fit = []
        while mine and sum(len(x) + 1 for x in fit) + len(mine[-1]) + 1 <= 100:
            fit.insert(0, mine.pop())
        assert got[c, t] == (len(fit), "\n".join(fit))


def test_log_files_by_day(spark):
    d = folder() + "/logs"
    log = lambda rows: spark.createDataFrame(rows, "event_id long, time string, name string, level string, message string").select(
        "event_id", F.col("time").cast("timestamp_ntz").alias("time"), "name", "level", "message", F.to_date("time").alias("day"))
    dialogue.write_log_files(log([(i, f"2024-01-{i:02d} 05:00:00", "n", lv, "old") for i in range(1, 21) for lv in ("INFO", "ERROR")]), d)
    dialogue.write_log_files(log([(99, "2024-01-20 06:00:00", "n", "INFO", "new")]), d)
    assert dialogue.expire_log_files(spark, d, 10) == 10
    back = dialogue.read_log_files(spark, d)
    got = {(str(r.day), r.level): (r.event_id, r.message) for r in back.collect()}
    assert len(got) == 20 and min(got)[0] == "2024-01-11"
    assert got["2024-01-20", "INFO"] == (99, "new") and got["2024-01-20", "ERROR"] == (20, "old")  # the other level is left
    one = back.filter("day = date'2024-01-15' and level = 'ERROR'")
    assert len(one.inputFiles()) == len(back.inputFiles())  # listed, but
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1
    assert dialogue.expire_log_files(spark, d, 90) == 0


def longest_first(words, text):
    out, i = [], 0
    while i < len(text):
        hit = max((w for w in words if text.startswith(w, i)), key=len, default=None)
        if hit:
            out.append(hit)
        i += len(hit) if hit else 1
    return out


def test_word_lists_against_a_loop(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab(.é$中", k=rng.randrange(1, 5))) for _ in range(60)}) + ["a-b", "^", "[x]", "a|b", "\\", "a b"]
    texts = ["".join(rng.choices("ab(.é$中-^[]x|\\ ", k=rng.randrange(0, 60))) for _ in range(80)] + ["", None]
    lists = spark.createDataFrame([(f"c{i % 3}", w) for i, w in enumerate(words)] + [("c9", words[0])], "category string, term string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.category, r.word): r.n for r in analyze.dictionary_matches(df, "text", lists, ["id"]).collect()}
    want = {}
    for i, t in enumerate(texts):
        for w in longest_first(words, t or ""):
            for c in [f"c{words.index(w) % 3}"] + (["c9"] if w == words[0] else []):
                want[i, c, w] = want.get((i, c, w), 0) + 1
    assert got == want
    assert analyze.dictionary_matches(df, "text", lists.limit(0), ["id"]).count() == 0


def test_two_runs_read_new_files_only(spark):
    docs = lambda ids: spark.createDataFrame([(i, f"s{i % 2}", f"text {i // 2}") for i in ids], "doc_id long, source string, text string")
    src, sink, ckpt = (folder() for _ in range(3))
    os.rmdir(sink)
    docs([1, 2, 2, 3]).write.parquet(f"{src}/a")
    one = ingest.ingest_run(spark, src, sink, ckpt, docs([1]).schema)
    assert sorted(r.doc_id for r in one.collect()) == [1, 2, 3]
    docs([3, 4, 5]).write.parquet(f"{src}/b")
    two = ingest.ingest_run(spark, src, sink, ckpt, docs([1]).schema)
    assert sorted((r.doc_id, r.batch) for r in two.collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    again = ingest.ingest_run(spark, src, sink, ckpt, docs([1]).schema)  # nothing new
    assert again.count() == 5
