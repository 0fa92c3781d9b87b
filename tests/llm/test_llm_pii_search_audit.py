"""Operators 11 (personal data), 12 (ranked search) and 13 (divergence audit)."""
import collections
import functools
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F
from test_llm_other import equal_to_sql

from quarry.llm import divergence, pii, strata_index
from quarry.llm.boosted import fit, sigmoid
from quarry.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string"


# 11: personal data

def plain_base(text):
    """The contract's patterns by themselves, with Python's backtracking."""
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (2 if i % 2 else 1)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(s, e, k) for s, _, k, e in sorted(found)]


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    bits = ["a", "B.c", "@", "@@", ".", "-", " ", "x@y.z", "+", "+1 ", "(632) 555-5381", "4921758104870150", "1.2.3.4", "255", "256", "é", "日本",
            "0", "12", "  ", "\n", "4012 8888 8888 1881", "mail5.example.com", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1", "1 ", "at ", "a at a dot ", "@.", "(1)", "1.2.3.4.", "a.b@c.d ", "+1 ("])
def test_scan_is_linear(unit):
    import time
    text = unit * (60_000 // len(unit))
    start = time.perf_counter()
    pii.base_spans(text)
    list(pii.proposals(text))
    assert time.perf_counter() - start < 8


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SF01}/documents.parquet"), keep=400)


@pytest.fixture(scope="module")
def taught(spark):
    """A model of a table with some two hundred base spans of each kind."""
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("text,kind,span", [
    ("write to jane.doe at mail3 dot example dot com today", "email", "jane.doe at mail3 dot example dot com"),
    ("reach jane.doe [at] mail3 [dot] example [dot] com.", "email", "jane.doe [at] mail3 [dot] example [dot] com"),
    ("call (632) 555-5381 now", "phone", "(632) 555-5381"), ("thnd 632.555.5381 onre", "phone", "632.555.5381"),
    ("card 4921.7581.0487.0150 ok", "card", "4921.7581.0487.0150"), ("from 65[.]228[.]206[.]89 thnd", "ip", "65[.]228[.]206[.]89"),
])
def test_method_adds_what_the_patterns_miss(taught, text, kind, span):
    (base, added), = pii.find([text], taught)
    assert not base
    assert [(k, text[a:b]) for a, b, k in added] == [(kind, span)]


@pytest.mark.parametrize("text", ["on 2024-01-15 the", "in 1999-2003 the", "Look at the dot product", "4921758104870151 is order", "isbn 978-3-16-148410-0",
                                  "2019 2020 2021 2022", "License, Version 2.0. 2004", "id 12345678 row", "meet at noon. polka dot dress", "12:30:45.123 time"])
def test_method_leaves_lookalikes_alone(taught, text):
    assert pii.find([text], taught) == [([], [])]


def test_thresholds_hold_out(taught):
    assert set(taught.threshold) == set(pii.KINDS)
    assert all(0.5 <= t <= 1 for t in taught.threshold.values())


def test_model_learns_from_every_example(spark, monkeypatch):
    """``keep`` only says where the sums are taken: nothing is left out above it."""
    from quarry.llm import boosted
    for name in ("fit_binned", "fit_table"):
        monkeypatch.setattr(pii, name, functools.partial(getattr(boosted, name, None) or fit, trees=12), raising=False)
    words = "alpha beta gamma delta omega sigma kappa".split()
    rows = [(i, f"{words[i % 7]} write to {words[i % 5]}{i}@{words[i % 3]}.com or +1 {200 + i} 555 {1000 + 7 * i} {words[i % 4]} 2024-01-{10 + i % 20}")
            for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every, table = pii.train(docs), pii.train(docs, keep=0)
    assert every.trees is not None and table.trees is not None
    for part in ("feature", "cut", "leaf"):
        assert np.array_equal(getattr(every.trees, part), getattr(table.trees, part))
    assert (every.scale, every.threshold) == (table.scale, table.threshold)
    assert set(every.scale) == {"email", "phone"}


def test_overlapping_proposals_compete():
    a, b, c, d = (0, 10, "phone"), (5, 15, "card"), (12, 20, "phone"), (30, 40, "ip")
    assert pii._chosen([(0.9, a), (0.95, b), (0.9, c), (0.7, d)], [(35, 36, "email")]) == [b]
    assert pii._chosen([(0.96, a), (0.95, b), (0.9, c), (0.7, d)], []) == [a, c, d]


def test_pii_odd_rows(spark, model):
    rows = [(1, None, "x"), (None, "a@b.cd and 1.2.3.4", "y"), (2, "", None), (2, "a@b.cd", "z"), (2, "a@b.cd", "z"), (3, "w " * 200_000 + "é a@b.cd", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `spans` string").withColumn("a.b", F.lit(1))
    out = sorted(pii.scan(docs, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["spans"]))
    assert [r["spans"] for r in out] == ["", "", "email:0:6", "email:0:6", f"email:{400_000 + 2}:{400_000 + 8}", "email:0:6,ip:11:18"]
    assert out[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    red = pii.redact(docs, model)
    assert red.columns == docs.columns
    assert sorted((r["text"] or "")[-12:] for r in red.collect()) == sorted(["", "", "[email]", "[email]", "[email] and [ip]"[-12:], "w w é [email]"[-12:]])
    empty = docs.limit(0)
    assert pii.scan(empty, pii.train(empty)).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = fit(x[:2000], y[:2000], np.ones(2000), trees=30, depth=3)
    assert ((sigmoid(t.margin(x[2000:])) > 0.5) == y[2000:]).mean() > 0.95


def test_pii_query_on_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = QUERIES["op11_candidate_pii"](spark, SF001).collect()
    assert len(out) == len(docs)
    for r in out:
        base = plain_base(docs[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


# 12: ranked search

def plain_ranking(docs, items, k=10):
    cut = lambda t: [x for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                           re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
    tf = [(i, collections.Counter(cut(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(cut(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    out = sorted(map(tuple, strata_index.search(strata_index.build(d), i, k).collect()), key=str)
    assert sorted(map(tuple, strata_index.rank(d, i, k).collect()), key=str) == out  # from the items' terms alone
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "日本", "A1", "é"]
    docs = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([1, 3, 9, 30])))) for i in range(150)]
    docs += [(None, "w1 w2 w3"), (7, None), (8, ""), (9, "-- ; !"), (150, docs[3][1]), (150, docs[3][1])]
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(12)] + [(90, None), (91, "nowhere"), (92, "W1 w1, W1")]
    monkeypatch.setattr(strata_index, "SEGMENT", 700)
    monkeypatch.setattr(strata_index, "ITEM_TERMS", 20)
    assert ranked(spark, docs, items) == plain_ranking(docs, items)


def test_equal_scores_go_by_doc_id_across_tasks(spark):
    docs = [(i, "same text here") for i in range(60, 0, -1)] + [(100 + i, "other words altogether") for i in range(80)]
    assert [r[2] for r in ranked(spark, docs, [(1, "same")])] == sorted(range(1, 11), key=lambda i: str((1, i, i)))


def test_strata_hold_every_posting_once(spark, monkeypatch):
    monkeypatch.setattr(strata_index, "SEGMENT", 300)
    docs = [(i, " ".join(f"t{j % (i % 5 + 1)}" for j in range(i % 7))) for i in range(80)]
    index = strata_index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    got = collections.Counter()
    for r in index.strata.collect():
        assert len(set(r["docs"])) == len(r["docs"])
        for p in r["postings"]:
            for at in p["docs"]:
                got[r["docs"][at], p["term"], p["tf"]] += 1
    want = collections.Counter((i, t, n) for i, text in docs for t, n in collections.Counter(text.split()).items())
    assert got == want
    n = {i: len(t.split()) for i, t in docs}
    for r in index.strata.collect():  # one normaliser a stratum
        assert {10 + 90 * n[i] * index.n_docs // index.n_terms for i in r["docs"]} == {r["m"]}


def test_waves_stop_by_bound():
    """Strata whose bound is below the k-th score are not read: what they hold may be broken."""
    best = strata_index._Best(1)
    best.add(np.array([10**9]), pa.array([5]))
    posting = pa.array([[{"term": "a", "tf": 1, "docs": [99]}]], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("docs", pa.list_(pa.int32()))])))
    batch = pa.RecordBatch.from_arrays([pa.array([50]), pa.array([[1]]), posting], ["m", "docs", "postings"])
    strata_index._visit(batch, pa.array(["a"]), [np.array([0])], np.array([3]), [best])
    assert best.doc.to_pylist() == [5]


def test_normalisers_beyond_64_bits():
    got = strata_index.normalisers(np.array([10**9, 1]), 10**10, 10**12)
    assert got.tolist() == [10 + 90 * 10**9 * 10**10 // 10**12, 10 + 90 * 10**10 // 10**12]


def test_search_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, None)], [(1, "a")])


@pytest.mark.parametrize("name", ["op12_strata_search", "op13_divergence_audit"])
def test_queries_against_sql(spark, name):
    equal_to_sql(QUERIES[name](spark, SF01), ORACLE_SQL[name], documents=f"{SF01}/documents.parquet", benchmark=f"{SF01}/benchmark.parquet")


# 13: divergence audit

def test_perfect_hash_is_minimal_and_verified():
    terms = pa.array([f"term{i}é" for i in range(5000)], pa.large_string())
    p = divergence.PerfectHash.of(terms)
    slots = p.slots(terms)
    assert sorted(slots.tolist()) == list(range(5000))
    assert p.terms.take(pa.array(slots)).equals(terms)
    assert (p.slots(pa.array([f"other{i}" for i in range(5000)], pa.large_string())) == -1).all()
    assert divergence.PerfectHash.of(terms.slice(0, 1)).slots(terms.slice(0, 2)).tolist() == [0, -1]


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "term_hash", lambda t: np.array([len(x) for x in t.to_pylist()], np.uint64))
    terms = pa.array(["aa", "bb", "c", "dddd", "eeee"], pa.large_string())
    p = divergence.PerfectHash.of(terms)
    assert p.rest == 4
    assert sorted(p.slots(terms).tolist()) == [0, 1, 2, 3, 4]
    assert p.slots(pa.array(["zz", "q"], pa.large_string())).tolist() == [-1, -1]


def plain_audit(docs, least, top):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    rows = [(lang or "", source or "", cut(t)) for _, t, lang, source in docs]
    df = collections.Counter((la, t) for la, _, ts in rows for t in set(ts))
    kept = collections.defaultdict(list)
    for (la, t), n in df.items():
        if n >= least:
            kept[la].append(t)
    count = collections.Counter((la, s, t) for la, s, ts in rows for t in ts)
    groups = {(la, s) for la, s, _ in rows}
    def share(get, la):
        n, v = sum(get(t) for t in kept[la]), len(kept[la])
        return {t: 1 + (10**9 * (get(t) + 5)) // (n + 5 * v) for t in kept[la]}
    p = {(la, s): share(lambda t: count[la, s, t], la) for la, s in groups}
    q = {la: share(lambda t: sum(count[la, s, t] for l2, s in groups if l2 == la), la) for la, _ in groups}
    out = []
    for la, s in groups:
        pair = [(-sum(abs(p[la, s][t] - p[la, o][t]) for t in kept[la]), o.encode(), o) for l2, o in groups if l2 == la and o != s]
        term = [(q[la][t] - p[la, s][t], t.encode(), t) for t in kept[la] if count[la, s, t] and p[la, s][t] > q[la][t]]
        out += [(la, s, "pair", x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(pair))]
        out += [(la, s, "term", x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(term)[:top])]
    return sorted(out)


@pytest.mark.parametrize("dense,sent,shard,tile", [(1 << 26, 1 << 26, 1 << 14, 64), (200, 1500, 4, 2)])
def test_audit_against_brute_force(spark, monkeypatch, dense, sent, shard, tile):
    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "x1y", "d-e"] + [f"{a}{b}" for a in "pqrs" for b in "tuvw"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 20))), rng.choice(["en", "fr", None, "", "xx"]), rng.choice(["s1", "s2", "s3", "é", None, "s4", "s5"]))
            for i in range(260)]
    docs += [(None, None, "zz", "only"), (1, "", "yy", "a"), (1, "", "yy", "b"), docs[0], docs[0]]
    monkeypatch.setattr(divergence, "DENSE", dense)
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    got = divergence.audit(df, least=12, top=4, shard=shard, sent=sent, tile=tile)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, 12, 4)


def test_pairs_are_named_alike_in_every_shard():
    rows = [{"lang": "en", "part": 0, "a": 0, "b": 0, "source": x, "block": 0, "size": 2, "total": 9, "vocabulary": 2, "counts": c}
            for x, c in (("s1", [1, 8]), ("s2", None), ("s3", [9, 0]))]
    tile = lambda r: sorted(map(tuple, (x.values() for x in divergence._tile(pa.Table.from_pylist(
        r, pa.schema([("lang", pa.string()), ("part", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("source", pa.string()), ("block", pa.int32()),
                      ("size", pa.int32()), ("total", pa.int64()), ("vocabulary", pa.int64()), ("counts", pa.list_(pa.int64()))]))).to_pylist())))
    assert len(tile(rows)) == 3
    assert tile(rows) == tile(rows[::-1]) == tile([rows[1], rows[2], rows[0]])


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_of_large_counts():
    n, v = 4 * 10**14, 10**6
    counts = np.array([0, 1, 3 * 10**11, 10**14, n])
    assert divergence.shares(counts, n, v).tolist() == [1 + (10**9 * (int(c) + 5)) // (n + 5 * v) for c in counts]
