"""Operators 3 and 5 and what they share, against brute force."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import dart_minhash, line_dedup, linkage, numtext
from quarry.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut(rows, names, types, rng):
    at = 0
    while at < len(rows):
        end = at + rng.randrange(1, 9)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at:end]], t) for i, t in enumerate(types)], names)
        at = end


def flat(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(40))
def test_streams_do_not_depend_on_batches(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(4), rng.randrange(-6, 25)) for _ in range(rng.randrange(60)))
    by = collections.defaultdict(list)
    for k, n in sorted(set(rows)):
        by[k].append(n)
    got = flat(linkage._first_pairs(cut(rows, ["key", "node"], [pa.int64()] * 2, rng)))
    assert len(got) == len(set(got))
    assert set(got) == {(k, v[i], v[p]) for k, v in by.items() for p in range(1, len(v)) for i in (0, p - 1)}

    sets = {n: np.unique(np.random.default_rng(n % 5).integers(0, 1 << 32, 30).astype(np.uint32))[rng.randrange(3):] for _, n in rows}
    jac = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    hubs = rng.choice([1, 2, 4, 50])
    full = [(k, n, n % 3, sets[n].tobytes()) for k, n in sorted(set(rows))]
    got = flat(linkage._close_pairs(hubs)(cut(full, list("abcd"), [pa.int64()] * 3 + [pa.binary()], rng)))
    assert {g for g in got if g[3]} == {(k, n, n, True) for k, v in by.items() for n in v[hubs:]}
    links = {(k, b, a % 3) for k, v in by.items() for p, b in enumerate(v) for a in v[:min(p, hubs)]
             if a % 3 != b % 3 and jac(a, b) >= linkage.CLOSE}
    assert {(k, b, a % 3) for k, a, b, rest in got if not rest} == links


@pytest.mark.parametrize("seed", range(20))
def test_nodes_of_a_bucket_come_in_any_order(seed, monkeypatch):
    """Spark sorts by key alone; a bucket too large to hold is paired part by part."""
    rng = random.Random(seed)
    rows = sorted(((rng.randrange(5), rng.randrange(-6, 25)) for _ in range(rng.randrange(90))), key=lambda r: r[0])
    by = collections.defaultdict(set)
    for k, n in rows:
        by[k].add(n)
    sort = {k: sorted(v) for k, v in by.items()}
    names = ["key", "node"], [pa.int64()] * 2
    got = flat(linkage._first_pairs(cut(rows, *names, rng)))
    assert sorted(got) == sorted({(k, v[i], v[p]) for k, v in sort.items() for p in range(1, len(v)) for i in (0, p - 1)})
    monkeypatch.setattr(linkage, "HELD", 8)
    got = flat(linkage._first_pairs(cut(rows, *names, rng)))
    assert all({a, b} <= by[k] and a != b for k, a, b in got) and len(got) <= 2 * len(rows)
    for k, v in by.items():
        root = union_find(v, [(a, b) for j, a, b in got if j == k])
        assert len({find(root, n) for n in v}) == 1
        if len(v) == 3:
            assert len({frozenset(x[1:]) for x in got if x[0] == k}) == 3


def test_element_sets_are_sorted_not_hashed(monkeypatch):
    """np.unique hashes integers, which takes ten times as long as sorting them."""
    rng = np.random.default_rng(3)
    row, h = np.sort(rng.integers(0, 40, 900)), rng.integers(0, 300, 900).astype(np.uint64) << np.uint64(32)
    row, h = row[row != 7], h[row != 7]
    want = [sorted(set((h[row == r] >> np.uint64(32)).tolist())) for r in range(41)]
    monkeypatch.setattr(np, "unique", None)
    got = numtext.element_sets(row, h, 41)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got.to_pylist()] == want and want[7] == want[40] == []
    assert numtext.element_sets(row[:0], h[:0], 0).to_pylist() == []


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def union_find(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(edges)
    want = union_find({x for e in edges for x in e}, edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.root for r in linkage.components(df).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert linkage.components(df.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(5000).selectExpr("xxhash64(id) AS node").repartition(3)
    bloom = linkage.bloom_of(df)
    nodes = np.array([r.node for r in df.collect()])
    assert linkage.in_bloom(bloom, nodes).all()
    assert linkage.in_bloom(bloom, np.arange(10_000)).mean() < 0.01
    assert not linkage.bloom_of(df.limit(0)).any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né日🙂", max_size=30)), max_size=12), st.integers(1, 9))
def test_shingles_and_lines(texts, k):
    col = pa.array(texts, pa.string())
    data, offs = numtext.utf8(col)
    texts = [t or "" for t in texts]
    start, end, row = numtext.word_spans(data, offs)
    raw = data.tobytes()
    assert [(int(r), raw[s:e].decode()) for s, e, r in zip(start, end, row, strict=True)] == [
        (i, w) for i, t in enumerate(texts) for w in WORDS.findall(t)]
    ls, le, lr, ln = numtext.line_spans(data, offs)
    assert [(int(r), int(n), raw[s:e].decode()) for s, e, r, n in zip(ls, le, lr, ln, strict=True)] == [
        (i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    idx, h = numtext.char_shingles(numtext.Spans(data), offs[:-1], offs[1:], k)
    want = [(i, t[j: j + k]) for i, t in enumerate(texts) for j in range(max(1, len(t) - k + 1)) if t]
    assert idx.tolist() == [i for i, _ in want]
    names = {}
    assert all(names.setdefault(s, x) == x for (_, s), x in zip(want, h.tolist(), strict=True))
    assert len(set(names.values())) == len(names)
    idx, h, n = numtext.word_shingles(data, offs, k)
    words = [WORDS.findall(t) for t in texts]
    want = [(i, tuple(w[j: j + k])) for i, w in enumerate(words) for j in range(max(1, len(w) - k + 1)) if w]
    assert idx.tolist() == [i for i, _ in want] and n.tolist() == [len(w) for w in words]
    names = {}
    assert all(names.setdefault(s, x) == x for (_, s), x in zip(want, h.tolist(), strict=True))


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    n, trials = 150, 40
    for share in (0.1, 0.4):
        a = rng.uniform(0.2, 9, n)
        b = np.where(rng.random(n) < share, rng.uniform(0.2, 9, n), a)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = []
        for t in range(trials):
            item = numtext.mix(np.arange(n, dtype=np.uint64) + np.uint64(1000 * t + 1))
            sig = dart_minhash.signatures(np.repeat([0, 1], n), np.append(item, item), np.append(a, b), 2)
            got.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(got) - want) < 4 * (want * (1 - want) / (100 * trials)) ** 0.5 + 0.005


def weighted(text):
    w = WORDS.findall(text)
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_no_similar_pair_is_told_apart_by_bitmaps():
    rng = np.random.default_rng(11)
    sets, pairs = [], []
    for size in (1, 2, 5, 7, 31, 32, 33, 100, 500, 5000, 40_000):
        for share in (0.0, 0.3, 0.6, 0.78, 0.8, 0.81, 0.9, 1.0):
            one = rng.integers(0, 1 << 32, size, np.uint32)
            kept = one[rng.random(size) < np.sqrt(share)]
            other = np.append(kept, rng.integers(0, 1 << 32, max(0, int(size * rng.uniform(0.8, 1.2)) - len(kept)), np.uint32))
            pairs.append((len(sets), len(sets) + 1))
            sets += [np.unique(one), np.unique(other)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "elements"])
    (b,) = linkage._bitmaps(iter([rows]))
    sides = [b.select(["n", "bits"]).take(pa.array([p[i] for p in pairs])) for i in (0, 1)]
    ids = [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]
    (out,) = linkage.possible(iter([pa.RecordBatch.from_arrays([*ids, *sides[0].columns, *sides[1].columns], list("abcdef"))]))
    left = set(zip(*(c.to_pylist() for c in out.columns), strict=True))
    sim = {(i, j): len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j]))) for i, j in pairs}
    assert {p for p, x in sim.items() if x >= linkage.CLOSE} <= left
    far = {p for p, x in sim.items() if x < 0.4 and 31 <= len(sets[p[0]]) <= 5000}
    assert far and not far & left


def near_classes(rows):
    """Brute force: smallest id of each class of (id, text) rows."""
    first = {}
    for i, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    sets = [(i, weighted(t)) for t, i in first.items() if weighted(t)]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if (a & b).total() >= 0.8 * (a | b).total():
                links.append((i, j))
    cls = union_find(first.values(), links)
    return {i: cls[first[t or ""]] for i, t in rows}, links


def edited(rng, words, share):
    return " ".join("edit%d" % rng.randrange(10 ** 6) if rng.random() < share else w for w in words)


def near_rows(rng, group=150):
    """Copies, near copies at all distances, a large group of them, odd texts."""
    base = [["w%d" % rng.randrange(3000) for _ in range(rng.randrange(30, 200))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    texts += [edited(rng, b, rng.choice([0.005, 0.01, 0.02, 0.05])) for b in base for _ in range(3)]
    texts += [edited(rng, base[0], rng.uniform(0, 0.06)) for _ in range(group)] + [texts[1]] * 40
    texts += [None, None, "", " \n", "one", "one", "two words", "a b c d e f", "same " * 40, "same " * 41]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    rows = near_rows(rng)
    want, links = near_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS root", "3 AS `a.b`").repartition(4)
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[i].class_id != c for i, c in want.items())
    assert wrong == 0
    size = collections.Counter(want.values())
    for i, c in want.items():
        assert got[i].class_size == size[c] and got[i].kept == (i == c)
    left = dart_minhash.dedup(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_duplicates_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "x"), (3, "x"), (None, None)], "doc_id long, text string")
    got = dart_minhash.near_duplicates(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got if r.doc_id == 3) == 1 and sum(r.kept for r in got) == 3
    assert dart_minhash.dedup(df).count() == 3
    assert dart_minhash.near_duplicates(df.limit(0)).count() == 0 and dart_minhash.dedup(df.limit(0)).count() == 0


def kept_lines(rows):
    lines = [((i is None, i), n, x.strip(" \t\n\v\f\r")) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    sets = {}
    for _, _, x in lines:
        sets.setdefault(x, {x[j: j + 5] for j in range(max(1, len(x) - 4))})
    names = list(sets)
    links = [(a, b) for a in range(len(names)) for b in range(a)
             if len(sets[names[a]] & sets[names[b]]) >= 0.8 * len(sets[names[a]] | sets[names[b]]) - 1e-12]
    root = union_find(range(len(names)), links)
    first = {}
    for i, n, x in lines:
        first.setdefault(root[names.index(x)], (i[1], n))
    return set(first.values())


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join("w%d" % rng.randrange(200) for _ in range(rng.randrange(2, 60))) for _ in range(40)]
    pool += [" ".join(rng.choice(["zq", w]) if rng.random() < 0.04 else w for w in rng.choice(pool[:40]).split()) for _ in range(80)]
    texts = ["\n".join(rng.choice(pool + ["", "  ", "ab", " ab\t"]) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    rows = list(enumerate(texts + [None, "", "\n\n", "é🙂 日本\nab"]))
    want = kept_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS n_lines", "3 AS `a.b`").repartition(4)
    out = line_dedup.dedup_lines(df)
    assert out.columns[:5] == df.columns and len(set(out.columns)) == 7
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        stay = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in want or not x.strip(" \t\n\v\f\r"))
        total = 0 if t is None else sum(bool(x.strip(" \t\n\v\f\r")) for x in t.split("\n"))
        assert (got[i].text, got[i]["n_lines_"], got[i]["n_kept"]) == (stay, total, sum(k[0] == i for k in want))
    left = line_dedup.drop_emptied(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r["n_lines_"] == 0 or r["n_kept"]}


def test_lines_odd_tables(spark):
    df = spark.createDataFrame([(None, "only here\nshared line of text"), (2, "shared line of text"), (2, "shared line of text"),
                                (2, "another one")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_kept) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("2", "another one", 1), ("2", "shared line of text", 1), ("2", "shared line of text", 1), ("None", "only here", 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_with_one_changed_character(spark):
    """Lines of 60 characters of which one inner one differs are alike (0.836 of five-character shingles)."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    other = line[:30] + "#" + line[31:]
    shingles = lambda x: {x[j: j + 5] for j in range(len(x) - 4)}
    assert len(shingles(line) & shingles(other)) >= 0.8 * len(shingles(line) | shingles(other))
    rows = [(1, line), (2, other), (3, line[:20] + "##" + line[22:40] + "##" + line[42:])]
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_lines_of_whole_table_by_five_characters(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    at = sorted((i, n, x.strip(" \t\n\v\f\r")) for i, t in docs for n, x in enumerate((t or "").split("\n")))
    at = [x for x in at if x[2]]
    sets = {x: {x[j: j + 5] for j in range(max(1, len(x) - 4))} for _, _, x in at}
    place = {x: n for n, x in enumerate(sets)}
    names = list(sets)
    links = [(a, b) for a in range(len(names)) for b in range(a)
             if len(sets[names[a]] & sets[names[b]]) >= 0.8 * len(sets[names[a]] | sets[names[b]]) - 1e-12]
    root = union_find(range(len(names)), links)
    first = {}
    for i, _, x in at:
        first.setdefault(root[place[x]], i)
    want = collections.Counter(first.values())
    assert {r.doc_id: r.n_kept for r in QUERIES["op5_line_dedup"](spark, SF001).collect()} == {i: want[i] for i, _ in docs}


def test_band_rows_do_not_depend_on_runs(monkeypatch):
    rng = random.Random(9)
    lines = [" ".join("w%d" % rng.randrange(500) for _ in range(rng.randrange(1, 12))) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)])], ["text"])
    want = flat(line_dedup._band_rows([batch]))
    assert len({n for _, n in want}) == len(set(lines))
    most, whole = [], line_dedup.signatures
    monkeypatch.setattr(line_dedup, "RUN", 7)
    monkeypatch.setattr(line_dedup, "signatures", lambda line, h, n: most.append(n) or whole(line, h, n))
    assert sorted(flat(line_dedup._band_rows([batch]))) == sorted(want)
    assert max(most) == 7 and sum(most) == len(set(lines))
    with pytest.raises(ValueError):  # the number would wrap
        whole(np.zeros(0, np.int64), np.zeros(0, np.uint64), (1 << 20) + 1)


def test_queries_on_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want, _ = near_classes(docs)
    assert {r.doc_id: r.class_id for r in QUERIES["op3_dart_minhash"](spark, SF001).collect()} == want
    stay = kept_lines(docs)
    got = {r.doc_id: r.n_kept for r in QUERIES["op5_line_dedup"](spark, SF001).collect()}
    assert got == {i: sum(k[0] == i for k in stay) for i, _ in docs}


def test_texts_that_lose_no_line_are_not_joined(spark):
    """Of (id, text) rows only those that may lose a line go to the join; the others are counted where they are."""
    from quarry.llm import line_dedup
    odd = "one own line of this text\n \t\n\r\nanother line of it\r\n"
    data = [(1, "a line that two texts have\nfirst text's own words"), (2, "a line that two texts have\nsecond text, other words"),
            (3, odd), (4, None), (5, " \n\t"), (None, "a text whose id is null"), (6, "a line that two texts have"),
            (7, "said twice in one text\nsaid twice in one text"), (8, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    some, rest, _, _ = line_dedup.kept_lines(docs)
    assert sorted(r.doc_id for r in some.collect()) == [2, 6, 7]
    assert rest.columns == docs.columns and rest.count() == 6
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(docs).collect()}
    whole = {1: 2, 3: 2, 4: 0, 5: 0, None: 1, 8: 0}
    assert got == {i: (t, whole[i], whole[i]) for i, t in data if i in whole} | {
        2: ("second text, other words", 2, 1), 6: ("", 1, 0), 7: ("said twice in one text", 2, 1)}
