"""Operators 2, 4, 6, 8: text by text, against libraries and plain versions."""
import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF001, SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import fertility, html_extract, numtext, quality_cnn, sp_encode
from quarry.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sp_encode.read_model(PATH)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, `a.b` int, text_a string, node int"


def doc_rows(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", 0, "k", 1, "x", 2) for i, t in enumerate(texts)], DOC)


ODD = [None, "", " ", "\n", "a", "  a  b ", "a\n\nb\n", "▁x ▁▁y", "日本🙂 \x00\t", "<s> <unk> <0x0A>", "é" * 50, "word " * 300]


# 2: SentencePiece

def same_as_library(text):
    ids = SP.encode(text or "")
    v = sp_encode.vocabulary(MODEL)
    assert v.encode(text or "") == ids
    assert v.decode(ids) == SP.decode(ids)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(
        SP.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abeinrst  \n▁.,é日🙂<0x>\t'A1"), st.characters(codec="utf-8")), max_size=80))
def test_encoding_is_the_librarys(text):
    same_as_library(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 259)), max_size=30))
def test_decoding_is_the_librarys(ids):
    assert sp_encode.vocabulary(MODEL).decode(ids) == SP.decode(ids)


@pytest.mark.parametrize("ids", [[1, 2935], [2, 1, 2935, 2935], [1], [0, 2935], [1, 40, 2935], [1, SP.piece_to_id("▁"), 2935]])
def test_decoding_after_control_pieces(ids):
    assert sp_encode.vocabulary(MODEL).decode(ids) == SP.decode(ids)


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(sp_encode, "STRETCH", 50)
    v = sp_encode.vocabulary(MODEL)
    for text in ("the thing   is " * 40, "x" * 500, " " * 300, ("a" * 70 + " ") * 9 + "\n b"):
        assert sp_encode._digest(v, text) == same_as_library(text)
        assert len(list(v.stretches(text))) > 1 or " " not in text.strip(" ")


def test_encode_query(spark):
    got = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == same_as_library(d.text)


def test_encode_odd_rows(spark):
    df = doc_rows(spark, ODD + ODD)
    got = sp_encode.encode_decode(df, MODEL).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == [same_as_library(t) for t in ODD + ODD]
    assert sp_encode.encode_decode(df.limit(0), MODEL).count() == 0
    back = sp_encode.decoded(sp_encode.token_ids(df, MODEL), MODEL).select("doc_id", "text", "decoded", "node").collect()
    assert all(r.decoded == SP.decode(SP.encode(r.text or "")) and r.node == 2 for r in back)


# 4: HTML extraction

@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<b>q", "q"), ("a &amp; &lt;b&gt; &eacute;", "a & <b> é"),
    ("<nav>m</nav><article><h1>T</h1><p>One <b>t</b>wo<br>three</article><footer>f</footer>", "T One two three"),
    ("<article>a<div class='cookie-notice'>n</div><form>f<input></form><section id=comments><article>c</article></section></article>", "a"),
    ("<script>if (a < b) '</p>'</script><style>p{}</style><!-- x --><main>y</main>z", "y"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<header>site</header><article><header><h1>t</h1></header> x \n y </article>", "t x y"),
    ("<div hidden>h</div><p style='display: none'>n</p><div role=navigation>r</div>1 < 2", "1 < 2"),
    ("<article>a</article><article>b</article>", "a b"), ("<div>x</div><div id=comments><article>c</article></div>", "x"),
    ("<div class=ad>x<article>in", "in"), ("<form>f<main>m</main></form>", "m"),
    ("<div class='page has-sidebar'><div id=sidebar><article>t</article></div><article>a</article></div>", "a"), ("</p></div>x<", "x<"), ("<div class=shadow>s</div>", "s"),
])
def test_page_text(page, text):
    assert html_extract.text_of(html_extract.parse(page), frozenset()) == text


def test_templates_go_and_articles_stay(spark):
    box = "<div class='zz'><p>Join our club today</p></div>"
    pages = [(i, "http://h.org/a", f"<article><p>Text number {i} here</p>{box}<p>Same words</p></article>") for i in range(8)]
    pages += [(100 + i, "http://copy.org/a", "<article><div><p>Stored many times</p></div></article>") for i in range(8)]
    pages += [(200, None, None), (201, "x", ""), (202, "http://h.org/a", f"<body>{box}<p>alone</p></body>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS templates")
    got = {r.page_id: r.text for r in html_extract.extract(df.unionByName(df.filter("page_id = 3"))).collect()}
    assert all(got[i] == f"Text number {i} here Same words" for i in range(8))
    assert all(got[100 + i] == "Stored many times" for i in range(8))
    assert got[200] == got[201] == "" and got[202] == "alone"
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<a ", "<div></x>", '<a "', "<div>", "<p><select><b><h1>", "<b><li>", "<article>", "<!", "<a<", "<a b=\" '>"])
def test_malformed_pages_take_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        html_extract.text_of(html_extract.parse(unit * n), frozenset())
        return time.process_time() - began
    seconds(100)
    assert seconds(40_000) < 16 * seconds(5_000) + 0.5  # eight times the page; quadratic time would be 64 times


@pytest.mark.parametrize("page, text", [
    ('<p title="x>y">a</p><p title="z>b</p>c', "a b c"),  # the quote of z never closes: its tag ends at the next ">"
    ("a<b", "a<b"), ("a<b <!-- c", "a<b"), ("a<!-- c", "a"), ("<p>a</q></p>b", "a b"), ("<b><p>a<h1>b</b>c", "a b c"),
])
def test_broken_markup(page, text):
    assert html_extract.text_of(html_extract.parse(page), frozenset()) == text


def test_templates_of_sections_without_articles(spark):
    """Pages without article or main element, and no telling names: recurrence alone decides.
    A notice of the small section is on under a tenth of the host's pages."""
    every, some = "<div class=q1><p>All rights kept</p></div>", "<div class=q2><p>Only news readers see this</p></div>"
    pages = [(i, f"http://big.org/wiki/{i}", f"<body>{every}<div><p>Entry {i} of many</p></div></body>") for i in range(80)]
    pages += [(100 + i, f"http://big.org/news/{i}", f"<body>{every}{some}<div><p>Item {i} of few</p></div></body>") for i in range(6)]
    pages += [(200, "http://big.org/wiki/x", f"<body>{some}<p>quotes it</p></body>"), (201, "http://big.org/x", f"<body>{every}<p>top</p></body>"),
              (202, "http://other.org/news/x", f"<body>{some}<p>elsewhere</p></body>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS section", "2 AS of_host", "3 AS h")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert all(got[i] == f"Entry {i} of many" for i in range(80))
    assert all(got[100 + i] == f"Item {i} of few" for i in range(6))
    assert got[200] == "Only news readers see this quotes it" and got[201] == "top" and got[202] == "Only news readers see this elsewhere"


def test_templates_against_brute_force(spark):
    df = spark.read.parquet(f"{SF01.replace('sf0.01', 'sf0.1')}/pages.parquet")  # sf0.01 has no host with templates
    subtrees, pages = collections.defaultdict(set), collections.defaultdict(set)
    for p in df.collect():
        rest = (p.url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^/?#]*([^?#]*)", rest)[1].split("/")
        root = html_extract.parse(p.html)
        found = {e.digest for e in html_extract.digest(root)}
        for place in {(host, None), (host, path[1] if len(path) > 2 and path[1] else None)}:
            pages[place].add(root.digest)
            for d in found:
                subtrees[place, d].add(root.digest)
    want = {(place, d) for (place, d), on in subtrees.items() if len(on) >= 5 and len(on) * 10 >= len(pages[place])}
    got = {((r.host, r.section), d) for r in html_extract.templates(df).collect() for d in r.templates}
    assert got == want and any(place[1] for place, _ in got)


def test_extract_query_matches_marked_up_articles(spark):
    got = {r.page_id: r for r in QUERIES["op4_html_extract"](spark, SF01).collect()}
    pages = spark.read.parquet(f"{SF01}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


# 6: fertility

def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in SP.encode(w)]
    if not ids:
        return 0, 0.0, 0.0, 0.0
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    entropy = -(p * np.log2(p)).sum() / np.log2(len(ids)) if len(ids) > 1 else 0.0
    return len(ids), sum(map(len, words)) / len(ids), sum(SP.is_byte(i) for i in ids) / len(ids), abs(entropy)


def test_fertility_query(spark):
    rows = QUERIES["op6_fertility"](spark, SF01).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    bands = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        n, *rest = plain_base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
        assert (r.n_tokens, r.chars_per_token, r.byte_share, r.entropy) == pytest.approx(plain_measures(docs[r.doc_id].text))
        if not r.base_failed:
            for m in fertility.MEASURES:
                bands[r.lang_or_script, int(math.log2(r.n_tokens))][m].append(r[m])
    for r in rows:
        kept = not r.base_failed
        for m, least in fertility.LEAST.items():
            v = np.sort(bands[r.lang_or_script, int(math.log2(max(r.n_tokens, 1)))][m])
            if len(v) < fertility.ENOUGH:
                continue
            low, high = (v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.75))
            reach = fertility.WIDTH * max(high - low, least)
            kept &= low - reach <= r[m] <= high + reach
        assert r.kept == kept, r
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall())
    clean = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_fertility_odd_rows(spark):
    df = doc_rows(spark, ODD + ["日本語の文章です。" * 30])
    got = {r.doc_id: r for r in fertility.judge(df, MODEL).collect()}
    for i, t in enumerate(ODD):
        assert got[i][1:6] == plain_base(t)
    scripts = {r.doc_id: r.lang_or_script for r in fertility.judge(df, MODEL, lang=None).collect()}
    assert scripts[len(ODD)] in ("han", "kana") and scripts[4] == "latin" and scripts[0] == "other"
    assert fertility.judge(df.limit(0), MODEL).count() == 0


def test_texts_are_measured_in_any_cut(monkeypatch):
    texts = ["the cat sat on " * 100, "", "日本語\tthe " * 40, "x", "  \n", "the cat é🙂 \u200b"]
    data, offs = numtext.utf8(pa.array(texts))
    for most in (3, 1 << 18):
        monkeypatch.setattr(fertility, "WORDS", most)
        got = fertility.token_measures(data, offs, fertility.tokeniser(MODEL))
        for i, t in enumerate(texts):
            assert [got[m][i] for m in ("n_tokens", *fertility.MEASURES)] == pytest.approx(plain_measures(t))


def test_fertility_rejects_what_does_not_fit(spark):
    """Texts under a wrong language, mojibake and shuffled characters go; the clean ones they were made of stay."""
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    clean = {r.doc_id: r for r in QUERIES["op6_fertility"](spark, "/root/testdata/sf0.1").collect() if r.kept and r.n_tokens > 600}
    of = collections.defaultdict(list)
    for r in docs.filter(docs.doc_id.isin([*clean][:400])).collect():
        of[r.lang].append(r)
    bad = [(10**6 + i, t, lang, "s", 0) for i, (t, lang) in enumerate(
        [(r.text, "en") for r in of["es"][:20] + of["fr"][:20]] + [(r.text, "fr") for r in of["en"][:20]]
        + [("".join(rng.sample(r.text, len(r.text))), "en") for r in of["en"][20:40]]
        + [(r.text.encode().decode("latin1"), "fr") for r in of["fr"][:20]])]
    planted = spark.createDataFrame(bad, docs.schema)
    rows = fertility.judge(docs.unionByName(planted), MODEL).collect()
    sound = [r for r in rows if r.doc_id >= 10**6 and not r.base_failed]
    assert len(sound) > 90 and sum(not r.kept for r in sound) >= 0.9 * len(sound)
    still = [r for r in rows if r.doc_id in clean]
    assert sum(r.kept for r in still) >= 0.99 * len(still)


# 8: byte network

def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(1, 256, (4, quality_cnn.CHUNK)).astype(np.uint8)
    row, y = np.array([0, 0, 1, 1]), np.array([1.0, 0.0])

    def loss():
        h = net.pooled(x)
        z = net.logit(np.maximum.reduceat(h, [0, 2]), np.add.reduceat(h, [0, 2]) / 2)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grad = net.gradients(x, row, y)
    for k, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-6), k


def plain_score(net, text):
    """The network written out: every window of every chunk of the whole text, by loops."""
    data, h = (text or "").encode(), []
    for start in range(0, max(1, len(data) - quality_cnn.OVERLAP), quality_cnn.CHUNK - quality_cnn.OVERLAP):
        chunk = data[start: start + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
        places = range(0, quality_cnn.CHUNK - quality_cnn.KERNEL + 1, quality_cnn.STRIDE)
        seen = [np.concatenate([net.p["embed"][c] for c in chunk[i: i + quality_cnn.KERNEL]]) for i in places]
        h.append([max(0.0, max(float(w @ net.p["filter"][:, f]) + net.p["bias"][f] for w in seen)) for f in range(quality_cnn.FILTERS)])
    x = [max(c) for c in zip(*h)] + [sum(c) / len(h) for c in zip(*h)]
    z = sum(a * b for a, b in zip(x, net.p["out"])) + net.p["base"][0] + net.shift
    return 1 / (1 + math.exp(-z))


def test_scores_against_the_network_written_out(spark):
    rng, net = random.Random(4), quality_cnn.Network(seed=3)
    net.p["bias"] += np.linspace(-0.3, 0.3, quality_cnn.FILTERS).astype(np.float32)
    net.shift = 0.7
    texts = [None, "", "a", "é" * 300, *("".join(rng.choice("abcdefgh .\n日é") for _ in range(n)) for n in (511, 960, 2000))]
    got = {r.doc_id: r.score for r in quality_cnn.score(doc_rows(spark, texts), net).collect()}
    assert got == pytest.approx({i: plain_score(net, t) for i, t in enumerate(texts)}, abs=1e-5)


def test_training_takes_whole_texts_within_its_bounds(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in [100, 3000, 9000, 400, 12000, 50, 700, 100_000]]
    df = doc_rows(spark, texts * 4)
    df = df.unionByName(df.filter("doc_id < 4")).unionByName(df.filter("doc_id = 1").withColumn("text", F.lit("another text")))
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(32)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_cnn.Network, "fit", lambda self, chunks, row, label: seen.append((chunks.copy(), row.copy(), label.copy())))
    monkeypatch.setattr(quality_cnn, "ROW_CHUNKS", 30)
    for bound in (1000, 60):
        monkeypatch.setattr(quality_cnn, "SAMPLE_CHUNKS", bound)
        quality_cnn.train(df, labels)
        chunks, row, label = seen.pop()
        counts = np.bincount(row)
        assert len(label) == len(counts) and 0 < len(chunks) <= bound and counts.max() <= 30
        whole = {len(quality_cnn.chunk_starts(np.array([len(t.encode())]))[0]) for t in texts} | {1}
        assert set(counts) <= whole
        if bound == 1000:
            assert len(label) == sum(zlib.crc32(str(i).encode()) % 4 != 2 and i % 8 != 7 for i in range(32))


def test_parts_of_a_batch_add_up(monkeypatch):
    rng = np.random.default_rng(6)
    row = np.sort(np.append(rng.integers(0, 20, 60), np.arange(20)))
    chunks, label = rng.integers(0, 256, (80, quality_cnn.CHUNK)).astype(np.uint8), (np.arange(20) % 2).astype(np.float32)
    monkeypatch.setattr(quality_cnn, "EPOCHS", 1)
    nets = []
    for step in (1 << 20, 8):
        monkeypatch.setattr(quality_cnn, "STEP_CHUNKS", step)
        net = quality_cnn.Network()
        net.fit(chunks, row, label)
        nets.append(net)
    assert all(np.allclose(nets[0].p[k], nets[1].p[k], atol=2e-3) for k in ("filter", "out", "base", "bias"))


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        row, start = quality_cnn.chunk_starts(np.array([n]))
        covered = np.zeros(max(n, 1), bool)
        for s in start:
            covered[s: s + quality_cnn.CHUNK] = True
        assert covered.all() and (len(start) == 1 or start[-1] < n)


def test_quality_query(spark):
    sf = SF01.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_cnn.train(docs, labels)
    rows = quality_cnn.score(docs, net).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out]
    clean = [r for r in test if r.quality == 1]
    assert sum(r.predicted == r.quality for r in test) >= 0.96 * len(test)
    assert sum(r.predicted for r in clean) >= 0.98 * len(clean)


def test_quality_odd_rows(spark):
    df = doc_rows(spark, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 0), (None, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_cnn.score(df, quality_cnn.train(df, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    n = sum(zlib.crc32(i) % 4 != 2 for i in (b"4", b"5"))
    assert {r.score for r in quality_cnn.score(df, quality_cnn.train(df, one)).collect()} == {(n + 1) / (n + 2)}
    both = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))], "doc_id long, quality int")
    net = quality_cnn.train(df, both)
    assert quality_cnn.score(df, net).count() == len(ODD)
    kept = quality_cnn.filter_quality(df, net)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_cnn.score(df, net).collect() if r.predicted}
    assert quality_cnn.score(df.limit(0), net).count() == 0
    assert quality_cnn.train(df.limit(0), both).constant is not None
