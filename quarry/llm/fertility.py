"""Quality rules from tokeniser fertility.

A public vocabulary measures how the words of a text fit the languages it was made
for: characters per token, the share of byte-fallback tokens, and the entropy of the
tokens in relation to its largest value for their number. Documents that pass
the base rules set bands for each language (``lang``, or the script of most
letters where it is null) and size (doublings of the number of tokens, as short texts
vary more): the quartiles widened by ``WIDTH`` interquartile ranges, a floor of
``LEAST`` on that range. A document outside any band of its language and size is
rejected; a language and size of fewer than ``ENOUGH`` documents has no band. Bands
come from all documents, by mergeable quantile sketches.

Base rules (words are runs of non-white characters): a document fails with
fewer than ``MIN_WORDS`` words, or if more than 30 % of its words lie in
eight-word windows that occur twice or more in it.

Defined cases: null and wordless texts fail the base rules, their measures are
0. Texts of any length are measured whole, so many words at a time.
Repeated rows get equal results; extra columns are not read. On an empty table
there are no bands and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import exact, materialise
from quarry.llm.numtext import U, WHITE, Spans, expand, line_spans, mix, word_spans
from quarry.llm.terms import text_runs

WINDOW = 8
MIN_WORDS = 20
REPEATED = 30
WIDTH = 3.0
LEAST = {"chars_per_token": 0.02, "byte_share": 0.005, "entropy": 0.01}
ENOUGH = 30
MEASURES = tuple(LEAST)
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WORDS = 1 << 18
MEMO, MEMO_CHARS = 1 << 18, 40


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a block."""
    rows = len(offs) - 1
    start, end, row = word_spans(data, offs)
    words = np.bincount(row, minlength=rows)
    spans = Spans(data)
    by = lambda at, of: np.bincount(of, at, rows).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbol = np.flatnonzero(SYMBOLS[data])

    h = spans.hash(start, end)
    count = np.maximum(words - WINDOW + 1, 0)
    idx, pos = expand(count)
    head = (np.cumsum(words) - words)[idx] + pos
    window = np.zeros(len(idx), U)
    for j in range(WINDOW):
        window = mix(window * U(0x9E3779B97F4A7C15) + h[head + j]) if len(idx) else window
    twice = _repeated(idx, window)
    edge = np.zeros(len(start) + WINDOW + 1, np.int64)
    np.add.at(edge, head[twice], 1)
    np.add.at(edge, head[twice] + WINDOW, -1)
    covered = np.cumsum(edge)[: len(start)] > 0

    ls, le, lrow, _ = line_spans(data, offs)
    ink = np.searchsorted(start, le) > np.searchsorted(start, ls)  # a word starts in it
    key = mix(spans.hash(ls[ink], le[ink]) ^ mix(lrow[ink].astype(U)))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return {"n_words": words.astype(np.int64), "word_chars": by(chars[end] - chars[start], row),
            "n_symbols": np.bincount(np.searchsorted(offs, symbol, "right") - 1, minlength=rows).astype(np.int64),
            "n_dup_lines": by(later, lrow[ink]), "n_repeat_words": by(covered, row)}


def _repeated(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries share their (row, hash) with another."""
    key = mix(h ^ mix(row.astype(U)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out


class Tokeniser:
    """Pieces of words by a vocabulary, with a memo of the words met so far."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.size)])
        self.known: dict[str, list[int]] = {}

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has)."""
        if len(self.known) > MEMO:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        long = {}  # not kept: words of any length come once at most
        for w, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            (self.known if len(w) <= MEMO_CHARS else long)[w] = ids
        ids = [self.known[w] if w in self.known else long[w] for w in words]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count


_loaded: dict[bytes, Tokeniser] = {}


def tokeniser(model: bytes) -> Tokeniser:
    """The vocabulary's tokeniser, built once in a worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded[key] = Tokeniser(model)
    return _loaded[key]


def token_measures(data: np.ndarray, offs: np.ndarray, t: Tokeniser) -> dict[str, np.ndarray]:
    """Of each row of a block: tokens of its words, characters of words per token,
    byte-fallback share, and token entropy over its largest value."""
    rows = len(offs) - 1
    start, end, row = word_spans(data, offs)
    n, byte = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(start), WORDS):  # a text of any length, so many words at once
        s, e, r = start[at: at + WORDS], end[at: at + WORDS], row[at: at + WORDS]
        part = data[s[0]: e[-1]]
        body = part[~WHITE[part]]
        words = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(np.append(0, np.cumsum(e - s)).astype(np.int64)),
                                                                  pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        ids, count = t.pieces(words.dictionary.to_pylist())
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, times = np.unique(r * len(count) + code, return_counts=True)
        r, code = pair // len(count), pair % len(count)
        n += np.bincount(r, times * count[code], rows).astype(np.int64)
        idx, pos = expand(count[code])
        token = ids[(np.cumsum(count) - count)[code][idx] + pos]
        weight, of = times[idx], r[idx]
        byte += np.bincount(of[t.is_byte[token]], weight[t.is_byte[token]], rows).astype(np.int64)
        k, back = np.unique(of * t.size + token, return_inverse=True)
        keys.append(k)
        sums.append(np.bincount(back, weight, len(k)).astype(np.int64))
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(back, np.concatenate(sums), len(k))
    of = k // t.size
    total = np.maximum(n, 1)
    # sum of -c/n log(c/n) is log n less the mean of log c
    entropy = np.where(n > 1, np.log2(total) - np.bincount(of, c * np.log2(np.maximum(c, 1)), rows) / total, 0.0)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    in_words = np.bincount(row, chars[end] - chars[start], rows)
    return {"n_tokens": n, "chars_per_token": in_words / total, "byte_share": byte / total,
            "entropy": np.where(n > 1, entropy / np.log2(np.maximum(np.minimum(n, t.size), 2)), 0.0)}


SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}",
           "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}",
           "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}", "thai": r"\p{IsThai}"}


def script(text: Column) -> Column:
    """The script of most letters, "other" where none of ``SCRIPTS`` occurs."""
    n = F.array(*[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(s).alias("s")) for s, p in SCRIPTS.items()])
    best = F.array_max(n)
    return F.when(best["n"] > 0, best["s"]).otherwise(F.lit("other"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text",
             lang: str | None = "lang") -> DataFrame:
    """doc_id, group, the base counts and base_failed, and the token measures of each row."""
    group = script(F.coalesce(exact(text), F.lit("")))
    if lang:
        group = F.coalesce(exact(lang), group)
    src = docs.select(exact(doc_id).alias("doc_id"), group.alias("group"), exact(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_runs(b.column(2)):
                got = base_counts(data, offs) | token_measures(data, offs, tokeniser(model))
                cols = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(got[c]) for c in (*COUNTS, "n_tokens", *MEASURES))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "group", *COUNTS, "n_tokens", *MEASURES])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, group string, {', '.join(f'{c} long' for c in COUNTS)}, "
                               f"n_tokens long, {', '.join(f'{m} double' for m in MEASURES)}"
                          ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                                       | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def size_class() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def bands(measured: DataFrame) -> DataFrame:
    """(group, size, <measure>_low, <measure>_high) from the rows that pass the base rules."""
    q = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias(m) for m in MEASURES]
    at = (measured.filter("not base_failed").groupBy("group", size_class().alias("size")).agg(*q, F.count(F.lit(1)).alias("n"))
          .filter(F.col("n") >= ENOUGH))
    cols = ["group", "size"]
    for m, least in LEAST.items():
        low, high = F.col(m)[0], F.col(m)[1]
        reach = WIDTH * F.greatest(high - low, F.lit(least))
        cols += [(low - reach).alias(f"{m}_low"), (high + reach).alias(f"{m}_high")]
    return at.select(*cols)


def judge(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text",
          lang: str | None = "lang") -> DataFrame:
    """doc_id, base counts, base_failed, kept, and the measures, of every row."""
    known = materialise(measures(docs, model, doc_id, text, lang), "fertility")
    # written first, so that their size is known: a few rows a language are broadcast, and no document is shuffled
    limits = materialise(bands(known), "bands")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return known.withColumn("size", size_class()).join(limits, ["group", "size"], "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.col("group").alias("lang_or_script"), "n_tokens", *MEASURES)
