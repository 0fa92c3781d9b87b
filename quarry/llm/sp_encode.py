"""Exact SentencePiece BPE encoding by backtracking, and decoding.

Merge-type BPE has one valid encoding of a text, and a sequence of pieces is it
exactly if each adjacent pair is: re-merging the two pieces' characters
gives the same two pieces back. So a text is encoded from the left: at each
position the longest piece that an Aho-Corasick automaton found there is
tried, then its shorter prefixes, until one is compatible with the piece before
and ends where no dead end is known; where none does, the position's bit is set in
a bitfield of failed positions and the piece before is shortened. Each position
fails once at most.

No piece of such a vocabulary goes on with a space mark after another
character, nor holds a line feed, so both are cuts over which nothing merges;
units between cuts repeat and are kept in a bounded memo. Both properties are
read off the vocabulary, and the text is left whole where one is lacking.

Characters without a piece become byte pieces. Decoding joins the pieces, turns
space marks into spaces, byte pieces into UTF-8 (a U+FFFD for each broken byte) and
drops the one space that encoding puts in front.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to the empty text. Texts are worked on in stretches of about a million
characters, so memory does not grow with a text beyond its own size. Repeated
rows get equal results, extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quarry.llm.common import exact

SPACE = "▁"
MEMO = 400_000
MEMO_CHARS = 48
STRETCH = 1 << 20

#: Error handler of ``bytes.decode``: a U+FFFD for each broken byte, not one for a run of them.
BROKEN = "quarry-each-byte"
codecs.register_error(BROKEN, lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Vocabulary:
    """The pieces of a SentencePiece BPE model and what encoding needs of them."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.piece = [sp.id_to_piece(i) for i in ids]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.unk = sp.unk_id()
        self.spaced = {str(i): "" if sp.is_control(i) else sp.decode([i]) if i == self.unk
                       else self.piece[i].replace(SPACE, " ") for i in ids if i not in self.byte_of}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.chars = {c for p in self.score for c in p}
        whole = [i for i in plain if self.merge(self.piece[i]) == [self.piece[i]]]
        self.length = {i: len(self.piece[i]) for i in whole}
        reached = {self.piece[i]: i for i in whole}
        self.shorter = {i: next((reached[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1)
                        for p, i in reached.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in reached.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        feed = any("\n" in p for p in self.score)
        self.cut_space = not inner
        self.unit = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if feed
                               else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.known = re.compile("([" + re.escape("".join(sorted(self.chars))) + "]+)")
        self.pairs: dict[int, bool] = {}
        self.ids_of = _Memo(self.encode_unit)
        self.text_of = _Memo(self.decode_unit)

    def merge(self, text: str) -> list[str]:
        """The definition: join the adjacent pair whose join has the best score
        (of equals the leftmost), until no join is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        p, q = self.piece[a], self.piece[b]
        known = self.pairs[a << 20 | b] = self.merge(p + q) == [p, q]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        length, shorter, pairs = self.length, self.shorter, self.pairs
        stop = len(text)
        longest = [-1] * stop
        for end, i in self.automaton.iter(text):
            longest[end - length[i] + 1] = i  # ends ascend: the longest comes last
        failed = bytearray((stop >> 3) + 1)
        out: list[int] = []
        pos, before, tok = 0, -1, longest[0]
        while True:
            while tok >= 0:
                end = pos + length[tok]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    fits = pairs.get(before << 20 | tok)
                    if fits or fits is None and self.compatible(before, tok):
                        break
                tok = shorter[tok]
            if tok >= 0:
                out.append(tok)
                if end == stop:
                    return out
                pos, before, tok = end, tok, longest[end]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                tok = out.pop()
                pos -= length[tok]
                before, tok = out[-1] if out else -1, shorter[tok]

    def encode_unit(self, unit: str) -> str:
        """Decimal ids of a unit, joined by commas."""
        if self.chars.issuperset(unit):
            return ",".join(map(str, self.backtrack(unit)))
        out: list[int] = []
        for i, part in enumerate(self.known.split(unit)):
            if i % 2:
                out += self.backtrack(part)
            else:
                for c in part:
                    if self.byte_id:
                        out += [self.byte_id[x] for x in c.encode()]
                    elif not (out and out[-1] == self.unk):
                        out.append(self.unk)
        return ",".join(map(str, out))

    def decode_unit(self, ids: str) -> str:
        """The text of ids joined by commas, space marks as spaces."""
        try:
            return "".join([self.spaced[i] for i in ids.split(",")])
        except KeyError:  # byte pieces
            pass
        out, raw = [], bytearray()
        for i in ids.split(","):
            if i not in self.spaced:
                raw.append(self.byte_of[int(i)])
                continue
            if raw:
                out.append(raw.decode("utf-8", BROKEN))
                raw.clear()
            out.append(self.spaced[i])
        out.append(raw.decode("utf-8", BROKEN))
        return "".join(out)

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text with marks for spaces and one in front, as units, about a
        million characters at a time."""
        if not text:
            return
        s = SPACE + text.replace(" ", SPACE)
        at = 0
        while self.cut_space and len(s) - at > STRETCH:
            cut = s.rfind(SPACE, at + 1, at + STRETCH)
            while cut > at and s[cut - 1] == SPACE:
                cut -= 1
            if cut <= at:
                found = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(s, at + STRETCH)
                if not found:
                    break
                cut = found.start()
            yield self.unit.findall(s[at:cut])
            at = cut
        yield self.unit.findall(s[at:] if at else s)

    def encode(self, text: str) -> list[int]:
        return [int(i) for units in self.stretches(text) for u in units for i in self.ids_of[u].split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_unit(",".join(map(str, ids))) if ids else ""
        first = next((i for i in ids if self.spaced.get(str(i)) != ""), None)  # control pieces are no text
        return text[1:] if first is not None and self.piece[first].startswith(SPACE) else text


class _Memo(dict):
    """A function's results, forgotten when they are too many; long keys are not kept."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key: str) -> str:
        value = self.f(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The model's vocabulary, built once in a worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(model)
    return _loaded[key]


def _digest(v: Vocabulary, text: str) -> tuple[int, str, str]:
    ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
    n, first = 0, True
    for units in v.stretches(text):
        got = list(map(v.ids_of.__getitem__, units))
        joined = ",".join(got)
        n += joined.count(",") + 1
        ids_hash.update(joined.encode() if first else ("," + joined).encode())
        back = "".join(map(v.text_of.__getitem__, got))
        # the first piece opens with the space mark that encoding put in front
        text_hash.update((back[1:] if first else back).encode())
        first = False
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def read_model(path: str) -> bytes:
    """The vocabulary file, read where the job is started; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [_digest(v, t or "") for t in part.column(1).to_pylist()]
                n, i, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(exact(doc_id).alias("doc_id"), exact(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) of each text's tokens."""
    from pyspark.sql import functions as F

    def encode(texts):
        v = vocabulary(model)
        return texts.map(lambda t: v.encode(t or ""))
    return docs.withColumn(ids, F.pandas_udf(encode, "array<int>")(exact(text)))


def decoded(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column ``text`` of the texts that the ids stand for; null ids decode to the empty text."""
    from pyspark.sql import functions as F

    def decode(rows):
        v = vocabulary(model)
        return rows.map(lambda r: v.decode([] if r is None else [int(i) for i in r]))
    return docs.withColumn(text, F.pandas_udf(decode, "string")(exact(ids)))
