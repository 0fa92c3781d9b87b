"""Personal data by candidate gradient boosting.

Base spans (``email``, ``ip``, ``card``, ``phone``) are found by pattern and check and always
reported. Beyond them, high-recall generators propose overlapping spans: anything around
an @, words around "at" and "dot", and every window of the groups of a chain of
digits that could be a card, a number to call or an address. Boosted trees judge
each proposal by its format (digits, groups, separators, checksums) and its
context (neighbouring characters, words before it); their margins are calibrated
for each kind, and of the proposals above the kind's threshold the likeliest are
taken that overlap nothing taken before.

The trees learn from the corpus itself. Positives are base spans in their places,
rewritten into the ways people write them (``variants``: "at" and "dot" in words or
brackets, spaces, other separators, no country code, a port). Negatives are proposals
that overlap no base span, base matches that fail their check, and base spans'
places with what only looks alike (``decoys``: failing checksums, dates, versions,
amounts, prose). Every distinct example of every text is learnt from: places are shuffled
once, their examples' features stay in blocks of the shared folder, and Spark tasks
sum over them whatever the trees, their quantiles and the calibration take. A third of the
examples, by place, is held out of the trees for the calibration (Platt) and the thresholds:
the least probability, a half at least, at which the held-out precision, smoothed, is
``PRECISION``. Held-out margins are counted in steps of 1 / ``STEPS``.

Every text is scanned whole, in time linear in its length: patterns are possessive, or
bounded windows around their anchors.

Defined cases: null and empty texts have no spans. Where a kind has under
``ENOUGH`` base spans in the corpus, nothing is added for it. Rows of equal text get
equal spans; null doc_ids are allowed. Extra columns are not read by ``scan`` and
kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.boosted import (BLOCK, Trees, binned, block, cuts_of, fit_binned, fit_table, sigmoid, start_of,
                                unpacked)
from quarry.llm.common import discard, exact, free_name, materialise

KINDS = ("email", "ip", "card", "phone")
KEEP = 1 << 16
RUN = 8192
STEPS = 1024
ENOUGH = 20
PRECISION = 0.98
AROUND = 40

Span = tuple[int, int, str]  # start, end, kind

# fixed values: the patterns of the base kinds
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]+")
#: A text that matches nothing of this holds no span of any kind.
_ANY = r"[0-9@]|(?i:\bdot\b|\(dot\)|\[dot\])"


def digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def luhn(d: str) -> bool:
    total = sum(int(c) for c in d[-1::-2]) + sum((2 * int(c)) // 10 + (2 * int(c)) % 10 for c in d[-2::-2])
    return total % 10 == 0


def _byte_parts(s: str) -> bool:
    """Whether every run of digits is at most 255."""
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in _DIGITS.findall(s)))


def base_matches(text: str) -> list[tuple[Span, bool]]:
    """Every match of the base patterns, and whether it passes its check."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        reach = 64  # how far the local part goes back, within what no match has taken
        while True:
            left = text[max(free, at - reach): at]
            run = len(left) - len(left.rstrip(_LOCAL))
            if run < len(left) or at - reach <= free:
                break
            reach *= 4
        m = _DOMAIN.match(text, at + 1) if run else None
        if m:
            out.append(((at - run, m.end(), "email"), True))
            free = m.end()
        at = text.find("@", at + 1)
    out += [((m.start(), m.end(), "ip"), _byte_parts(m.group())) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        n = len(d := digits(m.group()))
        if n >= 7:  # shorter ones are no card in any way
            out.append(((m.start(), m.end(), "card"), 14 <= n <= 19 and luhn(d)))
    out += [((m.start(), m.end(), "phone"), 10 <= len(digits(m.group())) <= 15) for m in _PHONE.finditer(text)]
    return out


def base_spans(text: str) -> list[Span]:
    return sorted((s for s, ok in base_matches(text) if ok), key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- proposals
_LEFT = re.compile(r"[^\s@<>()\[\]{},;:\"']{1,64}[ \[({<]{0,2}$")
_RIGHT = re.compile(r"[ \])}>]{0,2}[^\s@<>()\[\]{},;:\"']{1,253}(?:[ ]?[\[({ ]\.[\])} ][ ]?[A-Za-z]{2,24}(?![A-Za-z]))?")
_AT_WORD = re.compile(r"(?<=[^\s@])(?: |\s?[\[({<]\s?)(?:at|AT|At)(?: |\s?[\])}>]\s?)(?=[A-Za-z0-9])")
_DOT_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| (?:dot|DOT|Dot) |\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?)[A-Za-z0-9-]{1,63}){1,5}")
_CHAIN = re.compile(r"(?:\+\s?)?\(?[0-9]++(?:[ .()/\[\]:\u00a0\u2009_-]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")


def _plausible(s: str) -> list[str]:
    """The kinds a window of digit groups might be."""
    n, g = sum(c.isdigit() for c in s), len(_GROUP.findall(s))
    kinds = ["card"] if 13 <= n <= 19 else []
    if 7 <= n <= 15:
        kinds.append("phone")
    if 4 <= g <= 5 and n <= 17 and (":" not in s or g == 5) and any(c in s for c in ".[") and all(len(x) <= 3 for x in _GROUP.findall(s)[:4]):
        kinds.append("ip")
    return kinds


def proposals(text: str) -> list[Span]:
    """High-recall spans of any kind; they overlap freely."""
    out = []
    at = text.find("@")
    while at >= 0:
        m = _LEFT.search(text[max(0, at - 66): at])
        r = _RIGHT.match(text, at + 1)
        if m and r:
            end = at + 1 + len(r.group().rstrip(".!?")) if not r.group().endswith(tuple(")]}")) else r.end()
            out.append((at - len(m.group()), end, "email"))
        at = text.find("@", at + 1)
    if "dot" in text or "DOT" in text or "Dot" in text or "[.]" in text or "(.)" in text or "[at]" in text or "(at)" in text:
        for m in _AT_WORD.finditer(text):
            left = re.search(r"[A-Za-z0-9._%+-]{1,64}(?: (?:dot|DOT|Dot) [A-Za-z0-9_%+-]{1,64})?$", text[max(0, m.start() - 132): m.start()])
            r = _DOT_HOST.match(text, m.end())
            if left and r:
                out.append((m.start() - len(left.group()), r.end(), "email"))
                short = left.group().split(" ")[-1]
                if short != left.group():
                    out.append((m.start() - len(short), r.end(), "email"))
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(x.start(), x.end()) for x in _GROUP.finditer(text, m.start(), m.end())]
        size = np.cumsum([0] + [b - a for a, b in groups])
        for i, (lo, _) in enumerate(groups):
            start = lo
            while start > m.start() and start > lo - 3 and text[start - 1] in "+(" :  # a sign or a bracket opens the number
                start -= 1
            if i == 0:
                start = m.start()
            # no window holds over 19 digits, so a group begins a bounded number of them
            for j in range(i, min(len(groups), i + 19)):
                n = size[j + 1] - size[i]
                if n > 19:
                    break
                if n < 4:
                    continue
                out += [(start, groups[j][1], k) for k in _plausible(text[start: groups[j][1]])]
    return out


# ---------------------------------------------------------------- features
# fixed values: words before a span that tell what it is, or is not
_SAY = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "from", "client", "gateway", "dns"),
    "card": ("card", "visa", "master", "amex", "payment", "tarjeta", "carte", "karte", "credit", "debit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "dial", "handy", "appel"),
    "not": ("version", "isbn", "issn", "doi", "order", "invoice", "no.", "id", "ref", "page", "section", "chapter", "date", "build", "sku", "serial", "volume", "vol"),
}
_TLDS = frozenset("com org net edu gov io co uk de fr es it eu info biz us ca ch at nl be ru jp cn in br au me dev app".split())
_SEPS = " .-/()[]:\u00a0\u2009_"


def features(left: str, span: str, right: str, kind: str) -> list[float]:
    """Format of a span and its context of at most AROUND characters to either side."""
    groups = [len(g) for g in _GROUP.findall(span)]
    d = digits(span)
    before, after = left[-1:], right[:1]
    low = left.lower()
    tail = re.search(r"([a-z0-9-]*)[\])}>]*$", span.lower()).group(1)
    letters = sum(c.isalpha() for c in span)
    sign = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;!?)]}\"'" else 5
    year = re.match(r"\D*(?:19|20)[0-9]{2}(?![0-9])", span) is not None
    # digits on the other side of one or two separators: the span may be a part of a longer run
    touch_l = bool(re.search(r"[0-9][ .()/\[\]:_\u00a0\u2009-]{1,2}$", left))
    touch_r = bool(re.match(r"[ .()/\[\]:_\u00a0\u2009-]{1,2}[0-9]", right))
    glue_l = bool(re.search(r"[0-9][.\-/:_]$", left))
    glue_r = bool(re.match(r"[.\-/:_][0-9]", right))
    return [
        *[float(kind == k) for k in KINDS], len(span), len(d), len(groups), *[groups[i] if i < len(groups) else 0 for i in range(6)],
        max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, *[span.count(s) for s in _SEPS],
        len({s for s in _SEPS if s in span}), float(span.startswith("+")), float(d.startswith("00")), float(d.startswith("0")),
        float(bool(d) and luhn(d)), float(bool(groups) and _byte_parts(re.sub(r":[0-9]+$", "", span))), int(d[:1] or -1), int(d[:2] or -1), len(set(d)), float(year),
        float(bool(re.fullmatch(r"\D*[0-9]{1,4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,4}\D*", span))),
        sign(before), sign(after), float(touch_l), float(touch_r), float(glue_l), float(glue_r), float(before in "$€£#%"  and before != ""),
        float(any(w in low for w in _SAY[kind])), float(any(w in low for w in _SAY["not"])),
        letters, span.count("@"), float(bool(re.search(r"(?i)[ \[({<]at[ \])}>]", span))), float(bool(re.search(r"(?i)[\[({<]", span))),
        len(re.findall(r"(?i)[ \[({<]dot[ \])}>]|\.", span)), len(tail), float(tail.isalpha()), float(tail in _TLDS),
        float(any(c.isdigit() for c in span.split("@")[0])), len(re.split(r"(?i)@|[ \[({<]at[ \])}>]", span)[0]),
    ]


# ---------------------------------------------------------------- examples
def variants(kind: str, span: str, pick: int, words: list[str]) -> str:
    """A base span as people also write it; ``pick`` chooses the way. Names in half
    of the addresses are changed for ``words``, so that no shape of name is learnt."""
    if kind == "email":
        local, _, host = span.partition("@")
        if pick % 2:
            a, b, c = (words[(pick // n) % len(words)] for n in (11, 121, 1331))
            local = [a, f"{a}.{b}", f"{a}_{b}", f"{a}{pick % 97}"][pick // 2 % 4]
            host = f"{c}.{sorted(_TLDS)[pick // 8 % len(_TLDS)]}"
            pick //= 2
        at, dot = [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), (" @ ", "."), ("[at]", "."),
                   (" (at) ", " (dot) "), ("@", " dot "), ("@", "[.]"), (" at ", ".")][pick % 10]
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return [span.replace(".", "[.]"), span.replace(".", " . "), f"{span}:{1024 + pick % 60000}", span.replace(".", "(.)")][pick % 4]
    d = digits(span)
    if kind == "card":
        cuts = (4, 10) if len(d) == 15 else tuple(range(4, len(d), 4))
        parts = [d[i:j] for i, j in zip((0, *cuts), (*cuts, len(d)), strict=True)]
        return [".", "/", "  ", " - ", "\u00a0", "_", ":", "-", " "][pick % 9].join(parts)
    a, b, c, e = d[:-10] or "1", d[-10:-7], d[-7:-4], d[-4:]
    return [f"({b}) {c}-{e}", f"{b}-{c}-{e}", f"00{a} {b} {c} {e}", f"{b}.{c}.{e}", f"+{a}/{b}/{c}{e}", f"({b}){c}-{e}", f"{a}-{b}-{c}-{e}",
            f"{b} {c} {e}", f"+{a}\u00a0{b}\u00a0{c}\u00a0{e}", f"{a} ({b}) {c}-{e}", f"+ {a} {b} {c} {e}"][pick % 11]


def decoys(kind: str, span: str, pick: int, words: list[str]) -> str:
    """What stands in a base span's place and only looks like one."""
    d = digits(span) + "7345829"
    a, b = words[pick % len(words)], words[(pick // 7) % len(words)]
    if kind == "email":
        return [f"{a} at the {b} dot", f"@{a}", f"{a} @ {d[:2]}.{d[2:4]}", f"{a} at {b}. {a}", f"{a}@{b}", f"at {b} dot {a}", f"{a}{d[:2]} at {b}",
                f"{a}.{d[:2]} at the dot {b}", f"{a} at {b}{d[0]} dot {d[1:3]}", f"{a}{d[0]}@{d[1:4]}"][pick % 10]
    if kind == "ip":
        return [f"{d[0]}.{d[1]}.{d[2]}.{d[3]}.{d[4]}", f"{300 + pick % 600}.{d[:2]}.{d[2:4]}.{d[4]}", f"{d[0]}.{d[1]} . {d[2]} . {d[3]} . {d[4]}",
                f"{d[:2]}:{d[2:4]}:{d[4:6]}.{d[:3]}", f"[{d[0]}] [{d[1]}] [{d[2]}] [{d[3]}]", f"0{d[:2]}.{d[2:5]}.{d[1:4]}-{d[0]}"][pick % 6]
    if kind == "card":
        n = 14 + pick % 6
        wrong = (d * 3)[: n - 1]
        wrong += next(c for c in "0123456789" if not luhn(wrong + c))
        return [wrong, " ".join(wrong[i: i + 4] for i in range(0, n, 4)), f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[1]}", ".".join(wrong[i: i + 4] for i in range(0, n, 4)),
                f"20{d[0]}{d[1]}-0{1 + pick % 9}-1{pick % 10} 1{d[0]}:{1 + pick % 5}{d[1]}:{pick % 6}{d[2]}.{d[:3]}", f"{wrong[:3]},{wrong[3:6]},{wrong[6:9]}.{wrong[9:13]}"][pick % 6]
    if pick % 3 == 0:
        n = int(d[:2])
        return [f"{d[0]}.{(d * 2)[1:5 + pick % 10]}", f"1{d[0]}:{1 + pick % 5}{d[1]}:{pick % 6}{d[2]}.{d[:3]}", " ".join(str(n + i) for i in range(4 + pick % 4)),
                f"{d[:2]}.{d[2:6]}, -{d[:2]}.{d[1:5]}", f"{d[:3]}.{d[3:6]}.{d[1:4]},{d[:2]}", f"{d[:2]}/{d[2:4]}/20{d[:2]}"][pick // 3 % 6]
    return [f"20{d[0]}{d[1]}-0{1 + pick % 9}-1{pick % 10}", f"1{pick % 10}.0{1 + pick % 9}.20{d[:2]}", f"{d[:7]}", f"{d[:3]},{d[3:6]},{d[1:4]}", f"{d[:2]}.{d[2:5]}.{d[1:4]}",
            f"{d[:4]}-{d[2:6]}", f"20{d[:2]} 20{d[1:3]} 20{d[2:4]}", f"{d[:8]}", f"{d[0]}.{d[1:3]}.{d[3:6]}-{d[4]}", f"{d[:10]}", f"19{d[:2]}-20{d[1:3]}"][pick % 11]


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=7).digest(), "big")


def _cross(spans: list[Span], starts: list[int], s: Span) -> bool:
    """Whether ``s`` overlaps one of the disjoint, ordered ``spans``."""
    i = bisect_right(starts, s[0])
    return (i > 0 and spans[i - 1][1] > s[0]) or (i < len(spans) and spans[i][0] < s[1])


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans):
        if out and s[0] < out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2])
        else:
            out.append(s)
    return out


def places(text: str) -> Iterator[tuple[str, str, int, str, str, str]]:
    """(kind, way, hash, left, span, right) of the places of a text that teach: ``base``
    spans, matches that ``failed`` their check, and ``other`` proposals."""
    matches = base_matches(text)
    known = _disjoint([s for s, ok in matches if ok])
    starts = [s[0] for s in known]

    def place(lo: int, hi: int, kind: str, way: str) -> tuple[str, str, int, str, str, str]:
        left, span, right = text[max(0, lo - AROUND): lo], text[lo:hi], text[hi: hi + AROUND]
        return kind, way, _hash(kind, left, span, right), left, span, right

    for (lo, hi, kind), ok in matches:
        if hi - lo <= 320 and (ok or not _cross(known, starts, (lo, hi, kind))):
            yield place(lo, hi, kind, "base" if ok else "failed")
    for lo, hi, kind in proposals(text):
        if not _cross(known, starts, (lo, hi, kind)):
            yield place(lo, hi, kind, "other")


def examples(kind: str, way: str, place: int, left: str, span: str, right: str) -> Iterator[tuple[str, int, str, str, str]]:
    """(kind, label, left, span, right) that a place has to teach."""
    if way != "base":
        yield kind, 0, left, span, right
        return
    yield kind, 1, left, span, right
    words = [w for w in re.findall(r"[^\W\d_]{2,12}", left + " " + right)] or ["the"]
    seen = set()
    for i in range(4):
        pick = _hash(place, i)
        # what stands next to it differs too, alike for both labels
        before = left + ["", "", "", "(", ": ", "\n", ", ", " - "][pick // 13 % 8]
        after = ["", "", "", ".", ",", ")", ";", "\n"][pick // 104 % 8] + right
        v = variants(kind, span, pick, words)
        yield kind, 1, before[-AROUND:], v, after[:AROUND]
        # proposals that cut the variant short, or take in what is beside it, are wrong; so are a decoy's
        for false, middle in (("part", v), ("decoy", decoys(kind, span, _hash(place, i, "no"), words))):
            whole, true = before + middle + after, (len(before), len(before) + len(middle))
            for s in proposals(whole):
                if s[0] < true[1] and s[1] > true[0] and (false == "decoy" or s[:2] != true) and (i, false, s) not in seen:
                    seen.add((i, false, s))
                    yield s[2], 0, whole[max(0, s[0] - AROUND): s[0]], whole[s[0]: s[1]], whole[s[1]: s[1] + AROUND]


_PLACE = "kind string, way string, h long, left string, span string, right string"


def _texts(col: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts that can hold a span at all."""
    hit = pc.fill_null(pc.match_substring_regex(col, _ANY), False)
    at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
    for i in at.tolist():
        yield i, col[i].as_py()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PLACE.split(", ")]
    for b in batches:
        held: dict[tuple, tuple] = {}  # of a batch's copies one is sent

        def rows() -> pa.RecordBatch:
            cols = zip(*held.values(), strict=True)  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "h" else pa.string()) for c, n in zip(cols, names, strict=True)], names)

        for _, text in _texts(b.column(0)):
            for p in places(text):
                held[p[:3]] = p
                if len(held) >= RUN:
                    yield rows()
                    held.clear()
        if held:
            yield rows()


#: A block of examples: features, kind and label (twice the kind's number and the label), what they are: 1 base, 2 held out.
_EXAMPLES = "x binary, code binary, mark binary"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, code, mark = [], [], []

    def full() -> pa.RecordBatch:
        parts = np.array(x, np.int32), np.array(code, np.uint8), np.array(mark, np.uint8)
        for part in (x, code, mark):
            part.clear()
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["x", "code", "mark"])

    for b in batches:
        for kind, way, h, *around in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held, base = 2 * (h % 3 == 0), way == "base"
            for k, label, left, span, right in examples(kind, way, h, *around):
                x.append(features(left, span, right, k))
                code.append(2 * KINDS.index(k) + label)
                mark.append(held + base)
                base = False  # the first example of a base place is the span itself
            if len(x) >= RUN:
                yield full()
    if x:
        yield full()


def _open(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, code, mark = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in enumerate((np.int32, np.uint8, np.uint8)))
    return x.reshape(len(code), -1), code, mark


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, what, value, n): how many examples have each value of a feature, held-out ones
    left aside; and, as what -1 and -2, how many are base spans (value 1) or not, and held out (2) or not."""
    for b in batches:
        for i in range(b.num_rows):
            x, code, mark = _open(b, i)
            for c in np.unique(code):
                mine, out = code == c, []
                for j, v in enumerate(x[mine & (mark < 2)].T):
                    out.append((j, *np.unique(v, return_counts=True)))
                out.append((-1, *np.unique(mark[mine] & 1, return_counts=True)))
                out.append((-2, *np.unique(mark[mine] & 2, return_counts=True)))
                n = [len(v) for _, v, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(sum(n), int(c))), pa.array(np.repeat([j for j, _, _ in out], n)),
                     pa.array(np.concatenate([v for _, v, _ in out]).astype(np.int64)), pa.array(np.concatenate([k for _, _, k in out]).astype(np.int64))],
                    ["code", "what", "value", "n"])


@dataclass
class Model:
    """Trees, and for each kind the calibration (slope, offset) and the threshold."""
    trees: Trees | None
    scale: dict[str, tuple[float, float]]
    threshold: dict[str, float]

    def probability(self, x: np.ndarray, kinds: list[str]) -> np.ndarray:
        z = self.trees.margin(x)
        a, b = (np.array([self.scale.get(k, (1.0, 0.0))[i] for k in kinds]) for i in (0, 1))
        return sigmoid(a * z + b)


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of ``y`` to the margins, each ``n`` times (Newton steps)."""
    beta = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)
    ones, every = float((n * y).sum()), float(n.sum())
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (every - ones + 2))
    for _ in range(30):
        p = sigmoid(x @ beta)
        grad = x.T @ (n * (goal - p)) - 1e-3 * (beta - np.array([1.0, 0.0]))
        beta = beta + np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
    return float(max(beta[0], 1e-3)), float(beta[1])


def _threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray, scale: tuple[float, float]) -> float | None:
    """The least probability at which enough of the held-out rows are right; rows of a
    margin step are taken together."""
    step, at = np.unique(-z, return_inverse=True)  # the likeliest first
    hits = np.cumsum(np.bincount(at, n * y, len(step)))
    seen = np.cumsum(np.bincount(at, n, len(step)))
    good = np.flatnonzero((hits + 0.5) / (seen + 1) >= PRECISION)
    if not len(good):
        return None
    return max(0.5, float(sigmoid(scale[0] * (-step[good[-1]] - 0.5 / STEPS) + scale[1])))


def train(docs: DataFrame, text: str = "text", keep: int = KEEP) -> Model:
    """Fit trees, calibration and thresholds to all distinct examples of ``docs``. If
    they are ``keep`` at most, the driver sums over them itself; the model is the same."""
    # places are few bytes and much work, so they are dealt by number and not by size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(docs.select(exact(text)).mapInArrow(_places, _PLACE).dropDuplicates(["kind", "way", "h"]).repartition(tasks)
                        .mapInArrow(_examples, _EXAMPLES), "examples")
    try:
        return _fitted(found, keep)
    finally:
        discard(found)


def _fitted(found: DataFrame, keep: int) -> Model:
    # features are small whole numbers, so this table is bounded by their values
    tally = (found.mapInArrow(_tally, "code long, what long, value long, n long").groupBy("code", "what", "value")
             .agg(F.sum("n").alias("n")).toPandas())
    base = tally[(tally["what"] == -1) & (tally["value"] == 1)].groupby("code")["n"].sum()
    taught = [k for i, k in enumerate(KINDS) if base.get(2 * i + 1, 0) >= ENOUGH]
    tally = tally[(tally["code"] // 2).isin([KINDS.index(k) for k in taught])]
    every = tally[tally["what"] == -2]
    if not taught or (every["code"] % 2).nunique() < 2:
        return Model(None, {}, {})
    # both labels of a kind weigh the same
    of_code = np.zeros(2 * len(KINDS))
    for c, n in every.groupby("code")["n"].sum().items():
        of_code[c] = every["n"].sum() / (2 * len(taught) * n)
    learnt = every[every["value"] == 0]
    if learnt.empty:
        return Model(None, {}, {})
    start = start_of(learnt["code"].to_numpy() % 2, of_code[learnt["code"]] * learnt["n"].to_numpy())
    values = tally[tally["what"] >= 0].groupby(["what", "value"])["n"].sum()
    cuts = [cuts_of(v.index.get_level_values("value").to_numpy(float), v.to_numpy()) for _, v in values.groupby(level="what", sort=True)]

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, code, mark = _open(b, i)
                mine = (mark < 2) & (of_code[code] > 0)
                if mine.any():
                    yield block(binned(x[mine], cuts), code[mine] % 2, of_code[code[mine]], np.full(int(mine.sum()), start))

    blocks = found.mapInArrow(taken, BLOCK)
    if learnt["n"].sum() <= keep:
        rows = blocks.toArrow()
        x, y, w, _ = (np.concatenate(p, axis=-1) for p in zip(*(unpacked(rows, i) for i in range(rows.num_rows)), strict=True))
        trees = fit_binned(x, y, w, cuts, start)
    else:
        blocks = materialise(blocks, "blocks")
        trees = fit_table(blocks, cuts, start)
        discard(blocks)
    model = Model(trees, {}, {})

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, code, mark = _open(b, i)
                mine = (mark >= 2) & (of_code[code] > 0)
                step = np.rint(trees.margin(x[mine]) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code[mine].astype(np.int64)), pa.array(step)], ["code", "step"])

    held = found.mapInArrow(margins, "code long, step long").groupBy("code", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()
    held = held.sort_values(["code", "step"])
    for k in taught:
        mine = held[held["code"] // 2 == KINDS.index(k)]
        z, y, n = mine["step"].to_numpy(float) / STEPS, (mine["code"] % 2).to_numpy(float), mine["n"].to_numpy(float)
        if not (0 < (n * y).sum() < n.sum()):
            continue
        model.scale[k] = _platt(z, y, n)
        least = _threshold(z, y, n, model.scale[k])
        if least is not None:
            model.threshold[k] = least
    return model


def _chosen(scored: list[tuple[float, Span]], base: list[Span]) -> list[Span]:
    """Likeliest first, those that overlap neither base spans nor one another."""
    taken = _disjoint(base)
    starts = [s[0] for s in taken]
    out = []
    free = [(p, s) for p, s in scored if not _cross(taken, starts, s)]
    # only proposals that overlap compete: clusters are settled each by itself
    free.sort(key=lambda v: v[1][:2])
    cluster, reach = [], -1
    def settle() -> None:
        mine: list[Span] = []
        for _, s in sorted(cluster, key=lambda v: (-v[0], v[1][0] - v[1][1], v[1][0], KINDS.index(v[1][2]))):
            if all(s[1] <= t[0] or s[0] >= t[1] for t in mine):
                mine.append(s)
        out.extend(mine)
    for p, s in free:
        if cluster and s[0] >= reach:
            settle()
            cluster, reach = [], -1
        cluster.append((p, s))
        reach = max(reach, s[1])
    settle()
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base, at, spans, rows = [base_spans(t) for t in texts], [], [], []
    for i, t in enumerate(texts):
        if not model.threshold:
            break
        taken = _disjoint(base[i])
        starts = [s[0] for s in taken]
        for s in proposals(t):
            if s[2] in model.threshold and not _cross(taken, starts, s):
                at.append(i)
                spans.append(s)
                rows.append(features(t[max(0, s[0] - AROUND): s[0]], t[s[0]: s[1]], t[s[1]: s[1] + AROUND], s[2]))
    scored: list[list[tuple[float, Span]]] = [[] for _ in texts]
    if rows:
        p = model.probability(np.array(rows, float), [s[2] for s in spans])
        for i, s, v in zip(at, spans, p.tolist(), strict=True):
            if v >= model.threshold[s[2]]:
                scored[i].append((v, s))
    return [(b, _chosen(s, b)) for b, s in zip(base, scored, strict=True)]


def _groups(col: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """The texts worth a scan, in lists of about a megabyte."""
    group, size = [], 0
    for i, t in _texts(col):
        group.append((i, t))
        size += len(t)
        if size > 1 << 20:
            yield group
            group, size = [], 0
    if group:
        yield group


def spans_of(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, end) and added (likewise) of every row."""
    kind = docs.select(exact(doc_id)).schema[0].dataType.simpleString()
    one = "array<struct<kind: string, start: long, end: long>>"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            found = [([], [])] * len(b)
            for group in _groups(b.column(1)):
                for (i, _), f in zip(group, find([t for _, t in group], model), strict=True):
                    found[i] = f
            struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in sorted(f[c], key=lambda v: (v[0], KINDS.index(v[2])))]
                              for f in found], struct) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "added"])

    return docs.select(exact(doc_id), exact(text)).mapInArrow(run, f"doc_id {kind}, base {one}, added {one}")


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    rows = spans_of(docs, model, doc_id, text)
    order = F.array(*[F.lit(k) for k in KINDS])

    def listed(c: F.Column) -> F.Column:
        by = F.transform(c, lambda s: F.struct(s["start"].alias("s"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("e"), s["kind"].alias("k")))
        return F.array_join(F.transform(F.array_sort(by), lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")

    # a lambda of two parameters would be given the place as the second
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [count(k) for k in KINDS]
    return rows.select("doc_id", *n, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       listed(F.concat("base", "added")).alias("spans"))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span as [kind]; what overlaps is one gap, named by its first."""
    out, at = [], 0
    for s, e, k in _disjoint(spans):
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = free_name(docs, "redacted")

    @F.pandas_udf("string")
    def masked(texts):
        out = texts.astype(object).where(texts.notna(), None).tolist()
        some = [i for i, t in enumerate(out) if t and re.search(_ANY, t)]
        for i in some:
            (base, added), = find([out[i]], sent.value)
            out[i] = mask(out[i], base + added)
        return type(texts)(out, dtype=object)

    rows = docs.withColumn(new, masked(exact(text)))
    return rows.select(*[exact(new).alias(c) if c == text else exact(c) for c in docs.columns])
