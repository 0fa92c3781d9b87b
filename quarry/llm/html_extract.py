"""HTML extraction with site template removal.

A page is read into an element tree (tolerant of missing end tags). Each element
subtree gets a hash of its tag, names, texts and children. Spark counts on how many
different pages of a host each subtree occurs, and on how many of each section of the
host (the first segment of a path that has more); one that recurs on ``MIN_PAGES`` pages
and on a share ``SHARE`` of the host's or of a section's is template and is deleted on
the pages of that host or section. So what only one part of a large host carries is
found as on a small host. Pages that are copies of one another count once, so an article is not
taken for template because its page was stored many times, and in an article or
main element only containers are deleted, never its paragraphs, lists or headings.

What no recurrence shows is told by structure: elements that are no content by
their tag, role or name (``NOT_CONTENT``, ``NOT_CONTENT_NAMES``) go as well. The main
text is that of the article elements left, else of the main element, else of
the body. Block elements and line breaks part the text into blocks; in a block white
space becomes one space, and blocks are joined in page order by one space.

The templates of a host or section number fewer than its mean subtrees on a page over
``SHARE``, so the lists that join a page are bounded, whatever the host's pages.

Defined cases: a null or empty page has an empty text; null urls and urls without
``://`` are one host, ''. Repeated rows get equal results, each its own row. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import exact, materialise
from quarry.llm.url_tree import host_path

MIN_PAGES = 5
SHARE = 0.1

# fixed values of HTML: elements without content, with raw text, and of blocks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td
tfoot th thead title tr ul""".split())
CLOSES_P = BLOCK - {"br", "body", "head", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
#: An open element of the value's tags ends where the key's tag starts, within the nearest of SCOPE.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
SCOPE = frozenset("ul ol dl table select article main section aside nav div body html".split())

NOT_CONTENT = frozenset("""aside button canvas dialog embed fieldset footer form frame frameset head iframe input label math menu nav
noscript object option script select style svg template textarea title""".split())
NOT_CONTENT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOT_CONTENT_NAMES = frozenset("""ad ads adsense adslot advert advertisement advertisements advertising adverts banner breadcrumb
breadcrumbs byline comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header
hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall
popup privacy promo promotion recommended related reply replies respond responses search share sharing sidebar signup skip social
sponsor sponsored sponsors subscribe subscription tags teaser toolbar topbar widget widgets""".split())
THREADS = frozenset("comment commentlist comments discussion disqus recommended related replies reply respond responses".split())
CONTAINERS = frozenset("div section table form fieldset details center".split())

_START = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "digest")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.digest = 0

    def names(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)} if self.attrs.strip() else {}

    def is_content(self, in_article: bool) -> bool:
        if self.tag in NOT_CONTENT or self.tag == "header" and not in_article:
            return False
        a = self.names()
        if not a:
            return True
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            return False
        if a.get("role", "").lower() in NOT_CONTENT_ROLES:
            return False
        if self.tag in ("html", "body", "main"):
            return True
        return not self.words() & NOT_CONTENT_NAMES

    def words(self) -> set[str]:
        a = self.names()
        return {w.lower() for k in ("class", "id") for w in _WORD.findall(a.get(k, ""))}


class _Open:
    """The open elements: the innermost one, and how many there are of each tag, in
    all and within the innermost of SCOPE, so that no tag has to search in vain."""

    def __init__(self, root: Element):
        self.here, self.tags, self.scopes = root, Counter(), [Counter()]

    def enter(self, e: Element) -> None:
        self.here = e
        self.tags[e.tag] += 1
        if e.tag in SCOPE:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][e.tag] += 1

    def leave(self) -> str:
        """Close the innermost element; its tag."""
        tag, self.here = self.here.tag, self.here.parent
        self.tags[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> bool:
        """Close the nearest element of a tag, and what is open in it."""
        if not self.tags[tag]:
            return False
        while self.leave() != tag:
            pass
        return True

    def before(self, tag: str) -> None:
        """Close what ends where a tag starts: of its own kind all in the scope, else the nearest paragraph."""
        ends = ENDS.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
        while any(self.scopes[-1][t] for t in ends):
            while self.leave() not in ends:
                pass
            if tag not in ENDS:
                break


def parse(page: str) -> Element:
    """The element tree of a page; texts are still escaped, but for raw ones.

    Time is linear in the page. A tag ends at the first ``>`` outside quotes. Where none
    follows because a quote never closes, quotes are plain characters in the rest
    of the page; after the last ``>`` there is text, up to a comment left open."""
    root = Element("", "", None)
    open_ = _Open(root)
    at, end, last, quoted = 0, len(page), page.rfind(">"), True
    while at < end:
        m = _START.search(page, at)
        if not m or m.end() > last:
            note = page.find("<!--", at)
            open_.here.children.append(page[at: note if note >= 0 else end])
            break
        if m.start() > at:
            open_.here.children.append(page[at: m.start()])
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            stop = page.find(mark, m.end())
            at = stop + len(mark) if stop >= 0 else end
            continue
        rest = _REST.match(page, m.end()) if quoted else None
        quoted = rest is not None
        stop = rest.end() - 1 if rest else page.find(">", m.end())
        tag, attrs, at = m[2].lower(), page[m.end(): stop], stop + 1
        if m[1]:  # an end tag closes the nearest open element of its name, and what is open in it
            if not open_.end(tag) and tag == "br":
                open_.here.children.append(Element("br", "", open_.here))
            continue
        open_.before(tag)
        child = Element(tag, attrs, open_.here)
        open_.here.children.append(child)
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            stop = close.start() if close else end
            child.children.append(page[at:stop])
            tail = page.find(">", stop)
            at = tail + 1 if close and tail >= 0 else end
        elif tag not in VOID and not attrs.endswith("/"):
            open_.enter(child)
    return root


def _walk(root: Element) -> Iterator[Element]:
    """All elements below, children before parents."""
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        e, done = stack.pop()
        if done:
            yield e
        else:
            stack.append((e, True))
            stack += [(c, False) for c in e.children if isinstance(c, Element)]


def digest(root: Element) -> list[Element]:
    """Give each element the hash of its subtree; those that say something, root excepted."""
    out = []
    for e in _walk(root):
        a = e.names() if e.attrs else {}
        parts = [e.tag, a.get("class", ""), a.get("id", ""), a.get("role", "")]
        for c in e.children:
            parts.append(" ".join(c.split()) if isinstance(c, str) else str(c.digest))
        e.digest = int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        if e.parent is not None and e.tag in BLOCK and e.tag not in VOID and any(parts[4:]):
            out.append(e)
    return out


def _left(root: Element, templates: frozenset[int]) -> tuple[list[Element], list[Element]]:
    """(article elements, main elements) that are not deleted, outermost ones, in page order."""
    # what holds every article of the page is its frame, whatever its name (has-sidebar) or a missing end tag says
    held: dict[int, int] = {}
    marked = 0
    for e in _walk(root):
        own = e.tag in ("article", "main")
        marked += own
        inside = held.get(id(e), 0) + own
        if inside and e.parent is not None:
            held[id(e.parent)] = held.get(id(e.parent), 0) + inside
    articles, mains = [], []
    stack = [root]
    while stack:
        e = stack.pop()
        frame = e.parent is None or held.get(id(e)) == marked and not e.words() & THREADS
        if not frame and (not e.is_content(False) or e.digest in templates and e.tag not in ("article", "main")):
            continue
        if e.tag == "article":
            articles.append(e)
            continue
        if e.tag == "main" or "main" == e.names().get("role"):
            mains.append(e)
        stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    return articles, mains


def text_of(root: Element, templates: frozenset[int]) -> str:
    """The main text of a page whose elements have their digests."""
    articles, mains = _left(root, templates)
    found = articles or mains[:1]
    blocks: list[str] = []
    part: list[str] = []

    def close() -> None:
        block = " ".join(entities.unescape("".join(part)).split())
        part.clear()
        if block:
            blocks.append(block)

    for top in found or [root]:
        # an entry is an element to open, the close of a block (None) or a text
        stack: list[Element | str | None] = [top]
        while stack:
            e = stack.pop()
            if e is None:
                close()
            elif isinstance(e, str):
                part.append(e)
            else:
                if e is not top and not e.is_content(bool(found)):
                    continue
                if e is not top and e.digest in templates and (e.tag in CONTAINERS or not found):
                    continue
                if e.tag in BLOCK:
                    close()
                    stack.append(None)
                stack += reversed(e.children)
        close()
    return " ".join(blocks)


def _places(url: Column) -> list[Column]:
    """Host and section of a url; a path of one segment is in no section (null)."""
    host, path = host_path(url)
    return [host.alias("host"), F.nullif(F.regexp_extract(path, "^/([^/]+)/", 1), F.lit("")).alias("section")]


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, section, templates): the hashes of the template subtrees of each host
    (section null) and of its sections."""
    rows = pages.select(*_places(exact(url)), exact(html).alias("html")).filter("html is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                hosts, sections, page, subtree = [], [], [], []
                for host, section, text in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    root = parse(text)
                    seen = {e.digest for e in digest(root)} | {None}  # null counts the pages
                    for place in {None, section}:
                        hosts += [host] * len(seen)
                        sections += [place] * len(seen)
                        page += [root.digest] * len(seen)  # equal for copies of a page
                        subtree += seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(sections, pa.string()), pa.array(page, pa.int64()), pa.array(subtree, pa.int64())],
                    ["host", "section", "page", "subtree"])

    place = ["host", "section"]
    seen = rows.mapInArrow(run, "host string, section string, page long, subtree long").distinct()
    often = materialise(seen.groupBy(*place, "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES), "often")
    size = often.filter("subtree is null").select(F.col("host").alias("h"), F.col("section").alias("s"), F.col("n").alias("pages"))
    return (often.filter("subtree is not null")
            .join(size, (F.col("host") == F.col("h")) & F.col("section").eqNullSafe(F.col("s")))
            .filter(F.col("n") >= SHARE * F.col("pages"))
            .groupBy(*place).agg(F.collect_list("subtree").alias("templates")))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    src = pages.select(exact(page_id).alias("page_id"), exact(url).alias("url"), exact(html).alias("html"), *_places(exact(url)))
    # written first, so that its size is known: pages are shuffled by host only if it is too large to broadcast
    found = materialise(templates(pages, url, html), "templates")
    known = (src.join(found.filter("section is null").select("host", F.col("templates").alias("of_host")), "host", "left")
             .join(found.filter("section is not null").withColumnRenamed("templates", "of_section"), ["host", "section"], "left")
             .select("page_id", "url", "html", "of_host", "of_section"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = []
                for page, *lists in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    root = parse(page or "")
                    found = frozenset(t for one in lists for t in one or ())
                    if found:
                        digest(root)
                    texts.append(text_of(root, found) if page else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kind = src.schema["page_id"].dataType.simpleString()
    return known.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
