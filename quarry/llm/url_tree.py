"""URL filters by a path-template tree, in DataFrame functions only.

A url is judged by the longest rule that fits its host (or a parent domain) and
the start of its path; other urls by their template. Templates come from a tree
of path segments per host, made level by level on the table of distinct shapes:

* a segment's shape has its digits as ``{n}`` and long hexadecimal runs as ``{h}``;
* a node's branches become ``*`` if they are many and rare (over ``VARIETY`` shapes of
  under ``RARE`` urls on average), or one by one if they are statistically like the
  node: the next level's shapes pass a chi-square test against the node's own (three
  deviations), and the share of blocked among labelled urls a z test (``Z``); a branch
  without labels has its structure alone to go by;
* the tree has ``DEPTH`` levels, more than urls in use have; below them a path goes on as ``**``.

Urls that a rule decides are the labels. A template is rejected if its labelled urls'
blocked share, smoothed by ``PRIOR`` urls of the overall share, reaches ``PURITY`` and
they are ``LABELS`` at least; the urls of it that no rule speaks of go with it. A template of
fewer labels is allowed.

Counting is pre-aggregated, so a hot host costs a row for each of its shapes and
map task. Defined cases: null urls and urls without ``://`` have an empty host and
path, no rule and the verdict of that empty template, which is to allow. Rows that
repeat are judged alike. Extra columns are not read by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, exact, materialise

DEPTH = 6
VARIETY = 20
RARE = 3
Z = 1.96
PRIOR = 10
PURITY = 0.8
LABELS = 10

#: (verdict, host, path) of the rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_S = [f"s{i}" for i in range(1, DEPTH + 1)]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and listed, the rule's verdict.

    The rules are a short list; the longest (host and path together) comes first."""
    host, path = host_path(F.col("url"))
    df = pages.select(exact(page_id).alias("page_id"), exact(url).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    rule = listed = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, listed = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(listed)
    return df.select("*", rule.alias("rule"), listed.alias("listed"))


def shapes(path: Column) -> list[Column]:
    """The shapes of the first DEPTH segments ('' beyond the end), the last with what follows."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F]{16,}", "{h}"), "[0-9]+", "{n}")
    out = [F.coalesce(shape(F.get(segments, F.lit(i))), F.lit("")) for i in range(DEPTH)]
    return out[:-1] + [F.concat(out[-1], F.when(F.size(segments) > DEPTH, "/**").otherwise(""))]


def templates(urls: DataFrame) -> DataFrame:
    """(host, s1.., t1.., n, labelled, blocked): the template of each distinct shape of
    a host. ``urls`` has host, s1.. and listed."""
    t = materialise(urls.groupBy("host", *_S).agg(
        F.count(F.lit(1)).alias("n"), F.count("listed").alias("l"),
        F.count_if(F.col("listed") == "block").alias("b")), "shapes")
    for i in range(1, DEPTH + 1):
        up, here = ["host", *(f"t{j}" for j in range(1, i))], f"s{i}"
        nxt = F.col(f"s{i + 1}") if i < DEPTH else F.lit("")
        kind = materialise(t.groupBy(*up, here, nxt.alias("c")).agg(*[F.sum(x).alias(x) for x in ("n", "l", "b")]), "kinds")
        node = kind.groupBy(*up, here).agg(*[F.sum(x).alias(x) for x in ("n", "l", "b")])
        whole = node.groupBy(*up).agg(F.sum("n").alias("un"), F.sum("l").alias("ul"), F.sum("b").alias("ub"),
                                      F.count(F.lit(1)).alias("kinds"))
        below = kind.groupBy(*up, "c").agg(F.sum("n").alias("cn"))
        # the sum over all kinds of (seen - expected)^2 / expected is the sum of seen^2 / expected, less the node's urls
        chi = (kind.join(below, [*up, "c"]).join(whole.select(*up, "un"), up)
               .groupBy(*up, here).agg(F.sum(F.col("n") * F.col("n") * F.col("un") / F.col("cn")).alias("x")))
        df = below.groupBy(*up).agg((F.count(F.lit(1)) - 1).alias("df"))
        j = node.join(whole, up).join(chi, [*up, here]).join(df, up)
        p = F.col("ub") / F.col("ul")
        z = F.abs(F.col("b") / F.col("l") - p) <= Z * F.sqrt(p * (1 - p) / F.col("l")) + 1e-9
        labels_like = F.when((F.col("ul") == 0) | (F.col("l") == 0), True).otherwise(z)
        like = (F.col("x") / F.col("n") - F.col("n") <= F.col("df") + 3 * F.sqrt(2 * F.col("df")) + 1e-6) & labels_like
        many = (F.col("kinds") > VARIETY) & (F.col("un") < RARE * F.col("kinds"))
        star = (F.col(here) != "") & (F.col("kinds") > 1) & (many | like)
        named = j.select(*up, here, F.when(star, "*").otherwise(F.col(here)).alias(f"t{i}"))
        t, before = materialise(t.join(named, [*up, here]), "shapes"), t
        discard(before)
        discard(kind)
    return t


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row."""
    urls = ruled(pages, rules, page_id, url)
    urls = urls.select("*", *[c.alias(n) for c, n in zip(shapes(F.col("path")), _S, strict=True)])
    tree = templates(urls)
    _T = [f"t{i}" for i in range(1, DEPTH + 1)]
    base = tree.agg(F.coalesce(F.sum("b") / F.nullif(F.sum("l"), F.lit(0)), F.lit(0.0))).first()[0]
    by_template = tree.groupBy("host", *_T).agg(*[F.sum(x).alias(x) for x in ("n", "l", "b")])
    purity = F.round((F.col("b") + PRIOR * F.lit(base)) / (F.col("l") + PRIOR), 9)
    scored = by_template.select(
        "host", *_T, purity.alias("purity"),
        F.when((purity >= PURITY) & (F.col("l") >= LABELS), "block").otherwise("allow").alias("by_template"))
    known = tree.select("host", *_S, *_T).join(scored, ["host", *_T]).select(
        "host", *_S, F.concat(F.lit("/"), F.array_join(F.filter(F.array(*_T), lambda s: s != ""), "/")).alias("template"),
        "purity", "by_template")
    return urls.join(known, ["host", *_S]).select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "by_template").alias("verdict"), "template", "purity")


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for ``judge`` over pages."""
    order = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    case = lambda f: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{f(v, h, p)}'" for v, h, p in order) + " END"
    seg = [f"coalesce(regexp_replace(regexp_replace(seg[{i}], '[0-9a-fA-F]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '')"
           for i in range(1, DEPTH + 1)]
    seg[-1] += f" || CASE WHEN len(seg) > {DEPTH} THEN '/**' ELSE '' END"
    sql = f"""
WITH parts AS (
SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), urls AS (
SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS listed,
  {', '.join(f'{e} AS s{i}' for i, e in enumerate(seg, 1))}
FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM split)
), lv0 AS (
SELECT host, {', '.join(_S)}, count(*) AS n, count(listed) AS l, count(*) FILTER (listed = 'block') AS b FROM urls GROUP BY ALL
)"""
    for i in range(1, DEPTH + 1):
        up, here = ", ".join(["host", *(f"t{j}" for j in range(1, i))]), f"s{i}"
        nxt = f"s{i + 1}" if i < DEPTH else "''"
        sql += f""", kind{i} AS (
SELECT {up}, {here}, {nxt} AS c, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM lv{i - 1} GROUP BY ALL
), node{i} AS (
SELECT {up}, {here}, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM kind{i} GROUP BY ALL
), whole{i} AS (
SELECT {up}, sum(n) AS un, sum(l) AS ul, sum(b) AS ub, count(*) AS kinds FROM node{i} GROUP BY ALL
), below{i} AS (
SELECT {up}, c, sum(n) AS cn FROM kind{i} GROUP BY ALL
), chi{i} AS (
SELECT {up}, {here}, sum(n::DOUBLE * n * un / cn) AS x FROM kind{i} JOIN below{i} USING ({up}, c) JOIN (SELECT {up}, un FROM whole{i}) w USING ({up})
GROUP BY ALL
), df{i} AS (
SELECT {up}, count(*) - 1 AS df FROM below{i} GROUP BY ALL
), named{i} AS (
SELECT {up}, {here}, CASE WHEN {here} <> '' AND kinds > 1 AND ((kinds > {VARIETY} AND un < {RARE} * kinds)
  OR (x / n - n <= df + 3 * sqrt(2 * df) + 1e-6 AND CASE WHEN ul = 0 OR l = 0 THEN true
    ELSE abs(b::DOUBLE / l - ub::DOUBLE / ul) <= {Z} * sqrt((ub::DOUBLE / ul) * (1 - ub::DOUBLE / ul) / l) + 1e-9 END))
  THEN '*' ELSE {here} END AS t{i}
FROM node{i} JOIN whole{i} USING ({up}) JOIN chi{i} USING ({up}, {here}) JOIN df{i} USING ({up})
), lv{i} AS (
SELECT * FROM lv{i - 1} JOIN named{i} USING ({up}, {here})
)"""
    ts = ", ".join(f"t{i}" for i in range(1, DEPTH + 1))
    return sql + f""", template AS (
SELECT host, {ts}, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM lv{DEPTH} GROUP BY ALL
), scored AS (
SELECT host, {ts}, round((b + {PRIOR} * p0) / (l + {PRIOR}), 9) AS purity,
  CASE WHEN round((b + {PRIOR} * p0) / (l + {PRIOR}), 9) >= {PURITY} AND l >= {LABELS} THEN 'block' ELSE 'allow' END AS by_template
FROM template, (SELECT coalesce(sum(b)::DOUBLE / nullif(sum(l), 0), 0) AS p0 FROM template)
), known AS (
SELECT host, {', '.join(_S)}, '/' || array_to_string(list_filter([{ts}], lambda s: s <> ''), '/') AS template, purity, by_template
FROM lv{DEPTH} JOIN scored USING (host, {ts})
)
SELECT page_id, host, path, rule, coalesce(listed, by_template) AS verdict, template, purity
FROM urls JOIN known USING (host, {', '.join(_S)})
"""
