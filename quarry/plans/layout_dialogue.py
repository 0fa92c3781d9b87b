"""Registered queries: extracted-table layout (H1-H5), dialogue and
logs (I1-I3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.fixed import RETENTION_DAYS
from quarry.operators import dialogue as I
from quarry.operators import layout as H
from quarry.operators.prompt import dialogue_pairs
from quarry.plans.registry import register
from quarry.plans.sqlparts import values
from quarry.plans.strategy import _checkpointed, group_row_number
from quarry.session import load_table, shared_dir

# Hand-made header cells (FIXTURES §3): a leading empty cell, empties to
# fill from the left, a cell with a newline.
HEADER_ROWS = [(-1, -1, "2024-01-01 00:00:00", None), (-2, -1, "2024-01-01 00:00:01", "a"),
               (-3, -1, "2024-01-01 00:00:02", None), (-4, -1, "2024-01-01 00:00:03", "b\nc"),
               (-5, -1, "2024-01-01 00:00:04", None)]
PAGE_ROWS = 50
ROW_HEIGHT = 12
PAGE_HEIGHT = 600
# Hand-made table parts: one table over three pages; equal headers but the
# first part ends more than 100 units above its page bottom.
PART_ROWS = [("1900-01-01", 0, "|a|b|", 590.0), ("1900-01-01", 1, "|a|b|", 595.0), ("1900-01-01", 2, "|a|b|", 100.0),
             ("1900-01-02", 0, "|a|b|", 400.0), ("1900-01-02", 1, "|a|b|", 300.0)]
TABLE_BLOCKS = [(0, 1, 15, "table", "|a|b|\n|---|---|\n|1|2|")]
MERGED_PAGES = [(0, 2)]
SHORT_RETENTION = 7


def header_cells(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    hand = spark.createDataFrame(HEADER_ROWS, "event_id long, user_id long, ts string, event_type string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cells = ev.unionByName(hand)
    return cells.withColumn("cell", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type")))


HEADER_SQL = f"""(SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS cell
 FROM (SELECT event_id, user_id, ts, event_type FROM events UNION ALL
       SELECT event_id, user_id, ts::TIMESTAMP, event_type
       FROM {values(HEADER_ROWS, ['event_id', 'user_id', 'ts', 'event_type'], ['BIGINT', 'BIGINT', 'VARCHAR', 'VARCHAR'])}))"""


# --- H1 / H2 --------------------------------------------------------------------
@register("header_fill", sql=f"""SELECT event_id, user_id,
  replace(coalesce(last_value(cell IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ''), chr(10), '') AS header
FROM {HEADER_SQL}""")
def q_header_fill(spark, sf_dir):
    cells = header_cells(spark, sf_dir)
    return H.fill_header(cells, ["user_id"], ["ts", "event_id"], "cell").select("event_id", "user_id", "header")


# --- H3 ---------------------------------------------------------------------------
ORDER_ROWS_SQL = """SELECT o_orderdate::DATE AS day, o_orderkey,
  row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS rn,
  '|' || concat_ws('|', replace(coalesce(o_orderkey::VARCHAR, ''), ' ', ''), replace(coalesce(o_orderstatus, ''), ' ', ''),
                   replace(coalesce(o_totalprice::VARCHAR, ''), ' ', '')) || '|' AS line
FROM orders"""


@register("markdown_table", sql=f"""SELECT day, ((rn - 1) // {PAGE_ROWS})::BIGINT AS page,
  '|o_orderkey|o_orderstatus|o_totalprice|' || chr(10) || '|---|---|---|' || chr(10)
    || string_agg(line, chr(10) ORDER BY rn) AS markdown,
  count(*)::BIGINT AS rows
FROM ({ORDER_ROWS_SQL}) GROUP BY day, ((rn - 1) // {PAGE_ROWS})""")
def q_markdown_table(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return H.markdown_pages(o, ["day"], "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice"], PAGE_ROWS)


# --- H4 ---------------------------------------------------------------------------
@register("merge_continued", sql="""WITH r AS (
  SELECT user_id, event_type, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
         - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island
  FROM events)
SELECT user_id, event_type, island::BIGINT AS island, min(ts) AS first_ts, count(*)::BIGINT AS n
FROM r GROUP BY user_id, event_type, island""")
def q_merge_continued(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    runs = H.merge_runs(ev, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.select("user_id", "event_type", "island", F.col("_first.ts").alias("first_ts"), "n")


PARTS_SQL = f"""(SELECT day AS doc, ((rn - 1) // {PAGE_ROWS})::BIGINT AS page, '|o_orderkey|o_orderstatus|o_totalprice|' AS header,
        (count(*) * {ROW_HEIGHT})::DOUBLE AS y_bottom, {PAGE_HEIGHT}::DOUBLE AS page_height
 FROM ({ORDER_ROWS_SQL}) GROUP BY day, ((rn - 1) // {PAGE_ROWS})
 UNION ALL
 SELECT doc::DATE, page, header, y_bottom, {PAGE_HEIGHT}::DOUBLE
 FROM {values(PART_ROWS, ['doc', 'page', 'header', 'y_bottom'], ['VARCHAR', 'BIGINT', 'VARCHAR', 'DOUBLE'])})"""


@register("merge_table_parts", sql=f"""WITH p AS (SELECT * FROM {PARTS_SQL}),
b AS (
  SELECT *, CASE WHEN lag(page) OVER w = page - 1 AND lag(header) OVER w = header
                      AND lag(page_height - y_bottom) OVER w <= 100 THEN 0 ELSE 1 END AS brk
  FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)
),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b)
SELECT doc, page, min(page) OVER (PARTITION BY doc, grp) AS table_page FROM g""")
def q_merge_table_parts(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    n = group_row_number(o, ["day"], ["o_orderkey"], "rn")
    parts = (n.groupBy(F.col("day").alias("doc"), F.floor((F.col("rn") - 1) / PAGE_ROWS).cast("bigint").alias("page"))
             .agg((F.count(F.lit(1)) * ROW_HEIGHT).cast("double").alias("y_bottom"))
             .withColumn("header", F.lit("|o_orderkey|o_orderstatus|o_totalprice|"))
             .withColumn("page_height", F.lit(float(PAGE_HEIGHT))))
    hand = spark.createDataFrame(PART_ROWS, "doc string, page long, header string, y_bottom double") \
        .withColumn("doc", F.to_date("doc")).withColumn("page_height", F.lit(float(PAGE_HEIGHT)))
    merged = H.merge_continued(parts.unionByName(hand))
    return merged.select("doc", "page", "table_page")


# --- H5 ---------------------------------------------------------------------------
@register("page_layout", sql=f"""WITH blocks AS (
  SELECT conv_id AS doc, turn AS page, (generate_subscripts(string_split(text, chr(10)), 1) * 10)::BIGINT AS y,
         'text' AS kind, unnest(string_split(text, chr(10))) AS text FROM conversations
  UNION ALL
  SELECT * FROM {values(TABLE_BLOCKS, ['doc', 'page', 'y', 'kind', 'text'], ['BIGINT', 'BIGINT', 'BIGINT', 'VARCHAR', 'VARCHAR'])}
),
kept AS (SELECT * FROM blocks b WHERE NOT EXISTS (
  SELECT 1 FROM {values(MERGED_PAGES, ['doc', 'page'], ['BIGINT', 'BIGINT'])} m WHERE m.doc = b.doc AND m.page = b.page))
SELECT doc, page, string_agg(text, chr(10) ORDER BY y, kind, text) AS content FROM kept GROUP BY doc, page""")
def q_page_layout(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"),
                     F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    blocks = lines.select("doc", "page", ((F.col("pos") + 1) * 10).cast("bigint").alias("y"),
                          F.lit("text").alias("kind"), "text")
    tables = spark.createDataFrame(TABLE_BLOCKS, "doc long, page long, y long, kind string, text string")
    skip = spark.createDataFrame(MERGED_PAGES, "doc long, page long")
    return H.page_layout(blocks.unionByName(tables), skip)


# --- H4 → H5: from cells to page text ----------------------------------------------
# Orders as the rows of documents' tables: a third of them are one document. A table part is
# a page of 20 rows; its header changes every third page, and every seventh page ends early.
PART_LINES = 20
CELL_COLS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_DOC_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + (o_orderkey % 40) END"
CELLS_SQL = f"""cell AS (
  SELECT *, ((rn - 1) // {PART_LINES})::BIGINT AS page, ((rn - 1) % {PART_LINES})::BIGINT AS row FROM (
    SELECT {_DOC_SQL} AS doc, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY {_DOC_SQL} ORDER BY o_orderkey) AS rn
    FROM orders)
),
part AS (
  SELECT doc, page, 'h' || (page // 3)::VARCHAR AS header, CASE WHEN page % 7 = 6 THEN 300.0 ELSE 120.0 + 20 * count(*) END AS y_bottom
  FROM cell GROUP BY doc, page
),
flag AS (
  SELECT *, CASE WHEN lag(page) OVER w = page - 1 AND lag(header) OVER w = header AND {PAGE_HEIGHT} - lag(y_bottom) OVER w <= 100
            THEN 0 ELSE 1 END AS brk FROM part WINDOW w AS (PARTITION BY doc ORDER BY page)
),
run AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM flag),
tabled AS (SELECT doc, page, min(page) OVER (PARTITION BY doc, grp) AS table_page FROM run),
lined AS (
  SELECT c.doc, t.table_page, '|' || concat_ws('|', c.o_orderkey::VARCHAR, replace(coalesce(o_orderstatus, ''), ' ', ''),
           replace(coalesce(o_totalprice::VARCHAR, ''), ' ', '')) || '|' AS line,
         row_number() OVER (PARTITION BY c.doc, t.table_page ORDER BY c.page, c.row) AS n
  FROM cell c JOIN tabled t ON t.doc = c.doc AND t.page = c.page
),
md AS (
  SELECT doc, table_page, ((n - 1) // {PAGE_ROWS})::BIGINT AS piece, '|{"|".join(CELL_COLS)}|' || chr(10) || '|---|---|---|' || chr(10)
         || string_agg(line, chr(10) ORDER BY n) AS markdown
  FROM lined GROUP BY doc, table_page, (n - 1) // {PAGE_ROWS}
),
block AS (
  SELECT doc, page, 10 AS y, 'above ' || doc::VARCHAR || '.' || page::VARCHAR AS text FROM part
  UNION ALL SELECT doc, table_page, 100 + piece, markdown FROM md
  UNION ALL SELECT doc, page, 590000, 'below ' || doc::VARCHAR || '.' || page::VARCHAR FROM part
)"""


def table_cells(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").withColumn(
        "doc", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1 + F.col("o_orderkey") % 40).cast("long"))
    n = group_row_number(o, ["doc"], ["o_orderkey"], "rn")
    return n.select("doc", F.floor((F.col("rn") - 1) / PART_LINES).cast("long").alias("page"),
                    ((F.col("rn") - 1) % PART_LINES).cast("long").alias("row"), *CELL_COLS)


def cell_parts(cells):
    return cells.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")).select(
        "doc", "page", F.concat(F.lit("h"), F.floor(F.col("page") / 3).cast("string")).alias("header"),
        F.when(F.col("page") % 7 == 6, 300.0).otherwise(120.0 + 20 * F.col("n")).alias("y_bottom"),
        F.lit(float(PAGE_HEIGHT)).alias("page_height"))


@register("document_pages", sql=f"""WITH {CELLS_SQL}
SELECT b.doc, b.page, string_agg(b.text, chr(10) ORDER BY y, text) AS content FROM block b JOIN tabled t ON t.doc = b.doc AND t.page = b.page
WHERE t.table_page = t.page GROUP BY b.doc, b.page""")
def q_document_pages(spark, sf_dir):
    """Cells to page text: parts that continue a table are found, their rows joined and
    rendered on the table's first page, and their own pages skipped."""
    cells = _checkpointed(table_cells(spark, sf_dir))
    parts = _checkpointed(H.merge_continued(cell_parts(cells)))
    tables = H.merged_tables(cells, parts, CELL_COLS, PAGE_ROWS)
    line = lambda y, word: parts.select("doc", "page", F.lit(y).cast("long").alias("y"), F.lit("text").alias("kind"), F.concat(
        F.lit(word + " "), F.col("doc").cast("string"), F.lit("."), F.col("page").cast("string")).alias("text"))
    blocks = (line(10, "above").unionByName(tables.select("doc", "page", (100 + F.col("piece")).alias("y"), F.lit("table").alias("kind"),
                                                           F.col("markdown").alias("text"))).unionByName(line(590000, "below")))
    return H.page_layout(blocks, parts.filter("table_page < page"))


# --- I1 / I2 ------------------------------------------------------------------------
@register("dialogue_log", sql="""WITH p AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')
SELECT conv_id, turn, 'glm-4' AS model, 0::BIGINT AS seq, 'User: ' AS speaker, question AS text FROM p
UNION ALL
SELECT conv_id, turn, 'glm-4', 1::BIGINT, 'Model (glm-4): ', answer FROM p""")
def q_dialogue_log(spark, sf_dir):
    pairs = dialogue_pairs(load_table(spark, sf_dir, "conversations")).filter(F.col("answer").isNotNull())
    return I.dialogue_log(pairs, ["glm-4"])


@register("history_window", sql="""SELECT conv_id, turn, (count(*) OVER w)::BIGINT AS n_prev,
       md5(coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '')) AS history_md5
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_history_window(spark, sf_dir):
    h = I.history(load_table(spark, sf_dir, "conversations"))
    return h.select("conv_id", "turn", "n_prev", F.md5("history").alias("history_md5"))


RECENT_CHARS = 1000


@register("history_recent", sql=f"""WITH t AS (
  SELECT conv_id, turn, role || ': ' || text AS line, length(role || ': ' || text) + 1 AS n FROM conversations),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT a.conv_id, a.turn, count(b.line)::BIGINT AS n_prev, md5(coalesce(string_agg(b.line, chr(10) ORDER BY b.turn), '')) AS history_md5
FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn < a.turn AND a.before - b.before <= {RECENT_CHARS}
GROUP BY a.conv_id, a.turn""")
def q_history_recent(spark, sf_dir):
    h = I.recent_history(load_table(spark, sf_dir, "conversations"), RECENT_CHARS)
    return h.select("conv_id", "turn", "n_prev", F.md5("history").alias("history_md5"))


# --- I3 ------------------------------------------------------------------------------
LINE_SQL = """concat_ws(' - ', strftime(ts, '%Y-%m-%d %H:%M:%S'), 'quarry', upper(event_type), props)"""


@register("log_lines", sql=f"""SELECT event_id, {LINE_SQL} AS line FROM events""")
def q_log_lines(spark, sf_dir):
    return I.render_log_lines(load_table(spark, sf_dir, "events"))


def parsed_logs(spark, sf_dir):
    return I.parse_log_lines(I.render_log_lines(load_table(spark, sf_dir, "events")))


@register("log_daily", sql="""SELECT date_trunc('second', ts)::DATE AS day, upper(event_type) AS level,
       count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def q_log_daily(spark, sf_dir):
    return I.daily_counts(parsed_logs(spark, sf_dir), "time", "level")


@register("log_errors", sql="""SELECT ts::DATE AS day, count(*)::BIGINT AS n FROM events
WHERE upper(event_type) = 'ERROR' GROUP BY 1""")
def q_log_errors(spark, sf_dir):
    logs = parsed_logs(spark, sf_dir).filter(F.col("level") == "ERROR")
    return I.daily_counts(logs, "time", "level").select("day", "n")


def _retention_sql(days: int) -> str:
    return f"""SELECT date_trunc('second', ts)::DATE AS day, count(*)::BIGINT AS n FROM events
WHERE date_trunc('second', ts) >= (SELECT max(date_trunc('second', ts)) FROM events) - INTERVAL {days} DAY
GROUP BY 1"""


@register("log_retention", sql=_retention_sql(RETENTION_DAYS))
def q_log_retention(spark, sf_dir):
    logs = I.retained(parsed_logs(spark, sf_dir), "time", RETENTION_DAYS)
    return I.daily_counts(logs, "time", "level").groupBy("day").agg(F.sum("n").cast("bigint").alias("n"))


@register("log_retention_7d", sql=_retention_sql(SHORT_RETENTION))
def q_log_retention_7d(spark, sf_dir):
    logs = I.retained(parsed_logs(spark, sf_dir), "time", SHORT_RETENTION)
    return I.daily_counts(logs, "time", "level").groupBy("day").agg(F.sum("n").cast("bigint").alias("n"))


@register("log_files", sql=f"""SELECT event_id, ts::DATE AS day, upper(event_type) AS level,
  props || CASE WHEN ts::DATE >= (SELECT max(ts)::DATE FROM events) - 2 THEN ' #2' ELSE '' END AS message
FROM events WHERE ts::DATE > (SELECT max(ts)::DATE FROM events) - {SHORT_RETENTION} AND upper(event_type) <> 'VIEW'""")
def q_log_files(spark, sf_dir):
    """Log files by day and level, written twice (the second run brings the last three days
    anew), old days deleted whole, and the days and levels asked for read back."""
    path = shared_dir(spark, "log-files")
    logs = parsed_logs(spark, sf_dir).withColumn("day", F.to_date("time"))
    I.write_log_files(logs, path)
    newest = logs.agg(F.max("day")).first()[0]
    again = logs.filter(F.col("day") >= F.lit(newest) - F.expr("INTERVAL 2 DAYS")).withColumn("message", F.concat("message", F.lit(" #2")))
    I.write_log_files(again, path)
    I.expire_log_files(spark, path, SHORT_RETENTION)
    return I.read_log_files(spark, path).filter("level != 'VIEW'").select("event_id", "day", "level", "message")
