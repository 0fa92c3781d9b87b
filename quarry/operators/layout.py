"""Extracted-table operators (H1-H5): the input is a table of cells or
blocks, not PDF bytes (byte decoding is outside the engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import TABLE_BOTTOM_GAP
from quarry.plans.strategy import forward_fill, group_row_number, islands, ordered_sessions


def fill_header(cells: DataFrame, table_cols, order_cols, text: str, out: str = "header") -> DataFrame:
    """Empty header cells take the value from their left (H1), then nulls
    become empty strings and newlines are removed (H2). Skew-safe: no
    per-table window (see ``forward_fill``)."""
    filled = forward_fill(cells, table_cols, order_cols, text, "_h")
    return filled.withColumn(out, clean_cell(F.col("_h"))).drop("_h")


def clean_cell(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(""))


def markdown_pages(rows: DataFrame, table_cols, order_col: str, value_cols, page_rows: int = 50) -> DataFrame:
    """Render each table as Markdown pipe tables of ``page_rows`` rows (H3):
    ``|c1|c2|`` header, ``|---|---|`` rule, one ``|v1|v2|`` line per row,
    spaces removed. Row numbers come from a skew-safe numbering, so a
    table with a third of all rows is split into bounded pages."""
    table_cols = list(table_cols)
    n = group_row_number(rows, table_cols, [order_col], "_rn")
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" "), F.lit("")) for c in value_cols]
    line = F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|"))
    n = n.withColumn("page", F.floor((F.col("_rn") - 1) / page_rows).cast("bigint")).withColumn("_line", line)
    header = "|" + "|".join(value_cols) + "|\n|" + "|".join("---" for _ in value_cols) + "|"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_line"))),
                                    lambda x: x.getField("_line")), "\n")
    return n.groupBy(*table_cols, "page").agg(
        F.concat(F.lit(header + "\n"), body).alias("markdown"), F.count(F.lit(1)).cast("bigint").alias("rows"))


def merge_runs(df: DataFrame, part_cols, order_cols, key_col: str) -> DataFrame:
    """Runs of consecutive rows with equal ``key_col`` per group (H4 at
    row level): ``(part..., key, island, first_order..., n)``."""
    x = islands(df, part_cols, order_cols, key_col, "island")
    first = F.min(F.struct(*order_cols)).alias("_first")
    return x.groupBy(*part_cols, key_col, "island").agg(first, F.count(F.lit(1)).cast("bigint").alias("n"))


def merge_continued(parts: DataFrame, doc: str = "doc", page: str = "page", header: str = "header",
                    y_bottom: str = "y_bottom", page_height: str = "page_height",
                    gap: float = TABLE_BOTTOM_GAP) -> DataFrame:
    """Join a table continued on the next page (H4): a part continues the
    previous one when it is on the following page, has an equal header,
    and the previous part ends within ``gap`` of its page bottom. Adds
    ``table_page``, the page of the merged table's first part. No window over a document:
    see ``ordered_sessions``."""
    room = F.col(page_height) - F.col(y_bottom)

    def goes_on(prev: Column) -> Column:
        return (prev["doc"].eqNullSafe(F.col(doc)) & (prev["page"] == F.col(page) - 1)
                & (prev["header"] == F.col(header)) & (prev["room"] <= gap))

    state = [F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(header).alias("header"), room.alias("room")]
    x = ordered_sessions(parts, [doc, page], goes_on, state, "_run", first=page)
    return x.withColumnRenamed(f"{page}_of_run", "table_page").drop("_run")


def merged_tables(cells: DataFrame, parts: DataFrame, value_cols, page_rows: int = 50, doc: str = "doc", page: str = "page",
                  row: str = "row") -> DataFrame:
    """The rows of continued tables concatenated in order and rendered (H4):
    ``(doc, page, piece, markdown)`` with the table's first page, in pieces of
    ``page_rows`` rows. ``cells`` has (doc, page, row, values), ``parts`` a row with
    ``table_page`` for each (doc, page)."""
    x = cells.join(parts.select(doc, page, "table_page"), [doc, page]).withColumn("_ord", F.struct(page, row))
    m = markdown_pages(x.drop(page).withColumnRenamed("table_page", "_tbl"), [doc, "_tbl"], "_ord", value_cols, page_rows)
    return m.select(doc, F.col("_tbl").alias("table_page"), F.col("page").alias("piece"), "markdown").withColumnRenamed("table_page", page)


def page_layout(blocks: DataFrame, skip: DataFrame, doc: str = "doc", page: str = "page",
                y: str = "y", kind: str = "kind", text: str = "text") -> DataFrame:
    """Page text with text and table blocks interleaved by vertical
    position (H5); pages already merged into a continued table are
    skipped (left-anti join)."""
    kept = blocks.join(skip.select(doc, page), [doc, page], "left_anti")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(y, kind, text))),
                                    lambda b: b.getField(text)), "\n")
    return kept.groupBy(doc, page).agg(body.alias("content"))
