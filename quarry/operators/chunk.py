"""Splitting documents into chunks.

All forms are map-only: a document's chunks are produced in the task that
reads the document, so chunking never shuffles, and a single huge
document costs one task's time rather than a driver round trip.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.fixed import CHUNK_OVERLAP, CHUNK_SIZE

RUN = 64  # documents whose chunks a task holds at once
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")


def chunk_windows(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                  keep=("doc_id", "source")) -> DataFrame:
    """Fixed character windows (the splitter's fallback for text without
    separators). ``cont_id`` counts 1..n within a document (C5)."""
    # one pass over the text: a window is the next run of up to ``size`` characters
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return (docs.select(*keep, F.posexplode(pieces).alias("pos", "content"))
            .select(*keep, (F.col("pos") + 1).cast("bigint").alias("cont_id"), "content"))


def chunk_lines(docs: DataFrame, text_col: str = "text", keep=("doc_id", "source")) -> DataFrame:
    """Line-level chunks: split on LF, drop empty lines, strip stray CR/LF
    from the content (B5). ``line_no`` is the 1-based line position."""
    return (docs.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
            .filter(F.length("line") > 0)
            .select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"),
                    F.replace(F.col("line"), F.lit("\n"), F.lit("")).alias("content")))


# ---------------------------------------------------------------------------
# Recursive character splitter (C1), per-row helper used inside mapInPandas.
# Contract: pick the first separator (paragraph, line, space, character) that
# occurs in the text; split keeping the separator at the start of the next
# piece; pieces shorter than the limit are packed greedily (joined with no
# extra text, then whitespace-stripped); longer pieces are split again with
# the remaining separators. Overlap is carried back up to ``overlap`` chars.
# ---------------------------------------------------------------------------

def _pieces(text: str, sep: str) -> list[str]:
    if sep == "":
        return [ch for ch in text]
    parts = re.split("(" + re.escape(sep) + ")", text)
    out = [parts[0]]
    for i in range(1, len(parts) - 1, 2):
        out.append(parts[i] + parts[i + 1])
    return [p for p in out if p != ""]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    chunks: list[str] = []
    window: list[str] = []
    total = 0
    for piece in pieces:
        n = len(piece)
        if window and total + n > size:
            joined = "".join(window).strip()
            if joined:
                chunks.append(joined)
            while window and (total > overlap or total + n > size):
                total -= len(window[0])
                window.pop(0)
        window.append(piece)
        total += n
    joined = "".join(window).strip()
    if joined:
        chunks.append(joined)
    return chunks


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=DEFAULT_SEPARATORS) -> list[str]:
    if not text:
        return []
    sep, rest = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, tuple(separators[i + 1:])
            break
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, sep):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out.extend(_pack(short, size, overlap))
            short = []
        if rest:
            out.extend(split_recursive(piece, size, overlap, rest))
        else:
            out.append(piece)
    if short:
        out.extend(_pack(short, size, overlap))
    return out


def chunk_recursive(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP, keep=("doc_id", "source")) -> DataFrame:
    """Recursive splitter as an Arrow-batched ``mapInPandas`` over document
    partitions; output ``(keep..., cont_id, content)``. Sequential packing
    has no built-in equivalent, so this is the one Python step of ingest."""
    keep = list(keep)
    in_schema = docs.select(*keep).schema
    out_schema = T.StructType(list(in_schema.fields) + [
        T.StructField("cont_id", T.LongType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[lo: lo + RUN] for whole in batches for lo in range(0, max(1, len(whole)), RUN)):
            rows = {c: [] for c in keep}
            ids, contents = [], []
            texts = pdf[text_col].tolist()
            for i, text in enumerate(texts):
                pieces = split_recursive(text or "", size, overlap)
                for j, piece in enumerate(pieces):
                    for c in keep:
                        rows[c].append(pdf[c].iat[i])
                    ids.append(j + 1)
                    contents.append(piece)
            cols = {c: pd.Series(rows[c], dtype=pdf[c].dtype if len(rows[c]) else "object") for c in keep}
            cols["cont_id"] = pd.Series(ids, dtype="int64")
            cols["content"] = pd.Series(contents, dtype="object")
            yield pd.DataFrame(cols)

    return docs.select(*keep, text_col).mapInPandas(run, out_schema)
