"""File sources and sinks.

Readers return DataFrames with a ``source`` column taken from the file
path; writers use Spark's own sinks. Paths default to fresh folders under
the shared checkpoint location (``quarry.session.shared_dir``).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.strategy import group_running_sum

# --- A3 ----------------------------------------------------------------------------


PART_CHARS = 1 << 28


def write_text_files(df: DataFrame, path: str, group: str, text: str, order: str, most: int = PART_CHARS) -> None:
    """UTF-8 text files under ``path/group=<value>/part=<n>/``: the rows of a ``group``
    value in ``order``, one per line, a new file after every ``most`` characters or the
    row that reaches them. Part numbers come from distributed running lengths, so a large
    source is written by many tasks, and no file is beyond ``most`` and a row."""
    size = F.coalesce(F.length(text), F.lit(0)) + 1
    x = group_running_sum(df.select(group, text, order), [group], [order], size, "_at")
    (x.withColumn("part", F.floor(F.col("_at") / most).cast("long")).repartition(group, "part")
     .sortWithinPartitions(group, "part", order)
     .select(group, "part", text).write.mode("overwrite").partitionBy(group, "part").text(path))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one document: ``(source, content)``; source is the
    file path (A3). Files that ``write_text_files`` wrote are of bounded size; a source's
    parts are put together only by who asks for it. Spark counts a file as some MB at
    least, so small files would be a task for every few: tasks are as many as their bytes fill,
    or as a shuffle has if those are more. Folders are listed by as many tasks, not one each."""
    tasks, listing = int(spark.conf.get("spark.sql.shuffle.partitions")), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, str(tasks))
    try:
        whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    finally:
        spark.conf.set(listing, before)
    size = int(whole._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return (whole.coalesce(max(tasks, -(-size // full)))
            .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content")))


# --- A5 ----------------------------------------------------------------------------
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DOCX_CT = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/word/document.xml" ContentType="application/'
            'vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
_DOCX_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
              '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
              '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
              'relationships/officeDocument" Target="word/document.xml"/></Relationships>')


def docx_bytes(text: str) -> bytes:
    """A minimal DOCX holding ``text``, one paragraph per line."""
    paras = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
                    for line in text.split("\n"))
    doc = (f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           f'<w:document xmlns:w="{_W}"><w:body>{paras}</w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _DOCX_CT)
        z.writestr("_rels/.rels", _DOCX_RELS)
        z.writestr("word/document.xml", doc)
    return buf.getvalue()


_PARA = re.compile(r"<w:p[ >].*?</w:p>|<w:p/>", re.S)
_TEXT = re.compile(r"<w:t(?: [^>]*)?>(.*?)</w:t>|<w:tab/>|<w:br/>", re.S)


def docx_text(data: bytes) -> str:
    """Paragraph texts of a DOCX joined by newlines (tabs and breaks kept)."""
    from xml.sax.saxutils import unescape
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    out = []
    for p in _PARA.findall(xml):
        parts = []
        for m in _TEXT.finditer(p):
            tok = m.group(0)
            if tok == "<w:tab/>":
                parts.append("\t")
            elif tok == "<w:br/>":
                parts.append("\n")
            else:
                parts.append(unescape(m.group(1), {"&quot;": '"', "&apos;": "'"}))
        out.append("".join(parts))
    return "\n".join(out)


_DOCUMENT = T.StructType([T.StructField("source", T.StringType()), T.StructField("content", T.StringType())])


def write_docx_rows(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """One row ``(path, content)`` per row of ``df``, the name ``<name>.docx`` and a
    DOCX's bytes, written by Spark: ``path`` may be on any store it can write."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["name"] + ".docx", "content": [docx_bytes(t or "") for t in pdf["text"]]})
    (df.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text"))
     .mapInPandas(run, "path string, content binary").write.mode("overwrite").parquet(path))


def _unzipped(raw: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["path"], "content": [docx_text(b) for b in pdf["content"]]})
    return raw.select("path", "content").mapInPandas(run, _DOCUMENT)


def read_docx_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(source, content)`` of each row that ``write_docx_rows`` wrote."""
    return _unzipped(spark.read.schema("path string, content binary").parquet(path))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``(source, content)`` for each ``*.docx`` under ``path``: the binary
    files are read by Spark and unzipped in Arrow batches on executors."""
    return _unzipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx")
                     .option("recursiveFileLookup", "true").load(path))


# --- A10 / A13 -------------------------------------------------------------------------
def write_json_records(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 kept as is."""
    df.write.mode("overwrite").json(path)


def read_json_records(spark: SparkSession, path: str, schema: str | None = None,
                      multiline: bool = False) -> DataFrame:
    """JSON records (A10); ``multiline=True`` reads files holding one JSON
    array of records."""
    r = spark.read.option("multiLine", str(multiline).lower())
    if schema:
        r = r.schema(schema)
    return r.json(path)


def json_array_elements(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The elements of JSON arrays in a column (A10, M7), and what cannot be used.

    Elements: the other columns and ``pos`` (0-based), ``kind`` ('string' or 'record'),
    ``title`` (null for a string) and ``content``. Rejects: the other columns, ``pos`` (null
    for a text that is no array), ``reason`` and ``raw``. Strings and records may be mixed."""
    keep = [c for c in df.columns if c != text]
    v = df.withColumn("_v", F.try_parse_json(text)).withColumn("_a", F.try_variant_get("_v", "$", "array<variant>"))
    bad = v.filter(F.col("_a").isNull()).select(*keep, F.lit(None).cast("int").alias("pos"), F.lit("not an array").alias("reason"),
                                                F.col(text).alias("raw"))
    e = v.filter(F.col("_a").isNotNull()).select(*keep, F.posexplode("_a").alias("pos", "e")).withColumn("t", F.schema_of_variant("e"))
    record, string = F.col("t").startswith("OBJECT"), F.col("t") == "STRING"
    content = F.when(string, F.try_variant_get("e", "$", "string")).when(record, F.try_variant_get("e", "$.content", "string"))
    e = e.select(*keep, "pos", F.when(string, "string").when(record, "record").alias("kind"),
                 F.when(record, F.try_variant_get("e", "$.title", "string")).alias("title"), content.alias("content"),
                 F.to_json("e").alias("raw"))
    why = F.when(F.col("kind").isNull(), "neither string nor record").otherwise("no content")
    rejects = e.filter(F.col("kind").isNull() | F.col("content").isNull()).select(*keep, "pos", why.alias("reason"), "raw")
    return e.filter(F.col("kind").isNotNull() & F.col("content").isNotNull()).drop("raw"), bad.unionByName(rejects)


# --- A11 / A12 -------------------------------------------------------------------------
def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV/TSV with a header; every field quoted so embedded newlines,
    quotes and separators survive (A12)."""
    (df.write.mode("overwrite").option("header", "true").option("sep", sep)
     .option("quoteAll", "true").option("escape", '"').csv(path))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV/TSV with header, multi-line quoted fields."""
    r = (spark.read.option("header", "true").option("sep", sep).option("multiLine", "true")
         .option("escape", '"'))
    if schema:
        r = r.schema(schema)
    return r.csv(path)


# --- A14-A17 ---------------------------------------------------------------------------------
LEXICAL_SCHEMA = ("source STRING, doc_id BIGINT, cont_id INT, content STRING, file_type STRING, "
                  "insert_time TIMESTAMP")
VECTOR_SCHEMA = "pk BIGINT, source STRING, text STRING, embeddings ARRAY<FLOAT>"


def create_store_tables(spark: SparkSession, prefix: str, location: str) -> tuple[str, str]:
    """Create the lexical and vector tables if absent, with explicit
    schemas (A17). Returns their names."""
    lex, vec = f"{prefix}_docs", f"{prefix}_vectors"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {lex} ({LEXICAL_SCHEMA}) USING parquet "
              f"LOCATION '{location}/{lex}'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {vec} ({VECTOR_SCHEMA}) USING parquet "
              f"LOCATION '{location}/{vec}'")
    return lex, vec


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a store table with its files."""
    path = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def append_chunks(chunks: DataFrame, table: str, file_type: str) -> None:
    """Bulk append to the lexical table with an insert time."""
    (chunks.select("source", "doc_id", F.col("cont_id").cast("int"), "content",
                   F.lit(file_type).alias("file_type"), F.current_timestamp().alias("insert_time"))
     .write.mode("append").insertInto(table))


def append_vectors(rows: DataFrame, table: str) -> None:
    """Append to the vector table."""
    (rows.select(F.col("pk").cast("bigint"), "source", "text",
                 F.col("embeddings").cast("array<float>"))
     .write.mode("append").insertInto(table))


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE {table}")
