"""Structured Streaming forms of ingestion and log counting.

Each job reads a file stream, runs with ``trigger(availableNow=True)``
(process everything present, then stop) and writes to a file sink or
through ``foreachBatch``; checkpoints live under the shared checkpoint
folder, so a restarted job resumes where the last one committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import normalize_newlines
from quarry.operators.chunk import chunk_windows
from quarry.operators.vectors import chunk_key, embed
from quarry.session import shared_dir


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A parquet file stream over one driver table (schema from the files)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(f"{sf_dir}/{table}*.parquet")


def run_available(query_builder, name: str, spark: SparkSession):
    """Start a streaming write, process all available input, stop."""
    q = query_builder.trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents → newline normalisation → chunk windows → parquet
    sink (J1). Returns the sink table as written."""
    out, ckpt = shared_dir(spark, "stream-chunks"), shared_dir(spark, "stream-chunks-ckpt")
    docs = file_stream(spark, sf_dir, "documents").withColumn("text", normalize_newlines("text"))
    chunks = chunk_windows(docs)
    run_available(chunks.writeStream.format("parquet").option("path", out)
                  .option("checkpointLocation", ckpt).outputMode("append"), "stream_ingest", spark)
    return spark.read.parquet(out)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore documents already ingested (J2): stateful ``dropDuplicates`` on
    the document's source and a hash of its text, so a repeated delivery is
    dropped and every different document reaches the sink. The tables carry
    no time, so the state keeps one hash per document for good."""
    out, ckpt = shared_dir(spark, "stream-dedup"), shared_dir(spark, "stream-dedup-ckpt")
    docs = file_stream(spark, sf_dir, "documents").select("source", F.md5("text").alias("text_md5"))
    firsts = docs.dropDuplicates(["source", "text_md5"])
    run_available(firsts.writeStream.format("parquet").option("path", out)
                  .option("checkpointLocation", ckpt).outputMode("append"), "stream_dedup", spark)
    return spark.read.parquet(out)


def ingest_run(spark: SparkSession, source: str, sink: str, checkpoint: str, schema) -> DataFrame:
    """One run over a growing folder (J1, J2): the checkpoint remembers which files
    earlier runs have read; of new rows those whose (source, text hash) the sink has, from this run
    or an earlier one, are dropped. What is remembered is the sink's own key columns, so
    no state grows in the stream. A replayed batch replaces its ``batch=<id>`` folder.
    Returns the sink."""
    keys = ["source", "text_md5"]
    docs = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    rows = docs.select("doc_id", "source", "text", F.md5("text").alias("text_md5"))

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(*keys).agg(F.min(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", *keys, "r.text")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [x.getPath().toString() for x in (fs.listStatus(p) if fs.exists(p) else [])
                   if x.getPath().getName() != f"batch={batch_id}" and x.getPath().getName().startswith("batch=")]
        if earlier:
            new = new.join(spark.read.parquet(*earlier).select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run_available(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), "ingest_run", spark)
    return spark.read.parquet(sink)


def stream_two_sinks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One micro-batch feeds both stores (J3): the same chunks go to the
    lexical table and, encoded, to the vector table, each written under
    ``batch=<id>`` with overwrite so a replayed batch replaces itself."""
    lex_path, vec_path = shared_dir(spark, "stream-lex"), shared_dir(spark, "stream-vec")
    ckpt = shared_dir(spark, "stream-two-ckpt")
    docs = file_stream(spark, sf_dir, "documents")

    def write_both(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_windows(batch)
        chunks.write.mode("overwrite").parquet(f"{lex_path}/batch={batch_id}")
        embed(chunks, "content").select(chunk_key().alias("pk"), "source", F.col("content").alias("text"), "embedding") \
            .write.mode("overwrite").parquet(f"{vec_path}/batch={batch_id}")

    run_available(docs.writeStream.foreachBatch(write_both).option("checkpointLocation", ckpt),
                  "stream_two_sinks", spark)
    return spark.read.parquet(lex_path), spark.read.parquet(vec_path)


def stream_daily_counts(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """Daily event counts per type (J4): event time with a watermark and a
    one-day tumbling window in update mode, so state of closed days is dropped;
    each batch's changed counts are written under ``batch=<id>`` and a day's
    latest batch counts."""
    out, ckpt = shared_dir(spark, "stream-daily"), shared_dir(spark, "stream-daily-ckpt")
    ev = (file_stream(spark, sf_dir, "events")
          .withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), spark.conf.get("spark.sql.session.timeZone")))
          .withWatermark("ts", watermark))
    counts = ev.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))

    tz = spark.conf.get("spark.sql.session.timeZone")

    def overwrite(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(F.from_utc_timestamp(F.col("w.start"), tz))
        batch.select(day.alias("day"), "event_type", F.col("n").cast("bigint").alias("n")) \
            .write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(counts.writeStream.outputMode("update").foreachBatch(overwrite)
                  .option("checkpointLocation", ckpt), "stream_daily_counts", spark)
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
