"""Dialogue log, history and log-table operators."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.fixed import MODEL_SPEAKER_FMT, USER_SPEAKER
from quarry.plans.strategy import _checkpointed, group_running_sum


def dialogue_log(pairs: DataFrame, models, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per answer and model, a ``User: `` entry then a ``Model (m): ``
    entry (I1), keyed by conversation instead of a process-global list."""
    prefix, suffix = MODEL_SPEAKER_FMT.split("{model}")
    entries = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit(USER_SPEAKER).alias("speaker"), F.col("question").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit(prefix), F.col("model"), F.lit(suffix)).alias("speaker"),
                 F.col("answer").alias("text")))
    x = pairs.select(conv, turn, "question", "answer", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return x.select(conv, turn, "model", F.explode(entries).alias("e")).select(
        conv, turn, "model", F.col("e.seq").cast("bigint").alias("seq"), "e.speaker", "e.text")


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """History so far per turn (I2): earlier turns of the conversation as
    ``role: text`` lines. One conversation is one window partition; its
    length is bounded by the model context the history feeds."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.collect_list(F.struct(turn, F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line"))).over(w)
    return turns.select(conv, turn, F.size(prev).cast("bigint").alias("n_prev"),
                        F.array_join(F.transform(F.array_sort(prev), lambda x: x.getField("line")), "\n")
                        .alias("history"))


def recent_history(turns: DataFrame, most: int, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """The last earlier turns of a conversation that fit in ``most`` characters (I2), as
    ``role: text`` lines of which each counts one more for its end:
    ``(conv, turn, n_prev, history)``.

    By running lengths (distributed, with a carry) a turn needs the lines that
    begin at most ``most`` before it, so it meets lines of its own stretch of that length and
    of the one before, by an equi-join on (conversation, stretch). What a turn gets is
    bounded by ``most``, so the result is linear however long the conversation."""
    line = F.concat(F.col(role), F.lit(": "), F.col(text))
    x = group_running_sum(turns.select(conv, turn, line.alias("_line")), [conv], [turn], F.length("_line") + 1, "_at")
    x = x.withColumn("_b", F.floor(F.col("_at") / most).cast("long"))
    x = _checkpointed(x)
    asks = x.select(conv, turn, "_at", F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"))
    lines = x.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.col("_at").alias("_s"), "_b", "_line")
    near = asks.join(lines, asks[conv].eqNullSafe(lines["_c"]) & (asks["_b"] == lines["_b"])).filter(
        (F.col("_t") < F.col(turn)) & (F.col("_at") - F.col("_s") <= most))
    got = near.groupBy(conv, turn).agg(F.array_sort(F.collect_list(F.struct("_t", "_line"))).alias("_h"))
    return x.select(conv, turn).join(got, [conv, turn], "left").select(
        conv, turn, F.coalesce(F.size("_h"), F.lit(0)).cast("bigint").alias("n_prev"),
        F.coalesce(F.array_join(F.transform("_h", lambda h: h["_line"]), "\n"), F.lit("")).alias("history"))


def render_log_lines(events: DataFrame, name: str = "quarry") -> DataFrame:
    """``{time} - {name} - {level} - {message}`` lines."""
    line = F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(name),
                       F.upper("event_type"), F.col("props"))
    return events.select("event_id", line.alias("line"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Back to a log table: ``(event_id, time, name, level, message)``."""
    parts = F.split(F.col("line"), " - ", 4)
    return lines.select("event_id", F.to_timestamp_ntz(parts[0], F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"),
                        parts[1].alias("name"), parts[2].alias("level"), parts[3].alias("message"))


def daily_counts(logs: DataFrame, ts: str, level: str) -> DataFrame:
    """Rows per day and level (I3's day files)."""
    return logs.groupBy(F.to_date(ts).alias("day"), F.col(level).alias("level")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def retained(logs: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows within ``days`` of the newest row (retention); the newest time
    is a scalar subquery."""
    newest = logs.agg(F.max(ts)).scalar()
    return logs.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def write_log_files(logs: DataFrame, path: str) -> None:
    """Log rows under ``day=<d>/level=<l>`` (I3): a run replaces the (day, level) folders it
    has rows for and leaves the others."""
    (logs.repartition("day", "level").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "level").parquet(path))


def expire_log_files(spark: SparkSession, path: str, days: int) -> int:
    """Delete the day folders that are ``days`` or more older than the newest; how many."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {s.getPath().getName().removeprefix("day="): s.getPath() for s in fs.listStatus(p)
             if s.getPath().getName().startswith("day=")}
    if not found:
        return 0
    keep = datetime.date.fromisoformat(max(found)) - datetime.timedelta(days=days)
    old = [q for d, q in found.items() if datetime.date.fromisoformat(d) <= keep]
    return sum(bool(fs.delete(q, True)) for q in old)


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """The log rows; filters on ``day`` and ``level`` prune folders."""
    return spark.read.schema("event_id long, time timestamp_ntz, name string, message string, day date, level string").parquet(path)
