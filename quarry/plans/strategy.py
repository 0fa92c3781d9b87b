"""Physical-strategy helpers shared by the operators.

* ``top_k``: per-group top-k as ``row_number() <= k``; Catalyst plans a
  partial WindowGroupLimit before the exchange (map-side top-k), so a hot
  group ships at most k rows per map partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, part_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group in ``order_cols`` order.

    The rank column is 1-based BIGINT. ``order_cols`` must make the order
    total (end with a key) so results are deterministic.
    """
    w = Window.partitionBy(*part_cols).orderBy(*order_cols)
    tmp = f"__rn_{rank_col}"
    return (df.withColumn(tmp, F.row_number().over(w))
            .filter(F.col(tmp) <= F.lit(k))
            .withColumn(rank_col, F.col(tmp).cast("bigint"))
            .drop(tmp))


def rounded(col: Column | str, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits)


def _checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: the lineage is cut and,
    unlike an unpersisted ``checkpoint()``, the plan runs only once."""
    from quarry.session import shared_dir, write_once
    path = shared_dir(df.sparkSession, "materialized")
    write_once(df, path)
    return df.sparkSession.read.parquet(path)


def global_row_number(df: DataFrame, order_cols, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole table without a single-partition
    window: range-partition on the order, number rows inside each
    partition, and add the row count of all earlier partitions (a table
    of one row per partition, broadcast)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # materialised once (reliable checkpoint in the shared checkpoint dir):
    # every branch below must see the same range split
    parted = _checkpointed(df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()))
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)))
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_part", "_local", "_off"))


def group_row_number(df: DataFrame, part_cols, order_cols, name: str = "rn",
                     partitions: int | None = None) -> DataFrame:
    """1-based row number inside each ``part_cols`` group, without a
    per-group window.

    Rows are range-partitioned on (group, order), so a group holding a third
    of the table is spread over many tasks. Each task numbers its rows per
    group; a group that started in earlier tasks gets the row count it has
    there added. Only a task's first group can continue from earlier tasks,
    so the correction table has at most two rows per task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_cols, order_cols = list(part_cols), list(order_cols)
    key = F.struct(*part_cols)
    # materialised once (reliable checkpoint in the shared checkpoint dir):
    # the numbering and the correction table must see the same range split
    parted = _checkpointed(df.repartitionByRange(n, *part_cols, *order_cols)
                           .withColumn("_pid", F.spark_partition_id()).withColumn("_key", key))
    local = parted.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", "_key").orderBy(*order_cols)))
    bounds = parted.groupBy("_pid").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    edge = (parted.join(F.broadcast(bounds), "_pid")
            .filter((F.col("_key") == F.col("_first")) | (F.col("_key") == F.col("_last")))
            .groupBy("_pid", "_key").agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.select("_pid", "_key", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one or two rows per task: bounded by the partition count
    return (local.join(F.broadcast(offsets), ["_pid", "_key"], "left")
            .withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("bigint"))
            .drop("_pid", "_key", "_local", "_off"))


def group_running_sum(df: DataFrame, part_cols, order_cols, value, name: str = "before",
                      partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each group, without a per-group
    window: as ``group_row_number``, with sums in place of counts."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_cols, order_cols = list(part_cols), list(order_cols)
    parted = _checkpointed(df.withColumn("_v", value).repartitionByRange(n, *part_cols, *order_cols)
                           .withColumn("_pid", F.spark_partition_id()).withColumn("_key", F.struct(*part_cols)))
    w = Window.partitionBy("_pid", "_key").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn("_local", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    bounds = parted.groupBy("_pid").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    edge = (parted.join(F.broadcast(bounds), "_pid")
            .filter((F.col("_key") == F.col("_first")) | (F.col("_key") == F.col("_last")))
            .groupBy("_pid", "_key").agg(F.sum("_v").alias("_n")))
    e = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.select("_pid", "_key", F.coalesce(F.sum("_n").over(e), F.lit(0)).alias("_off"))
    # one or two rows per task: bounded by the partition count
    return (local.join(F.broadcast(offsets), ["_pid", "_key"], "left")
            .withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("bigint"))
            .drop("_pid", "_key", "_local", "_off", "_v"))


def ordered_sessions(df: DataFrame, order_cols, continues, state, name: str = "session",
                     first: str | None = None, partitions: int | None = None) -> DataFrame:
    """Number the runs of consecutive rows of one global order: a row goes on with the
    run of the row before it where ``continues(previous, row)`` holds.

    ``state`` lists the columns of the row before that ``continues`` looks at (it gets them
    as a struct). Rows are range-partitioned, so a document with a third of the table is
    many tasks; each task compares neighbours by itself, and its first row with
    the last row of the tasks before it: the carry is one row per task. ``first`` names
    a column whose value at a run's first row is wanted, as ``<first>_of_run``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = list(order_cols)
    parted = _checkpointed(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
                           .withColumn("_state", F.struct(*state)))
    tasks = Window.orderBy("_pid")  # over one row per task
    last = parted.groupBy("_pid").agg(F.max_by("_state", F.struct(*order_cols)).alias("_end"))
    carry = last.select("_pid", F.lag("_end").over(tasks).alias("_carry"))
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    prev = F.coalesce(F.lag("_state").over(w), F.col("_carry"))
    x = parted.join(F.broadcast(carry), "_pid").withColumn("_prev", prev)
    x = x.withColumn("_new", F.when(F.col("_prev").isNotNull() & F.coalesce(continues(F.col("_prev")), F.lit(False)), 0).otherwise(1))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col(first) if first else F.lit(0)
    starts = x.filter("_new = 1").groupBy("_pid").agg(F.count(F.lit(1)).alias("_starts"),
                                                      F.max_by(value, F.struct(*order_cols)).alias("_value"))
    earlier = tasks.rowsBetween(Window.unboundedPreceding, -1)
    before = last.join(F.broadcast(starts), "_pid", "left").select(
        "_pid", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_off"), F.last("_value", True).over(earlier).alias("_open"))
    out = (x.withColumn("_local", F.sum("_new").over(running))
           .withColumn("_own", F.last(F.when(F.col("_new") == 1, value), True).over(running))
           .join(F.broadcast(before), "_pid").withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint")))
    if first:
        out = out.withColumn(f"{first}_of_run", F.when(F.col("_local") > 0, F.col("_own")).otherwise(F.col("_open")))
    return out.drop("_pid", "_state", "_carry", "_prev", "_new", "_local", "_own", "_off", "_open")


def forward_fill(df: DataFrame, part_cols, order_cols, col: str, out: str) -> DataFrame:
    """Last non-null ``col`` at or before each row within its group, as an
    equi-join instead of a per-group window: a null row's fill is the
    non-null row whose rank among non-null rows equals
    ``rank among all rows - rank among null rows``."""
    part_cols = list(part_cols)
    isnull = F.col(col).isNull()
    allr = group_row_number(df.withColumn("_isnull", isnull), part_cols, order_cols, "_rall")
    byk = group_row_number(allr, part_cols + ["_isnull"], order_cols, "_rk")
    # null groups are groups like any other: the join is null-safe
    vals = byk.filter(~F.col("_isnull")).select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(part_cols)], F.col("_rk").alias("_vrk"), F.col(col).alias("_fill"))
    tgt = byk.withColumn("_src", F.when(F.col("_isnull"), F.col("_rall") - F.col("_rk")))
    same = F.col("_src") == F.col("_vrk")
    for i, c in enumerate(part_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return (tgt.join(vals, same, "left").withColumn(out, F.coalesce(F.col(col), F.col("_fill")))
            .drop("_isnull", "_rall", "_rk", "_src", "_fill", "_vrk", *[f"_p{i}" for i in range(len(part_cols))]))


def islands(df: DataFrame, part_cols, order_cols, key_col: str, out: str = "island") -> DataFrame:
    """Runs of consecutive equal ``key_col`` inside each group (gaps and
    islands): ``out`` = rank among all rows − rank among rows of the same
    key, unique per (group, key) run."""
    part_cols = list(part_cols)
    a = group_row_number(df, part_cols, order_cols, "_ra")
    b = group_row_number(a, part_cols + [key_col], order_cols, "_rb")
    return b.withColumn(out, (F.col("_ra") - F.col("_rb")).cast("bigint")).drop("_ra", "_rb")
