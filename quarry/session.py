"""Session construction, table loading and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "quarry") -> SparkSession:
    """Session for tests and the bench. On a cluster the submitter's
    session is used as is; nothing here is required by the operators."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; the scan stays lazy so Catalyst can prune
    columns and push filters into the parquet reader.

    A session over a few small files, like the bench's, may ask for its scans
    to be spread over ``quarry.read.partitions`` tasks; by default none is.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get("quarry.read.partitions", None)
    return df.repartition(int(spread)) if spread else df


_CREATED: list[str] = []


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location comes from ``spark.checkpoint.dir`` as configured for the
    session, else from the context's checkpoint folder. Where neither is set, a
    local session gets a temporary folder of its own; on a cluster that
    would be a folder of the driver alone, so it is an error there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    path = "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])
    _CREATED.append(path)
    return path


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` as parquet; the shuffle files behind it go once it is written."""
    spark = df.sparkSession
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete the ``materialized`` tables that were made inside; nothing lazy may read them
    after. Stores and other folders stay."""
    before = set(_CREATED)
    yield
    for path in [p for p in _CREATED if p not in before and p.split("/")[-2] == "materialized"]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _CREATED.remove(path)


def release_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate folders (indexes, materialised steps, stream
    sinks and checkpoints) that this process created under the shared
    folder. Call it once the results built on them have been consumed;
    DataFrames that still read those folders stop working afterwards.
    Returns the number of folders removed. Uses the Hadoop FileSystem of
    each path, so it works for cluster storage as well as local disk."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _CREATED:
        p = jvm.org.apache.hadoop.fs.Path(_CREATED.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p) and fs.delete(p, True):
            removed += 1
    return removed
