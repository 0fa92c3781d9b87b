"""Small shared helpers: tables, intermediate results, column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it
    back: lineage is cut, a lost executor costs nothing already written, and the
    shuffle files behind it go once it is written."""
    spark = df.sparkSession
    path = shared_dir(spark, "llm", what)
    for paths in _scratch:
        paths.append(path)
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing lazy reads it any more."""
    remove(df.sparkSession, [df._llm_path])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of the tables that are materialised inside."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.remove(paths)


def exact(name: str) -> Column:
    """The column of exactly this name, dots and spaces taken literally."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
