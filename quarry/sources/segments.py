"""Append-only tables of segments, with a manifest that says which are live.

A store is a folder of tables; every append writes its rows under
``<table>/segment=<name>`` and then commits a new manifest version, a small file
that lists the live segments with the facts a reader needs (counts, batch names).
Readers take the newest manifest, so they see an append whole or not at all, and a
compaction replaces segments in one commit. The file is created without overwriting:
of two writers at one version the second fails and may try again.

A batch has a name; appending a batch that is live already changes nothing, so a
repeated delivery or a replayed job is harmless.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest version: {"version", "facts", "segments": {name: facts}}."""
        p, fs = self._file("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        versions = sorted(n for n in names if n.endswith(".json"))
        if not versions:
            return {"version": 0, "facts": {}, "segments": {}}
        p, fs = self._file("manifest", versions[-1])
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, at: dict, add: dict | None = None, drop=(), facts: dict | None = None) -> None:
        """The version after ``at``, with the segments ``add`` and without ``drop``."""
        live = {k: v for k, v in at["segments"].items() if k not in set(drop)} | (add or {})
        new = {"version": at["version"] + 1, "facts": at["facts"] | (facts or {}), "segments": live}
        p, fs = self._file("manifest", f"{new['version']:08d}.json")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()

    @staticmethod
    def new_name() -> str:
        return uuid.uuid4().hex[:16]

    def folder(self, table: str, segment: str) -> str:
        return f"{self.path}/{table}/segment={segment}"

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of the live segments, with their ``segment``."""
        live = sorted(self.manifest()["segments"])
        if not live:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return (self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.path}/{table}")
                .parquet(*[self.folder(table, s) for s in live]))

    def vacuum(self, *tables: str) -> int:
        """Delete the folders of segments that are not live; how many."""
        live, gone = set(self.manifest()["segments"]), 0
        for t in tables:
            p, fs = self._file(t)
            for s in (fs.listStatus(p) if fs.exists(p) else []):
                name = s.getPath().getName()
                if name.startswith("segment=") and name.removeprefix("segment=") not in live:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone

    def drop(self) -> None:
        p, fs = self._file("")
        fs.delete(p, True)

    def exists(self) -> bool:
        p, fs = self._file("manifest")
        return bool(fs.exists(p))
