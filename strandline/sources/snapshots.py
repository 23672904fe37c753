"""Keyed tables as versioned snapshots of Parquet, for sinks that may see a batch again.

A version is one small file that says where each part of the table lies and, for each writer, the last batch that it
holds. A batch merges into the parts that it touches only, writes them anew beside the old ones, and becomes the next
version by one rename that can't replace a file. A batch that the ledger has is left out; a crash before the rename
leaves the table as it was, and the batch is merged again. Readers see whole versions.

The parts are made by an expression on the keys (a day, for market tables), so the cost of a batch follows the rows of
the parts that it touches. One version is a line a part: parts grow with the days held, not with the rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.state import merge


class Store:
    """Small files on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(folder))) if self._fs().exists(self._path(folder)) else []

    def read(self, name: str) -> str | None:
        if not self._fs().exists(self._path(name)):
            return None
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; False where another writer was first. The file appears whole or not at all."""
        draft = self._path(f"_draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs().mkdirs(self._path(name).getParent())
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf)
            plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(self._path(name)), plain)
            return True
        except Exception:
            if self._fs().exists(self._path(name)):
                return False
            raise
        finally:
            self._fs().delete(draft, False)

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


class SnapshotTable:
    """A table of one row a key under ``root``.

    ``rules`` say how a column is merged (``state.merge``); ``part`` is a SQL expression on the keys that deals rows to
    parts; ``time`` is the column that the rule ``latest`` goes by.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], rules: dict[str, str], part: str = "date_format(time, 'yyyyMMdd')", time: str | None = None):
        self.spark, self.store, self.root = spark, Store(spark, root), root.rstrip("/")
        self.empty = spark.createDataFrame([], schema)
        self.keys, self.rules, self.part, self.time = keys, rules, part, time

    def version(self) -> dict:
        """The newest version: its number, the folder of each part and the last batch of each writer."""
        names = self.store.names("versions")
        return json.loads(self.store.read(f"versions/{names[-1]}")) if names else {"version": 0, "parts": {}, "batches": {}}

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows of the newest version; only those of some ``parts`` if given."""
        held = self.version()["parts"]
        return self._rows([held[p] for p in (held if parts is None else parts) if p in held])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.empty
        return self.spark.read.schema(self.empty.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def upsert(self, delta: DataFrame, writer: str, batch: int, before_switch=None) -> bool:
        """Merge ``delta`` (one row a key) as the ``batch`` of ``writer``; False if the table holds it already.

        Batches of a writer have rising numbers. ``before_switch`` is called between write and switch (tests).
        """
        delta = delta.select(*self.empty.columns).persist()
        try:
            return self._upsert(delta, writer, batch, before_switch)
        finally:
            delta.unpersist()

    def _upsert(self, delta: DataFrame, writer: str, batch: int, before_switch) -> bool:
        while True:
            now = self.version()
            if now["batches"].get(writer, -1) >= batch:
                return False
            name = f"data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
            dealt = F.coalesce(F.expr(self.part).cast("string"), F.lit("none"))
            touched = [r[0] for r in delta.select(dealt).distinct().collect()]
            if touched:
                base = self._rows([now["parts"][p] for p in touched if p in now["parts"]])
                merged = merge(base, delta, self.keys, self.rules, self.time).select(*self.empty.columns)
                merged.withColumn("_part", dealt).repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/{name}")
            if before_switch:
                before_switch()
            made = {"version": now["version"] + 1, "parts": now["parts"] | {p: f"{name}/_part={p}" for p in touched}, "batches": now["batches"] | {writer: batch}}
            if self.store.create(f"versions/{made['version']:012d}.json", json.dumps(made)):
                return True
            # Another writer was first: merge again onto its version.

    def vacuum(self, keep: int = 2) -> None:
        """Drop old versions but the last ``keep``, and data that none of the kept refers to. For times without writers."""
        names = self.store.names("versions")
        for name in names[:-keep]:
            self.store.delete(f"versions/{name}")
        used = {f.split("/")[1] for name in names[-keep:] for f in json.loads(self.store.read(f"versions/{name}"))["parts"].values()}
        for folder in self.store.names("data"):
            if folder not in used:
                self.store.delete(f"data/{folder}")
