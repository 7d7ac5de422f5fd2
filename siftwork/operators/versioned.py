"""Keyed tables on a file system with atomic versions.

A version is a small file in the table's ``log`` folder that names, for each
bucket of keys, the folder with its rows.  A writer first writes the buckets it
changes to a folder of its own and then puts the next log file in place by a
rename that never replaces one: readers see the old version or the new one, a
writer that dies leaves the old one, and of two writers one has to try again.
Buckets without a change keep their folders, so a change costs its buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import outdated


class Conflict(Exception):
    """Another writer committed first."""


class Versioned:
    """A table of one key, with ``buckets`` parts by the key's hash; schema is a DDL string with the key in it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    @property
    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        log = self._at("log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The current version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folders by bucket."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        lines = self.spark.read.text(f"{self.path}/log/{version:012d}").collect()
        return json.loads("".join(r.value for r in lines))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default."""
        return self._rows(list(self.manifest(version).values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, touched: list[int]) -> dict[str, str | None]:
        """Rows of the touched buckets in a new folder; None for those that have none left."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {f.getPath().getName() for f in self._fs.listStatus(self._at(folder))}
        return {str(b): f"{folder}/_bucket={b}" if f"_bucket={b}" in made else None for b in touched}

    def _commit(self, base: int, manifest: dict[str, str]) -> int:
        fs, temporary = self._fs, self._at("log", f".{uuid.uuid4().hex}")
        fs.mkdirs(self._at("log"))
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, self._at("log", f"{base + 1:012d}"), options)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {base + 1} of {self.path} exists") from None
            raise
        return base + 1

    def change(self, keys: DataFrame | None, new: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Commits new(rows) for the buckets of keys(<key>), or for all; rows are those buckets' of the version it builds on."""
        touched = list(range(self.buckets)) if keys is None else sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        for left in range(tries, 0, -1):
            base = self.version()
            before = self.manifest(base)
            if not touched:
                return base
            rows = self._rows([before[str(b)] for b in touched if str(b) in before])
            after = before | self._written(new(rows), touched)
            try:
                return self._commit(base, {b: f for b, f in after.items() if f})
            except Conflict:
                if left == 1:
                    raise
        return base

    def replace(self, rows: DataFrame) -> int:
        """A version of just these rows."""
        return self.change(None, lambda _: rows)

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those with their key; the others stay."""
        return self.change(rows, lambda old: old.join(rows.select(self.key).distinct(), self.key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> int:
        return self.change(keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def refresh(self, version: int, again: Callable[[DataFrame], DataFrame]) -> int:
        """Rows whose score_version is another one are made anew by ``again``; the others are not read by it, and buckets without any stay."""
        stale = outdated(self.read(), version)
        return self.change(stale, lambda old: old.join(outdated(old, version).select(self.key), self.key, "left_anti").unionByName(again(outdated(old, version)).withColumn("score_version", F.lit(version)), allowMissingColumns=True))

    def vacuum(self, keep: int = 2) -> int:
        """Drops all but the last ``keep`` versions, and folders that none of these names; returns the number of folders. Not beside a writer."""
        versions = self.versions()
        held = {f.split("/")[1] for v in versions[-keep:] for f in self.manifest(v).values()}
        for v in versions[:-keep]:
            self._fs.delete(self._at("log", f"{v:012d}"), False)
        data = self._at("data")
        gone = [f.getPath() for f in self._fs.listStatus(data) if f.getPath().getName() not in held] if self._fs.exists(data) else []
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)
