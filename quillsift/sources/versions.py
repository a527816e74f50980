"""A table that is changed by key: Parquet in hash buckets, versions, and manifests committed by rename.

A change reads and rewrites only the buckets that its keys fall into, in a folder of its own; a manifest then names the
folder of each bucket. A version is there once its manifest has been renamed into place, which fails if another writer
was first. So a writer that dies leaves the last version as it was, and readers of a version aren't disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    """A table below path with the given schema; rows are known by `key`, one row per key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        folder = self.at("manifests")
        names = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """Number of a version (the last one if not given), and the folder of each bucket that has rows."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return 0, {}
        if version not in known:
            raise ValueError(f"no version {version}")
        stream = self.files.open(self.at(f"manifests/{version:08d}"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, folders: dict[str, str]) -> int:
        draft, final = self.at(f"drafts/{uuid.uuid4().hex}"), self.at(f"manifests/{version:08d}")
        self.files.mkdirs(self.at("manifests"))
        stream = self.files.create(draft)
        stream.write(json.dumps(folders).encode())
        stream.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            raise Conflict(f"version {version} is there already")
        return version

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets if they are named."""
        _, folders = self.manifest(version)
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in folders.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def find(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some keys; buckets without any of them aren't read."""
        wanted = keys.select(self.key).distinct()
        return self.read(version, self._touched(wanted)).join(wanted, self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers

    def _write(self, old: int, folders: dict[str, str], touched: list[int], rows: DataFrame) -> int:
        """Commits the new rows of the touched buckets; large buckets are written by several tasks."""
        folder = f"data/{old + 1:08d}-{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket())
        dealt.repartition(BUCKET, F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(4))).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        there = self.files.listStatus(self.at(folder))
        filled = {s.getPath().getName().partition("=")[2] for s in there if s.getPath().getName().startswith(BUCKET)}
        left = {b: f for b, f in folders.items() if int(b) not in touched}
        return self.commit(old + 1, left | {b: folder for b in filled})

    def upsert(self, rows: DataFrame, columns: list[str] | None = None) -> int:
        """Rows come in, or replace those with their keys; with `columns` given, only those of a row that is there change.

        A key may come once; keys that come twice raise. Returns the new version.
        """
        changed = [c for c in self.schema.names if c != self.key] if columns is None else columns
        new = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        if twice := new.groupBy(self.key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"key {twice[0][0]!r} comes more than once")
        version, folders = self.manifest()
        touched = self._touched(new)
        old = self.read(version, touched)
        fresh, former = new.withColumn("_new", F.lit(True)).alias("n"), old.withColumn("_old", F.lit(True)).alias("o")
        both = former.join(fresh, self.key, "full")
        value = lambda c: F.when(F.col("_new") & (F.lit(c in changed) | F.col("_old").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return self._write(version, folders, touched, both.select(self.key, *[value(c) for c in self.schema.names if c != self.key]))

    def delete(self, keys: DataFrame) -> int:
        version, folders = self.manifest()
        touched = self._touched(keys)
        return self._write(version, folders, touched, self.read(version, touched).join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def vacuum(self) -> int:
        """Deletes what no manifest names: the folders of writers that died. Returns how many; no writer may be at work."""
        named = {f for v in self.versions() for f in self.manifest(v)[1].values()}
        there = [s.getPath() for s in self.files.listStatus(self.at("data"))] if self.files.exists(self.at("data")) else []
        gone = [p for p in there if f"data/{p.getName()}" not in named]
        for p in gone:
            self.files.delete(p, True)
        return len(gone)
