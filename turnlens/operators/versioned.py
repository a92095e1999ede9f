"""Parquet tables with versions: a write adds files and then one manifest, so readers see all of it or nothing.

A table is a folder with ``data/<write>/_folder=<value>/`` and ``manifests/<version>``; a manifest lists the folder of each
partition. A version is committed by renaming its manifest to a name that must not exist: of two writers that
began from one version the second fails to commit, and starts over from the version of the first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A copy of the partition's column, which names the folders; no column of a table may be called so.
PART = "_folder"
TRIES = 5


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted."""


class Files:
    """The few file operations that manifests need, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names and times (ms) of what a folder holds."""
        where = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file whole under a name that must be new."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        where = self.path(name)
        self.fs.mkdirs(where.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(where), options)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(where):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(files: Files) -> list[int]:
    return sorted(int(n) for n, _ in files.names("manifests"))


def manifest(files: Files, version: int) -> dict[str, str]:
    """Partition name to folder; empty before the first write."""
    return json.loads(files.read(f"manifests/{version:012}")) if version else {}


def load(spark: SparkSession, root: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one that is still kept."""
    files = Files(spark, root)
    known = versions(files)
    folders = manifest(files, version if version is not None else known[-1] if known else 0)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{folder}" for folder in sorted(folders.values())])


def upsert(root: str, rows: DataFrame, key: tuple[str, ...], partition_by: str, before_commit: Callable[[], None] | None = None) -> int:
    """Replace the keys of ``rows`` in the table at ``root``; only partitions that ``rows`` touch are written again. Returns the version.

    ``rows`` have one row for each key, and a key must keep its partition. Writing the same rows
    twice changes nothing. A job that fails leaves the table as it was; readers go on with the version that
    they opened. After a conflict the rows are merged again with the newer version.
    """
    spark: SparkSession = rows.sparkSession
    files = Files(spark, root)
    for _ in range(TRIES):
        known = versions(files)
        now = known[-1] if known else 0
        held = manifest(files, now)
        merged = rows
        if held:
            touched = rows.select(partition_by).distinct()
            old = load(spark, root, rows.schema, now).join(touched, partition_by, "left_semi").join(rows.select(*key), list(key), "left_anti")
            merged = rows.unionByName(old.select(*rows.columns))
        write = f"data/{uuid.uuid4().hex}"
        # the partition's column stays in the files too, so that folders of several writes are read alike
        merged.withColumn(PART, F.col(partition_by).cast("string")).write.partitionBy(PART).parquet(f"{root}/{write}")
        added = {name: f"{write}/{name}" for name, _ in files.names(write) if name.startswith(f"{PART}=")}
        if before_commit:
            before_commit()
        try:
            files.publish(f"manifests/{now + 1:012}", json.dumps(held | added, sort_keys=True))
            return now + 1
        except Conflict:
            files.delete(write)
    raise Conflict(f"{root}: lost {TRIES} times to other writers")


def sweep(spark: SparkSession, root: str, keep: int = 2, older_than_ms: int = 86_400_000) -> list[str]:
    """Delete all but the newest ``keep`` versions, and the folders no kept version names; younger folders may belong to a writer at work and stay."""
    files = Files(spark, root)
    known = versions(files)
    kept = known[-keep:]
    used = {folder for v in kept for folder in manifest(files, v).values()}
    for v in known[: len(known) - len(kept)]:
        files.delete(f"manifests/{v:012}")
    limit, gone = time.time() * 1000 - older_than_ms, []
    for write, at in files.names("data"):
        if at > limit:
            continue
        for name, _ in files.names(f"data/{write}"):
            if name.startswith(f"{PART}=") and f"data/{write}/{name}" not in used:
                files.delete(f"data/{write}/{name}")
                gone.append(f"data/{write}/{name}")
        if not any(folder.startswith(f"data/{write}/") for folder in used):
            files.delete(f"data/{write}")
    return gone
