"""Versioned snapshots of a folder of tables: one manifest commits all that an operation wrote.

Data folders are written once and never changed. A manifest, `manifests/<version>.json`, lists the folders of each table; it
appears by a rename that fails where the version is taken, so that of two writers with one base the second fails as a whole. A
reader pins a version and sees its tables together, whatever is written meanwhile; a writer that is killed leaves folders that no
manifest names, and the version before stays what it was. `expire` drops versions beyond the newest ones and the folders that
only they name, and what failed writers left.

It relies on a file system whose rename is atomic and doesn't replace (HDFS, local ones); object stores need a committer on top.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of a table from which an append merges them.
MERGE_FROM = 24


class Conflict(RuntimeError):
    """Another writer committed the version that this one was for."""


class _Files:
    """What is needed of Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)
        self.folder = self.fs.makeQualified(self.path(folder)).toString().rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, name: str) -> list[str]:
        at = self.path(f"{self.folder}/{name}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; False where the name is taken."""
        part, to = self.path(f"{self.folder}/{name}.{uuid.uuid4().hex}.part"), self.path(f"{self.folder}/{name}")
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        mode = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(mode.NONE.getClass(), 1)
        how[0] = mode.NONE
        try:
            context.rename(part, to, how)
        except Exception:  # noqa: BLE001  Py4J has one error for all of Java's; what counts is whether the name is there
            self.fs.delete(part, False)
            if self.fs.exists(to):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)


class Snapshot:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, folder: str, version: int, tables: dict[str, dict]):
        self.spark, self.folder, self.version, self.tables = spark, folder, version, tables

    def has(self, name: str) -> bool:
        return name in self.tables

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table as this version has it; one that it hasn't is empty where a schema is given."""
        if name not in self.tables:
            if schema is None:
                raise KeyError(f"version {self.version} has no table {name!r}")
            return self.spark.createDataFrame([], schema)
        table = self.tables[name]
        return self.spark.read.schema(table["schema"]).parquet(*[f"{self.folder}/{p}" for p in table["paths"]])


class Change(Snapshot):
    """A version in the making: reads see what it has written so far, others see nothing of it until commit."""

    def __init__(self, base: Snapshot, store: Snapshots):
        super().__init__(base.spark, base.folder, base.version + 1, {k: dict(v) for k, v in base.tables.items()})
        self.store, self.own = store, f"data/{base.version + 1:012d}-{uuid.uuid4().hex}"

    def _write(self, name: str, df: DataFrame) -> tuple[str, str]:
        path = f"{self.own}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{path}")
        return path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows; where a table has many folders they become one."""
        if name not in self.tables:
            return self.replace(name, df)
        path, schema = self._write(name, df)
        self.tables[name] = {"paths": [*self.tables[name]["paths"], path], "schema": schema}
        if len(self.tables[name]["paths"]) >= MERGE_FROM:
            self.replace(name, self.read(name))

    def replace(self, name: str, df: DataFrame) -> None:
        path, schema = self._write(name, df)
        self.tables[name] = {"paths": [path], "schema": schema}

    def commit(self) -> Snapshot:
        """The new version, or Conflict where another writer took it, which leaves nothing of this one."""
        if not self.store.files.put(f"manifests/{self.version:012d}.json", json.dumps(self.tables)):
            self.store.files.drop(self.own)
            raise Conflict(f"version {self.version} of {self.folder} was committed by another writer")
        return Snapshot(self.spark, self.folder, self.version, self.tables)


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, _Files(spark, folder)
        self.folder = self.files.folder

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json")]

    def at(self, version: int) -> Snapshot:
        return Snapshot(self.spark, self.folder, version, json.loads(self.files.read(f"manifests/{version:012d}.json")))

    def latest(self) -> Snapshot:
        """The newest version; version 0 has no table."""
        found = self.versions()
        return self.at(found[-1]) if found else Snapshot(self.spark, self.folder, 0, {})

    def change(self) -> Change:
        return Change(self.latest(), self)

    def expire(self, keep: int = 2) -> list[int]:
        """Drops all versions but the newest `keep` (at least one), and the data that none of those names. Data of a version that isn't committed yet stays, as its writer may be at work. Gives the dropped versions."""
        found = self.versions()
        if not found:
            return []
        kept, gone = found[-max(keep, 1) :], found[: -max(keep, 1)]
        used = {p for v in kept for t in self.at(v).tables.values() for p in t["paths"]}
        for v in gone:
            self.files.drop(f"manifests/{v:012d}.json")
        for own in self.files.names("data"):
            if int(own.partition("-")[0]) > found[-1]:
                continue
            for name in self.files.names(f"data/{own}"):
                if f"data/{own}/{name}" not in used:
                    self.files.drop(f"data/{own}/{name}")
            if not self.files.names(f"data/{own}"):
                self.files.drop(f"data/{own}")
        return gone
