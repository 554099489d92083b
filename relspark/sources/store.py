"""Snapshots of tables on a Hadoop file system: a commit writes a new folder, then its marker; readers see whole commits only.

Of writers that race for a version one wins, by the file system's rename, and the others raise, without
touching what it wrote: every commit writes to a folder of its own. As many readers as wanted; a reader keeps the version that it opened. History stays
until it is pruned. All access goes through Spark's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.root}/commits/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, tables: dict[str, DataFrame], user: dict[str, int] | None = None) -> int:
        """Publishes these tables; others stay as they are. user: numbers that travel with the commit."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        manifest = self._manifest(known[-1]) if known else {"tables": {}, "user": {}}
        own = f"{version}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            path = f"data/{own}/{name}"
            df.write.parquet(f"{self.root}/{path}")
            manifest["tables"][name] = path
        manifest["user"] |= user or {}
        out = self._fs.create(self._path(f"{self.root}/commits/{own}.tmp"), True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if not self._fs.rename(self._path(f"{self.root}/commits/{own}.tmp"), self._path(f"{self.root}/commits/{version}.json")):
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    def _of(self, version: int | None) -> dict:
        """The manifest of a version (the newest); KeyError if there is no such version."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise KeyError(f"no version {version}")
        return self._manifest(known[-1] if version is None else version)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest)."""
        return self.spark.read.parquet(f"{self.root}/{self._of(version)['tables'][table]}")

    def user(self, version: int | None = None) -> dict[str, int]:
        return self._of(version)["user"]

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._of(version)["tables"])

    def first_difference(self, other: Store, table: str) -> int | None:
        """The first common version at which a table differs, by bisection; None if none does."""
        both = sorted(set(self.versions()) & set(other.versions()))
        low, high = 0, len(both)
        while low < high:
            mid = (low + high) // 2
            a, b = self.read(table, both[mid]), other.read(table, both[mid])
            if a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty():
                low = mid + 1
            else:
                high = mid
        return both[low] if low < len(both) else None

    def prune(self, keep_from: int) -> None:
        """Forgets the versions before this one, and the data that no version left needs."""
        known = self.versions()
        left = [v for v in known if v >= keep_from]
        used = {p for v in left for p in self._manifest(v)["tables"].values()}
        for v in known:
            if v < keep_from:
                gone = self._manifest(v)["tables"].values()
                self._fs.delete(self._path(f"{self.root}/commits/{v}.json"), False)
                for p in gone:
                    if p not in used:
                        self._fs.delete(self._path(f"{self.root}/{p}"), True)


def export_pairs(pairs: DataFrame, path: str) -> None:
    """Key and value pairs, written in key order from file to file."""
    pairs.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def import_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
