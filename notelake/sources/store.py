"""The record store: Parquet partitioned by namespace, versions switched by a pointer (A1-A10, N3e).

A version is a list of folders, or partitions of folders, in a pointer file ``_CUR_<n>``;
readers take the newest whole one.  Writers put their files into a new folder and then claim the next number;
claiming one that is taken fails, so no writer undoes what another has done, nothing is
overwritten while it is read, and a writer that dies leaves the old version in force.
Inserting adds a folder and rewrites nothing; changing
and deleting write those partitions anew that hold such a record, a few at a time.  The file system has to create files
exclusively, as HDFS does.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake import schema
from notelake.functions.tables import release, unwritten, written
from notelake.operators import sync


#: Groups of partitions that are written anew one after the other, so that a change exchanges a share of the table at a time.
GROUPS = 8


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    """A table in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, ddl: str = schema.MEMORIES, partition: str | None = "namespace", key: str | Sequence[str] = "id"):
        self.spark, self.path, self.ddl, self.partition, self.key = spark, path.rstrip("/"), ddl, partition, key

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> dict[int, list[str]]:
        """Folders, and partitions of folders, of each whole version."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return {}
        numbers = [int(n[5:]) for n in (s.getPath().getName() for s in fs.listStatus(path(self.path))) if n.startswith("_CUR_")]
        lines = {n: self._text(f"{self.path}/_CUR_{n}").split("\n") for n in numbers}
        return {n: x[:-1] for n, x in lines.items() if x[-1] == "."}

    def _text(self, name: str) -> str:
        fs, path = self._fs()
        size = fs.getFileStatus(path(name)).getLen()
        with contextlib.closing(fs.open(path(name))) as f:
            return bytes(f.readNBytes(size)).decode()

    def _claim(self, v: int, folders: list[str]) -> int:
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.path}/_CUR_{v}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {v} of {self.path} is taken") from e
        with contextlib.closing(out):
            out.write(bytearray("\n".join([*folders, "."]).encode()))
        return v

    def version(self) -> int:
        """Number of the version in force; 0 for an empty store."""
        return max(self._pointers(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """A1, A3: the table, with columns that older versions lack as null."""
        held = self._pointers()
        v = max(held, default=0) if version is None else version
        scans = self._scans(held.get(v, []))
        return functools.reduce(DataFrame.unionByName, scans) if scans else self.spark.createDataFrame([], self.ddl)

    def _scans(self, entries: Sequence[str]) -> list[DataFrame]:
        """The rows of some folders or partitions, folder by folder: partitions are found below each."""
        paths: dict[str, list[str]] = {}
        for e in entries:
            paths.setdefault(e.split("/")[0], []).append(f"{self.path}/{e}")
        return [self.spark.read.schema(self.ddl).option("basePath", f"{self.path}/{f}").parquet(*p) for f, p in paths.items()]

    def _inside(self, folder: str) -> list[str]:
        """Partitions of a folder."""
        fs, path = self._fs()
        names = (s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}")))
        return sorted(f"{folder}/{n}" for n in names if n.startswith(f"{self.partition}="))

    def _holding(self, entries: Sequence[str], keys: DataFrame) -> set[str]:
        """Partitions (folders, in a table without) that hold records of some keys."""
        jvm, on = self.spark.sparkContext._jvm, sync.columns(self.key)
        place = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("place")
        all_ = functools.reduce(DataFrame.union, [s.select(*on, place) for s in self._scans(entries)])
        found = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["place"])) for r in all_.join(keys, on, "left_semi").select("place").distinct().collect()]
        return {f"{p.getParent().getName()}/{p.getName()}" if self.partition else p.getName() for p in found}

    def _without(self, entries: Sequence[str], keys: DataFrame) -> list[str]:
        """What a version's entries become without the records of some keys (a table of files)."""
        if not entries:
            return []
        old = self._holding(entries, keys)
        out = [x for e in entries for x in (self._inside(e) if any(o.startswith(f"{e}/") for o in old) else [e]) if x not in old]
        names = sorted({o.split("/")[-1] for o in old})
        for some in (names[i::GROUPS] for i in range(min(GROUPS, len(names)))):
            rows = functools.reduce(DataFrame.unionByName, self._scans(sorted(o for o in old if o.split("/")[-1] in some)))
            out.append(self._write(rows.join(keys, sync.columns(self.key), "left_anti")))
        return out

    def _columns(self, df: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], self.ddl)
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))

    def _write(self, df: DataFrame) -> str:
        """A new folder with rows rebalanced by partition, so a large namespace is split over several tasks and files; what it took to get there goes."""
        name, out = f"part-{uuid.uuid4().hex}", self._columns(df)
        if self.partition:
            out = out.hint("rebalance", F.col(self.partition)).sortWithinPartitions(self.partition, *([F.col("timestamp").desc()] if "timestamp" in out.columns else []))
            out.write.partitionBy(self.partition).option("compression", "zstd").parquet(f"{self.path}/{name}")
        else:
            out.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        release(self.spark)
        return name

    def replace(self, df: DataFrame, base: int | None = None) -> int:
        """Writes a new version and switches to it; returns its number.  Fails if ``base`` (the newest) is no longer the newest."""
        v = self.version() if base is None else base
        return self._claim(v + 1, [self._write(df)])

    def insert(self, new: DataFrame, strict: bool = False, tries: int = 5) -> int:
        """A4, A5: adds records whose key is new and returns their number; ``strict`` raises if one is not.

        Only new records are written.  Where another writer was first, keys are compared again.
        """
        for left in reversed(range(tries)):
            held = self._pointers()
            v = max(held, default=0)
            name = self._write(sync.insert(self.read(v), new, self.key))
            n = self.spark.read.schema(self.ddl).parquet(f"{self.path}/{name}").count()
            if strict and n < new.count():
                raise ValueError("a record with this key exists")
            try:
                self._claim(v + 1, [*held.get(v, []), name])
                return n
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def update(self, changed: DataFrame) -> int:
        """As ``sync.update``: the changed records in a new folder, and the partitions of those with their keys without these."""
        held, key = self._pointers(), sync.columns(self.key)
        v = max(held, default=0)
        name = self._write(self._columns(changed).join(self.read(v).select(*key), key, "left_semi").dropDuplicates(key))
        return self._claim(v + 1, [*self._without(held.get(v, []), self._scans([name])[0].select(*key)), name])

    def delete(self, ids: DataFrame) -> int:
        """A8, A8b."""
        held, key = self._pointers(), sync.columns(self.key)
        v = max(held, default=0)
        keys = written(ids.select(*key).distinct())
        left = self._without(held.get(v, []), keys)
        unwritten(keys)
        return self._claim(v + 1, left)

    def clear(self) -> int:
        """Removes all records and returns how many there were."""
        n = self.read().count()
        self.replace(self.spark.createDataFrame([], self.ddl))
        return n

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions before the last ``keep`` ones, and folders and partitions that none of these has; no writer may be at work."""
        fs, path = self._fs()
        held = self._pointers()
        stay = sorted(held)[-keep:]
        used = {f for v in stay for f in held[v]}
        some = {f.split("/")[0] for f in used}
        for s in fs.listStatus(path(self.path)):
            name = s.getPath().getName()
            if name.startswith("part-") and name not in some or name.startswith("_CUR_") and int(name[5:]) not in stay:
                fs.delete(s.getPath(), True)
        for gone in (p for f in some - used for p in self._inside(f) if p not in used):
            fs.delete(path(f"{self.path}/{gone}"), True)
        return len(held) - len(stay)
