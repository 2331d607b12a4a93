"""The claim store's mutations as pure functions of tables, resolution, and a versioned Parquet store."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows of one key the last by `seq`, if there is one, stays."""
    if "seq" in new.columns:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
        new = new.withColumn("__r", last).where("__r = 1").drop("__r", "seq")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def remove(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.distinct(), keys.columns, "left_anti")


def resolve(unresolved: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending references to all nodes of exactly that name, and what stays pending."""
    named = nodes.select(F.col("name").alias("seeking"), F.col("node_id").alias("to_id"))
    edges = unresolved.join(named, "seeking").select("from_id", "to_id", F.col("edge_kind").alias("kind"))
    return edges, unresolved.join(named.select("seeking").distinct(), "seeking", "left_anti")


def promote(unresolved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pending references to the first fresh node (by `ord`) of that name."""
    first = fresh.groupBy(F.col("name").alias("seeking")).agg(F.min_by("node_id", "ord").alias("to_id"))
    return unresolved.join(first, "seeking").select("from_id", "to_id", F.col("edge_kind").alias("kind"))


def demote(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is gone."""
    return edges.join(nodes.select(F.col("node_id").alias("to_id")), "to_id", "left_anti")


def version_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(name, stored, current) of names whose versions differ, one side missing included."""
    both = stored.select("name", F.col("version").alias("stored")).join(current.select("name", F.col("version").alias("current")), "name", "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("current")))


class Conflict(RuntimeError):
    """Another writer committed first."""


class StoreError(RuntimeError):
    """The folder holds no store that this version reads."""


class Store:
    """Tables as immutable Parquet versions and a manifest for each revision, on any file system that Spark reaches.

    A commit writes new versions of the changed tables, then the next revision's manifest under a name of its own, and
    renames that to the revision's name, which fails if it is there: that is the optimistic check, and no reader sees half a
    manifest. (On object stores, where renaming is no such test, writers have to take turns.) Readers are pinned to the
    revision they opened. A manifest also holds small facts (`meta`): versions, counters.
    """

    FORMAT, MARK = 1, "lodegraph-store"

    def __init__(self, spark: SparkSession, folder: str, create: bool = True):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.folder}/manifests")):
            if not create:
                raise StoreError(f"{folder} holds no store")
            if self._fs.exists(self._path(self.folder)) and self._fs.listStatus(self._path(self.folder)):
                raise StoreError(f"{folder} holds something else")
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        self._fs.mkdirs(self._path(f"{self.folder}/tables"))
        self._held(self.revision())

    @classmethod
    def temporary(cls, spark: SparkSession) -> Store:
        """A store in the session's shared folder that goes when the driver ends."""
        from lodegraph.scratch import Scratch

        return cls(spark, Scratch(spark).root)

    @classmethod
    def inspect(cls, spark: SparkSession, folder: str) -> dict:
        """What a folder holds, without opening it: format, revision, tables; an error text where it is no store."""
        try:
            store = cls(spark, folder, create=False)
        except StoreError as e:
            return {"error": str(e)}
        at = store.revision()
        return {"format": cls.FORMAT, "revision": at, "tables": sorted(store.manifest(at)), "meta": store.meta(at)}

    @classmethod
    def migrate(cls, spark: SparkSession, folder: str) -> int:
        """Brings a store of an older format to this one; the revision after it. Format 0 had no mark and no meta."""
        store = cls.__new__(cls)
        store.spark, store.folder = spark, folder.rstrip("/")
        store._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        store._fs = store._path(store.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        at = store.revision()
        held = store._read(at) if at else None
        if held is None or held.get("format") == cls.FORMAT:
            return at
        if held.get("format") != 0 or "tables" not in held:
            raise StoreError(f"format {held.get('format')} can't be migrated")
        store._write(at + 1, held["tables"], {})
        return at + 1

    def revision(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _read(self, at: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{at:012d}.json", wholetext=True).first()[0])

    def _held(self, at: int) -> dict:
        if not at:
            return {"tables": {}, "meta": {}}
        held = self._read(at)
        if held.get("mark") != self.MARK or held.get("format", 0) != self.FORMAT:
            raise StoreError(f"format {held.get('format')} is not {self.FORMAT}" + ("; migrate the store" if held.get("format") == 0 else ""))
        return held

    def manifest(self, revision: int | None = None) -> dict[str, str]:
        return self._held(self.revision() if revision is None else revision)["tables"]

    def meta(self, revision: int | None = None) -> dict:
        return self._held(self.revision() if revision is None else revision)["meta"]

    def read(self, table: str, revision: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tables/{self.manifest(revision)[table]}")

    def commit(self, base: int, changed: dict[str, DataFrame], meta: dict | None = None, clear: bool = False) -> int:
        """Writes the changed tables as revision base + 1; with `clear` nothing else of the base stays."""
        if self.revision() != base:
            raise Conflict(f"revision {self.revision()} is not {base}")
        held = self._held(0 if clear else base)
        tables = dict(held["tables"])
        for name, df in changed.items():
            tables[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/tables/{tables[name]}")
        self._write(base + 1, tables, held["meta"] | (meta or {}))
        return base + 1

    def _write(self, revision: int, tables: dict[str, str], meta: dict) -> None:
        own = self._path(f"{self.folder}/manifests/{uuid.uuid4().hex}.new")
        out = self._fs.create(own, True)
        out.write(bytearray(json.dumps({"mark": self.MARK, "format": self.FORMAT, "tables": tables, "meta": meta}).encode()))
        out.close()
        jvm = self.spark._jvm
        target = self._path(f"{self.folder}/manifests/{revision:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(own), self._fs.makeQualified(target), kinds)
        except Exception as e:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"revision {revision} exists") from e
            raise

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400) -> int:
        """Deletes table versions that none of the last `keep` revisions has; the number deleted. Younger ones than
        `older_than_s` stay, as a writer may be about to commit them."""
        now = self.revision()
        used = {v for r in range(max(1, now - keep + 1), now + 1) for v in self.manifest(r).values()}
        before = int((time.time() - older_than_s) * 1000)
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.folder}/tables")) if s.getPath().getName() not in used and s.getModificationTime() <= before]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def compact(self, files: int = 1) -> int:
        """Rewrites each table in few files, as a revision of its own."""
        at = self.revision()
        return self.commit(at, {name: self.read(name, at).coalesce(files) for name in self.manifest(at)})

    def remove(self) -> None:
        """Deletes the store, which must be one."""
        self._held(self.revision())
        self._fs.delete(self._path(self.folder), True)


class Lease:
    """One writer at a time for a folder: a file that names its holder and until when; a lapsed one can be taken over.

        with Lease(spark, folder, "indexer"): ...
    """

    def __init__(self, spark: SparkSession, folder: str, holder: str, seconds: float = 600.0):
        self.holder, self.seconds, self.token = holder, seconds, uuid.uuid4().hex
        self._at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/lease")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = lambda: json.loads(spark.read.text(self._at.toString(), wholetext=True).first()[0])

    def held(self) -> dict | None:
        """Who holds it, if someone does and it has not lapsed."""
        if not self._fs.exists(self._at):
            return None
        got = self._read()
        return got if got["until"] > time.time() else None

    def acquire(self) -> None:
        if other := self.held():
            raise Conflict(f"{other['holder']} holds the lease")
        self._fs.delete(self._at, False)
        try:
            out = self._fs.create(self._at, False)
        except Exception as e:
            if "already exists" in str(e).lower():
                raise Conflict("another writer took the lease") from e
            raise
        out.write(bytearray(json.dumps({"holder": self.holder, "token": self.token, "until": time.time() + self.seconds}).encode()))
        out.close()

    def release(self) -> None:
        if (got := self.held()) and got["token"] == self.token:
            self._fs.delete(self._at, False)

    def __enter__(self) -> Lease:
        self.acquire()
        return self

    def __exit__(self, *_: object) -> None:
        self.release()
