"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own removal of an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; only where that is unset, and in local mode, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Written tables after which the driver's JVM gives memory back.
RELIEF = 12
_saves = itertools.count(1)


def relieve(spark: SparkSession) -> str | None:
    """Collects the driver's garbage, which lets Spark's cleaner free broadcast tables of what is deleted, and returns to the
    machine what the JVM's compilers and buffers have freed, which else stays with the process. What the JVM says of it; a
    JVM without that command only collects."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:
        named = jvm.java.lang.Class.forName
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # noqa: BLE001  another JVM or C library
        return None


class Scratch:
    """Written tables that cut lineage: a lost executor rereads files instead of recomputing everything before them.

    `save` writes a table as Parquet and returns it reread; the shuffle files of that one execution go when it ends, as
    nothing reads them after it (they serve its own retries till then). `drop` deletes named tables; `finish` keeps only the
    result's table, which stays until the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lodegraph-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        if next(_saves) % RELIEF == 0:
            relieve(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def finish(self, df: DataFrame, keep: str = "result") -> DataFrame:
        out = self.save(df, keep)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            if status.getPath().getName() != keep:
                files.delete(status.getPath(), True)
        relieve(self.spark)
        return out

    def _delete(self, where: str) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone
            return


def numbered(ordered: DataFrame, scratch: Scratch, name: str, place: str) -> DataFrame:
    """A table as it is ordered (orderBy: a range sort) with its rows' places from 0; what one task orders of it is a row for
    each part."""
    saved = scratch.save(ordered.withColumn("__m", F.monotonically_increasing_id()), name)
    part = F.shiftright("__m", 33)  # the part's number is above a row's place in it
    parts = saved.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__c"))
    parts = parts.withColumn("__before", F.expr("sum(__c) over (order by __part) - __c")).select("__part", "__before")
    out = saved.join(F.broadcast(parts), part == F.col("__part")).withColumn(place, F.expr("__before + (__m & 8589934591)"))
    return out.drop("__m", "__part", "__before")


def ordinals(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch, column: str = "ordinal") -> DataFrame:
    """Adds a row's place, from 0, among those of its key in an order. By one range sort, so that a key with most of the rows is
    spread over tasks like others; a key's first place is pre-aggregated."""
    placed = scratch.save(numbered(df.orderBy(*keys, *order), scratch, "sorted", "__at"), "placed")
    if not keys:
        return placed.withColumnRenamed("__at", column)
    first = placed.groupBy(*keys).agg(F.min("__at").alias("__first"))
    same = [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    first = first.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__first")
    return placed.join(first, same).withColumn(column, (F.col("__at") - F.col("__first")).cast("long")).select(*df.columns, column)
