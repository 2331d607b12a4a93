"""Change feeds: debounced sessions of changed paths, in batch and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEBOUNCE, LEAST_MS = "150 milliseconds", 10


def relevant(changes: DataFrame) -> DataFrame:
    """Without accesses and what lies in `.git` or the state folder."""
    return changes.where((F.col("op") != "access") & ~F.col("path").rlike(r"(^|/)\.(git|lodegraph)(/|$)"))


def sessions(changes: DataFrame, gap: str = DEBOUNCE, key: str = "root", watermark: str | None = None) -> DataFrame:
    """(root, start, end, n_events, n_paths, paths): a session ends after a quiet gap. Keyed by root, so roots run in
    parallel; with a watermark it is a streaming query in append mode."""
    given = changes if watermark is None else changes.withWatermark("ts", watermark)
    got = given.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_set("path")).alias("paths"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", F.size("paths").cast("long").alias("n_paths"), "paths")


def apply_each(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `update` once for each micro-batch of sessions until what is there is done."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(update).start()


def unseen(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Changes (root, path, content_hash) whose content isn't what is known of that file."""
    same = known.select("root", "path", "content_hash").distinct()
    return changes.join(same, ["root", "path", "content_hash"], "left_anti")


def unseen_stream(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same in a stream: of changes (root, ts, path, content_hash) of one content those within a delay count once."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["root", "path", "content_hash"])


def saved(changes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(root, path, ts, op) with editors' ways to save as one change: writes to a file and a rename onto it, within a gap, are
    one modification; a file made and deleted within one is none. changes: (root, path, ts, op[, renamed_to])."""
    onto = F.coalesce("renamed_to", "path") if "renamed_to" in changes.columns else F.col("path")
    # A rename ends what its source began: the source's events belong to the target.
    moved = changes.where("op = 'rename'").select("root", F.col("path").alias("__p"), onto.alias("__to"), F.col("ts").alias("__at")) if "renamed_to" in changes.columns else None
    rows = changes.withColumn("target", onto)
    if moved is not None:
        rows = rows.join(moved, (rows["root"] == moved["root"]) & (F.col("path") == F.col("__p")) & (F.col("ts") <= F.col("__at")), "left").select(rows["root"], F.coalesce("__to", "target").alias("target"), "ts", "op")
    windows = rows.groupBy("root", F.col("target").alias("path"), F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("ts"), F.collect_set("op").alias("ops"), F.max_by("op", "ts").alias("last"), F.min_by("op", "ts").alias("first"))
    deleted, made = F.col("last") == "delete", F.col("first") == "create"
    kept = windows.where(~(deleted & made))
    return kept.select("root", "path", "ts", F.when(deleted, "delete").when(made & ~F.array_contains("ops", "rename"), "create").otherwise("modify").alias("op"))


def bounded(update: Callable[[DataFrame, int], None], scan: Callable[[int], None], most: int) -> Callable[[DataFrame, int], None]:
    """An update of micro-batches that gives way to a scan of everything where a batch has more than `most` paths."""

    def either(batch: DataFrame, number: int) -> None:
        n = batch.agg(F.sum(F.size("paths"))).first()[0] or 0
        scan(number) if n > most else update(batch, number)

    return either


class Watch:
    """A running feed that can be paused and goes on where it was: its progress is in the checkpoint."""

    def __init__(self, start: Callable[[], object]):
        self._start, self._query = start, None

    @property
    def active(self) -> bool:
        return self._query is not None and self._query.isActive

    def resume(self) -> None:
        if not self.active:
            self._query = self._start()

    def pause(self) -> None:
        if self.active:
            self._query.stop()
            self._query.awaitTermination()


def revisions(history: DataFrame, after: int = 0) -> DataFrame:
    """Updates beyond a revision, in order: what a poll gives; over a stream of the history it is a feed."""
    grown = history.where(F.col("revision") > after)
    return grown if history.isStreaming else grown.orderBy("revision")


def expired(requests: DataFrame, now: str | None = None, idle: str = "600 seconds") -> DataFrame:
    """(project, start, end, n_requests, active) of sessions of requests (project, ts): one ends after an idle time, and is
    active where that has not passed at `now`."""
    got = requests.groupBy("project", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return got.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_requests", (F.col("w.end") > at).alias("active"))
