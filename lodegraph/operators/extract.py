"""Extraction: files to tagged facts in one Arrow pass, then the claim tables. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.model import RANGE, owner, provenance, shaped
from lodegraph.packs import PACKS, Pack, extract
from lodegraph.shipping import bounded_arrow

KINDS = {
    "tag": pa.string(), "root": pa.string(), "path": pa.string(), "artifact_class": pa.string(), "language": pa.string(), "producer": pa.string(), "version": pa.string(),
    "node_id": pa.string(), "edge_id": pa.string(), "from_id": pa.string(), "to_id": pa.string(), "kind": pa.string(), "name": pa.string(), "qualified_name": pa.string(),
    "chain": pa.string(), "ordinal": pa.int32(), "seeking": pa.string(), "scope_hint": pa.string(), "start": pa.int64(), "end": pa.int64(), "start_line": pa.int32(),
    "start_column": pa.int32(), "end_line": pa.int32(), "end_column": pa.int32(), "attributes": pa.map_(pa.string(), pa.string()),
}
SCHEMA = ", ".join(f"`{k}` {'map<string,string>' if pa.types.is_map(v) else 'long' if v == pa.int64() else 'int' if v == pa.int32() else 'string'}" for k, v in KINDS.items())
ROWS = 4096


def tagged(files: DataFrame, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """A row for each fact (`tag`: node, edge, unresolved, diagnostic) of files (root, path, content[, artifact_class]), and a
    row `skip` for each file that no pack takes. Content may be text or bytes; null content is skipped too."""
    bounded_arrow(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def full() -> pa.RecordBatch:
            columns = [pa.array([list(r[k].items()) if k == "attributes" and r.get(k) is not None else r.get(k) for r in held], t) for k, t in KINDS.items()]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, list(KINDS))

        for batch in batches:
            for root, path, content, artifact in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                common = {"root": root, "path": path, "artifact_class": artifact}
                facts = None if content is None else extract(root, path, content, packs)
                if facts is None:
                    held.append(common | {"tag": "skip", "name": "unreadable" if content is None else "no pack takes it", "producer": "files", "version": "1"})
                else:
                    common |= {"language": facts.language, "producer": facts.producer, "version": facts.version}
                    held += [common | r for r in facts.rows]
                if len(held) >= ROWS:
                    yield full()
        if held:
            yield full()

    artifact = F.col("artifact_class") if "artifact_class" in files.columns else F.lit(None).cast("string")
    return files.select("root", "path", "content", artifact.alias("artifact_class")).mapInArrow(work, SCHEMA)


def tables(facts: DataFrame, revision: int = 0) -> dict[str, DataFrame]:
    """The claim tables of tagged facts (written beforehand, so that files are read once)."""
    at = F.struct("start", "end", "start_line", "start_column", "end_line", "end_column").cast(RANGE)
    claimed = facts.withColumn("owner", owner(F.col("root"), F.col("path"), F.col("producer"), F.col("version")))
    source = (F.col("root"), F.col("path"), F.col("producer"), F.col("version"), "extracted", F.lit(revision))
    of = lambda tag: claimed.where(F.col("tag") == tag)
    return {
        "nodes": shaped(of("node").withColumns({"range": at, "provenance": provenance(*source, at)}), "nodes"),
        "edges": shaped(of("edge").withColumns({"provenance": provenance(*source), "attributes": F.create_map().cast("map<string,string>")}), "edges"),
        "unresolved": shaped(of("unresolved").withColumns({"provenance": provenance(*source), "edge_kind": F.col("kind")}), "unresolved"),
        "diagnostics": shaped(of("diagnostic").withColumn("message", F.col("name")), "diagnostics"),
        "skips": shaped(of("skip").withColumn("reason", F.col("name")), "skips"),
    }
