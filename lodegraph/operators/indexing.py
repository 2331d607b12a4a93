"""Index maintenance: snapshots of files to revisions of the graph, promotion, resolution, demotion, and what version changes
invalidate. One commit a batch of files, whatever their number."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import ids
from lodegraph.model import owner, provenance
from lodegraph.operators import claims, extract, store
from lodegraph.packs import PACKS, Pack
from lodegraph.scratch import Scratch
from lodegraph.sources import files as sources
from lodegraph.sources.vcs import Vcs

PROMOTER, RESOLVER, VERSION = "promoter", "resolver", "1"
ENGINE = "1"


def current_versions(packs: tuple[Pack, ...] = PACKS) -> dict:
    """Version records of this engine: of its parts, and of each pack's extractor."""
    return {"schema": 1, "registry": 1, "classification": 1, "resolution": 1, "engine": ENGINE, "packs": {p.name: p.version for p in packs}, "extractors": {f"{p.name}_pack": p.version for p in packs}}


# ---- references


def _edges(met: DataFrame, extractor: str, revision: int) -> DataFrame:
    """Edges of references (from_id, to_id, seeking, scope_hint, edge_kind, root, path of what refers) that met nodes; what was sought stays with
    them, so that an edge whose target goes can become a reference again."""
    name, version = F.lit(extractor), F.lit(VERSION)
    attributes = F.map_filter(F.create_map(F.lit("seeking"), F.col("seeking"), F.lit("scope_hint"), F.col("scope_hint")), lambda k, v: v.isNotNull())
    return met.select(
        ids.edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_kind"), name).alias("edge_id"), "from_id", "to_id", F.col("edge_kind").alias("kind"),
        provenance(F.col("root"), F.col("path"), name, version, "resolved", F.lit(revision)).alias("provenance"), attributes.alias("attributes"), owner(F.col("root"), F.col("path"), name, version).alias("owner"),
    )


def _flat(unresolved: DataFrame) -> DataFrame:
    return unresolved.select("from_id", "seeking", "scope_hint", "edge_kind", F.col("owner.root").alias("root"), F.col("owner.path").alias("path"))


def promoted(unresolved: DataFrame, fresh: DataFrame) -> DataFrame:
    """References (with to_id) to the first fresh node of exactly that name, in the order of file and place."""
    order = F.struct("root", "path", F.coalesce("range.start", F.lit(0)).alias("at"), "node_id")
    first = fresh.groupBy(F.col("name").alias("seeking")).agg(F.min_by("node_id", order).alias("to_id"))
    return _flat(unresolved).join(first, "seeking")


def resolved(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (with to_id) to every node of exactly that name."""
    return _flat(unresolved).join(nodes.select(F.col("name").alias("seeking"), F.col("node_id").alias("to_id")).distinct(), "seeking")


def demoted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by resolution whose target is gone, and the references that they become again."""
    lost = edges.where(F.col("owner.producer").isin(PROMOTER, RESOLVER)).join(nodes.select(F.col("node_id").alias("to_id")).distinct(), "to_id", "left_anti")
    back = lost.join(nodes.select(F.col("node_id").alias("from_id")).distinct(), "from_id", "left_semi")
    back = back.select("from_id", F.col("attributes")["seeking"].alias("seeking"), F.col("attributes")["scope_hint"].alias("scope_hint"), F.col("kind").alias("edge_kind"), "provenance", "owner")
    return lost, back.where("seeking is not null")


# ---- updates


def apply_update(held: store.Store, changed: DataFrame, gone: DataFrame | None = None, packs: tuple[Pack, ...] = PACKS, rebuild: bool = False, strict: bool = False) -> int:
    """Takes files (root, path, content[, artifact_class]) in, and files `gone` (root, path) out: one revision.

    What the files' owners claimed is replaced; new definitions take the references that seek them, of old files and of new
    ones; edges to definitions that went become references again. With `rebuild` nothing else stays, and with `strict` a
    file that a pack failed on ends it all. The revision of the graph.
    """
    scratch = Scratch(held.spark)
    facts = scratch.save(extract.tagged(changed, packs), "facts")
    if strict and not facts.where("tag = 'diagnostic'").isEmpty():
        raise store.StoreError("a pack failed: " + facts.where("tag = 'diagnostic'").first()["name"])
    out: list[int] = []

    def change(t: claims.Transaction) -> None:
        base = t.view.revision()
        revision = base + 1
        new = extract.tables(facts, revision)
        before = {k: t.view.table(k) for k in ("nodes", "edges")}
        if rebuild:
            records = t.store.meta(t.base)
            t.clear_graph()
            t.meta |= records
        files = changed.select("root", "path") if gone is None else changed.select("root", "path").unionByName(gone.select("root", "path"))
        if not rebuild:
            t.remove_by_file(files)
        t.put_nodes(new["nodes"])
        t.put_edges(new["edges"])
        t.put_unresolved(new["unresolved"])
        t.put_skips(new["skips"])
        t.put_diagnostics(new["diagnostics"])
        for name in ("nodes", "edges", "unresolved"):
            t[name] = scratch.save(t[name], f"{name}-{t.base}")
        lost, back = demoted(t["edges"], t["nodes"])
        lost = scratch.save(lost, f"lost-{t.base}")
        t.remove_edge_claims(lost)
        t.put_unresolved(back)
        # Edges of the same reference by another producer hold it already.
        met = scratch.save(promoted(t["unresolved"], new["nodes"].where(~F.col("kind").isin("file", "document"))), f"promoted-{t.base}")
        t.put_edges(_edges(met, PROMOTER, revision))
        t.remove_unresolved(met)
        for name in ("edges", "unresolved"):
            t[name] = scratch.save(t[name], f"after-{name}-{t.base}")
        t.set_revision(revision)
        t.put_index_intent("lexical")
        counted = facts.groupBy("tag").count().collect()
        n = {r["tag"]: r["count"] for r in counted}
        t.put_summary(revision=revision, files=files.distinct().count(), nodes_added=n.get("node", 0), edges_added=n.get("edge", 0), unresolved_added=n.get("unresolved", 0), promoted=met.count(), demoted=lost.count(), nodes_removed=_removed(before["nodes"], t["nodes"], ["node_id", "owner"]), edges_removed=_removed(before["edges"], t["edges"], ["edge_id", "owner"]))
        out[:] = [revision]

    claims.transact(held, change)
    return out[0]


def _removed(before: DataFrame, after: DataFrame, keys: list[str]) -> int:
    return before.select(*keys).join(after.select(*keys), keys, "left_anti").count()


def apply_removal(held: store.Store, gone: DataFrame) -> int:
    """Takes files (root, path) out."""
    none = held.spark.createDataFrame([], "root string, path string, content binary, artifact_class string")
    return apply_update(held, none, gone)


def resolve_existing(held: store.Store) -> int:
    """Every pending reference to every node of exactly that name; the number of edges. A revision of its own."""
    scratch = Scratch(held.spark)
    made: list[int] = []

    def change(t: claims.Transaction) -> None:
        revision = t.view.revision() + 1
        met = scratch.save(resolved(t["unresolved"], t["nodes"].where(~F.col("kind").isin("file", "document"))), f"resolved-{t.base}")
        t.put_edges(_edges(met, RESOLVER, revision))
        t.remove_unresolved(met.select("from_id", "seeking", "edge_kind").distinct())
        t.set_revision(revision)
        made[:] = [met.count()]
        t.put_summary(revision=revision, resolved=made[0])

    claims.transact(held, change)
    return made[0]


def index_source(held: store.Store, files: DataFrame, packs: tuple[Pack, ...] = PACKS) -> int:
    """Takes all files in again; files that are no longer there go."""
    there = files.select("root", "path")
    gone = claims.View(held).files().join(there, ["root", "path"], "left_anti")
    return apply_update(held, files, gone, packs)


def rebuild_source(held: store.Store, files: DataFrame, packs: tuple[Pack, ...] = PACKS) -> int:
    """The graph of these files alone, as one revision; a pack's failure leaves the graph before."""
    return apply_update(held, files, packs=packs, rebuild=True, strict=True)


# ---- versions


@dataclass(frozen=True)
class Scope:
    """What a change of versions invalidates: classification, resolution, registry, schema, pack or extractor."""

    kind: str
    name: str = ""
    previous: str | None = None


def plan_invalidation(stored: dict | None, current: dict) -> list[Scope]:
    """Scopes of the versions that differ; none where nothing is stored yet."""
    if not stored:
        return []
    out = [Scope(k, previous=str(stored.get(k))) for k in ("schema", "registry", "classification", "resolution") if stored.get(k) != current.get(k)]
    for kind, field in (("pack", "packs"), ("extractor", "extractors")):
        old, new = stored.get(field, {}), current.get(field, {})
        out += [Scope(kind, name, old.get(name)) for name in sorted({*old, *new}) if old.get(name) != new.get(name)]
    return out


def invalidate_producer(held: store.Store, producer: str, version: str | None = None) -> DataFrame:
    """Drops a producer's facts; (root, path) of the files that need it again."""
    view = claims.View(held)
    owners = Scratch(held.spark).save(view.owners_by_producer(producer, version), "owners")
    if not owners.isEmpty():
        claims.transact(held, lambda t: t.remove_claims(owners))
    return owners.select("root", "path").distinct()


def invalidate_resolution(held: store.Store) -> int:
    """Drops edges by resolution; their references are pending again. The number of edges."""
    scratch, n = Scratch(held.spark), []

    def change(t: claims.Transaction) -> None:
        lost = scratch.save(t["edges"].where(F.col("owner.producer").isin(PROMOTER, RESOLVER)), f"lost-{t.base}")
        back = lost.select("from_id", F.col("attributes")["seeking"].alias("seeking"), F.col("attributes")["scope_hint"].alias("scope_hint"), F.col("kind").alias("edge_kind"), "provenance", "owner").where("seeking is not null")
        t.remove_edge_claims(lost)
        t.put_unresolved(back)
        n[:] = [lost.count()]

    claims.transact(held, change)
    return n[0]


def invalidate_all(held: store.Store) -> int:
    return claims.transact(held, lambda t: t.clear_graph())


def reclassify(held: store.Store, classify: Callable[[Column], Column] = sources.artifact_class) -> int:
    """Classes of all nodes' files by a rule, from stored facts alone; the number of claims that changed."""
    n: list[int] = []

    def change(t: claims.Transaction) -> None:
        rows = t["nodes"].select("node_id", "owner", F.col("artifact_class").alias("__old"), classify(F.col("path")).alias("artifact_class"))
        moved = Scratch(held.spark).save(rows.where(~F.col("__old").eqNullSafe(F.col("artifact_class"))).drop("__old"), "classes")
        n[:] = [moved.count()]
        if n[0]:
            t.update_node_classifications(moved)

    claims.transact(held, change)
    return n[0]


def execute(held: store.Store, scopes: list[Scope], files: Callable[[], DataFrame], packs: tuple[Pack, ...] = PACKS) -> None:
    """Carries out what a plan says: reclassifies, drops resolved edges, takes a pack's files in again, or rebuilds."""
    if any(s.kind in ("registry", "schema") for s in scopes):
        invalidate_all(held)
        apply_update(held, files(), packs=packs, rebuild=True)
        return
    targeted = None
    for s in scopes:
        if s.kind == "classification":
            reclassify(held)
        elif s.kind == "resolution":
            invalidate_resolution(held)
        elif s.kind in ("pack", "extractor"):
            producer = s.name if s.kind == "extractor" else f"{s.name}_pack"
            one = invalidate_producer(held, producer, s.previous)
            targeted = one if targeted is None else targeted.unionByName(one)
    if targeted is not None:
        again = files().join(targeted.distinct(), ["root", "path"], "left_semi")
        apply_update(held, again, packs=packs)


# ---- orchestration


def index_worktree(spark: SparkSession, held: store.Store, folder: str, root: str = "main", packs: tuple[Pack, ...] = PACKS, rebuild: bool = False, **walk) -> dict:
    """All of a folder: what versions invalidate, then the files, resolution, the lexical index and a compaction."""
    view, current = claims.View(held), current_versions(packs)
    walked = lambda: sources.walk(spark, folder, root, **walk)
    scopes = plan_invalidation(view.version_records(), current)
    if rebuild:
        apply_update(held, walked(), packs=packs, rebuild=True)
    elif scopes:
        execute(held, scopes, walked, packs)
    else:
        index_source(held, walked(), packs)
    edges = resolve_existing(held)

    def finish(t: claims.Transaction) -> None:
        t.rebuild_lexical()
        t.put_version_records(current)

    claims.transact(held, finish)
    nodes, all_edges = claims.View(held).counts()
    return {"scopes": scopes, "resolved": edges, "revision": claims.View(held).revision(), "nodes": nodes, "edges": all_edges}


def sync(spark: SparkSession, held: store.Store, folder: str, root: str = "main", deletions: bool = False) -> int | None:
    """Files that version control calls changed; None where there are none."""
    changed = Vcs(spark, folder).changed(deletions).collect()
    return update_files(spark, held, folder, [r["path"] for r in changed], root) if changed else None


def update_files(spark: SparkSession, held: store.Store, folder: str, paths: list[str], root: str = "main") -> int:
    """Files of a folder by their paths; those that aren't there or aren't allowed are taken out."""
    named = spark.createDataFrame([(root, p, f"{folder.rstrip('/')}/{p}") for p in sorted(set(paths))], "root string, path string, address string")
    path = F.col("path")
    there = Scratch(spark).save(sources.read(named.where(sources.contained(path) & ~sources.excluded(path))).where("content is not null"), "files")
    gone = named.select("root", "path").join(there.select("root", "path"), ["root", "path"], "left_anti")
    return apply_update(held, there.withColumn("artifact_class", sources.artifact_class(path)), gone)


def rebuild(spark: SparkSession, held: store.Store, what: str, folder: str | None = None, root: str = "main") -> dict:
    """graph, lexical, vector or all. Vectors are kept by their tables alone, so that part is always unavailable."""
    if what not in ("graph", "lexical", "vector", "all"):
        raise ValueError(f"{what} can't be rebuilt")
    out: dict = {}
    if what in ("graph", "all"):
        if folder is None:
            raise ValueError("the graph is rebuilt from a folder")
        out["graph"] = index_worktree(spark, held, folder, root, rebuild=True)["revision"]
    if what in ("lexical", "all"):
        claims.transact(held, lambda t: t.rebuild_lexical())
        out["lexical"] = "current"
    if what in ("vector", "all"):
        out["vector"] = "unavailable"
    return out


# Endings of paths by how far a change of them may reach.
GLOBAL, DEPENDENCY = ("Cargo.toml", "package.json", "tsconfig.json"), ("mod.rs", "index.ts", "lib.rs")


def blast_radius_class(path: Column) -> Column:
    """global (what configures a whole project), dependency (what others import from), or local."""
    ends = lambda names: path.rlike("(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    return F.when(ends(GLOBAL), "global").when(ends(DEPENDENCY), "dependency").otherwise("local")
