"""The graph store: claim tables in a versioned store, their reads (`View`) and their mutations (`Transaction`).

A fact is there once for each owner that claims it; the canonical graph has it once. Tables that a mutation does not touch
are carried to the next revision as they are; a commit is one manifest, whatever the number of files and facts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.model import KEYS, TABLES, TRANSITIVE_KINDS, known_kinds, shaped
from lodegraph.operators import graph, lexical, store

FACTS = ("nodes", "edges", "unresolved", "skips", "diagnostics")


class View:
    """Reads of one revision."""

    def __init__(self, held: store.Store, revision: int | None = None):
        self.store, self.spark = held, held.spark
        self.at = held.revision() if revision is None else revision
        self._tables = held.manifest(self.at)

    def table(self, name: str) -> DataFrame:
        """A claim table; empty where nothing was written yet."""
        if name not in self._tables:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(self.spark.createDataFrame([], TABLES[name]).schema).parquet(f"{self.store.folder}/tables/{self._tables[name]}")

    # ---- the canonical graph

    def nodes(self) -> DataFrame:
        """Each node once: of several claims that of the least owner."""
        claims = known_kinds(self.table("nodes"), "nodes")
        rest = [c for c in claims.columns if c != "node_id"]
        return claims.groupBy("node_id").agg(F.min_by(F.struct(*rest), "owner").alias("x")).select("node_id", "x.*")

    def edges(self) -> DataFrame:
        claims = known_kinds(self.table("edges"), "edges")
        rest = [c for c in claims.columns if c != "edge_id"]
        return claims.groupBy("edge_id").agg(F.min_by(F.struct(*rest), "owner").alias("x")).select("edge_id", "x.*")

    # ---- point and range reads

    def node(self, node_id: str) -> DataFrame:
        return known_kinds(self.table("nodes"), "nodes").where(F.col("node_id") == node_id).orderBy("owner").limit(1)

    def nodes_by_name(self, name: str, **filters) -> DataFrame:
        """Equal but for the case, or containing; % and _ in the name are wildcards."""
        fits = (F.lower("name") == name.lower()) | F.col("name").ilike(f"%{name}%")
        return filtered_nodes(self.nodes().where(fits), **filters)

    def nodes_by_file(self, root: str, path: str) -> DataFrame:
        return self.nodes().where((F.col("root") == root) & (F.col("path") == path))

    def node_claims_by_file(self, root: str, path: str) -> DataFrame:
        of = (F.col("owner.root") == root) & (F.col("owner.path") == path)
        return known_kinds(self.table("nodes"), "nodes").where(of).orderBy("node_id", "owner.producer", "owner.producer_version")

    def edges_from(self, node_id: str, **filters) -> DataFrame:
        return filtered_edges(self.edges().where(F.col("from_id") == node_id), self.nodes(), **filters).orderBy("edge_id")

    def edges_to(self, node_id: str, **filters) -> DataFrame:
        return filtered_edges(self.edges().where(F.col("to_id") == node_id), self.nodes(), **filters).orderBy("edge_id")

    def in_degree(self) -> DataFrame:
        """(node_id, in_degree) by claims."""
        return self.table("edges").groupBy(F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))

    def unresolved_seeking(self, name: str) -> DataFrame:
        return known_kinds(self.table("unresolved"), "unresolved").where(F.col("seeking") == name)

    def unresolved(self) -> DataFrame:
        return known_kinds(self.table("unresolved"), "unresolved").orderBy("seeking", "from_id", "edge_kind")

    def _optional(self, name: str, root: str | None, path: str | None) -> DataFrame:
        out = self.table(name)
        out = out if root is None else out.where(F.col("owner.root") == root)
        return out if path is None else out.where(F.col("owner.path") == path)

    def skips(self, root: str | None = None, path: str | None = None) -> DataFrame:
        return self._optional("skips", root, path)

    def diagnostics(self, root: str | None = None, path: str | None = None) -> DataFrame:
        return self._optional("diagnostics", root, path)

    def changes_since(self, revision: int) -> DataFrame:
        return self.table("history").where(F.col("revision") > revision).orderBy("revision")

    # ---- owners, files, singletons

    def owners(self) -> DataFrame:
        """Every owner of a fact, in order."""
        found = None
        for name in FACTS:
            one = self.table(name).select("owner.*").distinct()
            found = one if found is None else found.unionByName(one)
        return found.distinct().orderBy("root", "path", "producer", "producer_version")

    def owners_by_producer(self, producer: str, version: str | None = None) -> DataFrame:
        of = self.owners().where(F.col("producer") == producer)
        return of if version is None else of.where(F.col("producer_version") == version)

    def resolution_owners(self) -> DataFrame:
        """Owners of edges that were resolved or guessed."""
        return self.table("edges").where(F.col("provenance.derivation").isin("resolved", "heuristic")).select("owner.*").distinct()

    def files(self) -> DataFrame:
        return self.owners().select("root", "path").distinct()

    def version_records(self) -> dict | None:
        return self.store.meta(self.at).get("versions")

    def index_states(self) -> DataFrame:
        return self.table("index_state")

    def revision(self) -> int:
        """Of the graph: it counts updates, the store's counts commits."""
        return int(self.store.meta(self.at).get("revision", 0))

    def counts(self) -> tuple[int, int]:
        """Distinct nodes and edges."""
        return tuple(self.table(t).select(k).distinct().count() for t, k in (("nodes", "node_id"), ("edges", "edge_id")))

    # ---- outlines

    def outline(self, root: str, path: str) -> DataFrame:
        """(name, qualified_name, kind, range_preview) of a file's nodes but itself."""
        lines = F.concat(F.col("range.start_line").cast("string"), F.lit("-"), F.col("range.end_line").cast("string"))
        return self.nodes_by_file(root, path).where(~F.col("kind").isin("file", "document")).orderBy("node_id").select("name", "qualified_name", "kind", lines.alias("range_preview"))

    def at_position(self, root: str, path: str, line: int, column: int | None = None) -> DataFrame:
        """The smallest node around a line (and column, if that is to count)."""
        r = lambda f: F.col(f"range.{f}")
        around = (r("start_line") <= line) & (r("end_line") >= line)
        if column is not None:
            around &= ((r("start_line") < line) | (r("start_column") <= column)) & ((r("end_line") > line) | (r("end_column") >= column))
        return self.nodes_by_file(root, path).where(around).orderBy(r("end") - r("start"), "node_id").limit(1)


def filtered_nodes(nodes: DataFrame, kinds: tuple[str, ...] = (), roots: tuple[str, ...] = (), paths: tuple[str, ...] = (), classes: tuple[str, ...] = (), exclude: tuple[str, ...] = (), languages: tuple[str, ...] = (), derivations: tuple[str, ...] = (), changed_since: int | None = None) -> DataFrame:
    """Nodes by kind, root, path prefix, artifact class, language, derivation and revision; `exclude` are path prefixes."""
    for column, values in (("kind", kinds), ("root", roots), ("language", languages), ("artifact_class", () if "all" in classes else classes), ("provenance.derivation", derivations)):
        nodes = nodes.where(F.col(column).isin(*values)) if values else nodes
    starts = lambda prefixes: _any([F.col("path").startswith(p) for p in prefixes])
    nodes = nodes.where(starts(paths)) if paths else nodes
    nodes = nodes.where(~starts(exclude)) if exclude else nodes
    return nodes if changed_since is None else nodes.where(F.col("provenance.revision") > changed_since)


def filtered_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = (), target_kinds: tuple[str, ...] = (), transitive: bool = False) -> DataFrame:
    """Edges by kind and by the kind of what they lead to; `transitive`: of the kinds that carry over."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    edges = edges.where(F.col("kind").isin(*TRANSITIVE_KINDS)) if transitive else edges
    if target_kinds:
        wanted = nodes.where(F.col("kind").isin(*target_kinds)).select(F.col("node_id").alias("to_id"))
        edges = edges.join(wanted, "to_id", "left_semi")
    return edges


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


class Transaction:
    """Mutations on a revision, made visible together by `commit`. Tables are lazy until then."""

    def __init__(self, held: store.Store, base: int | None = None):
        self.view = View(held, base)
        self.store, self.spark, self.base = held, held.spark, self.view.at
        self.changed: dict[str, DataFrame] = {}
        self.meta: dict = {}
        self.cleared = False

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.changed:
            return self.changed[name]
        return self.spark.createDataFrame([], TABLES[name]) if self.cleared else self.view.table(name)

    def __setitem__(self, name: str, rows: DataFrame) -> None:
        self.changed[name] = shaped(rows, name)

    def _put(self, name: str, rows: DataFrame) -> None:
        """Upsert by the table's key; of new rows of one key one stays."""
        keys = list(KEYS[name])
        rest = [c for c in rows.columns if c not in keys]
        if rest:
            order = F.to_json(F.struct(*rest))
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
        self[name] = store.upsert(self[name], shaped(rows, name), keys)

    def put_nodes(self, rows: DataFrame) -> None:
        self._put("nodes", rows)

    def put_edges(self, rows: DataFrame) -> None:
        self._put("edges", rows)

    def put_unresolved(self, rows: DataFrame) -> None:
        self._put("unresolved", rows)

    def put_skips(self, rows: DataFrame) -> None:
        self._put("skips", rows)

    def put_diagnostics(self, rows: DataFrame) -> None:
        """Plainly appended."""
        self["diagnostics"] = self["diagnostics"].unionByName(shaped(rows, "diagnostics"))

    def _remove(self, name: str, keys: DataFrame) -> None:
        self[name] = store.remove(self[name], keys)

    def remove_node_claims(self, keys: DataFrame) -> None:
        """By (node_id, owner)."""
        self._remove("nodes", keys.select("node_id", "owner"))

    def remove_edge_claims(self, keys: DataFrame) -> None:
        self._remove("edges", keys.select("edge_id", "owner"))

    def remove_unresolved(self, keys: DataFrame) -> None:
        self._remove("unresolved", keys.select("from_id", "seeking", "edge_kind"))

    def remove_claims(self, owners: DataFrame) -> None:
        """All facts of owners (root, path, producer, producer_version), in all five tables."""
        gone = owners.select(F.struct("root", "path", "producer", "producer_version").alias("owner"))
        for name in FACTS:
            self._remove(name, gone)

    def remove_by_file(self, files: DataFrame) -> None:
        """All facts of files (root, path), whoever produced them."""
        gone = files.select(F.col("root").alias("__r"), F.col("path").alias("__p")).distinct()
        for name in FACTS:
            rows = self[name]
            self[name] = rows.join(gone, (F.col("owner.root") == F.col("__r")) & (F.col("owner.path") == F.col("__p")), "left_anti")

    def clear_graph(self) -> None:
        self.changed, self.meta, self.cleared = {}, {}, True

    def update_node_classifications(self, classes: DataFrame) -> None:
        """(node_id, owner, artifact_class): an error if a claim isn't there."""
        if not classes.join(self["nodes"], ["node_id", "owner"], "left_anti").isEmpty():
            raise store.StoreError("a claim to classify is not there")
        new = classes.select("node_id", "owner", F.col("artifact_class").alias("__new"))
        self["nodes"] = self["nodes"].join(new, ["node_id", "owner"], "left").withColumn("artifact_class", F.coalesce("__new", "artifact_class")).drop("__new")

    def put_summary(self, **counts: int) -> None:
        row = {"revision": self.meta.get("revision", self.view.revision()), "created_at": int(time.time())} | counts
        names = [x.split(" ")[0] for x in TABLES["history"].split(", ")]
        one = self.spark.createDataFrame([tuple(int(row.get(n, 0)) for n in names)], TABLES["history"])
        self["history"] = self["history"].unionByName(one)

    def put_version_records(self, versions: dict) -> None:
        self.meta["versions"] = versions

    def set_revision(self, revision: int) -> None:
        self.meta["revision"] = revision

    def put_index_intent(self, kind: str) -> None:
        """Says that an index is behind."""
        old = {r["kind"]: r["acknowledged_revision"] for r in self["index_state"].collect()}
        self._put("index_state", self.spark.createDataFrame([(kind, old.get(kind, 0), False)], TABLES["index_state"]))

    def acknowledge_index(self, kind: str, revision: int) -> None:
        self._put("index_state", self.spark.createDataFrame([(kind, revision, True)], TABLES["index_state"]))

    def rebuild_lexical(self) -> None:
        """The inverted index from the canonical nodes, marked as current."""
        claims = known_kinds(self["nodes"], "nodes")
        nodes = claims.groupBy("node_id").agg(*(F.min_by(c, "owner").alias(c) for c in ("name", "qualified_name", "path", "attributes")))
        self["postings"] = lexical.postings(nodes)
        self["lengths"] = lexical.lengths(nodes)
        self.acknowledge_index("lexical", int(self.meta.get("revision", self.view.revision())))

    def expect_revision(self, revision: int) -> None:
        if self.view.revision() != revision:
            raise store.Conflict(f"revision {self.view.revision()} is not {revision}")

    def commit(self) -> int:
        return self.store.commit(self.base, self.changed, self.meta, self.cleared)

    def rollback(self) -> None:
        self.changed, self.meta, self.cleared = {}, {}, False


def transact(held: store.Store, change: Callable[[Transaction], None], attempts: int = 2) -> int:
    """Runs a change on the newest revision and commits it; after a conflict once more."""
    while True:
        attempts -= 1
        own = Transaction(held)
        change(own)
        try:
            return own.commit()
        except store.Conflict:
            if attempts <= 0:
                raise


def invariants(nodes: DataFrame, edges: DataFrame, astray: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(invariant, id) of what breaks a well-formed graph: ids that are no digests, unknown kinds, edges with a missing end,
    edges from a node to itself by containment, nodes in two containers of one root, containers in a cycle (within
    the depth a tree of these nodes can have), ranges that end before they start, files under two nodes. `astray`: the edges
    (edge_id) from and to missing nodes, where the caller has found them already."""
    from lodegraph.model import EDGE_KINDS, NODE_KINDS

    def broken(rows: DataFrame, name: str, key: str) -> DataFrame:
        return rows.select(F.lit(name).alias("invariant"), F.col(key).alias("id"))

    nowhere = astray or graph.astray(nodes, edges)
    contained = edges.where("kind = 'contains'").select("from_id", "to_id").distinct()
    parts = [
        broken(nodes.where(~F.col("node_id").rlike("^[0-9a-f]{64}$")), "node id is no digest", "node_id"),
        broken(edges.where(~F.col("edge_id").rlike("^[0-9a-f]{64}$")), "edge id is no digest", "edge_id"),
        broken(nodes.where(~F.col("kind").isin(*NODE_KINDS)), "node kind is unknown", "node_id").unionByName(broken(edges.where(~F.col("kind").isin(*EDGE_KINDS)), "edge kind is unknown", "edge_id")),
        broken(nowhere[0], "edge leads from nowhere", "edge_id").unionByName(broken(nowhere[1], "edge leads nowhere", "edge_id")),
        broken(contained.groupBy("to_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "node has two containers", "to_id"),
        broken(nodes.where(F.col("kind").isin("file", "document")).groupBy("root", "path").agg(F.count(F.lit(1)).alias("c"), F.min("node_id").alias("id")).where("c > 1"), "file has two nodes", "id"),
    ]
    if "range" in nodes.columns:
        parts.append(broken(nodes.where((F.col("range.end") < F.col("range.start")) | (F.col("range.start_line") < 1)), "range ends before it starts", "node_id"))
    parts.append(broken(cycles(contained), "containers are in a cycle", "node_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cycles(edges: DataFrame) -> DataFrame:
    """(node_id) of nodes that reach themselves or lie between cycles: what is left when nodes without an edge in, then
    those without one out, are taken away again and again. Each round is written."""
    from lodegraph.scratch import Scratch

    scratch, left, step = Scratch(edges.sparkSession), edges.select("from_id", "to_id"), 0
    size = -1
    while True:
        left = scratch.save(left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi"), f"left{step}")
        now = left.count()
        if now in (0, size):
            return left.select(F.col("from_id").alias("node_id")).unionByName(left.select(F.col("to_id").alias("node_id"))).distinct()
        size, step = now, step + 1


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def open_view(spark: SparkSession, folder: str) -> View:
    return View(store.Store(spark, folder, create=False))
