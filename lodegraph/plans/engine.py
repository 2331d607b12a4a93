"""The closed set of requests over a project: a folder of files, the store of its graph, a configuration."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import config as configuration
from lodegraph.operators import claims, context, indexing, retrieval, search, store
from lodegraph.plans.envelope import Envelope, Freshness, Truncation, Warned, failed, now
from lodegraph.providers import Unavailable, reranked
from lodegraph.sources import files as sources


class Engine:
    """Answers requests by methods, or by `dispatch` of a name and its arguments."""

    REQUESTS = ("search_direct", "search_graph", "search_hybrid", "inspect_file", "at_position", "entity", "neighbors", "impact", "path", "context", "review_context", "index_all", "rebuild", "sync_vcs", "update_files", "rerank", "eval", "status")

    def __init__(self, spark: SparkSession, folder: str, state: str, config: dict | None = None, root: str = "main", files: DataFrame | None = None):
        """`files` (root, path, content): what is searched and quoted instead of the folder's own."""
        self.spark, self.folder, self.state, self.root = spark, folder, state, root
        self.config = configuration.validated(config or configuration.DEFAULTS)
        self._files = files

    # ---- parts

    def files(self) -> DataFrame:
        if self._files is not None:
            return self._files
        i = self.config["indexing"]
        return sources.walk(self.spark, self.folder, self.root, tuple(i["exclude_extensions"]), tuple(i["exclude_paths"]), i["respect_gitignore"], i["max_file_size_bytes"])

    def view(self) -> claims.View:
        return claims.View(store.Store(self.spark, self.state, create=False))

    def _freshness(self, view: claims.View) -> Freshness:
        states = {r["kind"]: r for r in view.index_states().collect()}
        lexical = states.get("lexical")
        return Freshness(view.revision(), "current", lexical["acknowledged_revision"] if lexical else None, "disabled" if lexical is None else "current" if lexical["is_current"] else "bypassed_lagging", "complete", now())

    def _answer(self, ask: Callable[[claims.View], Envelope]) -> Envelope:
        try:
            view = self.view()
        except store.StoreError as e:
            return failed("unavailable", "PROJECT_STATE_NEWER" if "format" in str(e) else "PROJECT_NOT_INITIALIZED", str(e))
        out = ask(view)
        out.freshness = self._freshness(view)
        out.sources = out.sources or ["graph"]
        return out

    def _found(self, found: retrieval.Found, limit: int) -> Envelope:
        warnings = [Warned("CAPABILITY_UNAVAILABLE", w) for w in found.warnings]
        cut = None
        if found.truncated:
            warnings.append(Warned("RESULT_TRUNCATED", f"there are more than {limit}"))
            cut = Truncation(limit, "limit")
        return Envelope("partial" if found.warnings else "ok", found.rows, warnings, truncation=cut)

    def dispatch(self, request: str, **arguments: Any) -> Envelope:
        if request not in self.REQUESTS:
            return failed("invalid", "INVALID_QUERY", f"{request} is no request")
        try:
            return getattr(self, request)(**arguments)
        except (TypeError, ValueError) as e:
            return failed("invalid", "INVALID_QUERY", str(e))

    # ---- search

    def search_direct(self, pattern: str, is_regex: bool = False, limit: int | None = None) -> Envelope:
        limit = self.config["retrieval"]["default_limit"] if limit is None else limit
        try:
            rows = search.direct(self.files(), pattern, is_regex)
        except ValueError as e:
            return failed("invalid", "INVALID_QUERY", str(e))
        ordered = rows.orderBy("root", "path", "start")
        more = ordered.limit(limit + 1).count() > limit
        return Envelope("ok", ordered.limit(limit), [Warned("RESULT_TRUNCATED", f"there are more than {limit}")] if more else [], ["working_tree"], Freshness(observed_at=now()), Truncation(limit, "limit") if more else None)

    def search_graph(self, query: str, limit: int | None = None) -> Envelope:
        limit = self.config["retrieval"]["default_limit"] if limit is None else limit
        return self._answer(lambda v: self._found(retrieval.search_graph(v, query, limit), limit))

    def search_hybrid(self, query: str, limit: int | None = None, vectors: DataFrame | None = None) -> Envelope:
        r = self.config["retrieval"]
        limit = r["default_limit"] if limit is None else limit
        return self._answer(lambda v: self._found(retrieval.search_hybrid(v, query, limit, r["centrality_boost"], vectors), limit))

    def search(self, query: str, mode: str | None = None, limit: int | None = None) -> Envelope:
        """By mode: hybrid, graph, direct or regex."""
        mode = mode or self.config["retrieval"]["default_mode"]
        if mode in ("direct", "regex"):
            return self.search_direct(query, mode == "regex", limit)
        return self.search_graph(query, limit) if mode == "graph" else self.search_hybrid(query, limit)

    # ---- files and graph

    def inspect_file(self, path: str) -> Envelope:
        return self._answer(lambda v: Envelope("ok", v.outline(self.root, path)))

    def at_position(self, path: str, line: int, column: int | None = None, strict: bool = False) -> Envelope:
        def ask(v: claims.View) -> Envelope:
            rows = v.at_position(self.root, path, line, column if strict else None)
            return failed("not_found", "ENTITY_NOT_FOUND", f"nothing is around {path}:{line}") if rows.isEmpty() else Envelope("ok", rows)

        return self._answer(ask)

    def _of(self, rows: DataFrame | None, name: str, code: str = "ENTITY_NOT_FOUND") -> Envelope:
        return failed("not_found", code, f"{name} is not in the graph") if rows is None else Envelope("ok", rows)

    def entity(self, name: str) -> Envelope:
        def ask(v: claims.View) -> Envelope:
            at = retrieval.entity(v, name)
            return self._of(None if at is None else v.node(at), name)

        return self._answer(ask)

    def neighbors(self, name: str, depth: int = 1, **filters: Any) -> Envelope:
        return self._answer(lambda v: self._of(retrieval.neighbors(v, name, **filters), name))

    def impact(self, name: str | list[str], depth: int = 3, kinds: list[str] | None = None) -> Envelope:
        return self._answer(lambda v: self._of(retrieval.impact(v, [name] if isinstance(name, str) else name, depth, kinds), str(name)))

    def path(self, source: str, target: str, depth: int = 5) -> Envelope:
        def ask(v: claims.View) -> Envelope:
            rows = retrieval.paths(v, source, target, depth)
            if rows is None:
                return self._of(None, f"{source} or {target}")
            return failed("not_found", "NO_PATH_FOUND", f"no path of {depth} edges") if rows.isEmpty() else Envelope("ok", rows.orderBy("depth", "edges"))

        return self._answer(ask)

    # ---- context

    def _assembled(self, v: claims.View, seeds: DataFrame, budget: int) -> Envelope:
        c = self.config["context"]
        nodes, edges = v.nodes(), v.edges()
        rows = context.assembled(nodes, edges, seeds, self.files(), c["padding_lines"], blast_radius=c["include_blast_radius"], source=c["include_verbatim_source"], bytes=budget).orderBy("seq")
        whole, kept = context.neighborhood(nodes, edges, seeds).select("node_id").distinct().count(), rows.count()
        cut = Truncation(kept, "bytes", whole) if kept < whole else None
        return Envelope("ok", rows, [Warned("RESULT_TRUNCATED", f"{kept} of {whole} fit")] if cut else [], ["graph", "working_tree"], truncation=cut)

    def context(self, query: str, budget: int = 64 << 10) -> Envelope:
        return self._answer(lambda v: self._assembled(v, retrieval.search_graph(v, query, 5).rows.select("node_id"), budget))

    def review_context(self, since: int | None = None, budget: int = 64 << 10) -> Envelope:
        """What changed after a revision of the graph, with its neighbours; without one, nodes named like main."""

        def ask(v: claims.View) -> Envelope:
            nodes = v.nodes()
            changed = None if since is None else nodes.where(F.col("provenance.revision") > since).select("root", "path")
            return self._assembled(v, context.review_seeds(nodes, changed), budget)

        return self._answer(ask)

    # ---- maintenance

    def _store(self) -> store.Store:
        return store.Store(self.spark, self.state)

    def index_all(self) -> Envelope:
        i = self.config["indexing"]
        return Envelope("ok", indexing.index_worktree(self.spark, self._store(), self.folder, self.root, extensions=tuple(i["exclude_extensions"]), globs=tuple(i["exclude_paths"]), gitignore=i["respect_gitignore"], most_bytes=i["max_file_size_bytes"]))

    def rebuild(self, what: str = "all") -> Envelope:
        got = indexing.rebuild(self.spark, self._store(), what, self.folder, self.root)
        vectors = [Warned("CAPABILITY_UNAVAILABLE", "vectors are kept by their tables")] if got.get("vector") else []
        return Envelope("unavailable" if what == "vector" else "ok", got, vectors)

    def sync_vcs(self, deletions: bool = False) -> Envelope:
        revision = indexing.sync(self.spark, self._store(), self.folder, self.root, deletions)
        return Envelope("ok", {"revision": revision})

    def update_files(self, paths: list[str]) -> Envelope:
        return Envelope("ok", {"revision": indexing.update_files(self.spark, self._store(), self.folder, paths, self.root)})

    def rerank(self, query: str, ask: Callable[[str, list[dict]], str] | None = None, top_n: int = 20, limit: int | None = None) -> Envelope:
        """By a caller's function, or by the configured provider's scores."""
        limit = self.config["retrieval"]["default_limit"] if limit is None else limit

        def answer(v: claims.View) -> Envelope:
            found = retrieval.search_hybrid(v, query, limit, self.config["retrieval"]["centrality_boost"])
            if ask is not None:
                return self._found(retrieval.rerank(found, query, ask, top_n), limit)
            rows = found.rows.select(F.concat(F.lit("node_"), F.substring("node_id", 1, 12)).alias("shown"), F.concat_ws(" ", "name", "qualified_name", "path").alias("content"))
            try:
                hits = reranked(rows, query, self.config["intelligence"]["rerank"]["provider"], "shown")
            except Unavailable as e:
                return Envelope("partial", found.rows, [Warned("CAPABILITY_UNCONFIGURED", str(e))])
            return self._found(retrieval.rerank_with_scores(found, hits), limit)

        return self._answer(answer)

    def eval(self, queries: list[tuple[str, str]], limit: int = 10) -> Envelope:
        """Queries and the names that they should find: precision at 1 and 5, mean reciprocal rank."""

        def ask(v: claims.View) -> Envelope:
            ranked = None
            for q, _ in queries:
                one = retrieval.search_hybrid(v, q, limit).rows.select(F.lit(q).alias("query"), "name", "score", "node_id")
                ranked = one if ranked is None else ranked.unionByName(one)
            if ranked is None:
                return failed("invalid", "INVALID_QUERY", "there are no queries")
            return Envelope("ok", retrieval.evaluated(ranked, self.spark.createDataFrame(queries, "query string, name string")))

        return self._answer(ask)

    def status(self) -> Envelope:
        def ask(v: claims.View) -> Envelope:
            nodes, edges = v.counts()
            return Envelope("ok", {"nodes": nodes, "edges": edges, "files": v.files().count(), "unresolved": v.unresolved().count(), "skips": v.skips().count(), "diagnostics": v.diagnostics().count(), "revision": v.revision()})

        return self._answer(ask)
