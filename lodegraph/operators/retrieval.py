"""Ranked retrieval over a graph: lexical and name candidates united, fused scores, vector bonus, reranking, entities, paths."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import graph, lexical, search
from lodegraph.operators.claims import View

#: The factor of over-fetched lexical hits, of the vector bonus and its floor, of reranked candidates.
HYBRID_FETCH, GRAPH_FETCH, VECTOR_BONUS, EPSILON, AGENT_BONUS = 3, 2, 0.2, 1.1920929e-07, 0.35
#: Tokens of a query that ask for names have so many bytes at least.
NAME_BYTES = 3


@dataclass
class Found:
    """Ranked rows, and whether more were there."""

    rows: DataFrame
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)


def _cut(ranked: DataFrame, limit: int) -> Found:
    """The first `limit` rows by score, then id; a further row tells that there are more."""
    if limit <= 0:
        return Found(ranked.limit(0), not ranked.isEmpty())
    order = (F.desc("score"), "node_id")
    more = ranked.orderBy(*order).select("node_id").limit(limit + 1).count() > limit
    return Found(ranked.orderBy(*order).limit(limit), more)


def channels(nodes: DataFrame, hits: DataFrame | None, query: str) -> DataFrame:
    """Candidates: nodes of lexical hits (those that are still there), of names like the query, and of names like each of
    its tokens; each node once, with its lexical score as `fts`."""
    asked = [query, *(t for t in query.split() if len(t.encode()) >= NAME_BYTES)]
    like = F.lower("name") == query.lower()
    for t in asked:
        like = like | F.col("name").ilike(f"%{t}%")
    if hits is None:
        return nodes.where(like).withColumn("fts", F.lit(None).cast("double"))
    known = nodes.join(hits.select("node_id", F.col("score").alias("fts")), "node_id", "left")
    return known.where(like | F.col("fts").isNotNull())


def hybrid(nodes: DataFrame, in_degree: DataFrame, hits: DataFrame | None, query: str, boost: float = 0.15, vectors: DataFrame | None = None) -> DataFrame:
    """All candidates with score and reasons. `vectors`: (node_id, score) of a vector search; candidates get their share of
    the greatest score, nothing becomes a candidate by it."""
    found = channels(nodes, hits, query).join(in_degree, "node_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    ranked = search.fused(found, query, boost)
    return ranked if vectors is None else with_vectors(ranked, vectors)


def with_vectors(ranked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the vector bonus to ranked nodes."""
    top = vectors.agg(F.greatest(F.max("score"), F.lit(EPSILON)).alias("__top"))
    bonus = F.coalesce(F.col("__v") / F.col("__top") * VECTOR_BONUS, F.lit(0.0))
    with_scores = ranked.join(vectors.select("node_id", F.col("score").alias("__v")), "node_id", "left").join(F.broadcast(top), how="left")
    reason = F.when(F.col("__v").isNotNull(), F.array(F.struct(F.lit("vector_similarity").alias("signal"), bonus.alias("score")))).otherwise(F.array().cast("array<struct<signal:string,score:double>>"))
    return with_scores.withColumns({"score": F.col("score") + bonus, "reasons": F.concat("reasons", reason)}).drop("__v", "__top")


def _hits(view: View, query: str, limit: int) -> DataFrame | None:
    """Lexical hits; none where the index was never built."""
    posted = view.table("postings")
    return None if "postings" not in view._tables else lexical.hits(posted, view.table("lengths"), query, limit)


def search_graph(view: View, query: str, limit: int = 50) -> Found:
    """Nodes of lexical hits, ranked by names and degrees (not by the lexical score)."""
    hits = _hits(view, query, limit * GRAPH_FETCH)
    if hits is None or limit <= 0:
        return Found(search.fused(view.nodes().limit(0).withColumns({"in_degree": F.lit(0), "fts": F.lit(None).cast("double")}), query), False, ["the lexical index is not built"] if hits is None else [])
    found = view.nodes().join(hits.select("node_id"), "node_id", "left_semi").join(view.in_degree(), "node_id", "left")
    found = found.withColumns({"in_degree": F.coalesce("in_degree", F.lit(0)), "fts": F.lit(None).cast("double")})
    return _cut(search.fused(found, query), limit)


def search_hybrid(view: View, query: str, limit: int = 50, boost: float = 0.15, vectors: DataFrame | None = None) -> Found:
    """Lexical hits, names like the query and like its tokens, fused with degrees and the vector bonus."""
    hits = _hits(view, query, max(limit, 0) * HYBRID_FETCH)
    ranked = hybrid(view.nodes(), view.in_degree(), hits, query, boost, vectors)
    found = _cut(ranked, limit)
    if hits is None:
        found.warnings.append("the lexical index is not built")
    return found


def rank(query: str, nodes: DataFrame) -> DataFrame:
    """Names, paths and classes alone."""
    return search.fused(nodes.withColumns({"in_degree": F.lit(0), "fts": F.lit(None).cast("double")}), query)


def with_signals(ranked: DataFrame, query: str, kinds: tuple[str, ...] = (), classes: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), newest: int | None = None, hops: DataFrame | None = None, weight: float = 0.05) -> DataFrame:
    """Adds further signals of `weight` each at most to ranked nodes: a qualified name that ends in the query, preferred kinds
    and classes, preferred path prefixes, recency (revision by the newest one), nearness to an anchor, (node_id, depth) in
    `hops`, and how many channels found it (name, path, lexical)."""
    found = ranked if hops is None else ranked.join(hops.select("node_id", F.col("depth").alias("__hops")), "node_id", "left")
    told = F.transform("reasons", lambda r: F.substring_index(r["signal"], "_", 1))
    channels_ = F.size(F.array_intersect(F.array_distinct(told), F.array(*map(F.lit, ("exact", "name", "path", "fts")))))
    yes = lambda test: F.when(F.coalesce(test, F.lit(False)), weight).otherwise(0.0)
    signals = {"channel_agreement": F.lit(weight) * F.greatest(channels_ - 1, F.lit(0)) / 2}
    if "qualified_name" in ranked.columns:
        signals["qualified_suffix_match"] = yes(F.lower("qualified_name").endswith("::" + query.lower()))
    if kinds:
        signals["kind_preference"] = yes(F.col("kind").isin(*kinds))
    if classes:
        signals["artifact_class_preference"] = yes(F.col("artifact_class").isin(*classes))
    if prefixes:
        signals["source_priority"] = yes(F.array_contains(F.array(*(F.col("path").startswith(p) for p in prefixes)), True))
    if newest:
        signals["recency"] = F.lit(weight) * F.coalesce(F.col("provenance.revision") / newest, F.lit(0.0))
    if hops is not None:
        signals["graph_proximity"] = F.coalesce(F.lit(weight) / (1 + F.col("__hops")), F.lit(0.0))
    for k, v in signals.items():
        found = found.withColumn(f"__{k}", v.cast("double"))
    reasons = F.filter(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(f"__{k}").alias("score")) for k in signals)), lambda x: x["score"] > 0)
    total = sum((F.col(f"__{k}") for k in signals), F.col("score"))
    return found.withColumns({"score": total, "reasons": F.concat("reasons", reasons)}).drop("__hops", *(f"__{k}" for k in signals))


# ---- reranking


def parsed_indices(said: str) -> list[int]:
    """The list of whole numbers between the first [ and the last ] of a text."""
    start, end = said.find("["), said.rfind("]")
    if start < 0 or end <= start:
        raise ValueError(f"no list of indices in {said[:200]!r}")
    got = json.loads(said[start : end + 1])
    if not isinstance(got, list) or not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in got):
        raise ValueError("no list of indices")
    return got


def reordered(ranked: DataFrame, indices: DataFrame) -> DataFrame:
    """Ranked rows by indices (index, at) into their order: listed ones first, with a bonus, then the others as they were.
    Unknown indices are left out; of an index that comes twice the first counts."""
    from pyspark.sql import Window

    placed = ranked.withColumn("__i", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")) - 1)  # a result's rows: few
    first = indices.groupBy("index").agg(F.min("at").alias("__at"))
    both = placed.join(F.broadcast(first), F.col("__i") == F.col("index"), "left")
    listed = F.col("__at").isNotNull()
    reason = F.when(listed, F.array(F.struct(F.lit("agent_rerank").alias("signal"), F.lit(AGENT_BONUS).alias("score")))).otherwise(F.array().cast("array<struct<signal:string,score:double>>"))
    place = F.row_number().over(Window.orderBy(F.coalesce(F.col("__at").cast("long"), F.col("__i") + 1_000_000_000)))
    return both.withColumns({"score": F.col("score") + F.when(listed, AGENT_BONUS).otherwise(0.0), "reasons": F.concat("reasons", reason), "place": place}).drop("__i", "__at", "index")


def rerank(found: Found, query: str, ask: Callable[[str, list[dict]], str], most: int = 20) -> Found:
    """Lets a caller order the first rows: `ask` gets the query and up to `most` candidates and answers with a text that has
    a list of indices in it. A failure leaves the order as it was, with a warning."""
    spark = found.rows.sparkSession
    head = found.rows.orderBy(F.desc("score"), "node_id").limit(most)
    shown = [{"index": k, "name": r["name"], "kind": r["kind"], "path": r["path"], "summary": (r["attributes"] or {}).get("doc_summary") or (r["attributes"] or {}).get("docSummary")} for k, r in enumerate(head.collect())]
    try:
        got = parsed_indices(ask(query, shown))
    except Exception as e:  # noqa: BLE001  whatever a caller's function raises is a warning
        return Found(found.rows, found.truncated, [*found.warnings, f"reranking failed: {e}"])
    indices = spark.createDataFrame([(x, k) for k, x in enumerate(got)], "index int, at int")
    return Found(reordered(found.rows, indices), found.truncated, found.warnings)


def rerank_with_scores(found: Found, hits: DataFrame) -> Found:
    """Adds a model's scores, (shown, score) by the short form of ids, and orders anew."""
    from lodegraph.functions.ids import display

    both = found.rows.withColumn("__shown", display(F.col("node_id"))).join(hits.select(F.col("shown").alias("__shown"), F.col("score").alias("__s")), "__shown", "left")
    reason = F.when(F.col("__s").isNotNull(), F.array(F.struct(F.lit("model_rerank").alias("signal"), F.col("__s").cast("double").alias("score")))).otherwise(F.array().cast("array<struct<signal:string,score:double>>"))
    rows = both.withColumns({"score": F.col("score") + F.coalesce("__s", F.lit(0.0)), "reasons": F.concat("reasons", reason)}).drop("__s", "__shown")
    return Found(rows, found.truncated, found.warnings)


# ---- entities and traces


def entity(view: View, name_or_id: str) -> str | None:
    """The id of a node: that id if it is one, else the least id of names like it."""
    if re.fullmatch(r"[0-9a-f]{64}", name_or_id) and not view.node(name_or_id).isEmpty():
        return name_or_id
    return view.nodes_by_name(name_or_id).agg(F.min("node_id")).first()[0]


def neighbors(view: View, name_or_id: str, **filters) -> DataFrame | None:
    """One hop out and in, by edge id."""
    from lodegraph.operators.claims import filtered_edges

    at = entity(view, name_or_id)
    if at is None:
        return None
    nodes = view.nodes()
    of = view.spark.createDataFrame([(at,)], "node_id string")
    return graph.neighbors(nodes, filtered_edges(view.edges(), nodes, **filters), of).orderBy("edge_id")


def impact(view: View, roots: list[str], depth: int = 3, kinds: list[str] | None = None) -> DataFrame | None:
    """What reaches the roots (names or ids) against the edges."""
    at = [x for x in (entity(view, r) for r in roots) if x]
    if not at:
        return None
    return graph.impact(view.nodes(), view.edges(), view.spark.createDataFrame([(x,) for x in at], "node_id string"), depth, kinds)


def paths(view: View, source: str, target: str, depth: int = 5) -> DataFrame | None:
    a, b = entity(view, source), entity(view, target)
    return None if a is None or b is None else graph.paths(view.edges(), a, b, depth)


def trace(edges: DataFrame, source: str, target: str, nodes: int = 5) -> DataFrame:
    """(nodes) of simple paths of at most so many nodes, which is one edge less."""
    if nodes < 2:
        return graph.paths(edges, source, target, 1).limit(0).select("nodes")
    return graph.paths(edges, source, target, nodes - 1).select("nodes")


# ---- evaluation


def evaluated(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(p_at_1, p_at_5, mrr) of queries: ranked (query, name, score, node_id), expected (query, name). A query's rank is that
    of its expected name, whatever its case; a query that doesn't find it counts 0."""
    from pyspark.sql import Window

    placed = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node_id")))
    want = expected.select("query", F.lower("name").alias("__n"))
    hit = placed.join(want, "query").where(F.lower("name") == F.col("__n")).groupBy("query").agg(F.min("rank").alias("rank"))
    both = expected.select("query").distinct().join(hit, "query", "left")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return both.agg(share(F.col("rank") == 1).alias("p_at_1"), share(F.col("rank") <= 5).alias("p_at_5"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
