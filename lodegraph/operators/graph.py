"""Graph operators over nodes(node_id, kind, name, path) and edges(edge_id, from_id, to_id, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.scratch import Scratch


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree): claims, not distinct edges. One shuffle, combined before it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("to_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """(node_id, in_degree) of nodes that an edge leads to."""
    return edges.groupBy(F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def reached(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """Edges within so many steps from the seeds (node_id), each once: those that paths from there can have."""
    scratch = Scratch(edges.sparkSession)
    level = scratch.save(seeds.select("node_id").distinct(), "reached0")
    seen = level
    for k in range(1, steps):
        new = edges.join(level, F.col("from_id") == F.col("node_id"), "left_semi").select(F.col("to_id").alias("node_id")).distinct()
        level = scratch.save(new.join(seen, "node_id", "left_anti"), f"reached{k}")
        seen = seen.unionByName(level)
    return edges.join(seen, F.col("from_id") == F.col("node_id"), "left_semi")


def neighbors(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """One hop out and in of the ids in `of` (node_id); a missing neighbour keeps its row with null name."""
    out = edges.join(of.select(F.col("node_id").alias("from_id")), "from_id").select("edge_id", "kind", F.lit("out").alias("direction"), F.col("to_id").alias("node_id"))
    into = edges.join(of.select(F.col("node_id").alias("to_id")), "to_id").select("edge_id", "kind", F.lit("in").alias("direction"), F.col("from_id").alias("node_id"))
    return out.unionByName(into).join(nodes.select("node_id", "name"), "node_id", "left")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """Everything that reaches the seeds against the edges: (node_id, depth, via).

    Level by level; a node belongs to its least depth, `via` is the kind of the edge of least (parent order, edge id).
    Missing nodes pass the search on and are not given. Each level is written, so lineage stays short.
    """
    scratch = Scratch(nodes.sparkSession)
    used = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    level = scratch.save(seeds.select("node_id").distinct().select("node_id", F.col("node_id").alias("ord")), "level0")
    seen, found = level.select("node_id"), None
    for depth in range(1, max_depth + 1):
        met = used.join(level, F.col("to_id") == F.col("node_id")).select(F.col("from_id").alias("next"), F.struct("ord", "edge_id").alias("by"), "kind")
        new = met.join(seen, F.col("next") == F.col("node_id"), "left_anti").groupBy("next").agg(F.min("by").alias("by"), F.min_by("kind", "by").alias("via"))
        # The next level's order is its nodes' discovery order: the path of (parent order, edge id).
        level = scratch.save(new.select(F.col("next").alias("node_id"), F.concat_ws("/", "by.ord", "by.edge_id").alias("ord"), F.lit(depth).alias("depth"), "via"), f"level{depth}")
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(level.select("node_id"))
        level = level.select("node_id", "ord")
    return found.join(nodes.select("node_id", "name"), "node_id").select("node_id", "name", F.col("depth").cast("long").alias("depth"), "via")


def paths(edges: DataFrame, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """All simple paths of at most max_depth edges: (depth, nodes, edges). Parallel edges give paths of their own.

    Before extending, edges are cut to those whose head still reaches the target in the steps left.
    """
    scratch = Scratch(edges.sparkSession)
    near = edges.sparkSession.createDataFrame([(target, 0)], "node_id string, away int")
    for k in range(1, max_depth):
        grown = edges.join(near.where(F.col("away") == k - 1), F.col("to_id") == F.col("node_id")).select(F.col("from_id").alias("node_id"), F.lit(k).alias("away"))
        near = scratch.save(near.unionByName(grown.distinct()).groupBy("node_id").agg(F.min("away").alias("away")), f"near{k}")
    open_ = edges.sparkSession.createDataFrame([(source, [source], [])], "tail string, nodes array<string>, edges array<string>")
    done = None
    for k in range(1, max_depth + 1):
        step = open_.join(edges, F.col("tail") == F.col("from_id")).where(~F.array_contains("nodes", F.col("to_id")))
        step = step.join(near.where(F.col("away") <= max_depth - k), F.col("to_id") == F.col("node_id"))
        step = scratch.save(step.select(F.col("to_id").alias("tail"), F.concat("nodes", F.array("to_id")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges")), f"step{k}")
        hit = step.where(F.col("tail") == target).select(F.lit(k).cast("long").alias("depth"), "nodes", "edges")
        done = hit if done is None else done.unionByName(hit)
        open_ = step.where(F.col("tail") != target)
    return done


def astray(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that come from no node, and those that lead to none. The ids that are missing are found first and written, so that
    where they are few they go to the edges, which then aren't shuffled."""
    scratch, out = Scratch(edges.sparkSession), []
    for end in ("from_id", "to_id"):
        lost = scratch.save(edges.select(end).distinct().join(nodes.select("node_id"), F.col(end) == F.col("node_id"), "left_anti"), end)
        out.append(edges.join(lost, end, "left_semi").select(*edges.columns).unionByName(edges.where(F.col(end).isNull())))
    return out[0], out[1]


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end isn't a node."""
    one, other = astray(nodes, edges)
    return one.select("edge_id").unionByName(other.select("edge_id")).distinct()


def many_parents(edges: DataFrame) -> DataFrame:
    """Nodes that more than one node contains: where containment is no forest."""
    return edges.where("kind = 'contains'").groupBy("to_id").agg(F.count(F.lit(1)).alias("parents")).where("parents > 1")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that aren't in the other, both ways: empty where the graphs are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
