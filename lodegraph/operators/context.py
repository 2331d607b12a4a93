"""Budgeted context: running sums decide where a sequence of snippets ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import numbered, redact_lines
from lodegraph.operators.graph import impact


#: Parts of a group whose own running totals cut it before it is brought together.
PARTS = 32


def packed(snippets: DataFrame, group: list[str], order: list[str], **budgets: int) -> DataFrame:
    """Of each group's snippets in order, those before any running total passes its budget: bytes=, lines=, units=.

    A key that comes again in a group is dropped before totals are taken. Totals only grow, so this is what stopping at
    the first overflow gives. A large group is cut first: where the running total of one of its parts is over, so is the
    whole's, and with that all that comes later in order; what one task sorts is PARTS budgets at most.
    """
    at = F.struct(*order)
    rest = [c for c in snippets.columns if c not in (*group, "key")]
    rows = snippets.groupBy(*group, "key").agg(F.min_by(F.struct(*rest), at).alias("__x")).select(*group, "key", "__x.*")

    def totals(df: DataFrame, keys: list[str]) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"total_{name}": F.sum(name).over(upto) for name in budgets})

    within = " and ".join(f"total_{n} <= {m}" for n, m in budgets.items())
    parted = totals(rows.withColumn("__part", F.pmod(F.xxhash64("key"), F.lit(PARTS))), [*group, "__part"])
    over = parted.groupBy(*group).agg(F.min(F.when(~F.expr(within), at)).alias("__over"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    over = over.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), "__over")
    left = parted.where(within).join(over, same).where(F.col("__over").isNull() | (at < F.col("__over")))
    return totals(left.select(*rows.columns), group).where(within)


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line, node_id): the smallest range around each point (path, line), the least id of equal ones.

    A range is cut into the few aligned stretches of 1, 4, 16, ... lines that tile it, a point is in one stretch of each
    length: an equality join, with some rows a range however long it is, and a dozen a point.
    """
    sizes = [4**k for k in range(16)]
    tiles = "flatten(array(" + ", ".join(_tiles(s) for s in sizes) + "))"
    cut = ranges.withColumn("__t", F.explode(F.expr(tiles))).select("path", "node_id", "start_line", "end_line", "__t.size", "__t.at")
    of = F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("size"), F.floor(F.col("line") / s).cast("long").alias("at")) for s in sizes)))
    met = points.withColumn("__t", of).select("path", "line", "__t.size", "__t.at").join(cut, ["path", "size", "at"])
    return met.groupBy("path", "line").agg(F.min_by("node_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("node_id"))).alias("node_id"))


def _tiles(size: int) -> str:
    """The stretches of a size that are in the range, but not in a longer one that is: before and after the longer ones."""
    low, high = f"((start_line + {size - 1}) div {size})", f"((end_line + 1) div {size})"  # whole stretches: low <= at < high
    wide = size * 4
    first, last = f"((start_line + {wide - 1}) div {wide} * 4)", f"((end_line + 1) div {wide} * 4)"  # covered by longer ones
    made = lambda a, b: f"if({a} < {b}, transform(sequence({a}, {b} - 1), x -> struct({size}L as size, cast(x as bigint) as at)), array())"
    split = f"({first} < {last})"
    return f"if({split}, concat({made(low, first)}, {made(last, high)}), {made(low, high)})"


def verbatim(files: DataFrame, ranges: DataFrame, padding: int = 0) -> DataFrame:
    """(root, path, start_line, end_line, text) of ranges of files (root, path, content): lines with their numbers, secrets
    hidden. Ranges beyond a file's end give what is there; those that begin beyond it, nothing."""
    lines = F.split(F.regexp_replace(F.col("content").cast("string"), "\\r?\\n$", ""), "\r?\n")
    cut = ranges.join(files.select("root", "path", lines.alias("__l")), ["root", "path"])
    first, upto = F.greatest(F.col("start_line") - padding, F.lit(1)), F.least(F.col("end_line") + padding, F.size("__l"))
    cut = cut.withColumns({"__a": first, "__z": upto}).where("__z >= __a")
    shown = F.transform(F.slice("__l", F.col("__a"), F.col("__z") - F.col("__a") + 1), lambda x, k: numbered(x, k + F.col("__a")))
    return cut.withColumn("text", redact_lines(F.array_join(shown, "\n"))).drop("__l", "__a", "__z")


#: The layout of a snippet.
RULE = "-" * 40
#: No snippet is shorter, so a budget of bytes holds no more than its share of them.
SHORTEST = 20


def snippets(sequence: DataFrame, files: DataFrame | None, padding: int = 2, blast_radius: bool = True, source: bool = True) -> DataFrame:
    """Adds text and its bytes and lines to nodes in sequence (with in_degree and out_degree): a head with symbol, file and
    range, then the lines themselves, or the attributes where there are none."""
    range_ = F.col("range")
    has = range_.isNotNull()
    radius = F.format_string("Blast Radius: %d incoming callers, %d outgoing relations\n", F.col("in_degree"), F.col("out_degree")) if blast_radius else F.lit("")
    symbol = F.concat(F.lit("Symbol: "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(")\nFile: "), F.col("path"))
    places = F.when(has, F.format_string("%d:%d..%d:%d", range_["start_line"], range_["start_column"], range_["end_line"], range_["end_column"])).otherwise(F.lit(""))
    attributes = F.to_json(F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    bare = redact_lines(F.concat(symbol, F.lit("\nLine Range: "), places, F.lit("\n"), radius, F.lit("Attributes: "), attributes))
    rows = sequence.withColumns({"start_line": F.coalesce(range_["start_line"], F.lit(1)), "end_line": F.coalesce(range_["end_line"], range_["start_line"], F.lit(1))})
    if files is None or not source:
        return _measured(rows.withColumn("text", bare))
    held = verbatim(files, rows.where(has).select("root", "path", "start_line", "end_line").distinct(), padding).select("root", "path", "start_line", "end_line", F.col("text").alias("__v"))
    head = F.concat(symbol, F.lit(" (L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit(")\n"), radius, F.lit(RULE + "\n"))
    joined = rows.join(held, ["root", "path", "start_line", "end_line"], "left")
    return _measured(joined.withColumn("text", F.when(has & F.col("__v").isNotNull(), F.concat(redact_lines(head), F.col("__v"))).otherwise(bare)).drop("__v"))


def _measured(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"bytes": F.octet_length("text").cast("long"), "lines": F.size(F.split("text", "\n")).cast("long")})


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes in sequence (seq): the seeds by id, each followed by what its edges lead to, by edge id. Nodes that come again
    are still there; packing drops them."""
    ids = seeds.select("node_id").distinct()
    own = ids.select("node_id", F.struct(F.col("node_id").alias("seed"), F.lit(0).alias("hop"), F.lit("").alias("edge")).alias("seq"))
    out = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id").select(F.col("to_id").alias("node_id"), F.struct(F.col("from_id").alias("seed"), F.lit(1).alias("hop"), F.col("edge_id").alias("edge")).alias("seq"))
    return own.unionByName(out).join(nodes, "node_id")


def assembled(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, files: DataFrame | None, padding: int = 2, estimate: Column | None = None, blast_radius: bool = True, source: bool = True, **budgets: int) -> DataFrame:
    """Snippets (seq, node_id, root, path, start_line, end_line, text, totals) of a neighbourhood, up to the first that passes
    a budget: bytes=, lines=, units=. A budget of units needs `estimate`, a column over text that gives them.

    Only as many nodes in sequence as the budget of bytes could hold are looked at, so a seed with many edges costs no more.
    """
    if "units" in budgets and estimate is None:
        raise ValueError("a budget of units needs an estimate of them")
    sequence = neighborhood(nodes, edges, seeds)
    first = sequence.groupBy("node_id").agg(F.min("seq").alias("seq"))
    if "bytes" in budgets:
        first = first.orderBy("seq").limit(budgets["bytes"] // SHORTEST + 1)
    degrees = edges.groupBy(F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    outward = edges.groupBy(F.col("from_id").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    rows = first.join(nodes, "node_id").join(degrees, "node_id", "left").join(outward, "node_id", "left").fillna(0, ["in_degree", "out_degree"])
    rows = snippets(rows, files, padding, blast_radius, source).withColumns({"key": F.col("node_id"), "request": F.lit(0)})
    rows = rows if estimate is None else rows.withColumn("units", estimate)
    got = packed(rows, ["request"], ["seq"], **budgets)
    return got.select("seq", "node_id", "root", "path", "start_line", "end_line", "text", *(f"total_{b}" for b in budgets))


def expanded(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, strategy: str, depth: int = 1) -> DataFrame:
    """Seeds (node_id) by a strategy: exact (themselves), dependency (what they lead to), dependents (what leads to them),
    call_chain (over calls, to a depth), file (what is in their files)."""
    ids = seeds.select("node_id").distinct()
    if strategy == "exact":
        return ids
    if strategy == "file":
        places = nodes.join(ids, "node_id", "left_semi").select("root", "path").distinct()
        return nodes.join(places, ["root", "path"], "left_semi").select("node_id")
    kinds = {"dependency": None, "dependents": None, "call_chain": ["calls"]}
    if strategy not in kinds:
        raise ValueError(f"{strategy} is no strategy")
    used = edges if kinds[strategy] is None else edges.where(F.col("kind").isin(*kinds[strategy]))
    used = used.select("edge_id", "kind", *(("from_id", "to_id") if strategy == "dependents" else (F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))))
    return ids.unionByName(impact(nodes, used, ids, depth).select("node_id")).distinct()


def review_seeds(nodes: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(node_id) of files (root, path) that changed; without any, of nodes whose name is like `main`."""
    if changed is None:
        return nodes.where(F.col("name").ilike("%main%")).select("node_id")
    return nodes.join(changed.select("root", "path").distinct(), ["root", "path"], "left_semi").where(~F.col("kind").isin("file", "document")).select("node_id")
