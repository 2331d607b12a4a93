"""Schemas of the claim tables, and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of nodes and edges, classes of files, derivations.
NODE_KINDS = (
    "repository", "root", "directory", "file", "package", "module", "namespace", "class", "struct", "interface", "trait", "enum", "type", "type_parameter",
    "function", "method", "constructor", "property", "accessor", "variable", "constant", "field", "parameter", "document", "section", "heading", "link_target",
    "schema", "schema_field", "table", "column", "migration", "endpoint", "route", "job", "service", "resource", "config_key", "external_symbol", "external_package",
    "concept", "topic", "responsibility",
)
EDGE_KINDS = (
    "contains", "declares", "defines", "references", "calls", "reads", "writes", "instantiates", "has_type", "returns", "accepts", "implements", "extends", "constrains",
    "imports", "exports", "depends_on", "resolves_to", "documents", "links_to", "mentions", "anchors", "queries", "migrates", "validates_with", "handles", "configures",
    "tested_by", "deploys", "relates_to", "summarizes",
)
TRANSITIVE_KINDS = ("contains", "calls", "extends", "implements", "depends_on", "resolves_to")
ARTIFACT_CLASSES = ("code", "tests", "docs", "config", "schema", "data", "build", "ci", "infra", "all")
DERIVATIONS = ("extracted", "resolved", "heuristic", "generated")

OWNER = "struct<root:string,path:string,producer:string,producer_version:string>"
RANGE = "struct<start:bigint,`end`:bigint,start_line:int,start_column:int,end_line:int,end_column:int>"
PROVENANCE = f"struct<root:string,path:string,range:{RANGE},extractor:string,extractor_version:string,derivation:string,confidence:float,revision:bigint>"
#: Tables of a graph: each fact once for each owner that claims it.
TABLES = {
    "nodes": f"node_id string, kind string, name string, qualified_name string, root string, path string, range {RANGE}, language string, artifact_class string, provenance {PROVENANCE}, attributes map<string,string>, owner {OWNER}",
    "edges": f"edge_id string, from_id string, to_id string, kind string, provenance {PROVENANCE}, attributes map<string,string>, owner {OWNER}",
    "unresolved": f"from_id string, seeking string, scope_hint string, edge_kind string, provenance {PROVENANCE}, owner {OWNER}",
    "skips": f"owner {OWNER}, reason string",
    "diagnostics": f"owner {OWNER}, message string, span {RANGE}",
    "history": "revision bigint, files bigint, nodes_added bigint, edges_added bigint, unresolved_added bigint, promoted bigint, resolved bigint, demoted bigint, nodes_removed bigint, edges_removed bigint, created_at bigint",
    "index_state": "kind string, acknowledged_revision bigint, is_current boolean",
    "postings": "token string, node_id string, field int, places array<int>",
    "lengths": "node_id string, n int",
}
KEYS = {"nodes": ("node_id", "owner"), "edges": ("edge_id", "owner"), "unresolved": ("from_id", "seeking", "edge_kind"), "skips": ("owner",), "index_state": ("kind",)}


def owner(root: Column, path: Column, producer: Column, version: Column) -> Column:
    return F.struct(root.alias("root"), path.alias("path"), producer.alias("producer"), version.alias("producer_version"))


def provenance(root: Column, path: Column, extractor: Column, version: Column, derivation: str, revision: Column | None = None, at: Column | None = None) -> Column:
    """With confidence 1 and revision 0 where not said otherwise."""
    return F.struct(root.alias("root"), path.alias("path"), (F.lit(None) if at is None else at).cast(RANGE).alias("range"), extractor.alias("extractor"), version.alias("extractor_version"), F.lit(derivation).alias("derivation"), F.lit(1.0).cast("float").alias("confidence"), (F.lit(0) if revision is None else revision).cast("bigint").alias("revision"))


def shaped(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, in its types; missing ones are null."""
    fields = df.sparkSession.createDataFrame([], TABLES[table]).schema.fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def known_kinds(df: DataFrame, table: str) -> DataFrame:
    """Kinds outside the vocabulary are read as file (nodes), contains (edges), references (pending); a missing provenance
    as that of an extraction by the owner."""
    column, kinds, other = {"nodes": ("kind", NODE_KINDS, "file"), "edges": ("kind", EDGE_KINDS, "contains"), "unresolved": ("edge_kind", EDGE_KINDS, "references")}[table]
    told = provenance(F.col("owner.root"), F.col("owner.path"), F.col("owner.producer"), F.col("owner.producer_version"), "extracted")
    return df.withColumns({column: F.when(F.col(column).isin(*kinds), F.col(column)).otherwise(F.lit(other)), "provenance": F.coalesce("provenance", told)})
