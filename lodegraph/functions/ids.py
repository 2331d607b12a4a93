"""Identities as Column functions: hex digests, so that string order is byte order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x1f"


def node_id(kind: Column, root: Column, path: Column, chain: Column, name: Column, ordinal: Column) -> Column:
    """Never depends on content or places in it. `ordinal` tells same-named siblings apart, in source order."""
    return F.sha2(F.concat_ws(MARK, F.lit("node:v1"), kind, root, path, chain, name, ordinal.cast("string")), 256)


def edge_id(source: Column, target: Column, kind: Column, extractor: Column) -> Column:
    return F.sha2(F.concat_ws(MARK, F.lit("edge:v1"), source, target, kind, extractor), 256)


def display(node: Column) -> Column:
    return F.concat(F.lit("node_"), F.substring(node, 1, 12))
