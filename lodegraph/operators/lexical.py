"""Lexical search over an inverted index: tokens with their places, prefix and phrase queries, BM25.

The index is two tables: postings (token, node_id, field, places), kept in token order so that a query's prefixes prune what
is read, and lengths (node_id, n).
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "qualified_name", "path", "attributes")
#: Latin letters with accents and the plain ones, by decomposition; lower case.
FOLDED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if chr(c).islower() and len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
ACCENTED, PLAIN = ("".join(x) for x in zip(*FOLDED, strict=True))
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Longest runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def asked(query: str) -> list[str]:
    """A query's tokens, as the index has them; quotes and stars are no part."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def _texts(nodes: DataFrame) -> DataFrame:
    held = F.col("attributes")
    values = F.array_join(F.transform(F.map_entries(held), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), " ") if dict(nodes.dtypes)["attributes"].startswith("map") else held
    return nodes.select("node_id", *(F.col(f) for f in FIELDS[:-1]), values.alias("attributes"))


def postings(nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(token, node_id, field, places): a row for each token of a field of a node, in the order of tokens. One shuffle: tokens
    are dealt by range over the session's partitions or `tasks`, a token that most nodes have over many of them, and gathered
    where they are."""
    of = F.array(*(F.struct(F.lit(k).alias("field"), tokens(F.col(f)).alias("ts")) for k, f in enumerate(FIELDS)))
    flat = _texts(nodes).select("node_id", F.explode(of).alias("x")).select("node_id", "x.field", F.posexplode("x.ts").alias("at", "token"))
    dealt = flat.repartitionByRange(*(() if tasks is None else (tasks,)), "token", "node_id", "field")
    return dealt.groupBy("token", "node_id", "field").agg(F.sort_array(F.collect_list("at")).alias("places")).sortWithinPartitions("token", "node_id", "field")


def lengths(nodes: DataFrame) -> DataFrame:
    return _texts(nodes).select("node_id", sum((F.size(tokens(F.col(f))) for f in FIELDS[1:]), F.size(tokens(F.col(FIELDS[0])))).alias("n"))


def hits(posted: DataFrame, lengths_: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(node_id, score): one token asks for its prefix and itself, several for the phrase and each one's prefix; every such
    branch counts by its own frequency. Only the postings of these tokens are read, the corpus' size is one row."""
    wanted = asked(query)
    if not wanted:
        return posted.select("node_id", F.lit(0.0).alias("score")).limit(0)
    starts = F.lit(False)
    for t in set(wanted):
        starts = starts | F.col("token").startswith(t)
    near = posted.where(starts)
    tf = lambda test: F.sum(F.when(test, F.size("places")).otherwise(0)).cast("double")
    branches = [tf(F.col("token").startswith(t)).alias(f"tf{k}") for k, t in enumerate(wanted)]
    if len(wanted) == 1:
        counted = near.groupBy("node_id").agg(*branches, tf(F.col("token") == wanted[0]).alias("tf1"))
        n = 2
    else:
        # A phrase: the places of its tokens, each moved back by its number, have one in common.
        moved = lambda k: lambda p: p - k  # noqa: E731  a default argument would be taken for the place
        places = [F.flatten(F.collect_list(F.when(F.col("token") == t, F.transform("places", moved(k))))).alias(f"p{k}") for k, t in enumerate(wanted)]
        inner = near.groupBy("node_id", "field").agg(*branches, *places)
        met = F.col("p0")
        for k in range(1, len(wanted)):
            met = F.array_intersect(met, F.col(f"p{k}"))
        inner = inner.withColumn("phrase", F.size(met).cast("double"))
        n = len(wanted) + 1
        counted = inner.groupBy("node_id").agg(*(F.sum(f"tf{k}").alias(f"tf{k}") for k in range(len(wanted))), F.sum("phrase").alias(f"tf{n - 1}"))
    stats = lengths_.agg(F.count(F.lit(1)).cast("double").alias("all"), F.avg("n").alias("mean"))
    found = counted.agg(*(F.sum((F.col(f"tf{k}") > 0).cast("int")).cast("double").alias(f"df{k}") for k in range(n)))
    scored = counted.join(lengths_, "node_id").join(F.broadcast(stats)).join(F.broadcast(found))
    total = F.lit(0.0)
    for k in range(n):
        idf = F.log((F.col("all") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        weight = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        total = total + weight * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    out = scored.select("node_id", total.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "node_id").limit(limit)
