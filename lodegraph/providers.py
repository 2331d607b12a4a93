"""Extension points of models: what embeds, reranks or writes text, registered by name. Nothing here opens a connection;
the offline provider is deterministic, others are what a caller registers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import search


class EmbeddingModel(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, candidates: Sequence[tuple[str, str]]) -> list[tuple[str, float]]:
        """(id, score) of candidates (id, content)."""
        ...


class TextModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class LexicalSource(Protocol):
    def search(self, query: str, limit: int) -> DataFrame:
        """(node_id, score), greater being better."""
        ...


Estimator = Callable[[Column], Column]
Classifier = Callable[[Column], Column]


@dataclass(frozen=True)
class Provider:
    """What a name stands for; parts that it lacks are None."""

    embed: Callable[[int], EmbeddingModel] | None = None
    rerank: Callable[[], Reranker] | None = None
    generate: Callable[[], TextModel] | None = None


class Unavailable(RuntimeError):
    """No provider of that name, or none that does this."""


_registered: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    _registered[name] = provider


def provider(name: str) -> Provider:
    if name in ("", "none") or name not in _registered:
        raise Unavailable(f"no provider {name or 'none'} is registered")
    return _registered[name]


def embedded(df: DataFrame, text: str, name: str, dimension: int, column: str = "embedding") -> DataFrame:
    """Adds vectors: the offline provider's as a Column, another one's by batches of an Arrow function."""
    if name == "embedded":
        return df.withColumn(column, search.pseudo_embedding(F.col(text), dimension))
    make = provider(name).embed
    if make is None:
        raise Unavailable(f"{name} doesn't embed")

    def embed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make(dimension)
        for texts in columns:
            yield pa.array(model.embed([t or "" for t in texts.to_pylist()]), pa.list_(pa.float64()))

    embed.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(column, F.arrow_udf(embed, "array<double>")(F.col(text)))


def reranked(candidates: DataFrame, query: str, name: str, key: str = "node_id", content: str = "content", most: int = 50) -> DataFrame:
    """(key, score, rank) of candidates: the offline provider counts the query's words, another one gets up to `most` rows."""
    if name == "embedded":
        scored = candidates.select(key, search.overlap_score(query, F.col(content)).alias("score"))
        return ranked(scored, key)
    make = provider(name).rerank
    if make is None:
        raise Unavailable(f"{name} doesn't rerank")
    rows = candidates.select(key, content).limit(most).collect()
    got = make().rerank(query, [(r[0], r[1]) for r in rows])
    return ranked(candidates.sparkSession.createDataFrame(got or [], f"{key} string, score double"), key)


def ranked(scored: DataFrame, key: str) -> DataFrame:
    from pyspark.sql import Window

    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def rank_score(rank: Column) -> Column:
    """1 for the first, 0.05 less for each after, 0.1 at least."""
    return 1 - F.least(0.05 * rank, F.lit(0.9))


def replies(said: DataFrame, shape: str, column: str = "reply") -> DataFrame:
    """Replies of providers, as JSON texts, in a common shape. shape: `list` ({"data": [{"index", "embedding"}]}), `single`
    ({"embedding"}), `values` ({"embeddings": [{"values"}]}), `scores` ({"results": [{"index", "relevance_score"}]}).
    What isn't of that shape gives no rows. (row columns, index, vector or score.)"""
    shapes = {
        "list": ("data array<struct<index:int,embedding:array<double>>>", "inline(transform(r.data, (x, i) -> struct(coalesce(x.index, i) as index, x.embedding as vector)))"),
        "single": ("embedding array<double>", "inline(if(r.embedding is null, array(), array(struct(0 as index, r.embedding as vector))))"),
        "values": ("embeddings array<struct<values:array<double>>>", "inline(transform(r.embeddings, (x, i) -> struct(i as index, x.values as vector)))"),
        "scores": ("results array<struct<index:int,relevance_score:double>>", "inline(transform(r.results, (x, i) -> struct(coalesce(x.index, i) as index, x.relevance_score as score)))"),
    }
    schema, unpack = shapes[shape]
    rest = [c for c in said.columns if c != column]
    return said.select(*rest, F.from_json(column, schema).alias("r")).where("r is not null").selectExpr(*(f"`{c}`" for c in rest), unpack)
