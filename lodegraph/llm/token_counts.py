"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts of an Arrow batch are cut into pieces of about PIECE_BYTES, the pieces are dealt into encoder calls of about
CALL_BYTES, and only the lengths of the encodings leave the worker. Equal texts of a batch are encoded once. A text is cut
only for vocabularies whose own way to split texts is known to allow it: the pattern that `pieces` is for, without a
normalizer, and without added tokens that reach over white space. Others get whole texts.

Null and empty texts have no tokens; texts of any length are counted whole. Repeated rows are counted each, and null ids
pass. Other columns pass unchanged; columns that have the names of the new ones are replaced. An empty table gives none.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import bounded_arrow, text_or_empty

PIECE_BYTES = 64 << 10
CALL_BYTES = 1 << 20
_loaded: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """The encoder of a vocabulary file as a function from texts to lengths, and whether texts may be split."""
    if path not in _loaded:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            encoder.no_truncation()
            encoder.no_padding()
            _loaded[path] = (lambda texts: [len(x) for x in encoder.encode_batch_fast(texts, add_special_tokens=False)], may_split(encoder.to_str()))
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False)
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = (lambda texts: [len(ranked.encode_ordinary(x)) for x in texts], True)  # that pattern is the one of `pieces`
    return _loaded[path]


def may_split(tokenizer: str) -> bool:
    """Whether a tokenizer (as JSON) encodes the pieces of a text to what it encodes the text to."""
    held = json.loads(tokenizer)
    before = held.get("pre_tokenizer") or {}
    known = before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
    added = [x for x in held.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or any(c.isspace() for c in x["content"])]
    return known and not held.get("normalizer") and not added


def _prefix(text: str, start: int, limit: int) -> int:
    """Characters from `start` on that are no more than `limit` bytes."""
    return len(text[start : start + limit].encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore"))


def pieces(text: str, limit: int = PIECE_BYTES) -> list[str]:
    """Cuts a text of more than `limit` bytes where white space follows other characters.

    No match of the pattern of words, numbers, other characters (each after a blank, if any) and white space crosses such a
    place, and the look-ahead of its white-space branch sees the same on both sides, so the pieces' counts sum to the
    text's. A stretch without such a place stays whole.
    """
    if 3 * len(text) <= limit or _prefix(text, 0, limit) == len(text):
        return [text]
    out, start = [], 0
    while (fits := _prefix(text, start, limit)) < len(text) - start:
        at = start + max(1, fits)
        while at < len(text) and not (text[at] in " \n\t\r" and not text[at - 1].isspace() and text[at - 1] not in "\x1c\x1d\x1e\x1f\x85"):
            at += 1
        out.append(text[start:at])
        start = at
    if start < len(text):
        out.append(text[start:])
    return out


def lengths(texts: list[str], encode: Callable[[list[str]], list[int]], splits: bool) -> list[int]:
    distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    parts = [(k, p) for t, k in distinct.items() for p in (pieces(t) if splits else [t])]
    totals, call, size = [0] * len(distinct), [], 0

    def flush() -> None:
        for (k, _), n in zip(call, encode([p for _, p in call]), strict=True):
            totals[k] += n
        call.clear()

    for k, p in parts:
        call.append((k, p))
        size += len(p.encode("utf-8", "surrogatepass"))
        if size >= CALL_BYTES:
            flush()
            size = 0
    if call:
        flush()
    return [totals[distinct[t]] for t in texts]


def token_count(text: str | Column, path: str) -> Column:
    """Column of the number of tokens of each text under the vocabulary file at `path` (on every worker)."""

    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, splits = load(path)
        for column in columns:
            yield pa.array(lengths(column.to_pylist(), encode, splits), pa.int64())

    counted.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counted, "long")(text_or_empty(text))


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    bounded_arrow(df.sparkSession)
    counted = df.withColumn("n_bytes", F.octet_length(text_or_empty(text)).cast("long")).withColumn("n_tokens", token_count(text, path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
