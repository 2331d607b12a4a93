r"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one connection a Python worker.

Encoding: a pattern cuts each text into words. A word that is a token is that token. The other distinct words of a
batch, where of up to SHORT bytes, become token-position rows; a recursive query joins neighbours with the merge table
and contracts each word's leftmost pair of least rank until no word has a pair. Longer words, whose states of all steps
would grow with the square of their length, are contracted in the same order by a heap of (rank, place), in n log n steps.
Words once merged are remembered, up to REMEMBERED a worker, the older ones going. Decoding: ids join the vocabulary, and an ordered aggregation
concatenates the tokens' bytes.

Null text counts as empty: no ids, and an empty decoding. Texts of any length are taken whole; one batch holds about
BATCH_BYTES of text and one text at least. Repeated rows are encoded each, alike; null ids pass; an empty table gives none.
Of the input only the id and the text are read, so other columns' names don't matter. Nothing is written to a disk.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import by_bytes, map_batches

BATCH_BYTES = 1 << 19
REMEMBERED, SHORT = 400_000, 200
#: Rows of token positions that one recursive query starts with.
QUERY_ROWS = 100_000
_coders: dict[tuple[str, str], Coder] = {}
#: What words encode to, as decimal text: kept between a worker's tasks, at some 70 bytes a word.
_known: dict[tuple[str, str], dict[str, str]] = {}

#: One contraction a step. A row knows the id after its own (-1: none): the pair's right row takes its place, the row before learns the
#: new id, so that no step orders the rows.
MERGE_SHORT = """
WITH RECURSIVE state(w, k, id, next, step) AS (
    SELECT w, pos, id, next, 0 FROM letters
  UNION ALL
    SELECT s.w, CASE WHEN s.k > b.k THEN s.k - 1 ELSE s.k END, CASE WHEN s.k = b.k + 1 THEN b.merged ELSE s.id END,
      CASE WHEN s.k = b.k - 1 THEN b.merged ELSE s.next END, s.step + 1
    FROM state s JOIN (
      SELECT w, best & 255 AS k, best >> 8 AS merged FROM (
        SELECT p.w, min((m.merged::BIGINT << 8) | p.k) AS best
        FROM state p JOIN merges m ON m.l = p.id AND m.r = p.next GROUP BY p.w)) b ON b.w = s.w
    WHERE s.k <> b.k
)
SELECT w, string_agg(id::VARCHAR, ' ' ORDER BY k) AS ids
FROM (SELECT s.* FROM state s JOIN (SELECT w, max(step) AS last FROM state GROUP BY w) l ON l.w = s.w AND l.last = s.step) GROUP BY w
"""
DECODE = "SELECT doc, array_to_string(list(hex ORDER BY pos), '') AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def numbers(shown: str) -> np.ndarray:
    return np.fromstring(shown, np.int32, sep=" ") if shown else np.empty(0, np.int32)


class Coder:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = load_ranks(path), regex.compile(pattern)
        #: Words' ids as decimal text, separated by blanks.
        self.known = _known.setdefault((path, pattern), {})
        # Every way to cut a token into two tokens is a merge that yields it; its rank is its id.
        cuts = [(self.ranks[t[:k]], self.ranks[t[k:]], n) for t, n in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.merges = {(a, b): n for a, b, n in cuts}
        left, right, made = (pa.array(c, pa.int32()) for c in zip(*cuts, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": "false", "temp_directory": ""})
        given = pa.table({"l": left, "r": right, "merged": made})
        words = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.register("words", words)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.db.unregister("words")
        self.letter = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def merge(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """Places in `words` and ids as text; each word is of two bytes at least, of SHORT at most, and no token itself."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.letter[raw]
        after = np.concatenate([ids[1:], np.full(1, -1, np.int32)])
        after[np.cumsum(sizes) - 1] = -1
        letters = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": (np.arange(len(raw)) - starts).astype(np.int32), "id": ids, "next": after})
        self.db.register("letters", letters)
        got = self.db.sql(MERGE_SHORT).to_arrow_table()
        self.db.unregister("letters")
        return got.column("w").to_pylist(), got.column("ids").to_pylist()

    def merge_long(self, word: bytes) -> str:
        """Ids as text of a word of any length: neighbours in linked lists, their pairs in a heap of (rank, place)."""
        merges, n = self.merges, len(word)
        ids = self.letter[np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, k) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1]))) is not None]
        heapify(heap)
        while heap:
            made, k = heappop(heap)
            if ids[k] < 0 or after[k] >= n or merges.get((ids[k], ids[after[k]])) != made:  # eaten, or no longer this pair
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = made, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (m := merges.get((made, ids[after[k]]))) is not None:
                    heappush(heap, (m, k))
            if before[k] >= 0 and (m := merges.get((ids[before[k]], made))) is not None:
                heappush(heap, (m, before[k]))
        return " ".join(str(x) for x in ids if x >= 0)

    def learn(self, texts: list[list[str]]) -> dict[str, str]:
        """What each distinct word of the texts encodes to."""
        known, ranks, distinct = self.known, self.ranks, set(chain.from_iterable(texts))
        if len(known) > REMEMBERED:
            for word in distinct & known.keys():  # to the end: what comes often is met in most batches
                known[word] = known.pop(word)
            for word in list(islice(known, len(known) - REMEMBERED + REMEMBERED // 8)):
                del known[word]
        words: list[str] = []
        raws: list[bytes] = []
        size = 0

        def query() -> None:
            places, ids = self.merge(raws)
            known.update(zip(map(words.__getitem__, places), ids, strict=True))
            words.clear(), raws.clear()

        for word in distinct.difference(known):
            raw = word.encode("utf-8", "surrogatepass")
            if raw in ranks:
                known[word] = str(ranks[raw])
                continue
            if len(raw) > SHORT:
                known[word] = self.merge_long(raw)
                continue
            if size + len(raw) > QUERY_ROWS and raws:
                query()
                size = 0
            words.append(word)
            raws.append(raw)
            size += len(raw)
        if raws:
            query()
        return known

    def shown(self, texts: list[str]) -> list[str]:
        """Each text's ids as decimal text."""
        cut = [self.pattern.findall(t) for t in texts]
        known = self.learn(cut)
        return [" ".join(map(known.__getitem__, w)) for w in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [numbers(x) for x in self.shown(texts)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        tokens = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(int(sizes.sum()), dtype=np.int64), "id": np.concatenate([*ids, np.empty(0, np.int32)])})
        self.db.register("tokens", tokens)
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(ids)
        for doc, text in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist(), strict=True):
            out[doc] = bytes.fromhex(text)
        return out


@contextmanager
def coder(path: str, pattern: str) -> Iterator[Coder]:
    """A worker's coder, for one task: it is made in a third of a second, and between tasks other work has its memory; only the
    words that it has learned stay."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    try:
        yield _coders[path, pattern]
    finally:
        if held := _coders.pop((path, pattern), None):
            held.db.close()


def encoded(df: DataFrame, path: str, pattern: str, row: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, ids): the ids of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path, pattern) as own:
            for batch in by_bytes(batches, text, BATCH_BYTES):
                ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return map_batches(df.select(row, text), work, f"id {df.schema[row].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", row)


def decoded(df: DataFrame, path: str, pattern: str, row: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(row, bytes): the bytes of every list of ids; null for null, ids outside the vocabulary add nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path, pattern) as own:
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    part = batch.slice(k, 64)
                    lists = part.column(1).to_pylist()
                    got = own.decode([np.array(x or [], np.int32) for x in lists])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else b for x, b in zip(lists, got, strict=True)], pa.binary())], ["id", "bytes"])

    return map_batches(df.select(row, ids), work, f"id {df.schema[row].dataType.simpleString()}, bytes binary").withColumnRenamed("id", row)


def round_trip(df: DataFrame, path: str, pattern: str, row: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for): encodes and decodes in one pass."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path, pattern) as own:
            for batch in by_bytes(batches, text, BATCH_BYTES):
                texts = own.shown([t or "" for t in batch.column(1).to_pylist()])
                ids = [numbers(x) for x in texts]
                shown = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
                back = [hashlib.sha256(b).hexdigest() for b in own.decode(ids)]
                columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {df.schema[row].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(df.select(row, text), work, schema).withColumnRenamed("id", row)
