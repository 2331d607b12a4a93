"""The recursive merge query: no step orders its rows, and its tokens are the library's."""

import random

import public_tokenizers
import pyarrow as pa
import tiktoken

from lodegraph.llm import bpe


def test_merges_without_windows_are_the_librarys():
    coder = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coder.db.register("letters", pa.table({c: pa.array([0], pa.int32()) for c in ("w", "pos", "id", "next")}))
    assert "WINDOW" not in str(coder.db.sql("EXPLAIN " + bpe.MERGE_SHORT).fetchall()).upper()
    coder.db.unregister("letters")
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aabneé中st", k=rng.randrange(1, 60))) for _ in range(40)) for _ in range(20)] + ["a" * 199, "", "ab" * 100]
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_words_that_come_again_stay_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    coder = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coder.known = {}
    merged, merge = [], coder.merge
    monkeypatch.setattr(coder, "merge", lambda words: merged.extend(words) or merge(words))
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=12))
    often = [word() for _ in range(20)]
    texts = [" ".join([*often, *(word() for _ in range(15))]) for _ in range(30)]
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert [coder.encode([t])[0].tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert all(merged.count((" " * (k > 0) + w).encode()) == 1 for k, w in enumerate(often))
    assert len(coder.known) < 140
