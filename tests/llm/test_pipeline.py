"""Each stage of the pipeline against brute force, on tables with nulls, repeats, ties and further columns, and the whole of it."""

import hashlib

import corpus_pipeline as cp
import public_tokenizers as P
import pytest
from brute_lines import removed
from brute_sets import components
from pyspark.sql import functions as F

from lodegraph.llm import bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(n, seed=0):
    return " ".join(f"w{(seed * 7919 + k * k) % 997}" for k in range(n))


def rows():
    base, far = words(120), words(200, 3)
    near = base.replace("w0", "zz", 1)
    long = "\n".join(words(60, 20 + k) for k in range(3))
    texts = [(1, base), (2, near), (2, far), (3, base), (3, base), (None, near), (None, far + " end"), (4, None), (5, ""), (5, ""), (6, " \n "), (7, long), (8, "head line\n" + long + "\ntail line"), (9, "x" * 50_000), (10, "a b"), (11, "a b")]
    return [(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), "other") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def key(r):
    return repr((r["doc_id"], r["text"], r["lang"], r["source"]))


def test_stages_keep_the_columns_and_take_empty_tables(spark, docs):
    for name, stage in cp.STAGES:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, SF)
            assert name == cp.STAGES[-1][0] or got.columns == list(cp.COLUMNS), name
            assert given is docs or got.count() == 0, name


def test_classifier_keeps_all_without_labels(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(key, cp.quality_classifier(spark, docs, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))


def test_line_dedup(spark, docs):
    order = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    gone = removed([(r[0], r[1]) for r in rows()], 50, order.get)
    want = []
    for i, t, lang, source, _, _ in rows():
        lost = gone.get((i, t), set())
        kept = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
        if not (lost and not kept.split()):
            want.append(repr((i, kept, lang, source, None if kept is None else len(kept))))
    got = cp.line_deduplication(spark, docs, SF).collect()
    assert sorted(repr((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])) for r in got) == sorted(want)


def test_near_duplicates(spark, docs):
    given = rows()
    marks = [r["m"] for r in docs.select(F.xxhash64(*cp.COLUMNS).alias("m"), "doc_id", "text", "lang", "source").collect()]
    of = components([t for _, t, *_ in given], 5, 80, 100)
    best = {}
    for k, c in enumerate(of):
        if c is not None:
            best[c] = min(best.get(c, (True, 1 << 62, 0, 0)), (given[k][0] is None, given[k][0] or 0, marks[k], k))
    want = [given[k] for k, c in enumerate(of) if c is None or best[c][3] == k]
    got = cp.near_duplicates(spark, docs, SF).collect()
    assert sorted(map(key, got)) == sorted(key(dict(zip(("doc_id", "text", "lang", "source"), r[:4], strict=True))) for r in want)


def test_mixing(spark, docs):
    got = [r for r in cp.source_mixing(spark, docs, SF).collect()]
    size = lambda t: len((t or "").split())
    total = sum(size(r[1]) for r in rows())
    assert abs(sum(size(r["text"]) for r in got) - 1.5 * total) <= 3 * max(size(r[1]) for r in rows())
    copies = {}
    for r in got:
        copies[key(r)] = copies.get(key(r), 0) + 1
    have = {}
    for r in docs.collect():
        have[key(r)] = have.get(key(r), 0) + 1
    assert all(n <= 2 * have[k] for k, n in copies.items())


def test_encoding(spark, docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted(repr((i, own.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest())) for i, t, *_ in rows())
    assert sorted(repr((r["doc_id"], r["ids"], r["decoded_sha256"])) for r in cp.encoding(spark, docs, SF).collect()) == want


def test_run(spark):
    got = cp.run(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < len(got) <= 2 * n and all(len(r["ids"]) == r["n_tokens"] for r in got)
