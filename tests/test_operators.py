"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import context, graph, search, store
from lodegraph.sources import files
from lodegraph.streaming import watch


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_redaction(spark):
    assert value(spark, text.redact_lines(F.lit("port = 80\ndb_password: hunter2 = x\nplain: y"))) == "port = 80\ndb_password: [REDACTED]\nplain: y"
    assert value(spark, text.redact_lines(F.lit("the secret\n= 4"))) == "the secret\n= 4"
    assert value(spark, text.redact_preview(F.lit("refresh_TOKEN => z : q"))) == "refresh_TOKEN = [REDACTED]"
    assert value(spark, text.redact_preview(F.lit("my auth: abc"))) == "my auth: [REDACTED]" and value(spark, text.redact_preview(F.lit("size = 3"))) == "size = 3"
    assert value(spark, text.numbered(F.lit("x"), F.lit(7))) == "   7: x" and value(spark, text.numbered(F.lit("x"), F.lit(12345))) == "12345: x"
    assert value(spark, text.links(F.lit("see [a](b.md) and [c](d)"))) == ["b.md", "d"] and value(spark, text.identifier_words(F.lit("readHTTPFile2_now"))) == ["read", "httpfile", "2", "now"]


def test_paths(spark):
    rows = {"a/.git/HEAD": True, "web/.env.local": True, "ssh/id_ed25519": True, "certs/site.pem": True, "x/node_modules/y.js": True, "lib/core.py": False, "pem": False, "gen/out/x.o": True, "app.map.js": True, "old/deep/z.py": True}
    df = spark.createDataFrame([(p,) for p in rows], "path string")
    assert {r.path: r.e for r in df.select("path", files.excluded(F.col("path"), ("map.js",), ("**/out/**", "old/**")).alias("e")).collect()} == rows
    kinds = {"lib/core.py": "code", "test/a.sh": "tests", "ui/view.spec.ts": "tests", "README.MD": "docs", "book/x": "docs", "api/schema/v1.json": "schema", "app.yaml": "config", "x/.github/run": "ci", "ops/k8s/y": "infra", "db/migrations/1": "data", "Makefile": "build"}
    df = spark.createDataFrame([(p,) for p in kinds], "path string")
    assert {r.path: r.e for r in df.select("path", files.artifact_class(F.col("path")).alias("e")).collect()} == kinds
    df = spark.createDataFrame([("x/y.z",), ("x/../y",), ("/etc",), ("",), ("D:/x",), ("x\\..\\y",)], "path string")
    assert [r[0] for r in df.select(files.contained(F.col("path"))).collect()] == [True, False, False, False, False, False]


def test_line_index(spark):
    df = spark.createDataFrame([("m", "a", "one\r\ntwo é\nthree"), ("m", "b", "\n\nx\n"), ("m", "c", ""), ("m", "d", "y\n" * 1000)], "root string, path string, content string")
    got = [(r.path, r.line, r.start, r.text) for r in search.lines(df.where("path <> 'd'")).orderBy("path", "line").collect()]
    assert got == [("a", 1, 0, "one"), ("a", 2, 5, "two é"), ("a", 3, 12, "three"), ("b", 1, 0, ""), ("b", 2, 1, ""), ("b", 3, 2, "x"), ("c", 1, 0, "")]
    assert [r.start for r in search.lines(df.where("path = 'd'")).orderBy("line").collect()] == list(range(0, 2000, 2))


def test_impact_and_paths(spark):
    nodes = spark.createDataFrame([(x, x) for x in "abcd"], "node_id string, name string")
    edges = spark.createDataFrame([("e1", "b", "a", "calls"), ("e2", "c", "b", "calls"), ("e3", "c", "a", "imports"), ("e4", "x", "c", "calls"), ("e5", "d", "x", "calls")], "edge_id string, from_id string, to_id string, kind string")
    seeds = nodes.where("node_id = 'a'")
    assert sorted((r.node_id, r.depth, r.via) for r in graph.impact(nodes, edges, seeds, 4).collect()) == [("b", 1, "calls"), ("c", 1, "imports"), ("d", 3, "calls")]
    assert sorted((r.depth, r.edges) for r in graph.paths(edges, "c", "a").collect()) == [(1, ["e3"]), (2, ["e2", "e1"])]
    assert graph.paths(edges, "a", "a").count() == 0


def test_budgets(spark):
    df = spark.createDataFrame([("g", 1, "k1", 8, 2), ("g", 2, "k1", 8, 2), ("g", 3, "k2", 6, 1)], "g string, seq int, key string, bytes int, lines int")
    assert [r.seq for r in context.packed(df, ["g"], ["seq"], bytes=14, lines=2).collect()] == [1]
    assert sorted(r.seq for r in context.packed(df, ["g"], ["seq"], bytes=14, lines=3).collect()) == [1, 3]


def test_store(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    assert held.commit(0, {"t": one}) == 1
    two = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "id int, v string, seq int")
    assert held.commit(1, {"t": store.upsert(held.read("t"), two, ["id"])}) == 2
    with pytest.raises(store.Conflict):
        held.commit(1, {"t": one})
    assert sorted(map(tuple, held.read("t").collect())) == [(1, "c"), (2, "d")]
    assert sorted(map(tuple, held.read("t", 1).collect())) == [(1, "a")]
    assert held.vacuum() == 0 and held.vacuum(older_than_s=0) == 1


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "vec_id int, embedding array<double>")
    assert [r.vec_id for r in search.nearest(df, [1.0, 0.0], 3).collect()] == [1, 2, 3]


def test_stream_sessions(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "a", "modify"), ("r", "2024-01-01 00:00:01", "a", "modify"), ("r", "2024-01-01 00:00:10", ".git/x", "modify"), ("r", "2024-01-01 01:00:00", "b", "create")]
    df = spark.createDataFrame(rows, "root string, at string, path string, op string").select("root", F.to_timestamp("at").alias("ts"), "path", "op")
    df.write.parquet(str(tmp_path / "in"))
    out = []
    stream = watch.sessions(watch.relevant(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "2 seconds", watermark="1 second")
    watch.apply_each(stream, lambda batch, _: out.extend(batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert [(r.n_events, r.paths) for r in out] == [(2, ["a"])]


def test_hashed_embedding_has_unit_length(spark):
    df = spark.createDataFrame([("One two two three",), ("a",), ("a a b c d e f",), ("",)], "t string")
    got = [sum(x * x for x in r.v) for r in df.select(search.hashed_embedding(F.col("t"), 8).alias("v")).collect()]
    assert got[:3] == pytest.approx([1, 1, 1]) and got[3] == 0
