"""A small project through extraction, indexing, retrieval, context and requests."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodegraph import config, providers
from lodegraph.functions import text
from lodegraph.operators import claims, context, extract, graph, indexing, lexical, retrieval, search, store
from lodegraph.plans.engine import Engine
from lodegraph.plans.envelope import Envelope, Warned
from lodegraph.sources import files
from lodegraph.sources.vcs import Vcs

PROJECT = {
    "src/pump.rs": "use std::fmt;\n/// Moves water.\npub struct Pump { speed: u32 }\nimpl Pump {\n    pub fn start(&self) {}\n}\n",
    "jobs/daily.py": "import valve\nfrom tank import Level\n\nAPI_TOKEN = 'abc'\n\n\nclass Nightly(Base):\n    def run(self):\n        return 1\n\n\ndef main():\n    pass\n",
    "jobs/tank.py": "class Level:\n    full = 1\n",
    "docs/guide.md": "# Guide\n\nSee [more](./more.md).\n\n## Pumps\n\nA pump moves water.\n",
    ".github/ci.yml": "on: push\n",
    "pkg/__init__.py": "",
    "pkg/_inner.py": "def hidden():\n    pass\n",
    "notes.log": "nothing\n",
    "out/made.py": "x = 1\n",
    ".gitignore": "out/\n*.log\n!keep.log\n",
    "keep.log": "kept\n",
    ".env": "A=1\n",
    "keys/server.pem": "x",
}


@pytest.fixture
def folder(tmp_path):
    for path, content in PROJECT.items():
        at = tmp_path / "p" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    return str(tmp_path / "p")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_walk(spark, folder):
    got = {r.path: r for r in files.walk(spark, folder).collect()}
    assert set(got) == {"src/pump.rs", "jobs/daily.py", "jobs/tank.py", "docs/guide.md", ".github/ci.yml", "pkg/__init__.py", "pkg/_inner.py", ".gitignore", "keep.log"}
    assert bytes(got["keep.log"].content) == b"kept\n" and got["docs/guide.md"].artifact_class == "docs"
    assert "out/made.py" in {r.path for r in files.walk(spark, folder, gitignore=False).collect()}
    assert {r.path for r in files.walk(spark, folder, extensions=("py",), globs=("docs/**",), most_bytes=60).collect()} == {".github/ci.yml", ".gitignore", "keep.log"}
    assert files.snapshot(spark, folder, "keep.log")["artifact_class"] == "build"
    assert files.snapshot(spark, folder, "../p/keep.log") is None and files.snapshot(spark, folder, ".env") is None and files.snapshot(spark, folder, "nowhere") is None
    assert files.size_of(spark, folder) == sum(len(x) for x in PROJECT.values())
    assert ("jobs", len(PROJECT["jobs/daily.py"]) + len(PROJECT["jobs/tank.py"]), 2) in rows(files.assets(spark, folder), "name", "bytes", "files")


def test_walk_errors(spark, folder):
    named = spark.createDataFrame([("main", "a", f"{folder}/gone.txt"), ("main", "b", f"{folder}/keep.log")], "root string, path string, address string")
    assert rows(files.read(named).where("content is null"), "path") == [("a",)]
    with pytest.raises(Exception, match="gone"):
        files.read(named, strict=True).collect()


def test_ignore_lists(spark):
    lists = [("", "*.tmp"), ("", "/top.txt"), ("", "build/"), ("sub", "!keep.tmp"), ("", "a/**/z"), ("", "# note"), ("", "")]
    cases = {"x.tmp": True, "sub/x.tmp": True, "sub/keep.tmp": False, "top.txt": True, "sub/top.txt": False, "build/x": True, "sub/build/y": True, "builds/x": False, "a/b/c/z": True, "a/z": True, "q": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.e for r in df.select("path", files.ignored(F.col("path"), lists).alias("e")).collect()} == cases


def test_extraction(spark, folder):
    got = extract.tables(extract.tagged(files.walk(spark, folder)))
    assert rows(got["nodes"].where("path = 'src/pump.rs'"), "kind", "name") == [("file", "src/pump.rs"), ("method", "start"), ("struct", "Pump")]
    assert rows(got["skips"], "reason") == [("no pack takes it",)] * 3
    start = got["nodes"].where("name = 'start'").first()
    assert (start.range.start_line, start.range.start_column, start.language, start.owner.producer) == (5, 5, "rust", "rust_pack")
    from lodegraph.functions import ids

    made = got["nodes"].where("name = 'Pump'").select("node_id", ids.node_id(F.col("kind"), F.col("root"), F.col("path"), F.lit(""), F.col("name"), F.lit(0)).alias("again")).first()
    assert made.node_id == made.again
    assert got["edges"].join(got["nodes"], F.col("to_id") == F.col("node_id"), "left_anti").count() == 0
    empty = extract.tables(extract.tagged(spark.createDataFrame([("m", "a.rs", None), ("m", "b.rs", b"")], "root string, path string, content binary")))
    assert rows(empty["skips"], "reason") == [("unreadable",)] and empty["nodes"].count() == 1


def source(spark, contents):
    return spark.createDataFrame([("m", p, c.encode()) for p, c in contents.items()], "root string, path string, content binary")


def test_index_and_update(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    a = {"a.py": "from b import helper\n\n\ndef use():\n    pass\n", "b.py": "def helper():\n    pass\n"}
    assert indexing.index_source(held, source(spark, a)) == 1
    view = claims.View(held)
    promoted = view.table("edges").where("owner.producer = 'promoter'").collect()
    assert len(promoted) == 1 and promoted[0].kind == "imports" and promoted[0].provenance.derivation == "resolved"
    assert rows(view.unresolved(), "seeking") == [("b",)]
    # The definition goes: its edge becomes a reference again; it comes back: an edge again.
    indexing.apply_update(held, source(spark, {"b.py": "def other():\n    pass\n"}))
    view = claims.View(held)
    assert rows(view.unresolved(), "seeking") == [("b",), ("helper",)] and view.table("edges").where("owner.producer = 'promoter'").isEmpty()
    assert view.changes_since(1).first().demoted == 1 and view.revision() == 2
    indexing.apply_update(held, source(spark, {"b.py": a["b.py"]}))
    assert rows(claims.View(held).unresolved(), "seeking") == [("b",)]
    # Incremental equals a rebuild, revisions apart.
    other = store.Store(spark, str(tmp_path / "t"))
    indexing.rebuild_source(other, source(spark, a))
    for name, key in (("nodes", ["node_id", "name", "owner"]), ("edges", ["edge_id", "from_id", "to_id", "kind"]), ("unresolved", ["from_id", "seeking", "edge_kind"])):
        assert graph.equal(claims.View(held).table(name).select(*key), claims.View(other).table(name).select(*key)).count() == 0
    # Removal, and a source without the file.
    indexing.apply_removal(held, spark.createDataFrame([("m", "b.py")], "root string, path string"))
    assert rows(claims.View(held).files(), "path") == [("a.py",)]
    indexing.index_source(held, source(spark, {"c.py": "x = 1\n"}))
    assert rows(claims.View(held).files(), "path") == [("c.py",)]


def test_resolution_fans_out(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    indexing.index_source(held, source(spark, {"b.py": "def helper():\n    pass\n", "c.py": "def helper():\n    pass\n"}))
    indexing.apply_update(held, source(spark, {"a.py": "from b import helper\n"}))
    assert claims.View(held).table("edges").where("kind = 'imports'").isEmpty()  # old definitions are for the resolver
    assert indexing.resolve_existing(held) == 2
    view = claims.View(held)
    assert view.table("edges").where("owner.producer = 'resolver'").count() == 2 and rows(view.unresolved(), "seeking") == [("b",)]
    assert rows(view.resolution_owners(), "producer") == [("resolver",)]
    assert indexing.invalidate_resolution(held) == 2
    assert rows(claims.View(held).unresolved(), "seeking") == [("b",), ("helper",)]


def test_failed_rebuild_keeps_the_graph(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    indexing.rebuild_source(held, source(spark, {"a.py": "def one():\n    pass\n"}))
    with pytest.raises(store.StoreError):
        indexing.rebuild_source(held, source(spark, {"a.py": "def ("}))
    assert "one" in {r.name for r in claims.View(held).nodes().collect()} and claims.View(held).revision() == 1
    indexing.rebuild_source(held, source(spark, {"a.py": "def two():\n    pass\n"}))
    assert {r.name for r in claims.View(held).nodes().collect()} == {"a.py", "two"} and claims.View(held).revision() == 2


def test_versions(spark, tmp_path):
    old, new = indexing.current_versions(), indexing.current_versions()
    new["resolution"], new["packs"] = 2, {**new["packs"], "rust": "2"}
    assert indexing.plan_invalidation(old, new) == [indexing.Scope("resolution", previous="1"), indexing.Scope("pack", "rust", "1")]
    assert indexing.plan_invalidation(None, new) == [] and indexing.plan_invalidation(old, old) == []
    held = store.Store(spark, str(tmp_path / "s"))
    both = {"a.rs": "pub fn f() {}\n", "b.py": "def g():\n    pass\n"}
    indexing.index_source(held, source(spark, both))
    again = indexing.invalidate_producer(held, "rust_pack", "1")
    assert rows(again, "path") == [("a.rs",)] and {r.name for r in claims.View(held).nodes().collect()} == {"b.py", "g"}
    indexing.execute(held, [indexing.Scope("pack", "rust", "1"), indexing.Scope("classification")], lambda: source(spark, both))
    indexing.execute(held, [indexing.Scope("pack", "python", "1")], lambda: source(spark, both))
    assert {"b.py", "g"} <= {r.name for r in claims.View(held).nodes().collect()}
    n = indexing.reclassify(held, lambda p: F.lit("docs"))
    assert n == claims.View(held).table("nodes").count() and rows(claims.View(held).nodes(), "artifact_class")[0] == ("docs",)
    assert indexing.reclassify(held, lambda p: F.lit("docs")) == 0
    indexing.execute(held, [indexing.Scope("registry")], lambda: source(spark, both))
    assert {r.name for r in claims.View(held).nodes().collect()} == {"a.rs", "f", "b.py", "g"}


def test_claims(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    o = lambda path, producer="p": (("m", path, producer, "1"),)
    node = "node_id string, name string, kind string, root string, path string, owner struct<root:string,path:string,producer:string,producer_version:string>"
    nodes = spark.createDataFrame([("n1", "one", "file", "m", "a", *o("a")), ("n1", "uno", "file", "m", "a", *o("a", "q")), ("n2", "two", "odd kind", "m", "b", *o("b"))], node)
    refs = spark.createDataFrame([("n1", "x", "calls", *o("a")), ("n1", "x", "calls", *o("a")), ("n2", "y", "odd", *o("b"))], "from_id string, seeking string, edge_kind string, owner struct<root:string,path:string,producer:string,producer_version:string>")
    t = claims.Transaction(held)
    t.put_nodes(nodes)
    t.put_unresolved(refs)
    t.put_skips(spark.createDataFrame([(*o("s"), "too large")], "owner struct<root:string,path:string,producer:string,producer_version:string>, reason string"))
    t.put_diagnostics(spark.createDataFrame([(*o("a"), "odd")], "owner struct<root:string,path:string,producer:string,producer_version:string>, message string"))
    t.put_version_records({"schema": 1})
    t.set_revision(1)
    t.put_index_intent("lexical")
    t.commit()
    v = claims.View(held)
    assert rows(v.nodes(), "node_id", "name", "kind") == [("n1", "one", "file"), ("n2", "two", "file")] and v.counts() == (2, 0)
    assert v.nodes().first().provenance.extractor == "p" and rows(v.unresolved(), "seeking", "edge_kind") == [("x", "calls"), ("y", "references")]
    assert v.unresolved_seeking("x").count() == 1 and v.unresolved_seeking("X").count() == 0
    assert v.skips("m").count() == 1 and v.skips("m", "zz").count() == 0 and v.diagnostics().count() == 1 and v.version_records() == {"schema": 1} and v.revision() == 1
    assert rows(v.index_states(), "kind", "is_current") == [("lexical", False)]
    assert [tuple(r) for r in v.owners().collect()] == [("m", "a", "p", "1"), ("m", "a", "q", "1"), ("m", "b", "p", "1"), ("m", "s", "p", "1")]
    assert v.owners_by_producer("q").count() == 1 and v.node_claims_by_file("m", "a").count() == 2 and v.node("n1").first().name == "one"
    t = claims.Transaction(held)
    t.remove_node_claims(nodes.where("name = 'one'"))
    t.remove_unresolved(refs.where("seeking = 'y'"))
    t.acknowledge_index("lexical", 1)
    t.rebuild_lexical()
    t.commit()
    v = claims.View(held)
    assert rows(v.nodes(), "name") == [("two",), ("uno",)] and rows(v.unresolved(), "seeking") == [("x",)] and v.index_states().first().is_current
    t = claims.Transaction(held)
    t.remove_by_file(spark.createDataFrame([("m", "a")], "root string, path string"))
    t.commit()
    assert rows(claims.View(held).nodes(), "name") == [("two",)]
    t = claims.Transaction(held)
    t.remove_claims(spark.createDataFrame([("m", "b", "p", "1")], "root string, path string, producer string, producer_version string"))
    with pytest.raises(store.StoreError):
        t.update_node_classifications(spark.createDataFrame([("n9", *o("z"), "docs")], "node_id string, owner struct<root:string,path:string,producer:string,producer_version:string>, artifact_class string"))
    with pytest.raises(store.Conflict):
        t.expect_revision(7)
    late = claims.Transaction(held)
    t.commit()
    late.clear_graph()
    with pytest.raises(store.Conflict):
        late.commit()
    claims.transact(held, lambda x: x.clear_graph())
    assert claims.View(held).counts() == (0, 0) and claims.View(held).version_records() is None


def test_store_life(spark, tmp_path):
    with pytest.raises(store.StoreError):
        store.Store(spark, str(tmp_path / "none"), create=False)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(store.StoreError):
        store.Store(spark, str(tmp_path / "other"))
    held = store.Store(spark, str(tmp_path / "s"))
    held.commit(0, {"t": spark.range(3)}, {"a": 1})
    held.compact()
    assert held.read("t").count() == 3 and store.Store.inspect(spark, str(tmp_path / "s")) == {"format": 1, "revision": 2, "tables": ["t"], "meta": {"a": 1}}
    assert "error" in store.Store.inspect(spark, str(tmp_path / "none"))
    at = tmp_path / "s" / "manifests" / f"{3:012d}.json"
    at.write_text(json.dumps({"format": 2, "mark": store.Store.MARK, "tables": {}, "meta": {}}))
    with pytest.raises(store.StoreError):
        store.Store(spark, str(tmp_path / "s"))
    at.write_text(json.dumps({"format": 0, "tables": held.manifest(2)}))
    (tmp_path / "s" / "manifests" / f".{3:012d}.json.crc").unlink(missing_ok=True)
    assert store.Store.migrate(spark, str(tmp_path / "s")) == 4 and store.Store(spark, str(tmp_path / "s")).read("t").count() == 3
    with store.Lease(spark, str(tmp_path / "s"), "one") as one:
        assert one.held()["holder"] == "one"
        with pytest.raises(store.Conflict):
            store.Lease(spark, str(tmp_path / "s"), "two").acquire()
    lapsed = store.Lease(spark, str(tmp_path / "s"), "three", seconds=-1)
    lapsed.acquire()
    with store.Lease(spark, str(tmp_path / "s"), "four") as four:
        lapsed.release()
        assert four.held()["holder"] == "four"
    assert four.held() is None
    held.remove()
    assert not os.path.exists(tmp_path / "s")


def test_lexical(spark):
    nodes = spark.createDataFrame([("a", "café_bar", "Café Bar", "src/x.rs", {"doc_summary": "the quick fox"}), ("b", "barista", None, "src/quick_fox.rs", None), ("c", "fox", "quick::fox", "z", {})], "node_id string, name string, qualified_name string, path string, attributes map<string,string>")
    p, n = lexical.postings(nodes), lexical.lengths(nodes)
    assert rows(lexical.hits(p, n, "cafe"), "node_id") == [("a",)] and rows(lexical.hits(p, n, "bar"), "node_id") == [("a",), ("b",)]
    assert rows(lexical.hits(p, n, '"quick fox"'), "node_id") == [("a",), ("b",), ("c",)] and lexical.hits(p, n, "--").count() == 0
    best = [r.node_id for r in lexical.hits(p, n, "quick fox", 1).collect()]
    assert len(best) == 1
    both = search.bm25(nodes.select(F.col("node_id").alias("doc_id"), F.concat_ws(" . ", "name", "qualified_name", "path", F.map_values("attributes")[0]).alias("text")).where("doc_id = 'x'"), "fox")
    assert both.count() == 0


def test_hybrid(spark):
    nodes = spark.createDataFrame([("a" * 64, "Engine", "src/a.rs", "code"), ("b" * 64, "EnginePart", "src/b.rs", "docs"), ("c" * 64, "wheel", "src/c.rs", "code"), ("d" * 64, "other", "src/d.rs", "code")], "node_id string, name string, path string, artifact_class string")
    degree = spark.createDataFrame([("b" * 64, 4)], "node_id string, in_degree long")
    hits = spark.createDataFrame([("c" * 64, 2.0), ("e" * 64, 9.0)], "node_id string, score double")
    got = {r.name: (round(r.score, 6), {x.signal: round(x.score, 6) for x in r.reasons}) for r in retrieval.hybrid(nodes, degree, hits, "engine whe").collect()}
    assert set(got) == {"Engine", "EnginePart", "wheel"} and got["wheel"][1] == {"fts_lexical_match": 0.2, "artifact_class_code": 0.1}
    got = {r.name: r for r in retrieval.hybrid(nodes, degree, None, "engine").collect()}
    assert round(got["Engine"].score, 6) == 0.6 and round(got["EnginePart"].score, 6) == 0.45
    vectors = spark.createDataFrame([("a" * 64, 0.5), ("d" * 64, 1.0)], "node_id string, score double")
    got = {r.name: r for r in retrieval.hybrid(nodes, degree, None, "engine", vectors=vectors).collect()}
    assert set(got) == {"Engine", "EnginePart"} and round(got["Engine"].score, 6) == 0.7 and got["Engine"].reasons[-1].signal == "vector_similarity"
    ranked = retrieval.hybrid(nodes, degree, None, "engine")
    cut = retrieval._cut(ranked, 1)
    assert cut.truncated and [r.name for r in cut.rows.collect()] == ["Engine"] and retrieval._cut(ranked, 0).rows.count() == 0 and not retrieval._cut(ranked, 2).truncated
    assert [r.name for r in retrieval.rank("wheel", nodes).orderBy(F.desc("score")).limit(1).collect()] == ["wheel"]


def test_further_signals(spark):
    nodes = spark.createDataFrame([("a" * 64, "Engine", "m::Engine", "src/engine.rs", "code", "struct", (4,)), ("b" * 64, "engine_x", "engine_x", "old/b.rs", "docs", "function", (1,))], "node_id string, name string, qualified_name string, path string, artifact_class string, kind string, provenance struct<revision:long>")
    degree = spark.createDataFrame([], "node_id string, in_degree long")
    ranked = retrieval.hybrid(nodes, degree, None, "engine")
    before = {r.name: r.score for r in ranked.collect()}
    hops = spark.createDataFrame([("b" * 64, 1)], "node_id string, depth int")
    got = {r.name: r for r in retrieval.with_signals(ranked, "engine", ("struct",), ("docs",), ("src/", "lib/"), 4, hops).collect()}
    told = {n: {x.signal for x in r.reasons} for n, r in got.items()}
    assert told["Engine"] >= {"qualified_suffix_match", "kind_preference", "source_priority", "recency", "channel_agreement"} and "graph_proximity" not in told["Engine"]
    assert told["engine_x"] >= {"artifact_class_preference", "recency", "graph_proximity"} and not told["engine_x"] & {"kind_preference", "channel_agreement"}
    assert round(got["Engine"].score - before["Engine"], 6) == 0.225 and round(got["engine_x"].score - before["engine_x"], 6) == 0.0875
    assert {r.name: r.score for r in retrieval.with_signals(ranked, "zzz").collect()}["engine_x"] == before["engine_x"]


def test_reranking(spark):
    ranked = spark.createDataFrame([(c * 64, c, 1.0 - k / 10, [("s", 1.0)], "k", "p", {}) for k, c in enumerate("abcd")], "node_id string, name string, score double, reasons array<struct<signal:string,score:double>>, kind string, path string, attributes map<string,string>")
    got = retrieval.rerank(retrieval.Found(ranked), "q", lambda q, shown: f"so: [2, 9, 2, {shown[0]['index']}] done")
    assert [r.name for r in got.rows.orderBy("place").collect()] == ["c", "a", "b", "d"] and round({r.name: r.score for r in got.rows.collect()}["c"], 6) == 1.15
    got = retrieval.rerank(retrieval.Found(ranked), "q", lambda q, shown: "none")
    assert got.warnings and [r.name for r in got.rows.orderBy(F.desc("score")).collect()] == list("abcd")
    hits = spark.createDataFrame([("node_" + "d" * 12, 5.0)], "shown string, score double")
    assert [r.name for r in retrieval.rerank_with_scores(retrieval.Found(ranked), hits).rows.orderBy(F.desc("score")).collect()] == list("dabc")
    for bad in ("", "]3[", "[a]", "[1.5]", "[true]", "[-1]"):
        with pytest.raises(ValueError):
            retrieval.parsed_indices(bad)
    e = retrieval.evaluated(spark.createDataFrame([("q", "A", 2.0, "1"), ("q", "b", 1.0, "2"), ("r", "c", 1.0, "3")], "query string, name string, score double, node_id string"), spark.createDataFrame([("q", "B"), ("r", "c"), ("s", "z")], "query string, name string")).first()
    assert (round(e.p_at_1, 4), round(e.p_at_5, 4), e.mrr) == (0.3333, 0.6667, 0.5)


def test_direct_search(spark):
    df = spark.createDataFrame([("m", "a", "foo\nbar foé\n"), ("m", "b", "api_key = 12\n")], "root string, path string, content string")
    at = lambda p, r=True: [(x.line, x.column, x.end_line, x.end_column, x.start, x.end) for x in search.direct(df.where("path = 'a'"), p, r).orderBy("start").collect()]
    assert at("foo\nbar") == [(1, 1, 2, 4, 0, 7)] and at("(?<n>fo)o") == [(1, 1, 1, 4, 0, 3)] and at("o*")[:2] == [(1, 1, 1, 1, 0, 0), (1, 2, 1, 4, 1, 3)]
    assert at(r"\w+$") == [(1, 1, 1, 4, 0, 3), (2, 5, 2, 8, 8, 12)] and at("é") == at("é", False) == [(2, 7, 2, 8, 10, 12)] and at(r"\\1") == []
    assert at("o.b", False) == [] and [r.preview for r in search.direct(df, "12").collect()] == ["api_key = [REDACTED]"]
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "("):
        with pytest.raises(ValueError):
            search.direct(df, bad, True)
    assert [(r.path, r.line) for r in search.direct(df, "[a-z]+", True, limit=2).collect()] == [("a", 1), ("a", 2)]


def test_positions(spark):
    df = spark.createDataFrame([("fn \U0001f980_run() {}\nab",)], "c string")
    at = lambda o: df.select(text.line_of(F.col("c"), F.lit(o)).alias("l"), text.column_of(F.col("c"), F.lit(o)).alias("k")).first()
    assert tuple(at(3)) == (1, 4) and tuple(at(7)) == (1, 5) and tuple(at(17)) == (2, 1) and tuple(at(19)) == (2, 3) and tuple(at(20)) == (None, None)
    numbers = spark.createDataFrame([("x [1, 2] y",), ("none",)], "t string").select(text.number_list(F.col("t")).alias("n")).collect()
    assert [r.n for r in numbers] == [[1, 2], None]
    assert spark.range(1).select((text.version_order(F.lit("1.10.0")) > text.version_order(F.lit("v1.9-rc"))).alias("x")).first().x


def test_enclosing(spark):
    import random

    random.seed(3)
    ranges = [("p", f"n{k:03}", a, a + random.choice([0, 1, 3, 17, 900, 100_000])) for k, a in enumerate(random.choices(range(1, 2000), k=150))]
    points = [("p", x) for x in random.sample(range(1, 2300), 300)] + [("q", 5)]
    got = {(r.path, r.line): r.node_id for r in context.enclosing(spark.createDataFrame(points, "path string, line long"), spark.createDataFrame(ranges, "path string, node_id string, start_line long, end_line long")).collect()}
    want = {}
    for p, line in points:
        around = [(b - a, n) for q, n, a, b in ranges if q == p and a <= line <= b]
        if around:
            want[p, line] = min(around)[1]
    assert got == want


def test_context(spark):
    files_ = spark.createDataFrame([("m", "a.py", "one\ntwo = 1\nsecret: x\nfour\n")], "root string, path string, content string")
    cut = context.verbatim(files_, spark.createDataFrame([("m", "a.py", 2, 3), ("m", "a.py", 9, 9)], "root string, path string, start_line int, end_line int"), 1).collect()
    assert [r.text for r in cut] == ["   1: one\n   2: two = 1\n   3: secret: [REDACTED]\n   4: four"]
    r = "struct<start:bigint,`end`:bigint,start_line:int,start_column:int,end_line:int,end_column:int>"
    nodes = spark.createDataFrame([(c, c.upper(), "function", "m", "a.py", (0, 3, 1, 1, 1, 4) if c != "z" else None, {"k": "v"}) for c in "abcz"], f"node_id string, name string, kind string, root string, path string, range {r}, attributes map<string,string>")
    edges = spark.createDataFrame([("e2", "b", "c", "calls"), ("e1", "b", "a", "calls"), ("e3", "c", "z", "calls")], "edge_id string, from_id string, to_id string, kind string")
    seeds = nodes.where("node_id in ('b', 'c')")
    for given in (seeds, seeds.orderBy(F.desc("node_id"))):
        got = context.assembled(nodes, edges, given, files_, 0, bytes=4096).orderBy("seq").collect()
        assert [x.node_id for x in got] == ["b", "a", "c", "z"]
        assert got[0].text == "Symbol: B (function)\nFile: a.py (L1-L1)\nBlast Radius: 0 incoming callers, 2 outgoing relations\n" + "-" * 40 + "\n   1: one"
        assert got[3].text == 'Symbol: Z (function)\nFile: a.py\nLine Range: \nBlast Radius: 1 incoming callers, 0 outgoing relations\nAttributes: {"k":"v"}'
    assert [x.node_id for x in context.assembled(nodes, edges, seeds, files_, 0, bytes=len(got[0].text) + len(got[1].text)).collect()] == ["b", "a"]
    assert context.assembled(nodes, edges, seeds, files_, 0, bytes=4096, lines=5, units=99, estimate=F.size(F.split("text", " "))).count() == 1
    with pytest.raises(ValueError):
        context.assembled(nodes, edges, seeds, files_, bytes=9, units=9)
    with pytest.raises(ValueError):
        context.expanded(nodes, edges, seeds, "odd")
    one = nodes.where("node_id = 'b'")
    assert rows(context.expanded(nodes, edges, one, "dependency"), "node_id") == [("a",), ("b",), ("c",)] and rows(context.expanded(nodes, edges, nodes.where("node_id = 'z'"), "dependents", 2), "node_id") == [("b",), ("c",), ("z",)]
    assert rows(context.expanded(nodes, edges, one, "call_chain", 3), "node_id") == [("a",), ("b",), ("c",), ("z",)] and context.expanded(nodes, edges, one, "file").count() == 4


def test_invariants(spark):
    n = lambda c: c * 64
    nodes = spark.createDataFrame([(n("a"), "file", "m", "x"), (n("b"), "class", "m", "x"), (n("c"), "odd", "m", "x"), ("short", "file", "m", "x")], "node_id string, kind string, root string, path string")
    edges = spark.createDataFrame([(n("1"), n("a"), n("b"), "contains"), (n("2"), n("b"), n("a"), "contains"), (n("3"), n("c"), n("b"), "contains"), (n("4"), n("a"), n("f"), "calls")], "edge_id string, from_id string, to_id string, kind string")
    got = rows(claims.invariants(nodes, edges), "invariant", "id")
    assert got == sorted([("node id is no digest", "short"), ("node kind is unknown", n("c")), ("edge leads nowhere", n("4")), ("node has two containers", n("b")), ("file has two nodes", n("a")), ("containers are in a cycle", n("a")), ("containers are in a cycle", n("b"))])


def test_trace(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "k"), ("e2", "b", "c", "k"), ("e3", "a", "c", "k")], "edge_id string, from_id string, to_id string, kind string")
    assert sorted(r.nodes for r in retrieval.trace(edges, "a", "c", 3).collect()) == [["a", "b", "c"], ["a", "c"]] and [r.nodes for r in retrieval.trace(edges, "a", "c", 2).collect()] == [["a", "c"]] and retrieval.trace(edges, "a", "c", 1).count() == 0


def test_configuration():
    got = config.load('[retrieval]\ndefault_limit = 100\n[indexing]\nexclude_paths = ["a"]\n', project='[retrieval]\ndefault_limit = 25\n[indexing]\nexclude_paths = ["b", "a"]\n')
    assert got["retrieval"]["default_limit"] == 25 and got["indexing"]["exclude_paths"] == ["a", "b"] and got["context"]["padding_lines"] == 2
    for bad in ("schema_version = 2", "[project]\nroots = []", '[project]\nroots = ["../x"]', "[retrieval]\nregex_size_limit_bytes = 0", '[retrieval]\ndefault_mode = "odd"', "x ="):
        with pytest.raises(config.ConfigError):
            config.load(bad)
    for bad in ('[intelligence.providers.x]\nendpoint = "y"', '[intelligence.embedding]\napi_key_env = "K"'):
        config.load(bad)
        with pytest.raises(config.ConfigError):
            config.load(project=bad)


def test_vcs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    assert Vcs(spark, str(tmp_path / "none")).revision() is None
    git("init", "-q", "-b", "trunk")
    for name in "abc":
        (tmp_path / name).write_text(name)
    git("add", ".")
    git("commit", "-qm", "x")
    first = Vcs(spark, str(tmp_path)).revision()
    (tmp_path / "a").write_text("more")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    v = Vcs(spark, str(tmp_path))
    assert v.branch() == "trunk" and len(first) == 40
    assert rows(v.status(), "path", "op") == [("a", "modified"), ("b", "deleted"), ("d", "added")] and rows(v.changed(), "path") == [("a",), ("d",)] and rows(v.changed(True), "path") == [("a",), ("b",), ("d",)]
    git("add", "-A")
    git("commit", "-qm", "y")
    assert rows(v.since(first), "path", "op") == [("a", "modified"), ("b", "deleted"), ("d", "added")]


def test_providers(spark):
    df = spark.createDataFrame([("a", "compute a sum"), ("b", "a database"), ("c", "")], "node_id string, content string")
    got = providers.embedded(df, "content", "embedded", 40).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 and len(r.embedding) == 40 for r in got) and got[0].embedding[:8] == got[0].embedding[32:]
    assert [(r.node_id, round(r.score, 2), r["rank"]) for r in providers.reranked(df, "compute sum", "embedded").orderBy("rank").collect()] == [("a", 0.8, 0), ("b", 0.5, 1), ("c", 0.5, 2)]

    class Model:
        dimension = 2

        def embed(self, texts):
            return [[float(len(t)), 0.0] for t in texts]

        def rerank(self, query, candidates):
            return [(i, float(len(t))) for i, t in candidates]

    with pytest.raises(providers.Unavailable):
        providers.embedded(df, "content", "none", 2)
    providers.register("own", providers.Provider(embed=lambda d: Model(), rerank=Model))
    assert rows(providers.reranked(df, "q", "own"), "node_id", "rank") == [("a", 0), ("b", 1), ("c", 2)]
    said = spark.createDataFrame([(1, '{"data": [{"index": 1, "embedding": [1.5]}, {"embedding": [2]}]}'), (2, "oops")], "k int, reply string")
    assert sorted((r.k, r["index"], r.vector) for r in providers.replies(said, "list").collect()) == [(1, 1, [1.5]), (1, 1, [2.0])]
    assert [round(r.s, 2) for r in spark.range(3).select(providers.rank_score(F.col("id")).alias("s")).collect()] == [1.0, 0.95, 0.9]


def test_requests(spark, folder, tmp_path):
    e = Engine(spark, folder, str(tmp_path / "state"))
    assert e.status().status == "unavailable" and e.dispatch("odd").status == "invalid" and e.dispatch("impact").status == "invalid"
    made = e.index_all()
    assert made.status == "ok" and made.data["nodes"] > 10
    s = e.status()
    assert s.data["files"] == 9 and s.freshness.lexical_state == "current" and s.freshness.graph_revision == made.data["revision"]
    g = e.search_graph("pump")
    assert "Pump" in {r.name for r in g.data.collect()} and g.status == "ok"
    h = e.search("Level")
    assert h.data.orderBy(F.desc("score"), "node_id").first().name == "Level" and json.loads(h.rendered())["status"] == "ok" and "Level" in h.shown()
    assert e.search_hybrid("a", 1).truncation.reason == "limit" and e.search_hybrid("a", 0).data.count() == 0
    d = e.search_direct("pump")
    assert {(r.path, r.line) for r in d.data.collect()} == {("docs/guide.md", 7)} and e.search("[", "regex").status == "invalid"
    assert [r.name for r in e.inspect_file("src/pump.rs").data.orderBy("name").collect()] == ["Pump", "start"]
    assert e.at_position("src/pump.rs", 5).data.first().name == "start" and e.at_position("src/pump.rs", 99).status == "not_found"
    assert e.entity("Nightly").data.first().kind == "class" and e.entity("nobody").status == "not_found"
    assert "Nightly" in {r.name for r in e.neighbors("jobs/daily.py").data.collect()}
    assert [r.node_id for r in e.impact("Level").data.collect()] and e.path("jobs/daily.py", "Nightly").data.first().depth == 1 and e.path("Nightly", "Pump").status == "not_found"
    c = e.context("pump", 2000)
    assert any("Symbol: Pump (struct)" in r.text for r in c.data.collect()) and e.context("pump", 10).truncation.reason == "bytes"
    assert any("abc" in r.text for r in e.review_context(0).data.collect()) is False and e.review_context().status == "ok"
    ev = e.eval([("Level", "level"), ("Nightly", "nothing")]).data.first()
    assert ev.p_at_1 == 0.5 and ev.mrr == 0.5
    assert e.rerank("Level").status == "partial" and e.rerank("Level", lambda q, shown: "[0]").status == "ok"
    os.remove(os.path.join(folder, "jobs/tank.py"))
    with open(os.path.join(folder, "src/pump.rs"), "a") as f:
        f.write("pub fn drain() {}\n")
    e.update_files(["jobs/tank.py", "src/pump.rs", "../x", ".env"])
    assert e.entity("drain").status == "ok" and e.entity("Level").status == "not_found" and e.status().freshness.lexical_state == "bypassed_lagging"
    assert e.rebuild("lexical").status == "ok" and e.status().freshness.lexical_state == "current" and e.rebuild("vector").status == "unavailable"
    assert e.sync_vcs().data == {"revision": None}
    with pytest.raises(ValueError):
        Envelope("odd")
    with pytest.raises(ValueError):
        Warned("odd", "")


def test_feeds(spark, tmp_path):
    from lodegraph.streaming import watch

    at = lambda x: f"2024-01-01 00:00:{x:06.3f}"
    events = [("m", at(0), "a", "modify", None), ("m", at(0.05), "a.tmp", "create", None), ("m", at(0.06), "a.tmp", "rename", "a"), ("m", at(5), "b", "create", None), ("m", at(5.1), "b", "delete", None), ("m", at(9), "c", "create", None), ("m", at(9.1), "c", "modify", None), ("m", at(20), "d", "delete", None)]
    df = spark.createDataFrame(events, "root string, at string, path string, op string, renamed_to string").withColumn("ts", F.to_timestamp("at"))
    assert rows(watch.saved(df), "path", "op") == [("a", "modify"), ("c", "create"), ("d", "delete")]
    known = spark.createDataFrame([("m", "a", "h1")], "root string, path string, content_hash string")
    new = spark.createDataFrame([("m", "a", "h1"), ("m", "a", "h2")], "root string, path string, content_hash string")
    assert rows(watch.unseen(new, known), "content_hash") == [("h2",)]
    done = []
    run = watch.bounded(lambda b, k: done.append(("update", k)), lambda k: done.append(("scan", k)), 2)
    run(spark.createDataFrame([(["a"],), (["b"],)], "paths array<string>"), 1)
    run(spark.createDataFrame([(["a", "b", "c"],)], "paths array<string>"), 2)
    assert done == [("update", 1), ("scan", 2)]
    assert [r.revision for r in watch.revisions(spark.createDataFrame([(2,), (1,), (3,)], "revision long"), 1).collect()] == [2, 3]
    asked = spark.createDataFrame([("p", "2024-01-01 00:00:00"), ("p", "2024-01-01 00:05:00"), ("p", "2024-01-01 01:00:00")], "project string, at string").select("project", F.to_timestamp("at").alias("ts"))
    assert [(r.n_requests, r.active) for r in watch.expired(asked, "2024-01-01 01:05:00").orderBy("start").collect()] == [(2, False), (1, True)]
    new.withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("root string, path string, content_hash string, ts timestamp").parquet(str(tmp_path / "in"))
    got = []
    feed = watch.Watch(lambda: watch.unseen_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: got.extend(r.content_hash for r in b.collect())).start())
    feed.resume()
    feed._query.processAllAvailable()
    assert feed.active and sorted(got) == ["h1", "h2"]
    feed.pause()
    assert not feed.active
