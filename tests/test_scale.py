"""What keeps a query's cost in proportion to its input."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph import scratch
from lodegraph.operators import search


@pytest.fixture
def saved(monkeypatch):
    """Names and schemas of the tables that are written."""
    names, save = {}, scratch.Scratch.save
    monkeypatch.setattr(scratch.Scratch, "save", lambda self, df, name: (names.__setitem__(name, df.schema), save(self, df, name))[1])
    return names


def test_one_pass_over_the_vectors_answers_many_queries(spark, saved):
    """Null, empty, zero, huge and tiny vectors, ties and other dimensions score as the engine's own cosine does."""
    odd = {3: [0.0] * 4, 5: None, 7: [], 11: [1.0, None, 2.0, 0.0], 13: [math.nan, 1.0, 1.0, 1.0], 17: [1e170, 1.0, 0.0, 1e170], 19: [1e-170] * 4, 23: [1.0, 2.0]}
    rows = [(f"k{i}", odd.get(i, [float(i % 7), 1.0, float(i % 5), -float(i % 3)])) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    queries = df.limit(600).selectExpr("vec_id AS query_id", "embedding AS query")
    got = search.nearest_batch(df, queries, 5).select("query_id", "vec_id", "score").collect()
    assert [n for n in saved if n.startswith("block")] == ["block0"]
    each = df.join(F.broadcast(queries), F.size("embedding") == F.size("query")).select("query_id", "vec_id", search.cosine(F.col("embedding"), F.col("query")).alias("score"))
    want = each.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("r <= 5").drop("r").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


SF = "/root/testdata/sf0.001"


@pytest.fixture
def graphs(monkeypatch):
    """No graph is held yet."""
    from lodegraph import catalogue

    for name in ("_nodes_of", "_links_of", "_counts", "_indexes"):
        monkeypatch.setattr(catalogue, name, {})
    return catalogue


def test_nodes_are_read_without_edges(spark, saved, graphs):
    assert graphs.QUERIES["declared_filters"](spark, SF).count() == 30
    assert list(saved) == ["nodes"]


@pytest.mark.parametrize("name", ["graph_invariants", "neighbors", "dangling_edges", "impact_bfs_d3", "boost_zero", "in_degree"])
def test_edges_are_held_by_numbers(spark, saved, graphs, name):
    """Digests are written of no more edges than a query tells of: none of all edges."""
    assert graphs.QUERIES[name](spark, SF).count() > 0
    assert dict((f.name, f.dataType.simpleString()) for f in saved["links"]) == {"from_id": "bigint", "to_id": "bigint", "kind": "string"}
    assert "edges" not in saved and "edge_id" not in {f.name for t in saved.values() for f in t}


def test_nodes_of_one_key_have_edges_of_their_own(spark, graphs, tmp_path):
    """A key that comes twice: the edges are those of the SQL, whose joins are by digests."""
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part", "lineitem"):
        more = {"supplier": " UNION ALL SELECT s_suppkey, 'Again', s_nationkey, s_acctbal FROM x WHERE s_suppkey = 1", "nation": " UNION ALL SELECT 99, 'NOWHERE', NULL"}.get(t, "")
        con.sql(f"COPY (WITH x AS (FROM '{SF}/{t}.parquet') SELECT * FROM x{more}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    for name in ("edge_ids", "in_degree", "out_degree", "distinct_counts", "forest_check", "dangling_edges", "demote_missing", "neighbors"):
        want = con.sql(graphs.SQL[name])
        got = graphs.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())), name


def test_edges_with_a_missing_end(spark):
    from lodegraph.operators import graph

    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "x"), ("e3", "y", "b"), ("e4", "y", "x"), ("e5", "a", None), ("e6", None, "b")], "edge_id string, from_id string, to_id string")
    one, other = graph.astray(nodes, edges)
    assert sorted(r.edge_id for r in one.collect()) == ["e3", "e4", "e6"] and sorted(r.edge_id for r in other.collect()) == ["e2", "e4", "e5"]
    assert sorted(r.edge_id for r in graph.dangling(nodes, edges).collect()) == ["e2", "e3", "e4", "e5", "e6"]


def test_spans_carry_no_lines(spark):
    from lodegraph import catalogue

    assert "line_text" not in catalogue.direct_spans(spark, SF)._jdf.queryExecution().toString()


def test_matches_of_a_long_line_are_handed_on_in_parts(spark):
    """A worker holds few lines at once, though each match has its line."""
    most = []
    text = "x é the y" + " the" * 6000 + "\nand the end"
    import pyarrow as pa
    import regex

    batch = pa.RecordBatch.from_arrays([pa.array(["r"]), pa.array(["p"]), pa.array([text])], ["root", "path", "content"])
    for rows in search.bounded(search.matches(batch, regex.compile(" the"), True)):
        most.append((len(rows), sum(len(r[-1]) for r in rows)))
    assert sum(n for n, _ in most) == 6002 and max(b for _, b in most) < search.MOST_BYTES + len(text)
    df = spark.createDataFrame([("r", "p", text)], "root string, path string, content string")
    got = {r.start: r for r in search.direct(df, " the").collect()}
    for start in (4, 10 + 4 * 5999, len("x é the y".encode()) + 24000 + 4):
        before = text.encode()[:start].decode()
        assert (got[start].line, got[start].column) == (before.count("\n") + 1, len(before) - before.rfind("\n")) and len(got) == 6002
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    search.direct(df, " the")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_a_token_of_all_nodes_is_gathered_by_many_tasks(spark):
    from lodegraph.operators import lexical

    nodes = spark.range(4000).selectExpr("id AS node_id", "'src src' AS name", "'' AS qualified_name", "'' AS path", "'' AS attributes")
    posted = lexical.postings(nodes, 8)
    assert sorted(r.places for r in posted.collect()) == [[0, 1]] * 4000
    each = [r["count"] for r in posted.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 8 and max(each) < 1000 and {r.token for r in posted.collect()} == {"src"}


def test_the_index_is_held_by_numbers(spark, saved, graphs):
    graphs.QUERIES["lexical_hits"](spark, SF).count()
    assert "links" not in saved and saved["postings"]["node_id"].dataType.simpleString() == saved["lengths"]["node_id"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("name", ["pack_java", "pack_markdown"])
def test_files_of_a_small_table_are_extracted_by_many_tasks(spark, graphs, monkeypatch, name):
    assert graphs.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(graphs, "TASK_FILES", 10)
    assert graphs.QUERIES[name](spark, SF).rdd.getNumPartitions() == 20


def test_both_batches_of_an_index_are_extracted_by_many_tasks(spark, graphs, monkeypatch):
    from lodegraph.operators import extract

    tasks, tagged = [], extract.tagged
    monkeypatch.setattr(extract, "tagged", lambda files, packs: (tasks.append(files.rdd.getNumPartitions()), tagged(files, packs))[1])
    assert graphs.QUERIES["index_claims"](spark, SF).count() == 200
    assert len(tasks) == 2 and min(tasks) >= spark.sparkContext.defaultParallelism
