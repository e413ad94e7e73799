"""Operators at sizes that the tables do not reach."""

from factloom.operators import facts as O
from factloom.operators import frameworks as Q
from factloom.operators import graph as G


def test_deep_traces(spark):
    turns = [(1, i, i - 1) for i in range(40)] + [(2, 5, 4), (2, 6, 5), (2, 9, 8)]
    got = O.span_depths(spark.createDataFrame(turns, "trace long, span long, parent long"), "trace", "span", "parent").collect()
    assert sorted((r.trace, r.span, r.root, r.depth) for r in got) == [(1, i, 0, i) for i in range(40)] + [(2, 5, 5, 0), (2, 6, 5, 1), (2, 9, 9, 0)]
    assert O.span_depths(spark.createDataFrame([], "trace long, span long, parent long"), "trace", "span", "parent").count() == 0


def test_similar_for_many_queries(spark):
    v = spark.range(1100).selectExpr("id as vec_id", "array(cos(id / 200.0), sin(id / 200.0)) as embedding")
    got = O.top_similar(v, v.selectExpr("vec_id as query_id", "embedding as q"), 1).collect()
    assert sorted(r.query_id for r in got) == list(range(1100))
    assert all(abs(r.vec_id - r.query_id) == 1 for r in got)


def test_distances_for_many_seeds(spark):
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    seeds = spark.range(1001).selectExpr("concat('s', id) as seed", "'a' as node")
    got = G.distances(edges, nodes, seeds, 2)
    assert {(r.node, r.distance, r.n) for r in got.groupBy("node", "distance").agg(G.F.count("*").alias("n")).collect()} == {("a", 0, 1001), ("b", 1, 1001), ("c", 99, 1001)}


def test_suffixes_of_many_templates(spark):
    call = "path string, line int, caller string, callee string, arguments array<string>"
    calls = spark.createDataFrame([("m.py", 1, "m.f", "render", ["'item.html'"]), ("m.py", 2, "m.g", "render", ["'sub/x.html'"]), ("m.py", 3, "m.h", "render", ["'tem.html'"])], call)
    paths = spark.range(10_001).selectExpr("concat('t/', id, '.html') as path").unionAll(spark.createDataFrame([("web/item.html",), ("a/sub/x.html",), ("b/sub/x.html",)], "path string"))
    got = sorted((r.source, r.target, r.confidence) for r in Q.template_edges(calls, paths).collect())
    assert got == [("m.f", "web/item.html", "HIGH"), ("m.g", "a/sub/x.html", "HIGH"), ("m.h", "tem.html", "LOW")]
