import pytest
from pyspark.sql import functions as F

from factloom.operators import interrogate as Q

EDGES = [
    ("API_ENDPOINT:1", "r.create", "HANDLED_BY"), ("r.create", "s.place", "CALLS"), ("s.place", "s.save", "CALLS"), ("s.place", "queue:orders", "PRODUCES_TO_QUEUE"), ("w.work", "queue:orders", "CONSUMES_FROM_QUEUE"),
    ("w.work", "w.store", "CALLS"), ("w.store", "db.x.y.audit", "WRITES_TABLE"), ("s.save", "db.x.y.orders", "WRITES_TABLE"), ("t.test_place", "s.place", "TESTS"), ("s.Big", "s.Base", "EXTENDS"),
    ("db.x.y.items.order_id", "db.x.y.orders.id", "FOREIGN_KEY_TO"), ("web.cart.a", "lib.core.b", "IMPORTS"), ("web.cart.c", "lib.core.b", "IMPORTS"), ("web.x", "web.y", "IMPORTS"),
]
SYMBOLS = [("s.py", "place", "s.place", "s"), ("s.py", "save", "s.save", "s"), ("s.py", "Big", "s.Big", "s"), ("s.py", "go", "s.Big.go", "s.Big"), ("r.py", "create", "r.create", "r"), ("w.py", "save", "w.save", "w")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*e, "HIGH", "s.py", i, "h1") for i, e in enumerate(EDGES)], "source string, target string, relationship string, confidence string, path string, line int, source_hash string").cache()


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(p, n, q, q, o, i) for i, (p, n, q, o) in enumerate(SYMBOLS)], "path string, name string, qualified_name string, canonical_id string, parent string, start_line int").cache()


def names(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_symbols(spark, edges, symbols):
    r = Q.symbol_profile(symbols, edges, "s.place").first()
    assert (r.name, r.callers, r.callees, r.children) == ("place", 1, 1, [])
    assert Q.symbol_profile(symbols, edges, "s.Big").first().children == ["go"]
    assert names(Q.implementations(edges, "s.Base"), "source") == [("s.Big",)]
    stale = spark.createDataFrame([("s.py", "h2")], "path string, hash string")
    assert {r.confidence for r in Q.references(edges, stale, "s.place").collect()} == {"LOW"}
    assert {r.confidence for r in Q.references(edges, stale.withColumn("hash", F.lit("h1")), "place").collect()} == {"HIGH"}
    assert [r.term for r in Q.expand_terms(["place", "get", "absent"], symbols).collect()] == ["s.place", "place", "get", "absent"]


def test_flows(edges):
    assert names(Q.trace_call(edges, "s.place"), "direction", "node") == [("callee", "s.save"), ("caller", "r.create")]
    flow = [(r.kind, r.node) for r in Q.async_flow(edges, "API_ENDPOINT:1").orderBy("step").collect()]
    assert flow == [("entry", "API_ENDPOINT:1"), ("producer", "s.place"), ("queue", "queue:orders"), ("consumer", "w.work"), ("table", "db.x.y.audit")]
    impact = names(Q.db_impact(edges, "orders"), "bucket", "node")
    assert impact == [("FOREIGN_KEYS", "db.x.y.items.order_id"), ("TESTS", "t.test_place"), ("WRITERS", "s.save"), ("WRITERS_CALLERS", "r.create"), ("WRITERS_CALLERS", "s.place"), ("WRITERS_ROUTES", "API_ENDPOINT:1")]


def test_packages_and_changes(spark, edges, symbols):
    p = spark.createDataFrame([("web", "web"), ("cart", "web/cart"), ("core", "lib/core")], "name string, root string")
    assert names(Q.package_edges(edges, p), "package", "depends_on", "imports") == [("cart", "core", 2)]
    changed = spark.createDataFrame([("s.py",)], "path string")
    assert ("TEST", "t.test_place") in names(Q.change_impact(changed, symbols, edges), "bucket", "name") and ("CALLER", "r.create") in names(Q.change_impact(changed, symbols, edges), "bucket", "name")
    t = spark.createDataFrame([("tests/a.py",), ("tests/b.py",)], "path string")
    assert Q.test_command(t).first().command == "python -m pytest tests/a.py tests/b.py"
    o = spark.createDataFrame([("save", "shop.Orders"), ("place", "ghost")], "handler string, table string")
    tables = spark.createDataFrame([("orders",)], "table_name string")
    assert names(Q.resolve_runtime(o, symbols, tables), "symbol_id", "table_id") == [("s.place", "db.UNKNOWN.UNKNOWN.ghost"), ("save", "db.UNKNOWN.UNKNOWN.orders")]


def test_files_and_routes(spark):
    f = spark.createDataFrame([("a.py", "1\n2\n3\n4", None), ("web/package.json", None, b'{"name":"shop","dependencies":{"express":"1"}}')], "path string, text string, content binary")
    assert names(Q.file_slice(f, "a.py", 2, 3), "line", "text", "truncated") == [(2, "2", True), (3, "3", True)]
    assert names(Q.manifests(f), "name", "root", "kind") == [("shop", "web", "SERVICE")]
    c = spark.createDataFrame([(1, "get", "/api/v1/orders/7"), (2, "DELETE", "/orders/7"), (3, "GET", "/nope")], "call int, method string, url string")
    e = spark.createDataFrame([("GET", "/orders/{id}"), ("POST", "/orders/{id}")], "method string, full string")
    assert names(Q.contract_drift(c, e), "call", "issue", "accepted") == [(2, "HTTP_METHOD_MISMATCH", "GET,POST"), (3, "ORPHANED_CLIENT_ROUTE", "")]
    rows = spark.createDataFrame([("a.b.c", "x/y"), ("a.bc", "x/yz"), ("d", "v/x")], "symbol string, path string")
    assert names(Q.constrained(rows, ["b"], ["y"]), "symbol") == [("a.bc",), ("d",)]
    p = spark.createDataFrame([("app/(shop)/cart/[id]/page.tsx",), ("pages/index.js",), ("app/docs/[...slug]/page.ts",)], "p string")
    assert [r[0] for r in p.select(Q.page_route(F.col("p"))).collect()] == ["/cart/{id}", "/", "/docs/{slug}"]
    i = spark.createDataFrame([("a.ts", "@app/x"), ("a.ts", "@app/lib/y"), ("a.ts", "react")], "path string, module string")
    a = spark.createDataFrame([("@app/", "src/"), ("@app/lib/", "lib/")], "alias string, target string")
    assert names(Q.alias_paths(i, a), "resolved") == [("lib/y",), ("react",), ("src/x",)]
