from factloom.operators import database as D
from factloom.operators import lookup as L

EDGES = [
    ("API:1", "r.create", "HANDLED_BY", "HIGH"), ("r.create", "s.place", "CALLS", "HIGH"), ("s.place", "s.save", "CALLS", "MEDIUM"), ("s.place", "s.guess", "CALLS", "LOW"), ("s.save", "s.place", "CALLS", "HIGH"),
    ("s.save", "db.x.y.orders", "WRITES_TABLE", "HIGH"), ("s.place", "db.x.y.orders", "READS_TABLE", "HIGH"), ("s.place", "db.x.y.users", "READS_TABLE", "UNKNOWN"), ("s.guess", "db.x.y.audit", "WRITES_TABLE", "HIGH"),
]


def edges(spark):
    return spark.createDataFrame(EDGES, "source string, target string, relationship string, confidence string")


def test_route_lineage(spark):
    got = {(r.endpoint, r.table): (r.kinds, r.chain, r.evidence_class) for r in D.route_lineage(edges(spark)).collect()}
    assert got == {
        ("API:1", "orders"): (["WRITES_TABLE"], "API:1>r.create>s.place>orders", "AST_VERIFIED"),
        ("API:1", "users"): (["READS_TABLE"], "API:1>r.create>s.place>users", "UNKNOWN"),
    }


def test_accessors(spark):
    got = {r.node: (r.distance, r.chain) for r in D.accessors(edges(spark), "orders", D.WRITES).collect()}
    assert got["s.save"] == (1, "s.save>orders") and got["API:1"] == (4, "API:1>r.create>s.place>s.save>orders")


def test_schema_drift(spark):
    fields = spark.createDataFrame([("orders", "Id", "int", True, None), ("orders", "note", "str", False, 500), ("orders", "total", "str", True, None), ("orders", "ghost", "str", True, None), ("orders", "code", "str", False, None)], "table_name string, field string, data_type string, required boolean, max_length int")
    columns = spark.createDataFrame([("orders", "id", "bigint", False, False, None), ("orders", "note", "varchar(100)", True, False, 100), ("orders", "total", "numeric", False, False, None), ("orders", "owner", "int", False, False, None), ("orders", "made", "timestamp", False, True, None), ("orders", "code", "text", False, False, None), ("other", "x", "int", False, False, None)], "table_name string, column_name string, data_type string, nullable boolean, has_default boolean, length int")
    got = {(r.name, r.issue) for r in D.schema_drift(fields, columns).collect()}
    assert got == {("note", "LENGTH_DRIFT"), ("total", "TYPE_INCOMPATIBILITY"), ("ghost", "UNKNOWN_COLUMN"), ("owner", "MISSING_REQUIRED_FIELD"), ("made", "UNUSED_COLUMN"), ("code", "NULLABILITY_DRIFT")}


def test_label_guard_fails_closed(spark):
    e = L.evidence_class(edges(spark), ("HANDLED_BY",))
    allowed = e.select("relationship", "evidence_class").distinct()
    assert L.enforce(e, allowed).count() == len(EDGES)
    try:
        L.enforce(e, allowed.where("relationship <> 'CALLS'")).collect()
    except Exception as x:  # noqa: BLE001
        assert "not allowed: CALLS" in str(x)
    else:
        raise AssertionError("a pair that is not allowed went through")
