import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract as E
from factloom.operators import resolve as R
from factloom.sources import scan, telemetry

FILES = {
    "app/models.py": "from sqlalchemy import Column, Integer, String, ForeignKey\nclass Base: pass\nclass Order(Base):\n    __tablename__ = 'orders'\n    id = Column(Integer, primary_key=True)\n    user_id = Column(Integer, ForeignKey('users.id'), nullable=False)\n    note = Column(String)\n",
    "app/service.py": "import os\nfrom .models import Order\ndef helper(x):\n    return x\ndef checkout(db, items):\n    '''Places an order.'''\n    key = os.getenv('API_URL')\n    db.execute('INSERT INTO orders (id) VALUES (1)')\n    producer.send('orders.created', items)\n    return helper(items)\nclass Service:\n    def run(self):\n        return self.step()\n    def step(self):\n        return Order()\n",
    "app/routes.py": "from fastapi import APIRouter, Depends\nfrom app import service\nfrom app.service import checkout as place\nrouter = APIRouter()\n@router.post('/orders/{id}')\ndef create(id: int, db=Depends(get_db)):\n    return place(db, id)\n@consumer('orders.created')\ndef on_created(m):\n    if m:\n        x = 1\n    return service.helper(m)\napp.include_router(router, prefix='/api/v1')\n",
    "tests/test_service.py": "from app.service import checkout\ndef test_checkout():\n    assert checkout(None, 1)\n",
    "app/broken.py": "import json\ndef f(:\n",
    "app/old.py": "def g():\n    try:\n        pass\n    except A, B:\n        pass\n",
    "web/client.ts": "import { api } from './api'\nexport class Cart extends Base {\n  total() { return sum(this.items) }\n}\nexport const load = async (id) => {\n  return fetch('/api/v1/orders/1', { method: 'POST' })\n}\n",
    "db/schema.sql": "CREATE TABLE users (id int primary key, email text not null, org_id int references orgs(id));\nSELECT * FROM users;",
    "web/page.html": "<script src='/a.js'></script><form action='/go'></form>{% block body %}",
    "game/main.luau": "local S = game:GetService('Players')\nfunction M:join(player, x)\nend\nlocal u = require(script.Parent.Util)\n",
    ".env": "TOKEN=1", "node_modules/x.js": "var x", "app/skip_me.py": "x = 1", "notes.txt": "hello",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "app/data.py").write_bytes(b"x\x00y")
    return scan.scan(spark, str(root), ignore=["skip_me*"]).cache()


@pytest.fixture(scope="module")
def facts(files):
    return E.parse(files).cache()


def test_scan(files):
    why = {r.path: (r.skipped, r.language, r.category) for r in files.collect()}
    assert why[".env"][0] == "sensitive" and why["node_modules/x.js"][0] == "ignored_folder" and why["app/skip_me.py"][0] == "ignored_pattern"
    assert why["notes.txt"][0] == "unknown_language" and why["app/data.py"][0] == "binary"
    assert why["app/service.py"] == (None, "python", "SOURCE") and why["tests/test_service.py"][2] == "TEST"
    assert {r.reason: r.n for r in scan.skip_counts(files).collect()}["read"] == 10


def test_facts(facts):
    s = {r.canonical_id: r for r in E.fact(facts, "symbols").collect()}
    assert s["app.service.checkout"].parameter_count == 2 and s["app.service.checkout"].documentation == "Places an order."
    assert s["app.service.Service.run"].kind == "method" and s["web.client.Cart"].kind == "class" and "app.old.g" in s and "game.main.M.join" in s
    t = {(r.table_name, r.column_name): r for r in E.fact(facts, "tables").collect()}
    assert t["orders", "user_id"].target == "users.id" and not t["orders", "user_id"].nullable and t["orders", "id"].primary_key and t["users", "org_id"].target == "orgs.id"
    assert {(r.name, r.detail) for r in E.fact(facts, "fetches").collect()} == {("/api/v1/orders/1", "POST")}
    assert [r.detail for r in E.fact(facts, "assets").orderBy("detail").collect()] == ["block", "form", "script"]
    assert facts.where("fact = 'files' and detail = 'parse_failed'").count() == 1


def test_edges(files, facts):
    kinds = ("calls", "symbols", "imports", "inheritance", "routes", "mounts", "queries", "tables", "queues", "injects", "env")
    edges = {(r.source, r.target, r.relationship): r.confidence for r in R.all_edges(files.where("skipped is null"), {k: E.fact(facts, k) for k in kinds}).collect()}
    want = [
        ("app.service.checkout", "app.service.helper", "CALLS"), ("app.service.Service.run", "app.service.Service.step", "CALLS"), ("app.service.Service.step", "app.models.Order", "CALLS"),
        ("app.routes.create", "app.service.checkout", "CALLS"), ("app.routes.on_created", "app.service.helper", "CALLS"), ("tests.test_service.test_checkout", "app.service.checkout", "TESTS"),
        ("app.models.Order", "app.models.Base", "EXTENDS"), ("app.service.checkout", "db.UNKNOWN.UNKNOWN.orders", "WRITES_TABLE"), ("app.service.checkout", "app.routes.on_created", "STATIC_QUEUE_LINKED"),
        ("app.service", "app.models", "IMPORTS"), ("app.routes", "app.service", "IMPORTS"), ("app.routes.create", "get_db", "INJECTS"), ("app.service.checkout", "env:API_URL", "READS_ENV"),
        ("API_ENDPOINT:fastapi:app/routes.py:5:POST /api/v1/orders/{id}#create", "app.routes.create", "HANDLED_BY"), ("db.UNKNOWN.UNKNOWN.orders.user_id", "db.UNKNOWN.UNKNOWN.users.id", "FOREIGN_KEY_TO"),
    ]
    assert [w for w in want if w not in edges] == []
    assert edges[want[0]] == "HIGH" and edges["app.service.checkout", "db.execute", "UNRESOLVED_REFERENCE"] == "UNKNOWN"


def test_bindings(spark):
    b = spark.createDataFrame([("f", "x", 1, "a", False), ("f", "x", 3, "b", False), ("f", "y", 2, "c", True), ("f", "z", 9, "d", False)], "scope string, name string, line int, source string, conditional boolean")
    u = spark.createDataFrame([(1, "f", "x", 2), (2, "f", "x", 5), (3, "f", "y", 4), (4, "f", "z", 4)], "use int, scope string, name string, line int")
    assert {r.use: (r.source, r.state) for r in R.resolve_bindings(u, b).collect()} == {1: ("a", "RESOLVED"), 2: ("b", "RESOLVED"), 3: ("c", "POSSIBLE"), 4: (None, "UNKNOWN")}


def test_telemetry(spark):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    span = {"traceId": "t", "spanId": "s", "name": "q", "kind": 4, "startTimeUnixNano": "1000000", "endTimeUnixNano": 3000000, "attributes": [attr("db.statement", "select * from a.b where id = 7"), attr("http.request.header.authorization", "x")]}
    doc = json.dumps({"resourceSpans": [{"resource": {"attributes": [attr("service.name", "shop")]}, "scopeSpans": [{"spans": [span, span]}]}]})
    (r,) = telemetry.otel_spans(spark.createDataFrame([(doc,)], "value string")).collect()
    assert (r.service, r.kind, r.duration_ms, r.sql) == ("shop", "PRODUCER", 2.0, "select * from a.b where id = ?") and len(r.attributes) == 1
    lines = spark.createDataFrame([('{"traceId":"t","verb":"GET","query":"update x.stock set n = 1","elapsed_ms":"2.5"}',), ("bad",)], "value string")
    (e,) = telemetry.json_events(lines).where("trace_id <> ''").collect()
    assert (e.trace_id, e.http_method, e.table, e.relationship, e.duration_ms) == ("t", "GET", "stock", "WRITES_TABLE", 2.5)
    (g,) = telemetry.sql_log(spark.createDataFrame([("trace_id=t1 caller=f duration_ms=3 SELECT * FROM s.users WHERE id = 3",), ("noise",)], "value string")).collect()
    assert (g.trace_id, g.caller, g.table, g.sql) == ("t1", "f", "users", "SELECT * FROM s.users WHERE id = ?")


def test_plain_texts_are_those_of_unparse():
    import ast

    lines = ["a", "a.b.c", "f(x, 'it\\'s', k=[1], *a, **b)", "f(x)(y).z", "(a + b).c", "t['a'](m)", "t[1, 2]", "t[1:2]", "{'a': b, **c}", "{}", "{'a': f(x)}", "u'x'", "1.5", "-1", "(1).real", "'\\n\\u00e9'", "None", "...", "b'x'", "lambda: 0", "f(x for x in y)", "f((yield))", "(x, y)", "a if b else c", "f(a := 1)", "f'{x}'", "f(*a)", "t[u'x']", "t[()]"]
    for x in lines:
        node = ast.parse(x).body[0].value
        assert E.text_of(node) == ast.unparse(node), x
    for x in ["", "a", "a, b=1", "a: int, b: List[str]=f(x)", "a, /, b", "*a, b=1", "a, **k", "a: 'x' = -1", "self, n: Optional[int]=None"]:
        node = ast.parse(f"def f({x}): pass").body[0].args
        assert E.text_of(node) == ast.unparse(node), x


def test_only_kinds_asked_for():
    from factloom.plans import corpus

    text = corpus.MODULE.format(k=3, b=2, s=5, t=0)
    every = E.python_facts("shop/part_3.py", text)
    for kinds in [(k,) for k in E.KINDS["python"]] + [("tables", "env"), ("queues", "calls"), ("routes", "mounts", "injects")]:
        assert sorted(map(str, (r for r in E.python_facts("shop/part_3.py", text, kinds) if r[0] in kinds))) == sorted(map(str, (r for r in every if r[0] in kinds)))
    assert E.python_facts("a.py", "def f(n=\uff24epends(g)): pass\n", ("injects",))  # another writing of a name


def test_only_passes_asked_for(spark):
    """Edges of one relationship need no facts of the others, and are the same as among all."""
    from factloom.operators import resolve as R
    from factloom.plans import corpus

    every, _ = corpus.edges(spark, "/root/testdata/sf0.001")
    rows = sorted(map(str, every.collect()))
    for kinds in [("READS_ENV", "INJECTS"), ("TESTS",), ("CALLS", "TESTS", "HANDLED_BY")]:
        some, found = corpus.edges(spark, "/root/testdata/sf0.001", *kinds)
        assert sorted(map(str, some.collect())) == [r for r in rows if any(f"relationship='{k}'" in r for k in kinds)]
        assert list(found) == R.facts_for(kinds)
    assert R.facts_for(("FOREIGN_KEY_TO",)) == ["tables"]


def test_files_are_parsed_by_many_tasks(spark):
    """The rows of parts are one split of one file."""
    from pyspark.sql import functions as F

    from factloom.plans import corpus

    modules = corpus.files(spark, "/root/testdata/sf0.001").where("path like 'shop/part%'")
    assert modules.groupBy(F.spark_partition_id()).count().count() == 4
