from factloom.operators import extract as E
from factloom.operators import frameworks as Q

CODE = {
    "app/main.py": "from pydantic import BaseModel, Field\nfrom lib import util as u\nclass Item(BaseModel):\n    id: int\n    name: str = Field(..., max_length=20)\n    note: str | None = None\n@app.post('/items')\ndef create(item: Item, db=Depends(get_db)):\n    return templates.TemplateResponse('item.html', {})\ndef get_db() -> Session:\n    return 1\ndef get_other() -> Session:\n    return 2\ndef get_user() -> User:\n    pass\n@celery.task('send')\ndef send_mail(): pass\n@receiver(saved)\ndef on_saved(): pass\nhandlers = {'a': create}\nhandlers = {'b': send_mail, 'c': on_saved}\ndef go(k):\n    return handlers[k](1)\n",
    "lib/util.py": "def helper(): pass\n",
}


def names(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_frameworks(spark):
    facts = E.parse(spark.createDataFrame([(p, t, "python") for p, t in CODE.items()], "path string, text string, language string")).cache()
    f = lambda k: E.fact(facts, k)
    symbols = f("symbols")
    assert names(f("fields"), "field", "data_type", "required", "max_length") == [("id", "int", True, None), ("name", "str", True, 20), ("note", "str", False, None)]
    assert names(Q.input_fields(f("routes"), symbols, f("fields")), "handler", "field") == [("app.main.create", "id"), ("app.main.create", "name"), ("app.main.create", "note")]
    assert names(Q.handler_edges(symbols), "source", "target") == [("event_listener:saved", "app.main.on_saved"), ("task_handler:send", "app.main.send_mail")]
    t = spark.createDataFrame([("web/item.html",)], "path string")
    assert names(Q.template_edges(f("calls"), t), "source", "target", "confidence") == [("app.main.create", "web/item.html", "HIGH")]
    p = names(Q.provider_edges(symbols, f("injects")), "source", "target", "confidence")
    assert ("app.main.get_user", "type:User", "HIGH") in p and ("app.main.get_db", "type:Session", "LOW") in p and ("app.main.create", "app.main.get_db", "HIGH") in p
    r = names(Q.registry_edges(f("bindings"), f("calls")), "source", "target", "relationship")
    assert ("app.main.handlers", "send_mail", "REGISTERS") in r and ("app.main.handlers", "create", "REGISTERS") not in r and ("app.main.go", "on_saved", "DISPATCHES_TO") in r
    d = names(Q.diagnose("u.helper", "app.main", symbols, f("imports")), "step", "tried", "found")
    assert (3, "lib.util.helper", True) in d and (1, "u.helper", False) in d


def test_small_ones(spark):
    assert Q.split_arguments("a, f(b, c), 'x, y', {k: [1, 2]}, \"q\\\",\"") == ["a", "f(b, c)", "'x, y'", "{k: [1, 2]}", '"q\\","']
    assert spark.range(1).select(Q.split_arguments_column(Q.F.lit("a, b"))).first()[0] == ["a", "b"]
    i = spark.createDataFrame([("a", "@s/ui/button"), ("a", "core"), ("a", "react")], "path string, module string")
    p = spark.createDataFrame([("@s/ui", "ui"), ("core", "c1"), ("core", "c2")], "name string, root string")
    assert names(Q.resolve_package(i, p), "module", "status") == [("@s/ui/button", "RESOLVED"), ("core", "AMBIGUOUS"), ("react", "EXTERNAL")]
    s = "canonical_id string, path string, body_hash string"
    base, head = spark.createDataFrame([("m.a", "m.py", "1"), ("m.b", "m.py", "1"), ("n.c", "n.py", "1")], s), spark.createDataFrame([("m.a", "m.py", "2"), ("n.c", "n.py", "1"), ("k.d", "k.py", "1")], s)
    assert names(Q.architecture(base, head), "module", "added", "removed", "modified") == [("k", ["k.d"], [], []), ("m", [], ["m.b"], ["m.a"])]
    e = spark.createDataFrame([("m.a", "n.c")], "source string, target string")
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert names(Q.diagnose_misses(n("m.a", "m.b", "z"), n("q"), base, e), "name", "cause") == [("m.a", "RANKED_OUT"), ("m.b", "NO_EDGES"), ("q", "UNEXPECTED"), ("z", "NOT_INDEXED")]
