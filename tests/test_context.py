import subprocess

import pytest
from factloom.operators import context as C


def test_plan():
    p = C.build_plan("Fix the crash in checkout_order of app/service.py behind /api/orders and OrderItem")
    assert (p.intent, p.paths, p.routes, p.names) == ("DEBUG", ["app/service.py"], ["/api/orders"], ["checkout_order", "OrderItem"])
    assert p.digest == C.build_plan(p.prompt).digest != C.build_plan("Explain it").digest


def test_context(spark):
    symbols = spark.createDataFrame([("s.place", "place_order", "s.py", "SOURCE"), ("s.save", "save", "s.py", "SOURCE"), ("r.create", "create", "r.py", "SOURCE"), ("t.t1", "t1", "t.py", "TEST"), ("v.place", "place_order", "v.py", "VENDOR")], "canonical_id string, name string, path string, category string")
    edges = spark.createDataFrame([("s.place", "s.save", "CALLS", "HIGH"), ("r.create", "s.place", "CALLS", "HIGH"), ("t.t1", "s.place", "TESTS", "HIGH"), ("x", "s.place", "CALLS", "LOW")], "source string, target string, relationship string, confidence string")
    chunks = spark.createDataFrame([("s.place", "x" * 400), ("s.save", "y" * 4000), ("r.create", "z" * 80)], "symbol string, content string")
    plan = C.build_plan("fix bug in place_order", budget=130)
    got = {r.symbol: (r.layer, r.accepted, r.reason) for r in C.get_context(plan, symbols, edges, chunks).collect()}
    assert got["s.place"] == ("TARGET", True, "COVERAGE") and got["r.create"] == ("CALLER", True, "COVERAGE") and got["t.t1"] == ("TEST", True, "COVERAGE")
    assert got["s.save"] == ("CALLEE", False, "TOKEN_LIMIT") and "v.place" not in got and "x" not in got
    r = C.trust(C.get_context(plan, symbols, edges, chunks), edges, ["r.create"]).first()
    assert (r.supported, r.unsupported, r.excluded) == (3, 0, 1)


def test_small_ones(spark, tmp_path):
    q = spark.createDataFrame([("a", 2.0, False), ("a", 0.5, True), ("b", 1.0, False)], "class string, latency_ms double, cached boolean")
    assert sorted(map(tuple, C.session_summary(q).collect()), key=str) == [("a", 2, 1, 2000, 500), ("b", 1, 0, 1000, None)]
    t = spark.createDataFrame([("ok", 1), ("see postgres://u:p@h", 2), ("seed-1 here", 3)], "a string, n int")
    assert [tuple(r) for r in C.audit_secrets({"t": t}, ["seed-1"]).collect()] == [("t", 2)]
    o = spark.createDataFrame([("1", "/a", "f", "x"), ("1", "", "g", "y"), ("2", "/b", "f", "z")], "trace_id string, route string, handler string, table string")
    assert C.trace_of(o, route="/A").count() == 2 and C.exists_anywhere("g", (t, "a"), (o, "handler"))
    for a in (["init", "-q"], ["-c", "user.name=n", "-c", "user.email=e", "commit", "-q", "--allow-empty", "-m", "first"]):
        subprocess.run(["git", "-C", str(tmp_path), *a], check=True)
    (r,) = C.git_log(spark, str(tmp_path)).collect()
    assert r.subject == "first" and C.git_state(str(tmp_path), r.commit) == "CLEAN" and C.git_state(str(tmp_path), "x") == "STALE"


def test_task_or_query():
    from factloom.operators import context as C

    plan = C.build_plan("fix a_b")
    assert C.task_or_query(" x ", None) == "x" and C.task_or_query("", "y") == "y" and C.task_or_query("same", " same ") == "same"
    assert C.task_or_query("fix a_b", plan) is plan and C.task_or_query(plan, "fix a_b") is plan
    assert C.task_or_query({"goal": "g"}, "g") == {"goal": "g"} and C.task_or_query({"depth": 2}, "g") == {"depth": 2, "raw_prompt": "g"}
    for bad in (("", None), ("x", "y"), ({}, " "), (plan, "other")):
        with pytest.raises(ValueError):
            C.task_or_query(*bad)


def test_git_head(tmp_path):
    from factloom.operators import context as C

    assert C.git_head(str(tmp_path)) == (None, None)
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/work/a\n")
    assert C.git_head(str(tmp_path)) == (None, "work/a")
    (git / "packed-refs").write_text(f"# pack-refs\n{'1' * 40} refs/heads/work/a\n^{'3' * 40}\n")
    assert C.git_head(str(tmp_path)) == ("1" * 40, "work/a")
    (git / "refs/heads/work").mkdir()
    (git / "refs/heads/work/a").write_text("2" * 40 + "\n")
    assert C.git_head(str(tmp_path)) == ("2" * 40, "work/a")
    (git / "HEAD").write_text("4" * 40)
    assert C.git_head(str(tmp_path)) == ("4" * 40, None)
