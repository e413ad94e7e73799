"""From facts to edges: every pass is a join or a cascade of joins with a step number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import settle
from .facts import union

EDGE = ["source", "target", "relationship", "confidence", "path", "line", "reason"]


def edge(df: DataFrame, source, target, relationship, confidence="HIGH", reason="") -> DataFrame:
    """source and target are columns or their names; the others are columns or literals."""
    lit = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    named = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(named(source).alias("source"), named(target).alias("target"), lit(relationship).alias("relationship"), lit(confidence).alias("confidence"), "path", "line", lit(reason).alias("reason"))


def definitions(symbols: DataFrame) -> DataFrame:
    """The module or class that holds a symbol defines it; classes contain their methods."""
    x = symbols.withColumn("line", F.col("start_line"))
    return edge(x, "parent", "canonical_id", F.when(F.col("kind") == "method", "CONTAINS").otherwise("DEFINES"))


def with_modules(imports: DataFrame) -> DataFrame:
    """imports with the absolute module they name and the importing module."""
    here = T.module_of(F.col("path"))
    package = F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), here).otherwise(F.regexp_replace(here, r"(^|\.)[^.]+$", ""))
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - F.col("level") + 1)), ".")
    relative = F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.col("module"), F.lit("")))
    return imports.withColumn("importer", here).withColumn("target_module", F.when(F.coalesce("level", F.lit(0)) > 0, relative).otherwise(F.col("module")))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """HIGH where the module, or the submodule named, is a file of the scan; else external."""
    known = files.select(T.module_of(F.col("path")).alias("m")).distinct()
    x = with_modules(imports).withColumn("sub", F.concat_ws(".", F.nullif(F.col("target_module"), F.lit("")), F.nullif(F.col("name"), F.lit(""))))
    a, b = known.select(F.col("m").alias("sub"), F.lit(1).alias("is_sub")), known.select(F.col("m").alias("target_module"), F.lit(1).alias("is_module"))
    x = x.join(a, "sub", "left").join(b, "target_module", "left")
    target = F.when(F.col("is_sub") == 1, F.col("sub")).otherwise(F.col("target_module"))
    found = (F.coalesce("is_sub", F.lit(0)) + F.coalesce("is_module", F.lit(0))) > 0
    return edge(x.withColumn("t", target), "importer", "t", "IMPORTS", F.when(found, "HIGH").otherwise("LOW"), F.when(found, "").otherwise("external"))


def call_edges(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Callees by a cascade; the first step that finds something decides, several matches are ambiguous.

    1 method of the same class through self, 2 nested in the caller, 3 same module, 4 imported name
    or member of an imported module, 6 the only symbol of that name (MEDIUM). Else UNKNOWN. The numbers
    of calls are written before five branches read them.
    """
    s = symbols.select("canonical_id", "name", "parent", T.module_of(F.col("path")).alias("module"))
    ids = s.select(F.col("canonical_id").alias("target")).distinct()
    c = settle(calls.withColumn("id", F.monotonically_increasing_id())).withColumn("module", T.module_of(F.col("path")))
    head, last = F.regexp_extract("callee", r"^([^.]+)", 1), F.element_at(F.split("callee", r"\."), -1)
    c = c.withColumn("head", head).withColumn("last", last).withColumn("dotted", F.col("callee").contains("."))
    owner = F.regexp_replace("caller", r"\.[^.]+$", "")
    rest = F.regexp_replace("callee", r"^[^.]+\.?", "")
    i = with_modules(imports).select(F.col("importer").alias("module"), F.when(F.col("alias") != "", F.col("alias")).when(F.col("name") != "", F.col("name")).otherwise(F.col("target_module")).alias("head"), F.concat_ws(".", F.nullif("target_module", F.lit("")), F.nullif("name", F.lit(""))).alias("base")).distinct()
    step = lambda df, n, target, why: df.select("id", target.alias("target"), F.lit(n).alias("step"), F.lit(why).alias("why"))
    exact = [
        step(c.where("head in ('self', 'cls', 'this') and dotted"), 1, F.concat_ws(".", owner, "last"), "same class"),
        step(c.where("not dotted"), 2, F.concat_ws(".", "caller", "callee"), "nested"),
        step(c, 3, F.concat_ws(".", "module", "callee"), "same module"),
        step(c.join(i, ["module", "head"]), 4, F.concat_ws(".", "base", F.nullif(rest, F.lit(""))), "imported"),
    ]
    found = union(exact).join(ids, "target", "left_semi").select("id", "target", "step", "why")
    unique = s.groupBy("name").agg(F.count("*").alias("n"), F.min("canonical_id").alias("target")).where("n = 1")
    # the only symbol of a name counts for plain calls; attributes of unknown objects stay unknown
    by_name = c.where("not dotted").join(unique, F.col("last") == F.col("name")).select("id", "target", F.lit(6).alias("step"), F.lit("unique name").alias("why"))
    every = found.select("id", "target", "step", "why").unionByName(by_name)
    best = every.groupBy("id").agg(F.min("step").alias("step"))
    chosen = every.join(best, ["id", "step"]).groupBy("id", "step").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"), F.min("why").alias("why"))
    x = c.join(chosen, "id", "left")
    unknown = F.col("target").isNull()
    label = F.when(unknown, "UNKNOWN").when(F.col("n") > 1, "LOW").when(F.col("step") == 6, "MEDIUM").otherwise("HIGH")
    kind = F.when(unknown, "UNRESOLVED_REFERENCE").when(F.col("n") > 1, "POSSIBLE_CALLS").otherwise("CALLS")
    return edge(x.withColumn("t", F.coalesce("target", "callee")), "caller", "t", kind, label, F.coalesce("why", F.lit("unresolved")))


def inheritance_edges(inheritance: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    calls = inheritance.select("path", F.regexp_replace("child", r"\.[^.]+$", "").alias("caller"), F.col("parent").alias("callee"), "line", "child")
    out = call_edges(calls.drop("child"), symbols.where("kind in ('class', 'interface')"), imports)
    back = inheritance.select("path", "line", F.col("child").alias("c"), F.regexp_replace("child", r"\.[^.]+$", "").alias("source")).distinct()
    return out.join(back, ["path", "line", "source"]).select(F.col("c").alias("source"), "target", F.lit("EXTENDS").alias("relationship"), "confidence", "path", "line", "reason").distinct()


def compose_routes(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Endpoints with the prefixes of the routers that mount theirs; up to three levels of mounts."""
    m = mounts.select(F.element_at(F.split("child", r"\."), -1).alias("child"), F.element_at(F.split("parent", r"\."), -1).alias("parent"), "prefix").distinct()
    x = routes.withColumn("at", F.element_at(F.split("owner", r"\."), -1)).withColumn("full", F.col("route"))
    for _ in range(3):
        up = m.select(F.col("child").alias("at"), F.col("parent").alias("next"), F.col("prefix").alias("_p"))
        x = x.join(up, "at", "left").withColumn("full", F.concat(F.coalesce("_p", F.lit("")), "full")).withColumn("at", F.coalesce("next", F.lit(""))).drop("next", "_p")
    x = x.withColumn("endpoint", F.concat(F.lit("API_ENDPOINT:"), "framework", F.lit(":"), "path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "method", F.lit(" "), "full", F.lit("#"), F.element_at(F.split("handler", r"\."), -1)))
    n = F.row_number().over(W.partitionBy("endpoint").orderBy("full")) - 1
    return x.withColumn("endpoint", F.concat("endpoint", F.when(n > 0, F.concat(F.lit("#m"), n.cast("string"))).otherwise(""))).drop("at")


def route_edges(endpoints: DataFrame) -> DataFrame:
    return edge(endpoints, "endpoint", "handler", "HANDLED_BY")


def query_edges(queries: DataFrame) -> DataFrame:
    sql = F.col("sql")
    table = T.sql_table(sql)
    x = queries.withColumn("t", F.concat(F.lit("db.UNKNOWN.UNKNOWN."), table)).withColumn("c", F.when(table == "UNKNOWN", "UNKNOWN").otherwise("HIGH"))
    return edge(x, "caller", "t", T.sql_relationship(sql), F.col("c"))


def table_edges(tables: DataFrame) -> DataFrame:
    x = tables.where("target <> ''").withColumn("s", F.concat(F.lit("db.UNKNOWN.UNKNOWN."), "table_name", F.lit("."), "column_name"))
    return edge(x, "s", F.concat(F.lit("db.UNKNOWN.UNKNOWN."), "target"), "FOREIGN_KEY_TO")


def queue_edges(queues: DataFrame) -> DataFrame:
    """Producers and consumers of a topic, and each producer's links to its consumers."""
    out = edge(queues, "owner", F.concat(F.lit("queue:"), "name"), F.when(F.col("detail") == "PRODUCER", "PRODUCES_TO_QUEUE").otherwise("CONSUMES_FROM_QUEUE"))
    p = queues.where("detail = 'PRODUCER'")
    c = queues.where("detail = 'CONSUMER'").select("name", F.col("owner").alias("consumer"))
    return out.unionByName(edge(p.join(c, "name"), "owner", "consumer", "STATIC_QUEUE_LINKED", "HIGH", "same topic"))


def test_edges(calls: DataFrame) -> DataFrame:
    """What resolved calls of test files reach."""
    tests = F.col("path").rlike(r"(^|/)(tests?/|test_)")
    return calls.where(tests & (F.col("relationship") == "CALLS")).withColumn("relationship", F.lit("TESTS"))


def resolve_bindings(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """uses (use, scope, name, line) with the binding that holds there.

    The last binding in the scope at or before the line: RESOLVED; POSSIBLE if any binding up to there is
    conditional; UNKNOWN if the name is bound later only, or never.
    """
    b = bindings.select(F.col("scope").alias("bs"), F.col("name").alias("bn"), F.col("line").alias("bl"), "source", "conditional")
    x = uses.join(b, (F.col("scope") == F.col("bs")) & (F.col("name") == F.col("bn")) & (F.col("bl") <= F.col("line")), "left")
    out = x.groupBy("use", "scope", "name", "line").agg(F.max_by("source", "bl").alias("source"), F.max("bl").alias("bound_at"), F.max(F.col("conditional").cast("int")).alias("c"))
    state = F.when(F.col("bound_at").isNull(), "UNKNOWN").when(F.col("c") == 1, "POSSIBLE").otherwise("RESOLVED")
    return out.select("use", "scope", "name", "line", "source", "bound_at", state.alias("state"))


#: each pass: the relationships that it makes, and the facts that it reads
PASSES = {
    "definitions": (("CONTAINS", "DEFINES"), ("symbols",)), "imports": (("IMPORTS",), ("imports",)),
    "calls": (("CALLS", "POSSIBLE_CALLS", "UNRESOLVED_REFERENCE"), ("calls", "symbols", "imports")), "tests": (("TESTS",), ("calls", "symbols", "imports")),
    "inheritance": (("EXTENDS",), ("inheritance", "symbols", "imports")), "routes": (("HANDLED_BY",), ("routes", "mounts")),
    "queries": (("READS_TABLE", "WRITES_TABLE", "DEFINES_TABLE", "UNKNOWN"), ("queries",)), "tables": (("FOREIGN_KEY_TO",), ("tables",)),
    "queues": (("PRODUCES_TO_QUEUE", "CONSUMES_FROM_QUEUE", "STATIC_QUEUE_LINKED"), ("queues",)), "injects": (("INJECTS",), ("injects",)), "env": (("READS_ENV",), ("env",)),
}


def passes(kinds: tuple[str, ...]) -> list[str]:
    """Passes that make edges of the relationships named, or all."""
    return [name for name, (made, _) in PASSES.items() if not kinds or set(made) & set(kinds)]


def facts_for(kinds: tuple[str, ...]) -> list[str]:
    """Kinds of facts that those passes read."""
    return list(dict.fromkeys(f for name in passes(kinds) for f in PASSES[name][1]))


def all_edges(files: DataFrame, facts: dict[str, DataFrame], kinds: tuple[str, ...] = ()) -> DataFrame:
    """Every pass over the facts of one generation, or those that the relationships named need."""
    due = passes(kinds)
    if "calls" in due or "tests" in due:
        calls = call_edges(facts["calls"], facts["symbols"], facts["imports"])
        calls = settle(calls) if "calls" in due and "tests" in due else calls  # both read them
    make = {
        "definitions": lambda: definitions(facts["symbols"]), "imports": lambda: import_edges(facts["imports"], files), "calls": lambda: calls, "tests": lambda: test_edges(calls),
        "inheritance": lambda: inheritance_edges(facts["inheritance"], facts["symbols"], facts["imports"]), "routes": lambda: route_edges(compose_routes(facts["routes"], facts["mounts"])),
        "queries": lambda: query_edges(facts["queries"]), "tables": lambda: table_edges(facts["tables"]), "queues": lambda: queue_edges(facts["queues"]),
        "injects": lambda: edge(facts["injects"], "owner", "name", "INJECTS"), "env": lambda: edge(facts["env"], "owner", F.concat(F.lit("env:"), "name"), "READS_ENV"),
    }
    out = reduce(DataFrame.unionByName, [make[name]() for name in due]).select(EDGE)
    return out.where(F.col("relationship").isin(*kinds)) if kinds else out
