"""Questions about code facts: symbols, files, routes, references, flows, packages and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import facts as O
from . import graph as G


def get_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """By canonical id or qualified name, in order of path and line."""
    return symbols.where((F.col("canonical_id") == name) | (F.col("qualified_name") == name)).orderBy("path", "start_line")


def symbol_profile(symbols: DataFrame, edges: DataFrame, canonical_id: str) -> DataFrame:
    """The symbol with its children and the numbers of its callers and callees."""
    calls = edges.where("relationship = 'CALLS'")
    count = lambda near, far, name: calls.where(F.col(near) == canonical_id).agg(F.countDistinct(far).alias(name))
    children = symbols.where(F.col("parent") == canonical_id).agg(F.array_sort(F.collect_set("name")).alias("children"))
    one = get_symbol(symbols, canonical_id).limit(1)
    for extra in (children, count("target", "source", "callers"), count("source", "target", "callees")):
        one = one.join(F.broadcast(extra), F.lit(True))
    return one


def file_slice(files: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = 200) -> DataFrame:
    """line, text of a bounded slice, with the file's length and whether more follows."""
    x = files.where(F.col("path") == path).select(T.lines(F.col("text")).alias("l"))
    last = min(end or start + most - 1, start + most - 1)
    each = x.select(F.size("l").alias("total"), F.posexplode("l").alias("i", "text")).where(F.col("i").between(start - 1, last - 1))
    return each.select((F.col("i") + 1).alias("line"), "text", "total", (F.col("total") > last).alias("truncated"))


def imports_of(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("path") == path).orderBy("line", "module", "name")


def list_routes(endpoints: DataFrame, framework: str | None = None, method: str | None = None, part: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    x = endpoints
    for column, value in (("framework", framework), ("method", method)):
        x = x if value is None else x.where(F.lower(column) == value.lower())
    x = x if part is None else x.where(F.lower("full").contains(part.lower()))
    return O.page(x, ["full", "method", "endpoint"], offset, limit)


def constrained(rows: DataFrame, symbols: list[str], paths: list[str], symbol: str = "symbol", path: str = "path") -> DataFrame:
    """Rows without excluded symbols (as whole dotted components in order) or paths (as whole components)."""
    inside = lambda column, sep, names: reduce(lambda a, b: a | b, (F.concat(F.lit(sep), F.regexp_replace(column, "[.:/]", sep), F.lit(sep)).contains(sep + n.replace(".", sep).replace(":", sep).replace("/", sep).strip(sep) + sep) for n in names), F.lit(False))
    return rows.where(~inside(symbol, "\x1f", symbols) & ~inside(path, "\x1e", paths))


def test_frameworks(imports: DataFrame) -> DataFrame:
    """Frameworks by what is imported."""
    known = {"pytest": "pytest", "unittest": "unittest", "vitest": "vitest", "@jest/globals": "jest", "@playwright/test": "playwright", "mocha": "mocha"}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    found = F.coalesce(F.try_element_at(table, F.col("module")), F.try_element_at(table, F.regexp_extract("module", r"^([^./]+)", 1)))
    return imports.withColumn("framework", found).where("framework is not null").groupBy("framework").agg(F.countDistinct("path").alias("files"))


def references(edges: DataFrame, files: DataFrame, canonical_id: str) -> DataFrame:
    """Edges into an id or into a longer name that ends in it; HIGH first; stale evidence counts as LOW.

    edges carry source_hash, files their present hash.
    """
    hit = (F.col("target") == canonical_id) | F.col("target").endswith("." + canonical_id)
    now = files.select("path", F.col("hash").alias("_now"))
    x = edges.where(hit).join(now, "path", "left")
    fresh = F.col("_now").isNull() | (F.col("_now") == F.col("source_hash"))
    x = x.withColumn("confidence", F.when(fresh, F.col("confidence")).otherwise("LOW")).drop("_now")
    return x.orderBy(F.when(F.col("confidence") == "HIGH", 0).otherwise(1), "path", "line", "source")


def implementations(edges: DataFrame, canonical_id: str) -> DataFrame:
    return edges.where(F.col("relationship").isin("EXTENDS", "IMPLEMENTS") & (F.col("target") == canonical_id)).orderBy("path", "line")


def trace_call(edges: DataFrame, canonical_id: str, depth: int = 2) -> DataFrame:
    """direction, node, depth: callers and callees up to depth, and the routes the symbol handles."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(canonical_id, canonical_id)], "seed string, node string")
    calls = edges.where("relationship = 'CALLS' and confidence in ('HIGH', 'MEDIUM')")
    walk = lambda back, name: G.bfs(calls, seed, depth, reverse=back).where("depth > 0").select(F.lit(name).alias("direction"), "node", "depth")
    routes = edges.where((F.col("relationship") == "HANDLED_BY") & (F.col("target") == canonical_id)).select(F.lit("route").alias("direction"), F.col("source").alias("node"), F.lit(0).alias("depth"))
    return O.union([walk(True, "caller"), walk(False, "callee"), routes])


def async_flow(edges: DataFrame, entry: str, depth: int = 3) -> DataFrame:
    """step, kind, node: from an entry through producers, queues and consumers to tables."""
    spark = edges.sparkSession
    calls = edges.where("relationship in ('CALLS', 'HANDLED_BY')")
    start = spark.createDataFrame([("a", entry)], "seed string, node string")
    reached = G.bfs(calls, start, depth)
    hop = lambda nodes, rel: nodes.join(edges.where(F.col("relationship") == rel).select(F.col("source").alias("node"), F.col("target").alias("next")), "node")
    produced = hop(reached, "PRODUCES_TO_QUEUE").select("node", F.col("next").alias("queue"))
    consumers = produced.join(edges.where("relationship = 'CONSUMES_FROM_QUEUE'").select(F.col("target").alias("queue"), F.col("source").alias("consumer")), "queue")
    after = G.bfs(calls, consumers.select(F.lit("b").alias("seed"), F.col("consumer").alias("node")).distinct(), depth)
    tables = after.join(edges.where("relationship in ('READS_TABLE', 'WRITES_TABLE')").select(F.col("source").alias("node"), F.col("target").alias("table")), "node")
    kinds = [(spark.createDataFrame([(entry,)], "node string"), "entry"), (produced.select("node"), "producer"), (produced.select(F.col("queue").alias("node")), "queue"), (consumers.select(F.col("consumer").alias("node")), "consumer"), (tables.select(F.col("table").alias("node")), "table")]
    every = O.union([df.distinct().select(F.lit(i).alias("stage"), F.lit(kind).alias("kind"), "node") for i, (df, kind) in enumerate(kinds)])
    return every.select(F.row_number().over(W.orderBy("stage", "node")).alias("step"), "kind", "node")


def db_impact(edges: DataFrame, table: str, depth: int = 4) -> DataFrame:
    """bucket, node, distance: readers, writers and their callers, endpoints, tests, and tables that refer to it."""
    from .database import READS, WRITES, accessors

    label = lambda df, name: df.select(F.lit(name).alias("bucket"), "node", "distance")
    parts = []
    for name, kinds in (("READERS", READS), ("WRITERS", WRITES)):
        found = accessors(edges, table, kinds, depth)
        route = F.col("node").startswith("API_ENDPOINT:")
        parts += [label(found.where("distance = 1"), name), label(found.where((F.col("distance") > 1) & ~route), f"{name}_CALLERS"), label(found.where(route), f"{name}_ROUTES")]
    foreign = edges.where((F.col("relationship") == "FOREIGN_KEY_TO") & F.col("target").contains(f".{table}.")).select(F.col("source").alias("node"), F.lit(1).alias("distance"))
    tested = edges.where("relationship = 'TESTS'").select("source", F.col("target").alias("node"))
    near = O.union(parts).select("node").distinct()
    tests = tested.join(near, "node", "left_semi").select(F.col("source").alias("node"), F.lit(2).alias("distance")).distinct()
    return O.union([*parts, label(foreign, "FOREIGN_KEYS"), label(tests, "TESTS")]).distinct()


def package_edges(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Dependencies between packages (name, root) of modules: the longest root decides, on both ends."""
    ends = edges.where("relationship = 'IMPORTS' and confidence = 'HIGH'").select("source", "target").distinct()
    few = F.broadcast(packages.select("name", F.concat(F.regexp_replace("root", "/", "."), F.lit(".")).alias("p")))
    modules = ends.select(F.col("source").alias("m")).unionAll(ends.select("target")).distinct()
    owner = modules.join(few, F.concat("m", F.lit(".")).startswith(F.col("p"))).groupBy("m").agg(F.max_by("name", F.length("p")).alias("owner"))
    x = ends.join(owner.select(F.col("m").alias("source"), F.col("owner").alias("a")), "source").join(owner.select(F.col("m").alias("target"), F.col("owner").alias("b")), "target")
    return x.where("a <> b").groupBy(F.col("a").alias("package"), F.col("b").alias("depends_on")).agg(F.count("*").alias("imports"))


def expand_terms(terms: list[str], symbols: DataFrame, most: int = 8, generic: tuple[str, ...] = ("get", "set", "run", "main", "init", "data")) -> DataFrame:
    """Query terms with the canonical and qualified names of the symbols they name; generic ones are not expanded."""
    spark = symbols.sparkSession
    given = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "ordinal int, term string")
    hits = given.where(~F.lower("term").isin(*generic)).join(symbols.select("name", "canonical_id"), F.lower("name") == F.lower("term"))
    every = hits.select("ordinal", F.lit(0).alias("rank"), F.col("canonical_id").alias("term")).unionAll(given.select("ordinal", F.lit(1).alias("rank"), "term"))
    first = every.groupBy("term").agg(F.min(F.struct("rank", "ordinal")).alias("o")).select("term", "o.*")
    return first.orderBy("rank", "ordinal", "term").limit(most).select("term")


def resolve_runtime(observed: DataFrame, symbols: DataFrame, tables: DataFrame) -> DataFrame:
    """Raw symbols and tables of telemetry as canonical ids: exact, else the only short name, else raw."""
    s = symbols.select("canonical_id", "name")
    exact = s.select(F.col("canonical_id").alias("handler"), F.col("canonical_id").alias("_exact")).distinct()
    unique = s.groupBy(F.col("name").alias("handler")).agg(F.count("*").alias("_n"), F.min("canonical_id").alias("_only")).where("_n = 1").drop("_n")
    known = tables.select(F.lower("table_name").alias("table")).distinct().withColumn("_t", F.concat(F.lit("db.UNKNOWN.UNKNOWN."), "table"))
    x = observed.join(exact, "handler", "left").join(unique, "handler", "left").withColumn("table", F.lower(F.element_at(F.split("table", r"\."), -1))).join(known, "table", "left")
    return x.withColumn("symbol_id", F.coalesce("_exact", "_only", "handler")).withColumn("table_id", F.coalesce("_t", F.concat(F.lit("db.UNKNOWN.UNKNOWN."), "table"))).drop("_exact", "_only", "_t")


def contract_drift(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Client calls (call, method, url) that no endpoint (method, full) takes, or only with another method."""
    c = calls.select("call", F.upper("method").alias("method"), T.strip_proxy(T.route_segments(F.col("url"))).alias("c")).withColumn("n", F.size("c"))
    e = endpoints.select(F.upper("method").alias("verb"), T.strip_proxy(T.route_segments(F.col("full"))).alias("b")).distinct().withColumn("n", F.size("b"))
    fits = F.forall(F.zip_with("c", "b", lambda p, q: (p == q) | (p == "{*}") | (q == "{*}")), lambda ok: ok)
    hits = c.join(e, "n").where(fits).groupBy("call").agg(F.max(F.col("verb") == F.col("method")).alias("ok"), F.array_join(F.array_sort(F.collect_set("verb")), ",").alias("verbs"))
    x = c.join(hits, "call", "left").where("ok is null or not ok")
    return x.select("call", F.when(F.col("ok").isNull(), "ORPHANED_CLIENT_ROUTE").otherwise("HTTP_METHOD_MISMATCH").alias("issue"), F.coalesce("verbs", F.lit("")).alias("accepted"))


def change_impact(changed: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed paths, their symbols, and who calls, handles or tests those: (bucket, name)."""
    own = symbols.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("canonical_id").alias("name")).distinct()
    kinds = {"CALLS": "CALLER", "HANDLED_BY": "ROUTE", "TESTS": "TEST", "EXTENDS": "SUBCLASS"}
    table = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    into = edges.where(F.col("relationship").isin(*kinds)).join(own.withColumnRenamed("name", "target"), "target", "left_semi").select(table[F.col("relationship")].alias("bucket"), F.col("source").alias("name"))
    return own.select(F.lit("SYMBOL").alias("bucket"), "name").unionAll(into).distinct()


def test_command(tests: DataFrame) -> DataFrame:
    """One command line a framework for the paths of affected tests."""
    runner = F.when(F.col("path").endswith(".py"), "python -m pytest").otherwise("npx vitest run")
    return tests.groupBy(runner.alias("runner")).agg(F.array_join(F.array_sort(F.collect_set("path")), " ").alias("paths")).select("runner", F.concat_ws(" ", "runner", "paths").alias("command"))


def page_route(path):
    """URL of a page file: groups dropped, [id] as {id}, [...rest] as {rest}, index and page files as their folder."""
    out = F.regexp_replace(path, r"^(src/)?(app|pages)/", "/")
    out = F.regexp_replace(out, r"\.[jt]sx?$", "")
    out = F.regexp_replace(out, r"/\([^)]*\)", "")
    out = F.regexp_replace(out, r"/(page|route|index)$", "")
    out = F.regexp_replace(out, r"\[\[?\.{0,3}([A-Za-z0-9_]+)\]?\]", "{$1}")
    return F.when(out == "", "/").otherwise(out)


def manifests(files: DataFrame) -> DataFrame:
    """Packages of package.json files: name, root, dependencies, kind."""
    kind = "struct<name:string,bin:string,main:string,dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>>"
    x = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(F.regexp_replace("path", r"/?package\.json$", "").alias("root"), F.from_json(F.coalesce("text", F.col("content").cast("string")), kind).alias("m"))
    deps = F.array_sort(F.map_keys(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>"))))
    server = F.arrays_overlap(deps, F.array(*map(F.lit, ("express", "fastify", "@nestjs/core", "koa"))))
    what = F.when(server, "SERVICE").when(F.col("m.bin").isNotNull() | F.array_contains(deps, "next"), "APPLICATION").when(F.col("m.main").isNotNull(), "LIBRARY").otherwise("UNKNOWN")
    return x.where("m is not null").select(F.coalesce("m.name", "root").alias("name"), "root", deps.alias("dependencies"), what.alias("kind"))


def alias_paths(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Modules with path aliases (alias, target) of a configuration replaced; the longest alias decides."""
    hit = imports.join(F.broadcast(aliases.select(F.col("alias").alias("_alias"), "target")), F.col("module").startswith(F.col("_alias")), "left")
    keys = [c for c in imports.columns]
    best = hit.groupBy(*keys).agg(F.max_by(F.struct(F.col("_alias").alias("alias"), "target"), F.length("_alias")).alias("a"))
    return best.withColumn("resolved", F.when(F.col("a.alias").isNotNull(), F.concat("a.target", F.expr("substring(module, length(a.alias) + 1)"))).otherwise(F.col("module"))).drop("a")


def migration_state(files: DataFrame) -> DataFrame:
    """One row: digest, n and latest of the migration files among files (path, modified), by name."""
    kinds = r"(^|/)migrations/[^/]*\.sql$|(^|/)prisma/migrations/.*\.sql$|(^|/)drizzle/[^/]*\.sql$|(^|/)alembic/versions/[^/]*\.py$"
    found = files.where(F.col("path").rlike(kinds) & ~F.col("path").rlike(r"(^|/)(node_modules|\.git)/"))
    x = found.agg(F.sort_array(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("modified").cast("string").alias("modified")))).alias("f"))
    text = F.array_join(F.transform("f", lambda r: F.concat(r["name"], F.lit(" "), r["modified"])), "\n")
    none = F.size("f") == 0
    return x.select(F.when(none, "").otherwise(F.substring(F.sha2(text, 256), 1, 16)).alias("digest"), F.size("f").alias("n"), F.when(none, "").otherwise(F.element_at("f", -1)["name"]).alias("latest"))
