"""Edges that frameworks imply: handlers, templates, providers, registries; and how names resolve."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import facts as O
from .resolve import edge, with_modules

#: decorator (last component), relationship
HANDLERS = (("task", "TASK_HANDLER"), ("shared_task", "TASK_HANDLER"), ("command", "COMMAND_HANDLER"), ("on_event", "EVENT_LISTENER"), ("receiver", "EVENT_LISTENER"), ("listens_for", "EVENT_LISTENER"), ("register", "REGISTERS"))


def handler_edges(symbols: DataFrame) -> DataFrame:
    """A decorated symbol handles what its decorator names, or a name of its own."""
    d = symbols.select("path", F.col("start_line").alias("line"), "canonical_id", "name", F.explode("decorators").alias("d"))
    word = F.regexp_extract("d", r"([A-Za-z_]\w*)\s*(?:\(|$)", 1)
    first = F.regexp_extract("d", r"\(\s*['\"]?([\w.:/-]+)['\"]?", 1)
    table = F.create_map(*(F.lit(x) for kv in HANDLERS for x in kv))
    x = d.withColumn("r", F.try_element_at(table, word)).where("r is not null").withColumn("n", F.when(first == "", F.col("name")).otherwise(first))
    return edge(x, F.concat(F.lower("r"), F.lit(":"), "n"), "canonical_id", F.col("r"))


def template_edges(calls: DataFrame, templates: DataFrame) -> DataFrame:
    """Calls that render a template named by a literal; LOW if no such file was scanned."""
    x = calls.where(F.col("callee").rlike(r"(^|\.)(render|render_template|TemplateResponse|render_to_string)$"))
    named = x.withColumn("t", F.get(F.filter(F.transform("arguments", lambda a: F.regexp_extract(a, r"^['\"]([\w./-]+\.(?:html?|jinja2?|njk|ejs))['\"]$", 1)), lambda a: a != ""), F.lit(0))).where("t is not null")
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    known = templates.select(F.col("path").alias("_p"), F.explode(ends).alias("t")).groupBy("t").agg(F.min("_p").alias("_p"))
    found = named.join(known, "t", "left")
    best = found.groupBy("path", "line", "caller", "t").agg(F.min("_p").alias("p"))
    return edge(best, "caller", F.coalesce("p", "t"), "RENDERS_TEMPLATE", F.when(F.col("p").isNull(), "LOW").otherwise("HIGH"))


def provider_edges(symbols: DataFrame, injects: DataFrame) -> DataFrame:
    """Functions provide the type they return; several for one type are only possible. What is injected
    by name resolves to the function of that name, if there is one."""
    made = symbols.where("kind in ('function', 'method') and return_type <> ''").withColumn("line", F.col("start_line"))
    n = made.groupBy("return_type").agg(F.countDistinct("canonical_id").alias("n"))
    x = made.join(n, "return_type")
    label = F.when(F.col("n") > 1, "LOW").otherwise("HIGH")
    provides = edge(x, "canonical_id", F.concat(F.lit("type:"), "return_type"), F.lit("PROVIDES"), label, F.when(F.col("n") > 1, "several providers").otherwise(""))
    names = symbols.where("kind = 'function'").groupBy("name").agg(F.count("*").alias("_n"), F.min("canonical_id").alias("_id"))
    i = injects.withColumn("last", F.element_at(F.split("name", r"\."), -1)).join(names.withColumnRenamed("name", "last"), "last", "left")
    target = F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.col("name"))
    resolved = edge(i, "owner", target, "RESOLVES_DEPENDENCY", F.when(F.col("_n") == 1, "HIGH").when(F.col("_n") > 1, "LOW").otherwise("UNKNOWN"))
    return provides.unionByName(resolved)


def registry_edges(bindings: DataFrame, calls: DataFrame) -> DataFrame:
    """Entries of dictionaries of handlers: the last assignment of a name wins; calls through it, in its file, dispatch to each."""
    d = bindings.where("kind = 'dict'")
    last = F.row_number().over(W.partitionBy("scope", "name").orderBy(F.col("line").desc()))
    now = d.withColumn("_r", last).where("_r = 1")
    items = now.select("path", "line", "scope", "name", F.explode(F.regexp_extract_all("source", F.lit(r"['\"][^'\"]*['\"]\s*:\s*([A-Za-z_][\w.]*)"), F.lit(1))).alias("h"))
    registry = F.concat_ws(".", "scope", "name")
    registers = edge(items, registry, "h", "REGISTERS")
    used = calls.withColumn("r", F.regexp_extract("callee", r"^([A-Za-z_]\w*)\s*(?:\[|\.get\()", 1)).where("r <> ''").select("path", "line", "caller", "r")
    hit = used.join(items.select("path", F.col("name").alias("r"), "h").distinct(), ["path", "r"])
    return registers.unionByName(edge(hit, "caller", "h", "DISPATCHES_TO", "MEDIUM", "registry"))


def resolve_package(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports that name a workspace package: the package, or AMBIGUOUS if two carry the name."""
    name = F.when(F.col("module").startswith("@"), F.regexp_extract("module", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("module", r"^([^/]+)", 1))
    n = packages.groupBy("name").agg(F.count("*").alias("n"), F.min("root").alias("root"))
    x = imports.withColumn("package", name).join(n.withColumnRenamed("name", "package"), "package", "left")
    return x.withColumn("status", F.when(F.col("n").isNull(), "EXTERNAL").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")).withColumn("root", F.when(F.col("n") == 1, F.col("root"))).drop("n")


def diagnose(expression: str, module: str, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """step, tried, found: every way in which a name used in a module may resolve, in order."""
    spark = symbols.sparkSession
    head, _, rest = expression.partition(".")
    i = with_modules(imports).where((F.col("importer") == module)).where((F.col("alias") == head) | ((F.col("alias") == "") & ((F.col("name") == head) | ((F.col("name") == "") & (F.col("target_module") == head)))))
    base = F.concat_ws(".", F.nullif("target_module", F.lit("")), F.nullif("name", F.lit("")), F.lit(rest or None).cast("string"))
    fixed = spark.createDataFrame([(1, expression), (2, f"{module}.{expression}")], "step int, tried string")
    tried = fixed.unionAll(i.select(F.lit(3).alias("step"), base.alias("tried")))
    ids = symbols.select(F.col("canonical_id").alias("tried")).distinct().withColumn("_f", F.lit(True))
    exact = tried.distinct().join(ids, "tried", "left").select("step", "tried", F.coalesce("_f", F.lit(False)).alias("found"))
    by_name = symbols.where(F.col("name") == expression.split(".")[-1]).select(F.lit(4).alias("step"), F.col("canonical_id").alias("tried"), F.lit(True).alias("found"))
    return exact.unionAll(by_name).orderBy("step", "tried")


def split_arguments(text: str) -> list[str]:
    """Arguments of a call by commas outside brackets and quotes."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [*out, text[start:].strip()] if text.strip() else []


def split_arguments_column(column):
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(split_arguments)

    return F.pandas_udf(run, "array<string>")(column)


def input_fields(routes: DataFrame, symbols: DataFrame, fields: DataFrame) -> DataFrame:
    """handler, model, field, ...: fields of the models that a handler's parameters are annotated with."""
    handlers = symbols.join(routes.select(F.col("handler").alias("canonical_id")).distinct(), "canonical_id", "left_semi")
    kinds = handlers.select(F.col("canonical_id").alias("handler"), F.explode(F.regexp_extract_all("signature", F.lit(r":\s*([A-Za-z_][\w.]*)"), F.lit(1))).alias("k"))
    x = fields.withColumn("short", F.element_at(F.split("model", r"\."), -1))
    return kinds.withColumn("short", F.element_at(F.split("k", r"\."), -1)).join(x, "short").select("handler", "model", "field", "data_type", "required", "nullable", "max_length")


def architecture(base: DataFrame, head: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of modules that differ between two sets of symbols: added, removed and changed names, and an
    estimate of the tokens that the page's symbols take."""
    d = O.compare(base.select("canonical_id", "body_hash"), head.select("canonical_id", "body_hash"), "canonical_id", "body_hash")
    where = base.select("canonical_id", "path").unionAll(head.select("canonical_id", "path")).groupBy("canonical_id").agg(F.min("path").alias("path"))
    x = d.join(where, "canonical_id").withColumn("module", T.module_of(F.col("path")))
    names = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("canonical_id"))))
    out = x.groupBy("module").agg(names("ADDED").alias("added"), names("REMOVED").alias("removed"), names("MODIFIED").alias("modified"), (F.count("*") * 25 + 150).alias("tokens"))
    return O.page(out, ["module"], offset, limit)


def diagnose_misses(expected: DataFrame, retrieved: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """name, cause: expected names that were not retrieved, and retrieved ones that were not expected."""
    known = symbols.select(F.col("canonical_id").alias("name")).distinct().withColumn("_s", F.lit(1))
    linked = edges.select(F.col("source").alias("name")).unionAll(edges.select("target")).distinct().withColumn("_e", F.lit(1))
    lost = expected.select("name").distinct().join(retrieved.select("name"), "name", "left_anti").join(known, "name", "left").join(linked, "name", "left")
    cause = F.when(F.col("_s").isNull(), "NOT_INDEXED").when(F.col("_e").isNull(), "NO_EDGES").otherwise("RANKED_OUT")
    extra = retrieved.select("name").distinct().join(expected.select("name"), "name", "left_anti").select("name", F.lit("UNEXPECTED").alias("cause"))
    return lost.select("name", cause.alias("cause")).unionAll(extra)
