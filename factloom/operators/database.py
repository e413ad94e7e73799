"""Database facts: tables, columns, models, accessors, route lineage and schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G

READS, WRITES = ("READS_TABLE",), ("WRITES_TABLE",)
#: Names of one kind of value in code and in databases.
TYPE_GROUPS = {
    "number": ("int", "integer", "bigint", "smallint", "number", "serial", "long"), "text": ("str", "string", "text", "varchar", "char", "uuid"), "flag": ("bool", "boolean"),
    "real": ("float", "double", "numeric", "decimal", "real"), "time": ("date", "datetime", "timestamp"), "document": ("json", "jsonb", "dict", "object"),
}


def find_tables(tables: DataFrame, name: str | None = None) -> DataFrame:
    """One row a table, the facts of its files merged; a name matches the last component in any case."""
    x = tables if name is None else tables.where(F.lower("table_name") == name.split(".")[-1].lower())
    return x.groupBy("table_name").agg(
        F.countDistinct("column_name").alias("columns"), F.array_sort(F.collect_set(F.when(F.col("primary_key"), F.col("column_name")))).alias("keys"),
        F.array_sort(F.collect_set(F.nullif("model", F.lit("")))).alias("models"), F.array_sort(F.collect_set("path")).alias("paths"),
    )


def find_columns(tables: DataFrame, column: str) -> DataFrame:
    """Columns of a name, once a table and file."""
    x = tables.where(F.lower("column_name") == column.lower())
    return G.first_by(x, ["table_name", "column_name", "path"], ["line"]).select("table_name", "column_name", "data_type", "nullable", "target", "path", "line")


def accessors(edges: DataFrame, table: str, kinds: tuple[str, ...] = READS + WRITES, depth: int = 5) -> DataFrame:
    """Symbols that reach a table: (node, distance, chain) from direct accessors up their callers and routes."""
    spark = edges.sparkSession
    last = F.element_at(F.split("target", r"\."), -1)
    direct = edges.where(F.col("relationship").isin(*kinds) & F.col("target").startswith("db.") & (last == table)).select("source", F.lit(table).alias("target"))
    calls = edges.where(F.col("relationship").isin("CALLS", "HANDLED_BY") & F.col("confidence").isin("HIGH", "MEDIUM")).select("source", "target")
    back = direct.unionByName(calls).select(F.col("target").alias("source"), F.col("source").alias("target"))
    found = G.shortest_paths(back, spark.createDataFrame([(table, table)], "seed string, node string"), depth)
    return found.where("depth > 0").select("node", F.col("depth").alias("distance"), F.array_join(F.reverse("path"), ">").alias("chain"))


def route_lineage(edges: DataFrame, depth: int = 4, most: int = 10) -> DataFrame:
    """For each endpoint and table: operations (a write takes in reads), the shortest chain, its length."""
    steps = edges.where(F.col("relationship").isin("HANDLED_BY", "CALLS") & F.col("confidence").isin("HIGH", "MEDIUM"))
    seeds = edges.where("relationship = 'HANDLED_BY'").select(F.col("source").alias("seed"), F.col("source").alias("node")).distinct()
    reach = G.shortest_paths(steps, seeds, depth)
    access = edges.where(F.col("relationship").isin(*READS, *WRITES)).select(F.col("source").alias("node"), F.element_at(F.split("target", r"\."), -1).alias("table"), "relationship", "confidence")
    x = reach.join(access, "node").withColumn("chain", F.concat("path", F.array("table")))
    out = x.groupBy(F.col("seed").alias("endpoint"), "table").agg(
        F.array_sort(F.collect_set("relationship")).alias("kinds"), F.min(F.struct(F.size("chain").alias("n"), F.col("chain"))).alias("c"), F.max((F.col("confidence") == "UNKNOWN").cast("int")).alias("unknown"), F.count("*").alias("evidence")
    )
    kinds = F.when(F.array_contains("kinds", "WRITES_TABLE"), F.array(F.lit("WRITES_TABLE"))).otherwise(F.col("kinds"))
    return out.select("endpoint", "table", kinds.alias("kinds"), F.array_join("c.chain", ">").alias("chain"), F.col("c.n").alias("length"), F.when(F.col("unknown") == 1, "UNKNOWN").otherwise("AST_VERIFIED").alias("evidence_class"), F.least("evidence", F.lit(most)).alias("evidence"))


def type_group(kind):
    base = F.lower(F.regexp_extract(kind, r"^([A-Za-z_]+)", 1))
    out = F.lit("other")
    for name, members in TYPE_GROUPS.items():
        out = F.when(base.isin(*members), name).otherwise(out)
    return out


def schema_drift(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """fields (table_name, field, data_type, required, max_length) a route takes, against columns
    (table_name, column_name, data_type, nullable, has_default, length): one row an issue."""
    f = fields.select("table_name", F.lower("field").alias("name"), F.col("data_type").alias("ft"), "required", "max_length")
    c = columns.select("table_name", F.lower("column_name").alias("name"), F.col("data_type").alias("ct"), "nullable", "has_default", "length")
    c = c.join(f.select("table_name").distinct(), "table_name", "left_semi")
    x = f.join(c, ["table_name", "name"], "full")
    issue = (
        F.when(F.col("ft").isNull() & ~F.col("nullable") & ~F.col("has_default"), F.struct(F.lit("MISSING_REQUIRED_FIELD").alias("issue"), F.lit("HIGH").alias("severity")))
        .when(F.col("ft").isNull(), F.struct(F.lit("UNUSED_COLUMN").alias("issue"), F.lit("LOW").alias("severity")))
        .when(F.col("ct").isNull(), F.struct(F.lit("UNKNOWN_COLUMN").alias("issue"), F.lit("MEDIUM").alias("severity")))
        .when(type_group(F.col("ft")) != type_group(F.col("ct")), F.struct(F.lit("TYPE_INCOMPATIBILITY").alias("issue"), F.lit("HIGH").alias("severity")))
        .when(~F.col("required") & ~F.col("nullable") & ~F.col("has_default"), F.struct(F.lit("NULLABILITY_DRIFT").alias("issue"), F.lit("MEDIUM").alias("severity")))
        .when(F.col("length").isNotNull() & (F.coalesce("max_length", F.lit(1 << 30)) > F.col("length")), F.struct(F.lit("LENGTH_DRIFT").alias("issue"), F.lit("MEDIUM").alias("severity")))
    )
    return x.withColumn("i", issue).where("i is not null").select("table_name", "name", "i.issue", "i.severity")
