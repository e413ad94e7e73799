"""The property graph over the relational tables: customers, orders, parts, suppliers, places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def build_edges(spark: SparkSession, sf_dir: str, *relationships: str) -> DataFrame:
    """source, target, relationship, confidence, line; only the named relationships are read."""
    wanted = relationships or ("PLACED", "CONTAINS", "SUPPLIED_BY", "LOCATED_IN", "PART_OF")
    none, high = F.lit(0).alias("line"), F.lit("HIGH").alias("confidence")
    parts = []
    rel = lambda name: F.lit(name).alias("relationship")
    if "PLACED" in wanted:
        label = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "MEDIUM").otherwise("LOW")
        parts.append(table(spark, sf_dir, "orders").select(node("c", "o_custkey").alias("source"), node("o", "o_orderkey").alias("target"), rel("PLACED"), label.alias("confidence"), none))
    if "CONTAINS" in wanted:
        lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linestatus").alias("status"), F.min("l_linenumber").alias("line"))
        label = F.when(F.col("status") == "F", "HIGH").otherwise("MEDIUM")
        parts.append(lines.select(node("o", "l_orderkey").alias("source"), node("p", "l_partkey").alias("target"), rel("CONTAINS"), label.alias("confidence"), "line"))
    if "SUPPLIED_BY" in wanted:
        pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
        parts.append(pairs.select(node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target"), rel("SUPPLIED_BY"), high, none))
    if "LOCATED_IN" in wanted:
        parts.append(table(spark, sf_dir, "customer").select(node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target"), rel("LOCATED_IN"), high, none))
        parts.append(table(spark, sf_dir, "supplier").select(node("s", "s_suppkey").alias("source"), node("n", "s_nationkey").alias("target"), rel("LOCATED_IN"), high, none))
    if "PART_OF" in wanted:
        parts.append(table(spark, sf_dir, "nation").select(node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target"), rel("PART_OF"), high, none))
    return reduce(DataFrame.unionByName, parts)


#: The same for DuckDB, as a common table expression.
EDGES = """edges as (
  select 'c:'||o_custkey as source, 'o:'||o_orderkey as target, 'PLACED' as relationship, case o_orderstatus when 'F' then 'HIGH' when 'O' then 'MEDIUM' else 'LOW' end as confidence, 0 as line from orders
  union all select 'o:'||l_orderkey, 'p:'||l_partkey, 'CONTAINS', case min(l_linestatus) when 'F' then 'HIGH' else 'MEDIUM' end, min(l_linenumber) from lineitem group by l_orderkey, l_partkey
  union all select distinct 'p:'||l_partkey, 's:'||l_suppkey, 'SUPPLIED_BY', 'HIGH', 0 from lineitem
  union all select 'c:'||c_custkey, 'n:'||c_nationkey, 'LOCATED_IN', 'HIGH', 0 from customer
  union all select 's:'||s_suppkey, 'n:'||s_nationkey, 'LOCATED_IN', 'HIGH', 0 from supplier
  union all select 'n:'||n_nationkey, 'r:'||n_regionkey, 'PART_OF', 'HIGH', 0 from nation)"""
