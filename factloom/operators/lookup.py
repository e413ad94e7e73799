"""Lookup, resolution, guards and impact over fact rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blast_radius(seeds: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """seeds: source. first: source, mid. second: mid, target. Counts are distinct; score at most 100."""
    direct = first.groupBy("source").agg(F.countDistinct("mid").alias("direct"))
    reach = first.join(second, "mid").groupBy("source").agg(F.countDistinct("target").alias("transitive"))
    zero = F.lit(0).cast("long")
    out = seeds.join(direct, "source", "left").join(reach, "source", "left").select(
        F.col("source").alias("seed"), F.coalesce("direct", zero).alias("direct"), F.coalesce("transitive", zero).alias("transitive")
    )
    out = out.withColumn("score", F.least(F.lit(100.0), F.col("direct") * 3.5 + F.col("transitive") * 1.5))
    return out.withColumn("risk", F.when(F.col("score") >= 75, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 25, "MEDIUM").otherwise("LOW"))


def evidence_class(edges: DataFrame, framework: tuple[str, ...]) -> DataFrame:
    """First match decides: weak confidence, then a framework's relationship, then how it was resolved."""
    return edges.withColumn(
        "evidence_class",
        F.when(F.col("confidence") == "LOW", "POSSIBLE").when(F.col("relationship").isin(*framework), "FRAMEWORK_DERIVED").when(F.col("confidence") == "MEDIUM", "DATAFLOW_VERIFIED").otherwise("AST_VERIFIED"),
    )


def guard(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Counts of (relationship, evidence_class) and whether the allow-list has the pair."""
    n = edges.groupBy("relationship", "evidence_class").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), ["relationship", "evidence_class"], "left").select("relationship", "evidence_class", F.coalesce("ok", F.lit(False)).alias("allowed"), "n")


def enforce(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges, or an error at run time for the first pair that the allow-list lacks."""
    ok = edges.join(F.broadcast(allowed.withColumn("_ok", F.lit(True))), ["relationship", "evidence_class"], "left")
    fail = F.raise_error(F.concat(F.lit("not allowed: "), "relationship", F.lit(" "), "evidence_class"))
    return ok.withColumn("relationship", F.when(F.col("_ok"), F.col("relationship")).otherwise(fail)).select(edges.columns)


def tiered(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted term (few) the first tier that matches: exact, suffix after a space, substring."""
    tier = F.when(F.col("name") == F.col("term"), 1).when(F.col("name").endswith(F.concat(F.lit(" "), "term")), 2).when(F.lower("name").contains(F.lower("term")), 3)
    hits = names.join(F.broadcast(wanted), F.lower("name").contains(F.lower("term"))).withColumn("tier", tier).where("tier is not null")
    counts = hits.groupBy("term", "tier").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    best = counts.groupBy("term").agg(F.min_by(F.struct("tier", "n", "first_id"), "tier").alias("b"))
    return wanted.distinct().join(best, "term", "left").select("term", F.col("b.tier").alias("tier"), F.coalesce("b.n", F.lit(0).cast("long")).alias("n"), F.col("b.first_id").alias("first_id"))


def scored_search(names: DataFrame, part: str, exact: str, top_k: int) -> DataFrame:
    """Names that hold part, case aside: 100 if exact, 85 if prefix, 70 if they hold exact, else 60."""
    name = F.lower("name")
    score = F.when(name == exact, 100).when(name.startswith(part), 85).when(name.contains(exact), 70).otherwise(60)
    top = names.where(name.contains(part)).withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(top_k)
    return top.withColumn("position", F.row_number().over(_all().orderBy(F.col("score").desc(), "id")))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def resolve(names: DataFrame, wanted: DataFrame) -> DataFrame:
    found = wanted.distinct().join(names, F.col("name") == F.col("term"), "left").groupBy("term").agg(F.count("id").alias("n"), F.min("id").alias("low"))
    status = F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return found.select("term", "n", status.alias("status"), F.when(F.col("n") == 1, F.col("low")).alias("resolved"))


def impact(branches: list[DataFrame]) -> DataFrame:
    """Each (target, source) in its best bucket. branches: target, category, rank, source."""
    every = reduce(DataFrame.unionByName, branches)
    best = every.groupBy("target", "source").agg(F.min(F.struct("rank", "category")).alias("b"))
    return best.select("target", "source", F.col("b.category").alias("category"), F.col("b.rank").alias("rank"))


def related(targets: DataFrame, strategies: list[DataFrame], weak: DataFrame) -> DataFrame:
    """(target, strategy, test): strategies in order of strength, weak only where none found anything."""
    every = reduce(DataFrame.unionByName, [s.withColumn("ordinal", F.lit(i)) for i, s in enumerate(strategies)])
    best = every.groupBy("target", "test").agg(F.min(F.struct("ordinal", "strategy")).alias("b")).select("target", F.col("b.strategy").alias("strategy"), "test")
    rest = weak.join(best.select("target").distinct(), "target", "left_anti").select("target", "strategy", "test")
    found = best.unionByName(rest)
    return targets.join(found, "target", "left").select("target", F.coalesce("strategy", F.lit("NONE")).alias("strategy"), F.coalesce("test", F.lit("NO_EVIDENCE")).alias("test"))


def together(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(a, b, n): pairs of items that share a group, and in how many; groups are small (lines of an order)."""
    one = rows.select(*keys, F.col(item).alias("a")).distinct()
    two = one.withColumnRenamed("a", "b")
    return one.join(two, keys).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def longest_prefix(rows: DataFrame, key: str, text: str, owners: DataFrame) -> DataFrame:
    """The owner with the longest matching prefix. owners (owner, prefix) are packages, so few."""
    hits = rows.join(F.broadcast(owners), F.col(text).startswith(F.col("prefix")))
    return hits.groupBy(key).agg(F.max_by("owner", F.length("prefix")).alias("owner"), F.max(F.length("prefix")).alias("matched"))
