"""Traversals of an edge table (source, target, relationship, confidence, line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import settle

MAX_DEPTH = 5


def clamp_depth(depth: int) -> int:
    return max(1, min(MAX_DEPTH, depth))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(seed, node, depth): every node reachable from each seed, at its smallest depth; seeds have depth 0.

    edges: source, target. seeds: seed, node. A level is one equi-join and one anti-join on what was
    visited; the frontier is distinct before each join, so hubs are expanded once a seed.
    """
    near, far = ("target", "source") if reverse else ("source", "target")
    steps = settle(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct())
    visited = seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for level in range(1, clamp_depth(depth) + 1):
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = settle(found.join(visited, ["seed", "node"], "left_anti").withColumn("depth", F.lit(level)))
        visited = visited.unionByName(frontier)
    return visited


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth, path): the shortest path to each node, the smallest in text order among equals.

    One path is kept for each node and level, which is enough: a smaller prefix of the same length
    makes a smaller path.
    """
    steps = settle(edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    visited = seeds.select("seed", "node").distinct().select("seed", "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    frontier = visited
    for level in range(1, clamp_depth(depth) + 1):
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        found = found.groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = settle(found.join(visited, ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("depth"), "path"))
        visited = visited.unionByName(frontier)
    return visited


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Simple cycles of up to ``longest`` edges, each once, from its smallest node: path, length."""
    steps = edges.where("source <> target").select("source", "target").distinct()
    paths = steps.select(F.array("source").alias("path"), F.col("target").alias("node"))
    out = []
    for n in range(1, longest + 1):
        head = F.get("path", F.lit(0))
        if n > 1:
            out.append(paths.where(F.col("node") == head).select("path", F.lit(n).alias("length")))
        if n < longest:
            paths = (
                paths.where((F.col("node") > head) & ~F.array_contains("path", F.col("node")))
                .join(steps, F.col("node") == F.col("source"))
                .select(F.concat("path", F.array("node")).alias("path"), F.col("target").alias("node"))
            )
    return reduce(DataFrame.unionByName, out)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both among nodes (node)."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(
        ends.withColumnRenamed("node", "target"), "target", "left_semi"
    )


def distances(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, unreachable: int = 99) -> DataFrame:
    """(seed, node, distance) over undirected edges for every pair of a seed and a node."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    found = bfs(both, seeds, depth)
    starts = seeds.select("seed").distinct()
    every = nodes.select("node").distinct().crossJoin(F.broadcast(starts) if _few(seeds) else starts)
    return every.join(found, ["seed", "node"], "left").select("seed", "node", F.coalesce("depth", F.lit(unreachable)).alias("distance"))


def _few(seeds: DataFrame, most: int = 1000) -> bool:
    """A handful of seeds (packages of a workspace) is broadcast."""
    return len(seeds.select("seed").distinct().limit(most + 1).collect()) <= most


def callers(edges: DataFrame, fallback: DataFrame) -> DataFrame:
    """Resolved edges (HIGH), then those of fallback whose (target, source, line) is not covered.

    Both have source, target, line, confidence. LOW fallbacks are POSSIBLE_CALLS.
    """
    resolved = edges.where("confidence = 'HIGH'").withColumn("branch", F.lit(1)).withColumn("kind", F.lit("CALLS"))
    rest = fallback.join(resolved.select("source", "target", "line"), ["source", "target", "line"], "left_anti")
    rest = rest.withColumn("branch", F.lit(2)).withColumn("kind", F.when(F.col("confidence") == "LOW", "POSSIBLE_CALLS").otherwise("CALLS"))
    cols = ["source", "target", "line", "confidence", "branch", "kind"]
    return resolved.select(cols).unionByName(rest.select(cols))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def compose_prefixes(mounts: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """All mount paths from roots to leaves, prefixes joined; leaves without a mount keep their own.

    mounts: parent (null for a root), child, prefix. leaves: owner, leaf, path. Columns: leaf, full, route.
    """
    paths = mounts.where("parent is null").select("child", F.col("prefix").alias("full"), F.array("child").alias("route"))
    every = paths
    for _ in range(clamp_depth(depth)):
        down = mounts.where("parent is not null").select(F.col("parent").alias("child"), F.col("child").alias("next"), "prefix")
        paths = (
            paths.join(down, "child")
            .where(~F.array_contains("route", F.col("next")))
            .select(F.col("next").alias("child"), F.concat("full", "prefix").alias("full"), F.concat("route", F.array("next")).alias("route"))
        )
        every = every.unionByName(paths)
    found = leaves.join(every, leaves.owner == every.child, "left")
    return found.select("leaf", F.concat(F.coalesce("full", F.lit("")), "path").alias("full"), F.coalesce(F.array_join("route", ">"), F.lit("UNMOUNTED")).alias("route"))


def compress(edges: DataFrame, labels: dict[str, int], locations: int = 4) -> DataFrame:
    """One row for each (source, target, relationship): best confidence, number, first few lines."""
    rank = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in labels.items() for x in reversed(kv)))
    return edges.groupBy("source", "target", "relationship").agg(
        F.get(F.array(F.max(rank[F.col("confidence")])), F.lit(0)).alias("_best"),
        F.count("*").alias("occurrences"),
        F.array_join(F.slice(F.array_sort(F.collect_set("line")), 1, locations).cast("array<string>"), ",").alias("lines"),
    ).select("source", "target", "relationship", names[F.col("_best")].alias("confidence"), "occurrences", "lines")
