"""Scores of retrieved paths and packets, and gates against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest relative rise, or fall for what should be high.
GATES = {"latency": 0.25, "memory": 0.25, "cpu": 0.30, "recall": -0.05, "coverage": -0.05}


def path_accuracy(paths: DataFrame, retrieved: str = "retrieved", expected: str = "expected") -> DataFrame:
    """Adds recall and precision in thousandths, missing and extra nodes; empty against empty is whole."""
    r, e = F.array_distinct(retrieved), F.array_distinct(expected)
    both = F.size(F.array_intersect(r, e))
    share = lambda a, b: F.floor(1000 * a / b).cast("long")
    whole = (F.size(e) == 0).cast("int")
    return paths.withColumns({
        "recall": F.when(whole == 1, 1000).otherwise(share(both, F.greatest(F.size(e), F.lit(1)))).cast("long"),
        "precision": F.when((whole == 1) & (F.size(r) == 0), 1000).when(F.size(r) == 0, 0).otherwise(share(both, F.greatest(F.size(r), F.lit(1)))).cast("long"),
        "missing": F.array_join(F.array_sort(F.array_except(e, r)), ","), "extra": F.array_join(F.array_sort(F.array_except(r, e)), ","),
    })


def efficiency(items: DataFrame, group: str, layer: str, key: str, tokens: str) -> DataFrame:
    """Layers covered, share of repeated keys (thousandths) and tokens of each packet."""
    return items.groupBy(group).agg(
        F.countDistinct(layer).alias("layers"), F.floor(1000 * (F.count("*") - F.countDistinct(key)) / F.count("*")).cast("long").alias("redundancy"), F.sum(tokens).alias("tokens")
    )


def regressions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, kind, old, new, status: against the largest rise or fall that the kind allows."""
    limits = baseline.sparkSession.createDataFrame(list(GATES.items()), "kind string, allowed double")
    x = baseline.select("metric", "kind", F.col("value").alias("old")).join(candidate.select("metric", F.col("value").alias("new")), "metric", "full").join(F.broadcast(limits), "kind", "left")
    change = F.try_divide(F.col("new") - F.col("old"), F.col("old"))
    bad = F.when(F.col("allowed") > 0, change > F.col("allowed")).otherwise(change < F.col("allowed"))
    status = F.when(F.col("new").isNull(), "MISSING").when(F.col("old").isNull(), "NEW").when(bad, "REGRESSION").otherwise("OK")
    return x.select("metric", "kind", "old", "new", status.alias("status"))
