"""Lexical search, ranking, budgeted selection and retrieval metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import settle

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, key: str, text: str, wanted: list[str]) -> DataFrame:
    """key, score of documents with at least one term. The terms of a query are few, so counting them
    needs no inverted index: one pass yields length and counts, one row of totals is broadcast."""
    split = docs.select(F.col(key), F.split(F.lower(text), "[^a-z0-9_]+").alias("_w"))
    empty = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0) + F.when(F.element_at("_w", -1) == "", 1).otherwise(0)
    length = F.greatest(F.size("_w") - empty, F.lit(0))
    counts = split.select(key, length.alias("_len"), *((F.size("_w") - F.size(F.array_remove("_w", t))).alias(f"_c{i}") for i, t in enumerate(wanted)))
    counts = settle(counts)  # narrow: the texts are split once, not once for the totals and again for the scores
    totals = counts.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count(F.when(F.col(f"_c{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(wanted))))
    x = counts.where(" or ".join(f"_c{i} > 0" for i in range(len(wanted)))).join(F.broadcast(totals), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"_c{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return x.select(key, F.round(score, 6).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best with their rank; ties to the smaller key."""
    order = [F.col("score").desc(), F.col(key)]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def line_hits(docs: DataFrame, key: str, text: str, literal: str, most: int = 5, around: int = 2) -> DataFrame:
    """key, line, score (hundredths), context: lines that hold the literal, case kept 92, else 88."""
    split = docs.select(key, T.lines(F.col(text)).alias("_l")).where(F.exists("_l", lambda x: F.lower(x).contains(literal.lower())))
    each = split.select(key, "_l", F.posexplode("_l").alias("_i", "_t")).where(F.lower("_t").contains(literal.lower()))
    first = each.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_i"))).where(F.col("_r") <= most)
    low = F.greatest(F.col("_i") - around + 1, F.lit(1))
    context = F.array_join(F.slice("_l", low, F.col("_i") + around + 2 - low), "\n")
    return first.select(key, (F.col("_i") + 1).alias("line"), F.when(F.col("_t").contains(literal), 92).otherwise(88).alias("score"), context.alias("context"))


def best_line(docs: DataFrame, key: str, text: str, literal: str, wanted: list[str]) -> DataFrame:
    """key, line, tier: first line with the literal, else with it in any case, else with most terms, else the first."""
    hits = lambda x: sum((F.when(F.lower(x).contains(t), 1).otherwise(0) for t in wanted), F.lit(0))
    tier = lambda x: F.when(x.contains(literal), 1).when(F.lower(x).contains(literal.lower()), 2).when(hits(x) > 0, 3).otherwise(4)
    rank = F.transform(T.lines(F.col(text)), lambda x, i: F.struct(tier(x).alias("tier"), F.when(tier(x) == 3, -hits(x)).otherwise(0).alias("n"), (i + 1).alias("line")))
    return docs.select(key, F.array_min(rank).alias("b")).select(key, F.col("b.line").alias("line"), F.col("b.tier").alias("tier"))


def penalized(rows: DataFrame, key: str, score: str, groups: dict[str, int]) -> DataFrame:
    """Scores less a penalty for each group column that a better row has already; floor 0.

    Only a group's best row escapes, which is a partial aggregate, so a hot group is no single task's.
    """
    out, total = rows, F.col(score)
    for column, penalty in groups.items():
        best = rows.groupBy(F.col(column).alias(f"_g_{column}")).agg(F.min(F.struct(-F.col(score), F.col(key).alias("k")))["k"].alias(f"_b_{column}"))
        out = out.join(best, F.col(column).eqNullSafe(F.col(f"_g_{column}")), "left")
        total = total - F.when(F.col(key) == F.col(f"_b_{column}"), 0).otherwise(penalty)
    return out.withColumn("final", F.greatest(total, F.lit(0))).select(*rows.columns, "final")


def budget_select(items: DataFrame, task: str, key: str, tokens: str, score: str, layer: str, budget: int, least: int) -> DataFrame:
    """Greedy choice for each task under a token budget: one item of each layer first, then by score.

    task, key, accepted, reason. The choice depends on what was chosen before, so a task's candidates
    are one group; a task's candidates are bounded by the retrieval that made them.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True])
        used, seen, out = 0, set(), {}
        for first in (True, False):
            for row in pdf.itertuples(index=False):
                k, n, s, where = (getattr(row, c) for c in (key, tokens, score, layer))
                if k in out and out[k][0] or first and where in seen:
                    continue
                if s < least:
                    out[k] = (False, "LOW_SCORE")
                elif used + n > budget:
                    out[k] = (False, "TOKEN_LIMIT")
                else:
                    used += n
                    seen.add(where)
                    out[k] = (True, "COVERAGE" if first else "UTILITY")
        return pd.DataFrame([(pdf[task].iloc[0], k, *v) for k, v in out.items()], columns=[task, key, "accepted", "reason"])

    kinds = dict(items.dtypes)
    return items.groupBy(task).applyInPandas(choose, f"{task} {kinds[task]}, {key} {kinds[key]}, accepted boolean, reason string")


def metrics(ranked: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """precision, recall, mrr, ndcg10 of ranked (key, rank) against expected (key). Both empty counts as 1."""
    hits = ranked.join(expected.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    a = hits.agg(F.count("*").alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("hit"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"), F.coalesce(F.sum(F.when((F.col("_hit") == 1) & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"))
    b = expected.select(key).distinct().agg(F.count("*").alias("want"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("want"), F.lit(10))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    x = a.join(b, F.lit(True))
    empty = F.col("want") == 0
    return x.select(
        F.when(empty, 1.0).when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("hit") / F.greatest("n", F.lit(1)), 6)).alias("precision"), F.when(empty, 1.0).otherwise(F.round(F.col("hit") / F.greatest("want", F.lit(1)), 6)).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.when(empty, 1.0).otherwise(F.round(F.col("dcg") / ideal, 6)).alias("ndcg10"),
    )
