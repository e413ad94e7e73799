"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of all words. A
target stops at twice its source's words; what is cut off is shared by weight among the others until
none is above. A source's target is met by whole documents: all of them once if the target allows,
and for the rest of the budget a choice of documents by exact word count. Document counts by length
go to one task for each source (as many rows as there are lengths, however many documents); there a
proportional share of each length is taken, and bounded-knapsack dynamic programming over the
remaining lengths, as a bit set of reachable sums, fits what remains. How many documents of a length
are taken is then turned into which ones by a seeded hash: cells of the hash order are counted, so
that no window holds a whole length of a hot source.

Defined results: a null text has size 0; documents of size 0 are never taken; a null doc_id takes
part like any other; rows that repeat a doc_id are documents of their own; an empty table gives an
empty result. Only the columns named are read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, free_prefix, numbered, read

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 17
RESERVE = 1 << 14  # words that the exact fit works on, at least
BROADCAST_BYTES = 64 << 20


def count_words(text: str):
    """Runs of bytes other than ASCII white space."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    blank = lambda k: F.when(F.element_at(parts, k) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - blank(1) - blank(-1), F.lit(0)).cast("long")


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length make a sum nearest to budget; a bounded knapsack over a bit set."""
    reach, before, items, limit = 1, [], [], 2 * budget + 1
    mask = (1 << limit) - 1
    for i in range(len(lengths)):
        left, part = min(counts[i], budget // lengths[i] + 1), 1
        while left > 0 and not reach >> budget & 1:
            n = min(part, left)
            before.append(reach)
            items.append((i, n))
            reach = (reach | reach << n * lengths[i]) & mask
            left, part = left - n, part * 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << budget + 1) - 1)).bit_length() - 1
    above = reach >> budget
    above = budget + (above & -above).bit_length() - 1 if above else math.inf
    at = below if budget - below <= above - budget else above
    out = [0] * len(lengths)
    for (i, n), was in zip(reversed(items), reversed(before)):
        if not was >> at & 1:
            at -= n * lengths[i]
            out[i] += n
    return out


def plan(lengths: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """Copies of every document, and how many documents of each length get one more."""
    total = sum(a * b for a, b in zip(lengths, counts))
    copies = min(int(target // total), int(MOST)) if total else 0
    left = max(0.0, target - copies * total) if copies < MOST else 0.0
    more = [int(n * left / total) for n in counts] if total else [0] * len(counts)
    left -= sum(a * b for a, b in zip(lengths, more))
    spare = [n - m for n, m in zip(counts, more)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # large documents first, to the reserve
        n = min(spare[i], max(0, int((left - RESERVE) // lengths[i])))
        more[i], spare[i], left = more[i] + n, spare[i] - n, left - n * lengths[i]
    for i, n in enumerate(fit(lengths, spare, max(0, round(left)))):
        more[i] += n
    return copies, more


def columns(source_col: str, text_col: str, id_col: str, seed: int) -> list:
    """src, size and h, the seeded place of a document in the order in which documents are taken."""
    return [
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("src"),
        count_words(text_col).alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"),
    ]


def budgets(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with src, size and cell: (src, source_size, target), and what is taken of each cell:
    (src, size, cell, n, before, base, more), before being the documents of lower cells."""
    counts = scratch.cut(docs.groupBy("src", "size", "cell").agg(F.count("*").alias("n")))
    # one row a source from here on
    sources = counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("src")) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS) + 1).cast("double")
    )
    ranked = ranked.withColumn("most", MOST * F.col("source_size"))
    by = W.orderBy(F.col("most") / F.col("weight"), "rank")
    upto, from_ = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(0))
    # sources in the order in which they reach their limit; the level at which the others stand then
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(from_)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("most") / F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    targets = scratch.cut(
        levels.select("src", "source_size", F.least(F.coalesce(first * F.col("weight"), F.col("most")), F.col("most")).alias("target"))
    )

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        lengths, n = pdf["size"].tolist(), pdf["n"].tolist()
        copies, more = plan(lengths, n, float(pdf["target"].iloc[0]))
        return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "base": copies, "more": more})

    lengths = counts.where("size > 0").groupBy("src", "size").agg(F.sum("n").alias("n")).join(targets, "src")
    chosen = lengths.groupBy("src").applyInPandas(planned, "src string, size long, base long, more long")
    before = F.sum("n").over(W.partitionBy("src", "size").orderBy("cell")) - F.col("n")
    return targets, scratch.cut(counts.where("size > 0").withColumn("before", before).join(chosen, ["src", "size"]))


def cell(h: str) -> F.Column:
    return F.shiftrightunsigned(h, 56).cast("int")


def draw(scratch: Scratch, docs: DataFrame, source_col: str, text_col: str, seed: int, id_col: str) -> DataFrame:
    """id, size, source_size, target, copies for every row."""
    docs = docs.select(F.col(id_col).alias("key"), *columns(source_col, text_col, id_col, seed))
    docs = scratch.cut(docs.withColumn("cell", cell("h")))
    targets, cells = budgets(scratch, docs)
    place = F.row_number().over(W.partitionBy("src", "size", "cell").orderBy("h", "key"))
    found = docs.join(cells.drop("n"), ["src", "size", "cell"], "left").withColumn("place", place)
    copies = F.when(F.col("size") > 0, F.col("base") + F.when(F.col("before") + F.col("place") <= F.col("more"), 1).otherwise(0)).otherwise(0)
    return found.withColumn("copies", copies.cast("long")).join(targets, "src").select(F.col("key").alias(id_col), "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every row."""
    drawn = draw(Scratch(docs.sparkSession), docs, source_col, text_col, seed, id_col)
    return drawn.select(F.col(id_col).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, 0, 1 or 2 times.

    What is taken of a source's documents of one size is the start of a seeded order, so a document
    needs only the copies of all of them and the last place that gets one more: one row for each
    source and size, broadcast if measured to be within ``BROADCAST_BYTES`` and joined like any table
    otherwise. Texts are not copied. A place is (hash of doc_id, hash of the text, file and row of
    the input); the last part only decides between rows that repeat.

    Null texts and texts without words are never taken; a null doc_id, a null source and rows that
    repeat take part as rows of their own; an empty table stays empty; other columns pass unread.
    """
    scratch, name = Scratch(spark), free_prefix(docs, "mix_")
    src, size, h = columns("source", "text", "doc_id", SEED)
    parts = {"src": src, "size": size, "h": h, "text": F.xxhash64("text")}
    found = numbered(scratch, docs, f"{name}row").withColumns({f"{name}{k}": c for k, c in parts.items()})
    keys = scratch.cut(found.select(*(F.col(f"{name}{k}").alias(k) for k in (*parts, "row"))).withColumn("cell", cell("h")))
    _, cells = budgets(scratch, keys)
    order = lambda prefix: F.struct(cell(f"{prefix}h").alias("cell"), *(F.col(f"{prefix}{k}").alias(k) for k in ("h", "text", "row")))
    ends = keys.join(cells.where("before < more and more <= before + n"), ["src", "size", "cell"])
    ends = ends.withColumn("place", F.row_number().over(W.partitionBy("src", "size").orderBy("h", "text", "row"))).where("place = more - before")
    limits = cells.groupBy("src", "size").agg(F.max("base").alias("base")).join(ends.select("src", "size", order("").alias("end")), ["src", "size"], "left")
    limits = scratch.cut(limits.select(F.col("src").alias(f"{name}src"), F.col("size").alias(f"{name}size"), F.col("base").alias(f"{name}base"), F.col("end").alias(f"{name}end")))
    scratch.drop(keys)
    scratch.drop(cells)
    held = limits.agg(F.sum(F.octet_length(f"{name}src") + 64)).first()[0] or 0
    met = found.join(F.broadcast(limits) if held <= BROADCAST_BYTES else limits, [f"{name}src", f"{name}size"])
    copies = F.col(f"{name}base") + F.when(order(name) <= F.col(f"{name}end"), 1).otherwise(0)
    return met.withColumn(f"{name}n", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
