"""Aggregates, integrity checks, paging, telemetry and snapshot comparisons over fact rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import settle


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(check, n): rows whose key no parent has."""
    lost = child.select(F.col(key).alias("k")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return lost.agg(F.lit(name).alias("check"), F.count("*").alias("n")).select("check", "n")


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, n): keys that more than one row has."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.lit(name).alias("check"), F.count("*").alias("n")).select("check", "n")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in total order with its position, the total and whether more follow.

    Only offset + limit rows are ever ordered (top-k), the total is a count of its own.
    """
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order).limit(offset + limit)
    numbered = top.withColumn("position", F.row_number().over(W.orderBy(*order))).where(F.col("position") > offset)
    return numbered.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)


def runtime_edges(events: DataFrame, source: str, target: str, value: str, ts: str) -> DataFrame:
    """Running aggregate of observed edges; sums are exact decimals."""
    return events.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(
        F.count("*").alias("observations"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"), F.max(value).alias("largest"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
    )


def merge_runtime_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two such aggregates as one."""
    return old.unionByName(new).groupBy("source", "target").agg(
        F.sum("observations").alias("observations"), F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("total"), F.max("largest").alias("largest"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def retain(df: DataFrame, order: list, most: int) -> DataFrame:
    """The newest ``most`` rows."""
    return df.orderBy(*order).limit(most)


def inherit(spans: DataFrame, trace: str, span: str, parent: str, cols: list[str]) -> DataFrame:
    """Empty columns take the parent span's value."""
    up = spans.select(F.col(trace).alias("_t"), F.col(span).alias("_s"), *(F.col(c).alias(f"_{c}") for c in cols))
    joined = spans.join(up, (F.col(trace) == F.col("_t")) & (F.col(parent) == F.col("_s")), "left")
    return joined.select(*(c for c in spans.columns if c not in cols), *(F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"_{c}"), F.lit(""))).alias(c) for c in cols))


def span_depths(spans: DataFrame, trace: str, span: str, parent: str) -> DataFrame:
    """trace, span, root, depth: by pointer jumping, so a trace of n spans takes at most log2(n) joins."""
    most = spans.groupBy(trace).count().agg(F.max("count")).first()[0] or 1
    known = spans.select(F.col(trace).alias("t"), F.col(span).alias("s"))
    now = spans.select(F.col(trace).alias("t"), F.col(span).alias("s"), F.col(parent).alias("p")).join(
        known.withColumnRenamed("s", "p").withColumn("has", F.lit(1)), ["t", "p"], "left"
    )
    now = now.select("t", "s", F.when(F.col("has") == 1, F.col("p")).otherwise(F.col("s")).alias("up"), F.coalesce("has", F.lit(0)).alias("depth"))
    for _ in range((most - 1).bit_length()):
        now = settle(now)
        above = now.select("t", F.col("s").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        now = now.join(above, ["t", "up"]).select("t", "s", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
    return now.select(F.col("t").alias("trace"), F.col("s").alias("span"), F.col("up").alias("root"), "depth")


def trace_forest(spans: DataFrame, trace: str, span: str, parent: str, service: str, operation: str, status: str, duration: str) -> DataFrame:
    """For each trace: roots, spans, deepest level, services in order, database operations, whether a status is an
    error (400 or more), the longest duration and a one-line summary. Spans without a service are of unknown_service."""
    levels = span_depths(spans, trace, span, parent).groupBy("trace").agg(F.countDistinct("root").alias("roots"), F.max("depth").alias("deepest"))
    name = F.coalesce(F.nullif(F.col(service), F.lit("")), F.lit("unknown_service"))
    found = spans.groupBy(F.col(trace).alias("trace")).agg(
        F.count("*").alias("spans"), F.array_sort(F.collect_set(name)).alias("services"), F.count(F.nullif(F.col(operation), F.lit(""))).alias("db_queries"),
        F.coalesce(F.max(F.col(status) >= 400), F.lit(False)).alias("has_errors"), F.coalesce(F.max(duration), F.lit(0.0)).cast("double").alias("duration_ms"),
    )
    text = F.format_string("Trace %s: %d spans across %d service(s), %d DB queries, total duration %.1fms.", F.substring(F.col("trace").cast("string"), 1, 8), "spans", F.size("services"), "db_queries", "duration_ms")
    return found.join(levels, "trace").withColumn("summary", text)


def reconcile(expected: DataFrame, observed: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, status, other. Expected and observed hold (source, target).

    Equal pairs are CONFIRMED. An expected pair whose source was only observed with other, unexpected
    targets is a CONFLICT with the first of them. Else it is NOT_OBSERVED. What is left is RUNTIME_ONLY.
    """
    e = expected.select(source, target).distinct().withColumn("e", F.lit(1))
    o = observed.select(source, target).distinct().withColumn("o", F.lit(1))
    both = e.join(o, [source, target], "full")
    spare = both.where("e is null").groupBy(source).agg(F.min(target).alias("spare"))
    confirmed = both.where("e = 1 and o = 1").select(source).distinct().withColumn("confirmed", F.lit(1))
    found = both.join(spare, source, "left").join(confirmed, source, "left")
    conflict = F.col("spare").isNotNull() & F.col("confirmed").isNull()
    status = F.when(F.col("e").isNull(), "RUNTIME_ONLY").when(F.col("o") == 1, "CONFIRMED").when(conflict, "CONFLICT").otherwise("NOT_OBSERVED")
    return found.select(source, target, status.alias("status"), F.when(F.col("e").isNotNull() & F.col("o").isNull() & conflict, F.col("spare")).alias("other"))


def last_before(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before it: as-of join by union and one window."""
    cols = left.columns
    one = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1))
    two = right.select(key, order, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    every = one.unionByName(two, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(order, "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    return every.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, value)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts of events of a key that are at most gap apart."""
    s = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return s.select(key, "started", "ended", "events")


def change_batches(changes: DataFrame, key: str, path: str, ts: str, gap: float, most: int = 100) -> DataFrame:
    """key, batch, started, ended, paths: bursts of changed paths that are at most gap seconds apart, closed
    early when ``most`` different paths wait. A burst is one group, so a burst must fit in a task."""
    seconds = F.col(ts).cast("timestamp").cast("double")
    by = W.partitionBy(key).orderBy(ts, path)
    new = F.when(seconds - F.lag(seconds).over(by) <= gap, 0).otherwise(1)
    x = changes.select(key, path, ts).withColumn("_new", new).withColumn("_burst", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))

    def cut(pdf):
        waiting, number, out = set(), [], 0
        for p in pdf.sort_values([ts, path])[path]:
            number.append(out)
            waiting.add(p)
            if len(waiting) >= most:
                waiting, out = set(), out + 1
        return pdf.sort_values([ts, path]).assign(_part=number)[[key, "_burst", "_part", path, ts]]

    kinds = dict(changes.dtypes)
    x = x.withColumn("_n", F.count("*").over(W.partitionBy(key, "_burst")))
    whole = x.where(F.col("_n") < most).select(key, "_burst", F.lit(0).cast("long").alias("_part"), path, ts)  # too few to be closed early
    long_ = x.where(F.col("_n") >= most).select(key, "_burst", path, ts).groupBy(key, "_burst")
    parts = whole.unionByName(long_.applyInPandas(cut, f"`{key}` {kinds[key]}, _burst long, _part long, `{path}` {kinds[path]}, `{ts}` {kinds[ts]}"))
    out = parts.groupBy(key, "_burst", "_part").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.countDistinct(path).alias("paths"))
    return out.withColumn("batch", F.row_number().over(W.partitionBy(key).orderBy("_burst", "_part"))).select(key, "batch", "started", "ended", "paths")


def compare(base: DataFrame, head: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status of each row that differs: ADDED, REMOVED, MODIFIED."""
    b, h = base.select(key, F.col(digest).alias("b")), head.select(key, F.col(digest).alias("h"))
    status = F.when(F.col("b").isNull(), "ADDED").when(F.col("h").isNull(), "REMOVED").when(F.col("b") != F.col("h"), "MODIFIED")
    return b.join(h, key, "full").select(key, status.alias("status")).where("status is not null")


def replace_paths(old: DataFrame, new: DataFrame, dirty: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """The next generation: facts of dirty keys come from new; keys that failed keep their last facts."""
    gone = dirty.select(key).distinct()
    if failed is not None:
        gone = gone.join(failed.select(key).distinct(), key, "left_anti")
    return old.join(gone, key, "left_anti").unionByName(new.join(gone, key, "left_semi"))


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, tile: int = 1 << 15, block: int = 1 << 10) -> DataFrame:
    """query_id, vec_id, rank, cosine: for each query (query_id, q) the k nearest vectors (vec_id, embedding) but itself.

    Blocks of queries meet tiles of vectors, and only the k best of each meeting go on. Vectors that are null,
    zero or hold null or non-finite components, and those of another length than the query, take no part.
    """
    one = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.lit(False).alias("asks"))
    two = queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("v"), F.lit(True).alias("asks"))
    tiles, blocks = (max(1, -(-df.count() // n)) for df, n in ((one, tile), (two, block)))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = one.withColumn("t", part(tiles)).withColumn("b", every(blocks)).unionByName(two.withColumn("b", part(blocks)).withColumn("t", every(tiles)))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def nearest(t: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "cosine": []}
        ids, asks = t["id"].to_numpy(), t["asks"].to_numpy()
        lists = t["v"].combine_chunks()
        length = lists.value_lengths().fill_null(0).to_numpy()
        start, flat = lists.offsets.to_numpy()[:-1], lists.values.to_numpy(zero_copy_only=False)
        for d in np.unique(length[length > 0]).tolist():
            i = np.flatnonzero(length == d)
            x = flat[start[i][:, None] + np.arange(d)]
            size = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(size) & (size > 0)
            i, x = i[good], x[good] / size[good, None]
            q, c = np.flatnonzero(asks[i]), np.flatnonzero(~asks[i])
            for a in q.tolist():
                score = x[c] @ x[a]
                own = ids[i[c]] != ids[i[a]]
                score, names = score[own], ids[i[c]][own]
                least = np.partition(score, -k)[-k] if len(score) > k else -2.0
                near = np.flatnonzero(score >= least - 1e-9)  # ties with the last stay in; the window decides
                found["query_id"] += [int(ids[i[a]])] * len(near)
                found["vec_id"] += names[near].tolist()
                found["cosine"] += (x[c][own][near] * x[a]).sum(axis=1).tolist()  # equal vectors get equal sums
        return pa.table(found, schema=out)

    pairs = met.groupBy("t", "b").applyInArrow(nearest, "query_id long, vec_id long, cosine double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "cosine")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
