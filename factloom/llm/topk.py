"""Exact top-k by inner product, with vectors bucketed by length.

Candidates are sorted by length and dealt to tiles of neighbouring lengths; queries to blocks. Each
block first meets the tile of the longest candidates, which gives every query a k-th best score to
start with. A tile is skipped for a block if no query can reach its score by the tile's longest
vector. In a tile, a query's score divided by the two lengths is a local cosine threshold. Where it is
low, length alone prunes: candidates too short are dropped from the tile's end. Where it is
high, coordinates prune: the product over the query's largest coordinates plus the product of the
lengths of the rests bounds the score (Cauchy-Schwarz). Survivors are verified by whole products.

Scores are sums of products of integers. They are computed in doubles while they are exact there (below
2 ** 53), else in Python's integers; a score outside 64 bits is an error.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; an empty vector scores 0; vectors of another length than the query's score over the
components that both have; rows that repeat an id are candidates of their own, but never for
queries of the same id; as a query such an id counts once, with the greatest of its vectors; ties go to the smaller id. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions, read

SCALE, EVERY, K, TILE, BLOCK = 256.0, 50, 5, 4096, 512
FOCUS, STEEP = 16, 0.5  # coordinates of the partial product; cosine from which it is worth its cost
SLACK = 1.0 + 1e-9
EXACT = 2.0**53


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v): components floor(scale * x), x as double, for rows that take part."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.lit(scale) * x)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad).select(
        "vec_id", F.transform("v", lambda x: F.floor(x).cast("double")).alias("v")
    )


def blobs(rows: DataFrame, size: int, number: str) -> DataFrame:
    """Rows of up to size vectors: <number>, ids, dims, data, longest, shortest (lengths)."""
    kind = pa.schema([("ids", pa.binary()), ("dims", pa.binary()), ("data", pa.binary()), ("longest", pa.float64()), ("shortest", pa.float64())])

    def run(batches):
        def emit(ids, lists):
            dims = np.array([len(x) for x in lists], np.int64)
            data = np.zeros((len(ids), max(1, int(dims.max()))))
            for i, x in enumerate(lists):
                data[i, : len(x)] = x
            length = np.sqrt((data * data).sum(axis=1))
            cols = [np.array(ids, np.int64).tobytes(), dims.tobytes(), data.tobytes(), float(length.max()), float(length.min())]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, kind)], schema=kind)

        ids, lists = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            lists += [x.values.to_numpy() for x in b.column(1)]
            while len(ids) >= size:
                yield emit(ids[:size], lists[:size])
                ids, lists = ids[size:], lists[size:]
        if ids:
            yield emit(ids, lists)

    out = rows.select("vec_id", "v").mapInArrow(run, "ids binary, dims binary, data binary, longest double, shortest double")
    return out.withColumn(number, F.monotonically_increasing_id())


def matrix(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(d, 1) < EXACT:
        return (q @ v.T).astype(np.int64)
    wide = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in q], dtype=object).reshape(len(q), len(v))
    return wide.astype(np.int64)  # raises OverflowError outside 64 bits


def search(qids, q, vids, v, k: int, least: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each query, ids and scores of its k best candidates of a tile among those that score at
    least ``least``; ties to the smaller id. Candidates are in order of falling length."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    qlen, vlen = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-vlen, kind="stable")
    v, vids, vlen = v[order], vids[order], vlen[order]
    out_ids, out_scores = [np.zeros(0, np.int64)] * len(q), [np.zeros(0, np.int64)] * len(q)
    top = qlen * vlen[0] * SLACK
    cosine = np.divide(least, top, out=np.full(len(q), -1.0), where=top > 0)

    def take(i, ids, scores):
        good = (scores >= least[i]) & (ids != qids[i])
        ids, scores = ids[good], scores[good]
        best = np.lexsort((ids, -scores))[:k]
        out_ids[i], out_scores[i] = ids[best], scores[best]

    by_length = np.flatnonzero(cosine < STEEP)
    if len(by_length):
        # the shortest candidate that can still reach a query's score ends its part of the tile
        need = np.divide(least[by_length], qlen[by_length] * SLACK, out=np.full(len(by_length), -np.inf), where=qlen[by_length] > 0)
        need = np.where((qlen[by_length] == 0) & (least[by_length] > 0), np.inf, need)
        reach = np.searchsorted(-vlen, -need, side="right")
        scores = products(q[by_length], v[: reach.max(initial=0)])
        for i, n, s in zip(by_length.tolist(), reach.tolist(), scores):
            take(i, vids[:n], s[:n])
    for i in np.flatnonzero((cosine >= STEEP) & (cosine <= 1)).tolist():
        n = int(np.searchsorted(-vlen, -least[i] / (qlen[i] * SLACK), side="right"))
        focus = np.argpartition(-np.abs(q[i]), min(FOCUS, d) - 1)[: min(FOCUS, d)]
        part = v[:n, focus]
        rest = np.sqrt(np.maximum(0, vlen[:n] ** 2 - (part * part).sum(axis=1)))
        left = np.sqrt(max(0.0, qlen[i] ** 2 - (q[i, focus] ** 2).sum()))
        bound = part @ q[i, focus] + rest * left
        keep = np.flatnonzero(bound + 1e-6 * (1 + np.abs(bound)) >= least[i])
        take(i, vids[keep], products(q[i : i + 1], v[keep])[0])
    return out_ids, out_scores


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, scale: float = SCALE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose id is divisible by every."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = scratch.cut(whole_vectors(vectors, id_col, vec_col, scale))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    asked = scratch.cut(blobs(asked.repartition(asked.count() // block + 1, "vec_id"), block, "block"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    order = [F.col("n").desc(), F.col("vec_id")]
    dealt = rows.withColumn("n", length).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    tiles = scratch.cut(blobs(dealt, tile, "tile"))
    # one row for each tile from here: its place in order of length
    places = scratch.cut(tiles.select("tile", "longest").withColumn("place", F.row_number().over(W.orderBy(F.col("longest").desc(), "tile")) - 1))
    lengths = np.array([r.longest for r in places.orderBy("place").collect()])  # one number for every tile
    if not len(lengths):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tiles = tiles.join(F.broadcast(places.select("tile", "place")), "tile").select("place", "ids", "data")
    blocks = pa.schema([("qids", pa.binary()), ("qdata", pa.binary()), ("least", pa.binary()), ("n_tiles", pa.int32())])
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def start(batches):
        """Each query's k-th best score in the first tile, and how many tiles the block must see."""
        for b in batches:
            for r in range(b.num_rows):
                (qids, q), (vids, v) = (matrix(b.column(c)[r].as_py(), b.column(c + 1)[r].as_py()) for c in (0, 2))
                _, scores = search(qids, q, vids, v, k, np.full(len(qids), -np.inf))
                least = np.array([float(x[k - 1]) if len(x) >= k else -np.inf for x in scores])
                size = np.sqrt((q * q).sum(axis=1)) * SLACK
                need = np.where(least > 0, np.divide(least, size, out=np.full(len(q), np.inf), where=size > 0), -np.inf)
                n = int((lengths >= need.min()).sum())
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((qids.tobytes(), q.tobytes(), least.tobytes(), max(1, n)), blocks)], schema=blocks)

    def verify(batches):
        for b in batches:
            for r in range(b.num_rows):
                (qids, q), (vids, v) = (matrix(b.column(c)[r].as_py(), b.column(c + 1)[r].as_py()) for c in (0, 2))
                ids, scores = search(qids, q, vids, v, k, np.frombuffer(b.column(4)[r].as_py(), np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, [len(x) for x in ids])), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], schema=found)

    first = tiles.where("place = 0").withColumn("one", F.lit(1)).drop("place")  # one row of at most tile vectors
    seeded = asked.select(F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.lit(1).alias("one")).join(F.broadcast(first), "one")
    seeded = scratch.cut(seeded.select("qids", "qdata", "ids", "data").mapInArrow(start, "qids binary, qdata binary, least binary, n_tiles int"))
    # a block has a row for each tile here: by its size on disk Spark would take the blocks for small and broadcast all these copies
    pairs = seeded.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))).hint("merge").join(tiles, "place")
    scored = pairs.select("qids", "qdata", "ids", "data", "least").mapInArrow(verify, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
