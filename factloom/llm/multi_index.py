"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves, each with a codebook of its own (k-means on a
bounded sample). A vector's cell is its pair of nearest codewords, within its label. From a vector,
the multi-sequence algorithm visits cells of the product grid in order of distance: both lists of
codewords are sorted, and a heap holds the frontier. It stops when a cell is farther than the vector's
own by more than a margin, set so that the target recall is reached: on the sample, each
vector gets a partner at exactly the least cosine in a random direction. A pair is found if either
side visits the other's cell, so the margin is the ``target`` quantile of how much farther the other's
cell is, on the side where it is less. All members of visited cells are verified by cosine in double precision.

The codebooks are fitted on at most max(``sample``, ``FOR_WORD`` * ``MOST``) vectors, and have as many words as
make cells of about ``OCCUPANCY`` vectors of the largest label, up to 2 ** 24 cells (a billion
vectors a label); beyond that cells grow.

Cells are split into tiles of bounded size by a hash, so that a cell that holds a third of all
vectors is spread over many tasks, and a task returns counts and a spanning forest, never pairs.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, and rows
without a label or an id, link with nothing. Only vectors of the most frequent dimension are
indexed by halves of it; others meet in a cell for each dimension. Rows that repeat an id link like any
others and share its component. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest, partitions, read

LEAST, SAMPLE, TARGET, TILE, OCCUPANCY = 0.93, 20_000, 0.999, 1024, 64
FEWEST, MOST = 4, 4096  # codewords for each half, so at most 2 ** 24 cells
FOR_WORD = 8  # sampled vectors for each codeword, at least
PASSES, SEED = 8, 5


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(PASSES):
        near = np.concatenate([distances(x[a : a + 2048], words).argmin(axis=1) for a in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None, :])


def traverse(one: np.ndarray, two: np.ndarray, margin: float) -> list[int]:
    """Cells (i * K + j) in order of one[i] + two[j], up to margin beyond the nearest."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    x, y, k = one[a].tolist(), two[b].tolist(), len(one)
    limit, heap, seen, out = x[0] + y[0] + margin, [(x[0] + y[0], 0, 0)], {(0, 0)}, []
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        out.append(a[i] * k + b[j])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < k and v < k and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (x[u] + y[v], u, v))
    return out


def codewords(n: int) -> int:
    """For each half, given the vectors of the largest label: about ``OCCUPANCY`` of them a cell."""
    return int(min(MOST, max(FEWEST, round((n / OCCUPANCY) ** 0.5))))


class Index:
    def __init__(self, sample: np.ndarray, n: int, least: float, target: float):
        """sample: unit vectors of one dimension; n: vectors of the largest label."""
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        k = min(codewords(n), len(sample))
        self.cut = (self.dim + 1) // 2
        self.words = [k_means(h, k, rng) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        some = sample[rng.permutation(len(sample))[:4000]]
        away = rng.normal(size=some.shape)
        away -= (away * some).sum(axis=1, keepdims=True) * some
        size = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, size, out=np.zeros_like(away), where=size > 0)
        (one, two), (p, q) = self.near(some), self.near(least * some + (1 - least**2) ** 0.5 * away)
        r = np.arange(len(some))
        there = one[r, p.argmin(axis=1)] + two[r, q.argmin(axis=1)] - one.min(axis=1) - two.min(axis=1)
        back = p[r, one.argmin(axis=1)] + q[r, two.argmin(axis=1)] - p.min(axis=1) - q.min(axis=1)
        excess = np.minimum(there, back)
        self.margin = float(np.quantile(excess, target)) if len(excess) else 0.0

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.cut], self.words[0]), distances(x[:, self.cut :], self.words[1])

    def cells(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits; its own comes first."""
        return [traverse(a, b, self.margin) for at in range(0, len(x), 1024) for a, b in zip(*self.near(x[at : at + 1024]))]


KEPT = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("v", pa.binary())])


def unit(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim, v (doubles of a vector of length 1; null if the row links with nothing)."""

    def run(batches):
        for b in batches:
            lists = b.column(2).cast(pa.large_list(pa.float64()))
            at = lists.offsets.to_numpy()
            length = np.diff(at)
            flat = lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
            usable = (length > 0) & lists.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * len(length)
            for d in np.unique(length[usable]).tolist():
                i = np.flatnonzero(usable & (length == d))
                x = flat[at[:-1][i][:, None] + np.arange(d)]
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                i, x = i[ok], x[ok] / top[ok, None]  # scaling first keeps squares finite
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                for k, row in zip(i.tolist(), x):
                    out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(length, pa.int32()), pa.array(out, pa.binary())], schema=KEPT)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, v binary")


def link(scratch: Scratch, rows: DataFrame, least: float, sample: int, target: float, tile: int) -> DataFrame:
    """For rows (row, vec_id, label, dim, v): (row, n) partial counts of links and (a, b) edges of vec_ids."""
    spark = rows.sparkSession
    usable = rows.where("v is not null")
    largest = usable.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = max(sample, FOR_WORD * codewords(largest))  # at most 32,768 unless more are asked for
    dims = usable.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = dims["dim"] if dims else 0
    some = usable.where(F.col("dim") == dim).select("v", F.xxhash64("row", F.lit(3)).alias("h")).orderBy("h").limit(wanted).select("v").toPandas()["v"]
    index = Index(np.frombuffer(b"".join(some), np.float64).reshape(len(some), dim), largest, least, target) if len(some) else None
    kind = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("cells", pa.list_(pa.int32()))])

    def place(batches):
        for b in batches:
            length = b.column(3).to_numpy()
            cells: list = [[-d] for d in length.tolist()]
            same = np.flatnonzero(length == dim)
            if len(same):
                raw = b.column(4).to_pylist()
                x = np.frombuffer(b"".join(raw[i] for i in same.tolist()), np.float64).reshape(len(same), dim)
                for i, c in zip(same.tolist(), index.cells(x)):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(cells, kind.field("cells").type)], schema=kind)

    placed = scratch.cut(usable.select("row", "vec_id", "label", "dim", "v").mapInArrow(place, "row long, vec_id long, label string, v binary, cells array<int>"))
    visits = placed.select("row", "vec_id", "label", "v", "cells", F.posexplode("cells").alias("turn", "cell"))
    sizes = visits.groupBy("label", "cell").agg(F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).alias("members"), F.count("*").alias("guests"))
    sizes = scratch.cut(
        sizes.where("guests > 1 and members > 0").select("label", "cell", F.ceil(F.col("members") / tile).cast("int").alias("data_tiles"), F.ceil(F.col("guests") / tile).cast("int").alias("query_tiles"))
    )
    met = visits.join(sizes, ["label", "cell"])
    hashed = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["label", "cell"]
    queries = met.withColumn("q", hashed("query_tiles")).select(*own, "q", all_of("data_tiles").alias("d"), F.lit(True).alias("asks"), "row", "vec_id", "v", "cells")
    data = met.where("turn = 0").withColumn("d", hashed("data_tiles")).select(*own, all_of("query_tiles").alias("q"), "d", F.lit(False).alias("asks"), "row", "vec_id", "v", "cells")
    keys = [*own, "q", "d"]
    out = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.RecordBatch:
        asks = t["asks"].to_numpy(zero_copy_only=False)
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        none = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in out], schema=out)
        if not len(q) or not len(d):
            return none
        row, ids, cells = t["row"].to_numpy(), t["vec_id"].to_numpy(), t["cells"].to_pylist()
        x = np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(len(row), -1)
        i, j = np.nonzero(x[q] @ x[d].T >= least)
        i, j = q[i], d[j]
        apart = row[i] != row[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return none
        # the other side counts the link itself if it visits this side's cell
        home = np.array([c[0] for c in cells])
        wide = 1 << 32
        seen = np.array(sorted({k * wide + (c & 0xFFFFFFFF) for k in set(j.tolist()) for c in cells[k]}), dtype=np.int64)
        alone = ~np.isin(j * wide + (home[i] & 0xFFFFFFFF), seen)
        n = np.bincount(i, minlength=len(row)) + np.bincount(j[alone], minlength=len(row))
        at = np.flatnonzero(n)
        names, spot = np.unique(ids, return_inverse=True)
        root = forest(spot[i], spot[j], len(names))
        far = np.flatnonzero(root != np.arange(len(root)))
        blank = lambda k: [None] * k
        return pa.RecordBatch.from_arrays(
            [pa.array([*row[at].tolist(), *blank(len(far))], pa.int64()), pa.array([*n[at].tolist(), *blank(len(far))], pa.int64()), pa.array([*blank(len(at)), *names[far].tolist()], pa.int64()), pa.array([*blank(len(at)), *names[root[far]].tolist()], pa.int64())], schema=out)

    def units(batches):
        held, last = [], None
        for b in batches:
            key = list(zip(*(b.column(c).to_pylist() for c in range(4))))
            start = 0
            for k in range(1, len(key) + 1):
                if k == len(key) or key[k] != key[start]:
                    if key[start] != last and held:
                        yield compare(pa.Table.from_batches(held))
                        held = []
                    held.append(b.slice(start, k - start))
                    last, start = key[start], k
        if held:
            yield compare(pa.Table.from_batches(held))

    dealt = queries.unionAll(data).repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return scratch.cut(dealt.mapInArrow(units, "row long, n long, a long, b long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST, sample: int = SAMPLE, target: float = TARGET, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.cut(unit(vectors, id_col, vec_col, label_col).withColumn("row", F.monotonically_increasing_id()))
    found = link(scratch, rows, least, sample, target, tile)
    counts = found.where("row is not null").groupBy("row").agg(F.sum("n").alias("n_links"))
    comp = components(scratch, found.where("a is not null").select("a", "b")).withColumnRenamed("node", "vec_id")
    out = rows.select("row", "vec_id").join(counts, "row", "left").join(comp, "vec_id", "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))


def op2_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
