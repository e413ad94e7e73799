"""Shared pieces: scratch tables in the shared folder, connected components, union-find, tiles."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


class Scratch:
    """Intermediate tables under ``spark.checkpoint.dir``, which every executor sees.

    Only a session without that setting on a local master (tests) gets a local folder; on a cluster
    it must be set. ``cut`` writes a frame and returns the frame read back, so a lost executor costs
    no more than the tasks it was running.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        self.root = f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[str] = []
        atexit.register(self.drop)

    def cut(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, n: int, key: str) -> DataFrame:
        """As cut, with the rows in n buckets by key: a join by key leaves them where they are."""
        self.n += 1
        name = f"{self.root.rsplit('/', 1)[-1]}_{self.n}".replace("-", "_")
        df.write.option("compression", "zstd").option("path", f"{self.root}/{self.n}").bucketBy(n, key).saveAsTable(name, format="parquet")
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove one table that ``cut`` made, or all of them."""
        path = self.root if df is None else df._scratch_path
        try:
            while df is None and self.tables:
                self.spark.sql(f"drop table if exists {self.tables.pop()}")
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if df is not None:
                raise  # at exit the session may be gone already


def numbered(scratch: Scratch, docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells any two rows apart: the hash of file and row that a row is read from.

    It is the same whenever the row is read again. Rows that are not read from files are written first.
    """
    try:
        row = docs.metadataColumn("_metadata")
        docs.select(row["row_index"]).schema  # is analysed here
    except AnalysisException:
        docs = scratch.cut(docs)
        row = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.xxhash64(row["file_path"], row["row_index"]))


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """prefix, lengthened until no column of docs begins with it."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star contraction. Each half round replaces the links of a node
    by links to the smallest neighbour; rounds are logarithmic in the longest path. No group is
    gathered: minima are partial aggregates, and the neighbour lists meet them in a join whose two
    sides are plain exchanges, which adaptive execution can split when a node has very many links.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    now = scratch.cut(oriented(edges.select("a", "b")))
    mark = None
    while True:
        pairs = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.cut(
            pairs.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        after = scratch.cut(oriented(small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        for df in (now, low, large, least):
            scratch.drop(df)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n items after joining items a[i] and b[i]: the smallest item of its group."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        far = ra != rb
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def rows(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)
