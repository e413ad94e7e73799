"""Quality scores from random-indexing word vectors and a small calibrated network.

Every word has two names: itself in lower case, and its shape (letters by case, digits, signs, runs
shortened). Names hash to rows of a table. Each row has a random sparse index vector; a row's word
vector is its index vector plus the scaled sum of the index vectors of its neighbours in the training
texts. A text is the mean of its words' vectors, names and shapes apart. A network of two
layers is trained by numpy, and a temperature fitted on rows set apart makes its scores
probabilities.

Training uses a bounded sample of the labelled rows: at most ``SAMPLE`` of them, those with the smallest
hash of doc_id, never rows whose crc32(doc_id as text) is divisible by ``FOLDS``. What the driver gets
is bounded too: word vectors of fixed size from ``PARTS`` tasks, and one vector for each sampled row.
Labels, languages, sources and ids are not inputs of a score.

Defined results: null and empty texts have the score of a text without words; a null doc_id is not
held out, nor learned from; rows that repeat a doc_id are scored each; of labels that repeat, the
greatest counts; labels that are null do not. Without labels, or with one class only, every score is the
share of class 1 (1/2 if there is none). An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

SAMPLE, FOLDS, PARTS, KEEP = 8000, 5, 8, 0.3
NAMES, SHAPES, WIDE, NEAR = 1 << 13, 1 << 10, 64, 2
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 60, 3e-3, 1e-4, 23
WORDS_AT_ONCE, CACHE = 1 << 16, 500_000

SHAPE = bytes(ord("0") if 48 <= b < 58 else ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class Rows(dict):
    """Word -> name row * SHAPES + shape row."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        shape = RUNS.sub(rb"\1", word.translate(SHAPE))
        out = xxhash.xxh32_intdigest(word.lower()) % NAMES * SHAPES + xxhash.xxh32_intdigest(shape) % SHAPES
        if len(word) < 40:
            self[word] = out
        return out


def rows_of(text: bytes | None, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([rows[w] for w in (text or b"").split()], dtype=np.int64)
    return both // SHAPES, both % SHAPES


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.choice(np.array([-1, 0, 1], np.float32), size=(n, WIDE), p=[0.05, 0.9, 0.05]) for n in (NAMES, SHAPES))


def add_rows(table: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    table[at[order][first]] += np.add.reduceat(values[order], first, axis=0)


def context_sums(texts, names: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of neighbours for each row of both tables."""
    total, rows = np.zeros((NAMES + SHAPES, WIDE), np.float32), Rows()
    for text in texts:
        a, b = rows_of(text, rows)
        for at in range(0, len(a), WORDS_AT_ONCE):
            x, y = a[at : at + WORDS_AT_ONCE], b[at : at + WORDS_AT_ONCE]
            own = names[x] + shapes[y]
            near = np.zeros_like(own)
            for k in range(1, NEAR + 1):
                near[k:] += own[:-k]
                near[:-k] += own[k:]
            add_rows(total, x, near)
            add_rows(total, y + NAMES, near)
    return total


class Vectors:
    def __init__(self, sums: np.ndarray):
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        base = np.concatenate(index_vectors())
        size = np.linalg.norm(base, axis=1, keepdims=True)
        table = base + np.divide(sums, length, out=np.zeros_like(sums), where=length > 0) * size
        self.names, self.shapes = table[:NAMES], table[NAMES:]

    def pool(self, text: bytes | None, rows: Rows) -> np.ndarray:
        a, b = rows_of(text, rows)
        n = max(1, len(a))
        one = np.bincount(a, minlength=NAMES).astype(np.float32) @ self.names if len(a) > 4096 else self.names[a].sum(axis=0)
        two = np.bincount(b, minlength=SHAPES).astype(np.float32) @ self.shapes if len(b) > 512 else self.shapes[b].sum(axis=0)
        return np.concatenate([one, two]) / n


class Network:
    """tanh layer, then a logistic one; a temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        apart = order[: len(x) // 5] if len(x) >= 50 else order
        fit = order[len(x) // 5 :] if len(x) >= 50 else order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(max(EPOCHS, 2000 * 64 // max(1, len(fit)) // 4)):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[at]) / len(at)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[at].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit = self.logits(x[apart])
        loss = lambda s: np.logaddexp(0, np.where(y[apart] > 0, -logit, logit) / s).mean()
        self.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return (h @ self.p[2] + self.p[3]) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Vectors, Network | Constant]:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # the labelled rows may name documents that are not here, so the bound is drawn after the join by id
    here = docs.where("doc_id is not null").select("doc_id").distinct()
    picked = scratch.cut(known.join(here, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = scratch.cut(texts.repartition(PARTS, "doc_id"))
    base = index_vectors()

    def sums(batches):
        got = context_sums((t for b in batches for t in b.column(0).to_pylist()), *base)
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((NAMES + SHAPES, WIDE), np.float32)
    for r in texts.select("text").coalesce(PARTS).mapInArrow(sums, "sums binary").collect():
        total += np.frombuffer(r.sums, np.float32).reshape(total.shape)
    vectors = Vectors(total)

    def pools(batches):
        rows = Rows()
        for b in batches:
            data = [vectors.pool(t, rows).astype(np.float32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(data, pa.binary())], names=["doc_id", "quality", "pool"])

    # one vector a sampled document; of rows that repeat a doc_id, the first by bytes
    found = texts.select("text", "doc_id", "quality").mapInArrow(pools, "doc_id long, quality int, pool binary")
    found = found.groupBy("doc_id").agg(F.min("pool").alias("pool"), F.max("quality").alias("quality")).toPandas().sort_values("doc_id")
    y = found["quality"].to_numpy(dtype=np.float64) if len(found) else np.zeros(0)
    if len(set(y)) < 2:
        return vectors, Constant(float(y.mean()) if len(y) else 0.5)
    x = np.frombuffer(b"".join(found["pool"]), np.float32).reshape(len(found), -1).astype(np.float64)
    return vectors, Network(x, y)


def scorer(vectors: Vectors, network: Network | Constant):
    """Column function of a text as bytes."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = Rows()
        for s in batches:
            x = np.array([vectors.pool(t, rows) for t in s], np.float64).reshape(len(s), 2 * WIDE)
            yield pd.Series(network.scores(x), index=s.index)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs' doc_id with held_out, score and predicted."""
    scratch = Scratch(docs.sparkSession)
    score = scorer(*train(scratch, docs.select("doc_id", "text"), labels.select("doc_id", "quality"), sample))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("binary")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of low quality go."""
    score = scorer(*train(Scratch(spark), docs.select("doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")))
    return docs.where(score(F.col("text").cast("binary")) >= KEEP)


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
