"""Batches of whole texts, and question-and-answer rounds between batches and key buckets.

A batch is one row that holds some megabytes of whole texts. It is written once, so every later pass
sees the same texts in the same order. In a round each batch sends, for each bucket of keys, one blob
of distinct keys (a key that a third of all texts hold is one entry a batch, so no bucket is hot);
a bucket answers each blob with one small blob, aligned to its entries. Only keys and answers are
shuffled, as binary blobs, at any size: the table of batches is bucketed by batch number, so answers
come to where the texts are. A task that makes batches numbers them so that they fall into one bucket,
and writes one file.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

BATCH_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


@dataclass
class Batch:
    number: int
    ids: np.ndarray  # int64; NO_ID for null
    named: np.ndarray  # bool
    ends: np.ndarray  # of each text in data
    data: np.ndarray  # uint8
    answers: list[dict[int, bytes]]  # one dict of bucket -> blob for each round so far

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def bucket_of(number: np.ndarray, n: int) -> np.ndarray:
    """The bucket of n into which Spark puts a long: its 32-bit Murmur3 hash with seed 42, modulo n.

    Another hash would only spread a task's batches over more files.
    """
    u = np.uint32
    turn = lambda x, k: x << u(k) | x >> u(32 - k)
    h = np.full(len(number), 42, u)
    for half in (number & 0xFFFFFFFF, number >> 32):
        h = turn(h ^ turn(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32).astype(np.int64) % n


def numbers(task: int, n: int) -> Iterator[int]:
    """Numbers of a task's batches, all in bucket task % n."""
    for at in itertools.count(0, 4096):
        some = (np.int64(task) << 32) + np.arange(at, at + 4096, dtype=np.int64)
        yield from some[bucket_of(some, n) == task % n].tolist()


SCHEMA = "batch long, ids binary, named binary, ends binary, data binary"


def make_batches(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each batch; a text of more than BATCH_BYTES has its own."""
    limit, n = BATCH_BYTES, partitions(docs.sparkSession)
    schema = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("ids", "named", "ends", "data"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers(TaskContext.get().partitionId(), n)
        number, ids, named, texts, size = next(own), [], [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64())]
                + [pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(named, np.bool_).tobytes(), ends.tobytes(), b"".join(texts))],
                schema=schema,
            )

        for b in batches:
            texts_in = pc.fill_null(b.column(1).cast(pa.large_binary()), b"").to_pylist()
            for d, t in zip(b.column(0).to_pylist(), texts_in):
                if texts and size + len(t) > limit:
                    yield row()
                    number, ids, named, texts, size = next(own), [], [], [], 0
                ids.append(NO_ID if d is None else d)
                named.append(d is not None)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    return scratch.bucketed(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA), n, "batch")


def each(table: DataFrame, work: Callable[[Batch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                number, ids, named, ends, data = (b.column(k)[i] for k in range(5))
                got = [{x["bucket"]: x["blob"] for x in b.column(k)[i].as_py() or []} for k in range(5, b.num_columns)]
                yield from work(
                    Batch(number.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(named.as_buffer(), np.bool_), np.frombuffer(ends.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.uint8), got)
                )

    return table.mapInArrow(run, schema)


MAIL = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("blob", pa.large_binary())])


def mail(number: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(blobs), pa.int64()), pa.array([k for k, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.large_binary())], schema=MAIL
    )


def ask(
    scratch: Scratch,
    table: DataFrame,
    question: Callable[[Batch], list[tuple[int, bytes]]],
    answer: Callable[[int, list[bytes]], list[bytes]],
) -> DataFrame:
    """table with one more column: the answers of this round."""
    sent = each(table, lambda b: iter([mail(b.number, question(b))]), "batch long, bucket int, blob binary")

    def reply(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")  # the same order in every attempt
        blobs = answer(t["bucket"][0].as_py(), t["blob"].to_pylist())
        return pa.table({"batch": t["batch"], "bucket": t["bucket"], "blob": pa.array(blobs, pa.binary())})

    back = sent.groupBy("bucket").applyInArrow(reply, "batch long, bucket int, blob binary")
    name = f"answer{len(table.columns)}"
    got = scratch.cut(back.groupBy("batch").agg(F.collect_list(F.struct("bucket", "blob")).alias(name)))
    return table.join(got.hint("shuffle_hash"), "batch", "left")


def by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """(bucket, slice) for each run of a sorted bucket array."""
    if not len(bucket):
        return []
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]


def pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def gather(blobs: list[bytes], *types) -> tuple[list[np.ndarray], list[int]]:
    """The arrays of all blobs, each type's joined, and where to cut answers for each blob."""
    parts = [unpack(x, *types) for x in blobs]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(types))], np.cumsum([len(p[0]) for p in parts])[:-1].tolist()
