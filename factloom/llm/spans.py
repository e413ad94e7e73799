"""Removal of repeated passages by hashes of runs of consecutive sentences.

A sentence ends at a word that ends in ``.``, ``!`` or ``?``, or at a line's end. A sentence of over
``longest`` words counts as several, cut before every word that has the smallest hash among some
``longest`` / 2 consecutive words of it: cuts depend on the words around them and not on where the
sentence begins, and are at most ``longest`` / 2 words apart. At every sentence starts one span: the
next ``run`` sentences, and as many more as it takes to hold ``least`` words. Spans with equal bytes
are one group, told apart by 128-bit hashes; the first of a group is the one with the smallest
(doc_id, place in the document). Every sentence covered by a span that is not the first of its group
is removed, within a document as well as across documents.

So a passage that two documents share may begin and end anywhere: what it has of the sentence it begins
in is cut alike in both from the ``longest``-th word on, and so at its end. Of 2 * ``longest`` + ``least`` words or
more (48 by default), at least ``least`` lie in whole sentences that both have, which is a span.

The hashes meet in buckets as one entry for each batch of texts, so a passage that a third of all
documents hold makes no hot key; a bucket answers each entry with one bit.

Defined results: null and empty texts have no sentences and stay empty; null doc_ids come last; of
rows that repeat a doc_id, one counts as first; other columns are not read; an empty table gives an
empty result. Sentences are judged on the input, not on what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, read
from .exchange import Batch, ask, by_bucket, each, gather, make_batches, pack

RUN, LEAST, LONGEST = 2, 20, 14
SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
STOP = np.isin(np.arange(256), list(b".!?"))
U = np.uint64


def marks(data: np.ndarray, word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word by its length and first bytes; it only has to tell most words apart."""
    h = (end - word).astype(U)
    for k in range(8):
        at = word + k
        inside = at < end
        h = (h * U(0x9E3779B97F4A7C15)) ^ np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(U)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def cut_long(new: np.ndarray, h, longest: int) -> np.ndarray:
    """new, which marks words that begin a sentence, with the cuts of sentences of over longest words."""
    near = longest // 2
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(new)))
    long = size > longest
    words = np.flatnonzero(np.repeat(long, size))
    if not len(words):
        return new
    # (hash, place) of the words of long sentences; the smallest of each window, the last among equals
    order = np.empty(len(words), np.int64)
    order[np.lexsort((-words, h(words)))] = np.arange(len(words))
    least, reach = order, 1
    while reach * 2 <= near:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if near > reach:
        least = np.minimum(least[: reach - near], least[near - reach :])
    which = np.repeat(np.arange(len(at)), size)[words]
    whole = which[: len(least)] == which[near - 1 :]
    back = np.empty(len(words), np.int64)
    back[order] = words
    out = new.copy()
    out[back[least[whole]]] = True
    return out


def sentences(b: Batch, longest: int) -> tuple[np.ndarray, ...]:
    """Start, end without space, words and document of each sentence of a batch."""
    space = SPACE[b.data]
    before = np.concatenate([[True], space[:-1]])[: len(space)]
    starts = b.starts
    before[starts[starts < len(space)]] = True
    word = np.flatnonzero(~space & before)
    if not len(word):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc = np.searchsorted(b.ends, word, side="right")
    after = np.concatenate([space[1:], [True]])
    after[b.ends[b.ends > 0] - 1] = True
    end = np.flatnonzero(~space & after) + 1
    lines = np.flatnonzero(b.data == 10)
    new = np.ones(len(word), bool)
    broken = np.searchsorted(lines, word[1:]) > np.searchsorted(lines, end[:-1])
    new[1:] = (doc[1:] != doc[:-1]) | STOP[b.data[end[:-1] - 1]] | broken
    new = cut_long(new, lambda k: marks(b.data, word[k], end[k]), longest)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(word))
    return word[at], end[stop - 1], stop - at, doc[at]


class Spans:
    def __init__(self, run: int, least: int, longest: int, buckets: int):
        self.run, self.least, self.longest, self.buckets = run, least, longest, buckets

    def find(self, b: Batch):
        """Sentences; first and last sentence of each span; its entry; the entries' hashes and firsts."""
        start, end, words, doc = sentences(b, self.longest)
        total = np.concatenate([[0], np.cumsum(words)])
        first = np.arange(len(start))
        last = np.maximum(first + self.run - 1, np.searchsorted(total, total[first] + self.least) - 1)
        fits = last < len(start)
        first, last = first[fits], last[fits]
        one = doc[first] == doc[last]
        first, last = first[one], last[one]
        raw, digest = memoryview(b.data), xxhash.xxh3_128_digest
        h = np.frombuffer(b"".join(digest(raw[x:y]) for x, y in zip(start[first].tolist(), end[last].tolist())), dtype="u8").reshape(-1, 2)
        place = start[first] - b.starts[doc[first]]
        ids = b.ids[doc[first]]
        order = np.lexsort((place, ids, h[:, 1], h[:, 0], h[:, 0] % U(self.buckets)))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]).any(axis=1)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        at = order[new]
        return (start, end, doc), first, last, entry, at, h[at], ids[at], place[at]

    def question(self, b: Batch):
        _, _, _, _, _, h, ids, place = self.find(b)
        return [(k, pack(h[s, 0].copy(), h[s, 1].copy(), ids[s], place[s].astype(np.uint32))) for k, s in by_bucket(h[:, 0] % U(self.buckets))]

    def answer(self, bucket: int, blobs: list[bytes]) -> list[bytes]:
        """For each entry: is it the first of its group? Of equal ones, that of the lowest batch."""
        (one, two, ids, place), cuts = gather(blobs, U, U, np.int64, np.uint32)
        order = np.lexsort((place, ids, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        out = np.empty(len(order), bool)
        out[order] = new
        return [np.packbits(x).tobytes() for x in np.split(out, cuts)]

    def removed(self, b: Batch):
        parts, first, last, entry, at, h, _, _ = self.find(b)
        keep = np.zeros(len(first), bool)
        for k, s in by_bucket(h[:, 0] % U(self.buckets)):
            yes = np.unpackbits(np.frombuffer(b.answers[0][k], np.uint8), count=s.stop - s.start)
            keep[at[s]] = yes
        edge = np.zeros(len(parts[0]) + 1, np.int32)
        np.add.at(edge, first[~keep], 1)
        np.add.at(edge, last[~keep] + 1, -1)
        return parts, np.cumsum(edge[:-1]) > 0


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_sentences, n_removed, text (without the removed sentences and the space after them)."""
    scratch = Scratch(docs.sparkSession)
    table = make_batches(scratch, docs, id_col, text_col)
    total = table.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    s = Spans(run, least, longest, max(4 * partitions(docs.sparkSession), total // (1 << 25)))
    table = ask(scratch, table, s.question, s.answer)
    kind = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.large_string())])

    def finish(b: Batch):
        (start, _, doc), gone = s.removed(b)
        n = np.bincount(doc, minlength=len(b.ends))
        lost = np.bincount(doc[gone], minlength=len(b.ends))
        cut = np.concatenate([[0], np.cumsum(n)])
        raw, starts = b.data.tobytes(), b.starts
        texts = []
        for d in range(len(b.ends)):
            x, y = int(starts[d]), int(b.ends[d])
            if lost[d]:
                at = [x, *start[cut[d] + 1 : cut[d + 1]].tolist(), y]
                texts.append(b"".join(raw[p:q] for p, q, g in zip(at, at[1:], gone[cut[d] : cut[d + 1]]) if not g))
            else:
                texts.append(raw[x:y])
        for d in range(0, len(texts), 2000):
            e = min(d + 2000, len(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(i) if m else None for i, m in zip(b.ids[d:e], b.named[d:e])], pa.int64()), pa.array(n[d:e], pa.int64()), pa.array(lost[d:e], pa.int64()), pa.array(texts[d:e], pa.large_binary()).cast(pa.large_string())], schema=kind)

    return each(table, finish, "doc_id long, n_sentences long, n_removed long, text string")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(read(spark, sf_dir, "documents", "doc_id", "text"))
