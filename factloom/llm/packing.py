"""Packing documents into fixed windows by order-preserving dynamic programming.

Documents follow each other in blocks of about ``BLOCK`` tokens. Within a block, cuts may fall at
document ends and sentence ends, or, at a higher price, at every ``GRAIN`` tokens inside a sentence
that is long. A window of n tokens costs its padding (none if n is a power of two, which is not
padded) plus a penalty if the cut that ends it splits a document. Let c be the cut places and f(j)
the least cost up to place j. For padded windows f(j) = penalty(j) + W - c[j] + min(f(i) + c[i]) over
the i with c[j] - c[i] <= W: a sliding-window minimum, which a monotone queue gives in constant time
for each place. Windows of exactly a power of two are looked up apart.

Texts are tokenised by words: a word with the space before it always becomes the same ids, so ids
are kept for words seen before; texts with other white space next to a space are encoded as a whole.
A string that the JSON vocabulary lists as an added token (``<|endoftext|>``) is that token wherever
it stands in a text, as the library of that file has it by default; what stands between is encoded
piece by piece.

Defined results: null and empty texts are just the end token; null doc_ids stay null; rows that
repeat are packed as often; an empty table gives an empty result; other columns are not read.
Sequence numbers are unique, and a block never spans two tasks.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read

WINDOW, END, BLOCK, GRAIN = 1024, 0, 1 << 19, 64
SPLIT, HARD = 4.0, 40.0  # penalties for a cut at a sentence end and inside a sentence
CACHE = 400_000  # words kept


def ranks_path() -> str:
    """The same vocabulary as ``byte_bpe_50k.json`` in the form that the faster library reads."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Strings that are one token each, by the JSON vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(x[k] for x in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match anywhere as they stand are understood")
    return {x["content"]: x["id"] for x in found}


class Words(dict):
    """Ids of words as bytes; a word that must not be encoded alone raises KeyError."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        if len(self) > CACHE:
            self.clear()
        out = np.array(self.encode(self.before + word), dtype="<u4").tobytes()
        if len(word) < 40:
            self[word] = out
        return out


class Tokens:
    def __init__(self, path: str | None = None, added: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or ranks_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = added_tokens(added)
        # the longest of those that start at one place
        self.parts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.rest = Words(self.encode, ""), Words(self.encode, " ")
        self.stops = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, dtype=bool)  # tokens that end a sentence
        for token, i in ranks.items():
            self.stops[i] = token[-1:] in (b".", b"!", b"?", b"\n")

    def __call__(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.added[m.group()]], dtype="<u4")]
            at = m.end()
        return np.concatenate([*out, self.plain(text[at:])]) if out else self.plain(text)

    def plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        words = text.split(" ")
        try:
            # a list, not a generator: __missing__ may raise
            raw = b"".join([self.first[words[0]], *[self.rest[w] for w in words[1:]]])
        except KeyError:
            return np.array(self.encode(text), dtype="<u4")
        return np.frombuffer(raw, dtype="<u4")


def cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of places, from 0 to the last, that cut a block best. Gaps must not exceed window."""
    n = len(places)
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    exact: dict[int, list[int]] = {}
    for p in powers:
        at = np.searchsorted(places, places - p)
        for j in np.flatnonzero((places >= p) & (places[at] == places - p)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
    c, pen = places.tolist(), penalty.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()  # indices with rising best[i] + c[i]
    for j in range(1, n):
        value = best[j - 1] + c[j - 1]
        while queue and best[queue[-1]] + c[queue[-1]] >= value:
            queue.pop()
        queue.append(j - 1)
        while c[queue[0]] < c[j] - window:
            queue.popleft()
        i = queue[0]
        cost = best[i] + c[i] + window - c[j]
        for k in exact.get(j, ()):
            if best[k] < cost:
                i, cost = k, best[k]
        best[j], back[j] = cost + pen[j], i
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def pack_block(lengths: np.ndarray, ids: np.ndarray, stops: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For each piece: document index, start in it, length, sequence, offset; and the block's place."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    last = np.zeros(total + 1, dtype=bool)
    last[ends] = True
    sentence = np.zeros(total + 1, dtype=bool)
    sentence[1:] = stops[ids]
    soft = last | sentence
    soft[0] = True
    edge = np.flatnonzero(soft)
    since = np.arange(total + 1) - np.repeat(edge, np.diff(np.append(edge, total + 1)))
    places = np.flatnonzero(soft | (since % GRAIN == 0))
    penalty = np.where(last[places], 0.0, np.where(sentence[places], SPLIT, HARD))
    chosen = places[cuts(places, penalty, window)]
    bounds = np.unique(np.concatenate([chosen, ends]))
    bounds = bounds[bounds > 0]
    start = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(ends, start, side="right")
    sequence = np.searchsorted(chosen, start, side="right") - 1
    return doc, start - (ends - lengths)[doc], bounds - start, sequence, start - chosen[sequence], start


KIND = pa.schema([(n, t) for n, t in (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.large_binary()))])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, keep_ids: bool = True, added: str | None = None) -> DataFrame:
    """One row for each piece; ids holds its token ids as little-endian unsigned 32-bit integers."""
    kind = KIND if keep_ids else pa.schema(list(KIND)[:-1])

    def run(batches):
        tokens, base = Tokens(path, added), TaskContext.get().partitionId() << 32
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal base, names, held, size
            lengths, ids = np.array([len(x) for x in held]), np.concatenate(held)
            doc, start, length, sequence, offset, at = pack_block(lengths, ids, tokens.stops, window)
            raw = memoryview(ids.tobytes())
            parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            cols = {
                "doc_id": [names[d] for d in doc.tolist()], "start": start, "length": length, "ids_crc32": [zlib.crc32(p) for p in parts],
                "doc_tokens": lengths[doc], "sequence_id": base + sequence, "offset": offset,
            }
            if keep_ids:
                cols["ids"] = [bytes(p) for p in parts]
            out = pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in kind], schema=kind)
            base, names, held, size = base + int(sequence[-1]) + 1, [], [], 0
            return out

        end = np.array([END], dtype="<u4")
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate([tokens(t), end]) if t else end
                names.append(d)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    types = {pa.int64(): "long", pa.large_binary(): "binary"}
    return docs.selectExpr(f"cast(`{id_col}` as long)", f"`{text_col}`").mapInArrow(run, ", ".join(f"`{f.name}` {types[f.type]}" for f in kind))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents, as ``pack`` has them.

    Null and empty texts are one end token; null doc_ids stay null; rows that repeat are packed as
    often; an empty table gives no pieces; other columns are not read, so names cannot clash.
    """
    return pack(docs, keep_ids=False)


def op5_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), keep_ids=False)
