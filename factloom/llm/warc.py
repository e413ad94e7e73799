"""WARC archives as tables of chunks: written and read without holding an oversized record.

An archive is a table of rows (archive, record, chunk, last, data, digest), whose ``data`` joined in
order of (record, chunk) is a WARC file. A record of up to ``CHUNK`` bytes is one row; a longer one is
a row for its head and one for each CHUNK bytes of its block. Every row carries the SHA-256 of the
payload up to its end, so a reader can tell at each chunk whether what it has is whole. Tables rather than
files hold the archives because executors reach the shared store only through Spark; ``export``
writes plain ``.warc`` files where the store is a mounted folder.

Records with the same payload of at least ``DEDUP_BYTES`` bytes are stored once: the one with the
smallest page_id is the response, the others become revisit records without a payload, which
name the response.

Defined results: a null payload is empty. A null page_id counts as larger than any; records without a
page_id never are another record's response. Rows that repeat the smallest page_id are responses all.
Other columns are not read. An empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, read

CHUNK, DEDUP_BYTES, HELD = 1 << 16, 100, 8 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
ROW = pa.schema([("archive", pa.int64()), ("record", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.large_binary()), ("digest", pa.string())])
FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def classify(pages: DataFrame, scratch: Scratch, id_col: str, payload_col: str, url_col: str | None) -> DataFrame:
    """page_id, url, payload, digest, first (page_id of the response if this is a revisit)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"), payload.alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # a digest and length that repeat; page ids only travel with digests here
    repeated = scratch.cut(
        rows.where(F.octet_length("payload") >= DEDUP_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    )
    found = rows.join(repeated, "digest", "left")
    return found.withColumn("first", F.when((F.col("page_id") > F.col("first")) | F.col("page_id").isNull(), F.col("first")))


def header(page_id: int | None, url: str | None, digest: str, size: int, refers: int | None) -> bytes:
    """The head of a record, and for a stored page that of the HTTP response inside it."""
    clean = " ".join((url or "").split())
    kind = "response" if refers is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = len(http) + (size if refers is None else 0)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}" if clean else "", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "" if page_id is None else f"X-Page-ID: {page_id}",
        "" if refers is None else f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: {refers}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {body}",
    ]
    return "\r\n".join(x for x in lines if x).encode() + b"\r\n\r\n" + http


def chunks(page_id, url, digest: str, payload: memoryview, refers: int | None) -> Iterator[tuple[bool, bytes, str]]:
    """(last, data, digest of the payload so far) of each chunk of one record."""
    head = header(page_id, url, digest, len(payload), refers)
    if refers is not None:
        yield True, head + b"\r\n\r\n", hashlib.sha256().hexdigest()
    elif len(head) + len(payload) <= CHUNK:
        yield True, b"".join((head, payload, b"\r\n\r\n")), digest
    else:
        seen = hashlib.sha256()
        yield False, head, seen.hexdigest()
        for at in range(0, len(payload), CHUNK):
            part = payload[at : at + CHUNK]
            seen.update(part)
            yield False, bytes(part), seen.copy().hexdigest()
        yield True, b"\r\n\r\n", seen.hexdigest()


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """The chunk table of one archive for each task, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record, out, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ROW)], schema=ROW)

        for b in batches:
            ids, urls, digests, firsts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "first"))
            payloads = b.column(b.schema.get_field_index("payload"))
            for i in range(b.num_rows):
                for k, (last, data, digest) in enumerate(chunks(ids[i], urls[i], digests[i], memoryview(payloads[i].as_buffer()), firsts[i])):
                    out.append((archive, record, k, last, data, digest))
                    size += len(data)
                    if size >= HELD:
                        yield flush()
                        out, size = [], 0
                record += 1
        if out:
            yield flush()

    found = classify(pages, scratch, id_col, payload_col, url_col)
    return scratch.cut(found.mapInArrow(run, "archive long, record long, chunk long, last boolean, data binary, digest string"))


class Reader:
    """Parses the bytes of one WARC stream, given in any pieces; holds heads only, never a payload."""

    def __init__(self):
        self.head, self.left, self.tail, self.fields = bytearray(), 0, 0, None
        self.http, self.seen, self.size = None, None, 0

    def feed(self, data: bytes) -> Iterator[dict]:
        view = memoryview(data)
        while len(view):
            if self.tail:  # the two line ends after a block
                n = min(self.tail, len(view))
                if bytes(view[:n]) != b"\r\n\r\n"[4 - self.tail : 4 - self.tail + n]:
                    raise ValueError("a record's end is missing")
                view, self.tail = view[n:], self.tail - n
                if not self.tail:
                    yield self.close()
            elif self.fields is None or self.http is None:
                view = self.take_head(view)
            else:
                n = min(self.left, len(view))
                self.seen.update(view[:n])
                self.size, self.left, view = self.size + n, self.left - n, view[n:]
            if self.http is not None and not self.left and not self.tail:
                self.tail = 4

    def take_head(self, view: memoryview) -> memoryview:
        was = len(self.head)
        self.head += view[: 1 << 16]
        at = self.head.find(b"\r\n\r\n", max(0, was - 3))
        if at < 0:
            return view[1 << 16 :]
        lines = bytes(self.head[:at]).split(b"\r\n")
        used, self.head = at + 4 - was, bytearray()
        if self.fields is None:
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            self.fields = {k.lower(): v for k, v in (x.decode("utf-8", "replace").split(": ", 1) for x in lines[1:])}
            self.left, self.seen, self.size = int(self.fields["content-length"]), hashlib.sha256(), 0
        else:
            self.http = lines
            self.left -= at + 4
        return view[used:]

    def close(self) -> dict:
        f = self.fields
        number = lambda k: int(f[k]) if k in f else None
        digest, size = f["warc-payload-digest"].removeprefix("sha256:"), number("x-payload-length")
        if f["warc-type"] == "response" and (digest, size) != (self.seen.hexdigest(), self.size):
            raise ValueError("a payload does not match its digest")
        self.fields = self.http = None
        return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": number("x-refers-to-page-id"), "url": f.get("warc-target-uri")}


def parse(chunk_rows: Iterable[tuple[int, int, int, bool, bytes, str]]) -> Iterator[dict]:
    """Records of chunk rows in order; checks that no chunk is missing and what digests say on the way."""
    at, reader = None, Reader()
    for archive, record, chunk, last, data, digest in chunk_rows:
        if (archive, record, chunk) != (at or (archive, record, 0)) or (at is None and chunk):
            raise ValueError("a chunk is missing")
        whole = 0
        for found in reader.feed(data):
            whole += 1
            if found["record_type"] == "response" and found["payload_digest"] != digest:
                raise ValueError("a chunk does not match its digest")
            yield found
        if whole != int(last) or (not last and reader.seen and reader.seen.hexdigest() != digest):
            raise ValueError("a chunk does not match its digest")
        at = None if last else (archive, record, chunk + 1)


def read_archives(table: DataFrame) -> DataFrame:
    """One row for each record, in FOUND's columns.

    Records of one chunk are parsed where they lie. The chunks of longer ones are brought together and
    sorted, then streamed through the parser; a task holds one Arrow batch, whatever a record's size.
    """

    def run(batches):
        def stream():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(4)), (x.as_py() for x in b.column(4)), b.column(5).to_pylist())

        out = []
        for r in parse(stream()):
            out.append(r)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    whole = (F.col("chunk") == 0) & F.col("last")
    long = table.where(~whole).repartition(partitions(table.sparkSession), "archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return table.where(whole).mapInArrow(run, kind).unionAll(long.mapInArrow(run, kind))


def export(table: DataFrame, folder: str) -> None:
    """Plain files <archive>.warc in a folder that all executors have mounted."""

    def run(batches):
        name = file = None
        for b in batches:
            for a, data in zip(b.column(0).to_pylist(), b.column(4)):
                if a != name:
                    if file:
                        file.close()
                    name, file = a, open(os.path.join(folder, f"{a:06d}.warc"), "wb")  # noqa: SIM115
                file.write(data.as_buffer())
        if file:
            file.close()
        yield from ()

    os.makedirs(folder, exist_ok=True)
    table.repartition(partitions(table.sparkSession), "archive").sortWithinPartitions("archive", "record", "chunk").mapInArrow(run, "n long").count()


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    scratch = Scratch(pages.sparkSession)
    return read_archives(write_archives(pages, scratch, id_col, payload_col, url_col))


def op1_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages", "page_id", "url", "html")).drop("url")
