"""WARC archives written and read back as a chunked record table.

Payloads are hashed in Spark; of equal payloads the row with the largest id becomes the
response record and the others become revisit records that refer to it. Every task
streams its records into gzip-per-record archives of bounded size below the shared
folder, under names of its own attempt; only the manifest of the attempt that Spark
commits is read, so a lost executor or a second attempt leaves nothing half-written in
use. Reading streams each archive member by member and yields rows of record id and
chunk number: no payload is ever held whole, and the running length and SHA-1 travel
from chunk to chunk.

Defined cases: a null payload is an empty one; rows with the largest id of their payload
that are repeated are all responses; among equal payloads a null id is a revisit unless
all ids are null; a null or odd URL is written percent-encoded or as ``urn:unknown``; an
empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.columns import small_batches
from larder.llm.shared import folder, stored

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
DATE = "2024-01-15T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records bigint, bytes bigint"
CHUNKS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("chunk_no", T.LongType()), T.StructField("last", T.BooleanType()),
    T.StructField("data", T.BinaryType()), T.StructField("bytes_so_far", T.LongType()),
    T.StructField("digest_so_far", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType())])


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder of any store that the cluster shares."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def records(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """One row per page: key, url, payload bytes, digest, record type and the key of the
    response that a revisit refers to."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    hashed = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    hashed = hashed.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = hashed.groupBy("sha1", "size").agg(F.max("key").alias("newest"))
    joined = hashed.join(first, ["sha1", "size"])
    revisit = (F.col("size") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("newest"))
    return joined.select(F.col("key").cast("string").alias("key"), "url", "payload", "sha1",
                         F.when(revisit, F.col("newest").cast("string")).alias("refers_to"))


def _member(head: list[str], parts: Iterator[bytes]) -> Iterator[bytes]:
    """One record as one gzip member, compressed piece by piece."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    yield squeeze.compress("\r\n".join(["WARC/1.1", *head, "", ""]).encode())
    for part in parts:
        yield squeeze.compress(part)
    yield squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _record(key, url, payload: memoryview, sha1: str, refers_to, name: str) -> Iterator[bytes]:
    digest = base32(bytes.fromhex(sha1))
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    identity = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{k}:{digest}')}>"
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:unknown"
    head = [f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: {identity(key) if refers_to is None else identity(f'{key}:{name}')}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
            f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if key is not None:
        head.append(f"Record-Key: {quote(str(key), safe='')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {identity(refers_to)}", f"Refers-To-Key: {quote(str(refers_to), safe='')}", f"WARC-Profile: {IDENTICAL}",
                 f"Content-Length: {len(http)}"]
        return _member(head, iter([http]))
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return _member(head, (x for part in ([http], (payload[i:i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)))
                          for x in part))


def write_archives(rows: DataFrame, name: str = "warc", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The records written as archives below the shared folder; returns the manifest
    (path, records, bytes), itself a table of the shared folder."""
    small_batches(rows.sparkSession)
    root = folder(rows.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        task = TaskContext.get()
        prefix = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        made, out = [], None
        n = written = 0

        def finish():
            nonlocal out
            out.close()
            made.append((path, n, written))
            out = None

        for batch in batches:
            key, url, payload, sha1, refers_to = (batch.column(c) for c in ("key", "url", "payload", "sha1", "refers_to"))
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, n, written = f"{root}/{prefix}-{len(made):05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{prefix}-{len(made):05d}.warc.gz", compression=None)
                body = memoryview(payload[i].as_buffer())
                for piece in _record(key[i].as_py(), url[i].as_py(), body, sha1[i].as_py(), refers_to[i].as_py(), f"{path}:{n}"):
                    written += out.write(piece) or len(piece)
                n += 1
                if written >= archive_bytes:
                    finish()
        if out is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))],
                                             names=["path", "records", "bytes"])

    return stored(rows.mapInArrow(run, MANIFEST), f"{name}-manifest")


class Members:
    """Reads a file of gzip members as one stream of plain bytes, at most ``READ_BYTES``
    compressed and ``CHUNK_BYTES`` plain bytes at a time."""

    def __init__(self, source):
        self.source, self.raw, self.plain = source, b"", bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data + self.raw
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:
                    return False
            got = self.inflate.decompress(self.raw, CHUNK_BYTES)
            self.raw = self.inflate.unconsumed_tail
            if got:
                self.plain += got
                return True

    def head(self) -> list[str] | None:
        """The lines up to an empty one; None at the end of the file."""
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.plain.strip():
                    raise ValueError("archive ends inside a record")
                return None
        lines = self.plain[:at].decode().split("\r\n")
        del self.plain[:at + 4]
        return lines

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces of ``CHUNK_BYTES``."""
        while size:
            want = min(size, CHUNK_BYTES)
            while len(self.plain) < want:
                if not self.more():
                    raise ValueError("archive ends inside a record")
            yield bytes(self.plain[:want])
            del self.plain[:want]
            size -= want


def chunks(archive: str, source, with_data: bool) -> Iterator[tuple]:
    """The chunk rows of one archive; a record without payload has one empty chunk."""
    stream = Members(source)
    while (lines := stream.head()) is not None:
        head = dict(line.split(": ", 1) for line in lines[1:])
        http = stream.head()
        size = int(head["Content-Length"]) - sum(len(x.encode()) + 2 for x in http) - 2
        sha1, so_far, number = hashlib.sha1(), 0, 0
        # keys are percent-encoded: a line end in one would end its header
        own, refers_to = (None if x is None else unquote(x) for x in (head.get("Record-Key"), head.get("Refers-To-Key")))
        common = (archive, head["WARC-Record-ID"], head["WARC-Type"], own, head["WARC-Target-URI"], refers_to)
        full = (int(head["Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
        for piece in stream.pieces(size) if size else [b""]:
            sha1.update(piece)
            so_far += len(piece)
            yield (*common, number, so_far == size, piece if with_data else None, so_far, base32(sha1.digest()), *full)
            number += 1
        if b"".join(stream.pieces(4)) != b"\r\n\r\n":
            raise ValueError("record without its end mark")


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives of a manifest."""
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary() if f.dataType == T.BinaryType() else pa.int64() if f.dataType == T.LongType()
                 else pa.bool_() if f.dataType == T.BooleanType() else pa.string() for f in CHUNKS]
        most = 8 if with_data else 4096

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=CHUNKS.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = opened(path)
                with fs.open_input_stream(inner, compression=None) as source:
                    rows = []
                    for row in chunks(path, source, with_data):
                        rows.append(row)
                        if len(rows) == most:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return manifest.select("path").repartition(max(1, n)).mapInArrow(run, CHUNKS)


def record_table(read: DataFrame) -> DataFrame:
    """One row per record from its last chunk: a response's length and digest as read, a
    revisit's as its headers state them."""
    own = F.col("record_type") == "response"
    return read.filter("last").select(
        "key", F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")
