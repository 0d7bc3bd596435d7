"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by ranges of their key; each task writes its range to files of gzip members, one a
record, and starts a new file when the compressed size is reached. Files get their names only when they
are whole, the names and the bytes follow from the rows alone, and the manifest lists what counts:
a lost and repeated task writes the same files again. Headers and digests are made anew from
the payloads. A payload that a record with a smaller key has too is not stored again: its record is a revisit.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import spread, stored
from strata.llm.files import opened, whole_file

# Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Layout:
    """Files are closed by the record that brings them to ``file_bytes`` (compressed); payloads of fewer
    than ``least_revisit`` bytes are always stored."""

    file_bytes: int = 64_000_000
    least_revisit: int = 100
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


def with_first(pages: DataFrame, layout: Layout, key: str, url: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``key``, ``url``, ``payload`` (bytes; null: empty) and ``digest``; and of those whose payload a
    smaller key has too, ``key``, ``digest`` and ``first``, that key. A payload's rows are counted before they are joined, so that very common
    ones are only keys that the join may split; payloads themselves are not moved by it."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= layout.least_revisit).groupBy(F.col("digest").alias("d")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stored(groups.select("d", "first"), "payloads")
    revisits = rows.select("key", "digest").join(groups, F.col("digest") == F.col("d")).where("key <> first")
    return rows, stored(revisits.select("key", "digest", "first").distinct(), "revisits")


def _record(kind: str, key: str, url: str, digest: str, length: int, payload: bytes, refers: str | None, layout: Layout) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    block = http + payload
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"),
        ("WARC-Date", layout.date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(length)),
        ("X-Page-ID", key),
    ]
    if refers is not None:
        lines += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>"), ("X-Refers-To-Page", refers)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{n}: {_line(v)}\r\n".encode() for n, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value in one line."""
    return " ".join(value.split()) if value.isprintable() else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def _member(data: bytes, level: int) -> bytes:
    """One gzip member; its header has no time, so equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


MANIFEST = "partition int, seq int, path string, n_records long, n_bytes long, sha256 string"


class _Hashed:
    """A stream that keeps the length and digest of what it was given."""

    def __init__(self, out):
        self.out, self.n, self.sha = out, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.n += len(data)
        self.sha.update(data)


def write_archives(pages: DataFrame, folder: str, layout: Layout = Layout(), key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record for each row and returns the manifest.

    Null payloads are empty, null urls too; a null key is written as an empty one, sorts first and is never
    what others revisit unless no row with that payload has a key. Rows that repeat a key and payload are each
    written as the first of them is. Very long payloads are one record each.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seq = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            uri, n = f"{folder}/part-{partition:06d}-{seq:05d}.warc.gz", 0
            with whole_file(uri) as stream:
                out = _Hashed(stream)
                while row is not None and out.n < layout.file_bytes:
                    k, u, body, digest, length, first = row
                    name = "" if k is None else str(k)
                    kind = "response" if first is None else "revisit"
                    out.write(_member(_record(kind, name, u or "", digest, length, body or b"", None if first is None else str(first), layout), layout.level))
                    n += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"partition": partition, "seq": seq, "path": uri, "n_records": n, "n_bytes": out.n, "sha256": out.sha.hexdigest()}], schema=schema)
            seq += 1

    schema = pa.schema([("partition", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
    rows, revisits = with_first(pages, layout, key, url, payload)
    revisits = revisits.select(F.col("key").alias("k"), F.col("digest").alias("d"), "first")
    rows = rows.join(revisits, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")), "left")
    # a revisit's payload is not needed any more
    body = F.when(F.col("first").isNull(), F.col("payload"))
    rows = rows.select("key", "url", body.alias("payload"), "digest", F.length("payload").cast("long").alias("length"), "first")
    rows = rows.repartitionByRange("key", "digest").sortWithinPartitions("key", "digest", "url")
    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive, a member at a time."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or stream.read(1 << 20)
            if not data:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(z.decompress(data))
            rest = z.unused_data
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8").split("\r\n")
        if first.encode() != VERSION:
            raise ValueError(f"not a WARC record: {first[:20]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        yield headers, body[: int(headers["Content-Length"])]


READ = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(manifest: DataFrame, key: str = "page_id", html: bool = True) -> DataFrame:
    """The records of the manifest's files: key, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and ``html`` (null in revisits). Digests are made from the payloads and must be as the headers say."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, name = opened(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for h, block in records(stream):
                        payload, length, digest = block.partition(b"\r\n\r\n")[2], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{path}: block digest of page {h['X-Page-ID']}")
                        if h["WARC-Type"] == "response":
                            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            if digest != h["WARC-Payload-Digest"].removeprefix("sha256:"):
                                raise ValueError(f"{path}: payload digest of page {h['X-Page-ID']}")
                        page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, h["WARC-Target-URI"], length, digest, h["WARC-Type"], int(refers) if refers else None, payload.decode("utf-8") if html and h["WARC-Type"] == "response" else None))
                        held += len(payload) * html + 200
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    files = spread(manifest.select("path"), manifest.agg(F.sum("n_bytes")).first()[0])
    return files.mapInArrow(read, READ).withColumnRenamed("key", key)
