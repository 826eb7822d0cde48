"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records,
with the seek table of Zstandard's seekable format as its last, skippable
frame. An index maps each record's identifier to (frame, offset in the frame's
content, length), so a record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, lookup

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_URN = "urn:record:"


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to one."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = HTTP + (payload if refers_to is None else b"")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Collects records into frames and closes with the seek table."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame_bytes, self.frames, self.sizes, self.open, self.filled, self.total = frame_bytes, [], [], [], 0, 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, record_id: str, data: bytes) -> None:
        if self.open and self.filled + len(data) > self.frame_bytes:
            self._end_frame()
        self.index.append((record_id, len(self.frames), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        self.total += len(data)

    def _end_frame(self) -> None:
        content = b"".join(self.open)
        frame = self.compress(content)
        self.frames.append(frame)
        self.sizes.append((len(frame), len(content)))
        self.open, self.filled = [], 0

    def close(self) -> bytes:
        if self.open:
            self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    start, out, at = len(bundle) - 9 - n * width, [], 0
    for i in range(n):
        packed, content = struct.unpack_from("<II", bundle, start + i * width)
        out.append((at, packed, content))
        at += packed
    return out


def fetch(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry; only its frame is decompressed."""
    import zstandard

    at, packed, content = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=content)[offset : offset + length]


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 24, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row; returns the bundles as read back, as (bundle, data,
    records), records being the index: (record_id, frame, offset, length).

    Of rows with equal payloads of at least ``min_bytes``, that with the largest
    id is a response and the others revisits of it; all other rows are
    responses. Rows with the largest id in common, and rows with a null id, are
    responses. A null body is an empty payload; a null url is left out. Payloads
    are compared by SHA-1. Each task bundles the rows it has, one bundle at
    a time in memory; a payload beyond ``bundle_bytes`` has a bundle of its own.
    An empty table gives no bundle. Bundles are rows of a table in the shared
    folder, so that a repeated task cannot leave half a file.
    """
    scratch = Scratch(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    same = rows.where((F.length("body") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = scratch.keep(same, "copies")
    judged = lookup(rows, same, ["digest"], "n", pages.count(), F.xxhash64("id").cast("string"))
    judged = judged.withColumn("first", F.when(F.col("id") < F.col("first"), F.col("first"))).select(F.col("id").cast("string"), "url", "body", "digest", F.col("first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes, level)

        def out() -> pa.RecordBatch:
            index = [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in bundle.index]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([bundle.close()], pa.binary()), pa.array([index], INDEX)], names=["bundle", "data", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, url, payload, digest, first = row
                if bundle.index and bundle.total + len(payload) > bundle_bytes:
                    yield out()
                    n, bundle = n + 1, Bundle(frame_bytes, level)
                urn = _urn(key)
                bundle.add(urn, record(urn, url, payload, digest, None if first is None else _urn(first), date))
        if bundle.index:
            yield out()

    return scratch.keep(judged.mapInArrow(run, "bundle string, data binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"), "bundles")


INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def _urn(key: str | None) -> str:
    return RECORD_URN + ("" if key is None else "id:" + quote(key, safe=""))


def read(bundles: DataFrame) -> DataFrame:
    """The records of bundles: (id, type, uri, refers_to, payload_bytes, payload_digest,
    payload). Ids are strings, null where a row had none; a revisit's payload is
    null. A response's digest and length are those of the payload read, and a
    record that does not match its header raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for data, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames, at, content = seek_table(data), -1, b""
                out: list[tuple] = []
                for entry in index:
                    if entry["frame"] != at:
                        if out:
                            yield _records(out)
                            out = []
                        at = entry["frame"]
                        start, packed, size = frames[at]
                        content = unzip(data[start : start + packed], max_output_size=size)
                    headers, payload = parse(content[entry["offset"] : entry["offset"] + entry["length"]])
                    if headers["WARC-Record-ID"] != f"<{entry['record_id']}>":
                        raise ValueError(f"{entry['record_id']} is not where the index has it")
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                    if headers["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                        raise ValueError(f"{entry['record_id']}: the payload does not match its digest")
                    uri = headers.get("WARC-Target-URI")
                    revisit = headers["WARC-Type"] == "revisit"
                    out.append((_id(entry["record_id"]), headers["WARC-Type"], uri, _id(headers["WARC-Refers-To"][1:-1]) if revisit else None, n, digest, None if revisit else payload))
                if out:
                    yield _records(out)

    return bundles.select("data", "records").mapInArrow(run, "id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")


RECORD = pa.schema([("id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)


def _id(urn: str) -> str | None:
    rest = urn.removeprefix(RECORD_URN)
    return unquote(rest.removeprefix("id:")) if rest else None
