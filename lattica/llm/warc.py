"""WARC records in seekable Zstandard bundles.

Records are gathered into independent frames of about ``FRAME`` bytes, frames into bundles of about ``BUNDLE`` bytes. A
bundle ends in a seek table in the public seekable format: a skippable frame with the compressed and decompressed size of
every frame. A bundle's index maps each record's identifier to its frame and to its offset inside the decompressed frame,
so one record is read by decompressing one frame.

Bundles are rows of a table (bundle, bytes, index): Spark's own writer puts them wherever the cluster keeps tables, and a
lost executor's bundles are written again under the same names. :func:`export` puts them into files of a mounted folder.

Edge cases: null payloads are empty payloads; a row with a null page_id is written under the identifier ``urn:page:`` and
is a response of its own; rows that repeat the largest page_id of an equal payload are all responses; rows of one page_id
with different payloads are separate records; a payload of any length is one record, never split; an empty table gives no
bundle; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import broadcast_if_small, written

FRAME = 1 << 18
BUNDLE = 1 << 23
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"
SCHEMA = "bundle string, bytes binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or the revisit of another page's payload."""
    target = (url or "").replace("\r", "").replace("\n", "") or "about:blank"
    name = "" if page_id is None else page_id
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Target-URI": target,
        "WARC-Date": _DATE,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": len(payload),
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        payload = b""
    head["Content-Length"] = len(payload)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """Collects records into frames; ``finish`` gives the bytes with the seek table, and the index."""

    def __init__(self):
        self.packer, self.frames, self.index = zstandard.ZstdCompressor(level=LEVEL), [], []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.length, self.total = [], 0, 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.sizes), self.length, len(data)))
        self.open.append(data)
        self.length += len(data)
        self.total += len(data)
        if self.length >= FRAME:
            self._close()

    def _close(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), self.length))
        self.open, self.length = [], 0

    def finish(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        if self.open:
            self._close()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", _SKIPPABLE, len(body)), body]), self.index


class Reader:
    """Random access to the frames of one bundle by its seek table."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = len(data) - 9 - count * width
        self.data, self.spans, at = data, [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", data, table + i * width)
            self.spans.append((at, packed, plain))
            at += packed
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, plain = self.spans[k]
            self.last = (k, self.unpacker.decompress(self.data[at : at + packed], max_output_size=max(plain, 1)))
        return self.last[1]

    def read(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame)[offset : offset + length])


def with_references(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of ``smallest`` bytes or more, all but the largest page_id refer to it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("sum", F.sha2("html", 256))
    best = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).where(F.octet_length("html") >= smallest).groupBy(F.sha2("html", 256).alias("sum")).agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    # only payloads that occur again need to be told: few rows meet all pages, whose texts are not dealt for the others
    again = written(best.where("n > 1").select("sum", "best"), "again")
    joined = keyed.join(broadcast_if_small(again, 200_000), "sum", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("best") != F.col("page_id"), F.col("best")).alias("refers_to"))


def bundles(rows: DataFrame) -> DataFrame:
    """The bundle table of (page_id, url, html, refers_to)."""

    def run(batches):
        task, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def pack():
            data, index = bundle.finish()
            entries = [[dict(zip(("record_id", "frame", "offset", "length"), x)) for x in index]]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.record_batch([pa.array([f"bundle-{task:06d}-{number:06d}.warc.zst"]), pa.array([data], pa.binary()), pa.array(entries, kind)], names=["bundle", "bytes", "index"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bundle.add(f"urn:page:{'' if page_id is None else page_id}", record(page_id, url, html.encode(), refers_to))
                if bundle.total >= BUNDLE:
                    yield pack()
                    number, bundle = number + 1, Bundle()
        if bundle.index:
            yield pack()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, SCHEMA)


def write(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder; the table that was written."""
    return written(bundles(with_references(pages)), "warc")


def read(table: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Every record of the bundles, or those whose ``record_id`` is in ``records`` (only their frames are decompressed)."""
    if records is None:
        wanted = table.select("bytes", "index")
    else:
        entries = table.select("bundle", F.explode("index").alias("e")).join(records.select(F.col("record_id").alias("wanted")).distinct(), F.col("e.record_id") == F.col("wanted"))
        some = entries.groupBy("bundle").agg(F.collect_list("e").alias("index"))
        wanted = table.select("bundle", "bytes").join(some, "bundle").select("bytes", "index")

    def run(batches):
        for batch in batches:
            for data, index in zip(batch.column(0), batch.column(1)):
                reader, rows = Reader(data.as_py()), []
                for e in index.as_py():
                    head, payload = reader.read(e["frame"], e["offset"], e["length"])
                    page, revisit = head["WARC-Record-ID"][10:-1], head["WARC-Type"] == "revisit"
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload)
                    if not revisit and f"sha1:{sha}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"damaged record {e['record_id']}")
                    rows.append((int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), sha, head["WARC-Type"], int(head["WARC-Refers-To"][10:-1]) if revisit else None, None if revisit else payload.decode()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return wanted.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def export(table: DataFrame, folder: str) -> DataFrame:
    """Put the bundles into files of a folder that every executor has mounted; (bundle, size)."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
                yield pa.record_batch([pa.array([name]), pa.array([len(data)], pa.int64())], names=["bundle", "size"])

    return table.select("bundle", "bytes").mapInArrow(run, "bundle string, size long")


def op4(pages: DataFrame) -> DataFrame:
    """The contract's result, from the archives read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
    SELECT hex, octet_length(encode(html)) AS bytes, max(page_id) AS best FROM p GROUP BY ALL
), d AS (
    SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(0, 5), lambda j: CAST(((strpos('0123456789abcdef', substr(hex, CAST((i * 5 + j) // 4 AS INTEGER) + 1, 1)) - 1)
            // CAST(pow(2, 3 - (i * 5 + j) % 4) AS INTEGER)) % 2 AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), '') AS base32
    FROM g
)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, base32 AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN g USING (hex) JOIN d USING (hex)
"""
