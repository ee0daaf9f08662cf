"""WARC archives in seekable Zstandard bundles.

A bundle is the byte image of one `.warc.zst` file: records are grouped into independent frames of
about `frame_bytes`, a skippable seek table with the compressed and plain size of every frame closes
the file, and an index maps a record's id to (frame, offset in the plain frame, length). Any
Zstandard tool can read a bundle from front to back; a single record needs one frame only.

A page's payload is its html in UTF-8 (null: empty). Of records with equal payloads of at least
`revisit_bytes` bytes the one with the largest page_id is a `response`; the others are `revisit`
records without payload that name it. Smaller payloads are always responses.

Defined cases: a null url leaves out the target header; control characters in a url are
percent-encoded; page_id null: such a row never becomes the original of another row unless no row of
its group has an id, when all of them are responses; rows that repeat the largest page_id and payload
are all responses; an empty table gives no bundle; extra columns are not read.

Bundles are rows of a table in the shared folder (bundle name, content, index), written by Spark's
own writer, so a lost task leaves nothing half-written and any store Spark can write will do.
`export_bundles` copies them out as files where executors mount a common folder.

Scale: the html crosses the network once, in one join on the payload digest, whose right side has
one row per repeated payload; Spark splits the partition of a payload that a third of all pages
share. A writer holds one bundle of at most `bundle_bytes` at a time, a reader one frame.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastbreak.llm.common import lookup, materialize

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 16 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle string, content binary, index array<struct<record_id:string,frame:int,offset:int,length:int>>"
INDEX_ARROW = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
RECORDS = "record_id string, page_id bigint, record_type string, refers_to bigint, url string, payload_digest string, payload_bytes bigint, payload binary"


def resolve(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"))
    base = base.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("bigint")})
    large = base.where(F.col("payload_bytes") >= revisit_bytes)
    first = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = lookup(base, first, "payload_digest", "originals")
    refers = F.when((F.col("original") != F.col("page_id")) | F.col("page_id").isNull(), F.col("original"))
    return found.select("page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def header(url: str | None) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return f"WARC-Target-URI: {safe}\r\n".encode() if url is not None else b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> tuple[str, bytes]:
    """A record's id and its bytes."""
    rid = f"urn:page:{'' if page_id is None else page_id}"
    lines = [b"WARC/1.1\r\n"]
    if refers_to is None:
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        lines.append(b"WARC-Type: response\r\n")
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        lines.append(f"WARC-Type: revisit\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n".encode())
    lines.append(header(url))
    lines.append(f"WARC-Record-ID: <{rid}>\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: {size}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode())
    return rid, b"".join(lines) + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's digest and length are those of the payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    out = {"record_id": fields["WARC-Record-ID"][1:-1], "page_id": int(page) if page else None, "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "refers_to": None}
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"refers_to": int(fields["WARC-Refers-To"][len("<urn:page:") : -1]), "payload_digest": told, "payload_bytes": int(fields["X-Payload-Length"]), "payload": None}
    digest = hashlib.sha1(payload).hexdigest()
    if digest != told:
        raise ValueError(f"{out['record_id']}: payload digest {digest}, header says {told}")
    return out | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload}


class Bundle:
    """Frames and index of a bundle under way."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.at = self.size = 0

    def add(self, rid: str, data: bytes) -> None:
        if self.open and self.at + len(data) > self.frame_bytes:
            self.flush()
        self.index.append({"record_id": rid, "frame": len(self.frames), "offset": self.at, "length": len(data)})
        self.open.append(data)
        self.at += len(data)

    def flush(self) -> None:
        if self.open:
            packed = self.pack(b"".join(self.open))
            self.frames.append((packed, self.at))
            self.size += len(packed)
            self.open, self.at = [], 0

    def content(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<II", len(packed), plain) for packed, plain in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(packed for packed, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - i))
        out.append((at, packed, plain))
        at += packed
    return out


def frame(content: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, plain = entry
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives of `resolve`'s rows; returns the written table of bundles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes, level)

        def done() -> pa.RecordBatch:
            content = bundle.content()
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:05d}.warc.zst"]), pa.array([content], pa.binary()), pa.array([bundle.index], INDEX_ARROW)], names=["bundle", "content", "index"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")), strict=True):
                bundle.add(*record(*row))
                if bundle.size >= bundle_bytes:
                    yield done()
                    n, bundle = n + 1, Bundle(frame_bytes, level)
        if bundle.index:
            yield done()

    return materialize(records.mapInArrow(pack, BUNDLES), "bundles")


def record_batch(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in RECORDS.split(", ") if with_payload or not c.startswith("payload ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of every bundle, frame by frame."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, index in zip(batch.column(0), batch.column(1), strict=True):
                content, by = content.as_py(), {}
                for x in index.as_py():
                    by.setdefault(x["frame"], []).append(x)
                for k, entry in enumerate(seek_table(content)):
                    plain = frame(content, entry)
                    yield record_batch([parse(plain[x["offset"] : x["offset"] + x["length"]]) for x in by.get(k, [])], with_payload)

    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    return bundles.select("content", "index").mapInArrow(unpack, schema)


def find_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in `wanted`, each by its frame alone."""
    held = bundles.select("bundle", F.explode("index").alias("x")).select("bundle", "x.*").join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    spots = held.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("spots"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, own in zip(batch.column(0), batch.column(1), strict=True):
                content, last, plain = content.as_py(), None, b""
                frames, rows = seek_table(content), []
                for x in own.as_py():
                    if x["frame"] != last:
                        last, plain = x["frame"], frame(content, frames[x["frame"]])
                    rows.append(parse(plain[x["offset"] : x["offset"] + x["length"]]))
                yield record_batch(rows, True)

    return bundles.select("bundle", "content").join(spots, "bundle").select("content", "spots").mapInArrow(fetch, RECORDS)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Copy bundles out as files of a folder that all executors mount; returns names and sizes."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1), strict=True):
                half = f"{folder}/.{name}.{os.getpid()}"
                with open(half, "wb") as f:
                    sizes.append(f.write(content.as_py()))
                os.replace(half, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["bundle", "bytes"])

    return bundles.select("bundle", "content").mapInArrow(save, "bundle string, bytes bigint")


def import_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles from `.warc.zst` files; their index is read from the records themselves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                content, index = content.as_py(), []
                for k, entry in enumerate(seek_table(content)):
                    plain, at = frame(content, entry), 0
                    while at < len(plain):
                        head = plain.index(b"\r\n\r\n", at)
                        fields = plain[at:head].decode()
                        end = head + 8 + int(re.search(r"\r\nContent-Length: (\d+)", fields)[1])
                        index.append({"record_id": re.search(r"\r\nWARC-Record-ID: <(.*?)>", fields)[1], "frame": k, "offset": at, "length": end - at})
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path.as_py())]), pa.array([content], pa.binary()), pa.array([index], INDEX_ARROW)], names=["bundle", "content", "index"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content").mapInArrow(scan, BUNDLES)


def op2_warc_bundles(pages: DataFrame) -> DataFrame:
    read = read_bundles(write_bundles(resolve(pages)))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN original END AS refers_to
FROM m
"""
