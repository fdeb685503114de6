"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a skippable frame that holds the seek table (sizes of each
frame), so any frame can be read alone. The index maps a record identifier to its bundle, frame, and offset in the frame's
content. Bundles are rows of a Parquet table in the shared folder, each a whole .warc.zst file: Spark's commit makes the
table complete or absent, whichever executors are lost.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, materialize, new_path, write_table

FRAME, BUNDLE = 256 << 10, 4 << 20  # bytes of records in a frame, bytes of frames in a bundle, about
MIN_REVISIT = 1000
FEW = 200_000  # groups of equal payloads that are broadcast, at most (some 20 MB); with more, rows are joined by shuffling
#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages have no fetch time
SCHEMA = "bundle string, data binary, entries array<struct<record_id:string,frame:int,offset:int,length:int>>"


@dataclass
class Archive:
    spark: SparkSession
    path: str

    def bundles(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def index(self) -> DataFrame:
        """record_id, bundle, frame, offset, length."""
        return self.bundles().select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.offset", "e.length")


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def _page_of(identifier: str) -> int | None:
    name = identifier.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response, or, if payload is None, a revisit: HTTP headers (with the payload's length) without the payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case, `http-length` added), payload, and where the next record begins."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    head = {k.lower(): v for k, v in head.items()}
    begin = end + 4
    block = data[begin : begin + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    head["http-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return head, payload, begin + len(block) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    each = 12 if flags & 0x80 else 8
    table, places, at = len(data) - 9 - n * each, [], 0
    for k in range(n):
        size = struct.unpack_from("<I", data, table + k * each)[0]
        places.append((at, at + size))
        at += size
    return places


class _Bundle:
    def __init__(self, name: str):
        import zstandard

        self.name, self.frames, self.sizes, self.entries, self.open = name, [], [], [], bytearray()
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, identifier: str, record: bytes) -> None:
        self.entries.append({"record_id": identifier, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.open = bytearray()

    def row(self) -> pa.RecordBatch:
        self.close_frame()
        data = b"".join(self.frames) + seek_table(self.sizes)
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([data], pa.binary()), pa.array([self.entries], kind)], names=["bundle", "data", "entries"])


def write_archive(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT) -> Archive:
    """Writes a record for each row (page_id, url, html) and returns the archive.

    Of equal payloads of at least min_revisit bytes, the record with the largest page_id is the response, others revisit it.
    A null html is an empty payload; a null page_id is the smallest, and a group of null ids only has responses. Rows that repeat a
    page_id with the same payload are alike, so repeats of the response are responses too. Other columns are ignored;
    an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "sha1": F.sha1(F.encode("html", "UTF-8")), "same": F.sha2(F.encode("html", "UTF-8"), 256)})
    # Payloads stay where they are: groups of equal ones are found by digest and size alone.
    groups = rows.where(F.col("size") >= min_revisit).groupBy("same", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("best")).where("n > 1")
    groups = materialize(groups.select("same", "best"), "warc-groups")
    if groups.limit(FEW + 1).count() <= FEW:
        rows = rows.join(F.broadcast(groups), "same", "left")
    else:
        rows = attach_by_key(rows, groups, "same", F.col("page_id"))
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    rows = rows.select("page_id", "url", "size", "sha1", F.when(revisit, F.col("best")).alias("refers_to"), F.when(~revisit, F.col("html")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        bundle = _Bundle(f"{part:05d}-{k:05d}")
        for batch in batches:
            for page, url, size, sha1, refers_to, text in zip(*(batch.column(i) for i in range(6)), strict=True):
                payload = text.as_py()
                bundle.add(record_id(page.as_py()), make_record(page.as_py(), url.as_py(), None if payload is None else payload.encode(), size.as_py(), sha1.as_py(), refers_to.as_py()))
                if sum(s for s, _ in bundle.sizes) >= BUNDLE:
                    yield bundle.row()
                    k += 1
                    bundle = _Bundle(f"{part:05d}-{k:05d}")
        if bundle.entries:
            yield bundle.row()

    write_table(rows.mapInArrow(run, SCHEMA), path)
    return Archive(spark, path)


def _facts(head: dict[str, str], payload: bytes) -> list:
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = head["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["http-length"])):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    refers_to = head.get("warc-refers-to")
    return [_page_of(head["warc-record-id"]), int(head["http-length"]), digest, kind, _page_of(refers_to) if refers_to else None]


_FACTS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_FACTS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(archive: Archive, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to; with payloads,
    also payload (null for revisits). Responses are checked against their digests."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for column in batch.column("data"):
                data = column.as_py()
                for begin, end in frame_places(data):
                    records, at, rows = reader.decompress(data[begin:end]), 0, []
                    while at < len(records):
                        head, payload, at = parse_record(records, at)
                        rows.append([*_facts(head, payload), payload if head["warc-type"] == "response" else None])
                    kinds = _FACTS + [("payload", pa.binary())] * payloads
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return archive.bundles().select("data").mapInArrow(run, _FACTS_DDL + ", payload binary" * payloads)


def fetch_records(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The records of the identifiers in wanted (record_id), each read by its frame alone: record_id and record (bytes)."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, out = [], []
            for data, entries in zip(batch.column("data"), batch.column("found"), strict=True):
                bundle, frames = data.as_py(), {}
                places = frame_places(bundle)
                for e in entries.as_py():
                    if e["frame"] not in frames:
                        frames = {e["frame"]: reader.decompress(bundle[slice(*places[e["frame"]])])}
                    ids.append(e["record_id"])
                    out.append(frames[e["frame"]][e["offset"] : e["offset"] + e["length"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["record_id", "record"])

    found = archive.index().join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    found = found.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("found"))
    return archive.bundles().select("bundle", "data").join(found, "bundle").select("data", "found").mapInArrow(run, "record_id string, record binary")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, b, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN n >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND best <> page_id THEN best END AS refers_to FROM q
"""
