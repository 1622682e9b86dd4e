"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames
followed by a seek table in a skippable frame (the published seekable format), so any
Zstandard reader can unpack it and a reader that knows the footer can open one frame. An
index maps a record id to (bundle, frame, offset within the frame, length), so one record
is read by unpacking one frame.

Bundles are rows of a Parquet table with a binary column, written by Spark's own writer:
the shared folder may be one that only Spark reaches, and a task that is run again
replaces its output as a whole. A bundle is closed at ``bundle_bytes`` of records, which
bounds its memory and the size of a row; a longer record has a bundle to itself.

Records of equal payload: the smallest id is the response, the others are revisits that
carry the HTTP head and the digest but no payload. Equality is by SHA-1 and length.
Finding the smallest id is an aggregation with a map-side combine; the join back has one
row per payload on its other side, so Spark can split a hot payload.

Nulls: a null payload is empty, a null address or id is written as an empty header and
read as null. Rows that repeat the smallest id of a payload are all responses. Extra
columns are not carried. An empty table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1

BUNDLES = "bundle string, archive binary, ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"
READ = (
    "record_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary"
)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer for frames of (packed, unpacked) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes)
    body += struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames_of(archive: bytes) -> list[tuple[int, int]]:
    """(start, end) of every frame, read from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at = len(archive) - 9 - entry * count
    found, start = [], 0
    for i in range(count):
        (packed,) = struct.unpack_from("<I", archive, at + i * entry)
        found.append((start, start + packed))
        start += packed
    return found


def record(
    record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(n: int | None) -> str:
    return "" if n is None else f"<urn:record:{n}>"


def _number(urn: str) -> int | None:
    return int(urn.removeprefix("<urn:record:").removesuffix(">")) if urn else None


def _clean(url: str | None) -> str:
    """Line breaks would end the header."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    return head, data[start:end], end + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _unpacked(record_bytes: bytes) -> dict:
    """What a record says; the digest of a stored payload is computed anew."""
    head, block, _ = parse(record_bytes, 0)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = head["WARC-Type"] == "revisit"
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (digest_of(payload) != stated or len(payload) != size):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {
        "record_id": _number(head["WARC-Record-ID"]),
        "url": head["WARC-Target-URI"] or None,
        "record_type": head["WARC-Type"],
        "refers_to": _number(head.get("WARC-Refers-To", "")),
        "payload_digest": stated,
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


def _bundle(records: Iterable[tuple[int | None, bytes]], frame_bytes: int, level: int) -> dict:
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    out, sizes, ids, frames, offsets, lengths = io.BytesIO(), [], [], [], [], []
    frame = bytearray()

    def close() -> None:
        packed = packer.compress(bytes(frame))
        out.write(packed)
        sizes.append((len(packed), len(frame)))
        frame.clear()

    for record_id, data in records:
        if frame and len(frame) + len(data) > frame_bytes:
            close()
        ids.append(record_id)
        frames.append(len(sizes))
        offsets.append(len(frame))
        lengths.append(len(data))
        frame += data
    if frame:
        close()
    out.write(seek_table(sizes))
    return {
        "bundle": uuid.uuid4().hex,
        "archive": out.getvalue(),
        "ids": ids,
        "frames": frames,
        "offsets": offsets,
        "lengths": lengths,
    }


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def write_bundles(records: DataFrame, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Bundles of ``records`` (record_id, url, payload, first), in the order of their rows.

    ``first`` is the id of the response that holds the same payload.
    """
    schema = _arrow(BUNDLES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for batch in batches:
            columns = (batch.column(n) for n in ("record_id", "url", "payload", "first"))
            for record_id, url, payload, first in zip(*columns):
                body = payload.as_py() or b""
                own, first = record_id.as_py(), first.as_py()
                revisit = own != first
                data = record(own, url.as_py(), body, digest_of(body), first, revisit)
                if held and size + len(data) > bundle_bytes:
                    yield pa.RecordBatch.from_pylist([_bundle(held, frame_bytes, level)], schema)
                    held, size = [], 0
                held.append((own, data))
                size += len(data)
        if held:
            yield pa.RecordBatch.from_pylist([_bundle(held, frame_bytes, level)], schema)

    return records.select("record_id", "url", "payload", "first").mapInArrow(pack, BUNDLES)


def read_bundles(bundles: DataFrame, payload: bool = True) -> DataFrame:
    """All records, frame by frame; without ``payload`` the content is checked, not returned."""
    schema = _arrow(READ)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive"):
                data = archive.as_py()
                for start, end in frames_of(data):
                    frame = zstandard.ZstdDecompressor().decompress(data[start:end])
                    at, found = 0, []
                    while at < len(frame):
                        *_, stop = parse(frame, at)
                        row = _unpacked(frame[at:stop])
                        found.append(row if payload else row | {"payload": None})
                        at = stop
                    yield pa.RecordBatch.from_pylist(found, schema)

    return bundles.select("archive").mapInArrow(unpack, READ)


def index(bundles: DataFrame) -> DataFrame:
    """Record id -> bundle, frame, offset within the unpacked frame, length."""
    entry = F.explode(F.arrays_zip("ids", "frames", "offsets", "lengths")).alias("e")
    return bundles.select("bundle", entry).select(
        F.col("e.ids").alias("record_id"),
        "bundle",
        F.col("e.frames").alias("frame"),
        F.col("e.offsets").alias("offset"),
        F.col("e.lengths").alias("length"),
    )


def lookup(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the wanted ids; only the frames that hold them are unpacked."""
    schema = _arrow(READ)
    wanted = index(bundles).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("at"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, at in zip(batch.column("archive"), batch.column("at")):
                data, open_frames, found = archive.as_py(), {}, []
                ends = frames_of(data)
                for place in at.as_py():
                    n = place["frame"]
                    if n not in open_frames:
                        start, end = ends[n]
                        open_frames[n] = zstandard.ZstdDecompressor().decompress(data[start:end])
                    start = place["offset"]
                    found.append(_unpacked(open_frames[n][start : start + place["length"]]))
                yield pa.RecordBatch.from_pylist(found, schema)

    # The places of one bundle are at most the records of that bundle.
    return bundles.join(places, "bundle").select("archive", "at").mapInArrow(pick, READ)


def with_first(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """record_id, url, payload (bytes) and the smallest id of an equal payload."""
    rows = pages.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    firsts = rows.groupBy("sha", "size").agg(F.min("record_id").alias("first"))
    return rows.join(firsts, ["sha", "size"], "left").select("record_id", "url", "payload", "first")
