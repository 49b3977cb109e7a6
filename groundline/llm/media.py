"""Media columns: the Ogg container.

Writing deals the payload out in packets to logical streams in turn, wraps each stream's packets in
pages (lacing values of 255 go on, a lower one ends the packet; a packet may go on over pages) and
multiplexes the pages.  Reading verifies every page's checksum and number, reassembles packets
from lacing values, demultiplexes the streams by serial number, and takes timestamps from
the granule positions.

Samples are bytes, 8 bits each.  Defined results: a null text counts as an empty one, whose payload is
one block of blanks; equal texts give equal bytes, and repeated rows a row each; an empty
table gives no rows; a very long text is taken whole, in a slice of its own; other columns are left out; a damaged page raises OggError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm import common

BLOCK = 192
FILL = b" "
RATE = 8000
STREAMS = 2
#: Samples of a packet, and segments of a page (at most 255).
PACKET, SEGMENTS = 16 * BLOCK, 44
HEAD = struct.Struct("<4sBBqIII")
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC = b"\x7fPCM8"


class OggError(ValueError):
    pass


_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, bits unreflected, from 0 and with no final inversion.

    zlib's is the reflected one with both inversions; reversing the bits of every byte, and of the result, leads from one to the other.
    """
    got = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_REVERSED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    total = checksum(head + body)
    return head[:22] + struct.pack("<I", total) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = SEGMENTS) -> list[bytes]:
    """Pages of a logical stream; packets: data and the granule position at its end."""
    lacing, marks, ends = bytearray(), [], {}
    for data, granule in packets:
        full, rest = divmod(len(data), 255)
        lacing += b"\xff" * full + bytes([rest])
        marks.append(len(lacing))
        ends[len(lacing) - 1] = granule
    body = b"".join(d for d, _ in packets)
    pages, at, number, head_end = [], 0, 0, marks[0]
    start = 0
    while start < len(lacing):
        # the header packet has a page of its own
        end = head_end if start == 0 else min(len(lacing), start + segments)
        part = bytes(lacing[start:end])
        size = sum(part)
        done = [ends[k] for k in range(start, end) if k in ends]
        kind = (FIRST if start == 0 else 0) | (LAST if end == len(lacing) else 0) | (CONTINUED if start and lacing[start - 1] == 255 else 0)
        pages.append(page(kind, done[-1] if done else -1, serial, number, part, body[at : at + size]))
        start, at, number = end, at + size, number + 1
    return pages


def write(payload: bytes, streams: int = STREAMS, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file whose logical streams hold the payload's packets in turn."""
    parts: list[list[tuple[bytes, int]]] = [[(MAGIC + struct.pack("<IHHQ", rate, k, streams, len(payload)), 0)] for k in range(streams)]
    granules = [0] * streams
    for n, at in enumerate(range(0, len(payload), packet)):
        k, data = n % streams, payload[at : at + packet]
        granules[k] += len(data)
        parts[k].append((data, granules[k]))
    pages = [stream_pages(k + 1, p) for k, p in enumerate(parts)]
    out = [p[0] for p in pages]  # all first pages stand before the rest
    for n in range(1, max(map(len, pages))):
        out += [p[n] for p in pages if n < len(p)]
    return b"".join(out)


@dataclass
class Logical:
    """A logical stream as read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    open: list[bytes] = field(default_factory=list)
    ended: bool = False


def demultiplex(data: bytes) -> dict[int, Logical]:
    """The logical streams; every page's checksum, number and flags are verified."""
    found: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) < at + 27:
            raise OggError(f"page cut off at {at}")
        magic, version, kind, granule, serial, number, total = HEAD.unpack_from(data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or len(data) < at + size:
            raise OggError(f"no page at {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : at + size]) != total:
            raise OggError(f"checksum of the page at {at}")
        if bool(kind & FIRST) == (serial in found):
            raise OggError(f"first page of stream {serial}")
        s = found.setdefault(serial, Logical(serial))
        if number != s.pages or s.ended or bool(kind & CONTINUED) != bool(s.open):
            raise OggError(f"page {number} of stream {serial} is out of order")
        s.pages, s.ended = s.pages + 1, bool(kind & LAST)
        body, run = at + 27 + n, 0
        for value in lacing:
            run += value
            if value < 255:
                s.packets.append(b"".join([*s.open, data[body : body + run]]))
                s.open, body, run = [], body + run, 0
        if run or (lacing and lacing[-1] == 255):
            s.open.append(data[body : body + run])
        if granule >= 0:
            s.granules.append(granule)
        at += size
    for s in found.values():
        if s.open or not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return found


@dataclass
class Media:
    payload: bytes
    rate: int
    streams: list[Logical]

    @property
    def timestamps(self) -> list[list[float]]:
        """Seconds at the end of each page that ends a packet, by stream."""
        return [[g / self.rate for g in s.granules] for s in self.streams]

    def feature(self) -> str:
        ends = [s.granules[-1] for s in self.streams]
        return ";".join((f"streams={len(self.streams)}", f"pages={sum(s.pages for s in self.streams)}", f"packets={sum(len(s.packets) for s in self.streams)}", f"granules={','.join(map(str, ends))}", f"duration_ms={round(1000 * max(ends) / self.rate)}"))


def parse(data: bytes) -> Media:
    streams = sorted(demultiplex(data).values(), key=lambda s: s.serial)
    if not streams or any(not s.packets or s.packets[0][: len(MAGIC)] != MAGIC for s in streams):
        raise OggError("no header packet")
    rate, _, count, total = struct.unpack_from("<IHHQ", streams[0].packets[0], len(MAGIC))
    if count != len(streams):
        raise OggError("a stream is missing")
    rest = [s.packets[1:] for s in streams]
    payload = b"".join(p[n] for n in range(max(map(len, rest), default=0)) for p in rest if n < len(p))
    if len(payload) != total:
        raise OggError("payload is incomplete")
    return Media(payload, rate, streams)


def padded(text: bytes, block: int = BLOCK) -> bytes:
    return text + FILL * (max(block, -(-len(text) // block) * block) - len(text))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes in an Ogg file."""
    out = common.arrow_schema("doc_id long, n_bytes long, media binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.as_bytes(common.text_or_empty(text_col)).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, digest: bool = True) -> DataFrame:
    """Read stored files back: digests of payload and file, or with digest false the payload, and the feature text."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, " + ("payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string" if digest else "payload binary, timestamps array<array<double>>") + ", feature string"
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "media"):
            stored = b.column("media").to_pylist()
            read = [parse(m) for m in stored]
            payloads = [m.payload for m in read]
            mid = [pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array(map(len, stored), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored])] if digest else [pa.array(payloads, pa.binary()), pa.array([m.timestamps for m in read], out.field(4).type)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(map(len, payloads), pa.int64()), *mid, pa.array([m.feature() for m in read])], schema=out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)
