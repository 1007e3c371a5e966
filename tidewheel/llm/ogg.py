"""Media columns: payloads as 8-bit samples in Ogg streams, and the reader of such streams.

A file holds two logical streams: the samples, and an index with a checksum for each block of
samples. The reader verifies each page's checksum and sequence number, reassembles packets from
the lacing values (over page ends too), parts the logical streams by serial number, and derives
timestamps from granule positions, which count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import read_table, small_batches

# Fixed values of the container format.
CAPTURE, VERSION = b"OggS", 0
CONTINUED, FIRST, LAST = 1, 2, 4
PAGE_HEAD, PAGE_HEAD_BYTES = "<4sBBqIIIB", 27
MAX_SEGMENTS = 255
#: No packet ends on such a page.
NO_GRANULE = -1

SAMPLES, INDEX = 1, 2
SAMPLE_HEAD = "<8sIQ"
RATE, PACKET, BLOCK = 8000, 4096, 1 << 16
PAD = 64
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class Damaged(ValueError):
    """The bytes are not a well-formed stream."""


def page_crc(page: bytes) -> int:
    """The container's CRC-32: most significant bit first, from 0. It is zlib's with all bits mirrored."""
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(struct.pack(PAGE_HEAD, CAPTURE, VERSION, flags, granule, serial, number, 0, len(lacing)))
    raw = bytes(head) + lacing + body
    return raw[:22] + page_crc(raw).to_bytes(4, "little") + raw[26:]


def paged(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """A logical stream's pages as (granule, bytes), from packets with their end granules.

    The first packet has a page of its own, as the container asks.
    """
    pages: list[tuple[int, int, bytes, bytes]] = []
    for group in (packets[:1], packets[1:]):
        lacing, body, granule, flags = bytearray(), bytearray(), NO_GRANULE, 0
        for packet, at in group:
            laces = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            done = 0
            while done < len(laces):
                part = laces[done : done + MAX_SEGMENTS - len(lacing)]
                body += packet[255 * done : 255 * (done + len(part))]
                lacing += part
                done += len(part)
                if done == len(laces):
                    granule = at
                if len(lacing) == MAX_SEGMENTS:
                    pages.append((flags, granule, bytes(lacing), bytes(body)))
                    lacing, body, granule, flags = bytearray(), bytearray(), NO_GRANULE, CONTINUED if done < len(laces) else 0
        if lacing:
            pages.append((flags, granule, bytes(lacing), bytes(body)))
    last = len(pages) - 1
    return [(granule, page(flags | FIRST * (k == 0) | LAST * (k == last), granule, serial, k, lacing, body)) for k, (flags, granule, lacing, body) in enumerate(pages)]


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with 0 to a positive multiple of 64."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def write_media(text: bytes) -> bytes:
    """A file of both logical streams; it depends on the text alone."""
    payload = payload_of(text)
    size = len(payload)
    samples = [(struct.pack(SAMPLE_HEAD, b"samples8", RATE, len(text)), 0)] + [(payload[k : k + PACKET], min(size, k + PACKET)) for k in range(0, size, PACKET)]
    index = [(b"blocks32", 0)] + [(zlib.crc32(payload[k : k + BLOCK]).to_bytes(4, "little"), min(size, k + BLOCK)) for k in range(0, size, BLOCK)]
    a, b = paged(samples, SAMPLES), paged(index, INDEX)
    rest = sorted([(k, SAMPLES, raw) for k, (_, raw) in enumerate(a[1:])] + [(k, INDEX, raw) for k, (_, raw) in enumerate(b[1:])])
    return b"".join([a[0][1], b[0][1], *(raw for *_, raw in rest)])


@dataclass
class Stream:
    """What a logical stream holds: its packets and the (page number, granule) of its pages."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open_packet: list[bytes] | None = None
    pages: int = 0
    ended: bool = False


def read_pages(media: bytes) -> dict[int, Stream]:
    """The logical streams of a file by serial number."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < PAGE_HEAD_BYTES:
            raise Damaged("a page header is cut off")
        capture, version, flags, granule, serial, number, crc, n = struct.unpack_from(PAGE_HEAD, media, at)
        if capture != CAPTURE or version != VERSION:
            raise Damaged(f"no page begins at byte {at}")
        body = at + PAGE_HEAD_BYTES + n
        lacing = media[at + PAGE_HEAD_BYTES : body]
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise Damaged("a page is cut off")
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise Damaged(f"the page at byte {at} fails its checksum")
        if (serial not in streams) != bool(flags & FIRST):
            raise Damaged("a stream's first page is missing or comes twice")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or stream.ended:
            raise Damaged("a page is missing, repeated or after the last")
        if bool(flags & CONTINUED) != (stream.open_packet is not None):
            raise Damaged("a packet's continuation is missing")
        for size in lacing:
            stream.open_packet = stream.open_packet or []
            stream.open_packet.append(view[body : body + size])
            body += size
            if size < 255:
                stream.packets.append(b"".join(stream.open_packet))
                stream.open_packet = None
        if granule != NO_GRANULE:
            if stream.granules and granule < stream.granules[-1]:
                raise Damaged("granule positions go back")
            stream.granules.append(granule)
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.open_packet is not None for s in streams.values()):
        raise Damaged("a stream has no end")
    return streams


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    pages: int
    rate: int
    seconds: list[float]


def read_media(media: bytes) -> Media:
    """The payload and timestamps of a file made by ``write_media``, each block verified."""
    streams = read_pages(media)
    if set(streams) != {SAMPLES, INDEX}:
        raise Damaged("not the two streams expected")
    samples, index = streams[SAMPLES], streams[INDEX]
    kind, rate, n_bytes = struct.unpack(SAMPLE_HEAD, samples.packets[0])
    payload = b"".join(samples.packets[1:])
    sums = [zlib.crc32(payload[k : k + BLOCK]).to_bytes(4, "little") for k in range(0, len(payload), BLOCK)]
    if kind != b"samples8" or sums != index.packets[1:] or samples.granules[-1] != len(payload):
        raise Damaged("the samples do not match the index")
    return Media(payload, n_bytes, samples.pages + index.pages, rate, [g / rate for g in samples.granules])


def features(media: Media) -> str:
    """Length in seconds, pages, level and zero crossings of the samples around their middle value."""
    x = np.frombuffer(media.payload, np.uint8).astype(np.int16) - 128
    level = float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) / 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"seconds={media.seconds[-1]:.4f};pages={media.pages};stamps={len(media.seconds)};level={level:.6f};crossings={crossings}"


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text, a null one as empty, as a file.

    A row for each row of ``docs``; equal texts give equal files. No rows give an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write_media(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


def read_back(table: DataFrame) -> DataFrame:
    """Digests and features of a (doc_id, media) table; a damaged file fails the job.

    A row for each row, repeated ones too. No rows give an empty result.
    """
    small_batches(table.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                media = read_media(raw)
                rows.append((doc_id, media.n_bytes, len(media.payload), hashlib.sha256(media.payload).hexdigest(), zlib.crc32(media.payload[-PAD:]), len(raw), hashlib.sha256(raw).hexdigest(), features(media)))
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return table.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(with_media(read_table(spark, sf_dir, "documents")))
