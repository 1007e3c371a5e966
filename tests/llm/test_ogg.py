"""The container: round trips, checksums by plain division, and damage."""

import hashlib
import random
import struct
import zlib

import pytest
from messy import ROWS, documents, empty

from tidewheel.llm import ogg as O


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        crc &= 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 255, 4095, 4096, 65536, 200_001])
def test_round_trip(size):
    text = random.Random(size).randbytes(size)
    raw = O.write_media(text)
    media = O.read_media(raw)
    assert media.n_bytes == size and media.payload == O.payload_of(text) and len(media.payload) % 64 == 0 and media.payload
    assert media.seconds == sorted(media.seconds) and media.seconds[-1] == len(media.payload) / O.RATE
    assert raw == O.write_media(text)


def test_checksum_is_the_containers():
    for data in (b"", b"\x00", b"OggS", random.Random(1).randbytes(500)):
        assert O.page_crc(data) == slow_crc(data)


def test_packets_over_page_ends_and_lacing():
    sizes = (10, 255, 0, 70_000, 510, 130_000, 254)
    packets = [(random.Random(n).randbytes(n), k) for k, n in enumerate(sizes)]
    pages = O.paged(packets, 9)
    stream = O.read_pages(b"".join(raw for _, raw in pages))[9]
    assert stream.packets == [p for p, _ in packets] and stream.pages == len(pages) > 4
    assert any(g == O.NO_GRANULE for g, _ in pages)  # a page on which no packet ends


def test_streams_are_parted_by_serial_number():
    a, b = O.paged([(b"a", 0), (b"x" * 70_000, 5)], 1), O.paged([(b"b", 0), (b"y" * 70_000, 6)], 2)
    mixed = b"".join(raw for pair in zip(a, b) for _, raw in pair)
    found = O.read_pages(mixed)
    assert found[1].packets == [b"a", b"x" * 70_000] and found[2].packets == [b"b", b"y" * 70_000] and found[2].granules[-1] == 6


def test_damage_is_found():
    raw = O.write_media(random.Random(3).randbytes(90_000))
    second = raw.index(b"OggS", 1)
    cases = [raw[:-1], raw[1:], raw[second:], raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], raw + raw, raw[:500] + raw[501:], raw[: raw.rindex(b"OggS")]]
    for k in (0, 100, 5000, 89_000, len(raw) - 2):
        cases.append(raw[:k] + bytes([raw[k] ^ 0x10]) + raw[k + 1 :])
    for bad in cases:
        with pytest.raises((O.Damaged, struct.error)):
            O.read_media(bad)


def test_messy_documents(spark):
    rows = O.read_back(O.with_media(documents(spark))).collect()
    want = []
    for r in ROWS:
        text = (r[1] or "").encode()
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        want.append((r[0], len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:  # the features by plain loops
        payload = next(p for p in ((t or "").encode() + bytes(max(64, -(-len((t or "").encode()) // 64) * 64) - len((t or "").encode())) for _, t, *_ in ROWS) if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        level = (sum((b - 128) ** 2 for b in payload) / len(payload)) ** 0.5 / 128
        crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:]))
        packets = 1 + -(-len(payload) // 4096)
        laces = sum(len(payload[k : k + 4096]) // 255 + 1 for k in range(0, len(payload), 4096))
        sample_pages = 1 + -(-laces // 255)
        index_pages = 1 + -(-(-(-len(payload) // 65536)) // 255)
        stamps = 1 + sum(1 for _ in range(sample_pages - 1))  # packets end on every page here
        got = dict(x.split("=") for x in r.feature.split(";"))
        assert float(got["level"]) == pytest.approx(level, abs=1e-6) and int(got["crossings"]) == crossings and float(got["seconds"]) == pytest.approx(len(payload) / 8000, abs=1e-4)
        assert (int(got["pages"]), int(got["stamps"])) == (sample_pages + index_pages, stamps) and packets > 1
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature) if r.n_bytes != 0 else None)
    assert all(len(v) == 1 for v in by.values())


def test_empty_table(spark):
    assert O.read_back(O.with_media(empty(spark))).count() == 0
