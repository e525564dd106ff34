import hashlib
import zlib

import pytest
from tracewell.llm import media, queries

from .cases import as_set, empty, frame, nasty_rows


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert media.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 3839, 3840, 3841, 50_000, 255 * 40, 300_001])
def test_round_trip(size):
    payload = media.pad((bytes(range(256)) * (size // 256 + 1))[:size])
    assert len(payload) % 192 == 0 and len(payload) > 0
    stored = media.encode_payload(payload)
    back, info = media.decode_payload(stored)
    assert back == payload and info["faults"] == [] and info["streams"] == 2
    assert sum(info["seconds"]) * media.RATE == pytest.approx(len(payload))


@pytest.mark.parametrize("sizes", [[0], [255], [254, 256], [255 * 40], [255 * 41, 0, 3], [70_000, 1]])
def test_lacing(sizes):
    packets = [(b"head", 0), *((bytes([k]) * n, 10 * (k + 1)) for k, n in enumerate(sizes))]
    (stream,), faults = media.read_streams(media.write_streams([(7, packets)]))
    assert faults == [] and stream.packets == [p for p, _ in packets] and stream.ended


def test_two_streams_are_separated_and_timed():
    made = media.write_streams([(1, [(b"h", 0), (b"a" * 9000, 9000), (b"b" * 10, 9010)]), (2, [(b"i", 0), (b"c" * 400, 400)])])
    first, second = media.read_streams(made)[0]
    assert [len(p) for p in first.packets] == [1, 9000, 10] and [len(p) for p in second.packets] == [1, 400]
    assert media.packet_times(first, 1000) == [0.0, 9.0, 9.01] and max(second.granules) == 400


def test_damage_is_found():
    stored = media.encode_payload(media.pad(b"x" * 20_000))
    flipped = bytearray(stored)
    flipped[len(stored) // 2] ^= 1
    assert any("checksum" in f for f in media.decode_payload(bytes(flipped))[1]["faults"])
    assert media.decode_payload(stored[:-5])[1]["faults"] and media.decode_payload(b"junk")[1]["faults"]
    cut = stored.find(b"OggS", stored.find(b"OggS", 200) + 1)
    assert media.decode_payload(stored[:100] + stored[cut:])[1]["faults"]


@pytest.mark.parametrize("clash", [False, True])
def test_columns(spark, clash):
    rows = nasty_rows()
    got = as_set(media.store_texts(frame(spark, rows, clash)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        want.append(repr((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))))
    assert got == sorted(want)
    assert media.store_texts(empty(spark)).count() == 0


def test_media_column(spark):
    for r in media.store_texts(frame(spark, nasty_rows())).collect():
        assert len(r["media"]) == r["media_bytes"] and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        assert hashlib.sha256(media.decode_payload(bytes(r["media"]))[0]).hexdigest() == r["payload_sha256"]


def test_query(spark, sf_small):
    out = queries.op4_media(spark, sf_small)
    assert out.count() == 200 and "media" not in out.columns
