"""Ogg containers in binary columns: pages, checksums, lacing, logical streams, granule positions.

``write_streams`` puts packets of several logical streams into one interleaved byte string; ``read_streams``
verifies each page, joins packets over page borders and separates the streams again. ``store_texts`` applies both
to texts. Bad input raises nothing: ``read_streams`` lists what is wrong and gives
the packets that are whole. A null or empty text is stored as one block of 192 spaces.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_texts

BLOCK = 192
RATE = 8000
STREAMS = 2
#: Samples (bytes) of one data packet; not a multiple of 255, and larger than a page of a few segments.
PACKET_BYTES = 20 * BLOCK
PAGE_SEGMENTS = 40
HEAD = struct.Struct("<4sBBqIII")
IDENT = struct.Struct("<8sHHIq")
MAGIC = b"u8sound\0"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, bits unreflected, start 0, no final xor.

    It is zlib's CRC of the bit-reversed bytes, bit-reversed itself.
    """
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    page = bytearray(head + body)
    page[22:26] = struct.pack("<I", page_crc(bytes(page)))
    return bytes(page)


def stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = PAGE_SEGMENTS) -> list[bytes]:
    """Pages of one logical stream. packets: with the granule position each ends at; the first gets its own page."""
    pages, number = [], 0
    lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST

    def flush(more: int, going_on: bool) -> None:
        nonlocal lacing, body, granule, flags, number
        pages.append(_page(flags | more, granule, serial, number, bytes(lacing), bytes(body)))
        number += 1
        lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED if going_on else 0

    for k, (data, at) in enumerate(packets):
        size, done = len(data), 0
        while True:
            room = segments - len(lacing)
            full = min((size - done) // 255, room)
            lacing += b"\xff" * full
            body += data[done : done + 255 * full]
            done += 255 * full
            if full == room:
                flush(0, True)
                continue
            lacing.append(size - done)
            body += data[done:]
            granule = at
            break
        last = k == len(packets) - 1
        if last or k == 0 or len(lacing) == segments:
            flush(LAST if last else 0, False)
    return pages


def write_streams(streams: list[tuple[int, list[tuple[bytes, int]]]], segments: int = PAGE_SEGMENTS) -> bytes:
    """One physical stream: all first pages come first, the others alternate."""
    pages = [stream_pages(serial, packets, segments) for serial, packets in streams]
    out = [p[0] for p in pages]
    for k in range(1, max(map(len, pages), default=0)):
        out += [p[k] for p in pages if k < len(p)]
    return b"".join(out)


@dataclass
class Logical:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of the page on which each packet ends, for the last packet that ends there; else -1.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: bytearray | None = None


def read_streams(data: bytes) -> tuple[list[Logical], list[str]]:
    """Logical streams by first appearance, and faults. A page with a wrong checksum is left out, as is a packet
    of which a page is missing."""
    streams: dict[int, Logical] = {}
    faults: list[str] = []
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 4] != b"OggS" or at + 27 > end:
            faults.append(f"no page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc = HEAD.unpack_from(data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        body_at, size = at + 27 + n, sum(lacing)
        stop = body_at + size
        if stop > end or len(lacing) < n or version:
            faults.append(f"broken page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : stop]) != crc:
            faults.append(f"checksum of page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Logical(serial))
        if bool(flags & FIRST) != (s.pages == 0 and number == 0):
            faults.append(f"start of stream {serial} at {at}")
        if number != s.pages:
            faults.append(f"page {s.pages} of stream {serial} is missing")
            s.pages, s.open = number, None
        keep = True
        if flags & CONTINUED:
            keep = s.open is not None
        elif s.open is not None:
            faults.append(f"unended packet of stream {serial}")
            s.open = None
        current = s.open if s.open is not None else bytearray()
        first = len(s.packets)
        pos = run_at = body_at
        k = 0
        while k < n:
            j = k
            while j < n and lacing[j] == 255:
                j += 1
            pos += 255 * (j - k)
            if j == n:
                current += data[run_at:pos]
                break
            pos += lacing[j]
            current += data[run_at:pos]
            if keep:
                s.packets.append(bytes(current))
                s.granules.append(-1)
            current, keep, run_at, k = bytearray(), True, pos, j + 1
        s.open = current if n and lacing[-1] == 255 and keep else None
        if len(s.packets) > first:
            s.granules[-1] = granule
        s.pages += 1
        s.ended |= bool(flags & LAST)
        at = stop
    for s in streams.values():
        if not s.ended or s.open is not None:
            faults.append(f"stream {s.serial} has no end")
    return list(streams.values()), faults


def pad(text: bytes) -> bytes:
    """Spaces (32) up to a positive multiple of BLOCK."""
    return text + b" " * (BLOCK - len(text) if len(text) < BLOCK else -len(text) % BLOCK)


def encode_payload(payload: bytes) -> bytes:
    """8-bit samples at RATE, dealt to STREAMS logical streams packet by packet.

    A stream starts with a packet that has the magic, its index, the number of streams, the rate and the number of
    samples in all of them; granule positions count a stream's own samples.
    """
    streams = []
    chunks = [payload[i : i + PACKET_BYTES] for i in range(0, len(payload), PACKET_BYTES)]
    for k in range(STREAMS):
        packets, done = [(IDENT.pack(MAGIC, k, STREAMS, RATE, len(payload)), 0)], 0
        for c in chunks[k::STREAMS]:
            done += len(c)
            packets.append((c, done))
        streams.append((0x5EED0000 + k, packets))
    return write_streams(streams)


def decode_payload(media: bytes) -> tuple[bytes, dict]:
    """The samples, read back, and features: streams, pages, packets, seconds of each stream, faults."""
    streams, faults = read_streams(media)
    by_index: dict[int, Logical] = {}
    total = 0
    for s in streams:
        if s.packets and len(s.packets[0]) == IDENT.size and s.packets[0][:8] == MAGIC:
            _, index, _, rate, total = IDENT.unpack(s.packets[0])
            by_index[index] = s
    n = len(by_index)
    out: list[bytes] = [b""] * sum(len(s.packets) - 1 for s in by_index.values())
    for index, s in by_index.items():
        if len(out[index::n]) == len(s.packets) - 1:
            out[index::n] = s.packets[1:]
        else:
            faults.append(f"packets of stream {index}")
    payload = b"".join(out)
    if len(payload) != total:
        faults.append("length")
    ends = [max(s.granules) for _, s in sorted(by_index.items())]
    return payload, {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams),
        "packets": sum(len(s.packets) for s in streams),
        "seconds": [g / RATE for g in ends],
        "faults": faults,
    }


def packet_times(stream: Logical, rate: int = RATE) -> list[float | None]:
    """End of each packet in seconds, from the granule positions of the pages; packets before a page's last one
    count back by their own samples, as one byte is one sample."""
    out: list[float | None] = [None] * len(stream.packets)
    known: int | None = None
    for k in range(len(stream.packets) - 1, -1, -1):
        if stream.granules[k] >= 0:
            known = stream.granules[k]
        if known is not None:
            out[k] = known / rate
            known -= len(stream.packets[k])
    return out


SCHEMA = (
    "key {key}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text as an Ogg file (column ``media``; null if ``keep_media`` is false), and what reading it back gives.

    All hashes and features come from the stored bytes. A row whose bytes don't read back raises an error.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        rows: dict[str, list] = {k: [] for k in ("n", "media", "p", "sha", "crc", "m", "msha", "f")}
        for text in as_bytes(batch.column(1)):
            media = encode_payload(pad(text))
            payload, info = decode_payload(media)
            if info["faults"]:
                raise ValueError(f"stored media is broken: {info['faults'][:3]}")
            rows["n"].append(len(text))
            rows["media"].append(media if keep_media else None)
            rows["p"].append(len(payload))
            rows["sha"].append(hashlib.sha256(payload).hexdigest())
            rows["crc"].append(zlib.crc32(payload[-16:]))
            rows["m"].append(len(media))
            rows["msha"].append(hashlib.sha256(media).hexdigest())
            times = "+".join(f"{t:.6f}" for t in info["seconds"])
            rows["f"].append(f"ogg streams={info['streams']} pages={info['pages']} packets={info['packets']} seconds={times}")
        yield {"key": batch.column(0), **rows}

    return map_texts(docs, id_col, text_col, SCHEMA, work).withColumnRenamed("key", id_col)
