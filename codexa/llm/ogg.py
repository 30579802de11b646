"""Ogg media columns: write and read physical streams of any bytes.

Reading verifies every page's checksum, takes packets from the lacing values (also across pages), demultiplexes
logical streams by serial number and derives timestamps from granule positions. The stored form here has two
logical streams, interleaved by page: ``pcm8`` (the payload as unsigned 8-bit samples, one granule a sample) and
``marks`` (one packet a second of samples, with the sample count so far).

Edge cases: a null or empty payload text still makes a stream (64 zero bytes); a packet whose length is a multiple of
255 ends with a lacing value of 0; a damaged page is reported and left out, and so is a packet that lacks a page; bytes
between pages are skipped up to the next capture pattern; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from codexa.llm.common import map_texts, table

# Fixed values of the container format (RFC 3533).
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = "<4sBBqIIIB"

RATE = 8000
PACKET = 4000
_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 0x04c11db7, most significant bit first), by mirroring the usual one."""
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "big").translate(_MIRROR), "little")


def page_bytes(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    blank = struct.pack(HEADER, CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def pages_of(packets: list[tuple[bytes, int]], serial: int, segments: int = 255) -> list[bytes]:
    """Pages for the (packet, granule at its end) of one logical stream; the first packet has a page of its own.

    A page's granule is that of the last packet that ends on it, or -1 if none does.
    """
    out, lacing, body, granule, flags = [], bytearray(), bytearray(), -1, FIRST

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, flags
        out.append(page_bytes(serial, len(out), granule, flags | (LAST if last else 0), bytes(lacing), bytes(body)))
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    for k, (packet, at) in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        done = 0
        for j, value in enumerate(values):
            if len(lacing) == segments:
                close(False)
                flags = CONTINUED if j else 0
            lacing.append(value)
            body += packet[done : done + value]
            done += value
        granule = at
        if k == len(packets) - 1 or k == 0:
            close(k == len(packets) - 1)
    return out


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The stored form; a function of the payload alone."""
    base = zlib.crc32(payload) & 0xFFFFFFFE
    n = len(payload)
    head = struct.pack("<4sHHIQ", b"PCM8", 1, 1, rate, n)
    audio = [(head, 0)] + [(payload[i : i + packet], min(i + packet, n)) for i in range(0, n, packet)]
    marks = [(struct.pack("<4sHHIQ", b"MARK", 1, 0, rate, n), 0)] + [(struct.pack("<Q", min(i + rate, n)), min(i + rate, n)) for i in range(0, n, rate)]
    a, b = pages_of(audio, base), pages_of(marks, base + 1, segments=16)
    mixed = [a[0], b[0]]
    for i in range(1, max(len(a), len(b))):
        mixed += a[i : i + 1] + b[i : i + 1]
    return b"".join(mixed)


@dataclass
class Stream:
    """One logical stream: its packets, and for each the granule known at its end (-1 if none ends its page)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _open: bytearray | None = None
    _next: int | None = None


def decode(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    bad, at = 0, media.find(CAPTURE)
    while at >= 0 and at + 27 <= len(media):
        _, version, flags, granule, serial, number, crc, segments = struct.unpack_from(HEADER, media, at)
        lacing = media[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < segments or end > len(media) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = media.find(CAPTURE, at + 1)
            continue
        s = streams.setdefault(serial, Stream())
        s.pages += 1
        s.ended |= bool(flags & LAST)
        if s._next is not None and number != s._next or not flags & CONTINUED:
            s.lost += s._open is not None
            s._open = None
        skip = bool(flags & CONTINUED) and s._open is None  # its beginning is missing
        s._next = number + 1
        body, part, done = 27 + segments, s._open or bytearray(), []
        for value in lacing:
            part += page[body : body + value]
            body += value
            if value < 255:
                if skip:
                    s.lost += 1
                else:
                    done.append(bytes(part))
                part, skip = bytearray(), False
        s._open = part if lacing and lacing[-1] == 255 and not skip else None
        s.packets += done
        s.granules += [-1] * (len(done) - 1) + [granule] if done else []
        at = media.find(CAPTURE, end)
    return streams, bad


def samples(streams: dict[int, Stream]) -> tuple[bytes, int, list[float]]:
    """Of the ``pcm8`` stream: its samples, their rate, and the time in seconds at which each page's last packet ends.

    Without that stream, as when its first page is damaged: no samples.
    """
    for s in streams.values():
        if s.packets and s.packets[0][:4] == b"PCM8":
            rate = struct.unpack("<4sHHIQ", s.packets[0])[3]
            return b"".join(s.packets[1:]), rate, [g / rate for g in s.granules[1:] if g >= 0]
    return b"", 0, []


def payload_of(text) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def describe(payload: bytes, streams: dict[int, Stream], times: list[float], bad: int) -> str:
    if not payload:
        return f"streams={len(streams)};bad={bad};no samples"
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    centred = x - x.mean()
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};bad={bad};"
        f"seconds={times[-1] if times else 0:.6f};mean={x.mean():.4f};rms={np.sqrt((centred**2).mean()):.4f};crossings={crossings}"
    )


SHAPE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media binary: the documents as media columns."""

    def each(texts):
        made = [payload_of(x) for x in texts]
        return [[n for _, n in made], [encode(p) for p, _ in made]]

    return map_texts(docs, ["doc_id"], lambda: each, "n_bytes long, media binary")


def digest(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the digest of what the stored bytes hold; a medium that can't be read has an empty payload."""

    def each(stored):
        rows = []
        for medium in stored:
            medium = medium or b""
            streams, bad = decode(medium)
            payload, rate, times = samples(streams)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), describe(payload, streams, times, bad)))
        return list(zip(*rows, strict=True))

    return map_texts(media, ["doc_id", "n_bytes"], lambda: each, SHAPE, "media")


def query(spark, sf_dir):
    """op2: every document as an Ogg media column, and its digest read back from the stored bytes."""
    return digest(store(table(spark, sf_dir, "documents")))
