"""Media columns: texts as 8-bit samples in Ogg containers, and back.

A payload is cut into blocks of 192 samples. Even blocks go to one logical stream,
odd ones to another, like the two channels of a recording; each stream has a header
packet (rate, stream number, samples in all) and data packets of four blocks, whose
lengths are told by lacing values. Pages of both streams are multiplexed by time.
A page holds at most `SEGMENTS` lacing values, so long packets continue over pages;
each page carries a checksum and the granule position: samples of its stream up to
the last packet that ends in it.

Reading verifies every checksum, the page sequence and the continuation flags,
reassembles packets from lacing values, demultiplexes by serial number, and derives
time stamps from granule positions.

The container depends on the payload alone. Defined cases: null text is empty and,
like every payload, padded with spaces to a positive multiple of 192 bytes; a very long
text is one container, held whole while it is written and read; repeated rows have
equal containers; empty tables give no rows; only the columns named in `keep` are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BLOCK, RATE, BLOCKS_PER_PACKET, SEGMENTS = 192, 8000, 4, 64
SERIALS = (0x6F676730, 0x6F676731)
#: Format values of Ogg pages (RFC 3533): capture pattern, flags, header layout.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
STREAM_HEADER = struct.Struct("<8sIIq")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 of Ogg (polynomial 0x04C11DB7, most significant bit first, start 0): zlib's, seen in a mirror."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    rest = lacing + body
    return head[:22] + struct.pack("<I", checksum(head + rest)) + head[26:] + rest


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(time, page) of one logical stream from (packet, granule at its end); the first packet has a page of its own."""
    pages = []
    groups = [packets[:1], packets[1:]]
    for which, group in enumerate(groups):
        body = b"".join(p for p, _ in group)
        lacing, ends = bytearray(), {}
        for p, granule in group:
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            ends[len(lacing)] = granule
        at = 0
        continued = False
        for a in range(0, len(lacing), SEGMENTS):
            part = bytes(lacing[a : a + SEGMENTS])
            size = sum(part)
            done = [g for e, g in ends.items() if a < e <= a + len(part)]
            last = a + SEGMENTS >= len(lacing) and (which == 1 or not groups[1])
            flags = CONTINUED * continued | FIRST * (which == 0) | LAST * last
            granule = done[-1] if done else -1
            pages.append((granule if granule >= 0 else pages[-1][0], page(flags, granule, serial, len(pages), part, body[at : at + size])))
            at += size
            continued = a + len(part) not in ends
    return pages


def write(payload: bytes) -> bytes:
    """The container of a payload whose length is a multiple of BLOCK."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    every = []
    for k, serial in enumerate(SERIALS):
        mine = blocks[k::2]
        packets, granule = [(STREAM_HEADER.pack(b"\x01pcm8\0\0\0", RATE, k, len(mine) * BLOCK), 0)], 0
        for i in range(0, len(mine), BLOCKS_PER_PACKET):
            packet = b"".join(mine[i : i + BLOCKS_PER_PACKET])
            granule += len(packet)
            packets.append((packet, granule))
        every += [(n > 0, time, k, n, p) for n, (time, p) in enumerate(stream_pages(serial, packets))]
    return b"".join(p for *_, p in sorted(every))


def packets_of(media: bytes) -> tuple[dict[int, list[tuple[bytes, float]]], int]:
    """By serial number: packets and their time stamps, in seconds; and the number of pages.

    A page's granule position is the end of the last packet that ends in it; the packets
    before it are counted back by their samples (a header has none).
    """
    done: dict[int, list[tuple[bytes, float]]] = {}
    open_: dict[int, bytes] = {}
    rate: dict[int, int] = {}
    ended: set[int] = set()
    number: dict[int, int] = {}
    at = pages = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("page header is cut off")
        capture, version, flags, granule, serial, sequence, crc, segments = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + HEADER.size : at + HEADER.size + segments]
        start = at + HEADER.size + segments
        stop = start + sum(lacing)
        if len(lacing) < segments or stop > len(media):
            raise OggError("page is cut off")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            raise OggError(f"checksum of the page at byte {at} is wrong")
        if serial in ended or bool(flags & FIRST) != (serial not in number) or number.get(serial, -1) + 1 != sequence:
            raise OggError(f"stream {serial} is out of sequence")
        if bool(flags & CONTINUED) != (serial in open_):
            raise OggError(f"stream {serial}: continuation flag and packet disagree")
        number[serial] = sequence
        held = [open_.pop(serial, b"")] if flags & CONTINUED else []
        begin, size, whole = start, 0, []
        for value in lacing:
            size += value
            if value < 255:
                whole.append(b"".join([*held, media[begin : begin + size]]))
                held, begin, size = [], begin + size, 0
        if lacing and lacing[-1] == 255:
            open_[serial] = b"".join([*held, media[begin : begin + size]])
        if flags & FIRST:
            rate[serial] = STREAM_HEADER.unpack(whole[0])[1]
        stamped = []
        for p in reversed(whole):
            stamped.append((p, granule / rate[serial]))
            granule -= len(p)
        done.setdefault(serial, []).extend(reversed(stamped))
        if flags & LAST:
            ended.add(serial)
        at, pages = stop, pages + 1
    if open_ or ended != set(done):
        raise OggError("a stream doesn't end")
    return done, pages


def read(media: bytes) -> tuple[bytes, dict]:
    """The payload and what the container tells of it."""
    streams, pages = packets_of(media)
    parts, seconds, packets = {}, 0.0, 0
    for found in streams.values():
        _, rate, k, total = STREAM_HEADER.unpack(found[0][0])
        samples = b"".join(p for p, _ in found[1:])
        if len(samples) != total:
            raise OggError("samples are missing")
        parts[k] = samples
        seconds = max(seconds, found[-1][1])
        packets += len(found)
    even, odd = (np.frombuffer(parts.get(k, b""), np.uint8).reshape(-1, BLOCK) for k in (0, 1))
    out = np.empty((len(even) + len(odd), BLOCK), np.uint8)
    out[0::2], out[1::2] = even, odd
    return out.tobytes(), {"streams": len(streams), "pages": pages, "packets": packets, "seconds": seconds}


def feature(payload: bytes, told: dict) -> str:
    """Counts from the container, and of the samples around 128: mean, mean square, sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"streams={told['streams']};pages={told['pages']};packets={told['packets']};seconds={told['seconds']:.6f};sum={int(x.sum())};squares={int((x * x).sum())};sign_changes={changes}"


def padded(text: bytes) -> bytes:
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, with n_bytes (of the text) and media (the container)."""
    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_bytes long, media binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b["_text"])
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 256) for c in b.columns[:-1]), pa.array(map(len, part), pa.int64()), pa.array([write(padded(t)) for t in part], pa.binary())], names=[*b.schema.names[:-1], "n_bytes", "media"])

    return source.mapInArrow(run, schema)


def digests(media: DataFrame) -> DataFrame:
    """Reads the stored containers: doc_id, n_bytes, payload and media digests, feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stored in b["media"].to_pylist():
                payload, told = read(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, told)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["n_bytes"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, schema)
