"""Operator 8: Ogg containers as media columns.

`parse` reads pages one after another, checks each checksum (a page that fails is skipped and
counted, the search goes on at the next capture pattern), tells logical streams apart by serial
number (a serial that begins again after its end is a stream of its own: a chained one) and joins
packets from lacing values over page bounds.  A page's granule position is that of the last packet
that ends on it; `Stream.spans` derives the others from the packets' durations.  `build` writes
pages of several streams interleaved in the order of time.

Null texts count as empty; repeated rows and other columns have no effect on a row's result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.base import pick, slices, strings

HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, no initial or final inversion:
    the mirror image of zlib's CRC over mirrored bytes."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # a page's, at the last packet that ends on it; else -1
    pages: int = 0
    lost: int = 0  # pages missing by sequence number
    ended: bool = False
    _next: int = 0
    _open: list[bytes] = field(default_factory=list)
    _joined: bool = False

    def spans(self, duration: Callable[[bytes], int], skip: int = 1) -> list[tuple[int, int]]:
        """Granules at which each packet after the headers begins and ends.  Packets before one whose
        end is known end where the next one begins; packets behind the last known end go on from there.
        A last packet that would reach beyond the end of the stream is cut there."""
        length = [duration(p) for p in self.packets[skip:]]
        known = self.granules[skip:]
        out: list[tuple[int, int]] = []
        at, first = 0, 0  # the end so far; the first packet not placed yet
        for i, granule in enumerate(known):
            if granule < 0:
                continue
            total = sum(length[first : i + 1])
            if self.ended and i == len(known) - 1 and at + total - length[i] <= granule < at + total:
                total = granule - at  # the end of the stream cuts the last packet
            at = granule - total
            for k in range(first, i + 1):
                end = granule if k == i else at + length[k]
                out.append((at, end))
                at = end
            first = i + 1
        for n in length[first:]:
            out.append((at, at + n))
            at += n
        return out


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    data = head + body
    return data[:22] + struct.pack("<I", checksum(data)) + data[26:]


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(time, page) of a stream from (packet, granule position at its end): the first packet has a
    page of its own; a page holds 255 segments at most and packets may go on to the next."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, done, open_before = bytearray(), bytearray(), -1, False
    state = {"n": 0}

    def flush(flags: int) -> None:
        pages.append((max(done, 0), page(serial, state["n"], done, flags | (FIRST if state["n"] == 0 else 0), bytes(lacing), bytes(body))))
        state["n"] += 1

    for k, (data, granule) in enumerate(packets):
        at, left = 0, len(data) // 255 + 1  # segments
        while left:
            take = min(left, 255 - len(lacing))
            left -= take
            size = take * 255 if left else len(data) - at
            lacing += b"\xff" * (take - 1) + bytes([255 if left else size - (take - 1) * 255])
            body += data[at : at + size]
            at += size
            if not left:
                done = granule
            if len(lacing) == 255 or (k == 0 and not left) or (k == len(packets) - 1 and not left):
                flush((CONTINUED if open_before else 0) | (LAST if k == len(packets) - 1 and not left else 0))
                lacing, body, done, open_before = bytearray(), bytearray(), -1, bool(left)
    return pages


def build(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: the first pages of all logical streams, then the rest by time."""
    paged = [paginate(serial, packets) for serial, packets in streams.items() if packets]
    # granule -1 pages keep their place behind the page before them
    order: list[tuple[int, int, int, bytes]] = []
    latest: dict[int, int] = {}
    for s, pages in enumerate(paged):
        for n, (t, p) in enumerate(pages):
            latest[s] = max(latest.get(s, 0), t)
            if n:
                order.append((latest[s], s, n, p))
    rest = sorted(order, key=lambda x: x[:3])
    return b"".join(pages[0][1] for pages in paged) + b"".join(x[3] for x in rest)


def parse(data: bytes) -> tuple[list[Stream], int]:
    """Logical streams in the order of their first pages, and the number of pages that failed their
    checksum."""
    streams: list[Stream] = []
    latest: dict[int, Stream] = {}  # by serial number
    at, bad = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if version or len(lacing) < segments or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        s = latest.get(serial)
        if s is None or (s.ended and flags & FIRST):
            s = latest[serial] = Stream(serial)
            streams.append(s)
        if number != s._next:
            s.lost += max(0, number - s._next)
            s._open, s._joined = [], False
        s._next = number + 1
        s.pages += 1
        s.ended |= bool(flags & LAST)
        if not flags & CONTINUED:
            s._open, s._joined = [], True
        pos, run = at + 27 + segments, 0
        joined = s._joined  # else the page goes on with a packet whose start is lost
        before = len(s.packets)
        for k, v in enumerate(lacing):
            run += v
            if v < 255:
                if joined:
                    s.packets.append(b"".join([*s._open, data[pos : pos + run]]))
                    s.granules.append(-1)
                s._open, joined, pos, run = [], True, pos + run, 0
            elif k == len(lacing) - 1 and joined:
                s._open.append(data[pos : pos + run])
        if len(s.packets) > before:
            s.granules[-1] = granule
        s._joined = joined
        at = end
    return streams, bad


def store(payload: bytes, rate: int = 8000, frame: int = 4096) -> bytes:
    """Lossless 8-bit samples in one logical stream (a header packet, then frames; granule = samples
    so far), and a second stream that gives each frame's checksum at the same times.  Serial numbers
    come from the content, so equal payloads give equal bytes."""
    serial = zlib.crc32(payload)
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    ends = np.cumsum([len(f) for f in frames]).tolist()
    head = struct.pack("<8sHHIBBI", b"PCM     ", 0, 0, rate, 1, 8, frame)
    sums = b"".join(struct.pack("<I", zlib.crc32(f)) for f in frames)
    return build({
        serial: [(head, 0), *zip(frames, ends, strict=True)],
        serial ^ 0xFFFFFFFF: [(b"SUMS    " + struct.pack("<II", rate, frame), 0), *((sums[4 * i : 4 * i + 4], e) for i, e in enumerate(ends))],
    })


def load(media: bytes) -> tuple[bytes, dict]:
    """The payload read back, and what the container tells.  Raises if anything is damaged, or if the
    two streams do not tell the same times."""
    streams, bad = parse(media)
    samples = next((s for s in streams if s.packets and s.packets[0][:8] == b"PCM     "), None)
    sums = next((s for s in streams if s.packets and s.packets[0][:8] == b"SUMS    "), None)
    if bad or samples is None or sums is None or samples.lost or sums.lost or not samples.ended:
        raise ValueError("damaged Ogg stream")
    rate = struct.unpack_from("<I", samples.packets[0], 12)[0]
    frame = struct.unpack_from("<I", sums.packets[0], 12)[0]
    if [struct.unpack("<I", p)[0] for p in sums.packets[1:]] != [zlib.crc32(p) for p in samples.packets[1:]]:
        raise ValueError("samples do not match their checksums")
    spans = samples.spans(len)
    if spans != sums.spans(lambda _: frame):
        raise ValueError("the times of samples and checksums differ")
    micros = [(a * 1_000_000 // rate, b * 1_000_000 // rate) for a, b in spans]
    return b"".join(samples.packets[1:]), {"streams": len(streams), "pages": sum(s.pages for s in streams), "packets": len(spans), "rate": rate, "micros": max((b for _, b in micros), default=0), "spans": ",".join(f"{a}-{b}" for a, b in micros)}


def text_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = 64, rate: int = 8000) -> DataFrame:
    """Stores each text (UTF-8, zeros up to a positive multiple of `block`) as Ogg and reads it back:
    doc_id, n_bytes, media (the stored file), payload (as read back) and feature (what the container
    tells, with the microseconds at which each packet begins and ends, and levels of the samples)."""
    rows = pick(df, doc_id=id_column, text=text_column)

    def run(batches):
        for batch in slices(batches, "text"):
            sizes, media, payloads, features = [], [], [], []
            for text in strings(batch, "text"):
                raw = text.encode()
                stored = store(raw + b"\0" * (-len(raw) % block if raw else block), rate)
                payload, info = load(stored)
                level = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                info |= {"mean": f"{level.mean():.6f}", "rms": f"{np.sqrt((level * level).mean()):.6f}"}
                sizes.append(len(raw))
                media.append(stored)
                payloads.append(payload)
                features.append(";".join(f"{k}={v}" for k, v in info.items()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, feature string")
