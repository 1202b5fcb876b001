"""Media columns: Ogg.

``ogg_column`` stores byte payloads as 8-bit samples in Ogg bitstreams (a ``binary`` column), ``ogg_features`` reads such
a column back: it checks every page's checksum, puts packets together from the lacing values, parts the logical streams
by serial number and derives the time of every packet from the pages' granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples (bytes) of a packet, and the sample rate that granule positions are counted in.
PACKET, RATE = 576, 8000
#: Spans of time whose mean level is a feature.
BANDS = 8
FILL = b"\xff"
_SAMPLES, _NOTES = b"\x80smp8", b"\x80note"
_HEAD = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 04C11DB7, most significant bit first, start 0, no final xor.

    It is zlib's polynomial read the other way round, so the bytes' bits are reversed, zlib's code does the work (its start
    and final value undone) and the result's bits are reversed back.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class _Out:
    """One logical stream being written."""

    serial: int
    number: int = 0
    pages: list[bytes] = field(default_factory=list)

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> None:
        head = _HEAD.pack(b"OggS", 0, flags | _FIRST * (self.number == 0), granule, self.serial, self.number, 0, len(lacing)) + lacing
        crc = page_crc(head + body)
        self.pages.append(head[:22] + struct.pack("<I", crc) + head[26:] + body)
        self.number += 1

    def packets(self, packets: list[bytes], granules: list[int]) -> None:
        """Lace packets into pages of up to 255 segments; a packet that does not fit goes on in the next page."""
        lacing, body, ended, flags = bytearray(), [], -1, 0
        for packet, granule in zip(packets, granules, strict=True):
            at, whole = 0, False
            while not whole:
                room = 255 - len(lacing)
                if not room:
                    self.page(bytes(lacing), b"".join(body), ended, flags)
                    lacing, body, ended, flags, room = bytearray(), [], -1, _CONTINUED * (at > 0), 255
                full = min((len(packet) - at) // 255, room)
                lacing += b"\xff" * full
                whole = full < room
                stop = at + 255 * full
                if whole:
                    lacing.append(len(packet) - stop)
                    stop, ended = len(packet), granule
                body.append(packet[at:stop])
                at = stop
        self.page(bytes(lacing), b"".join(body), ended, flags | _LAST)


def ogg_bytes(payload: bytes, n_bytes: int) -> bytes:
    """A physical stream of two logical ones: the payload's samples, and a note of the unpadded length.

    Serial numbers come from the payload, so equal payloads are stored alike.
    """
    serial = zlib.crc32(payload)
    samples, notes = _Out(serial), _Out(serial ^ 1)
    samples.page(bytes([9]), _SAMPLES + struct.pack("<I", RATE), 0, 0)
    notes.page(bytes([5]), _NOTES, 0, 0)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    samples.packets(packets, [min((i + 1) * PACKET, len(payload)) for i in range(len(packets))])
    notes.packets([str(n_bytes).encode()], [len(payload)])
    return b"".join([samples.pages[0], notes.pages[0], samples.pages[1], notes.pages[1], *samples.pages[2:]])


@dataclass
class Logical:
    """A logical stream read back: its packets and the granule position at the end of each (-1: not stated)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    open: list[bytes] = field(default_factory=list)


def read_ogg(data: bytes) -> dict[int, Logical]:
    """All logical streams by serial number.  A wrong checksum, a gap in page numbers or a torn packet is an error."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        mark, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no Ogg page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data) or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"damaged Ogg page at byte {at}")
        stream = streams.setdefault(serial, Logical())
        if number != stream.pages or bool(flags & _FIRST) != (number == 0) or bool(flags & _CONTINUED) != bool(stream.open):
            raise ValueError(f"pages of stream {serial} are missing before byte {at}")
        stream.pages += 1
        start = body
        for value in lacing:
            body += value
            if value < 255:
                packet = data[start:body]
                if stream.open:
                    packet = b"".join([*stream.open, packet])
                    stream.open = []
                stream.packets.append(packet)
                stream.granules.append(-1)
                start = body
        if start < body:
            stream.open.append(data[start:body])
        if stream.granules and granule >= 0:
            stream.granules[-1] = granule
        at = end
    if any(s.open for s in streams.values()):
        raise ValueError("the last packet has no end")
    return streams


def packet_times(stream: Logical) -> list[tuple[float, float]]:
    """Start and end second of every data packet.  A page states the position at the end of its last whole packet; the
    packets before it end as many samples earlier as those after them hold."""
    ends, position = [0] * len(stream.packets), 0
    for i in range(len(stream.packets) - 1, 0, -1):
        position = stream.granules[i] if stream.granules[i] >= 0 else position - len(stream.packets[i + 1])
        ends[i] = position
    return [((e - len(p)) / RATE, e / RATE) for p, e in zip(stream.packets[1:], ends[1:], strict=True)]


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes of ``text`` with bytes 255 up to a positive multiple of ``PACKET``, and the unpadded length."""
    raw = text.encode()
    return raw + FILL * (max(1, -(-len(raw) // PACKET)) * PACKET - len(raw)), len(raw)


def ogg_column(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: every whole text as an Ogg stream.  A null text is empty (one packet of filling); one row per
    input row; other columns are ignored.  Map-only."""

    def run(batches):
        for batch in batches:
            media = [ogg_bytes(*payload_of(text.as_py() or "")) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def describe(media: bytes) -> dict:
    """What is read back from stored bytes: the payload and what the streams state, and as ``feature`` the pages of both streams,
    the packets, the last granule position and its time, the samples' sum, greatest value and changes, and the mean level of
    ``BANDS`` spans of packets (fewer if there are fewer packets)."""
    streams = list(read_ogg(media).values())
    samples = next(s for s in streams if s.packets[0].startswith(_SAMPLES))
    notes = next(s for s in streams if s.packets[0].startswith(_NOTES))
    payload = b"".join(samples.packets[1:])
    times = packet_times(samples)
    wave = np.frombuffer(payload, np.uint8)
    # the mean level of each of BANDS equal spans of the packets, to whole numbers
    levels = wave.reshape(-1, PACKET).sum(1, dtype=np.int64)
    spans = np.array_split(levels, min(BANDS, len(levels)))
    bands = ",".join(str(int(s.sum()) // (len(s) * PACKET)) for s in spans)
    feature = f"pages={samples.pages + notes.pages};packets={len(times)};granule={samples.granules[-1]};ms={round(times[-1][1] * 1000)};sum={int(levels.sum())};peak={int(wave.max())};steps={int(np.count_nonzero(wave[1:] != wave[:-1]))};bands={bands}"
    return {
        "n_bytes": int(notes.packets[1]), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature,
    }


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def ogg_features(media: DataFrame) -> DataFrame:
    """Read ``media`` of every row back and describe it (see ``describe``); a null ``media`` gives null fields."""

    def run(batches):
        for batch in batches:
            found = [describe(m.as_py()) if m.is_valid else dict.fromkeys(_FIELDS) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in _FIELDS.items())], ["doc_id", *_FIELDS])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in _FIELDS.items()))
