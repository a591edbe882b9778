"""Ogg media columns: mux bytes into a checked container, store it, and demux what is read back.

Writing: samples and a small description are two logical streams, interleaved page by
page; the containers are written as a binary column below the shared folder.  Reading verifies every
page's checksum and sequence number, reassembles packets from lacing values (also across pages),
demultiplexes by serial number and derives each page's times from granule positions.

Defined results: null text counts as empty.  Equal texts give equal containers: serials are fixed, and
repeated rows are stored each.  A container that is null, damaged or not of this kind gives a row with its
doc_id, nulls and what is wrong in ``error``; the others are not held up.  Very long texts are muxed alone
(a container is held whole in memory).  An empty table gives no rows.  Columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import shared

# Fixed values of the container format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = (1 << 64) - 1
SEGMENTS = 255

RATE = 8000  #: samples a second; one byte is one sample
UNIT = 192  #: payloads are padded to a multiple of this
PACKET = 10 * UNIT
AUDIO, ABOUT = 0x45564131, 0x45564132  #: serials of the two streams
_HEAD = struct.Struct("<4sBBQIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format."""


def page_checksum(page: bytes) -> int:
    """The container's crc32: polynomial 0x04c11db7, most significant bit first, zero start, no final inversion.

    It is the mirror image of the usual reflected crc32, so bytes are mirrored, summed natively and mirrored back.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """The pages of one logical stream of (packet, granule position at its end); the first packet has a page of its own."""
    number = 0
    for group, first in ((packets[:1], True), (packets[1:], False)):
        lacing, ends, at = bytearray(), {}, 0
        for packet, granule in group:
            lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            ends[len(lacing) - 1] = granule
        body, continued = b"".join(p for p, _ in group), False
        for start in range(0, len(lacing), SEGMENTS):
            some = bytes(lacing[start : start + SEGMENTS])
            size, done = sum(some), [ends[i] for i in range(start, start + len(some)) if i in ends]
            last = start + SEGMENTS >= len(lacing) and (not first or len(packets) == 1)
            yield _page(CONTINUED * continued | FIRST * first | LAST * last, done[-1] if done else NO_GRANULE, serial, number, some, body[at : at + size])
            at, continued, number = at + size, some[-1] == 255, number + 1


def mux(payload: bytes, n_bytes: int) -> bytes:
    """A container with the payload as 8-bit mono samples, and its unpadded size in a second stream."""
    audio = [(b"EVPCM8\x00\x01" + struct.pack("<IBQ", RATE, 1, len(payload)), 0)]
    audio += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    about = [(b"EVMETA\x00\x01", 0), (struct.pack("<QI", n_bytes, UNIT), len(payload))]
    a, b = list(stream_pages(AUDIO, audio)), list(stream_pages(ABOUT, about))
    return b"".join([a[0], b[0], *(p for k in range(1, max(len(a), len(b))) for s in (a, b) for p in s[k : k + 1])])


@dataclass
class Stream:
    """One logical stream as read back."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  #: of each page that ends a packet
    page_granules: list[int | None] = field(default_factory=list)  #: of each page
    pages: int = 0
    partial: list[bytes] = field(default_factory=list)
    open: bool = False
    ended: bool = False

    def seconds(self, rate: int = RATE) -> float:
        return (self.granules[-1] if self.granules else 0) / rate

    def page_times(self, rate: int = RATE) -> list[tuple[float, float]]:
        """Each page's first and last second: it starts where the last page that ends a packet ends, and ends at its own granule position."""
        out, at = [], 0
        for g in self.page_granules:
            end = at if g is None else g
            out.append((at / rate, end / rate))
            at = end
        return out


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams of a container, by serial; raises :class:`OggError` on any damage."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise OggError("truncated page header")
        capture, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError("no page here")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end > len(media):
            raise OggError("truncated page")
        page = media[at:end]
        if page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise OggError("page checksum differs")
        if bool(kind & FIRST) == (serial in streams):
            raise OggError("stream start missing or repeated")
        s = streams.setdefault(serial, Stream())
        if s.ended or number != s.pages or bool(kind & CONTINUED) != s.open:
            raise OggError("page out of order")
        body, start = at + 27 + n, at + 27 + n
        for value in lacing:
            body += value
            if value < 255:
                s.partial.append(media[start:body])
                s.packets.append(s.partial[0] if len(s.partial) == 1 else b"".join(s.partial))
                s.partial, start = [], body
        if start < body:
            s.partial.append(media[start:body])
        s.open = n > 0 and lacing[-1] == 255
        s.pages, s.ended = s.pages + 1, bool(kind & LAST)
        s.page_granules.append(None if granule == NO_GRANULE else granule)
        if granule != NO_GRANULE:
            if s.granules and granule < s.granules[-1]:
                raise OggError("granule position runs backwards")
            s.granules.append(granule)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("stream does not end")
    return streams


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration from granules, page and packet counts, and level and zero-crossing statistics of the samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
    power = int((samples.astype(np.int64) ** 2).sum())
    audio = streams[AUDIO]
    times = audio.page_times()
    longest = max((end - start for start, end in times), default=0.0)
    return f"ms={round(audio.seconds() * 1000)};pages={audio.pages};page_ms={round(longest * 1000)};packets={len(audio.packets)};sum={int(samples.sum())};power={power};peak={int(np.abs(samples).max(initial=0))};crossings={crossings}"


def _store(batch: pa.RecordBatch) -> pa.RecordBatch:
    media = []
    for text in shared.binary(batch.column("text")):
        payload = text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\x20")
        media.append(mux(payload, len(text)))
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "media": pa.array(media, pa.binary())})


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text (doc_id, text) as an Ogg container."""

    def run(batches):
        for batch in shared.small_batches(batches, 256, "text"):
            yield _store(batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id and media of :func:`store_texts`, written below the shared folder and read back from there."""
    return shared.materialise(store_texts(docs), "media", compression="zstd")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def payload_of(media: bytes | None) -> tuple[bytes, int, dict[int, Stream]]:
    """The payload of a container, its unpadded size and its streams; raises :class:`OggError`."""
    if media is None:
        raise OggError("no container")
    streams = demux(media)
    if streams.keys() != {AUDIO, ABOUT} or len(streams[ABOUT].packets) != 2 or not streams[AUDIO].packets:
        raise OggError("streams of another kind")
    head, about = streams[AUDIO].packets[0], streams[ABOUT].packets[1]
    if len(head) != 21 or head[:8] != b"EVPCM8\x00\x01" or len(about) != 12:
        raise OggError("stream heads of another kind")
    payload = b"".join(streams[AUDIO].packets[1:])
    if struct.unpack("<IBQ", head[8:])[2] != len(payload) or streams[AUDIO].granules[-1] != len(payload):
        raise OggError("sample count differs")
    return payload, struct.unpack("<QI", about)[0], streams


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
        media = cell.as_py()
        try:
            payload, n_bytes, streams = payload_of(media)
            rows.append((doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, streams), None))
        except OggError as e:
            rows.append((doc, *[None] * 7, str(e)))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})


def read_media(media: DataFrame) -> DataFrame:
    """Features of each container of ``media`` (doc_id, media), computed from the bytes read back; ``error`` says why there are none."""

    def run(batches):
        for batch in shared.small_batches(batches, 256, "media"):
            yield _read(batch)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


PAGES = "doc_id long, serial long, page long, start_seconds double, end_seconds double"


def page_table(media: DataFrame) -> DataFrame:
    """(doc_id, serial, page, start_seconds, end_seconds): the times of every page of every sound container."""

    def run(batches):
        for batch in shared.small_batches(batches, 256, "media"):
            rows = []
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                try:
                    streams = payload_of(cell.as_py())[2]
                except OggError:
                    continue
                rows += [(doc, serial, k, a, b) for serial, s in streams.items() for k, (a, b) in enumerate(s.page_times())]
            if rows:
                kinds = [pa.float64() if x.endswith("double") else pa.int64() for x in PAGES.split(", ")]
                yield pa.RecordBatch.from_pydict({x.split()[0]: pa.array(c, k) for x, k, c in zip(PAGES.split(", "), kinds, zip(*rows, strict=True), strict=True)})

    return media.select("doc_id", "media").mapInArrow(run, PAGES)
