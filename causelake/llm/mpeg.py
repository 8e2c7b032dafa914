"""MPEG audio in a media column: writing, resynchronising, verifying, indexing.

``parse`` reads any run of MPEG-1, -2 or -2.5 audio frames of layers I to III, of free format too:
it reads ID3v2, ID3v1 and APEv2 tags, finds the next header that another header (or the end) confirms
after junk, follows a change of rate, version or layer, checks the CRC of protected frames of all
layers, reads Xing/Info and VBRI tables and the encoder's delay and padding, and gives exact durations
(samples over rate, run by run) and the byte offset of every frame.

``store`` keeps any payload losslessly in such a stream: layer III frames of MPEG-2 (576 samples
each) that are silent to a decoder and carry 576 payload bytes each as ancillary data behind their
side information, after an ID3v2 tag and an Info frame.

Defined cases: null and empty texts store one frame of padding; repeated rows have equal media; a text
of any length is one stream; streams without a frame give no duration and no offsets; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from causelake.llm.common import doc_texts, lean, materialise, table, text_slices

# Bit rates (kbit/s) by (MPEG-1 or not, layer), and sample rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
# Bits of a layer II allocation, as runs of (subbands, bits), by the tables of the standard.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}

UNIT = 576
#: MPEG-2 layer III, CRC, 144 kbit/s, 16 kHz, mono: 648 bytes and 36 ms a frame.
FRAME_HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    channels: int
    samples: int
    size: int
    side: int
    joint: int = 32  # subband from which channels share their allocation

    @property
    def stream(self) -> tuple[str, int, int]:
        """What all frames of one stream share."""
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The header in four bytes, or none; a free-format one tells no size (0)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    bits, rates = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or bits == 15 or rates == 3:
        return None
    kbps, rate = BITRATES[version == "1", layer][bits], RATES[version][rates]
    padding, mono = raw[2] >> 1 & 1, raw[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    size = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padding
    size = size if kbps else 0
    joint = 4 * ((raw[3] >> 4 & 3) + 1) if raw[3] >> 6 == 1 else 32
    side = 0 if layer != 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
    return Header(version, layer, not raw[1] & 1, kbps, rate, padding, 1 if mono else 2, samples, size, side, joint)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The CRC of MPEG audio (polynomial 0x8005, all ones first) over all or the first bits."""
    crc = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


def allocation_bits(h: Header) -> list[int]:
    """Bits of the allocation of each layer II subband of a frame."""
    each = h.kbps // h.channels
    if h.version != "1":
        name = "low"
    elif h.rate == 48000 and each >= 56 or 56 <= each <= 80:
        name = "a"
    elif h.rate != 48000 and each >= 96:
        name = "b"
    else:
        name = "c" if h.rate != 32000 else "d"
    return [bits for run, bits in ALLOCATIONS[name] for _ in range(run)]


def guarded_bits(body: bytes, h: Header) -> int:
    """How many bits after the CRC word it guards beside the header's last two bytes; ``body`` stands after that word."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (min(h.joint, 32) * h.channels + 32 - min(h.joint, 32))
    value, at, selected = int.from_bytes(body), 0, 0
    for subband, bits in enumerate(allocation_bits(h)):
        shared = h.channels == 2 and subband >= h.joint
        for _ in range(1 if shared else h.channels):
            if value >> (8 * len(body) - at - bits) & ((1 << bits) - 1):
                selected += h.channels if shared else 1
            at += bits
    return at + 2 * selected


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def id3v2(texts: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of TXXX frames."""
    frames = b""
    for name, value in texts.items():
        body = b"\x03" + name.encode() + b"\x00" + value.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + _synchsafe(len(frames)) + frames


def read_id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of a tag at the beginning, its text frames)."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 128 for b in data[6:10]):
        return 0, {}
    safe = lambda b: sum(x << s for x, s in zip(b, (21, 14, 7, 0)))
    size, at, found = safe(data[6:10]) + 10 + 10 * bool(data[5] & 16), 10, {}
    while at + 10 <= min(size, len(data)) and data[at]:
        name = data[at : at + 4]
        n = safe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + n]
        if name[:1] == b"T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\x00") if name == b"TXXX" else (name.decode("latin-1"), "", text)
            found[key] = value.rstrip("\x00")
        at += 10 + n
    return min(size, len(data)), found


def read_id3v1(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of an ID3v1 tag at the end, its fields)."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return 0, {}
    said = lambda b: b.split(b"\x00")[0].decode("latin-1").rstrip()
    fields = {"title": said(tag[3:33]), "artist": said(tag[33:63]), "album": said(tag[63:93]), "year": said(tag[93:97]), "comment": said(tag[97:127])}
    if not tag[125] and tag[126]:
        fields["track"] = str(tag[126])
    if tag[127] != 255:
        fields["genre"] = str(tag[127])
    return 128, {f"id3v1.{k}": v for k, v in fields.items() if v}


def read_ape(data: bytes, end: int) -> tuple[int, dict[str, str]]:
    """(bytes of an APE tag that ends at ``end``, its text items)."""
    foot = data[max(0, end - 32) : end]
    if foot[:8] != b"APETAGEX" or len(foot) < 32:
        return 0, {}
    size, count, flags = (int.from_bytes(foot[a : a + 4], "little") for a in (12, 16, 20))
    at, found = end - size, {}
    if at < 0:
        return 0, {}
    for _ in range(count):
        n, kind, stop = int.from_bytes(data[at : at + 4], "little"), data[at + 4] >> 1 & 3 if at + 8 <= end else 3, data.find(b"\x00", at + 8, end)
        if stop < 0 or stop + 1 + n > end:
            break
        if kind == 0:
            found[f"ape.{data[at + 8 : stop].decode('latin-1')}"] = data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
        at = stop + 1 + n
    return size + 32 * (flags >> 31), found


def _frame(side: bytes, body: bytes) -> bytes:
    h = header(FRAME_HEADER)
    start = FRAME_HEADER + struct.pack(">H", crc16(FRAME_HEADER[2:] + side)) + side + body
    return start + bytes(h.size - len(start))


def store(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A stream that carries a payload of whole units of 576 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    h, n = header(FRAME_HEADER), len(payload) // UNIT
    blank = _frame(bytes(h.side), b"")
    frames = np.tile(np.frombuffer(blank, np.uint8), (n, 1))
    at = 6 + h.side
    frames[:, at : at + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    audio = (n + 1) * h.size
    toc = bytes(min(255, (h.size + i * n // 100 * h.size) * 256 // audio) for i in range(100))
    info = _frame(bytes(h.side), b"Info" + struct.pack(">III", 7, n, audio) + toc)
    return id3v2(tags or {}) + info + frames.tobytes()


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    offsets: list[np.ndarray] = field(default_factory=list)
    headers: list[tuple[Header, int]] = field(default_factory=list)
    bad_crc: int = 0
    skipped: int = 0
    encoder: str | None = None
    delay: int = 0
    padding: int = 0

    @property
    def seek(self) -> np.ndarray:
        """Byte offset of every audio frame."""
        return np.concatenate(self.offsets) if self.offsets else np.zeros(0, np.int64)

    @property
    def frames(self) -> int:
        return sum(n for _, n in self.headers)

    @property
    def samples(self) -> int:
        return sum(h.samples * n for h, n in self.headers)

    @property
    def duration(self) -> tuple[int, int] | None:
        """Exact length as (samples, samples a second); over several rates as a fraction of seconds."""
        if not self.headers:
            return None
        if len({h.rate for h, _ in self.headers}) == 1:
            return self.samples, self.headers[0][0].rate
        return sum((Fraction(h.samples * n, h.rate) for h, n in self.headers), Fraction(0)).as_integer_ratio()

    @property
    def played(self) -> tuple[int, int] | None:
        """The same without the encoder's delay and padding."""
        held = self.duration
        if not held:
            return None
        cut = self.delay + self.padding
        return (max(0, held[0] - cut), held[1]) if held[1] == self.headers[0][0].rate else (Fraction(*held) - Fraction(cut, self.headers[0][0].rate)).as_integer_ratio()


def _crc_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame has the CRC it states."""
    if not h.protected or at + h.size > len(data):
        return False
    body = data[at + 6 : at + min(h.size, 6 + 64)]
    guarded = data[at + 2 : at + 4] + body
    bits = 16 + guarded_bits(body, h)
    return bits <= 8 * len(guarded) and crc16(guarded[: -(-bits // 8)], bits) == int.from_bytes(data[at + 4 : at + 6])


def _sized(data: bytes, at: int) -> Header | None:
    """The header at a place; a free-format one has the size up to the next header like it."""
    h = header(data[at : at + 4])
    if h is None or h.size:
        return h
    unit = 4 if h.layer == 1 else 1
    found = at + 4 + 2 * h.protected + h.side
    while (found := data.find(data[at : at + 2], found)) >= 0 and found - at <= 8 * 1152 * 4:
        follows = header(data[found : found + 4])
        if follows and not follows.kbps and follows.stream == h.stream:
            bare = found - at - unit * h.padding  # the size without padding is what all frames share
            third = header(data[found + bare + unit * follows.padding :][:4])
            if third and not third.kbps and third.stream == h.stream or found + bare + unit * follows.padding == len(data):
                return replace(h, size=found - at, kbps=round(bare * 8 * h.rate / h.samples / 1000))
        found += 1
    return None


def _free(data: bytes, at: int, run: Header | None) -> Header | None:
    """The header at a place as :func:`_sized`, or with the size of the free-format frames before it."""
    h = header(data[at : at + 4])
    if h is None or h.size:
        return h
    if run is not None and run.stream == h.stream:
        unit = 4 if h.layer == 1 else 1
        return replace(h, size=run.size + unit * (h.padding - run.padding), kbps=run.kbps)
    return _sized(data, at)


def _confirmed(data: bytes, at: int, stream: tuple | None, free: Header | None = None) -> Header | None:
    """The header at a place if its CRC, the next frame or the end confirms it.

    A header of another kind than the stream so far needs two frames more that agree with it.
    """
    h = _free(data, at, free)
    if h is None or not h.size or at + h.size > len(data):
        return None
    end = at + h.size
    follows = _free(data, end, h if not header(data[at : at + 4]).size else None)
    agrees = follows is not None and follows.stream == h.stream and follows.size > 0
    if stream and h.stream != stream:
        third = agrees and _free(data, end + follows.size, follows if not header(data[end : end + 4]).size else None)
        return h if agrees and (third and third.stream == h.stream or end + follows.size == len(data)) else None
    return h if end == len(data) or agrees or _crc_holds(data, at, h) else None


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Reads a Xing, Info or VBRI table if the frame is one."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        out.table = frame[at : at + 4].decode()
        if flags & 1:
            out.table_frames, p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 4:
            out.toc, p = frame[p : p + 100], p + 100
        p += 4 * (flags >> 3 & 1)
        if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO"):
            out.encoder = frame[p : p + 9].split(b"\x00")[0].decode("latin-1").rstrip()
            gap = int.from_bytes(frame[p + 21 : p + 24])
            out.delay, out.padding = gap >> 12, gap & 0xFFF
        return True
    if frame[36:40] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(frame[46:50]), int.from_bytes(frame[50:54])
        entries, width = int.from_bytes(frame[54:56]), int.from_bytes(frame[58:60])
        out.toc = frame[62 : 62 + entries * width]
        return True
    return False


def parse(data: bytes) -> Stream:
    """The stream in some bytes."""
    at, tags = read_id3v2(data)
    size, closing = read_id3v1(data)
    ape, items = read_ape(data, len(data) - size)
    data = data[: max(at, len(data) - size - ape)]
    out, stream, raw = Stream(tags | items | closing), None, np.frombuffer(data, np.uint8)
    free = None
    while at + 4 <= len(data):
        h = _confirmed(data, at, stream, free)
        if h is None:  # resynchronise
            found = data.find(b"\xff", at + 1)
            found = len(data) if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        first = stream is None
        stream = h.stream
        if first and _table(data[at : at + h.size], h, out):
            at += h.size
            continue
        # frames with the same header and size in a row are taken together
        free = None if header(data[at : at + 4]).size else h
        most = (len(data) - at) // h.size
        block = raw[at : at + most * h.size].reshape(most, h.size)
        same = (block[:, :4] == block[0, :4]).all(1)
        n = most if same.all() else int(np.argmin(same))
        if h.protected and h.layer == 3:
            guarded = block[:n, 2 : 6 + h.side]
            alike = (guarded == guarded[0]).all(1)
            for row, count in [(guarded[0], int(alike.sum()))] + [(r, 1) for r in guarded[~alike]]:
                b = row.tobytes()
                out.bad_crc += count * (crc16(b[:2] + b[4:]) != int.from_bytes(b[2:4]))
        elif h.protected:
            out.bad_crc += sum(not _crc_holds(data, at + i * h.size, h) for i in range(n))
        out.offsets.append(at + h.size * np.arange(n, dtype=np.int64))
        out.headers.append((h, n))
        at += n * h.size
    return out


def carried(data: bytes, stream: Stream) -> bytes:
    """The payload that ``store`` put into a stream."""
    raw, parts = np.frombuffer(data, np.uint8), []
    for offsets, (h, n) in zip(stream.offsets, stream.headers):
        block = raw[offsets[0] : offsets[0] + n * h.size].reshape(n, h.size)
        at = 4 + 2 * h.protected + h.side
        parts.append(block[:, at : at + UNIT].tobytes())
    return b"".join(parts)


def padded(text: str) -> bytes:
    """UTF-8 with bytes 255 up to a positive multiple of 576."""
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def text_media(documents: DataFrame) -> DataFrame:
    """``doc_id, media``: each whole text as the payload of an MPEG audio stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                media = [store(padded(t), {"bytes": str(len(t.encode()))}) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return doc_texts(documents).mapInArrow(lean(write), "doc_id long, media binary")


FACTS = (
    "version string, layer int, channels int, rate int, kbps double, frames long, samples long, duration_s double, "
    "table_kind string, table_frames long, bad_crc long, skipped_bytes long, encoder string, delay int, padding int, played_s double, "
    "seek array<long>, tags map<string,string>"
)


def media_facts(media: DataFrame) -> DataFrame:
    """``doc_id`` and what ``parse`` finds in ``media``: exact durations, checks, offsets of all frames."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in [f.strip().split(" ")[0] for f in FACTS.replace("map<string,string>", "map").split(",")]}
            for data in batch.column("media").to_pylist():
                s = parse(data or b"")
                h = s.headers[0][0] if s.headers else None
                held = sum(x.size * n for x, n in s.headers)
                length = s.duration[0] / s.duration[1] if h else None
                values = (
                    h and h.version, h and h.layer, h and h.channels, h and h.rate, held * 8 / length / 1000 if h else None, s.frames, s.samples,
                    length, s.table, s.table_frames, s.bad_crc, s.skipped, s.encoder, s.delay, s.padding, s.played[0] / s.played[1] if h else None,
                    s.seek, list(s.tags.items()),
                )
                for column, v in zip(rows.values(), values):
                    column.append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
            arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *rows])

    return media.mapInArrow(lean(read), f"doc_id long, {FACTS}")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Per row: the payload and features read back from the stored bytes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in DIGEST.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                s = parse(data)
                payload, (samples, rate) = carried(data, s), s.duration
                h = s.headers[0][0]
                feature = (
                    f"mpeg{h.version}-l{h.layer} {h.rate}Hz {h.channels}ch {h.kbps}kbps frames={s.frames} samples={samples} ms={1000 * samples / rate:.3f} "
                    f"table={s.table}:{s.table_frames} crc_errors={s.bad_crc} skipped={s.skipped} seek_crc32={zlib.crc32(s.seek.astype('<i8').tobytes())}"
                )
                rows.append((doc_id, int(s.tags["bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.mapInArrow(lean(read), DIGEST)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the media column is written to the shared folder, and what follows sees only the stored bytes
    return media_digests(materialise(text_media(table(spark, sf_dir, "documents")), "media"))
