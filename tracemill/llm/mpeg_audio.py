"""MPEG audio columns: a writer of Layer III streams that carry bytes, and a parser.

The writer makes silent MPEG-1 Layer III frames (32 kHz, 48 kbit/s, mono, with
checksum: 216 bytes and 36 ms each) whose ancillary data hold 192 payload bytes
each, after an ID3v2 tag and an Info frame with frame count, byte count and a
table of contents. The parser takes any MPEG-1/2/2.5 stream of Layer I, II or
III (not of free format): it reads ID3v2.2 to 2.4 (unsynchronised ones too) and
ID3v1 tags, finds frame headers again after junk (a header counts if the next
frame, the end or an ID3v1 tag follows it, the first one only if its checksum
holds too; later broken checksums are counted), reads Xing, Info and VBRI
tables, verifies CRC-16 checksums over what each layer protects, and gives exact
durations and the byte offset of every frame.

Defined results: a null or empty text is 192 spaces, as the shortest payload;
a null or unparsable stream has no frames, no duration and an empty payload;
rows are independent, so equal texts give equal values; no rows give no rows.
Columns other than the two that are named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts

UNIT = 192
# fixed values of the MPEG audio standard: kbit/s by index, for (MPEG-1?, layer), and sampling rates of MPEG-1
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Allocation bits of each subband in Layer II, by table (A to D of MPEG-1, E of MPEG-2).
ALLOCATION = {"A": (4,) * 11 + (3,) * 12 + (2,) * 4, "B": (4,) * 11 + (3,) * 12 + (2,) * 7, "C": (4,) * 2 + (3,) * 6, "D": (4,) * 2 + (3,) * 10, "E": (4,) * 4 + (3,) * 7 + (2,) * 19}


def _table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out[i] = c & 0xFFFF
    return out


_CRC = _table()
_CRC_LIST = _CRC.tolist()


def crc16(data: bytes, bits: int = 0) -> int:
    """Of the whole data, or of its first so many bits."""
    c, bits = 0xFFFF, bits or 8 * len(data)
    for b in data[: bits // 8]:
        c = ((c << 8) & 0xFFFF) ^ _CRC_LIST[(c >> 8) ^ b]
    for i in range(bits % 8):
        top = c >> 15 ^ data[bits // 8] >> 7 - i & 1
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def crc16_rows(rows: np.ndarray) -> np.ndarray:
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, j]]
    return c


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    channels: int
    size: int
    samples: int
    #: Subbands that have an allocation of their own for each channel.
    bound: int

    @property
    def side(self) -> int:
        """Bytes of side information in Layer III."""
        if self.layer != 3:
            return 0
        return (32 if self.channels == 2 else 17) if self.version == "1" else (17 if self.channels == 2 else 9)


def header(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer = {0: "2.5", 2: "2", 3: "1"}.get(b >> 3 & 3), 4 - (b >> 1 & 3)
    if version is None or layer == 4 or c >> 4 in (0, 15) or c >> 2 & 3 == 3 or d & 3 == 2:
        return None
    first = version == "1"
    kbps = BITRATES[first, layer][c >> 4]
    rate = RATES[c >> 2 & 3] // {"1": 1, "2": 2, "2.5": 4}[version]
    pad, samples = c >> 1 & 1, {1: 384, 2: 1152, 3: 1152 if first else 576}[layer]
    size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return Header(version, layer, not b & 1, kbps, rate, pad, 1 if d >> 6 == 3 else 2, size, samples, 4 * (d >> 4 & 3) + 4 if d >> 6 == 1 else 32)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    duration: Fraction = Fraction(0)
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    vbr: dict = field(default_factory=dict)
    first: Header | None = None
    body: bytes = b""

    def seek(self, seconds: float) -> int:
        """The offset of the frame that holds this time."""
        if not len(self.offsets):
            return -1
        i = int(Fraction(seconds) * len(self.offsets) / self.duration) if self.duration else 0
        return int(self.offsets[min(max(i, 0), len(self.offsets) - 1)])


def _protected_bits(h: Header, body: bytes) -> int | None:
    """How many bits behind the checksum it covers: side information, or allocation bits (and scale factor choices in Layer II)."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.channels * min(h.bound, 32) + 32 - min(h.bound, 32))
    each = h.kbps // h.channels
    table = "E" if h.version != "1" else "A" if (h.rate == 48000 and each >= 56) or 56 <= each <= 80 else "B" if h.rate != 48000 and each >= 96 else "C" if h.rate != 32000 and each <= 48 else "D"
    value, size, at, chosen = int.from_bytes(body), 8 * len(body), 0, 0
    for band, width in enumerate(ALLOCATION[table]):
        own = h.channels if band < h.bound else 1
        for _ in range(own):
            if at + width > size:
                return None
            chosen += (value >> size - at - width & (1 << width) - 1 != 0) * (h.channels // own)
            at += width
    return at + 2 * chosen


def _crc_holds(data: bytes, at: int, h: Header) -> bool | None:
    """Whether the frame's checksum holds; None: it has none."""
    if not h.protected:
        return None
    body = data[at + 6 : at + min(h.size, 6 + 64)]
    bits = _protected_bits(h, body)
    return bits is not None and bits <= 8 * len(body) and crc16(data[at + 2 : at + 4] + body, 16 + bits) == int.from_bytes(data[at + 4 : at + 6])


def _goes_on(data: bytes, at: int, h: Header, end: int) -> bool:
    to = at + h.size
    if to >= end:
        return to == end
    n = header(data, to)
    return n is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    synch = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, tags, old = min(len(data), 10 + synch(data[6:10])), {}, data[3] == 2
    own, at = data[10:end], 0
    if data[5] & 0x80:  # a zero was put behind each 255
        own = own.replace(b"\xff\0", b"\xff")
    if data[5] & 0x40 and not old:  # an extended header
        at = synch(own[:4]) if data[3] == 4 else 4 + int.from_bytes(own[:4])
    head = 6 if old else 10
    while at + head <= len(own) and own[at]:
        name = own[at : at + (3 if old else 4)].decode("latin-1")
        size = int.from_bytes(own[at + 3 : at + 6]) if old else synch(own[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(own[at + 4 : at + 8])
        raw = own[at + head : at + head + size]
        if name[0] == "T" and raw:
            text = raw[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(raw[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else ({"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB"}.get(name, name), "", text)
            tags[key] = value.strip("\0")
        at += head + size
    return tags, end


def _table_frame(data: bytes, at: int, h: Header) -> dict:
    """The Xing, Info or VBRI table of a frame, or nothing."""
    body = at + 4 + 2 * h.protected + h.side
    kind = data[body : body + 4]
    if kind in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[body + 4 : body + 8]), body + 8
        out: dict = {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[p : p + 4])
                p += 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        v = at + 36
        n, scale, width = (int.from_bytes(data[v + k : v + k + 2]) for k in (18, 20, 22))
        return {"kind": "VBRI", "bytes": int.from_bytes(data[v + 10 : v + 14]), "frames": int.from_bytes(data[v + 14 : v + 18]), "toc": [scale * int.from_bytes(data[v + 26 + i * width : v + 26 + (i + 1) * width]) for i in range(n)]}
    return {}


def parse(data: bytes, unit: int = 0) -> Stream:
    """Read a stream; with ``unit``, also the first so many ancillary bytes of every frame, as one body."""
    end = len(data) - 128
    if data[-128:-125] != b"TAG":
        return _parse(data, unit, len(data))
    out, plain = _parse(data, unit, end), _parse(data, unit, len(data))
    if plain.skipped < out.skipped:  # the bytes lie within a frame
        return plain
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
        out.tags.setdefault(name, data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"))
    return out


def _parse(data: bytes, unit: int, end: int) -> Stream:
    out = Stream()
    out.tags, at = _id3v2(data)
    view, offsets, sizes, bodies = np.frombuffer(data, np.uint8), [], [], []
    samples: dict[int, int] = {}  # by rate
    while at < end:
        h = header(data, at)
        if h is None or not _goes_on(data, at, h, end) or (holds := _crc_holds(data, at, h)) is False and not offsets:
            to = data.find(b"\xff", at + 1, end)
            out.skipped += (to if to >= 0 else end) - at
            if to < 0:
                break
            at = to
            continue
        if not offsets and not out.vbr and (table := _table_frame(data, at, h)):
            out.vbr, out.first = table, h
            at += h.size
            continue
        out.first = out.first or h
        # frames with this very header, one after another, looked for in steps that double
        n, most = 1, (end - at) // h.size
        while n < most:
            to = min(2 * n, most)
            rows = view[at + n * h.size : at + to * h.size].reshape(to - n, h.size)
            same = (rows[:, :4] == view[at : at + 4]).all(axis=1)
            if not same.all():
                n += int(np.argmin(same))
                break
            n = to
        rows = view[at : at + n * h.size].reshape(n, h.size)
        skip = 4 + 2 * h.protected + h.side
        if holds is not None:
            if h.layer == 3:
                good = crc16_rows(np.hstack([rows[:, 2:4], rows[:, 6:skip]])) == rows[:, 4].astype(np.uint16) * 256 + rows[:, 5]
            else:
                good = np.array([_crc_holds(data, at + i * h.size, h) for i in range(n)])
            out.checked += int(good.sum())
            out.broken += int((~good).sum())
        offsets.append(at + h.size * np.arange(n))
        sizes.append(np.full(n, h.size))
        samples[h.rate] = samples.get(h.rate, 0) + n * h.samples
        if unit:
            bodies.append(rows[:, skip : skip + unit].tobytes())
        at += n * h.size
    if offsets:
        out.offsets, out.sizes = np.concatenate(offsets), np.concatenate(sizes)
    out.duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    out.body = b"".join(bodies)
    return out


# the writer's frame: MPEG-1 Layer III, 48 kbit/s at 32 kHz, mono, with checksum
_HEAD = bytes([0xFF, 0xFA, 0x38, 0xC0])
_SIDE = bytes(17)
_FRAME = header(_HEAD, 0)
_FRONT = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2) + _SIDE


def payload(text: bytes, unit: int = UNIT) -> bytes:
    return text + b" " * (unit - len(text) % unit if len(text) % unit or not text else 0)


def write(text: bytes) -> bytes:
    """The stream that carries payload(text); the tag keeps the unpadded length."""
    body = np.frombuffer(payload(text), np.uint8).reshape(-1, UNIT)
    size = _FRAME.size
    frames = np.zeros((len(body), size), np.uint8)
    frames[:, : len(_FRONT)] = np.frombuffer(_FRONT, np.uint8)
    frames[:, len(_FRONT) : len(_FRONT) + UNIT] = body
    value = b"\x03payload-bytes\0" + str(len(text)).encode()
    synch = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    tag = b"TXXX" + synch(len(value)) + b"\0\0" + value
    toc = bytes(256 * i // 100 for i in range(100))
    total = size * (len(body) + 1)
    info = b"Info" + (7).to_bytes(4) + len(body).to_bytes(4) + total.to_bytes(4) + toc
    return b"ID3\x04\0\0" + synch(len(tag)) + tag + (_FRONT + info).ljust(size, b"\0") + frames.tobytes()


def feature(s: Stream) -> str:
    if s.first is None:
        return "none"
    h = s.first
    last = int(s.offsets[-1]) if len(s.offsets) else -1
    return f"mpeg{h.version}-layer{h.layer};{h.rate}Hz;{h.kbps}kbps;{h.channels}ch;frames={len(s.offsets)};us={int(s.duration * 1_000_000)};crc={s.checked}/{s.checked + s.broken};table={s.vbr.get('kind', 'none')}:{s.vbr.get('frames', 0)};seek={s.seek(0)},{s.seek(float(s.duration) / 2)},{last}"


def store_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: the stream that carries each text."""
    return map_texts(docs, id_col, text_col, [("media", "binary")], lambda texts: [(write(t),) for t in texts])


def probe_column(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the parser finds in each stream: exact duration, checksum counts, seek offset of every frame, tags' length, feature."""
    fields = [("n_frames", "bigint"), ("duration_num", "bigint"), ("duration_den", "bigint"), ("crc_good", "bigint"), ("crc_broken", "bigint"), ("skipped", "bigint"), ("table_frames", "bigint"), ("seek_offsets", "array<bigint>"), ("feature", "string")]

    def rows_of(streams: list[bytes]) -> Iterable[tuple]:
        for data in streams:
            s = parse(data)
            yield len(s.offsets), s.duration.numerator, s.duration.denominator, s.checked, s.broken, s.skipped, s.vbr.get("frames"), s.offsets, feature(s)

    return map_texts(media, id_col, media_col, fields, rows_of, raw=True)


def store_and_read(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text, read the stored bytes back, and describe payload and stream, with the offset of every frame; with_media adds the streams."""
    fields = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("duration_us", "bigint"), ("frame_offsets", "array<bigint>")] + [("media", "binary")] * with_media

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        for t in texts:
            media = write(t)
            s = parse(media, UNIT)
            row = int(s.tags["payload-bytes"]), len(s.body), hashlib.sha256(s.body).hexdigest(), zlib.crc32(s.body[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), int(s.duration * 1_000_000), s.offsets
            yield (*row, media) if with_media else row

    return map_texts(docs, id_col, text_col, fields, rows_of)
