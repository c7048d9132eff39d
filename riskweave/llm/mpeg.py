"""Media columns: MPEG audio.

A payload is stored losslessly in an MPEG-1 Layer III stream: a tag with the payload's exact length, a
variable-bitrate header frame (frame and byte counts, a table of 100 seek points), and frames with a
checksum and empty side information, which decode to silence. The payload travels in the frames' data
areas. Reading needs nothing but the bytes: it parses the tag, resynchronises on frame headers (a header
counts if the next one or the end stands where its length says, or its checksum is right), verifies each
frame's checksum, checks the variable-bitrate header's counts and seek table against the frames, and gives
exact durations and every frame's offset.

Fixed values of the format: bitrates, sampling rates, sync word, the checksum polynomial 0x8005.

Defined cases: a null text is empty, its payload 64 zero bytes; a tag or header that is cut off or damaged is read
as far as it holds, damage between frames is skipped, both are counted and nothing raises; a very long text is
held whole, with its stored form, a few times its size; rows that repeat a doc_id are each stored; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_slices

BLOCK = 64
# Fixed values of MPEG-1 Layer III: kbit/s by index, samples/s by index, samples in a frame.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
#: Written at 48 kHz, where a frame is 3 bytes a kbit/s without padding; mono, so 17 bytes of side information.
RATE_INDEX = 1
SIDE = 17
HEAD = 4 + 2 + SIDE
OWNER = b"payload-bytes\x00"


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The frame checksum, over the header's last two bytes and the side information."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def header(bitrate_index: int) -> bytes:
    """MPEG-1, Layer III, checksummed, 48 kHz, mono, with checksum and empty side information."""
    head = bytes([0xFF, 0xFA, bitrate_index << 4 | RATE_INDEX << 2, 0xC4])
    side = bytes(SIDE)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


def frame_length(bitrate_index: int, rate_index: int, padding: int) -> int:
    return 144000 * BITRATES[bitrate_index] // RATES[rate_index] + padding


HEADERS = {i: header(i) for i in range(1, len(BITRATES))}
ROOM = {i: frame_length(i, RATE_INDEX, 0) - HEAD for i in HEADERS}


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, filled with zeros up to a positive multiple of 64; and their count before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def tag(payload_bytes: int) -> bytes:
    """An ID3v2.3 tag with a private frame that holds the payload's length."""
    body = OWNER + struct.pack(">Q", payload_bytes)
    frame = b"PRIV" + struct.pack(">IH", len(body), 0) + body
    return b"ID3\x03\x00\x00" + synchsafe(len(frame)) + frame


def encode(payload: bytes) -> bytes:
    top = max(ROOM)
    full, rest = divmod(len(payload), ROOM[top])
    whole = np.empty((full, HEAD + ROOM[top]), np.uint8)
    whole[:, :HEAD] = np.frombuffer(HEADERS[top], np.uint8)
    whole[:, HEAD:] = np.frombuffer(payload, np.uint8, full * ROOM[top]).reshape(full, ROOM[top])
    last = b""
    if rest:
        fit = min(i for i in ROOM if ROOM[i] >= rest)
        last = HEADERS[fit] + payload[full * ROOM[top] :] + bytes(ROOM[fit] - rest)
    frames = full + bool(rest)
    lead = frame_length(7, RATE_INDEX, 0)
    stream = lead + whole.size + len(last)
    # frames are equally long but for the last, so all offsets are known without a second pass
    at = seek_points([lead + k * (HEAD + ROOM[top]) for k in range(frames)], 0, stream)
    xing = b"Xing" + struct.pack(">III", 7, frames, stream) + at
    first = HEADERS[7] + xing
    return tag(len(payload)) + first + bytes(lead - len(first)) + whole.tobytes() + last


@dataclass
class Media:
    payload: bytes = b""
    #: payload bytes that the tag promises and the frames don't have
    missing: int = 0
    frames: int = 0
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    bad_checksums: int = 0
    #: what the variable-bitrate header says, where it has it
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    vbr_seek: bytes | None = None
    #: how many of its counts and seek points aren't what the frames say
    vbr_wrong: int = 0
    #: the offset of every frame that carries sound
    seek: list[int] = field(default_factory=list)
    bitrates: dict[int, int] = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def parse_header(data: bytes, at: int) -> tuple[int, int, int, bool, int] | None:
    """(length, rate, bitrate, checksummed, side bytes) of an MPEG-1 Layer III header at `at`, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    bitrate, rate, mono = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 3] >> 6 == 3
    if bitrate in (0, 15) or rate == 3:
        return None
    return frame_length(bitrate, rate, data[at + 2] >> 1 & 1), RATES[rate], BITRATES[bitrate], not data[at + 1] & 1, 17 if mono else 32


def checksum_holds(data: bytes, at: int, checked: bool, side: int) -> bool:
    """Whether the frame at `at` has a checksum and it is right."""
    return checked and int.from_bytes(data[at + 4 : at + 6], "big") == crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side])


def parse_tag(data: bytes) -> tuple[int, int | None]:
    """(where the tag ends, the payload's length if a private frame says it)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, None
    end = min(len(data), 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0))))
    at, size = 10, None
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 4] == b"PRIV" and body.startswith(OWNER) and len(body) == len(OWNER) + 8:
            size = int.from_bytes(body[len(OWNER) :], "big")
        at += 10 + n
    return end, size


def parse_vbr(frame: bytes, out: Media) -> None:
    """The fields of a variable-bitrate header that begins with its name, as far as the frame holds them."""
    flags, p = int.from_bytes(frame[4:8], "big"), 8
    for bit, name, n in ((1, "vbr_frames", 4), (2, "vbr_bytes", 4), (4, "vbr_seek", 100)):
        if flags & bit and p + n <= len(frame):
            setattr(out, name, frame[p : p + n] if n == 100 else int.from_bytes(frame[p : p + n], "big"))
            p += n


def seek_points(offsets: list[int], first: int, stream: int) -> bytes:
    """The 100 seek points of frames at `offsets` in a stream of so many bytes from `first` on."""
    at = offsets or [first]
    return bytes(min(255, (at[p * len(offsets) // 100] - first) * 256 // max(1, stream)) for p in range(100))


def decode(data: bytes) -> Media:
    at, size = parse_tag(data)
    out = Media()
    parts: list[bytes] = []
    first: int | None = None
    end = at
    while at < len(data):
        got = parse_header(data, at)
        fits = got is not None and at + got[0] <= len(data)
        good = fits and checksum_holds(data, at, got[3], got[4])
        # a header counts if its successor, the end, or its own checksum confirms it
        if not fits or not (good or at + got[0] == len(data) or parse_header(data, at + got[0]) is not None):
            step = data.find(b"\xff", at + 1)
            step = len(data) if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        length, rate, bitrate, checked, side = got
        body = at + 4 + 2 * checked + side
        out.bad_checksums += checked and not good
        if first is None and data[body : body + 4] in (b"Xing", b"Info"):
            parse_vbr(data[body : at + length], out)
        else:
            out.frames += 1
            out.samples += SAMPLES
            out.rate = rate
            out.bitrates[bitrate] = out.bitrates.get(bitrate, 0) + 1
            out.seek.append(at)
            parts.append(data[body : at + length])
        first = at if first is None else first
        at += length
        end = at
    joined = b"".join(parts)
    out.payload = joined if size is None else joined[:size]
    out.missing = 0 if size is None else max(0, size - len(joined))
    stream = end - (first or 0)
    out.vbr_wrong = (out.vbr_frames not in (None, out.frames)) + (out.vbr_bytes not in (None, stream))
    if out.vbr_seek is not None:
        out.vbr_wrong += sum(a != b for a, b in zip(out.vbr_seek, seek_points(out.seek, first or 0, stream)))
    return out


def feature(m: Media) -> str:
    """Durations, counts and a digest of all seek offsets."""
    rates = "+".join(f"{k}x{v}" for k, v in sorted(m.bitrates.items()))
    seek = f"{len(m.seek)}/{zlib.crc32(np.array(m.seek, '<i8').tobytes()):08x}"
    return (
        f"frames={m.frames};samples={m.samples};rate={m.rate};duration_us={m.duration_us};kbps={rates};vbr={m.vbr_frames}/{m.vbr_bytes}/{m.vbr_wrong};"
        f"bad={m.bad_checksums};skipped={m.skipped};missing={m.missing};seek={seek}"
    )


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the stored form of every whole text."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 23):
                sizes, media = [], []
                for x in part.column(1):
                    payload, n = padded(x.as_py())
                    sizes.append(n)
                    media.append(encode(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return narrow.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_offsets array<long>"


def read_media(stored: DataFrame) -> DataFrame:
    """Features and the payload's digests, from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                data = x.as_py() or b""
                m = decode(data)
                rows.append((len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(m), m.duration_us, m.seek))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], [f.split()[0] for f in FEATURES.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op3_media(spark, sf_dir: str) -> DataFrame:
    return read_media(store_media(table(spark, sf_dir, "documents")))
