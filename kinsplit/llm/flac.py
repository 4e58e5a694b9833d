"""Media columns: payloads as FLAC streams (mono, 8 bit) and their PCM blocks.

The encoder picks, for each block of ``BLOCK`` samples, the fixed linear predictor of
order 0 to 4 with the smallest residual and Rice-codes it; blocks that would grow are
stored verbatim and even ones as constants. Each stream has STREAMINFO with the MD5 of
its samples and a SEEKTABLE with the sample and byte offset of every frame. The decoder
reads any number of channels and sample size: constant, verbatim, fixed and LPC subframes
with Rice partitions, wasted bits and channel differences. It finds frames by their
headers, with or without a seek table, and checks the CRC-8 of each header, each frame's
CRC-16 and the stream's MD5. :func:`read_samples` decodes only the frames that hold the
samples asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsplit.plans.scratch import stored

BLOCK, RATE, UNIT = 4096, 8000, 192
#: Fixed values of the format: frame sync, CRC polynomials, predictor coefficients.
SYNC, POLY8, POLY16 = 0x3FFE, 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """The stream is damaged or uses a feature outside this codec."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc


_CRC8 = _crc_table(POLY8, 8).tolist()
_CRC16 = _crc_table(POLY16, 16).astype(np.uint16)
_by_distance = _CRC16[None, :]


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: bytes) -> int:
    """CRC-16 as an exclusive or of one table entry for each byte and its distance to the end."""
    global _by_distance
    n = len(data)
    if n > len(_by_distance):
        rows = [*_by_distance]
        while len(rows) < n:
            t = rows[-1]
            rows.append((t << np.uint16(8)) ^ _CRC16[t >> np.uint16(8)])
        _by_distance = np.array(rows)
    return int(np.bitwise_xor.reduce(_by_distance[np.arange(n - 1, -1, -1), np.frombuffer(data, np.uint8)], initial=0))


def _utf8(number: int) -> bytes:
    """The coded frame number: UTF-8's scheme, up to 36 bits."""
    if number < 0x80:
        return bytes([number])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | number & 0x3F)
        number >>= 6
        if number < limit:
            return bytes([(~(2 * limit - 1) & 0xFF) | number, *reversed(tail)])
        limit >>= 1


def _residual(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.diff(x)
    return x


def _subframe(x: np.ndarray) -> np.ndarray:
    """The bits (0/1 bytes) of one channel's subframe."""
    n = len(x)
    if n and (x == x[0]).all():
        return np.unpackbits(np.array([0, x[0] & 0xFF], np.uint8))
    # Samples have 8 bits, so four differences fit in 16.
    ladder = [x.astype(np.int16)]
    for _ in range(min(4, n - 1)):
        ladder.append(np.diff(ladder[-1]))
    sizes = [int(np.abs(r).sum()) + 64 * p for p, r in enumerate(ladder)]
    order = int(np.argmin(sizes))
    r = ladder[order]
    u = (r << 1) ^ (r >> 15)
    k0 = max(0, int(np.log2(u.mean() + 1e-9)))
    costs = {k: int((u >> k).sum()) + (k + 1) * len(u) + 8 * order for k in (max(0, k0 - 1), k0) if k < 15}
    k = min(costs, key=costs.get)
    if costs[k] + 10 >= 8 * n:
        return np.concatenate([np.unpackbits(np.array([2], np.uint8)), np.unpackbits((x & 0xFF).astype(np.uint8))])
    head = np.unpackbits(np.concatenate([[(8 | order) << 1], x[:order] & 0xFF]).astype(np.uint8))
    end = np.cumsum((u >> k) + np.int16(1 + k), dtype=np.int64) + 10
    bits = np.zeros(int(end[-1]), np.uint8)  # method 00, partition order 0000, parameter
    for b in range(4):
        bits[6 + b] = k >> (3 - b) & 1
    for b in range(k):
        end -= 1
        bits[end] = (u >> b).astype(np.uint8) & 1
    bits[end - 1] = 1
    return np.concatenate([head, bits])


def _frame(number: int, x: np.ndarray) -> bytes:
    whole = len(x) == BLOCK
    head = (SYNC << 2).to_bytes(2, "big") + bytes([(12 if whole else 7) << 4 | 4, 1 << 1]) + _utf8(number)
    if not whole:
        head += (len(x) - 1).to_bytes(2, "big")
    head += bytes([crc8(head)])
    body = head + np.packbits(_subframe(x)).tobytes()
    return body + crc16(body).to_bytes(2, "big")


def encode(payload: bytes) -> bytes:
    """A FLAC stream whose samples are the payload's bytes minus 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    frames = [_frame(i, x[at : at + BLOCK]) for i, at in enumerate(range(0, len(x), BLOCK))]
    sizes = [len(f) for f in frames]
    points, at = b"", 0
    for i, n in enumerate(sizes):
        points += (i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(x) - i * BLOCK).to_bytes(2, "big")
        at += n
    block = max(16, min(BLOCK, len(x)))
    info = block.to_bytes(2, "big") * 2 + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(frames)


@dataclass(frozen=True)
class Info:
    """What the metadata of a stream say; ``points`` are (first sample, byte offset) of some frames."""

    block: int
    rate: int
    channels: int
    width: int
    total: int
    md5: bytes
    points: tuple[tuple[int, int], ...]
    first_frame: int


def read_info(stream: bytes) -> Info:
    """STREAMINFO and, where there is one, the SEEKTABLE; other metadata are skipped."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata ends early")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        own = stream[at + 4 : at + 4 + size]
        if len(own) < size:
            raise FlacError("metadata ends early")
        if kind == 0:
            packed = int.from_bytes(own[10:18], "big")
            info = int.from_bytes(own[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, own[18:34]
        elif kind == 3:
            points = [(int.from_bytes(own[k : k + 8], "big"), int.from_bytes(own[k + 8 : k + 16], "big")) for k in range(0, size - 17, 18)]
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    return Info(*info, tuple(p for p in points if p[0] != (1 << 64) - 1), at)  # placeholders point nowhere


@dataclass(frozen=True)
class Frame:
    start: int  # first sample
    samples: int
    layout: int  # channels less one, or 8, 9, 10 for two channels with a difference
    width: int
    head: int  # bytes of the header


_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}  # fixed values of the format


def _frame_header(data: bytes, info: Info) -> Frame | None:
    """The header that starts here; None if there is none or its CRC-8 is wrong."""
    if len(data) < 6 or data[0] != 0xFF or data[1] & 0xFE != 0xF8:
        return None
    first = data[4]
    ones = 8 - (first ^ 0xFF).bit_length()
    if ones == 1 or ones == 8:
        return None
    number, at = (first if ones == 0 else first & (0x7F >> ones)), 5
    need = max(0, ones - 1) + 2 + 2 + 1  # number, size, rate, CRC at most
    data = data[: at + need]
    for _ in range(max(0, ones - 1)):
        if at >= len(data):
            return None
        number, at = number << 6 | data[at] & 0x3F, at + 1
    size = data[2] >> 4
    if size == 0:
        return None
    if size in (6, 7):
        n = int.from_bytes(data[at : at + size - 5], "big") + 1
        at += size - 5
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    at += {12: 1, 13: 2, 14: 2}.get(data[2] & 15, 0)
    if at >= len(data) or crc8(data[:at]) != data[at]:
        return None
    layout, code = data[3] >> 4, data[3] >> 1 & 7
    width = info.width if code == 0 else _WIDTHS.get(code)
    if layout > 10 or width is None:
        raise FlacError("reserved channel layout or sample size")
    return Frame(number if data[1] & 1 else number * info.block, n, layout, width, at + 1)


def frames(stream: bytes, info: Info, start: int = 0) -> Iterator[tuple[Frame, bytes]]:
    """Headers and bytes of the frames from the one with sample ``start`` or an earlier one on.

    A frame reaches to the next header before which its CRC-16 holds, or to the end.
    """
    at = info.first_frame + max((offset for sample, offset in info.points if sample <= start), default=0)
    while at < len(stream):
        frame = _frame_header(stream[at : at + 16], info)
        if frame is None:
            raise FlacError("lost sync or frame header checksum")
        end = at + frame.head
        while True:
            end = stream.find(b"\xff", end)
            if end < 0:
                end = len(stream)
            elif end + 1 < len(stream) and stream[end + 1] & 0xFE != 0xF8 or _frame_header(stream[end : end + 16], info) is None:
                end += 1
                continue
            own = stream[at:end]
            if len(own) > frame.head + 2 and crc16(own[:-2]) == int.from_bytes(own[-2:], "big"):
                break
            if end == len(stream):
                raise FlacError("frame checksum")
            end += 1
        yield frame, own
        at = end


def _value(bits: np.ndarray, at: int, width: int) -> int:
    v = 0
    for b in bits[at : at + width].tolist():
        v = v << 1 | b
    return v


def _signed(v: int, width: int) -> int:
    return v - (1 << width) if width and v >> (width - 1) else v


def _fields(bits: np.ndarray, at: int, n: int, width: int) -> np.ndarray:
    """``n`` signed numbers of ``width`` bits."""
    if width == 8:
        return np.packbits(bits[at : at + 8 * n]).view(np.int8).astype(np.int64)
    if n * width == 0:
        return np.zeros(n, np.int64)
    own = bits[at : at + width * n].reshape(n, width).astype(np.int64)
    return own @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) - (own[:, 0] << width)


def _rice(bits: np.ndarray, find, at: int, n: int, k: int) -> tuple[np.ndarray, int]:
    """``n`` residuals of Rice parameter ``k``, and where the next code starts."""
    step, nxt = k + 1, at
    stops = np.array([(nxt := find(b"\x01", nxt) + step) for _ in range(n)], np.int64) - step
    if n and ((stops < at).any() or nxt > len(bits)):
        raise FlacError("residual ends early")
    begin = np.concatenate(([at], stops[:-1] + step)) if n else stops
    u = stops - begin
    for _ in range(k):
        stops = stops + 1
        u = u << 1 | bits.take(stops)
    return (u >> 1) ^ -(u & 1), nxt


def _residuals(bits: np.ndarray, at: int, n: int, order: int) -> tuple[np.ndarray, int]:
    """The residuals of a block of ``n`` samples after ``order`` of them."""
    method, parts = _value(bits, at, 2), 1 << _value(bits, at + 2, 4)
    if method > 1 or n % parts or n // parts < order:
        raise FlacError("reserved residual coding")
    at, wide, out, find = at + 6, 4 + method, [], bits.tobytes().find
    for p in range(parts):
        k, at = _value(bits, at, wide), at + wide
        m = n // parts - (order if p == 0 else 0)
        if k == (1 << wide) - 1:  # not coded
            raw, at = _value(bits, at, 5), at + 5
            r, at = _fields(bits, at, m, raw), at + raw * m
        else:
            r, at = _rice(bits, find, at, m, k)
        out.append(r)
    return np.concatenate(out), at


def _channel(bits: np.ndarray, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    """One channel's samples, and where its subframe ends."""
    kind, wasted = _value(bits, at + 1, 6), 0
    at += 8
    if bits[at - 1]:
        stop = int(np.argmax(bits[at : at + width] == 1))
        wasted, at, width = stop + 1, at + stop + 1, width - stop - 1
    if kind == 0:
        x, at = np.full(n, _signed(_value(bits, at, width), width), np.int64), at + width
    elif kind == 1:
        x, at = _fields(bits, at, n, width), at + width * n
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        warm, at = _fields(bits, at, order, width), at + width * order
        taps, shift = FIXED[order] if kind < 32 else None, 0
        if taps is None:
            precision, shift = _value(bits, at, 4) + 1, _signed(_value(bits, at + 4, 5), 5)
            taps, at = _fields(bits, at + 9, order, precision).tolist(), at + 9 + precision * order
        r, at = _residuals(bits, at, n, order)
        x = _predicted(warm, r, taps, shift) if kind >= 32 else _summed(warm, r)
    else:
        raise FlacError(f"subframe type {kind}")
    return x << wasted, at


def _predicted(warm: np.ndarray, residual: np.ndarray, taps: list[int], shift: int) -> np.ndarray:
    """Each sample from the ones before it, the last of which has the first tap."""
    x, order = warm.tolist(), len(taps)
    for r in residual.tolist():
        x.append(r + (sum(c * v for c, v in zip(taps, reversed(x[-order:]))) >> shift))
    return np.array(x, np.int64)


def _summed(warm: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A fixed predictor of order p undoes p differences: p running sums from the warm-up."""
    ladder = [warm]
    for _ in range(len(warm)):
        ladder.append(np.diff(ladder[-1]))
    for p in range(len(warm) - 1, -1, -1):
        x = np.cumsum(np.concatenate([ladder[p][-1:], x]))[1:]
    return np.concatenate([warm, x])


def _samples(frame: Frame, data: bytes) -> np.ndarray:
    """The samples of a frame, a column for each channel."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[frame.head : -2])
    at, out = 0, []
    for k in range(2 if frame.layout >= 8 else frame.layout + 1):
        difference = (frame.layout, k) in ((8, 1), (9, 0), (10, 1))
        x, at = _channel(bits, at, frame.samples, frame.width + difference)
        out.append(x)
    if frame.layout == 8:  # left and difference
        out[1] = out[0] - out[1]
    elif frame.layout == 9:  # difference and right
        out[0] = out[0] + out[1]
    elif frame.layout == 10:  # middle and difference
        middle, side = out[0] << 1 | out[1] & 1, out[1]
        out = [(middle + side) >> 1, (middle - side) >> 1]
    return np.stack(out, 1)


def blocks(stream: bytes, start: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(sample offset, samples x channels) of the frames that hold samples ``start`` to ``start + count``."""
    info = read_info(stream)
    stop = None if count is None else start + count
    for frame, data in frames(stream, info, start):
        if stop is not None and frame.start >= stop:
            return
        if frame.start + frame.samples > start:
            yield frame.start, _samples(frame, data)


def decode_samples(stream: bytes) -> np.ndarray:
    """All samples, a column for each channel; checksums of frames and stream are verified."""
    info = read_info(stream)
    parts = [x for _, x in blocks(stream)]
    x = np.concatenate(parts) if parts else np.zeros((0, info.channels), np.int64)
    size = -(-info.width // 8)
    raw = x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()
    if info.total and len(x) != info.total or any(info.md5) and hashlib.md5(raw).digest() != info.md5:
        raise FlacError("samples do not match STREAMINFO")  # zeros there mean unknown
    return x


def decode(stream: bytes) -> bytes:
    """The payload that :func:`encode` was given."""
    info = read_info(stream)
    if (info.channels, info.width) != (1, 8):
        raise FlacError("a payload has one channel of 8 bits")
    return (decode_samples(stream)[:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def read_samples(stream: bytes, start: int, count: int) -> np.ndarray:
    """Samples ``start`` to ``start + count`` of each channel, from only the frames that hold them."""
    parts = [x[max(0, start - at) : max(0, start + count - at)] for at, x in blocks(stream, start, count)]
    return np.concatenate(parts) if parts else np.zeros((0, read_info(stream).channels), np.int64)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of 192, and their number before that."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def feature(pcm: bytes) -> str:
    """Frames, energy, zero crossings and peak of the decoded samples, all whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"frames={-(-len(x) // BLOCK)};energy={int((x * x).sum())};crossings={crossings};peak={int(abs(x).max())}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of every whole text (null: empty); repeated rows stay."""

    @F.pandas_udf("n_bytes long, media binary")
    def flac(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [(n, encode(p)) for p, n in map(payload, texts)]
            yield pd.DataFrame(made, columns=["n_bytes", "media"])

    return docs.select("doc_id", flac(F.col("text")).alias("_m")).select("doc_id", "_m.n_bytes", "_m.media")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row for each frame: doc_id, sample_offset, n_samples and its PCM bytes (of mono 8-bit streams)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for doc_id, stream in zip(part.doc_id, part.media):
                rows = [(doc_id, at, len(x), (x[:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes()) for at, x in blocks(stream)]
                yield pd.DataFrame(rows, columns=["doc_id", "sample_offset", "n_samples", "pcm"])

    named = media.select(F.col("doc_id").cast("string").alias("doc_id"), "media")  # pandas has no null long
    rows = named.mapInPandas(unpack, "doc_id string, sample_offset long, n_samples int, pcm binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _digests(stream: bytes) -> tuple:
    p = decode(stream)
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(p)


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the stored streams, from their decoded samples."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for streams in batches:
            yield pd.DataFrame([_digests(s) for s in streams], columns=DIGESTS)

    return media.select("doc_id", "n_bytes", read(F.col("media")).alias("_r")).select("doc_id", "n_bytes", "_r.*")


def store_media(docs: DataFrame) -> DataFrame:
    """The streams of all texts, written to a table and read from it."""
    return stored(to_media(docs), compression="zstd")


def op7(docs: DataFrame) -> DataFrame:
    """Every text stored as a stream; digests and features of what is read back.

    Null texts are empty ones, whose payload is 192 spaces; a null doc_id stays null; repeated
    rows stay; an empty table has no row; other columns than doc_id and text are not read.
    """
    return describe(store_media(docs.select("doc_id", "text")))
