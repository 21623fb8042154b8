"""FLAC frames: a decoder that goes on behind damage, and a small encoder, both by the published format (RFC 9639).

A frame's bits are held as a string of zeros and ones, in which the unary parts of Rice codes are found by a search. A frame
counts if the check of its header (CRC-8) and its own (CRC-16) are right; behind a bad one decoding goes on at the next
header whose check is right."""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from lodestone.sources import media

#: Fixed values of the format: samples of a block and rates by their codes (0: told otherwise), bits by their codes.
BLOCKS = (0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
RATES = (0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000, 0, 0, 0, 0)
BITS = (0, 8, 12, 0, 16, 20, 24, 32)
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def _table(polynomial: int, width: int) -> list[int]:
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = (value << 1) ^ (polynomial if value & top else 0)
        out.append(value & mask)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16(data: bytes, value: int = 0) -> int:
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC16[value >> 8 ^ byte]
    return value


class _Bits:
    def __init__(self, data: bytes):
        self.text, self.at = bin(int.from_bytes(b"\x01" + data, "big"))[3:], 0

    def number(self, n: int) -> int:
        if self.at + n > len(self.text):
            raise media.Damaged("a frame ends early")
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        found = self.text.find("1", self.at)
        if found < 0:
            raise media.Damaged("a frame ends early")
        count, self.at = found - self.at, found + 1
        return count


@dataclass
class Head:
    size: int
    rate: int
    layout: int
    bits: int
    end: int

    @property
    def channels(self) -> int:
        return self.layout + 1 if self.layout < LEFT_SIDE else 2


def head(data: bytes, at: int, bits: int) -> Head | None:
    """The frame header at this place if there is one whose check is right; ``bits`` is what the stream says of its samples."""
    part = data[at : at + 16]
    if len(part) < 6 or part[0] != 0xFF or part[1] & 0xFE != 0xF8:
        return None
    block, rate, layout, depth = part[2] >> 4, part[2] & 15, part[3] >> 4, part[3] >> 1 & 7
    if not block or rate == 15 or layout > MID_SIDE or depth == 3 or part[3] & 1:
        return None
    # The number of the frame: as many bytes more as its first one has ones on top.
    ones = 8 - (part[4] ^ 0xFF).bit_length()
    place = 4 + max(1, ones)
    size = BLOCKS[block]
    if block in (6, 7):
        size = int.from_bytes(part[place : place + block - 5], "big") + 1
        place += block - 5
    place += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if place >= len(part) or crc8(part[:place]) != part[place]:
        return None
    return Head(size, RATES[rate], layout, BITS[depth] or bits, at + place + 1)


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    width = (4, 5)[method] if (method := bits.number(2)) < 2 else 0
    if not width:
        raise media.Damaged("an unknown way of coding")
    parts, out = bits.number(4), []
    text = bits.text
    for part in range(1 << parts):
        count = (size >> parts) - (0 if part else order)
        k = bits.number(width)
        if count < 0:
            raise media.Damaged("a part is shorter than its predictor")
        if k == (1 << width) - 1:
            raw = bits.number(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        at = bits.at
        for _ in range(count):
            one = text.find("1", at)
            stop = one + 1 + k
            if one < 0 or stop > len(text):
                raise media.Damaged("a frame ends early")
            value = (one - at) << k | (int(text[one + 1 : stop], 2) if k else 0)
            out.append(value >> 1 ^ -(value & 1))
            at = stop
        bits.at = at
    return out


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    if bits.number(1):
        raise media.Damaged("a subframe begins wrongly")
    kind = bits.number(6)
    wasted = bits.unary() + 1 if bits.number(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        out = np.array([bits.signed(depth) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = [bits.signed(depth) for _ in range(order)]
        out = np.array(first + _residual(bits, size, order), np.int64)
        # A difference of some order is undone by as many sums, each from the difference of the first samples on.
        for level in range(order - 1, -1, -1):
            start = np.diff(np.array(first, np.int64), level)
            out[level:] = np.concatenate([start[:1], start[0] + np.cumsum(out[level + 1 :])]) if level + 1 <= order else out[level:]
    elif kind >= 32:
        order = kind - 31
        values = [bits.signed(depth) for _ in range(order)]
        precision = bits.number(4) + 1
        shift = bits.signed(5)
        if precision == 16 or shift < 0:
            raise media.Damaged("a predictor that isn't allowed")
        weights = [bits.signed(precision) for _ in range(order)][::-1]
        for rest in _residual(bits, size, order):
            values.append(rest + (sum(map(int.__mul__, weights, values[-order:])) >> shift))
        out = np.array(values, np.int64)
    else:
        raise media.Damaged("an unknown kind of subframe")
    return out << wasted


def frame(data: bytes, found: Head, stop: int) -> np.ndarray:
    """Samples by channels of the frame whose bits lie before ``stop``, where its check lies."""
    bits = _Bits(data[found.end : stop])
    parts = []
    for c in range(found.channels):
        side = found.layout == SIDE_RIGHT and c == 0 or found.layout in (LEFT_SIDE, MID_SIDE) and c == 1
        parts.append(_subframe(bits, found.size, found.bits + side))
    if len(bits.text) - bits.at > 7:
        raise media.Damaged("a frame that is longer than its samples")
    if found.layout == LEFT_SIDE:
        parts[1] = parts[0] - parts[1]
    elif found.layout == SIDE_RIGHT:
        parts[0] = parts[0] + parts[1]
    elif found.layout == MID_SIDE:
        whole = parts[0] * 2 + (parts[1] & 1)
        parts = [(whole + parts[1]) >> 1, (whole - parts[1]) >> 1]
    return np.stack(parts, 1)


@dataclass
class Decoded:
    """What came of a stream: good blocks of samples by channels, bad stretches, samples and the signature of all samples."""

    blocks: list = field(default_factory=list)
    errors: int = 0
    samples: int = 0
    md5: str = ""


def _next(data: bytes, at: int, bits: int) -> int:
    """Where the next frame header begins whose check is right; the end of the data if there is none."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0:
            return len(data)
        if head(data, at, bits):
            return at
        at += 1


def decode(data: bytes, bits: int, keep: bool = True) -> Decoded:
    """Frames from the first byte on. A frame ends where its check is right and the next header, or the end, begins: a header
    may show up within a frame by chance, and then its check isn't right there."""
    out, digest, at = Decoded(), hashlib.md5(), _next(data, 0, bits)
    out.errors += at > 0
    while at < len(data):
        found, stop, check, seen = head(data, at, bits), at, 0, at
        done = False
        while not done and stop < len(data):
            stop = _next(data, stop + 1, bits)
            check, seen = crc16(data[seen:stop], check), stop
            if not check:
                try:
                    samples = frame(data, found, stop - 2)
                    done = True
                except media.Damaged:
                    pass
        if done:
            digest.update(np.ascontiguousarray(samples).astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (found.bits + 7) // 8].tobytes())
            out.samples += len(samples)
            if keep:
                out.blocks.append(samples)
            at = stop
        else:
            out.errors += 1
            at = _next(data, at + 1, bits)
    out.md5 = digest.hexdigest()
    return out


def _packed(fields: list[tuple[int, int]]) -> str:
    return "".join(format(value & ((1 << n) - 1), f"0{n}b") for value, n in fields if n)


def _coded(x: np.ndarray, depth: int) -> str:
    """One subframe: constant, or the fixed predictor of the least sum, in one Rice part."""
    if (x == x[0]).all():
        return _packed([(0, 8), (int(x[0]), depth)])
    order = min(range(min(5, len(x))), key=lambda n: int(np.abs(np.diff(x, n)).sum()))
    rest = np.diff(x, order)
    folded = (rest << 1) ^ (rest >> 63)
    k = min(range(15), key=lambda n: int((folded >> n).sum()) + len(folded) * (n + 1))
    coded = "".join("0" * (v >> k) + "1" + (format(v & ((1 << k) - 1), f"0{k}b") if k else "") for v in folded.tolist())
    return _packed([(8 + order << 1, 8), *((int(v), depth) for v in x[:order]), (0, 2), (0, 4), (k, 4)]) + coded


def encode(samples: np.ndarray, bits: int, rate: int, block: int = 4096) -> bytes:
    """A stream of samples by channels: head, signature, frames of ``block`` samples."""
    stream = []
    for number, at in enumerate(range(0, len(samples), block)):
        part = samples[at : at + block].astype(np.int64)
        lead = bytes([0xFF, 0xF8, 0x70, (part.shape[1] - 1) << 4]) + (chr(number).encode() if number < 0xD800 else chr(number + 0x800).encode())
        lead += (len(part) - 1).to_bytes(2, "big")
        lead += bytes([crc8(lead)])
        text = "".join(_coded(part[:, c], bits) for c in range(part.shape[1]))
        text += "0" * (-len(text) % 8)
        whole = lead + int(text, 2).to_bytes(len(text) // 8, "big")
        stream.append(whole + crc16(whole).to_bytes(2, "big"))
    told = rate << 44 | (samples.shape[1] - 1) << 41 | (bits - 1) << 36 | len(samples)
    raw = samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (bits + 7) // 8].tobytes()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + told.to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(stream)


def listen(files: DataFrame) -> DataFrame:
    """Of FLAC rows (path, content): (path, frame_errors, expected_samples, decoded_samples, truncated, md5, md5_match, error).
    md5_match is 1 for the signature that the file has, 0 for another one, -1 where it has none. An unreadable head is an
    error; a null content is an empty file."""

    def rows(given):
        f = io.BytesIO(given["content"] or b"")
        row = media.parse(given["path"], f)
        if row["error"] is None and row["format"] == "FLAC":
            got = decode((given["content"] or b"")[row["audio_at"] :], row["bits"], keep=False)
            told = row["audio_md5"]
            match = -1 if not told or not int(told, 16) else int(told == got.md5)
            yield {"path": given["path"], "frame_errors": got.errors, "expected_samples": row["samples"], "decoded_samples": got.samples, "truncated": row["samples"] > got.samples, "md5": got.md5, "md5_match": match}
        else:
            yield {"path": given["path"], "error": row["error"] or "not FLAC"}

    return media._mapped(files.select("path", "content"), "path string, frame_errors int, expected_samples long, decoded_samples long, truncated boolean, md5 string, md5_match int, error string", rows)


def samples(files: DataFrame) -> DataFrame:
    """(path, channel, start, values) of the good frames of FLAC rows (path, content)."""

    def rows(given):
        f = io.BytesIO(given["content"] or b"")
        row = media.parse(given["path"], f)
        if row["error"] is None and row["format"] == "FLAC":
            start = 0
            for block in decode((given["content"] or b"")[row["audio_at"] :], row["bits"]).blocks:
                for c in range(block.shape[1]):
                    yield {"path": given["path"], "channel": c, "start": start, "values": block[:, c].tolist()}
                start += len(block)

    return media._mapped(files.select("path", "content"), "path string, channel int, start long, values array<long>", rows)
