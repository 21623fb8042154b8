"""Media columns in Matroska: a writer for 8-bit sound and a parser into packet tables.

The parser reads variable-length EBML elements, segments, clusters, simple blocks and block groups, all four kinds of
lacing, and cues. It gives one row for each frame: track, time, and the range of bytes that it has in the file.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

# Fixed values of the Matroska and EBML formats: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, FLAG_LACING, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples a second, samples a frame (64 ms), frames a laced block and blocks a cluster of what is written here.
RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 16
#: Bytes that payloads are padded to a multiple of.
UNIT = 64


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def _size(value: int, width: int = 0) -> bytes:
    """A data size in the fewest bytes, or in ``width``; all ones are kept for the unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def _element(number: int, data: bytes) -> bytes:
    return _id(number) + _size(len(data)) + data


def _uint(number: int, value: int) -> bytes:
    return _element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _double(number: int, value: float) -> bytes:
    return _element(number, np.array([value], ">f8").tobytes())


def lace(frames: list[bytes], kind: int) -> bytes:
    """What follows a block's flags: the number of frames and their sizes in the manner of ``kind``, then the frames."""
    if kind == NO_LACING:
        assert len(frames) == 1
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == FIXED:
        assert len(set(sizes)) == 1
    elif len(sizes) > 1:
        head += _size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            difference = n - before
            width = next(w for w in range(1, 9) if abs(difference) < (1 << 7 * w - 1) - 1)
            head += _size(difference + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(number: int, frames: list[bytes], relative: int, kind: int, track: int = 1, key: bool = True) -> bytes:
    flags = (0x80 if key and number == SIMPLE_BLOCK else 0) | kind << 1
    return _element(number, _size(track) + relative.to_bytes(2, "big", signed=True) + bytes([flags]) + lace(frames, kind))


def write(payload: bytes) -> bytes:
    """One file with one track of unsigned 8-bit samples that are the payload's bytes. Whole blocks have fixed-size
    lacing, a last block with a shorter frame has EBML lacing, and a single frame none; each cluster has a cue."""
    head = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    app = b"lodestone"
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _double(DURATION, len(payload) * 1000 / RATE) + _element(MUXING_APP, app) + _element(WRITING_APP, app))
    sound = _element(AUDIO, _double(SAMPLING_FREQUENCY, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1)
    entry += _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + sound
    parts = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    for start in range(0, len(payload), FRAME * LACE * BLOCKS):
        stop = min(len(payload), start + FRAME * LACE * BLOCKS)
        made = [_uint(TIMESTAMP, start * 1000 // RATE)]
        for i in range(start, stop, FRAME * LACE):
            frames = [payload[k : k + FRAME] for k in range(i, min(stop, i + FRAME * LACE), FRAME)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            made.append(block(SIMPLE_BLOCK, frames, (i - start) * 1000 // RATE, kind))
        parts.append(_element(CLUSTER, b"".join(made)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start * 1000 // RATE) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


class Malformed(ValueError):
    """The bytes break a rule of the format."""


@dataclass
class Media:
    """tracks: number -> type, codec, rate, channels, bits, default duration in ns. packets: (track, time in ns, first
    byte, length, key frame). cues: (time in ns, track, first byte of the cluster)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _vint(data: bytes, at: int, end: int, marked: bool = False) -> tuple[int, int, int]:
    """(value, position after it, width); with ``marked`` the length marker stays, as in element ids."""
    if at >= end or not data[at]:
        raise Malformed(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end or marked and width > 4:
        raise Malformed(f"a number is cut short at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return value if marked else value & (1 << 7 * width) - 1, at + width, width


def elements(data: bytes, at: int, end: int):
    """(id, first byte of the element, first byte of its data, end) of each element; an unknown size reaches to the
    parent's end, and whoever walks a cluster of unknown size stops at the next element of the segment's level."""
    while at < end:
        start = at
        number, at, _ = _vint(data, at, end, True)
        size, at, width = _vint(data, at, end)
        stop = end if size == (1 << 7 * width) - 1 else at + size
        if stop > end:
            raise Malformed(f"element {number:X} at byte {start} is cut short")
        yield number, start, at, stop
        at = stop


def _number(data: bytes, at: int, stop: int) -> int:
    return int.from_bytes(data[at:stop], "big")


def _real(data: bytes, at: int, stop: int) -> float:
    if stop == at:
        return 0.0
    if stop - at not in (4, 8):
        raise Malformed(f"a float of {stop - at} bytes")
    return float(np.frombuffer(data[at:stop], ">f4" if stop - at == 4 else ">f8")[0])


def frames(data: bytes, at: int, stop: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of the frames) of a block's data."""
    track, at, _ = _vint(data, at, stop)
    if at + 3 > stop:
        raise Malformed("a block is cut short")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at, kind = at + 3, flags >> 1 & 3
    if kind == NO_LACING:
        return track, relative, flags, [(at, stop - at)]
    if at >= stop:
        raise Malformed("a laced block has no number of frames")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == XIPH:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= stop:
                    raise Malformed("a lace is cut short")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif kind == EBML_LACING and count > 1:
        size, at, _ = _vint(data, at, stop)
        sizes.append(size)
        for _ in range(count - 2):
            step, at, width = _vint(data, at, stop)
            size += step - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    elif kind == FIXED:
        if (stop - at) % count:
            raise Malformed("frames of a fixed-size lace differ")
        sizes = [(stop - at) // count] * (count - 1)
    rest = stop - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Malformed("a lace is longer than its block")
    out = []
    for size in [*sizes, rest]:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def parse(data: bytes) -> Media:
    """The tables of a whole file. Raises Malformed where the bytes break the format; elements it doesn't know are
    skipped."""
    media, base, waiting = Media(), [0], []

    def packet(at: int, stop: int, time: int, key: bool | None) -> None:
        track, relative, flags, ranges = frames(data, at, stop)
        each = media.tracks.get(track, {}).get("frame_ns", 0)
        first = (time + relative) * media.scale
        for i, (start, length) in enumerate(ranges):
            media.packets.append((track, first + i * each, start, length, bool(flags & 0x80) if key is None else key))

    def cluster(at: int, stop: int) -> int:
        time = 0
        for number, start, at, end in elements(data, at, stop):
            if number in TOP:
                return start
            if number == TIMESTAMP:
                time = _number(data, at, end)
            elif number == SIMPLE_BLOCK:
                packet(at, end, time, None)
            elif number == BLOCK_GROUP:
                inner = [x for x in elements(data, at, end)]
                for kind, _, a, b in inner:
                    if kind == BLOCK:
                        packet(a, b, time, not any(x[0] == 0xFB for x in inner))
        return stop

    def entry(at: int, stop: int) -> None:
        got = {"type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "frame_ns": 0}
        track = 0
        for number, _, a, b in elements(data, at, stop):
            if number == TRACK_NUMBER:
                track = _number(data, a, b)
            elif number == TRACK_TYPE:
                got["type"] = _number(data, a, b)
            elif number == CODEC_ID:
                got["codec"] = data[a:b].decode("ascii", "replace").rstrip("\0")
            elif number == DEFAULT_DURATION:
                got["frame_ns"] = _number(data, a, b)
            elif number == AUDIO:
                for kind, _, c, d in elements(data, a, b):
                    if kind == SAMPLING_FREQUENCY:
                        got["rate"] = _real(data, c, d)
                    elif kind in (CHANNELS, BIT_DEPTH):
                        got["channels" if kind == CHANNELS else "bits"] = _number(data, c, d)
        media.tracks[track] = got

    def segment(at: int, stop: int) -> None:
        base[0] = at
        while at < stop:
            number, start, a, b = next(elements(data, at, stop))
            at = b
            if number == INFO:
                for kind, _, c, d in elements(data, a, b):
                    if kind == TIMESTAMP_SCALE:
                        media.scale = _number(data, c, d)
                    elif kind == DURATION:
                        media.duration = _real(data, c, d)
            elif number == TRACKS:
                for kind, _, c, d in elements(data, a, b):
                    if kind == TRACK_ENTRY:
                        entry(c, d)
            elif number == CLUSTER:
                media.clusters.append(start)
                at = cluster(a, b)
            elif number == CUES:
                for kind, _, c, d in elements(data, a, b):
                    if kind == CUE_POINT:
                        waiting.append((c, d))

    kinds = []
    for number, _, at, stop in elements(data, 0, len(data)):
        kinds.append(number)
        if number == SEGMENT:
            segment(at, stop)
    if kinds[:1] != [EBML] or SEGMENT not in kinds:
        raise Malformed("no Matroska file")
    for at, stop in waiting:
        time, places = 0, []
        for number, _, a, b in elements(data, at, stop):
            if number == CUE_TIME:
                time = _number(data, a, b)
            elif number == CUE_TRACK_POSITIONS:
                got = {kind: _number(data, c, d) for kind, _, c, d in elements(data, a, b)}
                places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))
        media.cues += [(time * media.scale, track, base[0] + place) for track, place in places]
    return media


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[at : at + size] for t, _, at, size, _ in media.packets if t == track)


def feature(media: Media, sound: bytes) -> str:
    """Packets, clusters, cues that point to a cluster, milliseconds, and of the samples the mean, the root mean square
    about it and the share of neighbours on different sides of 128."""
    x = np.frombuffer(sound, np.uint8)
    mean = float(x.mean(dtype=np.float64)) if len(x) else 0.0
    spread = float(np.sqrt(max(0.0, float((x.astype(np.float32) ** 2).mean(dtype=np.float64)) - mean * mean))) if len(x) else 0.0
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))) if len(x) else 0
    clusters = set(media.clusters)
    good = sum(place in clusters for _, _, place in media.cues)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={good};ms={media.duration:.0f};mean={mean:.3f};rms={spread:.3f};turns={turns / max(1, len(x) - 1):.4f}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these with zeros up to a positive multiple of UNIT)."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % UNIT or (UNIT if not data else 0))


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the file of each whole text. A null text is an empty one, whose payload is 64 zeros;
    repeated rows give repeated rows; a null key stays; other columns aren't carried."""

    def make():
        def each(k, value):
            size, payload = payload_of(value)
            yield k, size, write(payload)

        return each

    return map_rows(df, [key, text], f"`{key}` {_kind(df, key)}, n_bytes long, media binary", make)


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, packet, track, time_ns, first_byte, length, key_frame, error): a row for each frame of each file. A file
    that breaks the format has one row with its error and nulls; a null file has no row."""

    def make():
        def each(k, data):
            if data is None:
                return
            try:
                for i, (track, time, at, size, is_key) in enumerate(parse(data).packets):
                    yield k, i, track, time, at, size, is_key, None
            except Malformed as e:
                yield k, None, None, None, None, None, None, str(e)

        return each

    return map_rows(df, [key, media], f"`{key}` {_kind(df, key)}, packet long, track long, time_ns long, first_byte long, length long, key_frame boolean, error string", make)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): each text is
    stored, and the rest is computed from the samples that parsing the stored bytes gives back. Cases as in store()."""

    def make():
        def each(k, value):
            size, payload = payload_of(value)
            data = write(payload)
            media = parse(data)
            sound = samples(data, media)
            yield k, size, len(sound), hashlib.sha256(sound).hexdigest(), zlib.crc32(sound[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, sound)

        return each

    return map_rows(df, [key, text], f"`{key}` {_kind(df, key)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)


def _kind(df: DataFrame, key: str) -> str:
    return df.select(key).schema[0].dataType.simpleString()
