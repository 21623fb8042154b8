"""Headers and samples of audio files. A file is read by ranges: heads, tags and sizes of chunks, never the audio itself,
so a task holds little whatever the size of its files. Parsers raise on damage; probe() turns that into the row's error."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import tracks as fn

SCHEMA = (
    "path string, format string, lossless boolean, sample_rate int, bits int, channels int, samples long, duration_ms long, audio_at long, audio_bytes long, audio_md5 string,"
    " tags map<string,string>, pictures int, picture_bytes int, picture_w int, picture_h int, error string"
)
#: Fixed values of the formats.
WAVPACK_RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)
MP3_RATES = (44100, 48000, 32000)
MP3_KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
FIELDS = {
    "TITLE": "TITLE TIT2 TT2 INAM NAME", "ARTIST": "ARTIST TPE1 TP1 IART AUTH", "ALBUM": "ALBUM TALB TAL IPRD", "ALBUMARTIST": "ALBUMARTIST BAND TPE2 TP2", "TRACK": "TRACK TRACKNUMBER TRCK TRK ITRK",
    "DISC": "DISC DISCNUMBER TPOS TPA", "DATE": "DATE YEAR ORIGINALDATE TDRC TYER TYE ICRD", "GENRE": "GENRE TCON TCO IGNR", "COMPILATION": "COMPILATION TCMP TCP",
    "TRACKTOTAL": "TRACKTOTAL TOTALTRACKS", "DISCTOTAL": "DISCTOTAL TOTALDISCS",
}
FIELD_OF = {name: field for field, listed in FIELDS.items() for name in listed.split()}
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "gif"]
LARGEST_TAG = 64 << 20


class Damaged(ValueError):
    pass


def normalise(pairs) -> dict[str, str]:
    """Known fields of (name, value) pairs: names without case, an underscore being a space; the first value that isn't blank
    wins, for a compilation any that says so."""
    out: dict[str, str] = {}
    for name, value in pairs:
        name, value = name.upper().replace("_", " ").strip(), value.strip(" \t\r\n\0")
        field = FIELD_OF.get("ALBUMARTIST" if name == "ALBUM ARTIST" else name)
        if not field or not value:
            continue
        if field == "COMPILATION":
            value = "1" if value == "1" or value.lower() == "true" else "0"
            out[field] = max(out.get(field, "0"), value)
        out.setdefault(field, value)
    return out


def normalised(files: DataFrame) -> DataFrame:
    """The same for rows (path, tags: array of name and value in their order), as columns: (path, title, artist, album, album_artist,
    track, track_total, disc, disc_total, date, genre, compilation). A total beside a number counts like a field of its own.
    Files without a known field that isn't blank have no row. A file's tags are one row, so nothing is sorted or sent for them."""
    known = F.create_map(*[F.lit(x) for pair in {**FIELD_OF, "ALBUM ARTIST": "ALBUMARTIST"}.items() for x in pair])
    cleaned = F.transform("tags", lambda t: F.struct(known[F.trim(F.replace(F.upper(t["name"]), F.lit("_"), F.lit(" ")))].alias("field"), F.btrim(t["value"], F.lit(" \t\n\x0b\f\r\0")).alias("value")))
    kept = F.filter(cleaned, lambda t: t["field"].isNotNull() & (t["value"] != ""))
    # As a generator, since a filter on the array would be worked out beside it once more.
    rows = files.select("path", F.explode(F.filter(F.array(kept), lambda k: F.size(k) > 0)).alias("kept"))
    of = lambda *fields: F.filter("kept", lambda t: t["field"].isin(*fields))
    first = lambda field: F.get(of(field), F.lit(0))["value"]
    positive = lambda numbers: F.coalesce(F.get(F.filter(numbers, lambda n: n > 0), F.lit(0)), F.lit(0))
    number, total = (lambda t: fn.number_pair(t["value"])[0]), (lambda t: fn.number_pair(t["value"])[1])
    plain = {n.lower().replace("albumartist", "album_artist"): first(n) for n in ("TITLE", "ARTIST", "ALBUM", "ALBUMARTIST", "DATE", "GENRE")}
    sums = {}
    for name in ("TRACK", "DISC"):
        sums[name.lower()] = positive(F.transform(of(name), number))
        sums[f"{name.lower()}_total"] = positive(F.transform(of(name, f"{name}TOTAL"), lambda t: F.when(t["field"] == name, total(t)).otherwise(number(t))))  # noqa: B023
    both = F.exists("kept", lambda t: (t["field"] == "COMPILATION") & F.lower(t["value"]).isin("1", "true"))
    return rows.select("path", *[c.alias(n) for n, c in {**plain, **sums}.items()], both.alias("compilation"))


class _File:
    def __init__(self, f):
        self.f = f
        self.size = f.seek(0, 2)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size or n > LARGEST_TAG:
            raise Damaged(f"{n} bytes at {at} of {self.size}")
        self.f.seek(at)
        return self.f.read(n)

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.read(at, struct.calcsize(form)))


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) of a PNG or JPEG, (0, 0) for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return 0, 0
        kind = data[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def _pictures(found: list[bytes]) -> dict:
    """The biggest picture counts, the first one of equals."""
    if not found:
        return {"pictures": 0, "picture_bytes": 0, "picture_w": 0, "picture_h": 0}
    biggest = max(found, key=len)
    w, h = image_size(biggest)
    return {"pictures": len(found), "picture_bytes": len(biggest), "picture_w": w, "picture_h": h}


def _comments(data: bytes) -> list[tuple[str, str]]:
    at = 4 + int.from_bytes(data[:4], "little")
    out, count = [], int.from_bytes(data[at : at + 4], "little")
    at += 4
    for _ in range(count):
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data) or at + 4 > len(data):
            break
        name, _, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        out.append((name, value))
        at += 4 + n
    return out


def flac(f: _File) -> dict:
    at = _id3_end(f)
    if f.read(at, 4) != b"fLaC":
        raise Damaged("no fLaC mark")
    at, row, tags, art, last = at + 4, {}, [], [], False
    while not last:
        (head,) = f.unpack(">I", at)
        last, kind, n = bool(head >> 31), head >> 24 & 127, head & 0xFFFFFF
        if kind == 0:
            info = f.read(at + 4, 34)
            packed = int.from_bytes(info[10:18], "big")
            md5 = info[18:34]
            row = {"sample_rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "audio_md5": md5.hex() if any(md5) else None}
        elif kind == 4:
            tags += _comments(f.read(at + 4, n))
        elif kind == 6:
            art.append(_flac_picture(f.read(at + 4, n)))
        at += 4 + n
    if not row:
        raise Damaged("no stream information")
    return {"format": "FLAC", "lossless": True, **row, "tags": normalise(tags), "audio_at": at, "audio_bytes": f.size - at, **_pictures(art)}


def _flac_picture(data: bytes) -> bytes:
    at = 4
    for skip in (0, 16):  # media type, then description and four numbers
        at += 4 + int.from_bytes(data[at : at + 4], "big") + skip
    return data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "big")]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3_end(f: _File, at: int = 0) -> int:
    """Where the ID3v2 tags at the start end."""
    while f.size >= at + 10 and (head := f.read(at, 10))[:3] == b"ID3" and max(head[6:10]) < 128:
        at += 10 + _syncsafe(head[6:10]) + (10 if head[5] & 16 else 0)
    return at


def _text(data: bytes) -> str:
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return data[1:].decode(kinds[data[0]], "replace") if data and data[0] in kinds else ""


def _cut(data: bytes, kind: int) -> tuple[bytes, bytes]:
    """What stands before and after the zero that ends a text of the encoding."""
    width = 2 if kind in (1, 2) else 1
    for at in range(0, len(data) - width + 1, width):
        if not any(data[at : at + width]):
            return data[:at], data[at + width :]
    return data, b""


def id3(f: _File, at: int = 0) -> tuple[list[tuple[str, str]], list[bytes]]:
    """Fields and pictures of one ID3v2.2, 2.3 or 2.4 tag; compressed and encrypted frames are skipped."""
    head = f.read(at, 10)
    version, flags = head[3], head[5]
    data = f.read(at + 10, min(_syncsafe(head[6:10]), f.size - at - 10))
    if flags & 128 and version < 4:
        data = data.replace(b"\xff\x00", b"\xff")
    pos, width = 0, 3 if version == 2 else 4
    if flags & 64 and version > 2:
        pos = _syncsafe(data[:4]) if version == 4 else 4 + int.from_bytes(data[:4], "big")
    tags, art, head_size = [], [], 6 if version == 2 else 10
    while pos + head_size <= len(data) and data[pos]:
        name, raw = data[pos : pos + width].decode("latin-1"), data[pos + width : pos + 2 * width]
        n = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        frame_flags = int.from_bytes(data[pos + 8 : pos + 10], "big") if version > 2 else 0
        body = data[pos + head_size : pos + head_size + n]
        pos += head_size + n
        opaque = frame_flags & (0x0C if version == 4 else 0xC0)
        if len(body) < n or not body or opaque:
            continue
        if version == 4 and frame_flags & 1:
            body = body[4:]
        if version == 4 and (frame_flags & 2 or flags & 128):
            body = body.replace(b"\xff\x00", b"\xff")
        if name in ("TXXX", "TXX"):
            key, value = _cut(body[1:], body[0])
            tags.append((_text(body[:1] + key), _text(body[:1] + value)))
        elif name[0] == "T":
            tags.append((name, _text(body).split("\0")[0]))
        elif name == "APIC":
            _, rest = _cut(body[1:], 0)
            art.append(_cut(rest[1:], body[0])[1])
        elif name == "PIC":
            art.append(_cut(body[5:], body[0])[1])
    return tags, art


def ape_tag(f: _File, end: int | None = None) -> tuple[list[tuple[str, str]], list[bytes]]:
    """Items of the APEv2 tag that ends at ``end``, none if there is no tag."""
    end = f.size if end is None else end
    if end < 32 or f.read(end - 32, 8) != b"APETAGEX":
        return [], []
    _, size, count, _ = f.unpack("<IIII", end - 24)
    if not 32 <= size <= end:
        return [], []
    data, at, tags, art = f.read(end - size, size - 32), 0, [], []
    for _ in range(count):
        if at + 8 > len(data):
            break
        n, flags = struct.unpack("<II", data[at : at + 8])
        key, rest = _cut(data[at + 8 :], 0)
        value = rest[:n]
        at += 8 + len(key) + 1 + n
        if flags >> 1 & 3 == 1:
            if key.lower().startswith(b"cover art"):
                art.append(_cut(value, 0)[1])
        elif flags >> 1 & 3 == 0:
            tags.append((key.decode("latin-1"), value.decode("utf-8", "replace").split("\0")[0]))
    return tags, art


def _id3v1(f: _File) -> list[tuple[str, str]]:
    if f.size < 128 or (tag := f.read(f.size - 128, 128))[:3] != b"TAG":
        return []
    fields = [("TITLE", tag[3:33]), ("ARTIST", tag[33:63]), ("ALBUM", tag[63:93]), ("DATE", tag[93:97])]
    return [(k, v.split(b"\0")[0].decode("latin-1")) for k, v in fields] + ([("TRACK", str(tag[126]))] if not tag[125] and tag[126] else [])


def _mp3_frame(head: bytes) -> dict | None:
    """What four bytes say if they are a frame's header."""
    if len(head) < 4 or head[0] != 255 or head[1] < 224:
        return None
    kind, layer, rate, kbps = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 2 & 3, head[2] >> 4
    if kind == 1 or layer == 4 or rate == 3 or not 0 < kbps < 15:
        return None
    older = kind != 3
    hertz = MP3_RATES[rate] >> {3: 0, 2: 1, 0: 2}[kind]
    bitrate = MP3_KBPS[2 if older else 1, layer][kbps - 1] * 1000
    samples = 384 if layer == 1 else 576 if layer == 3 and older else 1152
    pad = head[2] >> 1 & 1
    size = (12 * bitrate // hertz + pad) * 4 if layer == 1 else samples // 8 * bitrate // hertz + pad
    mono = head[3] >> 6 == 3
    return {"rate": hertz, "bitrate": bitrate, "samples": samples, "size": size, "channels": 1 if mono else 2, "side": (9 if mono else 17) if older else 17 if mono else 32}


def mp3(f: _File) -> dict:
    start, tags, art, at = _id3_end(f), [], [], 0
    while at < start:
        more, pics = id3(f, at)
        tags, art, at = tags + more, art + pics, _id3_end_one(f, at)
    v1 = _id3v1(f)
    end = f.size - (128 if v1 else 0)
    more, pics = ape_tag(f, end)
    tags, art = tags + more + v1, art + pics
    frame, at = _first_frame(f, start, end)
    if frame is None:
        raise Damaged("no frame")
    mark = at + 4 + frame["side"]
    count, head = None, f.read(at, min(frame["size"], f.size - at))
    inside = head[mark - at :]
    if inside[:4] in (b"Xing", b"Info") and len(inside) >= 12 and inside[7] & 1:
        count = int.from_bytes(inside[8:12], "big")
    elif head[36:40] == b"VBRI":
        count = int.from_bytes(head[50:54], "big")
    samples = count * frame["samples"] if count else (end - at) * 8 * frame["rate"] // frame["bitrate"]
    return {"format": "MP3", "lossless": False, "sample_rate": frame["rate"], "bits": 0, "channels": frame["channels"], "samples": samples, "tags": normalise(tags), "audio_at": at, "audio_bytes": end - at, **_pictures(art)}


def _id3_end_one(f: _File, at: int) -> int:
    head = f.read(at, 10)
    return at + 10 + _syncsafe(head[6:10]) + (10 if head[5] & 16 else 0)


def _first_frame(f: _File, start: int, end: int) -> tuple[dict | None, int]:
    """The first frame that another one follows, in the first megabyte."""
    data = f.read(start, min(1 << 20, max(0, end - start)))
    at = data.find(b"\xff")
    while 0 <= at < len(data) - 3:
        frame = _mp3_frame(data[at : at + 4])
        if frame and (start + at + frame["size"] == end or _mp3_frame(data[at + frame["size"] : at + frame["size"] + 4])):
            return frame, start + at
        at = data.find(b"\xff", at + 1)
    return None, 0


def _chunks(f: _File, at: int, end: int, order: str, wide: bool = False, sizes: dict | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of chunks; the last one may be cut short."""
    form, head = (f"{order}Q", 12) if wide else (f"{order}I", 8)
    while at + head <= end:
        name, (n,) = f.read(at, 4), f.unpack(form, at + 4)
        n = (sizes or {}).get(name, n) if n == 0xFFFFFFFF and not wide else n
        yield name, at + head, min(n, end - at - head)
        at += head + n + n % 2


def _extended(data: bytes) -> float:
    """An 80-bit number."""
    power, whole = int.from_bytes(data[:2], "big"), int.from_bytes(data[2:10], "big")
    return (-1.0 if power >> 15 else 1.0) * whole * 2.0 ** ((power & 0x7FFF) - 16383 - 63)


def wav(f: _File) -> dict:
    if f.read(0, 4) not in (b"RIFF", b"RF64") or f.read(8, 4) != b"WAVE":
        raise Damaged("no RIFF WAVE mark")
    row, tags, sizes, code = {"format": "WAV", "lossless": True}, [], {}, 1
    for name, at, n in _chunks(f, 12, f.size, "<", sizes=sizes):
        if name == b"ds64":
            sizes[b"data"] = f.unpack("<Q", at + 8)[0]
        elif name == b"fmt ":
            code, channels, rate, _, block, bits = f.unpack("<HHIIHH", at)
            code = f.unpack("<H", at + 24)[0] if code == 0xFFFE and n >= 26 else code
            row |= {"channels": channels, "sample_rate": rate, "bits": bits, "_block": block, "_float": code == 3}
        elif name == b"data":
            row |= {"audio_at": at, "audio_bytes": n}
        elif name == b"LIST" and n >= 4 and f.read(at, 4) == b"INFO":
            tags += [(k.decode("latin-1"), f.read(a, m).split(b"\0")[0].decode("utf-8", "replace")) for k, a, m in _chunks(f, at + 4, at + n, "<")]
    if "channels" not in row or "audio_at" not in row or not row["_block"]:
        raise Damaged("no format or data")
    return row | {"samples": row["audio_bytes"] // row["_block"], "tags": normalise(tags), "_order": "<", **_pictures([])}


def aiff(f: _File) -> dict:
    if f.read(0, 4) != b"FORM" or f.read(8, 4) not in (b"AIFF", b"AIFC"):
        raise Damaged("no FORM AIFF mark")
    row, tags, order, floats = {"format": "AIFF", "lossless": True}, [], ">", False
    for name, at, n in _chunks(f, 12, f.size, ">"):
        if name == b"COMM":
            channels, frames, bits = f.unpack(">hIh", at)
            kind = f.read(at + 18, 4) if n >= 22 else b"NONE"
            order, floats = "<" if kind == b"sowt" else ">", kind.lower() in (b"fl32", b"fl64")
            row |= {"channels": channels, "samples": frames, "bits": bits, "sample_rate": int(_extended(f.read(at + 8, 10)))}
        elif name == b"SSND":
            row |= {"audio_at": at + 8 + f.unpack(">I", at)[0], "audio_bytes": n - 8}
        elif name in (b"NAME", b"AUTH"):
            tags.append((name.decode(), f.read(at, n).decode("utf-8", "replace")))
    if "channels" not in row:
        raise Damaged("no common chunk")
    return row | {"tags": normalise(tags), "_order": order, "_float": floats, "_block": row["channels"] * ((row["bits"] + 7) // 8), **_pictures([])}


def dsf(f: _File) -> dict:
    if f.read(0, 4) != b"DSD " or f.read(28, 4) != b"fmt ":
        raise Damaged("no DSD mark")
    (meta,) = f.unpack("<Q", 20)
    channels, rate, bits, samples = f.unpack("<IIIQ", 52)
    tags, art = id3(f, meta) if 0 < meta < f.size - 10 and f.read(meta, 3) == b"ID3" else ([], [])
    return {"format": "DSF", "lossless": True, "channels": channels, "sample_rate": rate, "bits": 1, "samples": samples, "tags": normalise(tags), **_pictures(art)}


def dff(f: _File) -> dict:
    if f.read(0, 4) != b"FRM8" or f.read(12, 4) != b"DSD ":
        raise Damaged("no FRM8 mark")
    row = {"format": "DFF", "lossless": True, "bits": 1, "channels": 0, "sample_rate": 0, "tags": {}}
    for name, at, n in _chunks(f, 16, f.size, ">", True):
        if name == b"PROP":
            for inner, a, _ in _chunks(f, at + 4, at + n, ">", True):
                if inner == b"FS  ":
                    row["sample_rate"] = f.unpack(">I", a)[0]
                elif inner == b"CHNL":
                    row["channels"] = f.unpack(">H", a)[0]
        elif name == b"DSD ":
            row |= {"audio_at": at, "audio_bytes": n}
    if not row["channels"] or "audio_at" not in row:
        raise Damaged("no properties or data")
    return row | {"samples": row["audio_bytes"] * 8 // row["channels"], **_pictures([])}


def monkey(f: _File) -> dict:
    start = _id3_end(f)
    mark, version = f.unpack("<4sH", start)
    if mark != b"MAC " or version < 3980:
        raise Damaged("not a file of version 3.98 or later")
    (skip,) = f.unpack("<I", start + 8)
    a_frame, last, frames, bits, channels, rate = f.unpack("<IIIHHI", start + skip + 4)
    tags, art = ape_tag(f, f.size - (128 if _id3v1(f) else 0))
    return {"format": "APE", "lossless": True, "sample_rate": rate, "bits": bits, "channels": channels, "samples": max(0, frames - 1) * a_frame + last if frames else 0, "tags": normalise(tags), **_pictures(art)}


def wavpack(f: _File) -> dict:
    mark, _, _, _, samples, _, _, flags = f.unpack("<4sIHHIIII", 0)
    if mark != b"wvpk":
        raise Damaged("no wvpk mark")
    at, hybrid = flags >> 23 & 15, bool(flags & 8)
    tags, art = ape_tag(f, f.size - (128 if _id3v1(f) else 0))
    bits = 0 if hybrid else ((flags & 3) + 1) * 8 - (flags >> 13 & 31)
    return {"format": "WV", "lossless": not hybrid, "sample_rate": WAVPACK_RATES[at] if at < len(WAVPACK_RATES) else 0, "bits": bits, "channels": 1 if flags & 4 else 2, "samples": 0 if samples == 0xFFFFFFFF else samples, "tags": normalise(tags), **_pictures(art)}


PARSERS = {"flac": flac, "mp3": mp3, "wav": wav, "aif": aiff, "aiff": aiff, "aifc": aiff, "dsf": dsf, "dff": dff, "ape": monkey, "wv": wavpack}


def parse(path: str, f) -> dict:
    """The row of SCHEMA for an open file; damage and formats without a parser become its error."""
    row = {"path": path, "format": path.rsplit(".", 1)[-1].upper(), "error": None}
    try:
        parser = PARSERS.get(path.rsplit(".", 1)[-1].lower())
        if parser is None:
            return row | {"error": "no parser"}
        row |= parser(_File(f))
        row["duration_ms"] = row["samples"] * 1000 // row["sample_rate"] if row["sample_rate"] else 0
    except (Damaged, struct.error, IndexError, KeyError, OSError) as e:
        row["error"] = str(e) or type(e).__name__
    return row


def pcm(row: dict, f) -> Iterator[np.ndarray]:
    """Blocks of (samples, channels) as 64-bit integers: 8-bit WAV is centred, floats are scaled to 24 bits and clamped."""
    file, width, channels = _File(f), (row["bits"] + 7) // 8, row["channels"]
    if not 1 <= channels <= 8 or width not in (1, 2, 3, 4, 8):
        raise Damaged("not a depth or number of channels that is read")
    whole = min(row["audio_bytes"], file.size - row["audio_at"]) // (width * channels) * width * channels
    step = 65_536 * width * channels
    for at in range(0, whole, step):
        raw = np.frombuffer(file.read(row["audio_at"] + at, min(step, whole - at)), np.uint8)
        if row["_float"]:
            values = raw.view(f"{row['_order']}f{width}").astype(np.float64)
            out = np.clip(np.rint(np.nan_to_num(values) * (1 << 23)), -(1 << 23), (1 << 23) - 1).astype(np.int64)
        elif width == 1:
            out = raw.astype(np.int64) - 128 if row["format"] == "WAV" else raw.view(np.int8).astype(np.int64)
        else:
            each = raw.reshape(-1, width)[:, :: 1 if row["_order"] == "<" else -1].astype(np.int64)
            out = (each << (8 * np.arange(width))).sum(axis=1)
            out -= (out >> (8 * width - 1)) << (8 * width)
        yield out.reshape(-1, channels)


def crc(data: bytes, bits: int, polynomial: int) -> int:
    """A checksum of most significant bits first, from 0: 8 bits with 0x07, 16 bits with 0x8005."""
    value, top, mask = 0, 1 << (bits - 1), (1 << bits) - 1
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value & top else 0)) & mask
    return value


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(given):
        for batch in given:
            for at in range(0, batch.num_rows, 64):
                listed = [r for given_row in batch.slice(at, 64).to_pylist() for r in rows(given_row)]
                cols = [[r.get(x.name) for r in listed] for x in arrow]
                cols = [[None if v is None else list(v.items()) for v in c] if pa.types.is_map(x.type) else c for c, x in zip(cols, arrow)]
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the audio files below a root, without what lies under names that start with a dot or in the
    root's own folder Android. The content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    audio = F.lower(F.regexp_extract("path", r"[^.]+$", 0)).isin(fn.EXTENSIONS)
    system = F.regexp_replace("path", "^file:/+", "/").startswith(re.sub("^file:/+", "/", root).rstrip("/") + "/Android/")
    return files.where(audio & ~system & ~F.col("path").rlike(r"/\.[^/]")).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def probe(files: DataFrame) -> DataFrame:
    """SCHEMA for each path, read by ranges through pyarrow. A file that can't be opened has an error."""

    def rows(given):
        from pyarrow import fs

        try:
            system, at = fs.FileSystem.from_uri(given["path"])
            with system.open_input_file(at) as f:
                yield parse(given["path"], f)
        except (OSError, ValueError) as e:
            yield {"path": given["path"], "error": str(e)}

    return _mapped(files.select("path"), SCHEMA, rows)


def probe_content(files: DataFrame) -> DataFrame:
    """SCHEMA for rows (path, content), for files that are held as columns."""
    return _mapped(files.select("path", "content"), SCHEMA, lambda r: [parse(r["path"], io.BytesIO(r["content"] or b""))])


def samples(files: DataFrame) -> DataFrame:
    """(path, channel, start, values) of WAV and AIFF rows (path, content), in blocks of 65,536 samples at most."""

    def rows(given):
        f = io.BytesIO(given["content"] or b"")
        row = parse(given["path"], f)
        if row["error"] is None and row["format"] in ("WAV", "AIFF"):
            start = 0
            for block in pcm(row, f):
                for c in range(block.shape[1]):
                    yield {"path": given["path"], "channel": c, "start": start, "values": block[:, c].tolist()}
                start += len(block)

    return _mapped(files.select("path", "content"), "path string, channel int, start long, values array<long>", rows)


def stored_md5(files: DataFrame) -> DataFrame:
    """(path, md5) of the interleaved samples as little-endian integers of their stored width."""
    import hashlib

    def rows(given):
        f = io.BytesIO(given["content"] or b"")
        row = parse(given["path"], f)
        if row["error"] is None and row["format"] in ("WAV", "AIFF"):
            digest, width = hashlib.md5(), 3 if row["_float"] else (row["bits"] + 7) // 8
            for block in pcm(row, f):
                digest.update(block.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes())
            yield {"path": given["path"], "md5": digest.hexdigest()}

    return _mapped(files.select("path", "content"), "path string, md5 string", rows)


def covers(files: DataFrame) -> DataFrame:
    """(folder, cover) of each folder of (path) with audio files of its own: of its images the last by name whose name begins
    like a cover's, else the first one, else null. Names that start with a dot don't count."""
    name, ending = F.substring_index("path", "/", -1), fn.extension()
    image = ending.isin(IMAGES)
    called = image & F.lower(name).rlike("^(cover|folder|front|album)")
    seen = files.where(~name.startswith(".")).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    each = seen.agg(F.max(ending.isin(fn.EXTENSIONS)).alias("audio"), F.coalesce(F.max(F.when(called, name)), F.min(F.when(image, name))).alias("cover"))
    return each.where("audio").select("folder", "cover")
