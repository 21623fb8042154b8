"""Small files of each format, written from a row's numbers and title by the formats' definitions, to read back."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.media import WAVPACK_RATES


def _chunk(name: bytes, data: bytes, order: str = "<", wide: bool = False) -> bytes:
    return name + struct.pack(f"{order}{'Q' if wide else 'I'}", len(data)) + data + b"\0" * (len(data) % 2)


def safe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def id3_tag(title: str, version: int = 3, picture: bytes = b"") -> bytes:
    text = b"\3" + title.encode() if version == 4 else b"\1" + title.encode("utf-16")
    size = safe if version == 4 else lambda n: n.to_bytes(3 if version == 2 else 4, "big")
    flags = b"" if version == 2 else b"\0\0"
    body = (b"TT2" if version == 2 else b"TIT2") + size(len(text)) + flags + text
    if picture:
        data = b"\0PNG\3\0" + picture if version == 2 else b"\0image/png\0\3\0" + picture
        body += (b"PIC" if version == 2 else b"APIC") + size(len(data)) + flags + data
    body += b"\0" * 16
    return b"ID3" + bytes([version, 0, 0]) + safe(len(body)) + body


def ape_items(title: str) -> bytes:
    value = title.encode()
    item = struct.pack("<II", len(value), 0) + b"Title\0" + value
    tail = struct.pack("<IIII8x", 2000, len(item) + 32, 1, 0)
    return item + b"APETAGEX" + tail


def png(w: int, h: int, size: int = 40) -> bytes:
    return (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)).ljust(size, b"\0")


def jpeg(w: int, h: int) -> bytes:
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", h, w) + b"\0" * 4


def wav(rate, bits, channels, samples, title) -> bytes:
    block = channels * bits // 8
    info = b"INFO" + _chunk(b"INAM", title.encode() + b"\0")
    return _riff(_chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * block, block, bits)) + _chunk(b"LIST", info) + _chunk(b"data", bytes(i % 251 for i in range(samples * block))))


def _riff(body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def aiff(rate, bits, channels, samples, title) -> bytes:
    power = int(math.log2(rate))
    comm = struct.pack(">hIh", channels, samples, bits) + struct.pack(">HQ", 16383 + power, rate << (63 - power))
    body = b"AIFF" + _chunk(b"COMM", comm, ">") + _chunk(b"NAME", title.encode(), ">") + _chunk(b"SSND", bytes(8) + bytes(samples * channels * bits // 8), ">")
    return b"FORM" + struct.pack(">I", len(body)) + body


def flac(rate, bits, channels, samples, title) -> bytes:
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples
    info = bytes(10) + packed.to_bytes(8, "big") + bytes(range(1, 17))
    entries = [b"title=" + title.encode(), b"TITLE=other", b"TrackNumber=3/12"]
    comments = struct.pack("<I", 1) + b"v" + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in entries)
    art = png(600, 500)
    picture = struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I16xI", 0, len(art)) + art
    block = lambda kind, data, last=0: bytes([last << 7 | kind]) + len(data).to_bytes(3, "big") + data
    return b"fLaC" + block(0, info) + block(4, comments) + block(6, picture, 1) + bytes(16)


def dsf(rate, bits, channels, samples, title) -> bytes:
    body = b"fmt " + struct.pack("<QIIIIIIQII", 52, 1, 0, 2, channels, rate, 1, samples, 4096, 0) + b"data" + struct.pack("<Q", 12)
    return b"DSD " + struct.pack("<QQQ", 28, 0, 28 + len(body)) + body + id3_tag(title)


def dff(rate, bits, channels, samples, title) -> bytes:
    prop = b"SND " + _chunk(b"FS  ", struct.pack(">I", rate), ">", True) + _chunk(b"CHNL", struct.pack(">H", channels) + b"SLFTSRGT"[: 4 * channels], ">", True)
    body = b"DSD " + _chunk(b"FVER", bytes(4), ">", True) + _chunk(b"PROP", prop, ">", True) + _chunk(b"DSD ", bytes(samples * channels // 8), ">", True)
    return b"FRM8" + struct.pack(">Q", len(body)) + body


def ape(rate, bits, channels, samples, title) -> bytes:
    a_frame = 1024
    frames = -(-samples // a_frame)
    head = struct.pack("<HHIIIHHI", 2000, 0, a_frame, samples - (frames - 1) * a_frame, frames, bits, channels, rate)
    return b"MAC " + struct.pack("<HHIIIIIII16x", 3990, 0, 52, 24, 0, 0, 0, 0, 0) + head + ape_items(title)


def wv(rate, bits, channels, samples, title) -> bytes:
    flags = bits // 8 - 1 | (channels == 1) << 2 | WAVPACK_RATES.index(rate) << 23
    return b"wvpk" + struct.pack("<IHBBIIIII", 24, 0x410, 0, 0, samples, 0, 0, flags, 0) + ape_items(title)


def mp3(rate, bits, channels, samples, title) -> bytes:
    """Frames of layer III at 128 kbps; the first one tells how many there are."""
    head = bytes([255, 0xFB, 0x90 | (44100, 48000, 32000).index(rate) << 2, 0xC0 if channels == 1 else 0])
    size = 144 * 128_000 // rate
    first = (head + bytes(17 if channels == 1 else 32) + b"Xing" + struct.pack(">II", 1, samples // 1152)).ljust(size, b"\0")
    return id3_tag(title, 4, png(300, 200)) + first + head.ljust(size, b"\0") * 2


MAKERS = {"wav": wav, "aiff": aiff, "flac": flac, "dsf": dsf, "dff": dff, "ape": ape, "wv": wv, "mp3": mp3}


def files(rows: DataFrame, kind: str) -> DataFrame:
    """(path, content) for rows (id, rate, bits, channels, samples, title)."""
    make = F.udf(MAKERS[kind], "binary", useArrow=True)
    return rows.select(F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(f".{kind}")).alias("path"), make("rate", "bits", "channels", "samples", "title").alias("content"))
