"""Parsers against files written by the formats' definitions; damage, samples, images, streaming."""

import hashlib
import io
import struct

import numpy as np
import pytest

from lodestone.sources import flac, made, media
from lodestone.streaming import ingest

NUMBERS = (48000, 24, 2, 2304, "Títle")


def parsed(kind, data):
    return media.parse(f"/a.{kind}", io.BytesIO(data))


@pytest.mark.parametrize("kind", sorted(made.MAKERS))
def test_every_cut_of_a_file_is_an_error_or_a_row(kind):
    data = made.MAKERS[kind](*NUMBERS)
    whole = parsed(kind, data)
    assert whole["error"] is None and whole["sample_rate"] == 48000 and whole["channels"] == 2 and whole["samples"] == 2304
    for n in range(0, min(len(data), 600), 7):
        parsed(kind, data[:n])
    assert parsed(kind, b"")["error"] and parsed(kind, b"\0" * 500)["error"]


@pytest.mark.parametrize("version", [2, 3, 4])
def test_id3_versions(version):
    tags, art = media.id3(media._File(io.BytesIO(made.id3_tag("Ünï", version, made.png(7, 9)))))
    assert media.normalise(tags) == {"TITLE": "Ünï"} and media.image_size(art[0]) == (7, 9)


def test_id3_unsynchronised_and_opaque_frames():
    text = b"\0\xff\x00\xe0x"
    opaque = b"TPE1" + (3).to_bytes(4, "big") + b"\0\x80" + b"\0ab"
    body = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + text + opaque + b"TALB" + (3).to_bytes(4, "big") + b"\0\0" + b"\0hi"
    tags, _ = media.id3(media._File(io.BytesIO(b"ID3\3\0\x80" + made.safe(len(body)) + body)))
    assert media.normalise(tags) == {"TITLE": "ÿàx", "ALBUM": "hi"}


def test_tags_first_value_wins_and_blank_ones_do_not():
    assert media.normalise([("Album_Artist", " "), ("ALBUM ARTIST", "a\0"), ("albumartist", "b"), ("x", "y")]) == {"ALBUMARTIST": "a"}
    assert media.normalise([("compilation", "no"), ("COMPILATION", "True"), ("Band", "b"), ("TotalTracks", "9"), ("track number", "4")]) == {"COMPILATION": "1", "ALBUMARTIST": "b", "TRACKTOTAL": "9"}


def test_image_sizes():
    assert media.image_size(made.png(640, 480)) == (640, 480) and media.image_size(made.jpeg(300, 200)) == (300, 200)
    assert media.image_size(b"") == media.image_size(b"\xff\xd8\xff") == media.image_size(b"GIF89a") == (0, 0)


def test_crc_check_values():
    assert media.crc(b"123456789", 8, 0x07) == 0xF4 and media.crc(b"123456789", 16, 0x8005) == 0xFEE8 and media.crc(b"", 16, 0x8005) == 0


def wav_of(code, bits, channels, data):
    return made._riff(made._chunk(b"fmt ", struct.pack("<HHIIHH", code, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)) + made._chunk(b"data", data))


@pytest.mark.parametrize("bits,kind", [(16, "<i2"), (32, "<i4")])
def test_integer_samples(bits, kind):
    want = np.array([[0, -1], [1, -(1 << (bits - 1))], [(1 << (bits - 1)) - 1, 5]])
    data = wav_of(1, bits, 2, want.astype(kind).tobytes())
    assert np.array_equal(np.concatenate(list(media.pcm(parsed("wav", data), io.BytesIO(data)))), want)


def test_8_bit_24_bit_and_float_samples():
    read = lambda d: np.concatenate(list(media.pcm(parsed("wav", d), io.BytesIO(d))))[:, 0].tolist()
    assert read(wav_of(1, 8, 1, bytes([0, 128, 255]))) == [-128, 0, 127]
    assert read(wav_of(1, 24, 1, b"\xff\xff\xff\x00\x00\x80\xff\xff\x7f")) == [-1, -(1 << 23), (1 << 23) - 1]
    assert read(wav_of(3, 32, 1, np.array([0.5, -2.0, 1.0, np.nan], "<f4").tobytes())) == [1 << 22, -(1 << 23), (1 << 23) - 1, 0]


def test_frames_of_samples_and_their_md5(spark):
    data = np.arange(-100_000, 100_000, dtype="<i4")
    raw = (data & 0xFFFF).astype("<u2").tobytes()
    files = spark.createDataFrame([("/a.wav", bytearray(wav_of(1, 16, 2, raw))), ("/b.wav", bytearray(b"x")), ("/c.wav", None)], "path string, content binary")
    rows = media.samples(files).orderBy("channel", "start").collect()
    assert [r.start for r in rows] == [0, 65536, 0, 65536] and sum(len(r["values"]) for r in rows) == 200_000
    assert [tuple(r) for r in media.stored_md5(files).collect()] == [("/a.wav", hashlib.md5(raw).hexdigest())]


def test_walk_probe_and_covers(spark, tmp_path):
    (tmp_path / "x" / ".hidden").mkdir(parents=True)
    for at, data in (("x/a.flac", made.flac(*NUMBERS)), ("x/b.wav", b"junk"), ("x/.hidden/c.wav", b""), ("x/d.txt", b"")):
        (tmp_path / at).write_bytes(data)
    found = media.walk(spark, str(tmp_path))
    assert sorted(p.path.rsplit("/", 1)[-1] for p in found.collect()) == ["a.flac", "b.wav"]
    rows = {r.path.rsplit("/", 1)[-1]: r for r in media.probe(found).collect()}
    assert rows["a.flac"].tags["TITLE"] == "Títle" and rows["a.flac"].error is None and rows["b.wav"].error
    images = spark.createDataFrame([("/m/z.jpg",), ("/m/back.png",), ("/m/cover.jpg",), ("/m/front.jpg",), ("/n/b.png",), ("/n/a.png",), ("/n/.x.png",), ("/o/t.txt",), ("/o/cover.gif",), ("/m/1.flac",), ("/n/1.Mp3",), ("/n/my cover.png",), ("/p/1.alac",)], "path string")
    assert {tuple(r) for r in media.covers(images).collect()} == {("/m", "front.jpg"), ("/n", "a.png"), ("/p", None)}


def test_walk_leaves_out_the_system_folder_of_the_root(spark, tmp_path):
    for at in ("Android/a.flac", "x/Android/b.flac", "c.wma", "d.alac"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in media.walk(spark, str(tmp_path)).collect()) == ["b.flac", "d.alac"]


def test_flac_published_example():
    """The first example file of RFC 9639, appendix D: one sample of two channels."""
    data = bytes.fromhex("664c6143 80000022 10001000 00000f00 000f0ac4 42f00000 00013e84 b41807dc 69030758 6a3dad1a 2e0f fff8 6918 0000 bf03 58fd 0312 8baa 9a".replace(" ", ""))
    row = parsed("flac", data)
    got = flac.decode(data[row["audio_at"] :], row["bits"])
    assert got.md5 == row["audio_md5"] and got.errors == 0 and got.blocks[0].tolist() == [[25588, 10416]]


def sound(n=30_000, channels=2, bits=16, seed=1):
    rng = np.random.default_rng(seed)
    wave = 9000 * np.sin(np.arange(n)[:, None] / (3 + 40 * np.arange(1, channels + 1))) + np.cumsum(rng.normal(0, 3, (n, channels)), 0)
    return wave.astype(int).clip(-(1 << bits - 1), (1 << bits - 1) - 1)


@pytest.mark.parametrize("bits, channels, n", [(16, 2, 20_000), (24, 1, 9_000), (8, 3, 5_000), (16, 8, 700), (16, 1, 1), (20, 2, 4097)])
def test_flac_round_trip(bits, channels, n):
    values = sound(n, channels, bits)
    data = flac.encode(values, bits, 44_100)
    row = parsed("flac", data)
    got = flac.decode(data[row["audio_at"] :], row["bits"])
    assert (got.errors, got.samples, got.md5) == (0, n, row["audio_md5"]) and (np.concatenate(got.blocks) == values).all()
    assert flac.decode(b"", bits).samples == 0


def test_flac_predictors_and_stereo():
    """Frames put together bit by bit: linear prediction, an escaped part, the three ways of stereo."""

    def made_frame(layout, subframes):
        lead = bytes([0xFF, 0xF8, 0x69, layout << 4 | 8, 0, 7])
        lead += bytes([flac.crc8(lead)])
        text = "".join(subframes)
        text += "0" * (-len(text) % 8)
        whole = lead + int(text, 2).to_bytes(len(text) // 8, "big")
        return whole + flac.crc16(whole).to_bytes(2, "big")

    verbatim = lambda x, n: flac._packed([(1 << 1, 8), *((v, n) for v in x)])
    a, b = [5, -7, 100, 101, 99, 0, -32768, 32767], [1, 2, -3, 4, 5, -6, 7, 8]
    side = [x - y for x, y in zip(a, b)]
    for layout, parts in ((8, (verbatim(a, 16), verbatim(side, 17))), (9, (verbatim(side, 17), verbatim(b, 16))), (10, (verbatim([x + y >> 1 for x, y in zip(a, b)], 16), verbatim(side, 17)))):
        got = flac.decode(made_frame(layout, parts), 16)
        assert got.errors == 0 and got.blocks[0].T.tolist() == [a, b]
    # Order 2, weights 3 and -2 over 2, of 4 bits; the rest of 6 samples escaped with 9 bits each.
    rest, want = [1, -2, 3, -4, 200, -200], [10, 20]
    for r in rest:
        want.append(r + (3 * want[-1] - 2 * want[-2] >> 1))
    linear = flac._packed([(33 << 1, 8), (10, 16), (20, 16), (3, 4), (1, 5), (3, 4), (-2, 4), (0, 2), (0, 4), (15, 4), (9, 5), *((r, 9) for r in rest)])
    got = flac.decode(made_frame(0, [linear]), 16)
    assert got.errors == 0 and got.blocks[0][:, 0].tolist() == want


def test_flac_damage_and_cuts(spark):
    whole = flac.encode(sound(), 16, 44_100)
    hurt = bytearray(whole)
    for i in range(40):
        hurt[len(whole) // 2 + i] ^= 0x5A
    rows = [("/good.flac", whole), ("/hurt.flac", bytes(hurt)), ("/cut.flac", whole[: len(whole) * 2 // 3]), ("/head.flac", whole[:42]), ("/none.flac", None), ("/x.flac", b"junk" * 50)]
    got = {r.path: r for r in flac.listen(spark.createDataFrame(rows, "path string, content binary")).collect()}
    good, bad, cut = got["/good.flac"], got["/hurt.flac"], got["/cut.flac"]
    assert (good.frame_errors, good.md5_match, good.truncated) == (0, 1, False)
    assert bad.frame_errors == 1 and bad.md5_match == 0 and 30_000 - 2 * 4096 <= bad.decoded_samples < 30_000
    assert cut.truncated and cut.md5_match == 0 and cut.decoded_samples % 4096 == 0
    assert got["/head.flac"].decoded_samples == 0 and got["/none.flac"].error and got["/x.flac"].error


def test_stream_takes_what_came_since(spark, tmp_path):
    root, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    root.mkdir()
    for i in range(3):
        (root / f"{i}.wav").write_bytes(made.wav(44100, 16, 1, 10, f"t{i}"))
    ingest.stream(spark, str(root), store, state, 2).awaitTermination(120)
    (root / "3.wav").write_bytes(b"junk")
    ingest.stream(spark, str(root), store, state, 2).awaitTermination(120)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in ingest.latest(spark, store).collect()}
    assert sorted(rows) == ["0.wav", "1.wav", "2.wav", "3.wav"] and rows["2.wav"].tags["TITLE"] == "t2" and rows["3.wav"].error
