"""op1, op3, op6: exact round trips, and the libraries as the reference."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lodestone.llm.queries")
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from lodestone.llm import bpe, matroska, queries, tokenfile  # noqa: E402

BITS = ["a", "th", "e ", " ", "  ", "\n", "\t", "é", "中文", "'s", "'", "12", "!!", "###", "\x1c", "\x85", " ", "😀", "<|endoftext|>", "tion", "ing", "\r\n"]
DIR = "/root/testdata/sf0.001"


def some(n, rng):
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Codec(bpe.Vocabulary.parse(f.read()), P.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_the_library(codec, encoding):
    for text in some(3000, random.Random(1)) + ["a" * 5000, " " * 300 + "x"]:
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_edits_and_appends(codec):
    rng = random.Random(2)
    for text in some(200, rng):
        held = bpe.EncodedText(codec, text)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b, new = rng.randint(a, len(text)), "".join(rng.choice(BITS) for _ in range(3))
            text = text[:a] + new + text[b:]
            held.edit(a, b, new)
            assert held.text == text and held.tokens() == list(memoryview(codec.encode(text)).cast("I"))
        held.append("tion s")
        assert held.tokens() == list(memoryview(codec.encode(text + "tion s")).cast("I"))
    table = bpe.PrefixTable(codec.vocabulary, bytes(rng.choice(b"abthei") for _ in range(1500)))
    again = bytes(table.data[:700]) + b"zq" + bytes(table.data[703:])
    assert table.edit(700, 703, b"zq") < 400
    assert table.last == bpe.PrefixTable(codec.vocabulary, again).last


def test_query_bpe(spark, encoding):
    texts = dict(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op1_bpe(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(encoding.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "ab", 0), (2, "x " * 50_000, 0)], "doc_id long, text string, ids int")
    got = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(r.n_tokens for r in got.collect())[:2] == [0, 0] and got.count() == 4
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_matroska_round_trip():
    rng = random.Random(3)
    for n in [*range(64, 1500, 64), 4096, 65536 * 3 + 64]:
        payload = rng.randbytes(n)
        data = matroska.write(payload)
        media = matroska.parse(data)
        assert matroska.samples(data, media) == payload
        assert [c[2] for c in media.cues] == media.clusters
        assert [p[1] for p in media.packets] == [64_000_000 * i for i in range(len(media.packets))]


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing(kind):
    rng = random.Random(kind)
    for _ in range(100):
        frames = [bytes(300 if kind == matroska.FIXED else rng.choice([0, 1, 254, 255, 256, 510, 20000])) for _ in range(rng.randint(1, 9))]
        made = matroska.block(matroska.SIMPLE_BLOCK, frames, -5, kind)
        ((_, _, at, end),) = matroska.elements(made, 0, len(made))
        track, relative, _, ranges = matroska.frames(made, at, end)
        assert (track, relative, [made[a : a + n] for a, n in ranges]) == (1, -5, frames)


def test_broken_files_raise_only_malformed():
    rng, whole = random.Random(4), matroska.write(bytes(64_000))
    for _ in range(1000):
        data = bytearray(whole[: rng.randint(0, len(whole))])
        if data:
            data[rng.randrange(min(len(data), 300))] = rng.randrange(256)
        try:
            matroska.parse(bytes(data))
        except matroska.Malformed:
            pass


def test_matroska_query_and_tables(spark):
    texts = dict(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op3_matroska(spark, DIR).collect():
        n, payload = matroska.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    df = spark.createDataFrame([(1, None, 0), (2, "x" * 9000, 0), (2, "x" * 9000, 0)], "doc_id long, text string, media int")
    stored = matroska.store(df)
    assert {r.n_bytes for r in stored.collect()} == {0, 9000}
    packets = matroska.packet_table(stored).collect()
    assert len(packets) == 1 + 2 * 18 and all(r.error is None for r in packets)
    broken = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, media binary")
    assert [r.error is not None for r in matroska.packet_table(broken).collect()] == [True]


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = some(300, random.Random(5))
    df = spark.createDataFrame([*enumerate(texts, 5), (None, "null key"), (1, None), (5, "again")], "doc_id long, text string")
    files = tokenfile.write(df.repartition(3), P.path("byte_bpe_50k.json"), str(tmp_path), 2)
    got = sorted(tokenfile.read(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:3] == [None, 1, 5] and len(got) == 303
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.start == at and len(ids) == r.n_tokens and ids[-1] == 2
        if r.doc_id is not None and r.doc_id > 5:
            assert ids[:-1].tolist() == library.encode(texts[r.doc_id - 5], add_special_tokens=False).ids
        at += len(ids)
    assert tokenfile.write(df.limit(0), P.path("byte_bpe_50k.json"), str(tmp_path), 2) == []
    assert [len(f) for f in map(lambda f: tokenfile.TokenFile(*tokenfile._open(f[0])), files)] == [f[1] for f in files]
    one = tokenfile.TokenFile(*tokenfile._open(files[0][0]))
    assert [one.ids(i).tolist() for i in range(len(one))] == [ids.tolist() for _, ids in one]
    whole = open(files[0][0], "rb").read()
    open(files[0][0], "wb").write(whole[:-40] + b"x" + whole[-39:])
    with pytest.raises(ValueError):
        tokenfile.TokenFile(*tokenfile._open(files[0][0]))


def test_token_files_of_hot_keys_and_long_texts(spark, tmp_path, monkeypatch):
    """A key with a third of the rows goes to several tasks and files; clashing names and repeated rows change nothing."""
    monkeypatch.setattr(tokenfile, "ROWS_PER_TASK", 20)
    rng = random.Random(7)
    rows = [(7 if i % 3 == 0 else i, " ".join(rng.choices(["one", "two", "the", "é"], k=rng.randint(0, 30))), i, "x") for i in range(300)]
    rows += [(400, "a b " * 100_000, 0, "y"), (9, "same", 1, "z"), (9, "same", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, frame string")
    files = tokenfile.write(df.repartition(4), P.path("byte_bpe_50k.json"), str(tmp_path), 2)
    assert len(files) > 8 and sum(f[1] for f in files) == len(rows) and max(f[1] for f in files) < 100
    got = sorted(tokenfile.read(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((k, (*library.encode(t, add_special_tokens=False).ids, 2)) for k, t, *_ in rows)
    assert sorted((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want


def test_many_texts_at_once_are_those_of_the_library(monkeypatch):
    """Also where caches start anew, for characters of every class, and for a tokenizer that doesn't cut into parts."""
    monkeypatch.setattr(tokenfile, "CACHE_WORDS", 300)
    raw = open(P.path("byte_bpe_50k.json"), "rb").read()
    library, rng = Tokenizer.from_str(raw.decode()), random.Random(11)
    library.encode_special_tokens = True
    usual = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x250), *range(0x400, 0x482), *range(0x2010, 0x2028)]] + ["\n", "\t", "\r", "\n\n", "'ll", "'s"]
    other = Tokenizer.from_str(raw.decode())
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.encode_special_tokens = True
    for tokenizer in (library, other):
        words = tokenfile.Words(tokenizer.to_str().encode(), 2)
        for _ in range(200):
            bits = rng.choice([BITS, usual, [b for b in BITS if tokenfile.COMMON.fullmatch(b)], ["a", "é", "12", "'", ",", "\n", "ª", "²", "\u0482"]])
            texts = [rng.choice([" ", "", "\n"]).join("".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
            got = [np.frombuffer(x, "<u2").tolist() for x in words.encode_all(texts)]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.encode_all([]) == []


def test_query_token_files(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts, at = dict(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()), 0
    got = sorted(queries.op6_tokenfiles(spark, DIR).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_bpe_repeated_rows_and_names(spark, codec):
    df = spark.createDataFrame([(1, "same words", b"x", 1), (1, "same words", b"x", 1)], "doc_id long, text string, ids binary, decoded int")
    got = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == 2 and len({bytes(r.ids) for r in got}) == 1


def test_many_tables_at_once_are_those_of_one_piece(codec):
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"abcdetinos \xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    lengths = np.array([*map(len, pieces)])
    ids, counts = codec.tables.encode(np.frombuffer(b"".join(pieces), np.uint8), lengths)
    cuts = [0, *counts.tolist()]
    for piece, a, b in zip(pieces, cuts, cuts[1:]):
        assert ids[a:b].tolist() == bpe.PrefixTable(codec.vocabulary, piece).tokens()


def test_words_come_back_from_an_old_generation(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    fresh, rng = bpe.Codec(codec.vocabulary, P.PATTERN), random.Random(10)
    for text in some(300, rng) + [" ".join(f"w{rng.randrange(200)}" for _ in range(40)) for _ in range(200)]:
        assert fresh.encode(text) == codec.encode(text)


def test_matroska_empty_table_and_null_key(spark):
    df = spark.createDataFrame([(None, "abc")], "doc_id long, text string")
    assert [(r.doc_id, r.n_bytes) for r in matroska.digests(df).collect()] == [(None, 3)]
    assert matroska.digests(df.limit(0)).count() == 0 and matroska.packet_table(matroska.store(df.limit(0))).count() == 0
