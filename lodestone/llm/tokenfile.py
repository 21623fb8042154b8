"""Token ids in binary files: each document is a zstandard frame of its own, all with one dictionary.

A file is: MAGIC; bytes of an id (1 byte); SHA-256 of the dictionary (32); the frames; the index, a row of ROW for each
document; the TAIL (documents, where the index starts, its crc32, MAGIC again). Numbers are little-endian. The
dictionary lies beside the files under its hash. So one document is read by the tail, its row of the index and its
frame, and never with another dictionary than it was written with.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, map_slices, shared_dir

MAGIC, TAIL = b"LTOKZ001", "<QQI8s"
#: Of a document: whether its key is null, the key, where its frame starts, the frame's bytes, ids.
ROW = np.dtype([("null", "u1"), ("key", "<i8"), ("at", "<u8"), ("size", "<u8"), ("ids", "<u8")])
#: Documents that the dictionary is trained on at most, in the order of a hash of their key; bytes of a dictionary.
FIT_ROWS, DICTIONARY = 500, 64 << 10
#: Documents a task writes about, tasks at most, documents of a file at most: a task that gets more writes more files.
ROWS_PER_TASK, TASKS, ROWS_PER_FILE = 4096, 100_000, 16_384
#: Bytes that are read at once, in whole frames (one may be longer).
READ_AT_ONCE = 4 << 20
LEVEL = 3
#: Words of a worker's cache and their characters, after which it starts anew. The same holds for parts of words.
CACHE_WORDS, CACHE_CHARACTERS = 1_000_000, 32_000_000
#: Texts whose words are numbered at once, at most; words that the library gets at once (more take longer each).
TEXTS_AT_ONCE, AT_ONCE = 1024, 128
#: Letters, white space beside spaces, and the tokenizer's pattern on texts of COMMON characters alone. Others are left out, as
#: Python's classes and the library's may differ on them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481"
EDGES = ["  ", " \t", " \n", " \r", "\t ", "\n ", "\r "]
COMMON = re.compile(rf"[ \t\n\r!-~\u2010-\u2027{_LETTERS}]*")
PART = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


class Rows:
    """Arrays of ids end to end in one array, by their number."""

    def __init__(self, kind: str):
        self.flat, self.starts, self.count = np.empty(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> range:
        """Numbers of the new arrays."""
        at, ends = int(self.starts[self.count]), np.cumsum(sizes)
        if at + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (at + len(flat)))
        if self.count + len(sizes) >= len(self.starts):
            self.starts = np.resize(self.starts, 2 * (self.count + len(sizes)))
        self.flat[at : at + len(flat)] = flat
        self.starts[self.count + 1 : self.count + 1 + len(sizes)] = at + ends
        self.count += len(sizes)
        return range(self.count - len(sizes), self.count)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers end to end, and where each ends; an empty one for -1."""
        starts = self.starts[numbers]
        sizes = np.where(numbers < 0, 0, self.starts[numbers + 1] - starts)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Words:
    """Encodes whole texts with the tokenizers library, each distinct word or part of a word once.

    A byte-level tokenizer cuts before a single space between two other characters, so a text is the sequence of its
    first word and of a space and a word each; a text with white space beside a space goes to the library whole. The words
    of many texts are numbered at once by Arrow. A word of COMMON characters is cut further, as a byte-level tokenizer of the
    usual pattern cuts it, so that the library gets each part once; a word of others, or for another tokenizer, goes there
    whole."""

    def __init__(self, raw: bytes, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        self.kind = f"<u{width}"
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.cut = isinstance(p := self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and p.use_regex and not p.add_prefix_space and self.tokenizer.normalizer is None
        self.line = self._ids("\n")[0]
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.known_ids, self.part_ids, self.known_size, self.part_size = Rows(self.kind), Rows(self.kind), 0, 0

    def _forget(self) -> None:
        """Before a slice, as numbers hold for a whole one. Words are made of parts sooner than parts by the library."""
        if len(self.known) > CACHE_WORDS or self.known_size > CACHE_CHARACTERS:
            self.known, self.known_ids, self.known_size = {}, Rows(self.kind), 0
        if len(self.parts) > CACHE_WORDS or self.part_size > CACHE_CHARACTERS:
            self.parts, self.part_ids, self.part_size = {}, Rows(self.kind), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _spaced_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that start with their only space, and how many each has: only the first of them starts with a space."""
        ids = np.concatenate([self._ids("".join(words[i : i + AT_ONCE])) for i in range(0, len(words), AT_ONCE)])
        cuts = np.flatnonzero(self.spaced[ids])
        assert len(cuts) == len(words) and not cuts[0]
        return ids, np.diff(cuts, append=len(ids))

    def _learn_parts(self, new: set[str]) -> None:
        after_space = [part for part in new if part[0] == " "]
        white = [part for part in new if part.isspace()]
        bare = [*new.difference(after_space, white)]
        self.part_size += sum(map(len, new))
        if after_space:
            self.parts.update(zip(after_space, self.part_ids.add(*self._spaced_ids(after_space))))
        if bare:
            # A line break is a token of its own before anything but white space.
            ids = self._ids("\n" + "\n".join(bare))
            cuts = np.flatnonzero(ids == self.line)
            assert len(cuts) == len(bare) and not cuts[0]
            self.parts.update(zip(bare, self.part_ids.add(ids[ids != self.line], np.diff(cuts, append=len(ids)) - 1)))
        for part in white:
            self.parts.update(zip([part], self.part_ids.add(ids := self._ids(part), np.array([len(ids)]))))

    def _learn(self, new: list[str], text: str) -> range:
        """Numbers of words without white space at either end; ``text`` has a space before each."""
        if not self.cut or not COMMON.fullmatch(text):
            return self.known_ids.add(*self._spaced_ids([" " + w for w in new]))
        parts = PART.findall(text)
        numbers = np.fromiter(map(self.parts.get, parts, repeat(-1)), np.int64, len(parts))
        if len(unknown := np.flatnonzero(numbers < 0)):
            asked = [parts[i] for i in unknown.tolist()]
            self._learn_parts(set(asked))
            numbers[unknown] = np.fromiter(map(self.parts.__getitem__, asked), np.int64, len(asked))
        ids, ends = self.part_ids.take(numbers)
        # Only the first part of a word starts with a space.
        cuts = np.flatnonzero(self.spaced[self.part_ids.flat[self.part_ids.starts[numbers]]])
        assert len(cuts) == len(new) and not cuts[0]
        return self.known_ids.add(ids, np.diff(ends[np.append(cuts[1:], len(parts)) - 1], prepend=0))

    def _learn_all(self, new: list[str]) -> np.ndarray:
        """Numbers of words; -1 for those at fault, which are empty or have white space at an end."""
        text = " " + " ".join(new)
        if COMMON.fullmatch(text) and not text[-1].isspace() and not any(edge in text for edge in EDGES):
            groups = [(np.arange(len(new)), new, text)]
        else:
            groups, fit = [], [bool(w) and not w[0].isspace() and not w[-1].isspace() for w in new]
            common = [bool(COMMON.fullmatch(w)) for w in new]
            for kind in (True, False):
                if some := [i for i, (a, b) in enumerate(zip(fit, common)) if a and b == kind]:
                    groups.append((np.array(some), words := [new[i] for i in some], " " + " ".join(words)))
        numbers = np.full(len(new), -1)
        for at, words, text in groups:
            learned = self._learn(words, text)
            self.known.update(zip(words, learned))
            self.known_size += len(text)
            numbers[at] = learned
        return numbers

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary
        # No word has a space in it. to_pylist takes six times as long.
        _, ends, data = pc.binary_join_element_wise(names, *pa.array(["", " "], names.type)).buffers()
        words = str(memoryview(data)[: np.frombuffer(ends, np.int64)[len(names)]], "utf-8").split(" ")[:-1]
        inner = np.ones(len(codes), bool)
        inner[at[:-1]] = False
        used = np.zeros(len(words), bool)
        used[codes[inner]] = True
        self._forget()
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(used & (numbers < 0))):
            numbers[new] = self._learn_all([words[i] for i in new.tolist()])
        placed = numbers[codes]
        faults = np.add.reduceat(inner & (placed < 0), at[:-1])
        placed[~inner] = -1
        ids, ends = self.known_ids.take(placed)
        packed, cuts = ids.tobytes(), (ends[at[1:] - 1] * ids.itemsize).tolist()
        made = []
        for text, fault, code, a, b in zip(texts, faults.tolist(), codes[at[:-1]].tolist(), [0, *cuts], cuts):
            first = words[code]
            # A text with a word at fault goes to the library whole, as does one that starts so.
            whole = fault or not first or first[-1].isspace()
            made.append(self._ids(text).tobytes() if whole else self._ids(first).tobytes() + packed[a:b])
        return made


@functools.lru_cache(maxsize=2)
def _words(raw: bytes, width: int) -> Words:
    return Words(raw, width)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder: local, or what pyarrow reaches (hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _put(system: fs.FileSystem, path: str, parts) -> None:
    """Whole or not at all, also when two attempts of a task write at once."""
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    system.move(own, path)


class TokenFile:
    """Reads one file; documents by their place in it."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.source, folder = system.open_input_file(path), path.rpartition("/")[0]
        head = self.source.read_at(len(MAGIC) + 33, 0)
        end = self.source.size() - struct.calcsize(TAIL)
        count, at, check, magic = struct.unpack(TAIL, self.source.read_at(struct.calcsize(TAIL), end))
        index = self.source.read_at(end - at, at)
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC or zlib.crc32(index) != check or len(index) != count * ROW.itemsize:
            raise ValueError(f"{path} is damaged")
        self.width, digest = head[len(MAGIC)], head[len(MAGIC) + 1 :].hex()
        with system.open_input_stream(f"{folder}/{digest}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError(f"the dictionary of {path} is another one")
        self.index = np.frombuffer(index, ROW)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def key(self, i: int) -> int | None:
        return None if self.index[i]["null"] else int(self.index[i]["key"])

    def ids(self, i: int) -> np.ndarray:
        row = self.index[i]
        return self._ids(self.source.read_at(int(row["size"]), int(row["at"])))

    def __iter__(self):
        """(key, ids) of all documents in order; neighbouring frames are read together."""
        first, ends = 0, (self.index["at"] + self.index["size"]).tolist()
        starts = self.index["at"].tolist()
        while first < len(self):
            stop = max(first + 1, bisect_right(ends, starts[first] + READ_AT_ONCE))
            data = memoryview(self.source.read_at(ends[stop - 1] - starts[first], starts[first]))
            for i in range(first, stop):
                yield self.key(i), self._ids(data[starts[i] - starts[first] : ends[i] - starts[first]])
            first = stop

    def _ids(self, frame) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4", copy=False)


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on serialized id arrays; empty where there are too few to train on."""
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(df: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encodes every whole text (a null one is empty) without special tokens, appends ``end_id``, and writes files in
    ascending order of the integer key, nulls first; equal keys are all kept, side by side in the order of a hash of their
    texts. Gives (path, documents, ids) of each file in that order. An empty table gives no files.

    Rows are dealt to ranges of the key and of that hash, so that rows of one key may go to several tasks; only texts are
    shuffled, once. A task writes one file after the other."""
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(raw.decode()).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    tail = b"" if end_id is None else end_id.to_bytes(width, "little")
    sent = spark.sparkContext.broadcast(raw)
    rows = df.count()
    if not rows:
        return []
    # Keys of small hashes, some multiple of FIT_ROWS of them whatever the number of rows and of tasks.
    few = F.pmod(F.xxhash64(key), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, 4 * FIT_ROWS / rows))
    first = df.where(few).orderBy(F.xxhash64(key), key).limit(FIT_ROWS)
    fitted = map_rows(first, [text], "ids binary", lambda: (lambda words: lambda value: [(words.encode(value or "") + tail,)])(_words(sent.value, width)))
    dictionary = _dictionary(sorted(bytes(r.ids) for r in fitted.toLocalIterator()))
    digest = hashlib.sha256(dictionary).digest()
    system, where = _open(folder)
    system.create_dir(where, recursive=True)
    _put(system, f"{where}/{digest.hex()}.zdict", [dictionary])
    trained = spark.sparkContext.broadcast(dictionary)

    def make():
        from pyspark import TaskContext

        own, place = _open(folder)
        words, task = _words(sent.value, width), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained.value) if trained.value else None)
        out, temporary, index, at, number = None, "", [], 0, 0

        def close():
            nonlocal out, number
            table = np.array(index, ROW)
            data = table.tobytes()
            out.write(data + struct.pack(TAIL, len(index), at, zlib.crc32(data), MAGIC))
            out.close()
            name = f"{task:06d}-{number:06d}.tokz"
            own.move(temporary, f"{place}/{name}")
            out, number = None, number + 1
            return name, len(index), int(table["ids"].sum())

        def each(given):
            nonlocal out, temporary, index, at
            for (k, _), coded in zip(given, words.encode_all([value or "" for _, value in given])):
                if out is None:
                    temporary, index, at = f"{place}/{task:06d}.{uuid.uuid4().hex}", [], len(MAGIC) + 33
                    out = own.open_output_stream(temporary)
                    out.write(MAGIC + bytes([width]) + digest)
                data = coded + tail
                frame = packer.compress(data)
                out.write(frame)
                index.append((k is None, k or 0, at, len(frame), len(data) // width))
                at += len(frame)
                if len(index) >= ROWS_PER_FILE:
                    yield close()

        return each, lambda: [close()] if out is not None else []

    named = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text").asc()]
    dealt = named.repartitionByRange(max(1, min(TASKS, -(-rows // ROWS_PER_TASK))), *order).sortWithinPartitions(*order)
    made = map_slices(dealt, ["_key", "_text"], "file string, documents long, ids long", make, TEXTS_AT_ONCE).collect()
    return [(f"{folder}/{r.file}", r.documents, r.ids) for r in sorted(made)]


def read(spark: SparkSession, files: list[tuple[str, int, int]], key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every document of the files, in their order: ids as little-endian unsigned 32-bit
    integers, start the number of ids of all documents before."""
    starts, total = [], 0
    for path, _, ids in files:
        starts.append((path, total))
        total += ids
    listed = spark.createDataFrame(starts, "path string, base long")
    listed = listed.repartition(max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism)))

    def make():
        def each(path, base):
            for k, ids in TokenFile(*_open(path)):
                yield k, base, len(ids), ids.tobytes()
                base += len(ids)

        return each

    return map_rows(listed, ["path", "base"], f"`{key}` long, start long, n_tokens long, ids binary", make)


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """read() of what write() puts into a new shared folder. Cases as there."""
    return read(df.sparkSession, write(df, tokenizer_path, shared_dir(df.sparkSession, "token-files"), end_id, key, text), key)
