"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one valid encoding exists, so the table keeps one number a prefix: its last
token. The table of a longer text extends that of a shorter one (exact appends), and after an edit only entries up to
the point where a whole token length of them agrees again are made anew.
"""

from __future__ import annotations

import base64
import functools
import sys
from array import array
from bisect import bisect_right
from itertools import repeat

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_slices

#: Words of a cache generation, pairs of the cache of single tables, slots of that of many; they bound a worker's memory.
CACHE_WORDS, CACHE_PAIRS, PAIR_SLOTS = 250_000, 150_000, 1 << 20
#: Pieces whose tables are made side by side, the bytes up to which a piece is one of them, tokens decoded at once.
PIECES_AT_ONCE, SIDE_BY_SIDE, DECODED_AT_ONCE = 16_384, 64, 1 << 18


assert sys.byteorder == "little" and array("I").itemsize == 4


class Vocabulary:
    """Token ranks with what the table needs: tokens by their bytes read backwards, and the last merge of each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        # The trie over reversed tokens: node * 256 + byte -> node; a node's token or -1.
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1]
        for token, rank in ranks.items():
            at = 0
            for byte in reversed(token):
                at = self.next.setdefault(at << 8 | byte, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
            self.token[at] = rank

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        """From the text of a ranks file: base64 of the token, a space, its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if (known := self._halves.get(token)) is not None:
            return known
        whole = self.bytes[token]
        if len(whole) == 1:
            return None
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], self.size))
            if parts[best] + parts[best + 1] not in self.ranks:
                raise ValueError(f"token {token} cannot be reached by merges")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        found = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether merging could leave these two tokens side by side.

        Merges are undone from the last back; the border fails if a merge across it would have come first."""
        key = left * self.size + right
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        before, a, b = self.size, left, right
        while True:
            across = self.ranks.get(self.bytes[a] + self.bytes[b])
            if across is not None and across < before:
                answer = False
                break
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                answer = True
                break
            if of_b is None or (of_a is not None and a > b):
                before, a = a, of_a[1]
            else:
                before, b = b + 1, of_b[0]
        self.pairs[key] = answer
        return answer


class PrefixTable:
    """The bytes of one piece and the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", known: list[int] | None = None):
        """known: the entries of a table whose data starts this one's, if there is one."""
        self.vocabulary = vocabulary
        self.last = [-1] if known is None else known[:]
        self.data = data[: len(self.last) - 1]
        self.append(data[len(self.last) - 1 :])

    def append(self, data: bytes) -> None:
        self.data += data
        v, data, last, done = self.vocabulary, self.data, self.last, len(self.last)
        follow, tokens, pairs, size = v.next.get, v.token, v.pairs.get, v.size
        for end in range(done, len(data) + 1):
            at, i, found = 0, end, []
            while i:
                i -= 1
                at = follow(at << 8 | data[i])
                if at is None:
                    break
                if tokens[at] >= 0:
                    found.append((i, tokens[at]))
            for start, token in reversed(found):
                if not start:
                    break
                fits = pairs(last[start] * size + token)
                if fits or fits is None and v.follows(last[start], token):
                    break
            else:
                raise ValueError("a byte has no token")
            last.append(token)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start:stop; gives how many entries were made anew."""
        rest, old, step = self.data[stop:], self.last[stop + 1 :], self.vocabulary.longest
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(new)
        for at in range(0, len(rest), step):
            self.append(rest[at : at + step])
            if len(rest) - at > step and self.last[-step:] == old[at : at + step]:
                self.data += rest[at + step :]
                self.last += old[at + step :]
                return len(new) + at + step
        return len(new) + len(rest)

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class _Slots:
    """A hash table of 64-bit keys to 32-bit numbers as arrays, so that many keys are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # every free slot takes one of those that want it, the others go on to the next
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.values[at] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for unknown ones."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            same = there == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (there >= 0)]
        return out


class Tables:
    """Prefix tables of many pieces at once: the same entries as those of PrefixTable, made for all pieces side by side,
    one length of prefix after the other."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, ranks, size = vocabulary, vocabulary.ranks, vocabulary.size
        edges = np.array([*vocabulary.next], np.int64), np.array([*vocabulary.next.values()], np.int32)
        self.edges, self.token = _Slots(*edges), np.array(vocabulary.token, np.int32)
        self.lengths = np.array([*map(len, vocabulary.bytes)], np.int64)
        # The nodes of one byte and of two, the last one first.
        every = np.arange(1 << 16)
        self.one = self.edges.get(every[:256])
        deeper = self.edges.get(self.one[every >> 8].astype(np.int64) << 8 | every & 255)
        self.two = np.where(self.one[every >> 8] >= 0, deeper, np.int32(-1))
        # Which two tokens are another one together, and of each token the two of its last merge: -1 for a byte.
        joined = [(ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.joined = _Slots(*(np.array(c, k) for c, k in zip(zip(*joined), (np.int64, np.int32)))) if joined else _Slots(np.zeros(0, np.int64), np.zeros(0, np.int32))
        halves = [vocabulary.halves(t) or (-1, -1) if self.lengths[t] else (-1, -1) for t in range(size)]
        self.left, self.right = (np.array(c, np.int64) for c in zip(*halves))
        # Answers about pairs, each in the one slot of its key: a later pair of that slot takes its place.
        self.asked, self.answer = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Vocabulary.follows() of many pairs."""
        keys = left.astype(np.int64) * self.vocabulary.size + right
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIR_SLOTS
        fresh = np.flatnonzero(self.asked[slots] != keys)
        answer = self.answer[slots]
        if len(fresh):
            answer[fresh] = self._undone(left[fresh].astype(np.int64), right[fresh].astype(np.int64))
            self.asked[slots[fresh]], self.answer[slots[fresh]] = keys[fresh], answer[fresh]
        return answer

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = self.vocabulary.size
        before, answer, at = np.full(len(a), size, np.int64), np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            across = self.joined.get(a * size + b)
            first = (across >= 0) & (across < before)
            answer[at[first]] = False
            of_a, of_b = self.right[a], self.left[b]
            on = ~first & ((of_a >= 0) | (of_b >= 0))
            a, b, of_a, of_b, at = a[on], b[on], of_a[on], of_b[on], at[on]
            undo_a = (of_b < 0) | (of_a >= 0) & (a > b)
            before = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, of_a, a), np.where(undo_a, b, of_b)
        return answer

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that lie one after the other in ``data`` and have ``lengths``, none of them 0: the ids of all, and
        the number of ids up to the end of each."""
        stops = np.cumsum(lengths)
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for at in range(0, len(lengths), PIECES_AT_ONCE):
            some = lengths[at : at + PIECES_AT_ONCE]
            begin = int(stops[at] - some[0])
            last = self._last(data[begin : begin + int(some.sum())].astype(np.int64), some)
            # Back from the ends of the pieces, token by token.
            ends, place, start = np.zeros(len(last), bool), np.cumsum(some) - 1, np.cumsum(some) - some
            final = place
            while len(place):
                ends[place] = True
                place = place - self.lengths[last[place]]
                on = place >= start
                place, start = place[on], start[on]
            ids.append(last[ends].astype("<u4"))
            counts.append(np.cumsum(ends)[final] + counts[-1][-1])
        return np.concatenate(ids), np.concatenate(counts[1:]) if len(counts) > 1 else counts[0][:0]

    def _last(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The last token of each prefix of each piece."""
        starts = np.cumsum(lengths) - lengths
        last = np.zeros(len(data), np.int32)
        for i in np.flatnonzero(lengths > SIDE_BY_SIDE):
            piece = slice(starts[i], starts[i] + lengths[i])
            last[piece] = PrefixTable(self.vocabulary, data[piece].astype(np.uint8).tobytes()).last[1:]
        # Tokens that end at each byte: the reversed trie is walked back from all bytes at once.
        first = np.repeat(starts, lengths)
        at = np.flatnonzero(np.repeat(lengths <= SIDE_BY_SIDE, lengths))
        node, found, back = np.zeros(len(at), np.int64), [], 0
        while len(at):
            step = data[at - back]
            node = self.one[step] if not back else self.two[data[at] << 8 | step] if back == 1 else self.edges.get(node.astype(np.int64) << 8 | step)
            back += 1
            alive = node >= 0
            at, node = at[alive], node[alive]
            token = self.token[node]
            ends = token >= 0
            found.append((at[ends], token[ends]))
            inside = at - back >= first[at]
            at, node = at[inside], node[inside]
        counts = np.zeros(len(data), np.int64)
        for ends, _ in found:
            counts[ends] += 1
        slot = np.cumsum(counts) - counts
        tokens, fill = np.full(int(counts.sum()) + 1, -1, np.int32), slot.copy()
        for ends, token in reversed(found):  # longest first
            tokens[fill[ends]] = token
            fill[ends] += 1
        # Of all prefixes of one length, longest tokens are tried first.
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= SIDE_BY_SIDE]
        most = int(lengths[order[0]]) if len(order) else 0
        fewer = np.searchsorted(-lengths[order], -np.arange(1, most + 1), "right")
        for length in range(1, most + 1):
            at = starts[order[: fewer[length - 1]]] + length - 1
            tried, stop = slot[at], fill[at]
            while len(at):
                if (tried >= stop).any():
                    raise ValueError("a byte has no token")
                token = tokens[tried]
                behind = self.lengths[token]
                fits = behind == length
                inner = np.flatnonzero(~fits)
                fits[inner] = self.follows(last[at[inner] - behind[inner]], token[inner])
                last[at[fits]] = token[fits]
                at, tried, stop = at[~fits], tried[~fits] + 1, stop[~fits]
        return last


class Codec:
    """Encodes whole texts, each match of the pattern separately, and decodes ids.

    The pattern always cuts before a single space between two other characters, so a text is the sequence of its first
    word and of a space and a word each. Words are cut apart and encoded once and kept, as long as there is room; a text
    with white space beside a space goes through the pattern whole."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.tables = Tables(vocabulary)
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.odd = False
        self._flat = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self._starts = np.cumsum(self.tables.lengths) - self.tables.lengths

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [text.split(" ") for text in texts]
        firsts = [words.pop(0) for words in cut]
        wanted = set().union(*cut).difference(self.known)
        if len(self.known) + len(wanted) > CACHE_WORDS:
            # Two generations: what is asked for again comes back, so that frequent words stay.
            self.old, self.known = self.known, {}
            wanted = set().union(*cut)
        known, old = self.known, self.old
        back = wanted.intersection(old)
        known.update(zip(back, map(old.__getitem__, back)))
        wanted -= back
        # A word with white space at an end is kept as None: where the pattern cuts there depends on more than the word.
        odd = {w for w in wanted if not w or w[0].isspace() or w[-1].isspace()}
        known.update(dict.fromkeys(odd))
        regular = [*(wanted - odd)] if odd else [*wanted]
        found = [self.pattern.findall(" " + " ".join(regular))] if regular else []
        whole = [not first or first[-1].isspace() for first in firsts]
        self.odd = self.odd or bool(odd)
        if self.odd:
            whole = [w or None in map(known.get, words, repeat(b"")) for w, words in zip(whole, cut)]
        found += [self.pattern.findall(text if w else first) for w, text, first in zip(whole, texts, firsts)]
        packed, counts, spaced = self._ids([piece for pieces in found for piece in pieces])
        ends = np.cumsum([*map(len, found)], dtype=np.int64)
        if regular:
            # Words hold no space, so a piece that starts with one starts a word.
            begins = np.flatnonzero(spaced[: ends[0]])
            assert len(begins) == len(regular)
            cuts = (4 * counts[begins]).tolist() + [4 * int(counts[ends[0]])]
            known.update(zip(regular, map(packed.__getitem__, map(slice, cuts, cuts[1:]))))
        stops = (4 * counts[ends[bool(regular) :]]).tolist()
        begin = 4 * int(counts[ends[0]]) if regular else 0
        out = []
        for w, words, stop in zip(whole, cut, stops):
            head, begin = packed[begin:stop], stop
            out.append(head if w else head + b"".join(map(known.__getitem__, words)))
        return out

    def _ids(self, pieces: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The packed ids of all pieces, the number of ids before each and at the end, and which start with a space."""
        if not pieces:
            return b"", np.zeros(1, np.int64), np.zeros(0, bool)
        text = "".join(pieces)
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(data) != len(text):
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        begins = np.append(0, ends[:-1])
        ids, counts = self.tables.encode(data, ends - begins)
        return ids.tobytes(), np.append(0, counts), data[begins] == 32

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        out = []
        for at in range(0, len(ids), DECODED_AT_ONCE):
            some = ids[at : at + DECODED_AT_ONCE]
            lengths = self.tables.lengths[some]
            ends = np.cumsum(lengths)
            if len(ends):
                out.append(self._flat[np.repeat(self._starts[some] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class EncodedText:
    """A text under edit: matches of the pattern, each with its own table."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.edit(0, 0, text)

    def append(self, text: str) -> int:
        return self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces characters start:stop; gives how many matches were cut anew. A match depends on itself and one
        character after it, so cutting starts one match before the edit and ends where old and new borders meet."""
        keep = max(0, bisect_right(self.starts, max(0, start - 1)) - 2)
        begin = self.starts[keep] if keep < len(self.starts) else 0
        shift = len(new) - (stop - start)
        after = {s + shift: i for i, s in enumerate(self.starts) if s >= stop and s + shift > start + len(new)}
        self.text = self.text[:start] + new + self.text[stop:]
        starts, tables, tail = [], [], len(self.starts)
        for m in self.codec.pattern.finditer(self.text, begin):
            if m.start() in after:
                tail = after[m.start()]
                break
            starts.append(m.start())
            tables.append(PrefixTable(self.codec.vocabulary, m.group().encode()))
        self.starts = self.starts[:keep] + starts + [s + shift for s in self.starts[tail:]]
        self.tables = self.tables[:keep] + tables + self.tables[tail:]
        return len(starts)

    def tokens(self) -> list[int]:
        return [t for table in self.tables for t in table.tokens()]


@functools.lru_cache(maxsize=4)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(Vocabulary.parse(raw), pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) for every row: ids packed as little-endian unsigned 32-bit integers, and the bytes
    that they decode to. A null text is an empty one; empty texts have no ids; repeated rows give repeated rows; a null
    key stays; other columns aren't carried. The ranks file is read on the driver and sent once to each executor: a
    vocabulary doesn't grow with the data."""
    with open(ranks_path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = _codec(raw.value, pattern)

        def each(rows):
            for (k, _), packed in zip(rows, codec.encode_all([value or "" for _, value in rows])):
                yield k, len(packed) // 4, packed, codec.decode(packed)

        return each

    kind = df.select(key).schema[0].dataType.simpleString()
    return map_slices(df, [key, text], f"`{key}` {kind}, n_tokens long, ids binary, decoded binary", make)
