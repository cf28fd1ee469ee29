"""Byte-level BPE through the pieces of a text, with numpy.

The library's pre-tokenizer cuts a text into pieces that are encoded independently of each other, so the
ids of a text are the concatenated ids of its pieces. Here the cuts of a whole batch of texts are found
with array operations on its UTF-8 bytes, each piece is looked up in a hash table by its exact bytes, and
the library encodes only what the table misses.

Where a text is cut depends on the classes of its characters (letter, number, white space, other), which are
asked of the library itself, for each character when it is first met. Texts with a special string go to
the library as they are.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .textkit import mix

#: Fixed value: the string that the vocabulary maps to one id of its own.
SPECIAL = b"<|endoftext|>"
#: What may follow an apostrophe as one piece with it.
SUFFIX_1, SUFFIX_2 = b"stmd", (b"re", b"ve", b"ll")
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Class of a character that was not met yet, and how many code points there are.
UNKNOWN, CODE_POINTS = 255, 0x110000
#: Longest piece that a table holds; longer ones are encoded each time.
LONGEST = 23
#: Bytes of text that are worked on at a time.
STRIDE = 1 << 21
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def library(vocabulary_json: str):
    """The tokenizer, from the text of its file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary_json)


def classes(tokenizer, chars: list[str]) -> np.ndarray:
    """Class of each character, as the library's pre-tokenizer has it: with what it stays in one piece."""
    found = np.full(len(chars), SPACE, np.uint8)
    for kind, other in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        begins = {at for _, (at, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"\n{other}{c}" for c in chars))}
        found[[k for k in range(len(chars)) if 3 * k + 2 not in begins]] = kind
    return found


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, widths and code points of the characters of two bytes or more."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int64)
    width = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> width)
    for k in range(1, 4):
        more = width > k
        code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
    return lead, width, code


def cuts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts data[offsets[d]:offsets[d + 1]] begin; kinds: the classes by code point."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    kind = kinds[np.minimum(data, 0x7F)]
    lead, width, code = characters(data)
    for k in range(4):
        wide = width > k
        kind[lead[wide] + k] = kinds[code[wide]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= edge[:n]
    runs = np.flatnonzero(start)
    after = runs[(kind[runs] != SPACE) & ~edge[runs]]
    after = after[kind[after - 1] == SPACE]  # runs that follow white space in their text
    last = after - np.where(data[after - 1] < 0x80, 1, np.where(data[after - 2] >= 0xC0, 2, np.where(data[after - 3] >= 0xC0, 3, 4)))
    start[last] = True
    joined = after[data[after - 1] == 0x20]
    start[joined] = False
    # An apostrophe alone that begins a piece takes certain letters after it.
    quote = runs[(data[runs] == 0x27) & start[runs]]
    quote = quote[quote + 1 < n]
    quote = quote[start[quote + 1] & ~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.append(data, [0, 0, 0]).astype(np.uint8)
        one = np.isin(padded[quote + 1], np.frombuffer(SUFFIX_1, np.uint8))
        two = np.zeros(len(quote), bool)
        inside = ~edge[np.minimum(quote + 2, n)]
        for a, b in SUFFIX_2:
            two |= inside & (padded[quote + 1] == a) & (padded[quote + 2] == b)
        took = quote[one | two]
        start[took + 1] = False
        rest = np.where(one, quote + 2, quote + 3)[one | two]
        rest = rest[(rest < n) & ~edge[np.minimum(rest, n)]]
        start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start)


def hash_words(words: list[np.ndarray]) -> np.ndarray:
    return mix(words[0] + mix(words[1] + mix(words[2])))


class Keys:
    """The bytes of pieces as three words and a hash; ``short`` marks those that fit."""

    def __init__(self, padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        blocks = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        self.short = lengths <= LONGEST
        self.words = [blocks[starts + 8 * k] & _MASKS[np.clip(lengths - 8 * k, 0, 8)] for k in range(3)]
        self.words[2] |= lengths.astype(np.uint64) << np.uint64(56)
        self.hashes = hash_words(self.words)

    def take(self, which: np.ndarray) -> Keys:
        out = object.__new__(Keys)
        out.short, out.words, out.hashes = self.short[which], [w[which] for w in self.words], self.hashes[which]
        return out


class Table:
    """An open-addressing hash table from pieces to the numbers 0, 1, …, kept as a few arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.slots = np.full(1 << bits, -1, np.int32)
        self.words = [np.zeros(1 << bits, np.uint64) for _ in range(3)]

    def find(self, keys: Keys) -> np.ndarray:
        """The number of each piece, -1 if unknown."""
        found = np.full(len(keys.hashes), -1, np.int32)
        open_ = np.flatnonzero(keys.short)
        slot = (keys.hashes[open_] >> np.uint64(64 - self.bits)).astype(np.int64)
        mine = [w[open_] for w in keys.words]
        while len(open_):
            held = self.slots[slot]
            same = (self.words[0][slot] == mine[0]) & (self.words[1][slot] == mine[1]) & (self.words[2][slot] == mine[2]) & (held >= 0)
            found[open_[same]] = held[same]
            more = ~same & (held >= 0)
            open_, slot = open_[more], (slot[more] + 1) & (len(self.slots) - 1)
            mine = [w[more] for w in mine]
        return found

    def add(self, keys: Keys) -> None:
        """Number new, distinct, short pieces in their order."""
        left = np.arange(len(keys.hashes))
        slot = (keys.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            place, who = np.unique(np.where(free, slot, -1), return_index=True)
            place, who = place[place >= 0], who[place >= 0]
            self.slots[place] = left[who] + self.n
            for k in range(3):
                self.words[k][place] = keys.words[k][left[who]]
            wait = np.ones(len(left), bool)
            wait[who] = False
            left, slot = left[wait], ((slot + ~free) & (len(self.slots) - 1))[wait]
        self.n += len(keys.hashes)


    def grown(self, bits: int) -> Table:
        """The same pieces and numbers in a table of 2^bits slots."""
        slots = np.flatnonzero(self.slots >= 0)
        slots = slots[np.argsort(self.slots[slots])]
        keys = object.__new__(Keys)
        keys.short, keys.words = np.ones(len(slots), bool), [w[slots] for w in self.words]
        keys.hashes = hash_words(keys.words)
        table = Table(bits)
        table.add(keys)
        return table


class Store:
    """Values (id sequences) by number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.counts, self.at, self.n = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int64), 0

    def add(self, counts: np.ndarray, ids: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(counts) > len(self.counts):
            self.counts, self.at = np.concatenate([self.counts, self.counts]), np.concatenate([self.at, self.at])
        self.flat[self.used : self.used + total] = ids
        self.counts[self.n : self.n + len(counts)] = counts
        self.at[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.used, self.n = self.used + total, self.n + len(counts)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.counts[numbers].astype(np.int64)
        shift = self.at[numbers] - (np.cumsum(counts) - counts)
        return self.flat[np.arange(int(counts.sum())) + np.repeat(shift, counts)]


class Library:
    """How the tokenizers library encodes: whole texts, and pieces as bytes."""

    special: bytes | None = SPECIAL

    def __init__(self, vocabulary_json: str):
        self.tokenizer = library(vocabulary_json)

    def classes(self, chars: list[str]) -> np.ndarray:
        return classes(self.tokenizer, chars)

    def texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.texts([p.decode() for p in pieces])
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))


class Encoder:
    """Texts to ids, with a table that fills as it works and starts anew when it is half full.

    ``backend``: encodes what the table misses (see ``Library``). ``first``: a table and the counts of its
    pieces, looked up before, when only counts are wanted. ``known``: distinct pieces (binary) of LONGEST bytes or fewer, the number of ids
    of each and all ids, that the table holds from the start. ``track``: count how often each piece of the table is looked
    up. With ``most_bits`` the table grows up to that size before it starts anew.
    """

    def __init__(self, backend, bits: int = 22, first: tuple[Table, np.ndarray] | None = None, known: tuple[pa.Array, np.ndarray, np.ndarray] | None = None, track: bool = False, most_bits: int = 0):
        self.backend, self.kinds = backend, np.full(CODE_POINTS, UNKNOWN, np.uint8)
        self.kinds[:0x80] = backend.classes(list(map(chr, range(0x80))))
        self.bits, self.first, self.known, self.most_bits = bits, first, known, most_bits
        self._anew()
        self.uses = np.zeros(0, np.int64) if track else None

    def _anew(self) -> None:
        self.table, self.store = Table(self.bits), Store()
        if self.known and len(self.known[0]):
            words, counts, ids = self.known
            _, offsets, data = words.buffers()
            offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            padded = np.append(np.frombuffer(data, np.uint8), np.zeros(32, np.uint8))
            self.table.add(Keys(padded, offsets[:-1], np.diff(offsets)))
            self.store.add(counts, ids)
        self.at_first = self.table.n

    def most_used(self, most: int) -> tuple[Table, np.ndarray]:
        """A table of the pieces that were looked up most, ties by key, and the numbers of their ids."""
        slots = np.flatnonzero(self.table.slots >= 0)
        used = self.uses[self.table.slots[slots]]
        order = np.lexsort([*(w[slots] for w in self.table.words), -used])[:most]
        slots = slots[order]
        keys = object.__new__(Keys)
        keys.short, keys.words = np.ones(len(slots), bool), [w[slots] for w in self.table.words]
        keys.hashes = hash_words(keys.words)
        table = Table(max(4, int(len(slots) * 2).bit_length()))
        table.add(keys)
        return table, self.store.counts[self.table.slots[slots]]

    def _numbers(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: Keys) -> np.ndarray:
        """Store numbers of the pieces, which are added where they are new; -1: too long for the table."""
        numbers = self.table.find(keys)
        new = np.flatnonzero((numbers < 0) & keys.short)
        if not len(new):
            return numbers
        one = keys.take(new)
        _, where = np.unique(one.hashes, return_index=True)
        while self.bits < self.most_bits and self.table.n + len(where) > len(self.table.slots) // 2:
            self.bits += 2
            self.table = self.table.grown(self.bits)
        if self.table.n + len(where) > len(self.table.slots) // 2:
            if self.table.n > self.at_first:
                self._anew()
                self.uses = None if self.uses is None else np.zeros(0, np.int64)
                return self._numbers(padded, starts, ends, keys)
            self.bits += 2
            self._anew()
            return self._numbers(padded, starts, ends, keys)
        low, high = starts[new[where]].tolist(), ends[new[where]].tolist()
        raw = padded.tobytes()
        self.store.add(*self.backend.pieces([raw[a:b] for a, b in zip(low, high)]))
        self.table.add(one.take(where))
        numbers[new] = self.table.find(one)
        if (numbers[new] < 0).any():  # pieces with equal hashes
            return self._numbers(padded, starts, ends, keys)
        return numbers

    def _plain(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool):
        """Number of ids of each text, and all ids."""
        padded = np.zeros(len(data) + 32, np.uint8)
        padded[: len(data)] = data
        codes = np.unique(characters(data)[2])
        codes = codes[self.kinds[codes] == UNKNOWN]
        if len(codes):
            self.kinds[codes] = self.backend.classes(list(map(chr, codes.tolist())))
        starts = cuts(data, offsets, self.kinds)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys = Keys(padded, starts, ends - starts)
        counts = np.zeros(len(starts), np.int64)
        left = np.arange(len(starts))
        if self.first is not None and self.first[0].n:
            frequent = self.first[0].find(keys)
            counts = np.where(frequent >= 0, self.first[1][frequent], 0).astype(np.int64)
            left = np.flatnonzero(frequent < 0)
            keys = keys.take(left)
        numbers = self._numbers(padded, starts[left], ends[left], keys)
        if self.uses is not None:
            self.uses = np.bincount(numbers[numbers >= 0], minlength=self.table.n) + np.pad(self.uses, (0, self.table.n - len(self.uses)))
        counts[left] = np.where(numbers >= 0, self.store.counts[numbers], 0)
        long = left[numbers < 0]
        long_counts, long_ids = self.backend.pieces([padded[starts[k] : ends[k]].tobytes() for k in long]) if len(long) else (0, None)
        counts[long] = long_counts
        total = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(starts, offsets)
        per_text = total[first[1:]] - total[first[:-1]]
        if not want_ids:
            return per_text, None
        if not len(long):
            return per_text, self.store.ids(numbers)
        out = np.empty(total[-1], np.uint32)
        known = np.repeat(numbers >= 0, counts)
        out[known], out[~known] = self.store.ids(numbers[numbers >= 0]), long_ids
        return per_text, out

    def encode(self, texts: pa.Array, want_ids: bool = True):
        """Number of ids of each text (a null text has none), and the ids of all one after the other.

        Works on about 2 MB at a time; a longer text is cut where a space stands between two words.
        """
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.empty(0, np.uint8)
        slow = np.zeros(len(texts), bool)
        at, whole = -1, data[offsets[0] :].tobytes() if self.backend.special else b""
        while self.backend.special and (at := whole.find(self.backend.special, at + 1)) >= 0:
            slow[np.searchsorted(offsets, at + offsets[0], "right") - 1] = True
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        d = 0
        while d < len(texts):
            e = d + 1
            if slow[d]:
                (ids,) = self.backend.texts([texts[d].as_py()])
                counts[d] = len(ids)
                parts.append(np.array(ids, np.uint32))
            else:
                while e < len(texts) and not slow[e] and offsets[e + 1] - offsets[d] <= STRIDE:
                    e += 1
                bounds = offsets[d : e + 1]
                if bounds[-1] - bounds[0] > STRIDE and e == d + 1:
                    pieces = self._long(data, int(bounds[0]), int(bounds[1]))
                    n, ids = zip(*(self._plain(data[a:b], np.array([0, b - a]), want_ids) for a, b in zip(pieces, pieces[1:])))
                    counts[d] = sum(int(x[0]) for x in n)
                    parts += [x for x in ids if x is not None]
                else:
                    counts[d:e], ids = self._plain(data[bounds[0] : bounds[-1]], bounds - bounds[0], want_ids)
                    if ids is not None:
                        parts.append(ids)
            d = e
        return counts, (np.concatenate(parts) if parts else np.empty(0, np.uint32)) if want_ids else None

    def _long(self, data: np.ndarray, a: int, b: int) -> list[int]:
        """Where to cut a long text: at single spaces between letters, or before an ideographic full stop after a letter."""
        found, step = [a], STRIDE // 2
        at = a + step
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        while at < b - step:
            here = data[at : min(at + step, b)]
            good = np.flatnonzero((here[1:-1] == 0x20) & letter[here[:-2]] & letter[here[2:]]) + 1
            if not len(good) and len(here) > 6:  # U+3002 after one of U+5000 to U+8FFF, all of them letters
                stop = (here[3:-2] == 0xE3) & (here[4:-1] == 0x80) & (here[5:] == 0x82)
                good = np.flatnonzero(stop & (here[:-5] >= 0xE5) & (here[:-5] <= 0xE8)) + 3
            if len(good):
                found.append(at + int(good[0]))
                at = found[-1] + step
            else:
                at += step
        return [*found, b]
