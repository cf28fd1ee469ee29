"""Ranked merges of byte-level BPE over many distinct words at once, and through Spark functions.

Both forms do what the definition says: as long as some neighbours of a word together are a token, the
leftmost pair of the lowest rank becomes that token.
"""

from __future__ import annotations

import array
import base64
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, column, free_name

#: Longer words are merged one by one with a heap: the joint form takes a step for each merge.
LONG = 256
_NONE = np.int64(2**62)
#: Types of the columns that the fold binds.
IDS, NUMBERS = "array<int>", "array<bigint>"


def read_ranks(path: str, most: int | None = None) -> list[bytes]:
    """The tokens of a rank file by rank, the first ``most`` of them."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    return [token for _, token in pairs][:most]


class Merger:
    """Words to ids by the ranks of ``tokens``, which hold every single byte."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, values = array.array("q"), array.array("q")
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(k)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        order = np.argsort(keys)  # a pair makes one token
        self.keys, self.values = np.append(keys[order], _NONE), np.append(values[order], _NONE)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it is no token."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids one word after the other."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(lengths > LONG)
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        symbols = self.byte[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        word = np.repeat(short, lengths[short])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in long:
            ids = self._heap(words[k])
            done.append((np.full(len(ids), k), ids))
        rank = self._ranks(symbols, word)
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(word)))
            of_word = np.repeat(least, sizes)
            over = of_word == _NONE
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, of_word = symbols[~over], word[~over], rank[~over], of_word[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == of_word)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of each word
            symbols[at] = rank[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            for place in (moved, moved[moved > 0] - 1):
                place = place[word[np.minimum(place + 1, len(word) - 1)] == word[place]]
                place = place[place + 1 < len(word)]
                rank[place] = self.pair(symbols[place], symbols[place + 1])
            last = moved[(moved + 1 == len(word)) | (word[np.minimum(moved + 1, len(word) - 1)] != word[moved])]
            rank[last] = _NONE
        if not done:
            return lengths, np.empty(0, np.int64)
        word, ids = (np.concatenate(x) for x in zip(*done))
        return np.bincount(word, minlength=len(words)), ids[np.argsort(word, kind="stable")]

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.pair(symbols[same], symbols[same + 1])
        return rank

    def _heap(self, word: bytes) -> np.ndarray:
        parts: list[bytes | None] = [word[k : k + 1] for k in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(word) and (r := self.rank.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, after[k]))

        for k in range(len(word)):
            offer(k)
        while heap:
            r, k, other = heapq.heappop(heap)
            if parts[k] is None or after[k] != other or parts[other] is None or self.rank.get(parts[k] + parts[other]) != r:
                continue
            parts[k] += parts[other]
            parts[other] = None
            after[k] = after[other]
            if after[k] < len(word):
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return np.array([self.rank[p] for p in parts if p is not None], np.int64)


class SparkMerges:
    """The same merges as Spark higher-order functions over a table of pairs.

    A word is an array of numbers, rank << 46 | place << 16 | symbol: the symbol, the byte it begins at, and the rank of its pair with
    the next one (LAST where that is no token). So no two are equal, and the least number is the leftmost pair of the lowest rank; a
    merge changes it and the number before, and takes out the next. An edge, no token, stands at both ends.
    The rank of a pair is looked up at two places, the remainders of its key by two primes, one of which holds it (a cuckoo table).
    """

    #: Bits of a symbol; vocabularies hold fewer tokens than that. Bits below the rank: of the symbol and 30 of its place.
    BITS, RANK = 16, 46
    LAST = 1 << BITS

    def __init__(self, tokens: list[bytes], words: list[bytes] | None = None):
        """words: the tables hold what occurs in them only, as all that merges make of a word does."""
        merger = Merger(tokens)
        if len(tokens) >= self.LAST - 1:
            raise ValueError("symbols have 16 bits")
        self.edge = len(tokens)
        keys, ranks = merger.keys[:-1], merger.values[:-1]
        if words is not None:
            parts = {w[a:b] for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
            inside = np.fromiter((tokens[k] in parts for k in ranks.tolist()), bool, len(ranks))
            keys, ranks = keys[inside], ranks[inside]
        self.entries = ((keys >> 32) << self.BITS | (keys & (self.LAST - 1))) << self.BITS
        size = max(1009, len(keys) * 5 // 4)
        while (tables := self._placed(ranks, primes := (_prime(size), _prime(size + size // 7)))) is None:
            size += size // 4
        self.primes = primes
        self.tables = dict(zip(("x", "y", "bytes"), (*tables, merger.byte)))

    def _placed(self, ranks: np.ndarray, primes: tuple[int, int]) -> list[np.ndarray] | None:
        """Two tables, each pair in one of them; None if some find no place."""
        tables = [np.full(p, -1, np.int64) for p in primes]
        left, which = np.arange(len(ranks)), 0
        for _ in range(200):
            if not len(left):
                return [np.where(t < 0, np.int64(2**62), self.entries[t] | ranks[t]) for t in tables]
            at = self.entries[left] % primes[which]
            place, one = np.unique(at, return_index=True)
            turned = tables[which][place]
            tables[which][place] = left[one]
            wait = np.ones(len(left), bool)
            wait[one] = False
            left, which = np.concatenate([left[wait], turned[turned >= 0]]), 1 - which
        return None

    def encode(self, word: Column) -> Column:
        """ids of a binary column, folded merge by merge; a null word has none, an empty one no ids.

        The tables are literals, which suits few pairs: see ``encoded``.
        """
        literals = {k: F.from_json(F.lit(json.dumps(x.tolist())), "array<bigint>") for k, x in self.tables.items()}
        return self._encode(word, F.struct(*(x.alias(k) for k, x in literals.items())))

    def encoded(self, words: DataFrame, word: str, out: str) -> DataFrame:
        """The columns of words, and the ids of its column ``word`` as ``out``, as ``encode`` gives them.

        The tables are the one row of a subquery. Literals of their size stand in every copy of the plan in the driver, as an
        object for each number, and each task reads these anew; the row is one block of bytes.
        """
        one = {k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for k, x in self.tables.items()}
        row = words.sparkSession.createDataFrame(pa.table(one)).select(F.struct(*one)).scalar()
        name = free_name([*words.columns, out], "tables")  # a function of arrays takes no subquery itself; Spark joins the two selections
        return words.select("*", row.alias(name)).select(*map(column, words.columns), self._encode(column(word), F.col(name)).alias(out))

    def _encode(self, word: Column, tables: Column) -> Column:
        # Latin-1 has a character for each byte; the tables stand in the plan once.
        chars = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
        folded = lambda t: bound(F.decode(word, "ISO-8859-1"), IDS, lambda text: bound(chars(text), IDS, lambda c: self._folded(c, t)))
        return F.when(word.isNotNull(), bound(tables, IDS, folded))

    def _folded(self, chars: Column, t: Column) -> Column:
        low, places = F.lit(self.LAST - 1).cast("long"), F.lit((1 << self.RANK) - self.LAST).cast("long")
        edge, none = F.lit(self.edge).cast("long"), F.lit(self.LAST).cast("long")
        key = lambda a, b: F.shiftleft(F.shiftleft(a, self.BITS).bitwiseOR(b), self.BITS)
        found = lambda k, at: F.get(t[at], (k % F.lit(self.primes["xy".index(at)])).cast("int")).bitwiseXOR(k)
        rank = lambda k: F.shiftleft(F.least(found(k, "x"), found(k, "y"), none), self.RANK)
        number = lambda a, b, place: bound(key(a, b), "bigint", rank).bitwiseOR(place).bitwiseOR(a)
        symbols = F.concat(F.array(edge), F.transform(chars, lambda c: F.get(t["bytes"], F.ascii(c))), F.array(edge))
        numbers = lambda s: F.transform(s, lambda x, i: number(x, F.coalesce(F.get(s, i + 1), edge), F.shiftleft(i.cast("long"), self.BITS)))

        def step(acc, _):
            def joined(least):
                def merged(before):  # where the number before the least one is
                    new = F.shiftright(least, self.RANK)
                    here = number(new, F.get(acc, before + 3).bitwiseAND(low), least.bitwiseAND(places))
                    changed = lambda x, i: F.when(x == least, here).when(i == before, number(x.bitwiseAND(low), new, x.bitwiseAND(places))).otherwise(x)
                    return F.transform(F.array_remove(acc, F.get(acc, before + 2)), changed)

                return F.when(least < self.LAST << self.RANK, bound((F.array_position(acc, least) - 2).cast("int"), NUMBERS, merged)).otherwise(acc)

            return bound(F.array_min(acc), NUMBERS, joined)

        folded = F.aggregate(chars, bound(symbols, NUMBERS, numbers), step)  # a word has fewer merges than bytes
        return bound(folded, IDS, lambda f: F.transform(F.slice(f, F.lit(2), F.size(f) - 2), lambda x: x.bitwiseAND(low).cast("int")))


def _prime(least: int) -> int:
    while any(least % k == 0 for k in range(2, int(least**0.5) + 1)):
        least += 1
    return least
