"""Operator 6: an n-gram Jaccard join by rare-first prefix filtering.

1. Document frequencies of n-grams are counted in a table of hash classes that grows with the input, to 2^22
   classes at most. Every n-gram becomes a 64-bit id whose upper bits are its frequency's logarithm, so the
   order of ids is rare-first and the same everywhere; a text's set is its sorted ids. Any order gives the
   same links; rare-first makes few candidates.
2. Equal sets are one: they are found by fingerprint, and one of them stands for all. With the fingerprint
   goes a bitmap, in which every id turns one of four bits or more an id over. What differs between two
   bitmaps differs between the sets, so they bound the intersection from above, exactly and for a twelfth
   of the bytes of the ids.
3. Each set sends the ids of its prefix, with its size and the id's place, to a range of id hashes. Sets of one
   id pass the length and positional filters. First each id's sets are paired with the least of them, so a
   group of near copies gives about one pair for each set.
4. A pair is verified once: if the bitmaps allow it, the suffix filter compares where a few ids of one set
   fall in the other, then the ids are intersected.
5. Links are joined to components by distributed union-find. Sets that share a prefix id and are still apart
   are then compared by their bitmaps, in blocks, whichever pair of them it is. What could link goes to
   verification: first a forest of such pairs, then all that are left and still apart. So no pair stays untested that shares an id, could link and is in two components.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import column, cut, free_name
from .components import components, extended

#: Words of an n-gram; least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: Text bytes for a class of the frequency table, its least and most bits, parts it is summed in, and bytes of index that one task gets.
CLASS_BYTES, LEAST_BITS, MOST_BITS, PARTS, RANGE_BYTES = 32, 16, 22, 8, 24 << 20
#: Most bits of the filter that tells which sets are needed for verification (16 MB).
NEEDED_BITS = 27
#: Bits of a bitmap for each id at least; pairs of one set that one task looks at; sets, and bytes of bitmaps, of a block that others are compared with; sets of a group that are looked at pair by pair before.
ID_BITS, HUB_PAIRS, BLOCK_SETS, BLOCK_BYTES, GROUP_SETS = 4, 512, 2048, 16 << 20, 8192
#: Pairs that a set and a component get in one round after another (see ``_block_comparer``); the last takes all that are left.
TRIES = (0, None)
ENTRY = np.dtype([("id", "<u8"), ("key", "<i8"), ("size", "<u4"), ("left", "<u4")])


def overlap_needed(a, b, percent: int):
    """Least intersection of two linked sets: 100 i >= p (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _frequency_counter(n: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        some = False
        for _, part in (x for batch in batches for x in textkit.slices(batch.column(0))):
            grams, _ = textkit.shingles(textkit.Words(part), n)
            classes, times = np.unique(grams >> np.uint64(64 - bits), return_counts=True)
            total[classes] += times.astype(np.uint32)
            some = some or len(grams) > 0
        if some:
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    return count


def _frequency_sum(final: bool):
    """Sums of the tasks' tables, part by part; in the end their levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns[:2])):
                counts = np.frombuffer(zlib.decompress(counts), "<u4").astype(np.uint64)
                total[part] = total[part] + counts if part in total else counts
        for part, counts in total.items():
            made = zlib.compress(_levels(counts).tobytes(), 1) if final else zlib.compress(np.minimum(counts, 2**32 - 1).astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.binary())], names=["part", "counts"])

    return add


def _levels(counts: np.ndarray) -> np.ndarray:
    """Frequencies as 6 bits, in their order: by halves of powers of two."""
    return np.minimum(np.floor(2 * np.log2(counts + 1.0)), 63).astype(np.uint8)


def frequency_levels(docs: DataFrame, text: str, n: int, bits: int) -> np.ndarray:
    """The 6-bit level of each of 2^bits classes of hashes; tasks' tables are summed in groups first."""
    counted = docs.select(column(text).cast("string").alias("text")).mapInArrow(_frequency_counter(n, bits), "part int, counts binary")
    grouped = counted.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(4))).repartition(4 * PARTS, "part", "group").mapInArrow(_frequency_sum(False), "part int, counts binary")
    levels = np.zeros((PARTS, (1 << bits) // PARTS), np.uint8)
    for part, level in grouped.repartition(PARTS, "part").mapInArrow(_frequency_sum(True), "part int, counts binary").collect():
        levels[part] = np.frombuffer(zlib.decompress(level), np.uint8)
    return levels.ravel()


def _sets(texts: pa.Array, n: int, levels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each text that has words, and its set of ids, rarest first."""
    for row, part in textkit.slices(texts):
        grams, bounds = textkit.shingles(textkit.Words(part), n)
        level = levels[(grams >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)].astype(np.uint64)
        ids = (level << np.uint64(58)) | (textkit.mix(grams) >> np.uint64(6))
        for d in np.flatnonzero(np.diff(bounds)):
            mine = np.sort(ids[bounds[d] : bounds[d + 1]])
            new = np.ones(len(mine), bool)
            np.not_equal(mine[1:], mine[:-1], out=new[1:])
            yield row + d, mine[new]


def _keys(ids: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set: mixed from the size, and the sum and the bitwise sums of its (mixed) ids."""
    odd = ids * np.uint64(0x9E3779B97F4A7C15)
    parts = np.array([np.bitwise_xor.reduce(ids), ids.sum(dtype=np.uint64), np.bitwise_xor.reduce(odd), np.bitwise_xor.reduce(odd >> np.uint64(29))])
    parts[::2] += np.uint64(len(ids))
    a, b = textkit.mix(textkit.mix(parts[::2]) + parts[1::2]).view(np.int64).tolist()
    return a, b


def bitmap(ids: np.ndarray) -> bytes:
    """Of a power of two of bits, ``ID_BITS`` for an id or more: those that an odd number of ids fall on."""
    length = max(64, 1 << (ID_BITS * len(ids) - 1).bit_length())
    times = np.bincount((ids & np.uint64(length - 1)).astype(np.int64), minlength=length)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of half the length: ids fall on the same bit of either half."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between each row of a and the bitmap b: no more than the ids that are in one of the sets only."""
    while a.shape[-1] > b.shape[-1]:
        a = folded(a)
    while b.shape[-1] > a.shape[-1]:
        b = folded(b)
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def may_link(differ, x, y, percent: int):
    """Whether sets of x and y ids that differ in so many bits can be similar enough."""
    return (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((x + y - differ) // 2 >= overlap_needed(x, y, percent))


KEYED = "doc_id long, size long, key long, check long, bits binary"


def _key_maker(levels, n: int):
    """Size, fingerprints and, where a set occurs first in a task, bitmap of each text; further columns follow."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, key, check = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            bits: list[bytes | None] = [None] * batch.num_rows
            for d, ids in _sets(batch.column(1), n, levels.value):
                size[d], (key[d], check[d]) = len(ids), _keys(ids)
                if int(key[d]) not in seen:
                    seen.add(int(key[d]))
                    bits[d] = bitmap(ids)
            if len(seen) > 1_000_000:  # bounded memory; a repeated bitmap costs bytes only
                seen.clear()
            columns = [batch.column(0), *map(pa.array, (size, key, check)), pa.array(bits, pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "key", "check", "bits", *(f"x{k}" for k in range(batch.num_columns - 2))])

    return make


def _prefix_maker(levels, n: int, percent: int, n_ranges: int):
    """Entries of the prefixes in one binary for each range of ids; a set that occurs again in the task is left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(parts)
            rng = ((textkit.mix(entries["id"]) >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(rng, kind="stable")
            entries, rng = entries[order], rng[order]
            found, at = np.unique(rng, return_index=True)
            binaries = [x.tobytes() for x in np.split(entries, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(binaries, pa.binary())], names=["rng", "entries"])

        for batch in batches:
            for _, ids in _sets(batch.column(0), n, levels.value):
                key, _ = _keys(ids)
                if key in seen:
                    continue
                seen.add(key)
                if len(seen) > 1_000_000:  # bounded memory; a repeated set costs time only
                    seen.clear()
                size = len(ids)
                prefix = size - -(-percent * size // 100) + 1
                entry = np.empty(prefix, ENTRY)
                entry["id"], entry["key"], entry["size"] = ids[:prefix], key, size
                entry["left"] = size - np.arange(prefix)  # ids from this one on
                parts.append(entry)
                waiting += prefix
                if waiting > 1 << 20:
                    yield flush()
                    parts, waiting = [], 0
        if parts:
            yield flush()

    return make


def _passes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters of entries that share an id."""
    x, y = a["size"].astype(np.int64), b["size"].astype(np.int64)
    short, long = np.minimum(x, y), np.maximum(x, y)
    return (100 * short >= percent * long) & (np.minimum(a["left"], b["left"]) >= overlap_needed(x, y, percent)) & (a["key"] != b["key"])


def _pair_maker(percent: int):
    """Pairs of each id's sets with the least of them; of ids with three sets or more also the sets, for later."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, ENTRY) for batch in batches for x in batch.column(1).to_pylist()]
        if not parts:
            return
        entries = np.concatenate(parts)
        del parts
        ids = np.sort(entries["id"])
        shared = np.unique(ids[1:][ids[1:] == ids[:-1]])
        if not len(shared):
            return
        del ids
        place = np.minimum(np.searchsorted(shared, entries["id"]), len(shared) - 1)
        entries = entries[shared[place] == entries["id"]]
        entries = entries[np.lexsort([entries["key"], entries["id"]])]
        same = np.zeros(len(entries), bool)
        same[1:] = (entries["id"][1:] == entries["id"][:-1]) & (entries["key"][1:] == entries["key"][:-1])
        entries = entries[~same]
        begin = np.flatnonzero(np.concatenate([[True], entries["id"][1:] != entries["id"][:-1]]))
        sizes = np.diff(np.append(begin, len(entries)))
        hub = entries[np.repeat(begin, sizes)]
        good = _passes(hub, entries, percent)
        pairs = np.unique(np.stack([hub["key"][good], entries["key"][good]]), axis=1)
        yield _rows(pairs[0], pairs[1])
        # Groups with equal sets need to be looked at once; the best place of each set stands for all.
        groups: dict[bytes, np.ndarray] = {}
        for a, b in zip(begin[sizes > 2], (begin + sizes)[sizes > 2]):
            group = entries[a:b]
            name = group["key"].tobytes()
            if name in groups:
                np.maximum(groups[name]["left"], group["left"], out=groups[name]["left"])
            else:
                groups[name] = group.copy()
        for name, group in groups.items():
            g = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
            yield _rows(group["key"], np.full(len(group), g), group["size"], group["left"])

    return make


PAIR_SCHEMA = "a long, b long, size long, left long"


def _rows(a, b, size=None, left=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    size, left = (zero if x is None else x.astype(np.int64) for x in (size, left))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a, b, size, left)], names=["a", "b", "size", "left"])


class Block:
    """Some sets by their bitmaps, to be compared with one set after another."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        by_length: dict[int, list] = {}
        for row in rows:
            by_length.setdefault(len(row[3]), []).append(row)
        self.parts = []
        for _, mine in sorted(by_length.items()):
            mine.sort(key=lambda r: r[2])
            keys, roots, sizes = (np.array([r[k] for r in mine], np.int64) for k in range(3))
            self.parts.append((keys, roots, sizes, np.frombuffer(b"".join(r[3] for r in mine), "<u8").reshape(len(mine), -1)))

    def near(self, size: int, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and roots of the sets that may link with one of so many ids, those that differ least first."""
        found = [(np.empty(0, np.int64),) * 3]
        for keys, roots, sizes, maps in self.parts:
            low, high = np.searchsorted(sizes, -(-percent * size // 100)), np.searchsorted(sizes, 100 * size // percent, "right")
            if low < high:
                differ = differences(maps[low:high], bits)
                good = np.flatnonzero(may_link(differ, sizes[low:high], size, percent))
                found.append((differ[good], keys[low:high][good], roots[low:high][good]))
        differ, keys, roots = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([keys, differ])
        return keys[order], roots[order]


def _block_comparer(percent: int, most: int | None):
    """Rows sorted by label, block, role, key and bad: the sets of a block (role 0), then those to compare with them (role 1), each followed by
    the sets (bad) that it was verified with in vain. Gives pairs (a, b), a < b, that may link: with ``most`` 0 those that join components
    which no pair given for the block joins yet, else so many for each set and component, the likeliest first; None: all. If both sets of
    a pair have role 1, it is looked at with the larger key in the block.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, rows = None, None, []
        joined: dict[int, int] = {}
        mine, bad = None, set()

        def find(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                joined[x] = x = joined.get(up, up)
            return x

        def pairs() -> Iterator[tuple[int, int]]:
            key, root, size, bits, top = mine
            keys, roots = block.near(size, np.frombuffer(bits, "<u8"), percent)
            good = (roots != root) & ((roots == top) | (keys > key))
            given: dict[int, int] = {}
            for other, other_root in zip(keys[good].tolist(), roots[good].tolist()):
                if other in bad:
                    continue
                if most == 0:
                    if (a := find(root)) == (b := find(other_root)):
                        continue
                    joined[a] = b
                elif most is not None:
                    given[other_root] = given.get(other_root, 0) + 1
                    if given[other_root] > most:
                        continue
                yield min(key, other), max(key, other)

        for batch in batches:
            found: list[tuple[int, int]] = []
            for label, number, role, key, bad_key, root, size, top, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if bad_key is not None:
                    bad.add(bad_key)
                    continue
                if mine is not None:
                    found += pairs()
                    mine = None
                if name != (label, number):
                    name, block, rows = (label, number), None, []
                    joined.clear()
                if role == 0:
                    rows.append((key, root, size, bits))
                elif rows or block:
                    if block is None:
                        block, rows = Block(rows), []
                    mine, bad = (key, root, size, bits, top), set()
            if found:
                yield _links(found)
        if mine is not None and (found := list(pairs())):
            yield _links(found)

    return compare


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])


def _unit_maker(percent: int):
    """Rows sorted by group: label and key of the sets that pass the length and positional filters with a set of another component.

    Of groups above ``GROUP_SETS`` all sets are given: the bitmaps tell them apart.
    """

    def units(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        _, label, root, key, size, left = (np.concatenate(x) for x in zip(*rows))
        good = np.ones(len(key), bool)
        if len(key) <= GROUP_SETS:
            for low in range(0, len(key), 512):
                x, l = size[low : low + 512, None], left[low : low + 512, None]
                short, long = np.minimum(x, size), np.maximum(x, size)
                near = (100 * short >= percent * long) & (np.minimum(l, left) >= overlap_needed(x, size, percent)) & (root[low : low + 512, None] != root)
                good[low : low + 512] = near.any(axis=1)
        return label[good], key[good]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            at = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            for part in zip(*(np.split(r, at) for r in rows)):
                if held and held[0][0][0] != part[0][0]:
                    found.append(units(held))
                    held = []
                held.append(part)
            if len(found) > 10_000:
                yield _pairs_once(found)
                found = []
        if held:
            found.append(units(held))
        if found:
            yield _pairs_once(found)

    return make


def _pairs_once(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], names=["label", "key"])


def _still_apart(units: DataFrame, maps: DataFrame, roots: DataFrame, failed: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b) to verify: of sets with one label that are in different components. units: label, key; maps: key, size, bits.

    All is decided without the bitmaps; they are joined to what is compared.
    """
    of = roots.select(F.col("id").alias("key"), "root")
    rows = units.join(of, "key", "left").withColumn("root", F.coalesce("root", "key"))
    tops = roots.select(F.col("id").alias("label"), F.col("root").alias("top"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("ids"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("ids") * ID_BITS / (8 * BLOCK_BYTES)))
    sizes = sizes.join(tops, "label", "left").select("label", F.coalesce("top", "label").alias("top"), blocks.alias("blocks"))
    rows = rows.join(sizes, "label")
    none = F.lit(None).cast("long")
    own = rows.select("label", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"), F.lit(0).alias("role"), "key", none.alias("bad"), "root", "top")
    guests = rows.where("root <> top")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    others = guests.select("label", every, F.lit(1).alias("role"), "key", none.alias("bad"), "root", "top")
    placed = own.union(others).join(maps, "key").select("label", "block", "role", "key", "bad", "root", "size", "top", "bits")
    vain = guests.select("label", "key", "blocks").join(failed.union(failed.select("b", "a")).toDF("key", "bad"), "key")
    vain = vain.select("label", F.pmod(F.xxhash64("bad"), F.col("blocks")).alias("block"), F.lit(1).alias("role"), "key", "bad", none, none, none, F.lit(None).cast("binary"))
    placed = placed.union(vain).repartition("label", "block").sortWithinPartitions("label", "block", "role", "key", F.col("bad").asc_nulls_first())
    return placed.mapInArrow(_block_comparer(percent, most), "a long, b long").distinct()


def _needed_sets(keys: DataFrame, rows: DataFrame, sets: DataFrame, levels, n: int) -> DataFrame:
    """key, ids of the sets whose keys are in the column ``key``, and of few others: a bitmap with 16 bits a set, or 16 MB if that is less, decides.

    A set is sent by the document with the least id of those that have it.
    """
    spark = keys.sparkSession
    wanted = cut(keys.distinct().join(sets.select("key", "least"), "key"), small=True)
    size = min(NEEDED_BITS, max(15, (16 * wanted.count()).bit_length()))
    slots = wanted.select(_slot(F.col("key"), F.col("least"), size).alias("slot"))
    maps = slots.groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
    bits = bytearray((1 << size) // 8)
    for part, one in maps.collect():  # 4,096 rows of 4 KB at most
        bits[part * 4096 : part * 4096 + 4096] = one
    needed = spark.sparkContext.broadcast((size, bytes(bits)))
    found = rows.mapInArrow(_set_maker(levels, n, needed), "key long, ids binary").join(wanted.select("key"), "key", "left_semi")
    return found.groupBy("key").agg(F.first("ids").alias("ids"))


def _packed(ids: np.ndarray) -> bytes:
    """The ids' lower 48 bits, sorted, 6 bytes each: two of a pair's ids are equal by chance once in 2^48."""
    return np.sort(ids & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed) -> np.ndarray:
    six = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _slot(key, least, bits: int):
    """Place in the bitmap of a set that the document with the least id sends; the same for columns and numbers."""
    if isinstance(key, Column):
        least = F.coalesce(least, F.lit(0).cast("long"))
        return F.pmod(key.bitwiseXOR(F.shiftleft(least, 17)).bitwiseXOR(F.shiftright(least, 9)), F.lit(1 << bits))
    least = least or 0
    return (key ^ (least << 17) ^ (least >> 9)) % (1 << bits)


def _set_maker(levels, n: int, needed):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, bits = needed.value
        bits = np.frombuffer(bits, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            keys, sets, names = [], [], batch.column(0).to_pylist()
            for d, ids in _sets(batch.column(1), n, levels.value):
                key, _ = _keys(ids)
                slot = _slot(key, names[d], size)
                if bits[slot >> 3] >> (slot & 7) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(_packed(ids))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets, pa.binary())], names=["key", "ids"])

    return make


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Suffix filter, then the intersection, of two sorted sets of ids."""
    if len(a) < len(b):
        a, b = b, a
    need = overlap_needed(len(a), len(b), percent)
    if len(b) < need:
        return False
    if len(b) > 64:
        # Between the places of a few ids of b the sets can share no more than the shorter stretch.
        mine = np.arange(0, len(b), len(b) // 8)
        theirs = np.searchsorted(a, b[mine])
        if np.minimum(np.diff(mine, append=len(b)), np.diff(theirs, append=len(a))).sum() < need:
            return False
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) >= need


def _verifier(percent: int):
    """Rows sorted by set and chunk, the set itself (other is null) before its pairs."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, other, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                ids = _unpacked(ids.as_buffer())
                if other is None:
                    hub, own = a, ids
                elif a == hub and linked(own, ids, percent):
                    found.append((a, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["a", "b"])

    return verify


def _possible(percent: int):
    """Rows as for ``_verifier``, with bitmaps and sizes: the pairs whose bitmaps differ little enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, own_size = None, None, 0
        for batch in batches:
            found = []
            for a, _, other, bits, size in zip(*(c.to_pylist() for c in batch.columns)):
                bits = np.frombuffer(bits, "<u8")
                if other is None:
                    hub, own, own_size = a, bits, size
                elif a == hub and may_link(differences(own, bits), own_size, size, percent):
                    found.append((a, other))
            if found:
                yield _links(found)

    return check


def _dealt(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, chunk, other (null: a itself), and the other columns of ``sets`` (key, …): the pairs of one set in chunks, each with that set in front."""
    rest = [c for c in sets.columns if c != "key"]
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    hubs = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    own = hubs.join(sets, hubs.a == sets.key).select("a", "chunk", F.lit(None).cast("long").alias("other"), *rest)
    others = dealt.join(sets, dealt.b == sets.key).select("a", "chunk", F.col("b").alias("other"), *rest)
    return own.union(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("other").asc_nulls_first())


def _verified(pairs: DataFrame, rows: DataFrame, known: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; each pair once."""
    sets = _needed_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")), rows, known, levels, n)
    return _dealt(pairs, sets).mapInArrow(_verifier(percent), "a long, b long")


def _grouped(docs: DataFrame, extra: list[Column], doc_id: str, text: str, n: int, percent: int, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, ``extra``, size and key of each row; and key, root of each set: the component that it is in."""
    spark = docs.sparkSession
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    texts = rows.select("text")
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (total // CLASS_BYTES).bit_length()))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, text, n, bits))
    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"), *extra)
    keyed = cut(given.mapInArrow(_key_maker(levels, n), KEYED + "".join(f", x{k} long" for k in range(len(extra)))))
    sets = cut(keyed.where("size > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.max("size").alias("size")))
    total, clash = sets.agg(F.sum("size"), F.count_if(F.col("c0") != F.col("c1"))).first()
    if clash:
        raise ValueError("different sets have one fingerprint")
    n_ranges = max(1, -(-int((total or 0) * (100 - percent) / 100 * ENTRY.itemsize) // range_bytes))
    index = texts.mapInArrow(_prefix_maker(levels, n, percent, n_ranges), "rng int, entries binary").repartitionById(n_ranges, F.col("rng"))
    made = cut(index.mapInArrow(_pair_maker(percent), PAIR_SCHEMA))
    pairs = made.where("left = 0").select("a", "b").distinct()
    groups = made.where("left > 0").groupBy(F.col("b").alias("grp"), F.col("a").alias("key")).agg(F.max("size").alias("size"), F.max("left").alias("left"))
    shared = made.select(F.explode(F.when(F.col("left") == 0, F.array("a", "b")).otherwise(F.array("a"))).alias("key")).distinct()
    maps = cut(keyed.where("bits is not null").select("key", "bits", "size").join(shared, "key", "left_semi").groupBy("key").agg(F.first("bits").alias("bits"), F.first("size").alias("size")))
    pairs = cut(_dealt(pairs, maps).mapInArrow(_possible(percent), "a long, b long"), small=True)
    links = cut(_verified(pairs, rows, sets, levels, n, percent), small=True)
    failed = pairs.join(links, ["a", "b"], "left_anti")
    roots = components(links)
    # What the first links have not joined: ids whose sets are in more than one component, under the name of the one with most.
    groups = groups.join(roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(8)))
    tops = groups.groupBy("grp", "root").count().groupBy("grp").agg(F.max_by("root", "count").alias("label"), F.count("*").alias("roots")).where("roots > 1")
    tops = tops.select("grp", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("salt"))
    mixed = groups.join(tops, ["grp", "salt"]).select("grp", "label", "root", "key", "size", "left").repartition("grp").sortWithinPartitions("grp")
    units = mixed.mapInArrow(_unit_maker(percent), "label long, key long").distinct()
    units = cut(units.join(maps.select("key", "size"), "key").select("label", "key", "size"), small=True)
    for most in TRIES:
        apart = cut(_still_apart(units, maps, roots, failed, percent, most), small=True)
        if apart.isEmpty():
            break
        good = cut(_verified(apart, rows, sets, levels, n, percent), small=True)
        failed = cut(failed.union(apart.join(good, ["a", "b"], "left_anti")), small=True)
        roots = extended(roots, good)
    named = sets.select("key", "least").join(roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return keyed.drop("bits", "check"), named


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; component_id is the least doc_id reachable by links.

    Two texts link when 100 times the intersection of their sets of n-grams is at least ``percent`` times
    the union. A text with fewer than ``n`` words has one n-gram, all its words; a null text, or one
    without words, has none and links with nothing. Rows with equal ids count by themselves, with the
    ids as names; a row with a null id is in its component but names none, and has a null component_id
    where all are null. Extra columns are not read. An empty table gives an empty result. Sets are
    compared whole. Two different sets with one fingerprint raise an error rather than mix.
    """
    keyed, named = _grouped(docs, [], doc_id, text, n, percent, range_bytes)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select(F.col("key").alias("of"), "component_id")
    out = keyed.join(found, (F.col("key") == F.col("of")) & (F.col("size") > 0), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are in another one's group: one row of each group of linked documents stays, with all its columns.

    It is a row with the least id of the group (null ids last); between rows with that id the least hash of
    the whole row decides, and of rows that are equal in all columns one stays. Rows are told apart by two
    64-bit hashes of all columns, never by their id alone, so a document whose id repeats with another
    text stays unless its own group has another row. Texts without words, and null ones, link with nothing:
    each such row stays, repeats included. Extra columns keep their names, whatever they are. An empty table
    gives an empty result.
    """
    every = [F.to_json(F.struct(*(column(c).alias(str(k)) for k, c in enumerate(docs.columns))), {"ignoreNullFields": "false"})]
    hashes = [F.xxhash64(F.lit(k), *every) for k in (1, 2)]
    keyed, named = _grouped(docs, [h.alias(f"x{k}") for k, h in enumerate(hashes)], doc_id, text, n, percent, RANGE_BYTES)
    members = keyed.where("size > 0").join(named.select("key", "root"), "key")
    stay = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "x0", "x1")).alias("stay")).select("stay.x0", "stay.x1")
    names = []
    for wanted in ("row_a", "row_b", "stay_a", "stay_b"):
        names.append(free_name([*docs.columns, *names], wanted))
    wordless = F.translate(F.coalesce(column(text).cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "") == ""
    rows = docs.where(~wordless).withColumns(dict(zip(names, hashes)))
    rows = rows.join(stay.toDF(*names[2:]), (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])), "left_semi")
    return rows.dropDuplicates(names[:2]).drop(*names[:2]).union(docs.where(wordless))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under a Jaccard similarity of five-word shingles of 0.75 or more."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {WORDS - 1}], chr(31))) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= {PERCENT} * (nx.n + ny.n - i)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (
  SELECT x, min(y) AS y FROM r GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""
