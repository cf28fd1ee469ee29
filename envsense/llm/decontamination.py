"""Operator 10: documents that hold test items, copied or edited.

Seeds are pairs of words of an item that are neighbours or have one word between them, looked for in the
documents in the same two forms. They miss nothing: an
alignment with m matches over an item of w words that scores at least s = max(w, 16) has errors of 2m - s
at most, which leave at least s / 2 - 1 steps from one match to the next with one error or none, and each
such step is a shared pair at its own word of the document and its own word of the item. So of an item's
w - 1 words that begin pairs, any w - s / 2 + 1 include one that is shared: the rarest so many, by the
occurrences of their pairs in all documents, are its rare seeds, and a document without one of them is not
looked at for the item. Where shared pairs then lie as close as they must within the 2w words that an
alignment can span (w or fewer matches, w or fewer errors), the item is aligned with that stretch by
Smith-Waterman; the best score of a document and item, as a share of a perfect match, decides. Items of
8 words or fewer must match whole. With ``n`` above 2 seeds are n neighbouring words, one is enough, and
edits that leave no n words together are missed.

The test items are the query set. They are read in blocks of bounded size, and each block is broadcast,
so any number of items works, with two passes over the documents for each block, one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import column, cut

#: Words of a seed; least seeds of an item; documents of a rare n-gram, and times the item's median; share of a perfect score that is contamination; words that must match at least (all words of shorter items).
SEED_WORDS, LEAST_SEEDS, RARE, LEAST_SCORE, LEAST_MATCHES = 2, 8, 8, 0.5, 8
#: Fixed values of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Text bytes of the items that are broadcast at a time (some ten times as much in a worker).
BLOCK_BYTES = 4 << 20
#: Counters of pairs, a power of two.
COUNTERS = 1 << 18
#: Cells of the alignments that are worked on at a time, and words that one stretch of a document may have.
CELLS, STRETCH = 1 << 21, 4


@dataclass
class Items:
    """A block of test items: word hashes, and the n-grams with the items and places they come from."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray
    rare: np.ndarray | None = None  # the rare seeds, sorted, and their items; without them all n-grams are seeds
    rare_item: np.ndarray | None = None

    def filter(self) -> np.ndarray:
        """A table of bits that is true for the n-grams' upper 20 bits."""
        return _bits(self.grams)


def _bits(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(grams >> np.uint64(44)).astype(np.int64)] = True
    return bits


def _pairs(h: np.ndarray, first: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words ``gap`` apart within a text, and their first words."""
    at = np.arange(max(0, len(h) - gap))
    if gap:
        ends = np.repeat(first[1:], np.diff(first))
        at = at[at + gap < ends[at]]
    return textkit.mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + textkit.mix(h[at + gap] + np.uint64(1))), at


def index_items(ids: list, texts: list[str | None], n: int) -> Items:
    words = textkit.Words(pa.array(texts, pa.string()), punctuation=True)
    h = words.hashes()
    owner = np.repeat(np.arange(len(ids)), np.diff(words.first))
    if n > 2:
        grams = textkit.ngrams(h, n)
        at = np.arange(len(grams))
        at = at[at + n <= words.first[owner[at] + 1]]
        found = grams[at]
    else:
        found, at = (np.concatenate(x) for x in zip(*(_pairs(h, words.first, gap) for gap in (1, 2))))
        # A word alone is a pair with itself; one row for a pair of an item is enough.
        alone = words.first[:-1][np.diff(words.first) == 1]
        found, at = np.append(found, _pairs(h[alone], np.arange(len(alone) + 1), 0)[0]), np.append(at, alone)
        _, one = np.unique(np.stack([found, owner[at].astype(np.uint64)]), axis=1, return_index=True)
        found, at = found[one], at[one]
    item = owner[at]
    order = np.argsort(found, kind="stable")
    return Items(np.array(ids, np.int64), h, words.first, found[order], item[order], (at - words.first[item])[order])


def rare_seeds(items: Items, counts: np.ndarray, least_score: float = LEAST_SCORE) -> Items:
    """The items with their rare seeds: pairs of so many words of each item that no alignment that passes misses all of them.

    counts: occurrences of pairs in the documents, by the upper bits of their hashes (a power of two of them).
    """
    h, first = items.words, items.first
    length, shift = np.diff(first), np.uint64(64 - int(len(counts)).bit_length() + 1)
    owner = np.repeat(np.arange(len(length)), length)
    pairs = [_pairs(h, first, gap) for gap in (1, 2)]
    rarity = np.zeros(len(h), np.int64)
    for found, at in pairs:
        rarity[at] += counts[(found >> shift).astype(np.int64)]
    begins = np.flatnonzero(np.arange(len(h)) + 1 < first[1:][owner]) if len(h) else np.empty(0, np.int64)
    order = begins[np.lexsort([begins, rarity[begins], owner[begins]])]
    many = np.maximum(length - 1, 0)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)
    keep = np.zeros(len(h), bool)
    keep[order[rank < (many - least_seeds(length, 2, least_score) + 1)[owner[order]]]] = True
    alone = first[:-1][length == 1]
    grams = np.concatenate([*(found[keep[at]] for found, at in pairs), _pairs(h[alone], np.arange(len(alone) + 1), 0)[0]])
    item = np.concatenate([*(owner[at[keep[at]]] for _, at in pairs), owner[alone]])
    by = np.lexsort([item, grams])
    return replace(items, rare=grams[by], rare_item=item[by])


def _found(items: Items, words: textkit.Words, pairs: list[tuple[np.ndarray, np.ndarray]], owner: np.ndarray) -> np.ndarray:
    """text * number of items + item, sorted, of the texts and items that share a rare seed."""
    bits, keys = _bits(items.rare), []
    for grams, at in pairs:
        may = np.flatnonzero(bits[(grams >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(items.rare, grams[may])
        many = np.searchsorted(items.rare, grams[may], "right") - low
        each = np.repeat(np.arange(len(may)), many)
        rows = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        keys.append(owner[at[may[each]]] * len(items.ids) + items.rare_item[rows])
    return np.unique(np.concatenate(keys))


def _matches(items: Items, bits: np.ndarray, texts: pa.Array, n: int):
    """words, their hashes, the places (word, row of its first n-gram in ``items.grams``) of shared n-grams, and ``_found`` (None: any).

    With rare seeds, n-grams are looked for in the texts that share one."""
    words = textkit.Words(texts, punctuation=True)
    h = words.hashes()
    parts = []
    alone = bool((np.diff(items.first) == 1).any())
    keys = mask = None
    if n <= 2 and items.rare is not None:
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        pairs = [_pairs(h, words.first, gap) for gap in ((0, 1, 2) if alone else (1, 2))]
        keys = _found(items, words, pairs, owner)
        mask = np.zeros(len(texts), bool)
        mask[keys // max(1, len(items.ids))] = True
        mask = mask[owner]
    for k, gap in enumerate((None,) if n > 2 else (0, 1, 2) if alone else (1, 2)):
        if mask is not None:
            grams, at = pairs[k]
            inside = mask[at]
            grams, at = grams[inside], at[inside]
        elif gap is None:
            grams = textkit.ngrams(h, n)
            at = np.arange(len(grams))
        else:
            grams, at = _pairs(h, words.first, gap)
        may = np.flatnonzero(bits[(grams >> np.uint64(44)).astype(np.int64)])
        grams, at = grams[may], at[may]
        row = np.searchsorted(items.grams, grams)
        same = row < len(items.grams)
        same[same] = items.grams[row[same]] == grams[same]
        at, row = at[same], row[same]
        text = np.searchsorted(words.first, at, "right") - 1
        inside = at + (n if gap is None else 0) <= words.first[text + 1]
        parts.append((at[inside], row[inside], text[inside]))
    return words, h, *(np.concatenate(x) for x in zip(*parts)), keys


def least_seeds(length: np.ndarray, n: int, least_score: float) -> np.ndarray:
    """Words of a stretch that begin a seed at least, for items of so many words."""
    whole = np.maximum(1, length - 1)
    return np.ones_like(length) if n > 2 else np.where(length <= LEAST_MATCHES, whole, (np.maximum(np.floor(MATCH * least_score * length), 2 * LEAST_MATCHES).astype(np.int64) - 1) // 2)


def choose_seeds(items: Items, docs_with: np.ndarray, least: int = LEAST_SEEDS) -> Items:
    """The items with their rarest n-grams only. Not used by the operator: what edits leave of an item may be what is frequent."""
    if not len(items.grams):
        return items
    same = np.searchsorted(items.grams, items.grams)
    rarity = docs_with[same]
    order = np.lexsort([items.place, items.grams, rarity, items.item])
    sizes = np.bincount(items.item, minlength=len(items.ids))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    median = np.zeros(len(items.ids))
    has = sizes > 0
    middle = (np.cumsum(sizes) - sizes + (sizes - 1) // 2)[has]
    median[has] = rarity[order][middle]
    rare = rarity[order] <= np.maximum(RARE, RARE * median)[items.item[order]]
    keep = np.sort(order[(rank < least) | rare])
    return Items(items.ids, items.words, items.first, items.grams[keep], items.item[keep], items.place[keep])


def align(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman scores of the rows of a against those of b (word hashes, padded).

    One step takes one word of every a; gaps along b come from a running maximum of score plus place.
    """
    k, width = b.shape
    places = np.arange(width, dtype=np.int32) * -GAP
    inside = np.arange(width) < b_len[:, None]
    row, best = np.zeros((k, width + 1), np.int32), np.zeros(k, np.int32)
    for i in range(a.shape[1]):
        same = (b == a[:, i : i + 1]) & inside
        up = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(up, 0, out=up)
        up += places
        row[:, 1:] = np.maximum.accumulate(up, axis=1) - places
        row[:, 1:][~inside] = 0
        best = np.where(i < a_len, np.maximum(best, row.max(axis=1)), best)
    return best


def find(items: Items, bits: np.ndarray, texts: pa.Array, n: int, least_score: float = LEAST_SCORE):
    """(text, item, best score, seeds) for each text and item with enough seeds together."""
    words, h, at, row, text, keys = _matches(items, bits, texts, n)
    # All items of an n-gram: rows row, row + 1, … of the sorted n-grams.
    more = np.searchsorted(items.grams, items.grams[row], "right") - row
    each = np.repeat(np.arange(len(row)), more)
    rows = row[each] + np.arange(len(each)) - np.repeat(np.cumsum(more) - more, more)
    text, at, item = text[each], at[each], items.item[rows]
    if keys is not None:
        own = text * len(items.ids) + item
        place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        good = keys[place] == own if len(keys) else np.zeros(len(own), bool)
        text, at, item = text[good], at[good], item[good]
    if not len(text):
        return (np.empty(0, np.int64),) * 4
    # One seed for a word and item; texts lie behind each other, so word numbers tell them apart.
    key = np.unique(item.astype(np.int64) * (len(h) + 1) + at)
    item, at = key // (len(h) + 1), key % (len(h) + 1)
    text = np.searchsorted(words.first, at, "right") - 1
    length = np.diff(items.first)
    # Words that an alignment spans, in lengths of the item.
    reach = 2 if least_score >= LEAST_SCORE else 3
    # Seeds of a run of as many as are needed within the words of an alignment.
    need, held = least_seeds(length[item], n, least_score), np.arange(len(at))
    last = held + need - 1
    full = last < len(at)
    there = np.minimum(last, len(at) - 1)
    full &= (item[there] == item) & (text[there] == text) & (at[there] - at <= reach * length[item])
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, held[full], 1)
    np.add.at(edge, last[full] + 1, -1)
    good = np.cumsum(edge[:-1]) > 0
    text, item, at = text[good], item[good], at[good]
    if not len(text):
        return (np.empty(0, np.int64),) * 4
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > reach * length[item[1:]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    # A group of seeds over a long stretch is cut into stretches of a few lengths that overlap by what an alignment spans.
    t, i = text[begin], item[begin]
    low = np.maximum(at[begin] - reach * length[i], words.first[t])
    high = np.minimum(at[end] + reach * length[i] + 1, words.first[t + 1])
    step = (STRETCH - reach) * length[i]
    parts = np.maximum(1, -(-(high - low - reach * length[i]) // step))
    own = np.repeat(np.arange(len(t)), parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = low[own] + nth * step[own], np.minimum(high[own], low[own] + nth * step[own] + STRETCH * length[i][own])
    who, what = t[own], i[own]
    score = np.zeros(len(own), np.int32)
    order = np.lexsort([high - low, length[what]])
    k = 0
    while k < len(order):
        tall = length[what[order[k]]]
        count = max(1, int(CELLS // max(1, tall * (high - low)[order[k]])))
        mine = order[k : k + count]
        mine = mine[length[what[mine]] <= max(8, 2 * tall)]
        a = _gather(items.words, items.first[what[mine]], length[what[mine]])
        b = _gather(h, low[mine], (high - low)[mine])
        score[mine] = align(a, length[what[mine]], b, (high - low)[mine])
        k += len(mine)
    pair, back = np.unique(np.stack([who, what]), axis=1, return_inverse=True)
    back = back.ravel()
    best = np.zeros(pair.shape[1], np.int64)
    np.maximum.at(best, back, score)
    seeds = np.zeros(pair.shape[1], np.int64)
    np.add.at(seeds, back[np.searchsorted(own, np.arange(len(t)))], end - begin + 1)
    return pair[0], pair[1], best, seeds


def _gather(values: np.ndarray, low: np.ndarray, length: np.ndarray) -> np.ndarray:
    place = low[:, None] + np.arange(max(1, int(length.max())))
    return values[np.minimum(place, len(values) - 1)]


def _leaks(items: Items, bits: np.ndarray, texts: pa.Array, n: int, least_score: float):
    """text, item, share of a perfect score and seeds of what counts as contamination."""
    parts = [(np.empty(0, np.int64),) * 4]
    for row, part in textkit.slices(texts):
        text, *rest = find(items, bits, part, n, least_score)
        parts.append((text + row, *rest))
    text, item, best, seeds = (np.concatenate(x) for x in zip(*parts))
    length = np.diff(items.first)[item]
    good = (best >= least_score * MATCH * length) & (best >= MATCH * np.minimum(length, LEAST_MATCHES))
    return text[good], item[good], best[good] / np.maximum(MATCH * length[good], 1), seeds[good]


def pair_counts(docs: DataFrame, text: str, block) -> np.ndarray:
    """Occurrences in all documents of the pairs that may be a block's, in COUNTERS counters by their hashes."""
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = block.value.filter(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, part in textkit.slices(batch.column(0)):
                words = textkit.Words(part, punctuation=True)
                h = words.hashes()
                for gap in (1, 2):
                    grams = _pairs(h, words.first, gap)[0]
                    grams = grams[bits[(grams >> np.uint64(44)).astype(np.int64)]]
                    total += np.bincount((grams >> shift).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    rows = docs.select(column(text).cast("string").alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def by_blocks(benchmark: DataFrame, docs: DataFrame, take, *, item_id: str, item_text: str, text: str, n: int, least_score: float, block_bytes: int) -> None:
    """take(broadcast of a block of items, whether it is the only one), block by block; ``docs`` are counted for rare seeds.

    Of several blocks each must be done with when ``take`` returns: its broadcast is destroyed.
    """
    sc = docs.sparkSession.sparkContext
    rows = benchmark.select(column(item_id).cast("long").alias("id"), column(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    for k in range(n_blocks):
        mine = sorted(map(tuple, rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()))
        block = sc.broadcast(index_items([r[0] for r in mine], [r[1] for r in mine], n))
        if n <= 2 and len(block.value.grams):
            items = rare_seeds(block.value, pair_counts(docs, text, block), least_score)
            block.destroy()
            block = sc.broadcast(items)
        take(block, n_blocks == 1)
        if n_blocks > 1:
            block.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SEED_WORDS, least_score: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score (share of a perfect match), n_seeds (words that begin a shared seed, where enough lie together): documents that hold test items.

    Words are lowered and free of ASCII punctuation. Null and empty texts hold nothing; items without an
    id, a text or a word are not looked for (nor, with ``n`` above 2, those under ``n`` words). Items with one id are found each by itself. A document
    row gives a row for each item that it holds, also with a null or repeated id. Extra columns are not
    read. Empty tables give an empty result. Texts are searched whole, whatever their length.
    """

    def matcher(block):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = block.value.filter()
            for batch in batches:
                t, i, score, seeds = _leaks(block.value, bits, batch.column(1), n, least_score)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array(block.value.ids[i]), pa.array(score), pa.array(seeds)], names=["doc_id", "item_id", "score", "n_seeds"])

        return match

    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    found = []

    def take(block, only: bool) -> None:
        part = rows.mapInArrow(matcher(block), "doc_id long, item_id long, score double, n_seeds long")
        found.append(part if only else cut(part, small=True))

    by_blocks(benchmark, docs, take, item_id=item_id, item_text=item_text, text=text, n=n, least_score=least_score, block_bytes=block_bytes)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SEED_WORDS, least_score: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, with all their columns; see ``leaks``. No document is shuffled."""

    def matcher(block, place: int):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = block.value.filter()
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[_leaks(block.value, bits, batch.column(place), n, least_score)[0]] = False
                yield batch.filter(pa.array(good))

        return match

    kept = [docs]

    def take(block, only: bool) -> None:
        part = kept[0].mapInArrow(matcher(block, docs.columns.index(text)), docs.schema)
        kept[0] = part if only else cut(part)

    by_blocks(benchmark, docs, take, item_id=item_id, item_text=item_text, text=text, n=n, least_score=least_score, block_bytes=block_bytes)
    return kept[0]


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``: one row for each document and item that it holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
