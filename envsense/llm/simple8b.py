"""Simple-8b coding of unsigned integers into 64-bit words, vectorised with numpy.

A word holds a selector in its upper 4 bits and equal-width values in the other 60, the first value
lowest. Selectors 1 to 15 stand for (values in a word, bits of a value); selector 0 is the escape for a
value of more than 60 bits: its payload is the value's position in a separate array of whole values.
Values are coded in blocks, a word never spans two blocks, and the offset of each block's first word is
kept, so any block, or all at once, can be decoded with array operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed values: (values in a word, bits of each) for selectors 1 to 15.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([1] + [n for n, _ in SELECTORS], np.int64)
BLOCK = 4096


@dataclass
class Coded:
    """words; escapes: whole values; offsets: first word of each block, and the end; lengths: values in each block."""

    words: np.ndarray
    escapes: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray


def _steps(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the selector that packs most values from there, and how many it takes before the block's end."""
    n = len(values)
    left = ends - np.arange(n, dtype=np.int32)
    selector = np.zeros(n, np.uint8)
    largest = int(values.max())
    #: For each value the number of selectors too narrow for it.
    narrow = np.zeros(n, np.uint8)
    for _, bits in SELECTORS:
        if largest >> bits:
            narrow += values >= np.uint64(1 << bits)
    for s, (count, bits) in enumerate(SELECTORS, 1):
        if largest >> bits == 0:
            selector[selector == 0] = s
            break
        fit = np.flatnonzero(narrow < s)
        if not len(fit):
            continue
        last = np.append(np.flatnonzero(np.diff(fit) != 1), len(fit) - 1)
        stop = np.repeat(fit[last] + 1, np.diff(last, prepend=-1))
        ok = fit[stop - fit >= np.minimum(left[fit], count)]
        ok = ok[selector[ok] == 0]
        selector[ok] = s
    return selector, np.minimum(left, COUNTS[selector]).astype(np.int32)


def encode(values, lengths=None) -> Coded:
    """Code blocks of the given lengths (default: BLOCK each). Empty input gives no words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if lengths is None:
        lengths = np.full(-(-n // BLOCK), BLOCK, np.int64)
        if n % BLOCK:
            lengths[-1] = n % BLOCK
    lengths = np.asarray(lengths, np.int64)
    if n == 0:
        return Coded(np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(lengths) + 1, np.int64), lengths)
    block_ends = np.cumsum(lengths)
    ends = np.repeat(block_ends, lengths).astype(np.int32)
    selector, step = _steps(values, ends)
    jump = step.tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(120, np.uint64)])
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        count, bits = SELECTORS[s - 1]
        if bits == 0:
            continue
        slots = np.arange(count)
        place = starts[mine, None] + slots
        part = padded[place]
        part[slots >= step[starts[mine]][:, None]] = 0
        words[mine] |= np.bitwise_or.reduce(part << (slots * bits).astype(np.uint64), axis=1)
    offsets = np.searchsorted(starts, np.concatenate([[0], block_ends]))
    return Coded(words, values[starts[chosen == 0]], offsets, lengths)


def decode(coded: Coded) -> np.ndarray:
    """All values, block after block."""
    words, n = coded.words, int(coded.lengths.sum())
    out = np.empty(n, np.uint64)
    if n == 0:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    counts = COUNTS[selector]
    nonempty = coded.lengths > 0
    first, lengths = coded.offsets[:-1][nonempty], coded.lengths[nonempty]
    block_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    ends = np.cumsum(lengths)
    before = np.cumsum(counts) - counts
    place = before - before[first][block_of] + (ends - lengths)[block_of]
    take = np.minimum(counts, ends[block_of] - place)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[place[mine]] = coded.escapes[payload[mine].astype(np.int64)]
            continue
        count, bits = SELECTORS[s - 1]
        slots = np.arange(count)
        inside = slots < take[mine][:, None]
        part = (payload[mine, None] >> (slots * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        out[(place[mine, None] + slots)[inside]] = part[inside]
    return out
