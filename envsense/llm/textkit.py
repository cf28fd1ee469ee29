"""Words and word n-grams of Arrow string columns as hashes, with numpy only.

A word is a run of bytes other than blanks (space, tab to carriage return); A-Z are lowered. Blanks and
letters are ASCII, so bytes of longer UTF-8 characters are never touched. A word's hash mixes its length
and all of its 8-byte blocks; an n-gram's hash mixes the hashes of its words by place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: ASCII punctuation as blanks too.
_PUNCTUATION = _BLANK.copy()
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit integers (two rounds of multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, most: int = 1 << 22):
    """(first row, slice) of stretches of about ``most`` bytes at most; a longer text is a stretch of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield row, texts.slice(row, stop - row)
        row = stop


class Words:
    """The words of a column of texts; ``first[d]``:``first[d + 1]`` are those of text d. Null texts have none.

    ``punctuation``: ASCII punctuation separates words too. ``separators``: a table of the bytes that do, instead.
    """

    def __init__(self, texts: pa.Array, punctuation: bool = False, separators: np.ndarray | None = None):
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = _LOWER[data]
        self.data, self.offsets = padded, offsets
        inside = np.zeros(n + 1, bool)
        np.logical_not((separators if separators is not None else _PUNCTUATION if punctuation else _BLANK)[data], out=inside[:n])
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        starts = inside & (~before | cut)
        stops = before & (~inside | cut)
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(stops)
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        blocks = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        lengths = self.ends - self.starts
        h = mix((blocks[self.starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _PLACES[0])
        long, k = np.flatnonzero(lengths > 8), 8
        while len(long):
            part = blocks[self.starts[long] + k] & _MASKS[np.minimum(lengths[long] - k, 8)]
            h[long] = mix(h[long] * _PLACES[1] + part)
            k += 8
            long = long[lengths[long] > k]
        return h

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n word hashes (also across texts: see ``valid``)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _PLACES[0]
    for k in range(1, n):
        out += mix(h[k : k + m] + np.uint64(k)) * _PLACES[k % 5]
    return mix(out)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, and where each text's begin: a text with fewer words has one, of all of them; a text without words none."""
    h = words.hashes()
    first = words.first
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    grams = ngrams(h, n)
    # Place of each text's i-th n-gram among all windows: the text's first word plus i.
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], sizes)
    out = grams[np.minimum(place, max(len(grams) - 1, 0))] if len(grams) else np.zeros(bounds[-1], np.uint64)
    for d in np.flatnonzero((counts < n) & (counts > 0)):
        few = h[first[d] : first[d + 1]]
        out[bounds[d]] = ngrams(few, len(few))[0] ^ np.uint64(len(few))
    return out, bounds
