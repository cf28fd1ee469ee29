"""Operator 13: how the words of each source diverge from its language's and from the other sources'.

Tokens come from bytes: a table of 256 classes over the concatenated UTF-8 buffers of a batch gives the
boundaries of all its terms. Their slices are hashed by xxhash and grouped by hash; every slice is compared, byte by
byte, with the first of its group. What a stretch of texts counts for a group and term leaves as one row.

The counts of the terms that a language keeps are dealt to blocks of terms. A task has a block of one language as a
CSR matrix of sources by terms and takes the sums over terms for all pairs of sources with ``reduceat``; terms that a
source lacks have one probability, so they are counted, not stored. Blocks' sums are added up. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .common import column, cut, new_dir, table

#: Documents of a language that a kept term is in, terms listed for a group, counts of a block, cells of a matrix that is worked on at a time.
LEAST_DOCS, TOP, BLOCK, CELLS = 3, 200, 250_000, 1 << 22
#: What one is worth in a probability.
UNIT = 1_000_000_000
#: Bytes that separate terms: ASCII but letters.
SEPARATORS = np.arange(256) < 128
SEPARATORS[[*range(65, 91), *range(97, 123)]] = False
#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTS = "lang string, source string, part string, item string, value long"


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices of ``data``, which must be eight bytes longer than the last; slices of 32 bytes or more one by one."""
    size = ends - starts
    eight, four = (np.ndarray((len(data) - k + 1,), f"<u{k}", data, strides=(1,)) for k in (8, 4))
    h = _P5 + size.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero((size >= 8 * (k + 1)) & (size < 32))
        lane = _rotated(eight[starts[at] + 8 * k] * _P2, 31) * _P1
        h[at] = _rotated(h[at] ^ lane, 27) * _P1 + _P4
    at = np.flatnonzero((size & 4 != 0) & (size < 32))
    h[at] = _rotated(h[at] ^ (four[starts[at] + (size[at] & ~7)].astype(np.uint64) * _P1), 23) * _P2 + _P3
    for k in range(3):
        at = np.flatnonzero((size & 3 > k) & (size < 32))
        h[at] = _rotated(h[at] ^ (data[starts[at] + (size[at] & ~3) + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first (a slice of each group) and group of each slice: those of one group have equal bytes, those of two have not, whatever their hashes."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = ends - starts, first[group]
    odd = size != size[like]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    left, k = np.flatnonzero(~odd), 0
    while len(left):
        mask = masks[np.minimum(size[left] - k, 8)]
        odd[left] |= (eight[starts[left] + k] ^ eight[starts[like[left]] + k]) & mask != 0
        k += 8
        left = left[size[left] > k]
    if odd.any():  # two contents with one hash: told apart by their bytes
        more: dict[bytes, int] = {}
        rest = np.flatnonzero(odd)
        group[rest] = [len(first) + more.setdefault(data[starts[i] : ends[i]].tobytes(), len(more)) for i in rest]
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return first, group


def _counted(group: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """group, term, occurrences and documents, for each group and term of the texts; ``group``: each text's."""
    words = textkit.Words(texts, separators=SEPARATORS)
    starts, ends, data = words.starts, words.ends, words.data
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    first, term = grouped(data, starts, ends, xxhashes(data, starts, ends))
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    pairs, n = np.unique(doc * len(first) + term, return_counts=True)
    cells, of = np.unique(group[pairs // len(first)] * len(first) + pairs % len(first), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(ends[first] - starts[first])])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts[first], np.diff(offsets))
    names = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[inside]))
    return cells // len(first), names.take(pa.array(cells % len(first))), np.bincount(of, n, len(cells)).astype(np.int64), np.bincount(of, minlength=len(cells))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lang, source, text (none null) to rows of ``_COUNTS``, one for each group and term of a stretch of texts."""
    for batch in batches:
        for row, texts in textkit.slices(batch.column(2)):
            names = pa.StructArray.from_arrays([c.slice(row, len(texts)) for c in batch.columns[:2]], names=["lang", "source"])
            known, code = {}, np.empty(len(texts), np.int64)
            for k, name in enumerate(zip(names.field(0).to_pylist(), names.field(1).to_pylist())):
                code[k] = known.setdefault(name, len(known))
            group, term, n, docs = _counted(code, texts)
            at = pa.array(group)
            for start in range(0, len(at), 20_000):
                part = slice(start, start + 20_000)
                of = [pa.array([name[k] for name in known], pa.string()).take(at[part]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*of, term[part], pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly; ``total`` at most 2^63 / 1000."""
    left, out = np.asarray(count, np.int64) + 1, np.int64(0)
    for _ in range(3):  # a digit of 1000 at a time keeps all products below 2^63
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(row: np.ndarray, term: np.ndarray, p: np.ndarray, rare: np.ndarray, n_terms: int) -> np.ndarray:
    """Sums of ``squares`` over ``n_terms`` terms for all pairs of sources: of row s against column q.

    row, term, p: the cells of the matrix in order of rows. rare: each source's probability of a term that it lacks.
    """
    n = len(rare)
    bounds = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(bounds))
    size = np.diff(bounds)

    def by_row(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(full):
            out[full] = np.add.reduceat(cells, bounds[full])
        return out

    sums = np.zeros((n, n), np.int64)
    for s in range(n):
        own = slice(bounds[s], bounds[s + 1])
        dense, mine = np.full(n_terms, rare[s]), np.zeros(n_terms, bool)
        dense[term[own]], mine[term[own]] = p[own], True
        shared = mine[term]
        total = by_row(squares(dense[term], p)) - by_row(np.where(shared, squares(dense[term], rare[row]), 0))
        step = max(1, CELLS // max(1, size[s]))
        for q in range(0, n, step):  # the terms of s, as if the other source lacked all of them
            total[q : q + step] += squares(p[own][None, :], rare[q : q + step, None]).sum(axis=1)
        neither = n_terms - size[s] - size + by_row(shared.astype(np.int64))
        sums[s] = total + neither * squares(np.full(n, rare[s]), rare)
    return sums


def block_parts(top: int):
    """A block's counts and its language's groups to rows of ``_PARTS``: sums of the block for pairs, its highest terms of each source."""

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        groups = groups.sort_by("source")
        sources = groups["source"].to_pylist()
        n, v, n_lang = groups["n"].to_numpy(), groups["v"].to_numpy(), groups["n_lang"].to_numpy()
        if not len(counts):
            return pa.table([[], [], [], [], []], schema=pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())]))
        coded = counts["term"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        names = coded.dictionary.take(pa.array(order)).to_pylist()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[coded.indices.to_numpy()]
        row = pc.index_in(counts["source"], value_set=groups["source"].combine_chunks()).to_numpy().astype(np.int64)
        by = np.lexsort((term, row))
        row, term, c, c_lang = row[by], term[by], counts["n"].to_numpy()[by], counts["n_lang"].to_numpy()[by]
        p, q = share(c, (n + v)[row]), share(c_lang, n_lang[0] + v[0])
        sums = pair_sums(row, term, p, share(np.zeros(len(n), np.int64), n + v), len(names))
        a, b = np.nonzero(~np.eye(len(n), dtype=bool))
        value = squares(p, q)
        high = np.flatnonzero(p > q)
        high = high[np.lexsort((term[high], -value[high], row[high]))]
        within = np.arange(len(high)) - np.searchsorted(row[high], row[high])
        high = high[within < top]
        return pa.table(
            {
                "lang": pa.array([lang] * (len(a) + len(high)), pa.string()), "source": pa.array([sources[k] for k in [*a, *row[high]]], pa.string()),
                "part": pa.array(["pair"] * len(a) + ["term"] * len(high), pa.string()),
                "item": pa.array([*(sources[k] for k in b), *(names[k] for k in term[high])], pa.string()), "value": pa.array(np.concatenate([sums[a, b], value[high]]), pa.int64()),
            }
        )

    return run


def divergences(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of each (lang, source) group: ``pair`` against each other source, ``term`` for its ``top`` terms.

    Null texts, languages and sources are empty ones. A term is kept if ``least_docs`` rows of its language hold
    it. Groups without terms have pairs too; a language with one source has none. Ties go to the lesser item in
    UTF-8; rows that repeat count each. Other columns are not read. An empty table gives an empty result. The result
    holds all pairs of a language's sources, as it must; its rows grow with the square of their number, not with the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = rows.mapInArrow(count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    of_lang = counts.select("lang", "source", "term", "n", F.sum("n").over(w).alias("n_lang"), F.sum("docs").over(w).alias("docs"), (F.min("source").over(w) == F.col("source")).cast("long").alias("once"))
    path = new_dir(spark, "terms")
    of_lang.where(F.col("docs") >= least_docs).drop("docs").write.parquet(path)
    kept = spark.read.parquet(path)
    zero = F.lit(0).cast("long")
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("once").alias("v"), F.sum("n").alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = cut(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "v", "n_lang"))), small=True)
    blocks = max(1, -(-kept.count() // block))
    cells = kept.select("lang", "source", "term", "n", "n_lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    each = groups.withColumn("block", F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))))
    parts = cells.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(block_parts(top), _PARTS)
    parts = cut(parts, small=True)
    none = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", zero.alias("value"))
    pairs = parts.where("part = 'pair'").select("lang", "source", "item", "value").union(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    return pairs.union(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: lang, source, part, item, value, rank."""
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + l.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + l.v)::HUGEINT AS q
  FROM totals g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts) WHERE part = 'pair' OR rank <= 200
"""
