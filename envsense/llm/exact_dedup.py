"""Operator 12: exact deduplication by a Grace hash of whole contents.

Records (a content, how many rows have it, the greatest id) are dealt to buckets by a hash of the content. A
task puts its bucket into an open-addressing table that compares complete contents. A bucket whose distinct
contents do not fit is spilled to files in the shared folder, and what all such buckets spilled is dealt
again by other bits of the hash, level by level, until each fits. Copies of a content meet before each shuffle
in the same table, so a group of copies reaches its bucket as one record of each task and stretch at most.

Rows find their class by the content's SHA-256. Classes with a thousandth of all rows or more, of which there are a
thousand at most, are broadcast, so that no group of copies meets in one task there either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, free_name, new_dir, numbered, table

#: Bytes of distinct contents that a table may hold; bytes of a batch that goes to Spark; share of rows of a hot class.
TABLE_BYTES, BATCH_BYTES, HOT = 64 << 20, 8 << 20, 1000
_RECORD = "hash long, text binary, n long, id long, n_max long"
_SOLVED = f"{_RECORD}, text_sha256 string"


class Contents:
    """An open-addressing table (linear probing) of distinct contents with, for each, n, the greatest id and n_max.

    Two contents are one if all their bytes are equal, whatever their hashes. A null id is less than any other.
    ``valid`` tells that there is an id, n_max counts the rows that have the greatest.
    """

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.contents: list[bytes] = []
        self.bytes = 0
        self.hashes = np.empty(0, np.uint64)
        self.n, self.ids, self.n_max = (np.empty(0, np.int64) for _ in range(3))
        self.valid = np.empty(0, bool)

    def __len__(self) -> int:
        return len(self.contents)

    def _grow(self, more: int) -> None:
        if 2 * (len(self) + more) <= len(self.slots):
            return
        self.slots = np.full(1 << int(2 * (len(self) + more)).bit_length(), -1, np.int64)
        mask = np.uint64(len(self.slots) - 1)
        left, at = np.arange(len(self)), (self.hashes & mask).astype(np.int64)
        while len(left):  # entries are distinct: each takes the next free slot
            free = self.slots[at[left]] < 0
            places, first = np.unique(at[left[free]], return_index=True)
            took = left[free][first]
            self.slots[places] = took
            left = left[~np.isin(left, took)]
            at[left] = (at[left] + 1) & int(mask)

    def place(self, hashes: np.ndarray, content: Callable[[int], bytes]) -> np.ndarray:
        """The entry of each row; contents that are not there yet are put in."""
        self._grow(len(hashes))
        mask = len(self.slots) - 1
        out, left = np.empty(len(hashes), np.int64), np.arange(len(hashes))
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.slots[at[left]] < 0
            if free.any():
                places, first = np.unique(at[left[free]], return_index=True)
                new = left[free][first]
                self.slots[places] = out[new] = len(self) + np.arange(len(new))
                texts = [content(int(k)) for k in new]
                self.contents += texts
                self.bytes += sum(map(len, texts))
                self.hashes = np.concatenate([self.hashes, hashes[new]])
                left = left[~np.isin(left, new)]
            entry = self.slots[at[left]]
            same = self.hashes[entry] == hashes[left]
            for k in np.flatnonzero(same):
                same[k] = self.contents[entry[k]] == content(int(left[k]))
            out[left[same]] = entry[same]
            left = left[~same]
            at[left] = (at[left] + 1) & mask
        fresh = len(self) - len(self.n)
        self.n, self.ids, self.n_max = (np.concatenate([x, np.zeros(fresh, np.int64)]) for x in (self.n, self.ids, self.n_max))
        self.valid = np.concatenate([self.valid, np.zeros(fresh, bool)])
        return out

    def add(self, batch: pa.RecordBatch) -> None:
        """Records (see ``_RECORD``) into the table."""
        text = batch.column(1)
        entry = self.place(batch.column(0).to_numpy().view(np.uint64), lambda k: text[k].as_py())
        valid = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        n, ids, n_max = batch.column(2).to_numpy(), batch.column(3).fill_null(0).to_numpy(), batch.column(4).to_numpy()
        np.add.at(self.n, entry, n)
        order = np.lexsort((ids, valid, entry))
        last = order[np.append(np.diff(entry[order]) != 0, True)] if len(order) else order
        e = entry[last]
        above = (self.n_max[e] == 0) | (valid[last] > self.valid[e]) | ((valid[last] == self.valid[e]) & (ids[last] > self.ids[e]))
        self.valid[e[above]], self.ids[e[above]], self.n_max[e[above]] = valid[last[above]], ids[last[above]], 0
        top = (valid == self.valid[entry]) & (ids == self.ids[entry])
        np.add.at(self.n_max, entry[top], n_max[top])

    def batches(self, solved: bool | None = None) -> Iterator[pa.RecordBatch]:
        """The entries as records; with ``solved`` given, with the digest too: of a bucket that fits, without its text, or none."""
        size = np.cumsum([0 if solved else len(c) for c in self.contents])
        start = 0
        while start < len(self):
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_BYTES, "right")))
            stop = min(stop, start + 10_000)
            part, cells = slice(start, stop), self.contents[start:stop]
            ids = pa.array(self.ids[part], mask=~self.valid[part])
            columns = [pa.array(self.hashes[part].view(np.int64)), pa.array([None] * len(cells) if solved else cells, pa.binary()), pa.array(self.n[part]), ids, pa.array(self.n_max[part])]
            if solved is not None:
                columns.append(pa.array([hashlib.sha256(c).hexdigest() if solved else None for c in cells], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "text", "n", "id", "n_max", "text_sha256"][: len(columns)])
            start = stop


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BATCH_BYTES of text."""
    text = batch.column(1)
    size = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64))) if len(text) else np.empty(0, np.int64)
    start = 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def combined(limit: int):
    """Records to fewer: those of a task with one content become one, a table full at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Contents()
        for batch in batches:
            for part in _pieces(batch):
                held.add(part)
                if held.bytes > limit:
                    yield from held.batches()
                    held = Contents()
        yield from held.batches()

    return run


def solved(limit: int):
    """A bucket's classes with their digests, or if its contents exceed the limit, its records for the next level.

    Contents that no bits of the hash tell apart stay in the table whatever their size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = Contents(), False
        for batch in batches:
            for part in _pieces(batch):
                held.add(part)
                if held.bytes > limit and (over or len(np.unique(held.hashes)) > 1):
                    over = True
                    yield from held.batches(solved=False)
                    held = Contents()
        yield from held.batches(solved=not over)

    return run


def classes(texts: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """text_sha256, n, id (the greatest; null if none has one), n_max (rows with that id): a row for each distinct content.

    texts: hash (any 64-bit hash of the content), text (binary), id.
    """
    spark = texts.sparkSession
    records = texts.select("hash", "text", F.lit(1).cast("long").alias("n"), "id", F.lit(1).cast("long").alias("n_max"))
    size, level, found = records.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, 0, None
    while True:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // limit))
        dealt = records.mapInArrow(combined(limit), _RECORD).repartition(buckets, F.xxhash64(F.lit(level), "hash"))
        path = new_dir(spark, f"grace-{level}")
        dealt.mapInArrow(solved(limit), _SOLVED).write.parquet(path)
        spilled = spark.read.parquet(path)
        part = spilled.where("text_sha256 is not null").select("text_sha256", "n", "id", "n_max")
        found = part if found is None else found.union(part)
        records = spilled.where("text_sha256 is null").drop("text_sha256")
        size, level = records.agg(F.sum(F.octet_length("text").cast("long"))).first()[0], level + 1
        if size is None:
            return found


def _content(text: str, normalise: Callable[[Column], Column] | None) -> Column:
    value = F.coalesce(column(text).cast("string"), F.lit(""))
    return (normalise(value) if normalise else value).cast("binary")


def _joined(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their group by ``text_sha256`` (nulls where there is none); hot groups are broadcast."""
    hot, cold = groups.where(F.col("n") * HOT >= total), groups.where(F.col("n") * HOT < total)
    first = rows.join(F.broadcast(hot), "text_sha256", "left")
    rest = first.where("n is null").select(*rows.columns).join(cold, "text_sha256", "left")
    return first.where("n is not null").unionByName(rest)


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, limit: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``.

    Texts are equal if all bytes are, after ``normalise`` (none by default); a null text is an empty one. The row with
    the greatest id of a group stays; a null id is less than any other, and keep_id is null if no row has an id. If
    several rows have the greatest id, one of them has ``kept``. Other columns are not read. An empty table gives an
    empty result. Texts of any length are compared whole.
    """
    content = _content(text, normalise)
    each = docs.select(F.xxhash64(content).alias("hash"), content.alias("text"), column(doc_id).cast("long").alias("id"))
    groups = cut(classes(each, limit).where("n > 1"), small=True).withColumnRenamed("id", "keep_id")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), F.sha2(content, 256).alias("text_sha256"))
    joined = _joined(rows, groups, docs.count())
    single = joined.where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.coalesce("n_max", F.lit(1)) > 1)))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = single.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
    # Rows that share the greatest id are told apart by number alone.
    tied = numbered(groups.where("n_max > 1"), "n_max", "k")
    return out.union(tied.select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("k") == 0).alias("kept"), "text_sha256"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, limit: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns and as they are; see ``exact_groups``.

    Of rows that share the greatest id of a group, the one with the least hash of its columns stays.
    """
    content = _content(text, normalise)
    each = docs.select(F.xxhash64(content).alias("hash"), content.alias("text"), column(doc_id).cast("long").alias("id"))
    groups = cut(classes(each, limit).where("n > 1"), small=True).toDF("text_sha256", "n", "keep_id", "n_max")
    row = free_name(docs, "row")
    packed = docs.select(F.struct(*map(column, docs.columns)).alias(row), column(doc_id).cast("long").alias("id"), F.sha2(content, 256).alias("text_sha256"))
    joined = _joined(packed, groups, docs.count())
    kept = joined.where(F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    tied = kept.where("n_max > 1").groupBy("text_sha256").agg(F.min_by(row, F.xxhash64(row)).alias(row)).select(row)
    return kept.where("n_max is null or n_max = 1").select(row).union(tied).select(f"{row}.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP12_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id::BIGINT AS doc_id, max(doc_id) OVER w::BIGINT AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
)
"""
