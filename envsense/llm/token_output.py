"""Operator 1: token ids in Simple-8b files, in ascending order of the documents.

The written table is one row per document, in files whose names and rows follow the order: ``part`` (the
file's place in the order), ``at`` (ids of the file before the document), ``n_tokens``, ``words`` (64-bit
words, little-endian), ``offsets`` (first word of each block of 4,096 ids, 32-bit) and ``escapes``
(values of more than 60 bits). A block can be decoded by itself.

One range shuffle puts the texts in order; encoding runs after it, so ids are moved once, coded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces, simple8b
from .common import column, new_dir, vocabulary

SCHEMA = "doc_id long, part long, at long, n_tokens long, words binary, offsets binary, escapes binary"
ROWS = 500


def _writer(vocabulary_json: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_json)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                n, ids = encoder.encode(rows.column(1))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    n = n + 1
                lengths = [np.diff(np.append(np.arange(0, x, simple8b.BLOCK), x)) for x in n]
                coded = simple8b.encode(ids, np.concatenate(lengths))
                ats = at + np.cumsum(n) - n
                at += int(n.sum())
                block = 0
                words, offsets, escapes = [], [], []
                selector = coded.words >> np.uint64(60)
                for x in lengths:
                    own = coded.offsets[block : block + len(x) + 1]
                    w = coded.words[own[0] : own[-1]]
                    out = selector[own[0] : own[-1]] == 0
                    e = np.empty(0, np.uint64)
                    if out.any():  # the document's escapes count from 0
                        e = coded.escapes[w[out].astype(np.int64)]
                        w = w.copy()
                        w[out] = np.arange(len(e), dtype=np.uint64)
                    words.append(w.astype("<u8").tobytes())
                    offsets.append((own - own[0]).astype("<u4").tobytes())
                    escapes.append(e.astype("<u8").tobytes())
                    block += len(x)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part)), pa.array(ats), pa.array(n), pa.array(words, pa.binary()), pa.array(offsets, pa.binary()), pa.array(escapes, pa.binary())],
                    names=["doc_id", "part", "at", "n_tokens", "words", "offsets", "escapes"],
                )

    return write


_ENCODERS: dict[str, pieces.Encoder] = {}


def _encoder(vocabulary_json: str) -> pieces.Encoder:
    """The encoder, kept with its table for the worker's next tasks."""
    key = hashlib.sha256(vocabulary_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = pieces.Encoder(pieces.Library(vocabulary_json))
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, vocabulary_json: str, *, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents to ``path``, in ascending order of the document's id.

    A null or empty text has no ids but the end id. Null ids come first; rows with equal ids follow each
    other in the order of a hash of their texts, and many of them may span several files. Other columns
    are not read. An empty table gives an empty file set. Very long texts are coded in blocks.
    """
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    ordered.mapInArrow(_writer(vocabulary_json, end_id), SCHEMA).write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            lengths, offsets, words, escapes, places, base, skipped = [], [0], [], [], rows.column("n_tokens").to_numpy(), 0, 0
            for n, w, o, e in zip(places, *(rows.column(c).to_pylist() for c in ("words", "offsets", "escapes"))):
                w, o, e = np.frombuffer(w, "<u8"), np.frombuffer(o, "<u4").astype(np.int64), np.frombuffer(e, "<u8")
                if len(e):
                    w = w + np.where(w >> np.uint64(60) == 0, np.uint64(skipped), np.uint64(0))
                lengths += [min(simple8b.BLOCK, n - k) for k in range(0, n, simple8b.BLOCK)]
                offsets += (base + o[1:]).tolist()
                base, skipped = base + len(w), skipped + len(e)
                words.append(w)
                escapes.append(e)
            ids = simple8b.decode(simple8b.Coded(np.concatenate(words), np.concatenate(escapes), np.array(offsets), np.array(lengths, np.int64)))
            ends = np.cumsum(places)
            ids = ids.astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - places, ends)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), rows.column("at"), rows.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the written files.

    The number of ids in each file (one row a file) is summed to the files' starts and broadcast, up to
    65,536 files; beyond that Spark joins it as it sees fit.
    """
    written = spark.read.parquet(path)
    totals = written.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if len(written.inputFiles()) <= 65_536:
        starts = F.broadcast(starts)
    digests = written.mapInArrow(_reader, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")
    return digests.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    """All of ``documents`` written as ids with end id 0 and read back: doc_id, start, n_tokens, ids_crc32."""
    with open(vocabulary_file or vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary_json = f.read()
    path = new_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_json)
    return read_digests(spark, path)
