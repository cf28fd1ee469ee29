"""Operator 4: token counts of documents, without moving any piece of text between tasks.

First tier: a compact hash table of the pieces that are frequent in a bounded sample of documents, with
their numbers of tokens, broadcast to all tasks (2 MB at most). Second tier: each worker encodes what that
table misses and keeps it in a bounded table of its own. The sample decides how often the library is
called, never a count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import column, free_name, vocabulary

#: Documents looked at for the first tier, the size up to which one is, and the pieces the tier holds at most.
SAMPLE_DOCS, SAMPLE_BYTES, TABLE_PIECES = 1_000, 32_768, 32_768


def frequent_pieces(docs: DataFrame, text: str, vocabulary_json: str, *, sample_docs: int = SAMPLE_DOCS, most: int = TABLE_PIECES) -> tuple[pieces.Table, np.ndarray]:
    """The first tier: the most frequent pieces of up to ``sample_docs`` documents, and their counts."""
    col = column(text).cast("string")
    sample = docs.where(F.octet_length(col) <= SAMPLE_BYTES).select(col.alias("t")).limit(sample_docs).collect()
    encoder = pieces.Encoder(pieces.Library(vocabulary_json), track=True)
    encoder.encode(pa.array([r.t for r in sample], pa.string()), want_ids=False)
    return encoder.most_used(most)


_ENCODERS: dict[str, pieces.Encoder] = {}


def _counter(frequent, vocabulary_):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = frequent.value
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = pieces.Encoder(pieces.Library(vocabulary_.value), first=first)
        for batch in batches:
            n, _ = _ENCODERS[key].encode(batch.column(batch.num_columns - 1), want_ids=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[str(k) for k in range(batch.num_columns)])

    return count


def count_tokens(docs: DataFrame, vocabulary_json: str, *, text: str = "text", out: str = "n_tokens", first: tuple[pieces.Table, np.ndarray] | None = None) -> DataFrame:
    """All columns but ``text``, and the text's number of tokens as column ``out``.

    Null and empty texts have 0 tokens. If a column has the name ``out``, the new one gets underscores in
    front. Rows are independent: order, ties and repeated rows do not matter, and an empty table gives an
    empty result. ``first`` replaces the sampled first tier.
    """
    if first is None:
        first = frequent_pieces(docs, text, vocabulary_json)
    keep = [c for c in docs.columns if c != text]
    out = free_name(keep, out)
    sc = docs.sparkSession.sparkContext
    counter = _counter(sc.broadcast((uuid.uuid4().hex, first)), sc.broadcast(vocabulary_json))
    fields = [docs.schema[c] for c in keep]
    given = docs.select(*(column(c).alias(str(k)) for k, c in enumerate(keep)), column(text).cast("string").alias(str(len(keep))))
    schema = ", ".join([*(f"`{k}` {f.dataType.simpleString()}" for k, f in enumerate(fields)), f"`{len(keep)}` long"])
    return given.mapInArrow(counter, schema).toDF(*keep, out)


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    """Of each document: doc_id, n_bytes, n_tokens, over_limit (more than 512 tokens)."""
    with open(vocabulary_file or vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary_json = f.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(docs, vocabulary_json)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
