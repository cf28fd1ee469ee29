"""Operator 5 [native]: a two-pass external shuffle of records into shards of equal row counts.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash. Pass 2 takes each
bucket into one task, shuffles it (Spark's ``shuffle`` is a seeded Fisher-Yates permutation) and writes
it. The buckets one after the other are a random order of all records; shard k is the k-th of ``n``
equal stretches of that order, so each bucket is written to one or two shards and nothing moves again.

Law ``rows``: the counts of any two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, new_dir

#: Text bytes of a bucket, and the most buckets there are (their counts are broadcast: 24 MB at most); beyond 4 TB buckets grow, to 100 MB at 100 TB.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 1 << 20


def scatter(docs: DataFrame, n_buckets: int, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """Pass 1: one struct column ``record`` and its ``bucket``.

    The hash also takes the record's place in its partition, so that many equal records, ids or null ids
    spread like any others.
    """
    hashed = F.xxhash64(F.lit(seed), column(doc_id), F.monotonically_increasing_id())
    return docs.select(F.struct(*map(column, docs.columns)).alias("record"), F.pmod(hashed, F.lit(n_buckets)).cast("int").alias("bucket"))


def write_shards(docs: DataFrame, path: str, n_shards: int, *, seed: int = 0, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> StructType:
    """Write all records, each as struct ``record`` with its ``slot``, to ``path``/shard=k.

    Every record is written once, whatever it holds: nulls, empty or very long texts (a bucket holds
    whole records, so it is at least as large as its largest), repeated rows, clashing column names.
    An empty table gives no records. The buckets are fixed by seed, partitions and rows of the input, which is read
    twice and must give the same rows in the same partitions again, as files do (write other inputs to a table first); the
    order in a bucket also follows how its rows arrive. Returns the schema to read the files with.
    """
    size = F.coalesce(F.octet_length(column(text)), F.lit(0)) + 64
    total, rows = docs.agg(F.sum(size.cast("long")), F.count("*")).first()
    n_buckets = max(1, min(MOST_BUCKETS, -(-(total or 0) // bucket_bytes)))
    scattered = scatter(docs, n_buckets, seed, doc_id)
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = F.broadcast(counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start")))
    # One row a bucket; the list of a bucket is bounded by the buckets' size.
    gathered = scattered.groupBy("bucket").agg(F.collect_list("record").alias("records"))
    placed = gathered.join(starts, "bucket").select("start", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    place = F.col("start") + F.col("at")
    least, more = divmod(rows, n_shards)  # the first `more` shards have one row more
    if least:
        shard = F.when(place < more * (least + 1), F.expr(f"(start + at) div {least + 1}")).otherwise(F.expr(f"(start + at - {more}) div {least}"))
    else:
        shard = place
    first = shard * least + F.least(shard, F.lit(more))
    out = placed.select("record", (place - first).alias("slot"), shard.cast("int").alias("shard"))
    out.write.partitionBy("shard").parquet(path)
    return out.schema


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards under the law ``rows``, as read back from the shards' files."""
    path = new_dir(spark, "shards")
    schema = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, 24, seed=20_240_229)
    text = F.col("record.text")
    return spark.read.schema(schema).parquet(path).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
