import zlib

import pytest
from pyspark.sql import functions as F

from envsense.llm import sharding
from envsense.llm.common import new_dir


@pytest.mark.parametrize("rows,shards", [(0, 4), (3, 5), (5, 5), (200, 7), (203, 7)])
def test_every_record_once_and_counts_at_most_one_apart(spark, rows, shards):
    docs = spark.range(rows).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 5 > 0, F.repeat(F.lit("ab"), F.col("id").cast("int"))).alias("text"), F.lit(1).alias("slot"), F.lit("x").alias("shard"), "id")
    path = new_dir(spark, "test")
    schema = sharding.write_shards(docs, path, shards, seed=5, bucket_bytes=1500)
    got = spark.read.schema(schema).parquet(path).collect()
    assert sorted(r.record.id for r in got) == list(range(rows))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.record.slot == 1 and r.record.shard == "x"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    if rows > 100:
        order = [r.record.id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        apart = sum(abs(a - b) for a, b in zip(order, order[1:])) / rows
        assert rows / 4 < apart < rows / 2  # a third of the rows is expected


def test_many_equal_rows_spread(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    by = sharding.scatter(docs, 10, 1).groupBy("bucket").count().collect()
    assert len(by) == 10 and max(r["count"] for r in by) < 300


def test_query(spark):
    from tests.conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sharding.op5_sharding(spark, SF).collect()
    assert len(got) == len(docs) and {r.shard for r in got} == set(range(24))
    slots = [sorted(r.slot for r in got if r.shard == k) for k in range(24)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
