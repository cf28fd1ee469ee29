"""Views of the generated tables as packets, clips and calibration samples; used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as packets: user is the device, value the magnitude, errors are loud, purchases have a person."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("device_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("magnitude"),
        F.when(F.col("event_type") == "error", 0.9).otherwise(0.1).alias("audio_peak"),
        (F.col("event_type") == "purchase").alias("humanoid"),
        F.get_json_object("props", "$.k").cast("int").alias("bluetooth_count"),
        "event_type",
    )


#: The same view in SQL.
PACKETS_SQL = """
packets AS (
  SELECT user_id AS device_id, ts, event_id AS seq, value AS magnitude,
         CASE WHEN event_type = 'error' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS audio_peak,
         event_type = 'purchase' AS humanoid, CAST(props->>'k' AS INT) AS bluetooth_count, event_type
  FROM events
)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as waveforms of 64 samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("clip_id"), F.lit(44_100).alias("sample_rate"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"), "label")


CLIPS_SQL = """
clips AS (
  SELECT vec_id AS clip_id, list_transform(embedding, lambda v: v::DOUBLE) AS samples, label FROM embeddings
), samples AS (
  SELECT clip_id, unnest(range(len(samples))) AS i, unnest(samples) AS v FROM clips
)"""


#: Vectors of a long clip, samples that hold each value, samples in all.
JOINED, HELD, LONG = 16, 43, 44_100


def long_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a second: 16 vectors of ``embeddings`` each, every value held for 43 samples, filled up with zeros."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    joined = e.groupBy(F.floor(F.col("vec_id") / JOINED).alias("clip_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("parts"))
    values = F.flatten(F.transform("parts", lambda p: p["embedding"]))
    held = F.flatten(F.transform(values, lambda v: F.array_repeat(v.cast("double"), HELD)))
    return joined.select("clip_id", F.lit(44_100).alias("sample_rate"), C.pad_or_trim(held, LONG).alias("samples"))


#: The values of long clips in SQL, each once, as a list of 1,024.
LONG_SQL = f"""
held AS (
  SELECT vec_id // {JOINED} AS clip_id, list_resize(flatten(list(list_transform(embedding, lambda v: v::DOUBLE) ORDER BY vec_id)), {JOINED * 64}, 0.0::DOUBLE) AS vals
  FROM embeddings GROUP BY 1
)"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as three-axis samples of devices (suppliers); seq numbers a device's samples."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return li.select(
        F.col("l_suppkey").alias("device_id"), F.col("l_orderkey").alias("ts"), F.row_number().over(w).alias("seq"), F.col("l_linenumber").alias("step"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"),
    )


AXES_SQL = """
axes AS (
  SELECT l_suppkey AS device_id, l_orderkey AS ts, l_linenumber AS step,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax) AS INT) AS seq,
         l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z FROM lineitem
)"""
