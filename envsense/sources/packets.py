"""Sensor packets from JSON, as batch or stream, split into valid rows and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import PACKET


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a malformed line is kept in ``_corrupt_record``."""
    return spark.read.schema(PACKET).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def stream_packets(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same files as a stream, a bounded number of them at a time."""
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", max_files).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def parse_packets(messages: DataFrame, value: str = "value") -> DataFrame:
    """Packets from a string column (a message queue's, say); the other columns stay in front."""
    parsed = F.from_json(F.col(value), PACKET, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return messages.withColumn("packet", parsed).select(*(c for c in messages.columns if c != value), "packet.*")


def error_code(packets: DataFrame) -> DataFrame:
    """Adds ``error``: INVALID_JSON, MISSING_TIMESTAMP, MISSING_DEVICE, INVALID_AUDIO_PEAK, or null for a valid packet."""
    code = (
        F.when(F.col("_corrupt_record").isNotNull(), "INVALID_JSON")
        .when(F.col("timestamp").isNull(), "MISSING_TIMESTAMP")
        .when(F.col("device_id").isNull(), "MISSING_DEVICE")
        .when((F.col("audio_peak") < 0) | (F.col("audio_peak") > 1), "INVALID_AUDIO_PEAK")
    )
    return packets.withColumn("error", code)


def split_valid(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid packets, and dead letters with their error codes."""
    coded = error_code(packets)
    return coded.where("error is null").drop("error", "_corrupt_record"), coded.where("error is not null")


def detector_rows(packets: DataFrame) -> DataFrame:
    """device_id, ts_ns, ts, seq, magnitude (null: no magnetometer), audio_peak, humanoid, bluetooth_count, with the defaults.

    A packet without a magnetometer, or with an empty one, has no magnitude; one whose magnetometer lacks
    the magnitude alone has 0. A missing audio peak is 0, a missing flag false, a missing count 0.
    """
    m = F.col("magnetometer")
    empty = m.isNull() | (m["x"].isNull() & m["y"].isNull() & m["z"].isNull() & m["magnitude"].isNull())
    return packets.select(
        "device_id",
        F.col("timestamp").alias("ts_ns"),
        F.timestamp_micros(F.expr("timestamp div 1000")).alias("ts"),
        F.col("timestamp").alias("seq"),
        F.when(~empty, F.coalesce(m["magnitude"], F.lit(0.0))).alias("magnitude"),
        F.coalesce("audio_peak", F.lit(0.0)).alias("audio_peak"),
        F.coalesce("humanoid_detected", F.lit(False)).alias("humanoid"),
        F.coalesce("bluetooth_devices_count", F.lit(0)).alias("bluetooth_count"),
    )
