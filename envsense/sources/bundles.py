"""Event bundles, waveforms, calibration tables and time series on disk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pad_or_trim, pcm_to_float
from .bundle_source import filesystem
from .schema import CALIBRATION, SENSORS_CSV

#: Directories whose files are a batch, and directories that a task lists where they are many.
PER_BATCH, PER_TASK = 64, 1024


def write_bundles(rows: DataFrame, path: str) -> None:
    """Sensor rows as CSV with a header, one directory an event (``event_id=…``), rows in the order of ``seq``."""
    rows.repartition("event_id").sortWithinPartitions("event_id", "seq").drop("seq").write.partitionBy("event_id").option("header", True).csv(path)


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """All events' sensor rows; ``event_id`` comes from the directory."""
    return spark.read.schema(f"{SENSORS_CSV}, event_id string").option("header", True).csv(path)


def load_event(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """One event's rows; an unknown id gives none. Only its directory is read."""
    return read_sensors(spark, path).where(F.col("event_id") == event_id)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out too."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def event_files(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """path, content of the files of a name below a path; without a name all files, whose contents are null.

    Tasks list and read: the driver has the names below the path itself alone, where Spark's readers would have it hold each file's status,
    list up to 10,000 directories with as many tasks and read a few small files a task. These are used for stores that Arrow does not know.
    """
    try:
        store, root = filesystem(path)
    except (OSError, ValueError, NotImplementedError):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name or "*").load(path)
        return found.select("path", "content" if name else F.lit(None).cast("binary").alias("content"))
    top = [f for f in store.get_file_info(fs.FileSelector(root)) if not _hidden(f.base_name)]
    given = pa.table({"top": pa.array([f.path for f in top], pa.string()), "deep": pa.array([f.type == fs.FileType.Directory for f in top], pa.bool_())})

    def read(store: fs.FileSystem, file: str) -> bytes:
        with store.open_input_stream(file) as stream:
            return stream.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(path)
        for batch in batches:
            for at in range(0, batch.num_rows, PER_BATCH):
                files: list[str] = []
                for row in batch.slice(at, PER_BATCH).to_pylist():
                    below = [f.path for f in store.get_file_info(fs.FileSelector(row["top"], recursive=True)) if f.type == fs.FileType.File] if row["deep"] else [row["top"]]
                    files += [f for f in below if not any(map(_hidden, f[len(row["top"]) :].split("/")))]
                files = [f for f in files if name in (None, f.rsplit("/", 1)[-1])]
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([read(store, f) if name else None for f in files], pa.binary())], names=["path", "content"])

    return spark.createDataFrame(given).repartition(max(4 * spark.sparkContext.defaultParallelism, len(top) // PER_TASK)).mapInArrow(run, "path string, content binary")


def read_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Metadata documents, one JSON object a file, with the event's id from its directory. Without a ``schema`` all documents are read once more to find it."""
    files = event_files(spark, path, "metadata.json").select(F.col("content").cast("string").alias("json"), F.regexp_extract("path", "(event_[^/]+)/[^/]*$", 1).alias("event_"))
    kind = schema or spark.read.option("multiLine", True).json(files.select("json").rdd.map(lambda r: r.json)).schema
    return files.select(F.from_json("json", kind).alias("document"), "event_").select("document.*", "event_").withColumn("event_id", F.col("event_")).drop("event_")


def event_directories(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the event directories below a path, sorted."""
    return event_files(spark, path).select(F.regexp_extract("path", "(event_[^/]+)/", 1).alias("event_id")).where("event_id <> ''").distinct().orderBy("event_id")


def pcm_chunks(chunks: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``samples``: little-endian 16-bit samples of a binary column as doubles in [-1, 1)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            yield batch.assign(samples=[None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(float) for b in batch[data]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{fields}, samples array<double>").withColumn("samples", pcm_to_float(F.col("samples")))


def read_wav(spark: SparkSession, path: str, length: int | None = 220_500) -> DataFrame:
    """path, sample_rate, samples (channels averaged, cut or filled to ``length``) of 16-bit WAV files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import io
        import wave

        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    a = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    rows.append((name, w.getframerate(), a.mean(axis=1) / 32768.0))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples"])

    out = files.mapInPandas(run, "path string, sample_rate int, samples array<double>")
    return out if length is None else out.withColumn("samples", pad_or_trim(F.col("samples"), length))


def write_points(points: DataFrame, path: str) -> None:
    """Time series by measurement and day, sorted so that row groups can be skipped."""
    dated = points.withColumn("date", F.to_date("time"))
    dated.repartition("measurement", "date").sortWithinPartitions("device_id", "time").write.mode("append").partitionBy("measurement", "date").parquet(path)


def save_calibration(calibration: DataFrame, path: str) -> None:
    calibration.withColumn("calibrated", F.lit(True)).write.mode("overwrite").parquet(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).parquet(path)
