"""Event bundles as a data source: a directory for each event with ``audio.wav``, ``sensors.csv`` and ``metadata.json``.

``spark.dataSource.register(BundleSource)``, then ``df.write.format("bundles").mode("append").save(path)`` and
``spark.read.format("bundles").load(path)``. A row is a bundle: event_id, sample_rate, samples (PCM_16 once written),
sensors (an array of structs of the CSV's columns) and metadata (a JSON object). Files go through Arrow's file systems,
so a path may be local, shared or in a store that Arrow knows. Tasks write beside the bundles; what a task has
finished is moved into place when the job commits, so an attempt that is lost leaves nothing. Reading is planned from the
directories' names, some bundles a partition; a filter on the event's id reads that bundle alone.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_string

#: Columns of the sensors' CSV, fields of a bundle, its files, bundles that a task reads.
SENSORS = ("timestamp", "magnetic_magnitude", "audio_peak", "humanoid_detected")
BUNDLE = "event_id string, sample_rate int, samples array<double>, sensors array<struct<timestamp:bigint,magnetic_magnitude:double,audio_peak:double,humanoid_detected:boolean>>, metadata string"
ARTEFACTS = {"audio": "audio.wav", "sensors": "sensors.csv", "metadata": "metadata.json", "video": "video.mp4"}
PER_PARTITION = 64


def to_pcm16(samples) -> bytes:
    """Little-endian 16-bit samples: times 32768, rounded down, held to the range. A missing value is silence."""
    a = np.nan_to_num(np.array([0.0 if v is None else v for v in samples], float))
    return np.clip(np.floor(a * 32768.0), -32768, 32767).astype("<i2").tobytes()


def wav_bytes(samples, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(to_pcm16(samples))
    return out.getvalue()


def wav_samples(content: bytes) -> tuple[int, list[float]]:
    """The rate and the samples, channels averaged, in [-1, 1)."""
    with wave.open(io.BytesIO(content)) as w:
        a = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return w.getframerate(), (a.mean(axis=1) / 32768.0).tolist()


def csv_bytes(sensors) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(SENSORS)
    writer.writerows(["" if row[c] is None else repr(row[c]) if isinstance(row[c], float) else row[c] for c in SENSORS] for row in sensors)
    return out.getvalue().encode()


def csv_rows(content: bytes) -> list[tuple]:
    kinds = (int, float, float, lambda v: v == "True")
    return [tuple(None if v == "" else kind(v) for kind, v in zip(kinds, row)) for row in list(csv.reader(io.StringIO(content.decode())))[1:]]


def directory(event_id: str) -> str:
    """The event's directory: its id, with what a path cannot hold in percent signs. Ids that a name cannot hold are an error."""
    if not event_id:
        raise ValueError("a bundle needs an event_id")
    name = quote(event_id, safe=" ")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Names of the directories that a task wrote below ``staging``."""

    staging: str
    names: list[str]


@dataclass
class Bundles(InputPartition):
    names: list[str]


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = filesystem(self.path)
        staging, names = f"{root}/_staging-{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(staging, recursive=True)
        for row in rows:
            name = directory(row["event_id"])
            files = {"audio.wav": wav_bytes(row["samples"] or [], row["sample_rate"] or 44_100), "sensors.csv": csv_bytes(row["sensors"] or []), "metadata.json": json.dumps(json.loads(row["metadata"] or "{}"), indent=2).encode()}
            store.create_dir(f"{staging}/{name}", recursive=True)
            for file, content in files.items():
                with store.open_output_stream(f"{staging}/{name}/{file}") as out:
                    out.write(content)
            names.append(name)
        return Written(staging, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        given = [m for m in messages if m is not None]
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if found.type == fs.FileType.Directory and not found.base_name.startswith("_"):
                    store.delete_dir(found.path)
        for message in given:
            for name in dict.fromkeys(message.names):
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.Directory:
                    store.delete_dir(f"{root}/{name}")
                store.move(f"{message.staging}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/_staging-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_staging-{self.job}")


class BundleReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per_partition, self.wanted = path.rstrip("/"), per_partition, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("event_id",) and f.value:
                self.wanted = directory(f.value)
            yield f  # Spark tests all rows again

    def partitions(self) -> list[Bundles]:
        store, root = filesystem(self.path)
        if self.wanted:
            return [Bundles([self.wanted])]
        found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))
        return [Bundles(found[k : k + self.per_partition]) for k in range(0, len(found), self.per_partition)] or [Bundles([])]

    def read(self, partition: Bundles) -> Iterator[tuple]:
        store, root = filesystem(self.path)

        def content(name: str, file: str) -> bytes | None:
            path = f"{root}/{name}/{file}"
            if store.get_file_info(path).type != fs.FileType.File:
                return None
            with store.open_input_stream(path) as f:
                return f.read()

        for name in partition.names:
            audio, sensors, metadata = (content(name, file) for file in ("audio.wav", "sensors.csv", "metadata.json"))
            if audio is sensors is metadata is None:
                continue
            rate, samples = wav_samples(audio) if audio else (None, None)
            yield unquote(name), rate, samples, csv_rows(sensors) if sensors else None, metadata.decode() if metadata else None


class BundleSource(DataSource):
    """Options: path; ``bundlesPerPartition`` (64)."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return BUNDLE

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options["path"], int(self.options.get("bundlesPerPartition", PER_PARTITION)))

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach the reader from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BundleSource)


def bundles_of(rows: DataFrame) -> DataFrame:
    """The rows with a bundle's columns in their order and types; missing ones are null, others are left out."""
    fields = _parse_datatype_string(BUNDLE)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Bundles of all rows. Of rows with one id one is kept; a bundle that is there is replaced."""
    register(rows.sparkSession)
    bundles_of(rows).dropDuplicates(["event_id"]).write.format("bundles").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("bundles").load(path)


def artefact(spark: SparkSession, path: str, event_id: str, kind: str) -> DataFrame:
    """event_id, kind, content (binary), length of one file of an event; no row if the event or the file is unknown."""
    file = f"{path.rstrip('/')}/{directory(event_id)}/{ARTEFACTS[kind]}"
    store, place = filesystem(file)
    if store.get_file_info(place).type != fs.FileType.File:
        return spark.createDataFrame([], "event_id string, kind string, content binary, length long")
    found = spark.read.format("binaryFile").load(file.replace("%", "%25") if "://" in file else file)
    return found.select(F.lit(event_id).alias("event_id"), F.lit(kind).alias("kind"), "content", "length")
