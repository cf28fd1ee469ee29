"""Bundles written and read back: the same bits, whatever the event is called."""

import io
import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from envsense.sources import bundle_source as B

IDS = ["event_20250117_143052", "a/b c%d", "..", "_x", "ünï", "e.mp4"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    r = np.random.default_rng(1)
    sensors = [(1, 2.5, 0.25, True), (2, None, None, False), (3, 1e-9, 0.1, None)]
    rows = [(e, 44_100, (r.integers(-32768, 32768, 300 + k) / 32768).tolist(), sensors[:k], json.dumps({"k": k, "é": None})) for k, e in enumerate(IDS)]
    df = spark.createDataFrame(rows, B.BUNDLE).repartition(3)
    path = str(tmp_path_factory.mktemp("bundles") / "events")
    B.write(df, path)
    return path, rows


def test_round_trip_is_bit_by_bit(spark, written):
    path, rows = written
    got = {r.event_id: r for r in B.read(spark, path).collect()}
    assert got.keys() == set(IDS)
    for event, rate, samples, sensors, metadata in rows:
        r = got[event]
        assert (r.sample_rate, r.samples, [tuple(s) for s in r.sensors], json.loads(r.metadata)) == (rate, samples, sensors, json.loads(metadata))
    assert not [d for d in os.listdir(path) if d.startswith("_")]
    with wave.open(f"{path}/{B.directory('..')}/audio.wav") as w:
        assert (w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()) == (2, 1, 44_100, 302)
        assert w.readframes(302) == (np.array(rows[2][2]) * 32768).astype("<i2").tobytes()


def test_a_filter_reads_one_bundle(spark, written):
    path, rows = written
    reader = B.BundleReader(path, 2)
    assert [len(p.names) for p in reader.partitions()] == [2, 2, 2]
    one = B.read(spark, path).where(F.col("event_id") == "a/b c%d")
    assert [r.event_id for r in one.collect()] == ["a/b c%d"] and one.rdd.getNumPartitions() == 1
    assert B.read(spark, path).where("event_id = 'nobody'").count() == 0


def test_artefacts_of_an_event(spark, written):
    path, rows = written
    for event in IDS:
        r = B.artefact(spark, path, event, "audio").first()
        assert r.event_id == event and r.length == len(r.content)
        with wave.open(io.BytesIO(r.content)) as w:
            assert w.getnframes() == len(rows[IDS.index(event)][2])
    assert bytes(B.artefact(spark, path, IDS[1], "sensors").first().content) == b"timestamp,magnetic_magnitude,audio_peak,humanoid_detected\n1,2.5,0.25,True\n"
    assert B.artefact(spark, path, "nobody", "audio").count() == B.artefact(spark, path, IDS[0], "video").count() == 0


def test_replacing_clipping_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "e")
    first = spark.createDataFrame([("a", 8000, [2.0, -2.0, None, 0.99999, -1e-9]), ("b", 8000, None), ("a", 8000, [2.0, -2.0, None, 0.99999, -1e-9])], "event_id string, sample_rate int, samples array<double>")
    B.write(first.withColumn("extra", F.lit(1)), path)
    got = {r.event_id: r for r in B.read(spark, path).collect()}
    assert [v * 32768 for v in got["a"].samples] == [32767, -32768, 0, 32767, -1] and got["b"].samples == [] and got["a"].sensors == [] and got["a"].metadata == "{}"
    B.write(spark.createDataFrame([("a", 8000, [0.5])], "event_id string, sample_rate int, samples array<double>"), path)
    assert {r.event_id: r.samples for r in B.read(spark, path).collect()} == {"a": [0.5], "b": []}
    B.write(first.where("event_id = 'b'"), path, "overwrite")
    assert [r.event_id for r in B.read(spark, path).collect()] == ["b"]
    os.remove(f"{path}/b/audio.wav")
    assert B.read(spark, path).first().samples is None


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "e")
    bad = spark.createDataFrame([(f"e{k}", "{}" if k else "{not json") for k in range(8)], "event_id string, metadata string").repartition(4)
    with pytest.raises(Exception):
        B.write(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    B.write(bad.limit(0), path)
    assert not os.path.exists(path) or os.listdir(path) == []
