"""Packets from JSON, streams, bundles, waveforms."""

import json
import struct
import time
import wave

from pyspark.sql import functions as F

from envsense.operators import catalog, detect, filters, fusion
from envsense.sources import bundles, packets, tables
from envsense.streaming import detector
from tests.conftest import SF

LINES = [
    {"timestamp": 1_000_000_000, "device_id": "a", "magnetometer": {"x": 1, "y": 2, "z": 2, "magnitude": 3.0}, "audio_peak": 0.9, "humanoid_detected": True, "extra": 1},
    {"timestamp": 2_000_000_000, "device_id": "a", "magnetometer": {}},
    {"timestamp": 3_000_000_000, "device_id": "a", "magnetometer": {"x": 1.0}, "audio_peak": None},
    {"device_id": "a"},
    {"timestamp": 4_000_000_000},
    {"timestamp": 5_000_000_000, "device_id": "a", "audio_peak": 7},
]


def test_packets_and_dead_letters(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join([*map(json.dumps, LINES), "{broken"]))
    valid, dead = packets.split_valid(packets.read_packets(spark, str(tmp_path)).persist())
    assert sorted(r.error for r in dead.collect()) == ["INVALID_AUDIO_PEAK", "INVALID_JSON", "MISSING_DEVICE", "MISSING_TIMESTAMP"]
    got = sorted(map(tuple, packets.detector_rows(valid).select("ts_ns", "magnitude", "audio_peak", "humanoid", "bluetooth_count").collect()))
    assert got == [(10**9, 3.0, 0.9, True, 0), (2 * 10**9, None, 0.0, False, 0), (3 * 10**9, 0.0, 0.0, False, 0)]
    text = spark.createDataFrame([(1, json.dumps(LINES[0])), (2, "nope")], "offset int, value string")
    parsed = {r.offset: r for r in packets.parse_packets(text).collect()}
    assert parsed[1].magnetometer.magnitude == 3.0 and parsed[2]._corrupt_record == "nope"


def test_stream_equals_batch(spark, tmp_path):
    p = tables.packets(spark, SF).select(F.col("device_id").cast("string").alias("device_id"), F.lit(0).cast("long").alias("session_id"), "ts", "seq", "magnitude", "audio_peak", "humanoid")
    p = p.where("device_id < '2'")
    cuts = p.selectExpr("percentile(seq, array(0.3, 0.7))").first()[0]
    for k, part in enumerate((p.where(F.col("seq") < cuts[0]), p.where((F.col("seq") >= cuts[0]) & (F.col("seq") < cuts[1])), p.where(F.col("seq") >= cuts[1]))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = detector.fused_stream(detector.detect_stream(stream))
    q = out.writeStream.format("memory").queryName("detected").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    # A query with timeouts has always another batch to run, so it does not end by itself.
    until = time.monotonic() + 120
    while spark.table("detected").count() < p.count() and time.monotonic() < until:
        time.sleep(1)
    q.stop()
    got = {(r.device_id, r.seq): r for r in spark.table("detected").collect()}
    batch = detect.rolling_sigma(filters.kalman_adaptive(p.withColumn("loud", F.lit(1)), ["device_id"], ["ts", "seq"], "magnitude"), ["device_id"], ["ts", "seq"], "filtered").collect()
    assert len(got) == len(batch) > 50
    for b in batch:
        s = got[b.device_id, b.seq]
        assert abs(s.filtered - b.filtered) < 1e-9 and s.n == b.n and s.anomaly == b.anomaly


def test_streams_of_time_and_sinks(spark, tmp_path):
    p = tables.packets(spark, SF).select(F.col("device_id").cast("string").alias("device_id"), "ts", "seq", "magnitude")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    for k, (df, mode) in enumerate(((detector.counters_stream(read(), "1 hour"), "complete"), (detector.once(read()), "append"), (detector.sessions_stream(read(), "1 hour"), "append"))):
        q = df.writeStream.format("memory").queryName(f"s{k}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(200)
    assert spark.table("s0").agg(F.sum("packets")).first()[0] == p.count() == spark.table("s1").count()
    fused = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "device_id string, ts int, is_event boolean")
    write = detector.sink(str(tmp_path / "events"), str(tmp_path / "acks"))
    write(fused, 3)
    write(fused, 3)
    assert spark.read.json(str(tmp_path / "events")).count() == 1 and spark.read.json(str(tmp_path / "acks")).count() == 2


def test_interval_join_of_streams(spark, tmp_path):
    p = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}") for s in range(0, 30, 3)], "device_id string, t string").select("device_id", F.col("t").cast("timestamp").alias("ts"))
    e = spark.createDataFrame([("a", "2024-01-01 00:00:10", "e1")], "device_id string, t string, event_id string").select("device_id", F.col("t").cast("timestamp").alias("ts"), "event_id")
    p.coalesce(1).write.parquet(str(tmp_path / "p"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = detector.event_clips_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), spark.readStream.schema(p.schema).parquet(str(tmp_path / "p")))
    q = out.writeStream.format("memory").queryName("clips").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert sorted(r.ts.second for r in spark.table("clips").collect()) == [9, 12]
    assert fusion.event_clips(e, p, "device_id", "ts", "2 SECONDS", "3 SECONDS").count() == 2


def test_bundles_and_points(spark, tmp_path):
    rows = spark.createDataFrame([("event_2", 1, 5.0), ("event_1", 2, 7.0), ("event_1", 1, 6.0)], "event_id string, seq int, magnetic_magnitude double")
    rest = {c: F.lit(0.0) for c in "accel_x accel_y accel_z gyro_x gyro_y gyro_z orientation_yaw audio_peak".split()}
    rows = rows.withColumns(rest | {"humanoid_detected": F.lit(True), "bluetooth_count": F.lit(1)})
    bundles.write_bundles(rows, str(tmp_path / "b"))
    assert [r.magnetic_magnitude for r in bundles.load_event(spark, str(tmp_path / "b"), "event_1").collect()] == [6.0, 7.0]
    assert bundles.load_event(spark, str(tmp_path / "b"), "none").count() == 0
    for name in ("event_2", "event_1"):
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "metadata.json").write_text(json.dumps({"score": 0.8}, indent=2))
    assert [r.event_id for r in bundles.event_directories(spark, str(tmp_path / "d")).collect()] == ["event_1", "event_2"]
    assert {r.event_id: r.score for r in bundles.read_metadata(spark, str(tmp_path / "d")).collect()} == {"event_1": 0.8, "event_2": 0.8}
    p = spark.createDataFrame([("a", 1.0)], "device_id string, v double").select("device_id", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.struct(F.col("v").alias("x"), F.col("v").alias("y"), F.col("v").alias("z")).alias("acc"))
    bundles.write_points(catalog.points(p, {"accelerometer": "acc"}), str(tmp_path / "pts"))
    assert spark.read.parquet(str(tmp_path / "pts")).first().measurement == "accelerometer"
    one = {f"{k}_{a}": F.lit(1.0) for k in ("offset", "scale") for a in "xyz"}
    bundles.save_calibration(spark.createDataFrame([("a", "mag")], "device_id string, sensor string").withColumns(one | {"timestamp": F.lit(1).cast("long")}), str(tmp_path / "cal"))
    assert bundles.load_calibration(spark, str(tmp_path / "cal")).first().calibrated


def test_waveforms(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<6h", 16384, 0, -32768, -32768, 100, 300))
    r = bundles.read_wav(spark, str(tmp_path), 4).first()
    assert r.sample_rate == 8000 and r.samples == [0.25, -1.0, 200 / 32768, 0.0]
    chunks = spark.createDataFrame([(bytearray(struct.pack("<2h", 16384, -32768)),), (None,)], "data binary")
    got = [x.samples for x in bundles.pcm_chunks(chunks).collect()]
    assert [0.5, -1.0] in got and None in got


def test_settings_from_the_environment():
    from envsense.config import DEFAULT, Settings

    s = Settings.from_env({"ENVSENSE_SIGMAS": "2.5", "ENVSENSE_WINDOW": "7", "OTHER": "1"})
    assert (s.sigmas, s.window, s.kalman_q) == (2.5, 7, DEFAULT.kalman_q) and isinstance(s.window, int)
    assert Settings.from_env({}) == Settings()


def test_many_directories_are_listed_and_read_by_few_tasks(spark, tmp_path):
    """event_metadata: not by a task for each directory, and with a schema no document is read to find one."""
    for k in range(120):
        folder = tmp_path / ("a b" if k % 2 else "c") / f"event_{k}"
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(json.dumps({"event_id": "other", "score": k}, indent=2))
        (folder / "audio.wav").write_bytes(b"x")
        (folder / "_old").mkdir()
        (folder / "_old" / "metadata.json").write_text("{}")
    (tmp_path / "event_without" / "more").mkdir(parents=True)
    sc, tasks = spark.sparkContext, []
    for make in (lambda: bundles.event_directories(spark, str(tmp_path)), lambda: bundles.read_metadata(spark, f"file://{tmp_path}", "event_id string, score long")):
        sc.setJobGroup(f"few-{len(tasks)}", "")
        rows = make().collect()
        assert sorted(r.event_id for r in rows) == sorted(f"event_{k}" for k in range(120))
        stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(f"few-{len(tasks)}") for s in sc.statusTracker().getJobInfo(j).stageIds]
        tasks.append(sum(s.numTasks for s in stages if s))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.event_id: r.score for r in rows} == {f"event_{k}": k for k in range(120)}
    assert max(tasks) < 100
    assert [r.event_id for r in bundles.read_metadata(spark, str(tmp_path / "c" / "event_4")).collect()] == ["event_4"]
    (tmp_path / "none").mkdir()
    assert bundles.event_directories(spark, str(tmp_path / "none")).count() == bundles.read_metadata(spark, str(tmp_path / "none"), "score long").count() == 0
