"""Audio kernels and filters against plain re-computations, and edge cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from envsense.config import DEFAULT, Settings
from envsense.functions import columns as C
from envsense.operators import audio, audio_kernels, calibration, catalog, detect, features, filters, fusion
from envsense.streaming.detector import Detector


def tone(seconds=0.2, rate=44_100, f=440.0, noise=0.05, seed=0):
    t = np.arange(int(seconds * rate)) / rate
    return 0.5 * np.sin(2 * np.pi * f * t) + noise * np.random.default_rng(seed).standard_normal(len(t))


def test_classic_finds_the_tone():
    _, confidence, f, m = audio_kernels.fft_classic(tone(noise=0), 44_100)
    assert abs(f["peak_frequency_hz"] - 440) < 3 and m == {"num_samples": "8820"} and confidence >= 0.2
    _, _, f, _ = audio_kernels.fft_classic(np.ones(64), 44_100)
    assert f["infrasound_power_db"] == -math.inf


def test_short_time_spectrum_of_a_tone_and_short_clips():
    m = np.abs(audio_kernels.short_spectra(np.cos(2 * np.pi * 8 * np.arange(4096) / 2048 * 1.0), 2048, 512))
    assert abs(m[8, 4] - 0.5) < 1e-6
    with pytest.raises(ValueError):
        audio_kernels.stft_temporal(np.zeros(1536), 44_100)
    assert audio_kernels.stft_temporal(np.zeros(1600) + 0.1, 44_100)[2]["flux_max"] >= 0
    assert not audio_kernels.stft_temporal(tone(), 44_100)[0] or audio_kernels.stft_temporal(tone(), 44_100)[1] == 0.4


def test_wavelet_keeps_energy_and_lengths():
    a = np.random.default_rng(1).standard_normal(1024)
    low, high = audio_kernels.wavelet_step(a)
    assert len(low) == len(high) == (1024 + 7) // 2
    assert abs(float(audio_kernels.DB4.sum()) - math.sqrt(2)) < 1e-9 and abs(float((audio_kernels.DB4**2).sum()) - 1) < 1e-9
    _, detail = audio_kernels.wavelet_step(np.arange(64.0))
    assert np.abs(detail[4:-4]).max() < 1e-8  # a line has no detail inside
    assert audio_kernels.wavelet_multiresolution(np.ones(512), 44_100)[2]["low_level_energy_ratio"] > 0.99


def test_burg_finds_a_resonance():
    rate, r, f = 44_100, 0.995, 1000.0
    a = np.zeros(4000)
    e = np.random.default_rng(2).standard_normal(4000)
    w = 2 * np.pi * f / rate
    for k in range(2, 4000):
        a[k] = 2 * r * np.cos(w) * a[k - 1] - r * r * a[k - 2] + e[k]
    assert min(abs(x - f) for x in audio_kernels.formants(a, rate)) < 60
    anomaly, confidence, found, metadata = audio_kernels.formant_evp(np.zeros(5), rate)
    assert (anomaly, confidence, found) == (False, 0.0, {}) and "error" in metadata


def test_filterbank_of_silence_and_zero_crossings():
    anomaly, confidence, f, _ = audio_kernels.filterbank_energy(np.zeros(4096), 44_100)
    assert anomaly and confidence == 1.0 and f["max_band_energy_db"] == 0 and f["band_entropy"] < 1e-6
    filters_ = audio_kernels.mel_filters(44_100)
    assert filters_.shape == (32, 1025) and (filters_ >= 0).all()
    _, _, f, _ = audio_kernels.zero_crossing(np.tile([1.0, -1.0], 4096), 44_100)
    assert f["zcr_max"] > 0.99 and f["high_zcr"] == 1.0
    assert audio_kernels.zero_crossing(np.ones(4096), 44_100)[2]["zcr_mean"] == 0


def test_averaged_spectrum_has_the_power_of_the_signal():
    a = tone(1.0, noise=0)
    anomaly, _, f, _ = audio_kernels.averaged_spectrum(a, 44_100)
    assert abs(f["peak_frequency"] - 440) < 44 and isinstance(anomaly, bool)


def test_sql_forms_equal_the_kernels(spark):
    r = np.random.default_rng(3)
    clips = [(k, 44_100, r.standard_normal(64).tolist()) for k in range(4)]
    df = spark.createDataFrame(clips, "clip_id int, sample_rate int, samples array<double>")
    for row in audio.fft_features(df, 44_100).collect():
        _, confidence, f, _ = audio_kernels.fft_classic(np.array(clips[row.clip_id][2]), 44_100)
        assert abs(row.peak_power_db - f["peak_power_db"]) < 1e-9 and abs(row.voice_band_energy_db - f["voice_band_energy_db"]) < 1e-9 and abs(row.confidence - confidence) < 1e-9
    for row in audio.zero_crossings(df, 16, 4).collect():
        _, _, f, _ = audio_kernels.zero_crossing(np.array(clips[row.clip_id][2]), 44_100, 16, 4)
        assert abs(row.zcr_mean - f["zcr_mean"]) < 1e-12 and abs(row.zcr_std - f["zcr_std"]) < 1e-9
    for row in audio.stft_features(df, 44_100, 16, 4).collect():
        _, _, f, _ = audio_kernels.stft_temporal(np.array(clips[row.clip_id][2]), 44_100, 16, 4)
        assert abs(row.flux_max - f["flux_max"]) < 1e-9 and abs(row.centroid_variance / f["centroid_variance"] - 1) < 1e-6
        assert abs(row.spread_mean - f["spread_mean"]) < 1e-3
    assert audio.mel_features(df, 16).count() == 4 and audio.merged_features(audio.analyze(df)).count() == 4


def test_client_peak_literal_is_twice_the_frequency(spark):
    a = np.cos(2 * np.pi * 5 * np.arange(64) / 64)
    df = spark.createDataFrame([(1, 44_100, a.tolist())], "clip_id int, sample_rate int, samples array<double>")
    right, literal = audio.client_spectrum(df, 6400).first(), audio.client_spectrum(df, 6400, literal=True).first()
    assert (right.peak_frequency, literal.peak_frequency) == (500.0, 1000.0)


def test_vote_ties_failures_and_literal_weights(spark):
    names = list(audio.VARIANTS)
    rows = [(1, n, k < 3, 0.0) for k, n in enumerate(names)] + [(2, n, None if k == 0 else False, None if k == 0 else 0.6) for k, n in enumerate(names)] + [(3, n, None, None) for n in names]
    df = spark.createDataFrame(rows, "clip_id int, variant string, anomaly boolean, confidence double")
    got = {r.clip_id: r for r in audio.vote(df).collect()}
    assert got[1].anomaly_detected and got[1].num_anomalies_detected == 3
    assert not got[2].anomaly_detected and got[2].num_variants == 5 and abs(got[2].confidence - 0.5) < 1e-9
    assert (got[3].anomaly_detected, got[3].confidence, got[3].num_variants) == (False, 0.0, 0)
    weights = dict(zip(names, [5.0, 1, 1, 1, 1, 1]))
    right, literal = (next(r for r in audio.vote(df, weights, literal=x).collect() if r.clip_id == 2) for x in (False, True))
    assert abs(right.confidence - 0.3) < 1e-9 and abs(literal.confidence - 0.54) < 1e-9


def test_stream_state_equals_the_batch_filter_and_detector(spark):
    r = random.Random(4)
    rows = [(d, k, r.gauss(50, 5) + (80 if k == 90 else 0)) for d in range(3) for k in range(300)]
    df = spark.createDataFrame(rows, "device_id int, seq int, magnitude double")
    batch = detect.rolling_sigma(filters.kalman_adaptive(df, ["device_id"], ["seq"], "magnitude"), ["device_id"], ["seq"], "filtered").collect()
    batch = {(b.device_id, b.seq): b for b in batch}
    for d in range(3):
        detector = Detector(DEFAULT)
        for _, k, z in rows[d * 300 : d * 300 + 300]:
            x, n, mean, std, _, z_score, anomaly = detector.step(z)
            b = batch[d, k]
            assert abs(b.filtered - x) < 1e-9 and b.n == n and b.anomaly == anomaly and (mean is None) == (b.mean is None)
            if mean is not None:
                assert abs(b.mean - mean) < 1e-9 and abs(b.z_score - z_score) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=60))
def test_filter_stays_inside_its_inputs(values):
    d = Detector(Settings())
    for z in values:
        x = d.step(z)[0]
        assert min(values) - 1e-9 <= x <= max(values) + 1e-9 and d.p > 0 and d.r >= 0


def test_detector_edges(spark):
    flat = [(1, k, 0.1) for k in range(12)] + [(2, k, 5.0 if k < 9 else 1e6) for k in range(10)] + [(3, k, 5.0 if k < 10 else 1e6) for k in range(11)] + [(4, k, None if k == 5 else 1.0) for k in range(12)]
    df = spark.createDataFrame(flat, "device_id int, seq int, v double")
    out = detect.rolling_sigma(df, ["device_id"], ["seq"], "v").collect()
    hits = {r.device_id for r in out if r.anomaly}
    assert hits == {3} and max(r.n for r in out if r.device_id == 4) == 11
    assert detect.one_shot(spark, 95.5, 1).first().anomaly and not detect.one_shot(spark, 50.0, 1).first().anomaly


def test_calibration(spark):
    rows = [("a", -1.0, 2.0, 5.0), ("a", -3.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "device_id string, x double, y double, z double")
    fit = calibration.fit_magnetometer(df, "device_id")
    f, literal = fit.first(), calibration.fit_magnetometer(df, "device_id", literal=True).first()
    assert (f.offset_x, f.offset_y, f.scale_z) == (-2.0, 3.0, 1.0) and abs(literal.offset_x + 1.5) < 1e-9
    half = (2 + 2 + 0) / 3 / 2
    ends = calibration.apply(df, fit, ["device_id"]).collect()
    assert sorted(abs(abs(r.x) - half) < 1e-9 for r in ends) == [True, True]
    other = spark.createDataFrame([("b", 1.0, 2.0, 3.0)], df.schema)
    assert tuple(calibration.apply(other, fit, ["device_id"]).select("x", "y", "z").first()) == (1.0, 2.0, 3.0)
    steps = calibration.next_steps(spark).collect()
    assert len(steps) == 14 and steps[-1].next_step == "COMPLETED" and [s.step for s in steps if s.computes] == ["MAG_FIGURE_8", "CALIBRATE_ACCEL", "CALIBRATE_GYRO"]


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(C.event_id(F.lit(1705501234999999999))) == "event_1705501235"
    assert value(C.frame_indexes(F.lit(300), 4)) == [0, 99, 199, 299]
    assert value(C.pad_or_trim(F.array(F.lit(1.0), F.lit(2.0)), 3)) == [1.0, 2.0, 0.0] and value(C.pad_or_trim(F.array(F.lit(1.0), F.lit(2.0)), 1)) == [1.0]
    assert value(C.downmix(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0))))) == [2.0, 4.0]
    assert value(C.formant_valid(F.array(*map(F.lit, (3900.0, 800.0, 250.0, 300.0))))) == [300.0, 800.0]
    assert value(C.label_index(F.lit("no such"))) == 0 and value(C.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))) == 1


def test_features_and_catalogue(spark):
    rows = spark.createDataFrame([("e", 1, 5.0, 0.5, False, 2)], "event_id string, seq int, magnetic_magnitude double, audio_peak double, humanoid_detected boolean, bluetooth_count int")
    rows = rows.withColumns({c: F.lit(1.0) for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z", "orientation_yaw")})
    assert features.sensor_features(rows, "event_id", ["seq"]).first().mag_std is None
    a = spark.createDataFrame([(1, "x"), (2, "y")], "event_id int, v string")
    assert {tuple(r) for r in catalog.upsert(a, spark.createDataFrame([(2, "z")], a.schema)).collect()} == {(1, "x"), (2, "z")}
    assert features.best_checkpoints(spark.range(9).withColumnRenamed("id", "loss"), "loss").count() == 3
    m = fusion.broadcast_message(spark.createDataFrame([("m",)], "message string"), spark.range(3).withColumnRenamed("id", "client"))
    assert m.count() == 3
    with pytest.raises(ValueError):
        fusion.broadcast_message(m, spark.range(5), most_clients=4)
