"""Batched spectra and the filter bank against the kernels of single clips."""

import numpy as np

from envsense.operators import audio, audio_kernels, spectra


def clips_of(spark, lengths, seed=5):
    rng = np.random.default_rng(seed)
    made = [(k, 44_100, None if n is None else (rng.standard_normal(n) * (k + 1)).tolist()) for k, n in enumerate(lengths)]
    return made, spark.createDataFrame(made, "clip_id int, sample_rate int, samples array<double>").repartition(2)


def test_features_of_clips_of_many_lengths(spark):
    made, df = clips_of(spark, [4096, 1600, 4096, 44_100, 3, 5000, 1600])
    for r in audio.fft_features(df, 44_100).collect():
        anomaly, confidence, f, _ = audio_kernels.fft_classic(np.array(made[r.clip_id][2]), 44_100)
        assert (r.anomaly, round(r.confidence, 9)) == (anomaly, round(confidence, 9))
        for name, v in f.items():
            assert r[name] is None if np.isinf(v) else abs(r[name] - v) < 1e-9
    for r in audio.stft_features(df, 44_100).collect():
        a = np.array(made[r.clip_id][2])
        if len(a) <= 1536:
            assert r.flux_max is None and not r.anomaly
            continue
        anomaly, confidence, f, _ = audio_kernels.stft_temporal(a, 44_100)
        assert r.anomaly == anomaly and abs(r.confidence - confidence) < 1e-9
        np.testing.assert_allclose([r[n] for n in f], [*f.values()], rtol=1e-9)


def test_clips_without_bins(spark):
    _, df = clips_of(spark, [None, 0, 1, 2, 64])
    rows = {r.clip_id: r for r in audio.fft_features(df, 44_100).collect()}
    assert all(rows[k].peak_power_db is None and not rows[k].anomaly and rows[k].confidence == 0 for k in range(4)) and rows[4].peak_power_db is not None
    peaks = {r.clip_id: r.peak_frequency for r in audio.client_spectrum(df, 44_100).collect()}
    assert [peaks[k] is None for k in range(5)] == [True, True, True, False, False]
    assert audio.fft_features(df.limit(0), 44_100).count() == audio.stft_features(df.limit(0), 44_100).count() == 0


def test_arrays_are_cut_to_cells(spark, monkeypatch):
    monkeypatch.setattr(spectra, "CELLS", 100)
    import pyarrow as pa

    lists = pa.array([[1.0, 2.0], None, [3.0, None], [4.0] * 60, [5.0] * 60], pa.list_(pa.float64()))
    got = [(rows.tolist(), array.shape) for rows, array, _ in spectra.stacked(lists.slice(1), np.full(4, 8000))]
    assert got == [([0], (1, 0)), ([1], (1, 2)), ([2], (1, 60)), ([3], (1, 60))]


def test_wavelet_levels_equal_the_kernel(spark):
    made, df = clips_of(spark, [512, 9, 1, 44, None, 1000])
    got = {r.clip_id: r for r in audio.wavelet_features(df).collect()}
    assert got.keys() == {0, 1, 2, 3, 5}
    for k, r in got.items():
        anomaly, confidence, f, _ = audio_kernels.wavelet_multiresolution(np.array(made[k][2]), 44_100)
        assert (r.anomaly, r.confidence) == (anomaly, confidence)
        np.testing.assert_allclose([r[n] for n in f], [*f.values()], rtol=1e-9, atol=1e-12)


def test_all_variants_equal_their_kernels(spark):
    made, df = clips_of(spark, [4096, 1600, 9000, 20, 5, 4096])
    for r in audio.analyze(df).collect():
        kernel = audio.VARIANTS[r.variant]
        try:
            anomaly, confidence, features, metadata = kernel(np.array(made[r.clip_id][2]), 44_100)
        except ValueError:
            assert r.anomaly is None and r.error
            continue
        assert (r.anomaly, round(r.confidence, 9), bool(r.error)) == (anomaly, round(confidence, 9), "error" in metadata), r
        missing = {k for k, v in features.items() if np.isinf(v)}
        assert set(r.features) == set(features) and all(np.isinf(r.features[k]) for k in missing)
        for k in features.keys() - missing:
            assert abs(r.features[k] - features[k]) < 1e-6 * max(1, abs(features[k])), (r.variant, k)
        if r.variant == "fft_classic":
            assert r.metadata == metadata
    for r in audio.averaged(df).collect():
        anomaly, confidence, features, _ = audio_kernels.averaged_spectrum(np.array(made[r.clip_id][2]), 44_100)
        assert (r.anomaly, round(r.confidence, 9)) == (anomaly, round(confidence, 9))
        assert all(abs(r.features[k] - v) < 1e-6 for k, v in features.items())
    mel = {r.clip_id: r.mel for r in audio.mel_features(df, 16).collect()}
    for k, _, a in made:
        np.testing.assert_allclose(mel[k], audio_kernels.power_to_db(audio_kernels.mel_spectrogram(np.array(a), 44_100, 16)), atol=1e-9)


def test_variants_of_empty_clips(spark):
    _, df = clips_of(spark, [None, 0])
    rows = audio.analyze(df).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.anomaly is None) == (r.variant not in ("formant_evp", "filterbank_energy")), r
    assert audio.analyze(df.limit(0)).count() == audio.averaged(df.limit(0)).count() == 0
    assert all(r.anomaly is None for r in audio.averaged(df).collect())
