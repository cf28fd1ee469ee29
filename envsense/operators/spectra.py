"""Spectra of batches of clips: clips of one length are one two-dimensional array, and one transform serves them all.

A clip is (clip_id, sample_rate, samples array<double>). Python workers get Arrow batches, cut them into arrays of
at most ``CELLS`` numbers and return a row of features for each clip. The time is n log n in a clip's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audio_kernels import mel_filters

TINY = 1e-10
#: Numbers of the arrays that are worked on at a time (but for a single longer clip).
CELLS = 1 << 21


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stacked(samples: pa.ListArray, rates: np.ndarray, cells_each: Callable[[int], int] = lambda n: n) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, array of their samples, rate) for clips of equal length and rate; ``cells_each`` gives the numbers that a clip needs. A null sample is NaN, a null clip is empty."""
    lengths = samples.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.asarray(samples.offsets)[:-1].astype(np.int64)
    values = samples.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for n, rate in sorted(set(zip(lengths.tolist(), rates.tolist()))):
        rows = np.flatnonzero((lengths == n) & (rates == rate))
        step = max(1, CELLS // max(1, cells_each(n)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            yield part, values[first[part][:, None] + np.arange(n)], rate


def by_batches(clips: DataFrame, kernel: Callable[[np.ndarray, int], dict[str, np.ndarray]], fields: dict[str, str], cells_each: Callable[[int], int] = lambda n: n, rate: int | None = None) -> DataFrame:
    """clip_id and ``fields`` (name -> type) of each clip, as ``kernel`` gives them for an array of clips and their rate; NaN becomes null.

    Types are double, boolean and array<double> (of one length for all clips of an array). ``rate`` replaces the clips' own.
    """
    kinds = {"double": np.float64, "boolean": bool, "array<double>": object}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: np.zeros(batch.num_rows, kinds[kind]) for name, kind in fields.items()}
            for rows, array, own in stacked(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), cells_each):
                for name, values in kernel(array, own).items():
                    if fields[name] == "array<double>":
                        for r, v in zip(rows, values):
                            out[name][r] = v
                    else:
                        out[name][rows] = values
            columns = [pa.array(list(v), pa.list_(pa.float64())) if v.dtype == object else pa.array(v, mask=np.isnan(v) if v.dtype == np.float64 else None) for v in out.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["clip_id", *fields])

    kind = clips.schema["clip_id"].dataType.simpleString()
    own = F.lit(rate) if rate else F.coalesce("sample_rate", F.lit(44_100))
    return clips.select("clip_id", "samples", own.cast("int").alias("rate")).mapInArrow(run, ", ".join([f"clip_id {kind}", *(f"{name} {t}" for name, t in fields.items())]))


def _best(db: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The greatest value of each row among some bins; NaN without a bin."""
    return db[:, bins].max(axis=1) if bins.any() else np.full(len(db), np.nan)


BAND = {"infrasound_power_db": "double", "ultrasound_power_db": "double", "peak_frequency_hz": "double", "peak_power_db": "double", "voice_band_energy_db": "double"}


def fft_features(clips: DataFrame, rate: int | None = None) -> DataFrame:
    """The classic variant's features and verdict; a band without a bin is null and raises no flag.

    Bins are those above 0 and below half the rate. A clip of under three samples, or a null one, has no bins.
    """

    def kernel(a: np.ndarray, rate: int) -> dict[str, np.ndarray]:
        n = a.shape[1]
        k = np.arange(1, (n - 1) // 2 + 1)
        if not len(k):
            return {name: np.full(len(a), np.nan) for name in BAND}
        f = k * rate / n
        db = 20 * np.log10(np.abs(np.fft.rfft(a, axis=1)[:, k]) + TINY)
        voice = (f >= 80) & (f <= 4000)
        mean = db[:, voice].mean(axis=1) if voice.any() else np.full(len(a), np.nan)
        return dict(zip(BAND, (_best(db, f < 20), _best(db, f > 18000), f[db.argmax(axis=1)], db.max(axis=1), mean)))

    out = by_batches(clips, kernel, BAND, rate=rate)
    low, high, peak = (F.coalesce(F.col(c) > t, F.lit(False)) for c, t in (("infrasound_power_db", -40), ("ultrasound_power_db", -40), ("peak_power_db", -20)))
    part = lambda flag, w: F.when(flag, F.lit(w)).otherwise(0.0)
    return out.withColumns({"anomaly": low | high | peak, "confidence": F.least(part(low, 0.4) + part(high, 0.4) + part(peak, 0.2), F.lit(1.0))})


def client_spectrum(clips: DataFrame, rate: int | None = None, *, literal: bool = False) -> DataFrame:
    """Peak of the Hann-windowed magnitude spectrum (bins 0 … n/2 - 1, first of equals).

    ``literal`` divides by half the length, which gives about twice the frequency. Clips without a bin have nulls.
    """

    def kernel(a: np.ndarray, rate: int) -> dict[str, np.ndarray]:
        n = a.shape[1]
        if n < 2:
            return {name: np.full(len(a), np.nan) for name in ("peak_frequency", "peak_magnitude")}
        mag = np.abs(np.fft.rfft(a * hann(n), axis=1))[:, : (n + 1) // 2]
        k = np.round(mag, 9).argmax(axis=1)
        return {"peak_frequency": k * float(rate) / (n / 2 if literal else n), "peak_magnitude": mag.max(axis=1)}

    return by_batches(clips, kernel, {"peak_frequency": "double", "peak_magnitude": "double"}, rate=rate)


FLUX = {"flux_max": "double", "flux_mean": "double", "centroid_variance": "double", "spread_mean": "double"}


def short_time(a: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(clips, frames, bins) of magnitudes under a Hann window, scaled by its sum; half a window of zeros at both ends, frames filled up."""
    half = size // 2
    fill = -(a.shape[1] + 2 * half - size) % hop
    padded = np.pad(a, ((0, 0), (half, half + fill)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size, axis=1)[:, ::hop]
    return np.abs(np.fft.rfft(frames * hann(size), axis=2)) / hann(size).sum()


def stft_features(clips: DataFrame, rate: int | None = None, size: int = 2048, hop: int = 512) -> DataFrame:
    """Flux, centroid variance and spread of short-time spectra, with the verdict (flux above 10, variance above 10^6).

    A clip shorter than the window shrinks it and keeps the overlap; where that leaves no step, all is null and no anomaly.
    """

    def kernel(a: np.ndarray, rate: int) -> dict[str, np.ndarray]:
        wide = min(size, a.shape[1])
        step = wide - (size - hop)
        if step <= 0:
            return {name: np.full(len(a), np.nan) for name in FLUX}
        m = short_time(a, wide, step)
        f = np.fft.rfftfreq(wide, 1 / rate)
        flux = np.diff(m, axis=1)
        weight = m.sum(axis=2) + TINY
        centroid = (m * f).sum(axis=2) / weight
        spread = np.sqrt((m * (f - centroid[:, :, None]) ** 2).sum(axis=2) / weight)
        return dict(zip(FLUX, (flux.max(axis=(1, 2)), flux.mean(axis=(1, 2)), centroid.var(axis=1), spread.mean(axis=1))))

    out = by_batches(clips, kernel, FLUX, lambda n: 2 * size * (n // hop + 2), rate)
    high, moves = F.coalesce(F.col("flux_max") > 10, F.lit(False)), F.coalesce(F.col("centroid_variance") > 1e6, F.lit(False))
    part = lambda flag, w: F.when(flag, F.lit(w)).otherwise(0.0)
    return out.withColumns({"anomaly": high | moves, "confidence": F.least(part(high, 0.6) + part(moves, 0.4), F.lit(1.0))})


def mel_decibels(a: np.ndarray, rate: int, bands: int, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(clips, bands, frames): mel power in decibels against each clip's largest, cut off 80 below; frames are centred, zeros beyond the ends."""
    padded = np.pad(a, ((0, 0), (size // 2, size // 2)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size, axis=1)[:, ::hop]
    power = np.abs(np.fft.rfft(frames * hann(size), axis=2)) ** 2
    mel = np.maximum(np.einsum("bk,cfk->cbf", mel_filters(rate, size, bands), power), TINY)
    db = 10 * np.log10(mel) - 10 * np.log10(mel.max(axis=(1, 2), keepdims=True))
    return np.maximum(db, db.max(axis=(1, 2), keepdims=True) - 80.0)


def mel_spectrogram(clips: DataFrame, bands: int = 128, rate: int | None = None) -> DataFrame:
    """clip_id, frames, mel: the log mel spectrogram as one array, band by band, for learning."""

    def kernel(a: np.ndarray, own: int) -> dict[str, np.ndarray]:
        db = mel_decibels(a, own, bands)
        return {"frames": np.full(len(a), float(db.shape[2])), "mel": db.reshape(len(a), -1)}

    return by_batches(clips, kernel, {"frames": "double", "mel": "array<double>"}, lambda n: 2048 * (n // 512 + 1), rate).withColumn("frames", F.col("frames").cast("int"))


def filterbank_features(clips: DataFrame, rate: int | None = None, bands: int = 32) -> DataFrame:
    """The filter bank variant: mean decibels of mel bands, their maximum, the entropy of their shares, and the verdict (entropy under 3, maximum over -30)."""

    def kernel(a: np.ndarray, own: int) -> dict[str, np.ndarray]:
        energy = mel_decibels(a, own, bands).mean(axis=2)
        part = energy - energy.min(axis=1, keepdims=True)
        part = part / (part.sum(axis=1, keepdims=True) + TINY)
        return {"band_energy_db": energy, "max_band_energy_db": energy.max(axis=1), "max_band_index": energy.argmax(axis=1), "band_entropy": -(part * np.log2(part + TINY)).sum(axis=1)}

    fields = {"band_energy_db": "array<double>", "max_band_energy_db": "double", "max_band_index": "double", "band_entropy": "double"}
    out = by_batches(clips, kernel, fields, lambda n: 2048 * (n // 512 + 1), rate)
    few, loud = F.coalesce(F.col("band_entropy") < 3.0, F.lit(False)), F.coalesce(F.col("max_band_energy_db") > -30, F.lit(False))
    return out.withColumns({"anomaly": few | loud, "confidence": F.when(few, 0.4).otherwise(0.0) + F.when(loud, 0.6).otherwise(0.0)})


def prediction(a: np.ndarray, order: int) -> np.ndarray:
    """(clips, order + 1): linear prediction coefficients by Burg's method, the first of them 1; NaN for clips that are too short or not finite."""
    out = np.full((len(a), order + 1), np.nan)
    good = np.isfinite(a).all(axis=1) if a.shape[1] > order else np.zeros(len(a), bool)
    forward, backward = a[good, 1:], a[good, :-1]
    made = np.ones((int(good.sum()), 1))
    for _ in range(order if good.any() else 0):
        energy = (forward**2).sum(axis=1) + (backward**2).sum(axis=1)
        k = -2 * (forward * backward).sum(axis=1) / (energy + np.finfo(float).tiny)
        wide = np.pad(made, ((0, 0), (0, 1)))
        made = wide + k[:, None] * wide[:, ::-1]
        forward, backward = (forward + k[:, None] * backward)[:, 1:], (backward + k[:, None] * forward)[:, :-1]
    if good.any():
        out[good] = made
    return out


def resonances(coefficients: np.ndarray, rate: int) -> np.ndarray:
    """(clips, order): the frequencies between 250 and 3800 Hz of a predictor's roots, ascending, then NaN."""
    n, order = len(coefficients), coefficients.shape[1] - 1
    good = np.isfinite(coefficients).all(axis=1)
    companion = np.zeros((int(good.sum()), order, order))
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1
    companion[:, 0] = -coefficients[good, 1:]
    f = np.full((n, order), np.nan)
    f[good] = np.angle(np.linalg.eigvals(companion)) * rate / (2 * np.pi)
    f[~((f > 250) & (f < 3800))] = np.nan
    return np.sort(f, axis=1)


def prediction_coefficients(clips: DataFrame, order: int = 12) -> DataFrame:
    """clip_id, coefficients (null for clips that are too short or not finite)."""
    out = by_batches(clips, lambda a, _: {"coefficients": prediction(a, order)}, {"coefficients": "array<double>"})
    return out.withColumn("coefficients", F.when(~F.exists("coefficients", F.isnan), F.col("coefficients")))


FORMANT = {"formant_count": "double", "formant_f1": "double", "formant_f2": "double", "formant_f3": "double", "failed": "boolean"}


def formant_features(clips: DataFrame, rate: int | None = None, order: int = 12) -> DataFrame:
    """The voice variant: the first resonances, whether they are those of a voice, and the verdict. ``failed``: a clip that has no predictor; it votes all the same."""

    def kernel(a: np.ndarray, own: int) -> dict[str, np.ndarray]:
        made = prediction(a, order)
        f = resonances(made, own)
        return {"formant_count": np.isfinite(f).sum(axis=1), "formant_f1": f[:, 0], "formant_f2": f[:, 1], "formant_f3": f[:, 2], "failed": np.isnan(made).any(axis=1)}

    out = by_batches(clips, kernel, FORMANT, rate=rate)
    enough = F.col("formant_count") >= 2
    f1, f2 = (F.when(enough, F.col(f"formant_f{k}")) for k in (1, 2))
    out = out.withColumns({"formant_f1_valid": (f1 > 250) & (f1 < 1000), "formant_f2_valid": (f2 > 700) & (f2 < 3800), "f1_f2_spacing": f2 - f1})
    out = out.withColumns({f"formant_f{k}": F.when(enough, F.col(f"formant_f{k}")) for k in (1, 2, 3)})
    one, two = (F.coalesce(f"formant_f{k}_valid", F.lit(False)) for k in (1, 2))
    voice = one & two & F.coalesce((F.col("f1_f2_spacing") > 600) & (F.col("f1_f2_spacing") < 1400), F.lit(False))
    part = lambda flag, w: F.when(flag, F.lit(w)).otherwise(0.0)
    return out.withColumns({"anomaly": voice, "confidence": F.least(part(one, 0.3) + part(two, 0.3) + part(voice, 0.4), F.lit(1.0))})


AVERAGED = {"infrasound": "boolean", "ultrasound": "boolean", "formants": "boolean", "peak_frequency": "double", "peak_power_db": "double"}


def averaged_features(clips: DataFrame, rate: int | None = None, size: int = 1024, order: int = 12) -> DataFrame:
    """Power density averaged over half-overlapping Hann windows without their means; infrasound, ultrasound or two formants are anomalies. An empty clip has nulls."""

    def kernel(a: np.ndarray, own: int) -> dict[str, np.ndarray]:
        n = min(size, a.shape[1])
        if not n:
            return {c: np.full(len(a), np.nan if t == "double" else False) for c, t in AVERAGED.items()}
        frames = np.lib.stride_tricks.sliding_window_view(a, n, axis=1)[:, :: n - n // 2]
        frames = frames - frames.mean(axis=2, keepdims=True)
        power = (np.abs(np.fft.rfft(frames * hann(n), axis=2)) ** 2).mean(axis=1) / (own * max((hann(n) ** 2).sum(), np.finfo(float).tiny))
        power[:, 1 : -1 if n % 2 == 0 else None] *= 2
        f, db = np.fft.rfftfreq(n, 1 / own), 10 * np.log10(power + TINY)
        low, high = (_best(db, x) > -40 for x in (f < 20, f > 18000))
        voices = np.isfinite(resonances(prediction(a, order), own)).sum(axis=1) >= 2
        return dict(zip(AVERAGED, (low, high, voices, f[power.argmax(axis=1)], db.max(axis=1))))

    out = by_batches(clips, kernel, AVERAGED, lambda n: 3 * n, rate)
    part = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(0.0)
    return out.withColumns({"anomaly": F.col("infrasound") | F.col("ultrasound") | F.col("formants"), "confidence": F.least(part("infrasound", 0.4) + part("ultrasound", 0.4) + part("formants", 0.2), F.lit(1.0))})
