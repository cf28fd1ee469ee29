"""Analyses of one waveform with numpy: six variants and the averaged-spectrum detector.

Each takes (samples, sample_rate) and returns (anomaly, confidence, features, metadata). Written from the
published formulas of the transforms; thresholds are fixed values.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-10
#: The eight-tap Daubechies low-pass filter.
DB4 = np.array([
    0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
    -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
])


def _confidence(*parts: tuple[bool, float]) -> float:
    return min(1.0, sum(w for on, w in parts if on))


def _top(values: np.ndarray) -> float:
    return float(values.max()) if len(values) else float("-inf")


def fft_classic(a: np.ndarray, rate: int):
    """Unscaled spectrum without DC and Nyquist: loudest below 20 Hz, above 18 kHz and overall, mean of 80-4000 Hz."""
    k = np.arange(1, (len(a) - 1) // 2 + 1)
    f = k * rate / len(a)
    db = 20 * np.log10(np.abs(np.fft.rfft(a))[k] + TINY)
    voice = db[(f >= 80) & (f <= 4000)]
    low, high, peak = _top(db[f < 20]), _top(db[f > 18000]), int(np.argmax(db))
    features = {
        "infrasound_power_db": low, "ultrasound_power_db": high, "peak_frequency_hz": float(f[peak]), "peak_power_db": float(db[peak]),
        "voice_band_energy_db": float(voice.mean()) if len(voice) else float("-inf"),
    }
    flags = low > -40, high > -40, bool(db[peak] > -20)
    return any(flags), _confidence(*zip(flags, (0.4, 0.4, 0.2))), features, {"num_samples": str(len(a))}


def short_spectra(a: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(bins, frames) of the Hann-windowed spectrum, scaled by the window's sum; half a window of zeros at both ends, frames filled up."""
    size = min(size, len(a))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.concatenate([np.zeros(size // 2), a, np.zeros(size // 2)])
    padded = np.append(padded, np.zeros(-(len(padded) - size) % hop % size))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(frames * window, axis=1).T / window.sum()


def stft_temporal(a: np.ndarray, rate: int, size: int = 2048, hop: int = 512):
    """Change, centroid and spread of the spectrum over time."""
    hop = min(size, len(a)) - (size - hop)  # the overlap stays when a short clip shrinks the window
    if hop <= 0:
        raise ValueError("the overlap is not shorter than the window")
    size = min(size, len(a))
    m = np.abs(short_spectra(a, size, hop))
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    flux = np.diff(m, axis=1)
    weight = m.sum(axis=0) + TINY
    centroid = (f * m).sum(axis=0) / weight
    spread = np.sqrt((((f - centroid) ** 2) * m).sum(axis=0) / weight)
    features = {
        "flux_max": float(flux.max()), "flux_mean": float(flux.mean()),
        "centroid_variance": float(centroid.var()), "spread_mean": float(spread.mean()),
    }
    flags = bool(flux.max() > 10), bool(centroid.var() > 1e6)
    return any(flags), _confidence(*zip(flags, (0.6, 0.4))), features, {"num_frames": str(m.shape[1])}


def wavelet_step(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: approximation and detail of floor((n + 7) / 2) values, with symmetric ends."""
    taps = len(DB4)
    high = DB4[::-1] * (-1.0) ** np.arange(taps)
    n = len(a)
    place = np.arange(1 - taps, n + taps - 1) % (2 * n)
    padded = a[np.where(place < n, place, 2 * n - 1 - place)]
    # Windows end at the odd places of the padded signal; the analysis filters are the synthesis ones reversed.
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)[1::2][: (n + taps - 1) // 2]
    return views @ DB4, views @ high


def wavelet_multiresolution(a: np.ndarray, rate: int, levels: int = 6):
    """Energies of the approximation (level 0) and the details, coarse to fine, and the shares of both ends."""
    details = []
    for _ in range(levels):
        a, d = wavelet_step(a)
        details.append(d)
    coefficients = [a, *details[::-1]]
    energy = [float((c**2).sum()) for c in coefficients]
    high, low = energy[-1] / (sum(energy) + TINY), energy[0] / (sum(energy) + TINY)
    features = {f"wavelet_energy_level_{k}": e / len(c) for k, (e, c) in enumerate(zip(energy, coefficients))}
    features |= {"high_level_energy_ratio": high, "low_level_energy_ratio": low}
    flags = high > 0.1, low > 0.5
    return any(flags), _confidence(*zip(flags, (0.5, 0.5))), features, {"levels": str(levels)}


def burg(a: np.ndarray, order: int = 12) -> np.ndarray:
    """Linear prediction coefficients, the first of them 1, by Burg's method."""
    forward, backward = a[1:].astype(float), a[:-1].astype(float)
    coefficients = np.array([1.0])
    if not np.isfinite(a).all() or len(a) <= order:
        raise ValueError("too few or invalid samples")
    for _ in range(order):
        energy = forward @ forward + backward @ backward
        reflection = -2.0 * (backward @ forward) / (energy + np.finfo(float).tiny)
        padded = np.append(coefficients, 0.0)
        coefficients = padded + reflection * padded[::-1]
        forward, backward = (forward + reflection * backward)[1:], (backward + reflection * forward)[:-1]
    return coefficients


def formants(a: np.ndarray, rate: int, order: int = 12) -> list[float]:
    angles = np.angle(np.roots(burg(a, order)))
    return sorted(float(f) for f in angles * rate / (2 * np.pi) if 250 < f < 3800)


def formant_evp(a: np.ndarray, rate: int, order: int = 12):
    """Resonances between 250 and 3800 Hz; a failure is a result without anomaly that still votes."""
    found, features, confidence, voice = [], {}, 0.0, False
    metadata = {"lpc_order": str(order)}
    try:
        found = formants(a, rate, order)
    except (ValueError, np.linalg.LinAlgError) as e:
        return False, 0.0, {}, metadata | {"error": str(e)}
    if len(found) < 2:
        return False, 0.0, {"formant_count": float(len(found))}, metadata
    features = {f"formant_f{k + 1}": f for k, f in enumerate(found[:3])}
    first, second, spacing = 250 < found[0] < 1000, 700 < found[1] < 3800, found[1] - found[0]
    voice = first and second and 600 < spacing < 1400
    features |= {"formant_f1_valid": float(first), "formant_f2_valid": float(second), "f1_f2_spacing": spacing}
    confidence = _confidence((first, 0.3), (second, 0.3), (voice, 0.4))
    return voice, confidence, features, metadata


def mel_filters(rate: int, size: int = 2048, bands: int = 32) -> np.ndarray:
    """(bands, bins) triangles on the Slaney mel scale up to half the rate, each of unit area."""
    top = rate // 2
    step, knee, log_step = 200 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, TINY) / knee) / log_step)
    mels = np.linspace(0, float(to_mel(np.float64(top))), bands + 2)
    edges = np.where(mels < knee / step, mels * step, knee * np.exp(log_step * (mels - knee / step)))
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_spectrogram(a: np.ndarray, rate: int, bands: int = 32, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(bands, frames) of power, frames centred on their time, zeros beyond the ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.concatenate([np.zeros(size // 2), a, np.zeros(size // 2)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return mel_filters(rate, size, bands) @ (np.abs(np.fft.rfft(frames * window, axis=1)) ** 2).T


def power_to_db(power: np.ndarray, floor: float = 80.0) -> np.ndarray:
    """Decibels against the largest value, cut off 80 below it."""
    reference = max(float(power.max()), TINY)
    db = 10 * np.log10(np.maximum(power, TINY)) - 10 * np.log10(reference)
    return np.maximum(db, db.max() - floor)


def filterbank_energy(a: np.ndarray, rate: int, bands: int = 32):
    """Mean decibels of mel bands and the entropy of their distribution."""
    energy = power_to_db(mel_spectrogram(a, rate, bands)).mean(axis=1)
    share = energy - energy.min()
    share = share / (share.sum() + TINY)
    entropy = float(-(share * np.log2(share + TINY)).sum())
    features = {f"band_{k}_energy_db": float(e) for k, e in enumerate(energy)}
    features |= {"max_band_energy_db": float(energy.max()), "max_band_index": float(energy.argmax()), "band_entropy": entropy}
    flags = entropy < 3.0, bool(energy.max() > -30)
    return any(flags), _confidence(*zip(flags, (0.4, 0.6))), features, {"num_bands": str(bands)}


def zero_crossing(a: np.ndarray, rate: int, size: int = 2048, hop: int = 512):
    """Share of sign changes in frames, the ends repeated."""
    padded = np.pad(a, size // 2, mode="edge")
    negative = np.signbit(np.where(np.abs(padded) <= TINY, 0.0, padded))
    frames = np.lib.stride_tricks.sliding_window_view(negative, size)[::hop]
    rates = (frames[:, 1:] != frames[:, :-1]).sum(axis=1) / size
    flags = bool(rates.mean() > 0.15), bool(rates.std() > 0.05)
    features = {"zcr_mean": float(rates.mean()), "zcr_std": float(rates.std()), "zcr_max": float(rates.max()), "high_zcr": float(flags[0]), "variable_zcr": float(flags[1])}
    return any(flags), _confidence(*zip(flags, (0.5, 0.5))), features, {}


def averaged_spectrum(a: np.ndarray, rate: int, size: int = 1024):
    """Power density averaged over half-overlapping Hann windows without their means; infrasound, ultrasound or formants are anomalies."""
    size = min(size, len(a))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames = np.lib.stride_tricks.sliding_window_view(a, size)[:: size - size // 2]
    frames = frames - frames.mean(axis=1, keepdims=True)
    power = (np.abs(np.fft.rfft(frames * window, axis=1)) ** 2).mean(axis=0) / (rate * (window**2).sum())
    power[1 : -1 if size % 2 == 0 else None] *= 2
    f = np.fft.rfftfreq(size, 1 / rate)
    db = 10 * np.log10(power + TINY)
    try:
        voices = formants(a, rate)[:3]
    except (ValueError, np.linalg.LinAlgError):
        voices = []
    flags = _top(db[f < 20]) > -40, _top(db[f > 18000]) > -40, len(voices) >= 2
    features = {"infrasound": float(flags[0]), "ultrasound": float(flags[1]), "formants": float(flags[2]), "peak_frequency": float(f[np.argmax(power)]), "peak_power_db": float(db.max())}
    return any(flags), _confidence(*zip(flags, (0.4, 0.4, 0.2))), features, {}
