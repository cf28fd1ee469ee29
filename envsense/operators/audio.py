"""Waveform analysis on DataFrames of clips: array functions, Arrow kernels, and the vote. Spectra are in ``spectra``.

A clip is (clip_id, sample_rate, samples array<double>). Kernels run a batch of clips in a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import VARIANT
from . import audio_kernels
from .spectra import averaged_features, client_spectrum, fft_features, filterbank_features, formant_features, mel_spectrogram, stft_features  # noqa: F401

#: Variants in the order of their weights. Others are added with ``register``.
VARIANTS: dict[str, Callable] = {
    "fft_classic": audio_kernels.fft_classic, "stft_temporal": audio_kernels.stft_temporal,
    "wavelet_multiresolution": audio_kernels.wavelet_multiresolution, "formant_evp": audio_kernels.formant_evp,
    "filterbank_energy": audio_kernels.filterbank_energy, "zero_crossing": audio_kernels.zero_crossing,
}


#: Those that ``analyze`` does for batches of clips.
BUILT_IN = tuple(VARIANTS)


def register(name: str, kernel: Callable) -> None:
    """Make a kernel (samples, rate) -> (anomaly, confidence, features, metadata) a variant."""
    VARIANTS[name] = kernel


def zero_crossings(clips: DataFrame, size: int, hop: int) -> DataFrame:
    """Sign changes in frames of ``size`` by array functions: zcr_mean, zcr_std (population), zcr_max and the flags."""
    half = size // 2
    first, last = F.get("samples", F.lit(0)), F.get("samples", F.size("samples") - 1)
    padded = F.concat(F.array_repeat(first, half), F.col("samples"), F.array_repeat(last, half))
    signs = F.transform(padded, lambda v: v < F.lit(-1e-10))
    frames = clips.select("clip_id", signs.alias("s")).select("clip_id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - size, F.lit(hop))).alias("at"))
    changes = F.size(F.filter(F.arrays_zip(F.slice("s", F.col("at") + 1, F.lit(size - 1)).alias("a"), F.slice("s", F.col("at") + 2, F.lit(size - 1)).alias("b")), lambda x: x["a"] != x["b"]))
    rates = frames.select("clip_id", (changes / F.lit(float(size))).alias("zcr"))
    out = rates.groupBy("clip_id").agg(F.avg("zcr").alias("zcr_mean"), F.stddev_pop("zcr").alias("zcr_std"), F.max("zcr").alias("zcr_max"))
    return out.withColumns({"high_zcr": F.col("zcr_mean") > 0.15, "variable_zcr": F.col("zcr_std") > 0.05})


def _mirrored(a: str) -> str:
    """The array column with seven more values at each end, mirrored about its ends as often as need be, in SQL."""
    ends = len(audio_kernels.DB4) - 1
    place = f"get({a}, CASE WHEN pmod(i, 2 * size({a})) < size({a}) THEN pmod(i, 2 * size({a})) ELSE 2 * size({a}) - 1 - pmod(i, 2 * size({a})) END)"
    wide = f"concat(reverse(slice({a}, 1, {ends})), {a}, reverse(slice({a}, size({a}) - {ends - 1}, {ends})))"
    return f"CASE WHEN size({a}) >= {ends} THEN {wide} ELSE transform(sequence(-{ends}, size({a}) + {ends - 1}), i -> {place}) END"


def _filtered(a: str, taps: list[float]) -> str:
    """Every other value of the convolution of a mirrored array column, in SQL: plans of these are parsed, not built call by call."""
    summed = " + ".join(f"get(w, at + {k}) * {v!r}D" for k, v in enumerate(taps))
    return f"get(transform(array({_mirrored(a)}), w -> transform(sequence(1, 2 * ((size({a}) + {len(taps) - 1}) div 2) - 1, 2), at -> {summed})), 0)"


def wavelet_levels(clips: DataFrame, levels: int = 6) -> DataFrame:
    """clip_id, level, length, energy of the wavelet coefficients: level 0 is the approximation, 1 the coarsest details.

    A filter bank of array functions: each level keeps every other value of two convolutions of the level above. The
    time is linear in a clip's length. A null or empty clip has no rows.
    """
    low = [float(v) for v in audio_kernels.DB4]
    high = [v * (-1.0) ** k for k, v in enumerate(reversed(low))]
    energy = lambda d, level: f"named_struct('level', {level}, 'length', size({d}), 'energy', aggregate({d}, 0.0D, (s, v) -> s + v * v))"
    rows = clips.where(F.size("samples") > 0).selectExpr("clip_id", "samples AS a0", "CAST(array() AS array<struct<level:int,length:int,energy:double>>) AS done")
    for k in range(levels):
        part = f"get(transform(array({_filtered(f'a{k}', high)}), d -> {energy('d', levels - k)}), 0)"
        rows = rows.selectExpr("clip_id", f"{_filtered(f'a{k}', low)} AS a{k + 1}", f"concat(done, array({part})) AS done")
    return rows.selectExpr("clip_id", f"inline(concat(done, array({energy(f'a{levels}', 0)})))")


def wavelet_features(clips: DataFrame, levels: int = 6) -> DataFrame:
    """The wavelet variant: mean energies of the levels, the shares of both ends, and the verdict."""
    rows = wavelet_levels(clips, levels)
    total = F.sum("energy") + F.lit(1e-10)
    of = lambda k: F.max(F.when(F.col("level") == k, F.col("energy")))
    means = [F.max(F.when(F.col("level") == k, F.col("energy") / F.col("length"))).alias(f"wavelet_energy_level_{k}") for k in range(levels + 1)]
    out = rows.groupBy("clip_id").agg(*means, (of(levels) / total).alias("high_level_energy_ratio"), (of(0) / total).alias("low_level_energy_ratio"))
    high, low = F.col("high_level_energy_ratio") > 0.1, F.col("low_level_energy_ratio") > 0.5
    return out.withColumns({"anomaly": high | low, "confidence": F.when(high, 0.5).otherwise(0.0) + F.when(low, 0.5).otherwise(0.0)})


def _named(columns: dict[str, Column]) -> Column:
    """A map of the features that are not null; flags are 0 and 1."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), c.cast("double").alias("value")) for k, c in columns.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _variant_rows(name: str, clips: DataFrame) -> DataFrame:
    """One variant's results for all clips: clip_id and the columns of VARIANT but the name. No verdict where it fails."""
    none = F.lit(None).cast("string")
    columns = lambda df, *skip: {c: F.col(c) for c in df.columns if c not in ("clip_id", "anomaly", "confidence", *skip)}
    about = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*(v.cast("string") if isinstance(v, Column) else F.lit(str(v)) for v in kv.values())))
    sizes = clips.select("clip_id", F.coalesce(F.size("samples"), F.lit(0)).alias("n"))
    if name == "fft_classic":
        out = fft_features(clips.withColumn("clip_id", F.struct("clip_id", F.greatest(F.coalesce(F.size("samples"), F.lit(0)), F.lit(0)).alias("n"))))
        out = out.select(F.col("clip_id.clip_id").alias("clip_id"), F.col("clip_id.n").alias("n_"), *[c for c in out.columns if c != "clip_id"])
        bands = {c: F.coalesce(c, F.lit(float("-inf"))) if c not in ("peak_frequency_hz", "peak_power_db") else F.col(c) for c in columns(out, "n_")}
        failed, features, metadata = F.when(F.col("peak_power_db").isNull(), F.lit("a clip without a bin")), _named(bands), about(num_samples=F.col("n_"))
    elif name == "stft_temporal":
        out = stft_features(clips)
        failed, features, metadata = F.when(F.col("flux_max").isNull(), F.lit("the overlap is not shorter than the window")), _named(columns(out)), about()
    elif name == "wavelet_multiresolution":
        out = sizes.join(wavelet_features(clips), "clip_id", "left").drop("n")
        failed, features, metadata = F.when(F.col("anomaly").isNull(), F.lit("an empty clip")), _named(columns(out)), about(levels=6)
    elif name == "formant_evp":
        out = formant_features(clips)
        found = {c: F.when(~F.col("failed"), F.col(c)) for c in columns(out, "failed", "formant_count")}
        found |= {"formant_count": F.when(~F.col("failed") & (F.col("formant_count") < 2), F.col("formant_count"))}
        rows = out.select("clip_id", "anomaly", "confidence", _named(found).alias("features"), about(lpc_order=12).alias("metadata"), F.when(F.col("failed"), F.lit("too few or invalid samples")).alias("error"))
        return rows
    elif name == "filterbank_energy":
        out = filterbank_features(clips)
        bands = {f"band_{k}_energy_db": F.get("band_energy_db", F.lit(k)) for k in range(32)}
        failed, features, metadata = none, _named(bands | columns(out, "band_energy_db")), about(num_bands=32)
    else:
        out = zero_crossings(clips.where(F.size("samples") > 0), 2048, 512)
        out = sizes.join(out, "clip_id", "left").drop("n")
        flags = F.col("high_zcr") | F.col("variable_zcr")
        out = out.withColumns({"anomaly": flags, "confidence": F.when(F.col("high_zcr"), 0.5).otherwise(0.0) + F.when(F.col("variable_zcr"), 0.5).otherwise(0.0)})
        failed, features, metadata = F.when(F.col("zcr_mean").isNull(), F.lit("an empty clip")), _named(columns(out)), F.create_map().cast("map<string,string>")
    verdict = lambda c: F.when(failed.isNull(), F.col(c))
    return out.select("clip_id", verdict("anomaly").alias("anomaly"), verdict("confidence").alias("confidence"), F.when(failed.isNull(), features).alias("features"), F.when(failed.isNull(), metadata).alias("metadata"), failed.alias("error"))


def analyze(clips: DataFrame, names: list[str] | None = None, kernels: dict[str, Callable] | None = None) -> DataFrame:
    """clip_id and one variant's result a row; a variant that fails has ``error`` set and no verdict (but for the voice variant, which votes).

    The six variants are those of ``spectra`` and this module, for batches of clips. Kernels that were registered,
    or are given, run clip by clip.
    """
    own = {n: k for n, k in (VARIANTS if kernels is None else kernels).items() if names is None or n in names}
    built = [n for n in own if kernels is None and n in BUILT_IN]
    rows = [_variant_rows(n, clips).withColumn("variant", F.lit(n)) for n in built]
    other = {n: k for n, k in own.items() if n not in built}
    if other:
        rows.append(_by_kernels(clips, other))
    order = ["clip_id", *(f.split(" ")[0] for f in VARIANT.split(", "))]
    out = rows[0].select(order)
    for more in rows[1:]:
        out = out.union(more.select(order))
    return out


def _by_kernels(clips: DataFrame, kernels: dict[str, Callable]) -> DataFrame:
    """The results of kernels (samples, rate) -> (anomaly, confidence, features, metadata), clip by clip."""
    kind = clips.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for clip, rate, values in zip(batch["clip_id"], batch["sample_rate"], batch["samples"]):
                a = np.asarray(values if values is not None else [], float)
                for name, kernel in kernels.items():
                    try:
                        anomaly, confidence, features, metadata = kernel(a, int(rate))
                        error = metadata.pop("error", None)
                        rows.append((clip, name, bool(anomaly), float(confidence), features, metadata, error))
                    except (ValueError, IndexError, ZeroDivisionError, np.linalg.LinAlgError) as e:
                        rows.append((clip, name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["clip_id", "variant", "anomaly", "confidence", "features", "metadata", "error"])

    return clips.select("clip_id", "sample_rate", "samples").mapInPandas(run, f"clip_id {kind}, {VARIANT}")


def vote(results: DataFrame, weights: dict[str, float] | None = None, *, literal: bool = False) -> DataFrame:
    """The ensemble's verdict for each clip from rows of variant results.

    Anomaly: half of the surviving variants or more say so, or the weighted confidence is above 0.5.
    Weights are normalised to 1. Variants without a verdict are dropped and the others keep their weights;
    ``literal`` gives the weights out by rank among the survivors instead.
    """
    weights = weights or dict.fromkeys(VARIANTS, 1.0)
    total = sum(weights.values())
    order = results.sparkSession.createDataFrame([(k, n, w / total) for k, (n, w) in enumerate(weights.items())], "place int, variant string, weight double")
    live = results.where("anomaly is not null").join(F.broadcast(order), "variant")
    if literal:
        live = live.withColumn("place", F.row_number().over(Window.partitionBy("clip_id").orderBy("place")) - 1)
        live = live.drop("weight").join(F.broadcast(order.select("place", "weight")), "place")
    by = live.groupBy("clip_id").agg(
        F.count("*").alias("num_variants"), F.sum(F.col("anomaly").cast("int")).alias("num_anomalies_detected"), F.sum(F.col("confidence") * F.col("weight")).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("place", "variant", "anomaly", "confidence"))).alias("results"),
    )
    none = results.select("clip_id").distinct().join(by, "clip_id", "left")
    n, votes, score = (F.coalesce(c, F.lit(0)) for c in ("num_variants", "num_anomalies_detected", "confidence"))
    return none.select(
        "clip_id", (F.coalesce(F.col("num_variants") > 0, F.lit(False)) & ((2 * votes >= n) | (score > 0.5))).alias("anomaly_detected"), score.cast("double").alias("confidence"),
        n.alias("num_variants"), votes.alias("num_anomalies_detected"),
        F.transform("results", lambda r: F.struct(r["variant"].alias("variant"), r["anomaly"].alias("anomaly"), r["confidence"].alias("confidence"))).alias("individual_results"),
    )


def merged_features(results: DataFrame) -> DataFrame:
    """All features of a clip in one map, each name with its variant's in front."""
    named = results.where("features is not null").select("clip_id", F.explode(F.transform_keys("features", lambda k, _: F.concat(F.col("variant"), F.lit("."), k))).alias("k", "v"))
    return named.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("features"))


def mel_features(clips: DataFrame, bands: int = 128) -> DataFrame:
    """clip_id and the log mel spectrogram (bands by frames) for learning."""
    flat = mel_spectrogram(clips, bands)
    return flat.select("clip_id", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.slice("mel", k * F.col("frames") + 1, F.col("frames"))).alias("mel"))


def averaged(clips: DataFrame) -> DataFrame:
    """The averaged-spectrum detector's results, in the form of a variant's."""
    out = averaged_features(clips)
    names = [c for c in out.columns if c not in ("clip_id", "anomaly", "confidence")]
    failed = F.col("peak_power_db").isNull()
    return out.select(
        "clip_id", F.lit("averaged_spectrum").alias("variant"), F.when(~failed, F.col("anomaly")).alias("anomaly"), F.when(~failed, F.col("confidence")).alias("confidence"),
        F.when(~failed, _named({c: F.col(c) for c in names})).alias("features"), F.create_map().cast("map<string,string>").alias("metadata"), F.when(failed, F.lit("an empty clip")).alias("error"),
    )
