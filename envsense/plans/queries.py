"""One query for each operator, over the views in ``sources.tables``. Doubles are rounded to 6 places."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..config import DEFAULT
from ..functions import columns as C
from ..operators import audio, calibration, catalog, clock, detect, features, filters, fusion, spectra
from ..operators import sensor_model as sensors
from ..sources import bundle_source, bundles
from ..sources import packets as parsing
from ..sources import tables

DEVICE, ORDER = ["device_id"], ["ts", "seq"]
#: Samples of a chunk, where a query splits its keys.
SPLIT = 32
#: Fixed moments inside the generated tables' time span.
NOW, RANGE_START, RANGE_STOP = "2024-01-20 12:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, doubles rounded; -0.0 becomes 0.0.

    A little is added first: means of two-decimal values fall on halves of the last place, where engines
    that sum in another order round differently.
    """
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c) + F.lit(3.7e-8), 6) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in keep or df.columns))


def _detected(spark: SparkSession, sf_dir: str, settings=DEFAULT) -> DataFrame:
    rows = detect.rolling_sigma(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude", settings)
    return fusion.fuse(detect.audio_spike(rows), settings=settings)


def _event_ids(rows: DataFrame) -> DataFrame:
    ts_ns = F.unix_micros("ts") * 1000
    return rows.withColumns({"ts_ns": ts_ns, "event_id": C.event_id(ts_ns)})


def fused_events(spark, sf_dir):
    """Events of two modalities or more on the raw signal."""
    events = _event_ids(_detected(spark, sf_dir)).where("is_event")
    return rounded(events, "device_id", "seq", "event_id", "magnitude", "n", "mean", "std", "threshold", "z_score", "anomaly", "audio_anomaly", "humanoid", "correlation_score")


def rolling_sigma_raw(spark, sf_dir):
    rows = detect.rolling_sigma(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude", zeros=True)
    return rounded(rows, "device_id", "seq", "n", "mean", "std", "threshold", "z_score", "anomaly")


def rolling_sigma_w20(spark, sf_dir):
    rows = detect.rolling_sigma(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude", replace(DEFAULT, window=20), zeros=True)
    return rounded(rows, "device_id", "seq", "n", "mean", "std", "threshold", "z_score", "anomaly")


def kalman_1d(spark, sf_dir):
    return rounded(filters.kalman_1d(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude"), "device_id", "seq", "x_prior", "x", "p", "gain")


def kalman_adaptive(spark, sf_dir):
    return rounded(filters.kalman_adaptive(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude"), "device_id", "seq", "raw", "filtered", "p", "r")


def kalman_3d(spark, sf_dir):
    return rounded(filters.kalman_3d(tables.axes(spark, sf_dir), DEVICE, ORDER, ("x", "y", "z")), "device_id", "ts", "seq", "x", "y", "z", "p")


def filtered_sigma(spark, sf_dir):
    """The detector on the adaptively filtered signal, all packets."""
    filtered = filters.kalman_adaptive(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude")
    rows = detect.rolling_sigma(filtered, DEVICE, ORDER, "filtered", zeros=True)
    return rounded(rows, "device_id", "seq", "raw", "filtered", "n", "mean", "std", "threshold", "z_score", "anomaly")


def ekf_identity(spark, sf_dir):
    rows = filters.matrix_kalman(tables.axes(spark, sf_dir), DEVICE, ORDER, ["x", "y", "z"])
    return rounded(rows.select("device_id", "ts", "seq", *(F.get("x", F.lit(k)).alias(a) for k, a in enumerate("xyz"))))


def kalman_1d_split(spark, sf_dir):
    """The same as a scan over chunks, as for keys that are too long for a task."""
    return rounded(filters.kalman_1d(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude", split=SPLIT), "device_id", "seq", "x_prior", "x", "p", "gain")


def kalman_adaptive_split(spark, sf_dir):
    return rounded(filters.kalman_adaptive(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude", split=SPLIT), "device_id", "seq", "raw", "filtered", "p", "r")


def kalman_3d_split(spark, sf_dir):
    return rounded(filters.kalman_3d(tables.axes(spark, sf_dir), DEVICE, ORDER, ("x", "y", "z"), split=SPLIT), "device_id", "ts", "seq", "x", "y", "z", "p")


def _velocity(spark, sf_dir, split=None):
    """Position and speed from measured positions: a state of two values, one of them observed."""
    rows = filters.matrix_kalman(tables.axes(spark, sf_dir), DEVICE, ORDER, ["x"], transition=[[1, 0.1], [0, 1]], observe=[[1, 0]], q=1e-3, r=0.5, split=split)
    return rounded(rows.select("device_id", "ts", "seq", F.get("x", F.lit(0)).alias("position"), F.get("x", F.lit(1)).alias("speed"), "trace"))


def kalman_velocity(spark, sf_dir):
    return _velocity(spark, sf_dir)


def kalman_velocity_split(spark, sf_dir):
    return _velocity(spark, sf_dir, SPLIT)


def orientation(spark, sf_dir):
    a = tables.axes(spark, sf_dir)
    rows = a.select("device_id", "ts", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), (F.col("y") / 1000).alias("gx"), (F.col("x") / 100).alias("gy"), (F.col("z") / 100).alias("gz"), F.lit(0.1).alias("dt"))
    return rounded(filters.orientation(rows, DEVICE, ORDER), "device_id", "ts", "seq", "roll", "pitch", "yaw")


def fusion_truth_table(spark, sf_dir):
    """Packets by what fired on them, with the score and verdict of each combination."""
    rows = _detected(spark, sf_dir).groupBy("anomaly", "audio_anomaly", "humanoid", "correlation_score", "is_event").agg(F.count("*").alias("n"))
    return rounded(rows)


def correlate_window(spark, sf_dir):
    """Modalities of one device within six hours."""
    rows = _detected(spark, sf_dir).drop("correlation_score", "is_event").withColumn("s", F.unix_seconds("ts"))
    out = fusion.correlate_window(rows, "device_id", "s", 6 * 3600)
    return rounded(out, "device_id", "seq", "buffered", "near_anomaly", "near_audio_anomaly", "near_humanoid", "correlation_score", "is_event")


def event_clip_join(spark, sf_dir):
    found = _detected(spark, sf_dir)
    clips = fusion.event_clips(found.where("is_event").select("device_id", "ts", "seq"), found.select("device_id", "ts", "seq", "magnitude"), "device_id", "ts", "24 HOURS", "36 HOURS")
    return rounded(clips, "device_id", "e_seq", "seq", "magnitude")


def _series(spark, sf_dir):
    axis = lambda *c: F.struct(*(F.lit(v).cast("double").alias(a) if isinstance(v, (int, float)) else v.alias(a) for v, a in zip(c, "xyz")))
    m, k = F.col("magnitude"), F.col("bluetooth_count").cast("double")
    p = tables.packets(spark, sf_dir).select(
        "device_id", "ts",
        F.struct((m * 0.6).alias("x"), (m * 0.0).alias("y"), (m * 0.8).alias("z"), m.alias("magnitude")).alias("m"),
        F.when(F.col("event_type") == "click", axis(k, k + 1, 9.8)).alias("a"),
        F.when(F.col("event_type") == "error", axis(0, k, 0)).alias("g"),
    )
    return catalog.points(p, {"magnetic": "m", "accelerometer": "a", "gyroscope": "g"})


def timeseries_unpivot(spark, sf_dir):
    return rounded(_series(spark, sf_dir).select("measurement", "device_id", F.unix_micros("time").alias("time_us"), "x", "y", "z", F.coalesce("magnitude", F.lit(-1.0)).alias("magnitude")))


def timeseries_range(spark, sf_dir):
    rows = catalog.point_range(_series(spark, sf_dir), device=3, measurement="magnetic", start=F.lit(RANGE_START).cast("timestamp"), stop=F.lit(RANGE_STOP).cast("timestamp"), fields=["x", "z", "magnitude"])
    return rounded(rows.select("device_id", F.unix_micros("time").alias("time_us"), "x", "z", "magnitude"))


def _catalogue(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("device_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("classification"), F.col("o_totalprice").alias("confidence"))


def events_list_page(spark, sf_dir):
    page = catalog.list_events(_catalogue(spark, sf_dir), start=F.lit("1995-01-01").cast("timestamp"), end=F.lit("1996-01-01").cast("timestamp"), classification="1-URGENT", limit=50, offset=20)
    return rounded(page.select("event_id", "device_id", F.unix_micros("ts").alias("ts_us"), "classification", "total"))


def event_lookup(spark, sf_dir):
    return rounded(catalog.event(_catalogue(spark, sf_dir), 7).select("event_id", "device_id", "classification", "confidence"))


def classify_latest(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    corrections = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("corrected_at"), F.col("l_suppkey").alias("by"), F.col("l_returnflag").alias("classification"), F.col("l_discount").alias("confidence"))
    out = catalog.latest_classification(_catalogue(spark, sf_dir), corrections, order=("corrected_at", "by", "confidence", "classification"))
    return rounded(out, "event_id", "classification", "confidence")


def realtime_stats(spark, sf_dir):
    return rounded(catalog.realtime_stats(_detected(spark, sf_dir), F.lit(NOW).cast("timestamp")))


def server_counters(spark, sf_dir):
    rows = detect.sessions(_detected(spark, sf_dir), "device_id", "ts", ORDER, 24 * 3600)
    return catalog.counters(rows, rows, F.lit(NOW).cast("timestamp"))


def packet_sessions(spark, sf_dir):
    return detect.sessions(tables.packets(spark, sf_dir), "device_id", "ts", ORDER, 24 * 3600).select("device_id", "seq", "session_id")


def rate_limit_rejects(spark, sf_dir):
    return detect.rate_limit(tables.packets(spark, sf_dir), "device_id", "ts", ORDER, "month", 10).select("device_id", "seq", "rank", "error")


def downsample_last(spark, sf_dir):
    out = detect.downsample_last(tables.packets(spark, sf_dir), "device_id", "ts", ORDER, "6 hours", ["seq", "magnitude"])
    return rounded(out.select("device_id", F.unix_micros("window_start").alias("window_us"), "seq", "magnitude"))


def sync_sensors(spark, sf_dir):
    """Each click with its device's last view at or before it."""
    p = tables.packets(spark, sf_dir)
    out = detect.sync_sensors(p.where("event_type = 'click'"), p.where("event_type = 'view'").select("device_id", "ts", "magnitude"), "device_id", "ts", "magnitude")
    return rounded(out.select("device_id", F.unix_micros("ts").alias("ts_us"), F.coalesce("magnitude", F.lit(-1.0)).alias("magnitude")))


def calibrate_mag(spark, sf_dir):
    return rounded(calibration.fit_magnetometer(tables.axes(spark, sf_dir), "device_id"))


def calibrate_bias(spark, sf_dir):
    return rounded(calibration.fit_bias(tables.axes(spark, sf_dir), "device_id", gravity=DEFAULT.gravity))


def calibration_steps(spark, sf_dir):
    return rounded(calibration.complete_steps(tables.axes(spark, sf_dir), ["device_id", "step"]))


def apply_calibration(spark, sf_dir):
    a = tables.axes(spark, sf_dir)
    out = calibration.apply(a, calibration.fit_magnetometer(a.where("device_id % 3 <> 0"), "device_id"), DEVICE)
    return rounded(out, "device_id", "ts", "seq", "x", "y", "z")


def audio_fft(spark, sf_dir):
    out = audio.fft_features(tables.clips(spark, sf_dir), 44_100)
    return rounded(out, "clip_id", "ultrasound_power_db", "peak_frequency_hz", "peak_power_db", "voice_band_energy_db", "anomaly", "confidence")


def audio_zcr(spark, sf_dir):
    return rounded(audio.zero_crossings(tables.clips(spark, sf_dir), 16, 4))


def client_spectrum(spark, sf_dir):
    return rounded(audio.client_spectrum(tables.clips(spark, sf_dir), 44_100))


def audio_stft(spark, sf_dir):
    out = audio.stft_features(tables.clips(spark, sf_dir), 44_100, 16, 4)
    return rounded(out.withColumn("centroid_variance", F.round("centroid_variance", 2)), "clip_id", "flux_max", "flux_mean", "centroid_variance", "spread_mean")


def audio_fft_long(spark, sf_dir):
    """The classic variant on clips of 44,100 samples."""
    return rounded(audio.fft_features(tables.long_clips(spark, sf_dir), 44_100))


def client_spectrum_long(spark, sf_dir):
    return rounded(audio.client_spectrum(tables.long_clips(spark, sf_dir), 44_100))


def audio_stft_long(spark, sf_dir):
    """Windows of 2,048 and steps of 512 on clips of 44,100 samples."""
    out = audio.stft_features(tables.long_clips(spark, sf_dir), 44_100)
    return rounded(out.withColumn("centroid_variance", F.round("centroid_variance", 2)))


def audio_wavelet(spark, sf_dir):
    """The wavelet variant by array functions."""
    return rounded(audio.wavelet_features(tables.clips(spark, sf_dir)))


def audio_wavelet_levels(spark, sf_dir):
    return rounded(audio.wavelet_levels(tables.long_clips(spark, sf_dir)))


def audio_variants(spark, sf_dir):
    """All six variants by Arrow kernels, features counted; short clips make the short-time variant fail, as specified."""
    out = audio.analyze(tables.clips(spark, sf_dir))
    return rounded(out.select("clip_id", "variant", "anomaly", "confidence", F.size("features").alias("n_features")))


def audio_filterbank(spark, sf_dir):
    """The filter bank variant's mean decibels, band by band, with its entropy and verdict."""
    out = audio.filterbank_features(tables.clips(spark, sf_dir))
    return rounded(out.select("clip_id", F.posexplode("band_energy_db").alias("band", "db"), "max_band_index", "band_entropy", "anomaly", "confidence"))


def audio_mel(spark, sf_dir):
    """The log mel spectrogram for learning, a row for each band and frame."""
    out = audio.mel_features(tables.clips(spark, sf_dir))
    return rounded(out.select("clip_id", F.posexplode("mel").alias("band", "row")).select("clip_id", "band", F.posexplode("row").alias("frame", "db")))


def audio_welch(spark, sf_dir):
    """The averaged spectrum's bands and peak; formants need roots of a polynomial and are tested apart."""
    return rounded(audio.averaged_features(tables.clips(spark, sf_dir)).select("clip_id", "infrasound", "ultrasound", "peak_frequency", "peak_power_db"))


def audio_prediction(spark, sf_dir):
    """The linear prediction coefficients that the voice variant takes roots of."""
    out = spectra.prediction_coefficients(tables.clips(spark, sf_dir))
    return rounded(out.select("clip_id", F.posexplode("coefficients").alias("place", "coefficient")))


def audio_formants(spark, sf_dir):
    """The voice variant's resonances and verdict."""
    out = spectra.formant_features(tables.clips(spark, sf_dir))
    return rounded(out.select("clip_id", "formant_count", *(F.coalesce(f"formant_f{k}", F.lit(-1.0)).alias(f"formant_f{k}") for k in (1, 2, 3)), "anomaly", "confidence"))


def audio_averaged(spark, sf_dir):
    return rounded(audio.averaged(tables.clips(spark, sf_dir)).select("clip_id", "anomaly", "confidence"))


def audio_ensemble(spark, sf_dir):
    out = audio.vote(audio.analyze(tables.clips(spark, sf_dir)))
    return rounded(out, "clip_id", "anomaly_detected", "confidence", "num_variants", "num_anomalies_detected")


def audio_ensemble_vote(spark, sf_dir):
    """The vote over variant rows made from the clips' labels."""
    made = tables.clips(spark, sf_dir).select("clip_id", F.posexplode(F.array(*map(F.lit, audio.VARIANTS))).alias("k", "variant"), "label")
    mark = F.pmod(F.col("clip_id") * 7 + F.col("k") * 5 + F.col("label"), F.lit(6))
    rows = made.select("clip_id", "variant", F.when(mark != 5, mark < 2).alias("anomaly"), (mark / 5).alias("confidence"))
    return rounded(audio.vote(rows), "clip_id", "anomaly_detected", "confidence", "num_variants", "num_anomalies_detected")


def _sensor_features(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("tie"), F.col("l_extendedprice").alias("magnetic_magnitude"),
        F.col("l_quantity").alias("accel_x"), F.col("l_tax").alias("accel_y"), F.col("l_discount").alias("accel_z"),
        F.col("l_discount").alias("gyro_x"), F.col("l_tax").alias("gyro_y"), F.lit(0.0).alias("gyro_z"), F.col("l_quantity").alias("orientation_yaw"),
        F.col("l_discount").alias("audio_peak"), (F.col("l_returnflag") == "R").alias("humanoid_detected"), F.col("l_linenumber").alias("bluetooth_count"),
    )
    return features.sensor_features(rows, "event_id", ["seq", "tie", "orientation_yaw"])


def sensor_features(spark, sf_dir):
    out = _sensor_features(spark, sf_dir)
    return rounded(out.withColumn("mag_std", F.coalesce("mag_std", F.lit(-1.0))))


def labelled_features(spark, sf_dir):
    """The features of each order's lines, labelled by what is high: magnetic values, audio, both or neither."""
    rows = _sensor_features(spark, sf_dir)
    m, a = F.col("mag_max") > 60_000, F.col("audio_peak_max") > 0.075
    names = list(C.LABELS)
    return rows.withColumn("label", F.when(m & a, names[3]).when(m, names[1]).when(a, names[2]).otherwise(names[0]))


def sensor_model(spark, sf_dir):
    """Accuracy and macro-F1 of the sensor classifier on the events that it was not trained on."""
    rows = labelled_features(spark, sf_dir)
    out = shared.cut(sensor_model_of(rows).select("label", "predicted"))  # read twice
    counts = out.agg(F.count("*").alias("n"))
    return rounded(features.classification_metrics(out, "label", "predicted").join(F.broadcast(counts)))


def sensor_model_of(rows):
    """Predictions for the held-out events by a model trained on the others."""
    apart = sensors.held_out(F.col("event_id"))
    return sensors.predict(sensors.fit(rows.where(~apart), "label"), rows.where(apart))


def classification_metrics(spark, sf_dir):
    return rounded(features.classification_metrics(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic"))


def confusion(spark, sf_dir):
    return features.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic")


def pose_flag(spark, sf_dir):
    return tables.clips(spark, sf_dir).select("clip_id", C.pose_present(F.col("samples"), 12, 0.1).alias("humanoid"))


def embedding_meanpool(spark, sf_dir):
    out = features.mean_pool(tables.clips(spark, sf_dir), "label", "samples")
    return rounded(out.select("label", F.posexplode("pooled").alias("dim", "mean")))


def embedding_concat(spark, sf_dir):
    c = features.concat_embeddings(tables.clips(spark, sf_dir).select("clip_id", F.col("samples").alias("a"), F.reverse("samples").alias("b")), "a", "b")
    return rounded(c.select("clip_id", F.posexplode("embedding").alias("dim", "v")))


def label_softmax(spark, sf_dir):
    """Softmax and argmax over all values as logits."""
    c = tables.clips(spark, sf_dir).select("clip_id", F.col("samples").alias("logits"))
    p = c.select("clip_id", C.softmax(F.col("logits")).alias("p"))
    return rounded(p.select("clip_id", F.array_max("p").alias("confidence"), C.argmax(F.col("p")).alias("class")))


def scalar_functions(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    ns = F.unix_micros("ts") * 1000 + 999
    m = F.col("magnitude")
    return rounded(p.select(
        "device_id", "seq", C.event_id(ns).alias("event_id"), C.calendar_event_id(F.col("ts")).alias("calendar_id"), C.decibels(m).alias("db"), C.power_decibels(m).alias("power_db"),
        C.magnitude(m, m * 2, m * 2).alias("norm"), C.progress(F.col("seq") % 150).alias("progress"), C.low_power(F.col("seq") % 101, F.lit(100)).alias("low_power"),
        C.clock_offset(F.col("seq"), F.lit(100), F.lit(7)).cast("double").alias("offset"), C.label_index(F.when(F.col("humanoid"), "Evento_Correlacionado").otherwise("?")).alias("label"),
    ))


def packet_errors(spark, sf_dir):
    """Packets as JSON text, some of them malformed or incomplete, parsed and told apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, every = F.col("event_id"), lambda n: F.col("event_id") % n == 0
    text = F.concat(
        F.when(every(17), F.lit("{oops")).otherwise(F.lit("{")),
        F.when(every(13), F.lit("")).otherwise(F.concat(F.lit('"timestamp":'), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7).cast("string"), F.lit(","))),
        F.when(every(11), F.lit("")).otherwise(F.concat(F.lit('"device_id":"d'), F.col("user_id").cast("string"), F.lit('",'))),
        F.when(every(5), F.lit("")).otherwise(F.concat(F.lit('"magnetometer":{"x":1.5'), F.when(every(4), F.lit("")).otherwise(F.concat(F.lit(',"magnitude":'), k.cast("string"), F.lit(".25"))), F.lit("},"))),
        F.lit('"audio_peak":'), F.when(every(7), F.lit("1.5")).otherwise(F.lit("0.5")), F.lit("}"),
    )
    coded = parsing.error_code(parsing.parse_packets(e.select(k.alias("id"), text.alias("value"))))
    good = parsing.detector_rows(coded.where("error is null").withColumn("bluetooth_devices_count", F.col("id").cast("int")))
    rows = good.select(F.col("bluetooth_count").cast("long").alias("id"), F.lit("").alias("error"), "device_id", F.unix_micros("ts").alias("ts_us"), F.coalesce("magnitude", F.lit(-1.0)).alias("magnitude"), "audio_peak", "humanoid")
    bad = coded.where("error is not null").select("id", "error", F.lit("").alias("device_id"), F.lit(0).cast("long").alias("ts_us"), F.lit(0.0).alias("magnitude"), F.lit(0.0).alias("audio_peak"), F.lit(False).alias("humanoid"))
    return rounded(rows.unionByName(bad))


def calibrate_mag_literal(spark, sf_dir):
    """Extremes of negative axes with the maxima that start at the least positive float."""
    a = tables.axes(spark, sf_dir).select("device_id", *(F.when(F.col("device_id") % 2 == 0, -F.col(c)).otherwise(F.col(c)).alias(c) for c in "xyz"))
    return rounded(calibration.fit_magnetometer(a, "device_id", literal=True))


def calibrate_gyro(spark, sf_dir):
    return rounded(calibration.fit_bias(tables.axes(spark, sf_dir), "device_id"))


def calibration_wizard(spark, sf_dir):
    """How far each device's samples take its wizard, with 20 samples a state."""
    rows = calibration.wizard_progress(tables.axes(spark, sf_dir), DEVICE, ["ts", "seq"], replace(DEFAULT, calibration_samples=20))
    return rows.withColumn("computes", F.coalesce("computes", F.lit("")))


def stored_calibrations(spark, sf_dir):
    """The calibrations of all devices, two thirds of which have one."""
    a = tables.axes(spark, sf_dir)
    fit = calibration.fit_magnetometer(a.where("device_id % 3 <> 0"), "device_id").withColumns({"timestamp": F.col("device_id").cast("long") * 1000, "calibrated": F.lit(True)})
    return rounded(calibration.with_defaults(a.select("device_id").distinct(), fit, DEVICE))


def ack_messages(spark, sf_dir):
    p = tables.packets(spark, sf_dir).select("device_id", (F.unix_micros("ts") * 1000).alias("ts"))
    return fusion.acks(p)


def pcm_samples(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    pcm = p.select("seq", C.pcm_to_float(F.array(F.col("seq") % 32768, -(F.col("seq") * 3 % 32768) - 1)).alias("s"))
    return rounded(pcm.select("seq", F.col("s")[0].alias("a"), F.col("s")[1].alias("b")))


def session_clock(spark, sf_dir):
    """Microseconds since the device's first packet."""
    p = tables.packets(spark, sf_dir).select("device_id", "seq", F.unix_micros("ts").alias("us"))
    return p.select("device_id", "seq", C.relative_time(F.col("us"), "device_id").alias("since"))


def one_shot_test(spark, sf_dir):
    """One value against the first 99 packets' values."""
    noise = tables.packets(spark, sf_dir).orderBy("seq").limit(99).select("magnitude")
    return rounded(detect.one_shot(spark, 95.5, noise=noise))


def token_bucket(spark, sf_dir):
    """Three tokens at most, one a day."""
    rows = tables.packets(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    out = detect.token_bucket(rows, DEVICE, "us", ["us", "seq"], 1 / 86400, 3)
    return rounded(out.withColumn("error", F.coalesce("error", F.lit(""))), "device_id", "seq", "tokens", "error")


def correlation_engine(spark, sf_dir):
    """The current row's score beside the number of rows of the last six hours."""
    rows = _detected(spark, sf_dir).drop("correlation_score", "is_event").withColumn("us", F.unix_micros("ts"))
    out = fusion.correlation_engine(rows, DEVICE, "us", 6 * 3600 * 1_000_000)
    return rounded(out, "device_id", "seq", "buffered", "correlation_score", "is_correlated")


def sliding_buffer(spark, sf_dir):
    """A buffer of five days and 12 packets: both bounds are met."""
    rows = tables.packets(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    out = detect.sliding_buffer(rows, DEVICE, "us", ["us", "seq"], "magnitude", 5 * 24 * 3600 * 1_000_000, 12)
    return rounded(out, "device_id", "seq", "buffered", "oldest", "buffer_mean", "buffer_min", "buffer_max")


def anomaly_messages(spark, sf_dir):
    """The messages of all events, read back from their JSON."""
    found = _event_ids(_detected(spark, sf_dir)).withColumn("ts", F.col("ts_ns"))
    part = lambda path: F.get_json_object("message", f"$.{path}")
    rows = fusion.event_messages(found).select(
        "device_id", part("type").alias("type"), part("event_id").alias("event_id"), part("timestamp").cast("long").alias("timestamp"), part("correlation_score").cast("double").alias("score"),
        *(F.coalesce(part(f"details.magnetic.{c}").cast("double"), F.lit(-1.0)).alias(c) for c in ("mean", "std", "threshold", "z_score")),
        F.coalesce(part("details.audio.peak").cast("double"), F.lit(-1.0)).alias("peak"), F.coalesce(part("details.audio.reason"), F.lit("")).alias("reason"), F.coalesce(part("details.humanoid"), F.lit("")).alias("humanoid"),
    )
    return rounded(rows)


def pose_confidence(spark, sf_dir):
    """All values of a vector as confidences of keypoints."""
    c = tables.clips(spark, sf_dir)
    return rounded(c.select("clip_id", C.pose_present(F.col("samples"), 5, 0.3).alias("humanoid"), C.mean_confidence(F.col("samples")).alias("confidence")))


def _questions(spark, sf_dir):
    """Views as questions of clocks, all but every seventh answered: requests and responses, in microseconds."""
    p = tables.packets(spark, sf_dir).where("event_type = 'view'").select("device_id", "seq", F.unix_micros("ts").alias("client_time"))
    trip = 2_000 + F.col("seq") * 7919 % 50_000
    answers = p.where("seq % 7 <> 0").select(
        "device_id", "client_time", (F.col("client_time") + F.col("device_id") * 1000 + F.col("seq") % 13 + (trip / 2).cast("long")).alias("server_time"),
        (F.col("seq") % 500).alias("processing"), (F.col("client_time") + trip + F.col("seq") % 500).alias("received_at"),
    )
    return p.select("device_id", "client_time"), answers


def clock_round_trips(spark, sf_dir):
    return rounded(clock.round_trips(*_questions(spark, sf_dir)))


def clock_sync(spark, sf_dir):
    """All packets with their device's best offset as of their time."""
    offsets = clock.best_offsets(clock.round_trips(*_questions(spark, sf_dir)))
    p = tables.packets(spark, sf_dir).select("device_id", "seq", F.unix_micros("ts").alias("client_time"))
    return rounded(clock.corrected(p, offsets).withColumn("server_time", F.floor("server_time")))


def training_schedule(spark, sf_dir):
    """Devices as runs, their values as losses, an epoch each."""
    return rounded(features.training_schedule(tables.packets(spark, sf_dir), DEVICE, ORDER, "magnitude"))


def event_bundles(spark, sf_dir):
    """All clips written as bundles (WAV, CSV, JSON) in the shared folder, and read back."""
    c = tables.clips(spark, sf_dir)
    sensors = F.transform(F.slice("samples", 1, 3), lambda v, i: F.struct(i.cast("long").alias("timestamp"), v.alias("magnetic_magnitude"), F.abs(v).alias("audio_peak"), (v > 0).alias("humanoid_detected")))
    rows = c.select(F.concat(F.lit("event/"), F.col("clip_id").cast("string")).alias("event_id"), "sample_rate", "samples", sensors.alias("sensors"), F.to_json(F.struct("clip_id", "label")).alias("metadata"))
    path = f"{shared.shared_dir(spark).rstrip('/')}/envsense-bundles-{uuid.uuid4().hex}"
    bundle_source.write(rows, path)
    back = bundle_source.read(spark, path)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    return rounded(back.select(
        "event_id", "sample_rate", F.size("samples").alias("n"), (total(F.col("samples"), lambda v: v * 32768)).cast("long").alias("pcm_sum"), F.element_at("samples", -1).alias("last"),
        total(F.col("sensors"), lambda x: x["magnetic_magnitude"]).alias("magnitudes"), F.size(F.filter("sensors", lambda x: x["humanoid_detected"])).alias("humanoids"), F.get_json_object("metadata", "$.label").cast("long").alias("label"),
    ))


def video_frames(spark, sf_dir):
    """Places of 150 frames of videos as long as each customer's number says."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") * 7 % 5000 + 1).cast("int").alias("total"))
    return c.select("video_id", F.posexplode(C.frame_indexes(F.col("total"))).alias("k", "frame"))


def clip_lengths(spark, sf_dir):
    """Clips cut to 40 samples and filled up to 100, and two channels of them averaged."""
    c = tables.clips(spark, sf_dir)
    cut = c.select("clip_id", C.pad_or_trim(F.col("samples"), 40).alias("a"), C.pad_or_trim(F.col("samples"), 100).alias("b"), C.downmix(F.array("samples", F.reverse("samples"))).alias("mono"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return rounded(cut.select("clip_id", F.size("a").alias("n_cut"), total("a").alias("cut_sum"), F.size("b").alias("n_filled"), total("b").alias("filled_sum"), F.element_at("b", -1).alias("last"), F.get("mono", F.lit(0)).alias("first_mono"), F.size("mono").alias("n_mono")))


def pcm_of_texts(spark, sf_dir):
    """All texts' bytes as little-endian 16-bit samples."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    out = bundles.pcm_chunks(d).select("doc_id", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * 32768).cast("long").alias("total"))
    return out


def formants_valid(spark, sf_dir):
    """Values as frequencies: those of a voice, in order."""
    c = tables.clips(spark, sf_dir).select("clip_id", C.formant_valid(F.transform("samples", lambda v: F.abs(v) * 20_000)).alias("f"))
    return rounded(c.select("clip_id", F.posexplode_outer("f").alias("k", "frequency")).select("clip_id", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("frequency", F.lit(0.0)).alias("frequency")))


def catalogue_upsert(spark, sf_dir):
    """The catalogue with every fifth event replaced and one added for each of these."""
    old = _catalogue(spark, sf_dir)
    fifth = old.where(F.col("event_id") % 5 == 0)
    new = fifth.withColumn("confidence", -F.col("confidence")).unionByName(fifth.withColumns({"event_id": -F.col("event_id"), "classification": F.lit("new")}))
    return rounded(catalog.upsert(old, new).select("event_id", "device_id", F.unix_micros("ts").alias("ts_us"), "classification", "confidence"))


def broadcast_messages(spark, sf_dir):
    """Every event's message for each nation as a client."""
    found = _event_ids(_detected(spark, sf_dir)).where("is_event").select("device_id", "event_id", "seq")
    clients = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("client_id"))
    return fusion.broadcast_message(found, clients)


def best_checkpoints(spark, sf_dir):
    """The three orders of least price as checkpoints of least loss."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").alias("val_loss"), F.col("o_orderkey").alias("epoch"))
    return rounded(features.best_checkpoints(o, "val_loss"))


def calibration_store(spark, sf_dir):
    """Calibrations written to the shared folder and read back."""
    path = f"{shared.shared_dir(spark).rstrip('/')}/envsense-calibration-{uuid.uuid4().hex}"
    fit = calibration.fit_magnetometer(tables.axes(spark, sf_dir), "device_id").withColumns({"device_id": F.col("device_id").cast("string"), "timestamp": F.col("device_id").cast("long") * 1000})
    bundles.save_calibration(fit, path)
    back = bundles.load_calibration(spark, path)
    return rounded(back.select("device_id", *(f"{p}_{a}" for p in ("offset", "scale") for a in "xyz"), "timestamp", "calibrated"))


def _written_events(spark, sf_dir):
    """All clips as bundles named event_<id>, and their folder."""
    c = tables.clips(spark, sf_dir)
    rows = c.select(F.concat(F.lit("event_"), F.col("clip_id").cast("string")).alias("event_id"), "sample_rate", "samples", F.to_json(F.struct("clip_id", "label")).alias("metadata"))
    path = f"{shared.shared_dir(spark).rstrip('/')}/envsense-events-{uuid.uuid4().hex}"
    bundle_source.write(rows, path)
    return path


def wav_files(spark, sf_dir):
    """The WAV files of all clips, read as files and filled up to 100 samples."""
    w = bundles.read_wav(spark, _written_events(spark, sf_dir), 100)
    name = F.regexp_extract("path", "(event_[0-9]+)/[^/]*$", 1)
    return rounded(w.select(name.alias("event_id"), "sample_rate", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, v: s + v).alias("total")))


def event_metadata(spark, sf_dir):
    """The metadata documents of all clips' events, and the directories they are in."""
    path = _written_events(spark, sf_dir)
    found = bundles.read_metadata(spark, path, "clip_id long, label long").select("event_id", "clip_id", "label")
    return found.join(bundles.event_directories(spark, path), "event_id")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    fused_events, rolling_sigma_raw, rolling_sigma_w20, kalman_1d, kalman_adaptive, kalman_3d, filtered_sigma, ekf_identity, orientation,
    kalman_1d_split, kalman_adaptive_split, kalman_3d_split, kalman_velocity, kalman_velocity_split,
    fusion_truth_table, correlate_window, event_clip_join, timeseries_unpivot, timeseries_range, events_list_page, event_lookup, classify_latest,
    realtime_stats, server_counters, packet_sessions, rate_limit_rejects, downsample_last, sync_sensors, calibrate_mag, calibrate_bias,
    calibration_steps, apply_calibration, audio_fft, audio_zcr, client_spectrum, audio_stft, audio_variants, audio_averaged, audio_ensemble,
    audio_fft_long, client_spectrum_long, audio_stft_long, audio_wavelet, audio_wavelet_levels,
    audio_filterbank, audio_mel, audio_welch, audio_prediction, audio_formants,
    audio_ensemble_vote, sensor_features, sensor_model, classification_metrics, confusion, pose_flag, embedding_meanpool, embedding_concat, label_softmax, scalar_functions,
    packet_errors, calibrate_mag_literal, calibrate_gyro, calibration_wizard, stored_calibrations, ack_messages, pcm_samples, session_clock, one_shot_test,
    token_bucket, correlation_engine, sliding_buffer, anomaly_messages, pose_confidence, clock_round_trips, clock_sync, training_schedule, event_bundles,
    video_frames, clip_lengths, pcm_of_texts, formants_valid, catalogue_upsert, broadcast_messages, best_checkpoints, calibration_store, wav_files, event_metadata,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
