"""The live path as a stream: adaptive filter, rolling detector and fusion with state for each device and session.

Windows of a number of rows are not allowed on streams, so filter and window live in keyed state: the
filter's three numbers, the last ten raw and the last hundred filtered values. Rows of a micro-batch are
taken in the order of (ts, seq). A session that is silent for longer than the timeout loses its state,
as a reconnecting client does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, Settings
from ..functions.columns import event_id
from ..operators.fusion import fuse

STATE = "n int, x double, p double, r double, raw array<double>, window array<double>"
STATISTICS = ("filtered", "n", "mean", "std", "threshold", "z_score", "anomaly")
OUTPUT = (
    "device_id {key}, session_id bigint, ts timestamp, seq bigint, raw double, filtered double, n int, mean double, std double, threshold double, z_score double, "
    "anomaly boolean, audio_peak double, audio_anomaly boolean, humanoid boolean"
)


def _windows(before: list, values: np.ndarray, size: int) -> np.ndarray:
    """For each value the last ``size`` values up to it, those of ``before`` included; NaN where there are fewer."""
    padded = np.concatenate([np.full(size - 1, np.nan), before, values])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[len(before) :]


class Detector:
    """One device's filter and window; ``steps`` takes magnitudes in order and gives the detector's columns."""

    def __init__(self, settings: Settings, state: tuple | None = None):
        self.s = settings
        self.n, self.x, self.p, self.r, raw, window = state or (0, 0.0, 1.0, settings.kalman_r, [], [])
        self.raw, self.window = list(raw), list(window)

    def state(self) -> tuple:
        return self.n, self.x, self.p, self.r, self.raw, self.window

    def _filtered(self, z: np.ndarray) -> np.ndarray:
        """The recursion alone goes sample by sample; the variances that it follows are taken all at once."""
        s = self.s
        near = _windows(self.raw, z, s.adapt_window)
        known = np.isfinite(near).sum(axis=1)
        spread = np.nanvar(near, axis=1)
        out = np.empty(len(z))
        for k, (value, n, v) in enumerate(zip(z.tolist(), known.tolist(), spread.tolist())):
            if self.n == 0:
                self.x, self.p = value, 1.0
            else:
                if n >= 3:
                    self.r = (1 - s.adapt_alpha) * self.r + s.adapt_alpha * v
                m = self.p + s.kalman_q
                gain = m / (m + self.r)
                self.x += gain * (value - self.x)
                self.p = (1 - gain) * m
            self.n += 1
            out[k] = self.x
        self.raw = [*self.raw, *z.tolist()][-s.adapt_window :]
        return out

    def steps(self, z: np.ndarray) -> dict[str, np.ndarray]:
        """filtered, n, mean, std, threshold, z_score, anomaly of each magnitude; statistics are NaN below ``min_samples``."""
        s = self.s
        if not len(z):
            return {c: np.empty(0) for c in STATISTICS}
        x = self._filtered(np.asarray(z, float))
        near = _windows(self.window, x, s.window)
        n = np.isfinite(near).sum(axis=1)
        mean, std = np.nanmean(near, axis=1), np.nanstd(near, axis=1)
        self.window = [*self.window, *x.tolist()][-s.window :]
        limit, ready = mean + s.sigmas * std, n >= s.min_samples
        spread = std > 1e-12 * np.maximum(np.abs(mean), 1.0)
        score = np.where(spread, (x - mean) / np.where(spread, std, 1.0), 0.0)
        known = lambda v: np.where(ready, v, np.nan)
        return dict(zip(STATISTICS, (x, n, known(mean), known(std), known(limit), known(score), ready & spread & (x > limit))))

    def step(self, z: float) -> tuple:
        """The columns of one magnitude, None for what is not known yet."""
        found = [float(v[0]) for v in self.steps(np.array([z])).values()]
        x, n, *rest, anomaly = found
        return x, int(n), *(None if np.isnan(v) else v for v in rest), bool(anomaly)


def detect_stream(packets: DataFrame, settings: Settings = DEFAULT, timeout: str = "1 hour") -> DataFrame:
    """device_id, session_id, ts, seq, magnitude, audio_peak, humanoid -> the detector's rows for every packet.

    A packet without a magnitude advances neither filter nor window.
    """
    from pyspark.sql.types import _parse_datatype_string

    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        detector = Detector(settings, state.get if state.exists else None)
        held, z = len(detector.window), rows["magnitude"].to_numpy(float, na_value=np.nan)
        given = ~np.isnan(z)
        found = detector.steps(z[given])
        # A packet without a magnitude sees the window as it is.
        filled = np.minimum(held + np.cumsum(given), settings.window)
        out = pd.DataFrame({c: np.full(len(z), np.nan) for c in STATISTICS})
        for c in STATISTICS:
            out.loc[given, c] = found[c]
        peak = rows["audio_peak"].fillna(0.0).to_numpy(float)
        out = out.astype(object).where(out.notna(), None).assign(n=filled, anomaly=(out["anomaly"] == 1.0).to_numpy())
        columns = {"device_id": key[0], "session_id": key[1], "ts": rows["ts"], "seq": rows["seq"], "raw": rows["magnitude"]} | {c: out[c].to_numpy() for c in STATISTICS}
        columns |= {"audio_peak": peak, "audio_anomaly": peak > settings.audio_peak, "humanoid": rows["humanoid"].fillna(False).astype(bool)}
        state.update(detector.state())
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(columns)[[f.name for f in schema.fields]]

    schema = _parse_datatype_string(OUTPUT.format(key=packets.schema["device_id"].dataType.simpleString()))
    return packets.groupBy("device_id", "session_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def fused_stream(detected: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Score, event flag and event id: no state is needed any more."""
    return fuse(detected, settings=settings).withColumn("event_id", event_id(F.unix_micros("ts") * 1000))


def counters_stream(packets: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Packets and devices in windows of time; later rows than the watermark are left out."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("packets"), F.approx_count_distinct("device_id").alias("devices"))


def sessions_stream(packets: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of each device, closed by a gap."""
    return packets.withWatermark("ts", late).groupBy("device_id", F.session_window("ts", gap)).agg(F.count("*").alias("packets"))


def once(packets: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (device, seq) once within the watermark."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(["device_id", "seq"])


def event_clips_stream(events: DataFrame, packets: DataFrame, before: str = "2 seconds", after: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Interval join of two streams: packets around each event of their device."""
    e = events.select(F.col("device_id").alias("e_device"), F.col("ts").alias("e_ts"), "event_id").withWatermark("e_ts", late)
    p = packets.withWatermark("ts", late)
    return p.join(e, F.expr(f"device_id = e_device AND ts >= e_ts - INTERVAL {before} AND ts <= e_ts + INTERVAL {after}"))


def sink(events: str, acks: str, dead: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes a batch's events and acknowledgements, one folder a batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            batch.where("is_event").write.mode("overwrite").json(f"{events}/batch={epoch}")
            batch.select("device_id", "ts", F.lit("ack").alias("type"), F.lit("ok").alias("status")).write.mode("overwrite").json(f"{acks}/batch={epoch}")
        finally:
            batch.unpersist()

    return write
