"""Rate limits and sessions of a live stream, with keyed state and timers for each device.

A device has a bucket of tokens (see ``detect.token_bucket``); its packets take them in the order of time. Each
packet moves a timer of event time; when the watermark passes it, the session ends with a row of its counts and
its state is gone. State is three numbers and two counts a device, and the last packets' times in a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import DEFAULT, Settings

OUTPUT = "device_id {key}, kind string, us bigint, seq bigint, tokens double, error string, accepted bigint, rejected bigint, recent array<bigint>"
LIMITED, LATE = "RATE_LIMIT_EXCEEDED", "LATE_PACKET"
#: State store that keyed state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times of packets that a session keeps.
RECENT = 5


def spent(us: np.ndarray, tokens: float, at: int | None, rate: float, most: float) -> tuple[np.ndarray, np.ndarray, float, int | None]:
    """Of packets in order of time: tokens left after each and whether it got one, then the bucket and the last time."""
    left, taken = np.empty(len(us)), np.empty(len(us), bool)
    for k, t in enumerate(us.tolist()):
        tokens = min(most, tokens + (0 if at is None else t - at) * (rate / 1e6))
        taken[k] = tokens >= 1
        tokens -= taken[k]
        left[k], at = tokens, t
    return left, taken, float(tokens), at


class Limiter(StatefulProcessor):
    def __init__(self, rate: float, most: float, gap_ms: int):
        self.rate, self.most, self.gap_ms = rate, float(most), gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, at bigint, accepted bigint, rejected bigint")
        self.recent = handle.getListState("recent", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "seq"], kind="stable")
        tokens, at, accepted, rejected = self.bucket.get() if self.bucket.exists() else (self.most, None, 0, 0)
        us = batch["us"].to_numpy(np.int64)
        late = us < (at if at is not None else us.min())
        left = np.full(len(us), np.nan)
        error = np.where(late, LATE, None).astype(object)
        left[~late], taken, tokens, at = spent(us[~late], tokens, at, self.rate, self.most)
        error[np.flatnonzero(~late)[~taken]] = LIMITED
        accepted, rejected = accepted + int(taken.sum()), rejected + int((~taken).sum() + late.sum())
        self.bucket.update((tokens, at, accepted, rejected))
        times = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        self.recent.put([(int(t),) for t in [*times, *us[~late].tolist()][-RECENT:]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.gap_ms)
        yield pd.DataFrame({"device_id": key[0], "kind": "packet", "us": us, "seq": batch["seq"].to_numpy(), "tokens": left, "error": error, "accepted": None, "rejected": None, "recent": None})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, at, accepted, rejected = self.bucket.get()
        recent = [r[0] for r in self.recent.get()]
        self.bucket.clear()
        self.recent.clear()
        yield pd.DataFrame({"device_id": [key[0]], "kind": ["session"], "us": [at], "seq": [None], "tokens": [None], "error": [None], "accepted": [accepted], "rejected": [rejected], "recent": [recent]})

    def close(self) -> None:
        pass


def limited_stream(packets: DataFrame, rate: float = DEFAULT.rate_limit, most: float = DEFAULT.rate_limit, gap: str = "30 seconds", late: str = "10 minutes", settings: Settings = DEFAULT) -> DataFrame:
    """device_id, ts, seq -> a row for each packet (kind ``packet``, with its error) and for each session that has ended.

    A packet older than its device's last one is LATE_PACKET and takes no token; those behind the watermark are
    dropped by Spark. A session ends ``gap`` after its last packet. Needs the RocksDB state store (``ROCKS``).
    """
    from pyspark.sql import functions as F

    kind: StructType = _parse_datatype_string(OUTPUT.format(key=packets.schema["device_id"].dataType.simpleString()))
    rows = packets.withWatermark("ts", late).select("device_id", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"))
    limiter = Limiter(rate, most, int(pd.Timedelta(gap).total_seconds() * 1000))
    return rows.groupBy("device_id").transformWithStateInPandas(statefulProcessor=limiter, outputStructType=kind, outputMode="Append", timeMode="EventTime")
