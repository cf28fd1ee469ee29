"""Clocks of devices set right by question and answer: offsets as data, applied to packets as of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clock_offset


def round_trips(requests: DataFrame, responses: DataFrame, device: str = "device_id") -> DataFrame:
    """device, client_time, received_at, round_trip, offset: an answered request, with its first answer.

    requests: device, client_time. responses: device, client_time (of the request), server_time, processing, received_at;
    all times in one unit. The round trip is without the server's processing. Requests without an answer, answers
    without a request or that came before it are left out; repeated requests of one time are one.
    """
    asked = requests.select(device, "client_time").distinct()
    first = responses.groupBy(device, "client_time").agg(F.min(F.struct("received_at", "server_time", "processing")).alias("r"))
    both = asked.join(first, [device, "client_time"]).select(device, "client_time", "r.*").where("received_at >= client_time")
    trip = F.greatest(F.col("received_at") - F.col("client_time") - F.col("processing"), F.lit(0))
    both = both.withColumn("round_trip", trip)
    return both.select(device, "client_time", "received_at", "round_trip", clock_offset(F.col("server_time"), F.col("client_time"), F.col("round_trip")).alias("offset"))


def best_offsets(trips: DataFrame, device: str = "device_id", last: int = 8) -> DataFrame:
    """device, at, offset: after each answer, the offset of the least round trip among the last ``last`` answers; ties go to the later."""
    w = Window.partitionBy(device).orderBy("received_at", "client_time").rowsBetween(1 - last, 0)
    best = F.min(F.struct("round_trip", (-F.col("received_at")).alias("a"), (-F.col("client_time")).alias("b"), "offset")).over(w)
    return trips.select(device, F.col("received_at").alias("at"), F.col("client_time").alias("asked"), best["offset"].alias("offset"))


def corrected(packets: DataFrame, offsets: DataFrame, device: str = "device_id", at: str = "client_time") -> DataFrame:
    """The packets with ``offset``, the device's last one known at their time (0 before the first), and ``server_time``.

    Packets of the moment of an answer use it. Of several offsets of one moment the last request's counts.
    """
    known = offsets.groupBy(device, "at").agg(F.max_by("offset", "asked").alias("offset"))
    sides = packets.withColumns({"side_": F.lit(1), "known_": F.lit(None).cast("double")}).select(*packets.columns, "side_", "known_", F.col(at).alias("when_"))
    marks = known.select(*(F.col(device) if c == device else F.lit(None).cast(packets.schema[c].dataType).alias(c) for c in packets.columns), F.lit(0).alias("side_"), F.col("offset").cast("double").alias("known_"), F.col("at").alias("when_"))
    w = Window.partitionBy(device).orderBy("when_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    joined = sides.unionByName(marks).withColumn("offset", F.coalesce(F.last("known_", ignorenulls=True).over(w), F.lit(0.0))).where("side_ = 1")
    return joined.select(*packets.columns, "offset", (F.col(at) + F.col("offset")).alias("server_time"))
