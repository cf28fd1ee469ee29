"""Weighted fusion of modalities into events, correlation over time, clips around events, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def correlation_score(magnetic: Column, audio: Column, humanoid: Column, settings: Settings = DEFAULT) -> Column:
    part = lambda flag, weight: F.when(flag, F.lit(weight)).otherwise(0.0)
    return part(magnetic, settings.weight_magnetic) + part(audio, settings.weight_audio) + part(humanoid, settings.weight_humanoid)


def fuse(rows: DataFrame, magnetic: str = "anomaly", audio: str = "audio_anomaly", humanoid: str = "humanoid", settings: Settings = DEFAULT) -> DataFrame:
    """Adds correlation_score and is_event: a sensor fired and the score is at least ``min_score``."""
    m, a, h = (F.coalesce(F.col(c), F.lit(False)) for c in (magnetic, audio, humanoid))
    out = rows.withColumn("correlation_score", correlation_score(m, a, h, settings))
    return out.withColumn("is_event", (m | a) & (F.col("correlation_score") >= settings.min_score))


def correlate_window(rows: DataFrame, device: str, seconds: str, reach: int, settings: Settings = DEFAULT) -> DataFrame:
    """Modalities that fired within ``reach`` seconds up to now, fused; ``buffered`` counts the rows in reach.

    Rows exactly ``reach`` old are out. ``seconds`` is a whole number of seconds; rows of one second see each other.
    """
    w = Window.partitionBy(device).orderBy(seconds).rangeBetween(1 - reach, 0)
    flags = {f"near_{c}": F.max(F.col(c).cast("int")).over(w) == 1 for c in ("anomaly", "audio_anomaly", "humanoid")}
    near = rows.withColumns(flags | {"buffered": F.count("*").over(w)})
    return fuse(near, "near_anomaly", "near_audio_anomaly", "near_humanoid", settings)


def correlation_engine(rows: DataFrame, keys: list[str], micros: str, reach: int = DEFAULT.correlation_ms * 1000, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``buffered``, the rows of the last ``reach`` microseconds (younger than that), and the current row's score alone.

    The buffer does not enter the score. ``is_correlated`` is true from ``min_score`` on, which no single modality
    reaches. Rows of one microsecond see each other; ``micros`` is a whole number.
    """
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(1 - reach, 0)
    m, a, h = (F.coalesce(F.col(c), F.lit(False)) for c in ("anomaly", "audio_anomaly", "humanoid"))
    out = rows.withColumns({"buffered": F.count("*").over(w), "correlation_score": correlation_score(m, a, h, settings)})
    return out.withColumn("is_correlated", F.col("correlation_score") >= settings.min_score)


def event_clips(events: DataFrame, packets: DataFrame, device: str, ts: str, before: str, after: str) -> DataFrame:
    """Packets in [event - before, event + after] of the same device: event columns as e_*, packet columns as they are.

    Both sides are dealt to stretches of time as long as a clip, an event to all that its clip touches: a device's
    packets meet the events of their own time only.
    """
    length = " + ".join(f"unix_micros(timestamp_seconds(0) + INTERVAL {x})" for x in (before, after))
    part = lambda at: F.floor(F.unix_micros(at) / F.expr(f"greatest(1, {length})"))
    low, high = F.col(f"e_{ts}") - F.expr(f"INTERVAL {before}"), F.col(f"e_{ts}") + F.expr(f"INTERVAL {after}")
    e = events.select(*(F.col(c).alias(f"e_{c}") for c in events.columns))
    own = "_part"
    while {own, f"e_{own}"} & {*packets.columns, *e.columns}:
        own = "_" + own
    e = e.withColumn(f"e_{own}", F.explode(F.sequence(part(low), part(high))))
    near = (F.col(own) == F.col(f"e_{own}")) & (F.col(ts) >= low) & (F.col(ts) <= high)
    return packets.withColumn(own, part(F.col(ts))).join(e, (F.col(device) == F.col(f"e_{device}")) & near).drop(own, f"e_{own}")


def event_messages(fused: DataFrame) -> DataFrame:
    """device_id and the event as JSON, details only of what fired."""
    details = F.struct(
        F.when(F.col("anomaly"), F.struct("mean", "std", "threshold", "z_score")).alias("magnetic"),
        F.col("audio_details").alias("audio"),
        F.when(F.col("humanoid"), F.lit(True)).alias("humanoid"),
    )
    message = F.struct(F.lit("anomaly_detected").alias("type"), "event_id", F.col("ts").alias("timestamp"), "correlation_score", details.alias("details"))
    return fused.where("is_event").select("device_id", F.to_json(message).alias("message"))


def acks(packets: DataFrame) -> DataFrame:
    """An acknowledgement for every packet."""
    return packets.select("device_id", F.to_json(F.struct(F.lit("ack").alias("type"), F.col("ts").alias("timestamp"), F.lit("ok").alias("status"))).alias("message"))


def broadcast_message(messages: DataFrame, clients: DataFrame, most_clients: int = 10_000) -> DataFrame:
    """Each message for each active client; more than ``most_clients`` clients are an error, as each message is repeated for them."""
    n = clients.limit(most_clients + 1).count()
    if n > most_clients:
        raise ValueError(f"more than {most_clients} clients")
    return messages.join(F.broadcast(clients))
