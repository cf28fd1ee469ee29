"""Event catalogue, time series, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_events(events: DataFrame, *, device=None, start=None, end=None, classification=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of events, newest first, ties by id; ``total`` is the number before paging. start is included, end is not."""
    kept = events
    for column, value, test in (("device_id", device, "eq"), ("ts", start, "ge"), ("ts", end, "lt"), ("classification", classification, "eq")):
        if value is not None:
            kept = kept.where({"eq": F.col(column) == value, "ge": F.col(column) >= F.lit(value), "lt": F.col(column) < F.lit(value)}[test])
    total = kept.agg(F.count("*").alias("total"))
    page = kept.orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def event(events: DataFrame, event_id) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def latest_classification(events: DataFrame, corrections: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("corrected_at",)) -> DataFrame:
    """Events with their last correction's classification and confidence, where there is one."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    last = corrections.withColumn("r_", F.row_number().over(w)).where("r_ = 1").select(key, F.col("classification").alias("c_"), F.col("confidence").alias("p_"))
    joined = events.join(last, key, "left")
    return joined.withColumns({"classification": F.coalesce("c_", "classification"), "confidence": F.coalesce("p_", "confidence")}).drop("c_", "p_")


def upsert(events: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with those of ``new`` in place of equal keys."""
    return events.join(new.select(key), key, "left_anti").unionByName(new)


def realtime_stats(rows: DataFrame, now: Column) -> DataFrame:
    """Distinct devices, events of the day, mean magnitude, anomalies of the last hour, as of ``now``."""
    past = F.col("ts") <= now
    return rows.agg(
        F.count_distinct(F.when(past, F.col("device_id"))).alias("connected_clients"),
        F.count_if(past & F.col("is_event") & (F.date_trunc("day", "ts") == F.date_trunc("day", now))).alias("events_today"),
        F.avg(F.when(past, F.col("magnitude"))).alias("mean_magnitude"),
        F.count_if(past & F.col("anomaly") & (F.col("ts") > now - F.expr("INTERVAL 1 HOUR"))).alias("anomalies_last_hour"),
    )


def counters(rows: DataFrame, sessions: DataFrame, online_since: Column) -> DataFrame:
    """total_clients (sessions, not distinct devices), packets, events, clients_online (seen since a moment)."""
    packets = rows.agg(F.count("*").alias("total_packets"), F.count_if("is_event").alias("total_events"), F.count_distinct(F.when(F.col("ts") >= online_since, F.col("device_id"))).alias("clients_online"))
    return packets.join(F.broadcast(sessions.select("device_id", "session_id").distinct().agg(F.count("*").alias("total_clients"))))


def points(packets: DataFrame, measurements: dict[str, str]) -> DataFrame:
    """Up to one point for each measurement of a packet: ``measurements`` maps names to struct columns with x, y, z and maybe magnitude."""
    fields = lambda c: [F.col(f"{c}.{a}").alias(a) for a in "xyz"] + [(F.col(f"{c}.magnitude") if "magnitude" in packets.schema[c].dataType.names else F.lit(None).cast("double")).alias("magnitude")]
    all_ = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("measurement"), *fields(c))) for name, c in measurements.items()))
    return packets.select("device_id", F.col("ts").alias("time"), F.explode(F.filter(all_, lambda p: p.isNotNull())).alias("p")).select("p.measurement", "device_id", "time", "p.x", "p.y", "p.z", "p.magnitude")


def point_range(series: DataFrame, *, device, measurement: str, start, stop, fields: list[str]) -> DataFrame:
    """Points of a device and measurement in [start, stop), with the wanted fields."""
    return series.where((F.col("measurement") == measurement) & (F.col("device_id") == device) & (F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(stop))).select("device_id", "time", *fields)
