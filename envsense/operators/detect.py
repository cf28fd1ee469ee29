"""Rolling k-sigma detectors, rate limit, downsampling, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import let
from .scans import fold, together


def rolling_sigma(rows: DataFrame, keys: list[str], order: list[str], value: str, settings: Settings = DEFAULT, *, zeros: bool = False) -> DataFrame:
    """Adds n, mean, std, threshold, z_score, anomaly over the last ``window`` samples, the current one included.

    Rows without a value are left out: they do not advance the window. std is the population's. The test is
    one-sided and strict and needs ``min_samples``; a window whose spread is only rounding never fires.
    Below ``min_samples`` the statistics are null, or 0 with ``zeros``.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - settings.window, 0)
    v = F.col(value)
    out = rows.where(v.isNotNull()).withColumns({"n": F.count(value).over(w), "mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w)})
    ready = F.col("n") >= settings.min_samples
    spread = F.col("std") > 1e-12 * F.greatest(F.abs("mean"), F.lit(1.0))
    out = out.withColumns({
        "threshold": F.when(ready, F.col("mean") + F.lit(settings.sigmas) * F.col("std")),
        "z_score": F.when(ready, F.when(spread, (v - F.col("mean")) / F.col("std")).otherwise(0.0)),
        "anomaly": F.coalesce(ready & spread & (v > F.col("mean") + F.lit(settings.sigmas) * F.col("std")), F.lit(False)),
    })
    return out.withColumns({c: F.when(ready, F.col(c)) if not zeros else F.when(ready, F.col(c)).otherwise(0.0) for c in ("mean", "std", "threshold", "z_score")})


def sliding_buffer(rows: DataFrame, keys: list[str], micros: str, order: list[str], value: str, reach: int = 5_000_000, most: int = 500) -> DataFrame:
    """Adds buffered, oldest, buffer_mean, buffer_min, buffer_max over a buffer that is bounded by time and by number.

    It holds the rows of the last ``reach`` microseconds (younger than that), but the last ``most`` in ``order`` at most:
    the oldest are dropped. Rows of one microsecond see each other unless the number bounds the buffer. ``micros``
    is a whole number and the first part of ``order``. Null values count as rows and enter no statistic.
    """
    by_time = Window.partitionBy(*keys).orderBy(micros).rangeBetween(1 - reach, 0)
    by_number = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - most, 0)
    near = F.count("*").over(by_time)
    either = lambda f, c: F.when(near <= most, f(c).over(by_time)).otherwise(f(c).over(by_number))
    return rows.withColumns({
        "buffered": F.least(near, F.lit(most)), "oldest": either(F.min, micros), "buffer_mean": either(F.avg, value), "buffer_min": either(F.min, value), "buffer_max": either(F.max, value),
    })


def audio_spike(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds audio_anomaly and its details (peak, reason), which are null where there is none."""
    loud = F.coalesce(F.col("audio_peak"), F.lit(0.0)) > settings.audio_peak
    return rows.withColumns({"audio_anomaly": loud, "audio_details": F.when(loud, F.struct(F.col("audio_peak").alias("peak"), F.lit("audio_peak_threshold").alias("reason")))})


def one_shot(spark: SparkSession, value: float, seed: int = 0, settings: Settings = DEFAULT, noise: DataFrame | None = None) -> DataFrame:
    """One value against 99 samples of N(50, 5), or the one column of ``noise``, and itself; a fresh filter passes the first value as it is."""
    noise = spark.range(99).select((50 + 5 * F.randn(seed)).alias("v")) if noise is None else noise.toDF("v")
    seen = noise.union(spark.createDataFrame([(float(value),)], "v double"))
    stats = seen.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    limit = F.col("mean") + settings.sigmas * F.col("std")
    return stats.select(F.lit(float(value)).alias("raw"), F.lit(float(value)).alias("filtered"), "mean", "std", limit.alias("threshold"), ((value - F.col("mean")) / F.col("std")).alias("z_score"), (F.lit(float(value)) > limit).alias("anomaly"))


def rate_limit(rows: DataFrame, device: str, ts: str, order: list[str], unit: str = "second", limit: int = DEFAULT.rate_limit) -> DataFrame:
    """Rows beyond the first ``limit`` of a device and unit of time, with their rank and an error code."""
    w = Window.partitionBy(device, F.date_trunc(unit, F.col(ts))).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > limit).withColumn("error", F.lit("RATE_LIMIT_EXCEEDED"))


def token_bucket(rows: DataFrame, keys: list[str], micros: str, order: list[str], rate: float = DEFAULT.rate_limit, most: float = DEFAULT.rate_limit) -> DataFrame:
    """keys, order, tokens, error: a bucket of ``most`` tokens that fills by ``rate`` a second; a row takes one or is rejected.

    ``micros`` (whole microseconds) is the first part of ``order``. tokens: what is left after the row.
    """
    kind = "struct<tokens:double,at:bigint,accepted:boolean>"

    def step(s, e):
        full = F.least(F.lit(float(most)), s["tokens"] + F.coalesce(e[micros] - s["at"], F.lit(0)) * F.lit(rate / 1e6))
        return let(full, lambda f: F.struct(F.when(f >= 1, f - 1).otherwise(f).alias("tokens"), e[micros].alias("at"), (f >= 1).alias("accepted")))

    start = F.struct(F.lit(float(most)).alias("tokens"), F.lit(None).cast("long").alias("at"), F.lit(True).alias("accepted"))
    grouped = together(rows.select(*keys, F.struct(*order).alias("sample")), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    each = grouped.select(*keys, F.explode(F.arrays_zip(F.col("samples").alias("s"), fold(F.col("samples"), kind, start, step).alias("f"))).alias("e"))
    return each.select(*keys, *(F.col(f"e.s.{c}").alias(c) for c in order), F.col("e.f.tokens").alias("tokens"), F.when(~F.col("e.f.accepted"), F.lit("RATE_LIMIT_EXCEEDED")).alias("error"))


def downsample_last(rows: DataFrame, device: str, ts: str, order: list[str], every: str, values: list[str]) -> DataFrame:
    """The last row of each device and window of time."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(device, F.window(ts, every).alias("w")).agg(last.alias("l")).select(device, F.col("w.start").alias("window_start"), *(F.col(f"l.{v}").alias(v) for v in values))


def sessions(rows: DataFrame, device: str, ts: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Adds session_id: it rises by one where a device was silent for longer than the gap."""
    w = Window.partitionBy(device).orderBy(*order)
    silent = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > gap_seconds
    return rows.withColumn("session_id", F.sum(F.when(silent, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sync_sensors(left: DataFrame, right: DataFrame, device: str, ts: str, value: str) -> DataFrame:
    """As-of join: each row of ``left`` with the last ``value`` of ``right`` at or before its time."""
    both = left.select(device, ts, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(right.select(device, ts, value, F.lit(0).alias("side")))
    w = Window.partitionBy(device).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")
