"""Feature vectors, classification metrics, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import magnitude
from .scans import fold


def sensor_features(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ten features of each event's sensor rows; std is the sample's and null for one row; yaw is the last."""
    norm = lambda p: magnitude(*(F.col(f"{p}_{a}") for a in "xyz"))
    return rows.groupBy(key).agg(
        F.avg("magnetic_magnitude").alias("mag_mean"), F.stddev_samp("magnetic_magnitude").alias("mag_std"),
        F.max("magnetic_magnitude").alias("mag_max"), F.min("magnetic_magnitude").alias("mag_min"),
        F.avg(norm("accel")).alias("accel_mean"), F.avg(norm("gyro")).alias("gyro_mean"),
        F.max_by("orientation_yaw", F.struct(*order)).alias("last_yaw"), F.max("audio_peak").alias("audio_peak_max"),
        F.bool_or("humanoid_detected").alias("humanoid_any"), F.avg("bluetooth_count").alias("bluetooth_mean"),
    )


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy and macro-F1 over the classes that occur as label or prediction; a class without a hit has F1 0."""
    cells = confusion(rows, label, predicted)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("side")).unionByName(cells.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("side")))
    f1 = sides.groupBy("class").agg((2 * F.sum("tp") / F.sum("side")).alias("f1"))
    total = cells.agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    return total.join(F.broadcast(f1.agg(F.avg("f1").alias("macro_f1"))))


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of each dimension of a key's vectors."""
    long = rows.select(key, F.posexplode(vector).alias("dim", "v"))
    means = long.groupBy(key, "dim").agg(F.avg("v").alias("mean"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("pooled"))


def concat_embeddings(rows: DataFrame, *vectors: str) -> DataFrame:
    """Adds ``embedding``: the vectors one after the other."""
    return rows.withColumn("embedding", F.concat(*vectors))


def training_schedule(
    logged: DataFrame, keys: list[str], order: list[str], loss: str, rate: float = 1e-3, *, factor: float = 0.5, patience: int = 5, threshold: float = 1e-4, stop_patience: int = 10, rounds: int = 50,
) -> DataFrame:
    """keys, epoch (from 1), loss, rate, bad, wait, stopped for each epoch of a run that is trained.

    The rate after an epoch: it is multiplied by ``factor`` once more than ``patience`` epochs in a row have not brought
    the loss below its best by the share ``threshold``. Training stops with the epoch ``stop_patience`` after the last
    that was strictly best, with a loss that is null or not finite, or after ``rounds``; later rows are left out.
    """
    kind = "struct<epoch:int,best:double,bad:int,rate:double,least:double,wait:int,stopped:boolean>"

    def step(s, x):
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        better, least = F.coalesce(x < s["best"] * (1 - threshold), F.lit(False)), F.coalesce(x < s["least"], F.lit(False))
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        lower = (bad > patience) & (s["rate"] * (1 - factor) > 1e-8)
        wait = F.when(least, 0).otherwise(s["wait"] + 1)
        return F.struct(
            (s["epoch"] + 1).alias("epoch"), F.when(better, x).otherwise(s["best"]).alias("best"), F.when(bad > patience, 0).otherwise(bad).alias("bad"), F.when(lower, s["rate"] * factor).otherwise(s["rate"]).alias("rate"),
            F.when(least, x).otherwise(s["least"]).alias("least"), wait.alias("wait"), ((wait >= stop_patience) | ~finite | (s["epoch"] + 1 >= rounds)).alias("stopped"),
        )

    start = F.struct(F.lit(0).alias("epoch"), F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(rate).alias("rate"), F.lit(float("inf")).alias("least"), F.lit(0).alias("wait"), F.lit(False).alias("stopped"))
    w = Window.partitionBy(*keys).orderBy(*order)
    first = logged.select(*keys, *order, F.col(loss).cast("double").alias("loss")).withColumn("epoch_", F.row_number().over(w)).where(F.col("epoch_") <= rounds)
    runs = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("epoch_", "loss"))).alias("log"))
    states = fold(F.transform("log", lambda e: e["loss"]), kind, start, step)
    each = runs.select(*keys, F.explode(F.arrays_zip(F.transform("log", lambda e: e["loss"]).alias("loss"), states.alias("s"))).alias("e"))
    ended = F.coalesce(F.min(F.when(F.col("e.s.stopped"), F.col("e.s.epoch"))).over(Window.partitionBy(*keys)), F.lit(rounds))
    return each.withColumn("ended_", ended).where("e.s.epoch <= ended_").select(*keys, "e.s.epoch", F.col("e.loss").alias("loss"), "e.s.rate", "e.s.bad", "e.s.wait", "e.s.stopped")


def best_checkpoints(runs: DataFrame, loss: str, keep: int = 3) -> DataFrame:
    return runs.orderBy(loss, *[c for c in runs.columns if c != loss]).limit(keep)
