"""Hard- and soft-iron fit, bias estimates, application, the wizard's steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

AXES = "xyz"
#: Fixed value: the least positive single-precision number, where literal mode starts its maxima.
LEAST_FLOAT = 1.401298464324817e-45
#: The wizard's states in order.
STEPS = (
    "WELCOME", "PREPARE_MAGNETOMETER", "CALIBRATE_MAG_1", "CALIBRATE_MAG_2", "CALIBRATE_MAG_3", "CALIBRATE_MAG_4", "CALIBRATE_MAG_5", "CALIBRATE_MAG_6",
    "MAG_FIGURE_8", "PREPARE_ACCELEROMETER", "CALIBRATE_ACCEL", "PREPARE_GYROSCOPE", "CALIBRATE_GYRO", "COMPLETED",
)
#: Which sensor is fitted when a state is left.
COMPUTES = {"MAG_FIGURE_8": "magnetometer", "CALIBRATE_ACCEL": "accelerometer", "CALIBRATE_GYRO": "gyroscope"}


def fit_magnetometer(samples: DataFrame, key: str, *, literal: bool = False) -> DataFrame:
    """Offsets and scales of each device from the extremes of its axes; an axis without range has scale 1.

    ``literal`` starts the maxima at the least positive float, so an all-negative axis has maximum 0.
    """
    high = lambda a: F.greatest(F.max(a), F.lit(LEAST_FLOAT)) if literal else F.max(a)
    ends = samples.groupBy(key).agg(*(F.min(a).alias(f"min_{a}") for a in AXES), *(high(a).alias(f"max_{a}") for a in AXES))
    ranges = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES}
    mean = (ranges["x"] + ranges["y"] + ranges["z"]) / 3
    scale = lambda a: F.when(F.abs(ranges[a]) > 1e-6, mean / ranges[a]).otherwise(1.0)
    return ends.select(key, *(((F.col(f"max_{a}") + F.col(f"min_{a}")) / 2).alias(f"offset_{a}") for a in AXES), *(scale(a).alias(f"scale_{a}") for a in AXES))


def fit_bias(samples: DataFrame, key: str, *, gravity: float = 0.0) -> DataFrame:
    """Mean of each axis, less gravity on z (9.8 for the accelerometer); devices without samples have no row."""
    means = samples.groupBy(key).agg(*(F.avg(a).alias(f"offset_{a}") for a in AXES))
    return means.withColumn("offset_z", F.col("offset_z") - gravity)


def complete_steps(samples: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """Count, progress and completeness of each step."""
    counted = samples.groupBy(*keys).agg(F.count("*").alias("samples"))
    return counted.withColumns({"progress": F.least(F.col("samples") / F.lit(float(settings.calibration_samples)), F.lit(1.0)), "complete": F.col("samples") >= settings.calibration_samples})


def apply(readings: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """(raw - offset) * scale on x, y, z; readings without a calibration pass as they are."""
    names = [f"{p}_{a}" for p in ("offset", "scale") for a in AXES]
    c = calibration.select(*keys, *(F.col(n) for n in names if n in calibration.columns))
    joined = readings.join(c, keys, "left")
    value = lambda n, default: F.coalesce(F.col(n), F.lit(default)) if n in calibration.columns else F.lit(default)
    return joined.withColumns({a: (F.col(a) - value(f"offset_{a}", 0.0)) * value(f"scale_{a}", 1.0) for a in AXES}).drop(*c.columns[len(keys) :])


def with_defaults(devices: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Stored calibrations of all devices; offsets 0, scales 1, not calibrated where there is none."""
    joined = devices.join(calibration, keys, "left")
    zero = {f"offset_{a}": F.coalesce(F.col(f"offset_{a}"), F.lit(0.0)) for a in AXES}
    one = {f"scale_{a}": F.coalesce(F.col(f"scale_{a}"), F.lit(1.0)) for a in AXES}
    return joined.withColumns(zero | one | {"timestamp": F.coalesce("timestamp", F.lit(0)), "calibrated": F.coalesce("calibrated", F.lit(False))})


def next_steps(spark) -> DataFrame:
    """place, step, computes, next_step: the wizard as a table; the last step stays."""
    rows = spark.createDataFrame([(k, s, COMPUTES.get(s)) for k, s in enumerate(STEPS)], "place int, step string, computes string")
    return rows.withColumn("next_step", F.coalesce(F.lead("step").over(Window.orderBy("place")), "step"))


def wizard_progress(samples: DataFrame, keys: list[str], order: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """keys, place, step, samples, complete, computes, next_step: how far each device's samples have taken its wizard.

    States that only announce are passed; each of the others takes ``calibration_samples`` samples in order and is then
    left, which fits the sensor that ``computes`` names. Samples beyond the last state are counted as COMPLETED.
    """
    taking = [s for s in STEPS if not s.startswith(("WELCOME", "PREPARE"))]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    k = F.least(F.floor(n / settings.calibration_samples), F.lit(len(taking) - 1)).cast("int")
    counted = samples.select(*keys, F.get(F.array(*map(F.lit, taking)), k).alias("step")).groupBy(*keys, "step").agg(F.count("*").alias("samples"))
    steps = next_steps(samples.sparkSession)
    out = counted.join(F.broadcast(steps), "step").withColumn("complete", (F.col("samples") >= settings.calibration_samples) | (F.col("step") == STEPS[-1]))
    return out.select(*keys, "place", "step", "samples", "complete", F.when(F.col("complete"), F.col("computes")).alias("computes"), "next_step")
