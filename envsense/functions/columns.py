"""Scalar and array functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label indexes, and the label of what is in none of them.
LABELS = {"Ruído_Ambiente": 0, "Anomalia_Magnética": 1, "Anomalia_Áudio": 2, "Evento_Correlacionado": 3}


def let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def event_id(ts_ns: Column) -> Column:
    """``event_`` and the whole seconds of a float division: rounds up just below a second."""
    return F.concat(F.lit("event_"), (ts_ns.cast("double") / F.lit(1e9)).cast("bigint").cast("string"))


def calendar_event_id(ts: Column) -> Column:
    return F.date_format(ts, "'event_'yyyyMMdd_HHmmss")


def clock_offset(t2: Column, t1: Column, round_trip: Column) -> Column:
    """Offset of a clock: the answer's time, less the question's, less half of the round trip."""
    return t2 - t1 - round_trip / 2


def relative_time(ts: Column, *session: str) -> Column:
    from pyspark.sql import Window

    return ts - F.min(ts).over(Window.partitionBy(*session))


def pcm_to_float(samples: Column) -> Column:
    """16-bit samples to [-1, 1)."""
    return F.transform(samples, lambda v: v / F.lit(32768.0))


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(F.abs(amplitude) + F.lit(1e-10))


def power_decibels(power: Column) -> Column:
    return 10 * F.log10(power + F.lit(1e-10))


def softmax(logits: Column) -> Column:
    def scaled(a):
        return let(F.transform(a, lambda v: F.exp(v - F.array_max(a))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w)))

    return let(logits, scaled)


def argmax(values: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def progress(n: Column, of: int = 100) -> Column:
    return F.least(F.greatest(n / F.lit(float(of)), F.lit(0.0)), F.lit(1.0))


def label_index(label: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, label), F.lit(0))


def pose_present(confidences: Column, least: int = 5, above: float = 0.3) -> Column:
    """Whether at least five keypoints have a confidence above 0.3."""
    return F.size(F.filter(confidences, lambda c: c > above)) >= least


def mean_confidence(confidences: Column) -> Column:
    """Mean over all keypoints; null without one."""
    return F.aggregate(confidences, F.lit(0.0), lambda s, c: s + c) / F.when(F.size(confidences) > 0, F.size(confidences))


def low_power(level: Column, scale: Column, below: int = 20) -> Column:
    return (level / scale * 100).cast("int") < below


def formant_valid(frequencies: Column) -> Column:
    return F.array_sort(F.filter(frequencies, lambda f: (f > 250) & (f < 3800)))


def frame_indexes(total: Column, frames: int = 150) -> Column:
    """Places of evenly spaced frames from the first to the last, truncated."""
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.floor(i * (total - 1) / (frames - 1)).cast("int"))


def pad_or_trim(samples: Column, length: int = 220_500) -> Column:
    """An array of exactly ``length`` values: cut, or filled with zeros."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), length)), 1, length)


def downmix(channels: Column) -> Column:
    """Mean over channels of an array of equal-length arrays, one for each channel."""
    n = F.size(channels)
    return F.transform(F.sequence(F.lit(0), F.size(F.get(channels, F.lit(0))) - 1), lambda i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i)) / n)
