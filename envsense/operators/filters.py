"""Recursive filters over ordered samples of a key, as folds of Spark's higher-order functions.

A key that is too long for one task is split: see ``scans``. ``split`` gives the samples of a chunk; by default the
samples of the keys are counted, and chunks are used if a key has more than ``scans.LONG``.

A fold carries its state through ``aggregate`` and appends each step's row to an array, in chunks, since
appending one element copies the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..config import DEFAULT, Settings
from ..functions import matrix as M
from ..functions.columns import let
from ..shared import cut
from . import scans
from .scans import fold


def _ordered(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], dealt: bool = False) -> DataFrame:
    """One row a key with its samples in order: struct of the order columns and values. ``dealt``: the rows are by key already."""
    sample = F.struct(*order, *(c.alias(k) for k, c in values.items()))
    flat = rows.select(*keys, sample.alias("sample"))
    return (flat if dealt else scans.together(flat, *keys)).groupBy(*keys).agg(F.array_sort(F.collect_list("sample")).alias("samples"))


#: Rows that a task filters together, a step of all their keys at a time.
ROWS = 1 << 17
PLAIN = "struct<n:int,x_prior:double,x:double,p:double,gain:double>"


def _series(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], scan, step, first, split: int | None) -> DataFrame:
    """keys, samples, before: a key's samples in order, or chunks of them if the key is long or ``split`` is given.

    before: what the earlier samples come to by ``scan``, whose elements ``step`` and ``first`` make.
    """
    if split or scans.is_long(rows, keys):
        return scans.scanned(scans.chunked(rows, keys, order, values, split or scans.SPLIT), keys, scan, step, first)
    return _ordered(rows, keys, order, values).withColumn("before", scan.unit)


def _begun(kind: str, fresh: Column, later: Column) -> Column:
    """State before a chunk: ``later`` where samples came before it."""
    return F.when(F.col("before.n") == 0, fresh.cast(kind)).otherwise(later.cast(kind))


def plain_step(state: Column, z: Column, q: float, r: float) -> Column:
    m = state["p"] + F.lit(q)

    def update(gain):
        first = state["n"] == 0
        return F.struct(
            (state["n"] + 1).alias("n"),
            state["x"].alias("x_prior"),
            F.when(first, z).otherwise(state["x"] + gain * (z - state["x"])).alias("x"),
            F.when(first, m).otherwise((1 - gain) * m).alias("p"),
            F.when(first, F.lit(0.0)).otherwise(gain).alias("gain"),
        )

    return let(m / (m + F.lit(r)), update)


def _start(x0: float = 0.0) -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(x0).alias("x_prior"), F.lit(x0).alias("x"), F.lit(1.0).alias("p"), F.lit(0.0).alias("gain"))


def kalman_1d(rows: DataFrame, keys: list[str], order: list[str], value: str, q: float = 1e-5, r: float = 1e-2, x0: float = 0.0, split: int | None = None) -> DataFrame:
    """Constant-noise filter: keys, order, z, x_prior, x, p, gain for each sample that is not null.

    The first sample becomes the state as it is, with p = 1 + q.
    """
    present = rows.where(F.col(value).isNotNull())
    grouped = _series(present, keys, order, {"z": F.col(value)}, scans.gaussian(1), lambda s: scans.gaussian_step([s["z"]], q, F.lit(r)), lambda s: scans.gaussian_first([s["z"]], 1.0 + q), split)
    later = F.struct(F.col("before.n").cast("int").alias("n"), F.col("before.b0").alias("x_prior"), F.col("before.b0").alias("x"), F.col("before.c").alias("p"), F.lit(0.0).alias("gain"))
    states = fold(F.transform("samples", lambda s: s["z"]), PLAIN, _begun(PLAIN, _start(x0), later), lambda s, z: plain_step(s, z, q, r))
    pairs = grouped.select(*keys, F.explode(F.arrays_zip(F.col("samples").alias("s"), states.alias("f"))).alias("e"))
    return pairs.select(*keys, *(F.col(f"e.s.{c}").alias(c) for c in order), F.col("e.s.z").alias("z"), *(F.col(f"e.f.{c}").alias(c) for c in ("x_prior", "x", "p", "gain")))


def kalman_3d(rows: DataFrame, keys: list[str], order: list[str], axes: tuple[str, str, str], q: float = 1e-5, r: float = 1e-2, split: int | None = None) -> DataFrame:
    """Three independent filters in one fold: keys, order, x, y, z (filtered) and the common p."""
    three = lambda s: [s[f"z{k}"] for k in range(3)]
    values = {f"z{k}": F.col(a) for k, a in enumerate(axes)}
    grouped = _series(rows, keys, order, values, scans.gaussian(3), lambda s: scans.gaussian_step(three(s), q, F.lit(r)), lambda s: scans.gaussian_first(three(s), 1.0 + q), split)
    kind = "struct<n:int,a:double,b:double,c:double,p:double>"

    def step(s, v):
        m = s["p"] + F.lit(q)
        first = s["n"] == 0

        def update(g):
            axis = lambda x, k: F.when(first, v[f"z{k}"]).otherwise(x + g * (v[f"z{k}"] - x))
            return F.struct((s["n"] + 1).alias("n"), axis(s["a"], 0).alias("a"), axis(s["b"], 1).alias("b"), axis(s["c"], 2).alias("c"), F.when(first, m).otherwise((1 - g) * m).alias("p"))

        return let(m / (m + F.lit(r)), update)

    fresh = F.struct(F.lit(0).alias("n"), *(F.lit(0.0).alias(c) for c in "abc"), F.lit(1.0).alias("p"))
    later = F.struct(F.col("before.n").alias("n"), *(F.col(f"before.b{k}").alias(c) for k, c in enumerate("abc")), F.col("before.c").alias("p"))
    start = _begun(kind, fresh, later)
    pairs = grouped.select(*keys, F.explode(F.arrays_zip(F.col("samples").alias("s"), fold(F.col("samples"), kind, start, step).alias("f"))).alias("e"))
    return pairs.select(*keys, *(F.col(f"e.s.{c}").alias(c) for c in order), F.col("e.f.a").alias("x"), F.col("e.f.b").alias("y"), F.col("e.f.c").alias("z"), F.col("e.f.p").alias("p"))


def kalman_adaptive(rows: DataFrame, keys: list[str], order: list[str], value: str, settings: Settings = DEFAULT, split: int | None = None) -> DataFrame:
    """The adaptive filter: keys, order, raw, filtered, p, r for each sample that is not null.

    The noise r moves by ``adapt_alpha`` towards the population variance of the last ten raw samples, the
    current one included, once there are three; the first sample becomes the state with p = 1. The noise is
    found first; of a key that is not split, variances are window aggregates.
    """
    present = rows.where(F.col(value).isNotNull())
    alpha, q = settings.adapt_alpha, settings.kalman_q
    noise = lambda r, v: F.when(v.isNull(), r).otherwise((1 - alpha) * r + alpha * v)
    if split or scans.is_long(present, keys):
        grouped = _split_adaptive(present, keys, order, value, settings, noise, split or scans.SPLIT)
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - settings.adapt_window, 0)
        dealt = scans.together(present.select(*keys, *order, F.col(value).alias("z_")), *keys)
        ready = dealt.withColumn("v_", F.when(F.count("z_").over(w) >= 3, F.var_pop("z_").over(w)))
        grouped = _ordered(ready, keys, order, {"z": F.col("z_"), "v": F.col("v_")}, dealt=True).withColumns({"r_start": F.lit(settings.kalman_r), "before": scans.gaussian(1).unit})
    kind = "struct<n:int,x:double,p:double,r:double>"

    def step(s, e):
        m = s["p"] + F.lit(q)
        update = lambda b: F.struct((s["n"] + 1).alias("n"), (s["x"] + b["g"] * (e["z"] - s["x"])).alias("x"), ((1 - b["g"]) * b["m"]).alias("p"), b["r"].alias("r"))
        later = let(F.struct(noise(s["r"], e["v"]).alias("r"), m.alias("m")), lambda a: let(F.struct(a["r"].alias("r"), a["m"].alias("m"), (a["m"] / (a["m"] + a["r"])).alias("g")), update))
        return F.when(s["n"] == 0, F.struct(F.lit(1).alias("n"), e["z"].alias("x"), F.lit(1.0).alias("p"), s["r"].alias("r"))).otherwise(later)

    fresh = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("x"), F.lit(1.0).alias("p"), F.col("r_start").alias("r"))
    later = F.struct(F.col("before.n").alias("n"), F.col("before.b0").alias("x"), F.col("before.c").alias("p"), F.col("r_start").alias("r"))
    pairs = grouped.select(*keys, F.explode(F.arrays_zip(F.col("samples").alias("s"), fold(F.col("samples"), kind, _begun(kind, fresh, later), step).alias("f"))).alias("e"))
    return pairs.select(*keys, *(F.col(f"e.s.{c}").alias(c) for c in order), F.col("e.s.z").alias("raw"), F.col("e.f.x").alias("filtered"), F.col("e.f.p").alias("p"), F.col("e.f.r").alias("r"))


def _variance(values: Column) -> Column:
    """Population variance of an array of three values or more; null of fewer."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    around = lambda a: let(total(a) / F.size(a), lambda m: total(F.transform(a, lambda v: (v - m) * (v - m))) / F.size(a))
    return let(values, lambda a: F.when(F.size(a) >= 3, around(a)))


def _split_adaptive(rows: DataFrame, keys: list[str], order: list[str], value: str, settings: Settings, noise, split: int) -> DataFrame:
    """keys, samples (z and v), r_start, before, for chunks: three scans, of the last values, of the noise and of the filter."""
    chunks, most = scans.chunked(rows, keys, order, {"z": F.col(value)}, split), settings.adapt_window
    one = lambda **c: F.struct(F.lit(1).cast("long").alias("n"), *(x.alias(k) for k, x in c.items()))
    near = scans.scanned(chunks, keys, scans.last_values(most - 1), lambda s: one(tail=F.array(s["z"])))
    ends = lambda all_, i: F.slice(all_, F.greatest(F.size("before.tail") + i + 2 - most, F.lit(1)), F.least(F.size("before.tail") + i + 1, F.lit(most)))
    with_v = lambda all_: F.transform("samples", lambda s, i: F.struct(*(s[c].alias(c) for c in order), s["z"].alias("z"), _variance(ends(all_, i)).alias("v")))
    ready = cut(near.select(*keys, "block_", let(F.concat("before.tail", F.transform("samples", lambda s: s["z"])), with_v).alias("samples")))
    alpha = settings.adapt_alpha
    moves = lambda s: F.when(s["v"].isNull(), one(a=F.lit(1.0), c=F.lit(0.0))).otherwise(one(a=F.lit(1 - alpha), c=alpha * s["v"]))
    noisy = scans.scanned(ready, keys, scans.affine(), moves)
    noisy = noisy.withColumn("r_start", F.col("before.a") * F.lit(settings.kalman_r) + F.col("before.c"))
    levels = fold(F.transform("samples", lambda s: s["v"]), "struct<r:double>", F.struct(F.col("r_start").alias("r")), lambda s, v: F.struct(noise(s["r"], v).alias("r")))
    joint = F.zip_with("samples", levels, lambda s, r: F.struct(*(s[c].alias(c) for c in order), s["z"].alias("z"), s["v"].alias("v"), r["r"].alias("r")))
    steps = cut(noisy.select(*keys, "block_", "r_start", joint.alias("samples")))
    return scans.scanned(steps, keys, scans.gaussian(1), lambda s: scans.gaussian_step([s["z"]], settings.kalman_q, s["r"]), lambda s: scans.gaussian_first([s["z"]], 1.0))


def orientation(rows: DataFrame, keys: list[str], order: list[str], beta: float = 0.1) -> DataFrame:
    """Gradient-descent fusion of accelerometer (ax, ay, az) and gyroscope (gx, gy, gz, radians) over dt seconds.

    Adds roll, pitch, yaw in radians. A zero acceleration has no direction: its gradient step is left
    out. The sine of the pitch is held to [-1, 1].
    """
    names = ("ax", "ay", "az", "gx", "gy", "gz", "dt")
    grouped = _ordered(rows, keys, order, {n: F.col(n) for n in names})
    kind = "struct<q0:double,q1:double,q2:double,q3:double>"

    def step(q, e):
        q0, q1, q2, q3 = (q[f"q{k}"] for k in range(4))

        def direction(a):
            f1, f2, f3 = 2 * q0 * q2 - 2 * q1 * q3 - a["x"], 2 * q0 * q1 + 2 * q2 * q3 - a["y"], 1 - 2 * q1 * q1 - 2 * q2 * q2 - a["z"]
            slopes = F.struct(
                (-2 * (q1 * f1 + q2 * f2 + q3 * f3)).alias("s0"), (2 * (q0 * f1 + q3 * f2 - 2 * q1 * f3)).alias("s1"),
                (2 * (q3 * f1 + q0 * f2 - 2 * q2 * f3)).alias("s2"), (-2 * q2 * f1 + 2 * q1 * f2).alias("s3"),
            )
            none = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in range(4)))
            return F.when(a["n"] > 0, slopes).otherwise(none)

        def move(s):
            gx, gy, gz, dt = e["gx"], e["gy"], e["gz"], e["dt"]
            rates = (-q1 * gx - q2 * gy - q3 * gz, q0 * gx + q2 * gz - q3 * gy, q0 * gy - q1 * gz + q3 * gx, q0 * gz + q1 * gy - q2 * gx)
            return F.struct(*((q[f"q{k}"] + (0.5 * rate - beta * s[f"s{k}"]) * dt).alias(f"q{k}") for k, rate in enumerate(rates)))

        def unit(v):
            return let(F.sqrt(v["q0"] * v["q0"] + v["q1"] * v["q1"] + v["q2"] * v["q2"] + v["q3"] * v["q3"]), lambda n: F.struct(*((v[f"q{k}"] / n).alias(f"q{k}") for k in range(4))))

        norm = F.sqrt(e["ax"] * e["ax"] + e["ay"] * e["ay"] + e["az"] * e["az"])
        towards = let(norm, lambda n: F.struct(n.alias("n"), *((e[f"a{c}"] / F.when(n > 0, n).otherwise(1.0)).alias(c) for c in "xyz")))
        return let(let(let(towards, direction), move), unit)

    start = F.struct(F.lit(1.0).alias("q0"), *(F.lit(0.0).alias(f"q{k}") for k in (1, 2, 3)))
    pairs = grouped.select(*keys, F.explode(F.arrays_zip(F.col("samples").alias("s"), fold(F.col("samples"), kind, start, step).alias("f"))).alias("e"))
    flat = pairs.select(*keys, *(F.col(f"e.s.{c}").alias(c) for c in order), *(F.col(f"e.f.q{k}").alias(f"q{k}") for k in range(4)))
    q0, q1, q2, q3 = (F.col(f"q{k}") for k in range(4))
    sine = F.least(F.greatest(2 * (q0 * q2 - q3 * q1), F.lit(-1.0)), F.lit(1.0))
    return flat.withColumns({
        "roll": F.atan2(2 * (q0 * q1 + q2 * q3), 1 - 2 * (q1 * q1 + q2 * q2)),
        "pitch": F.asin(sine),
        "yaw": F.atan2(2 * (q0 * q3 + q1 * q2), 1 - 2 * (q2 * q2 + q3 * q3)),
    })


def _riccati_powers(f, h, qs, rs, most: int = 48) -> list[tuple]:
    """(A, C, J) for 1, 2, 4 ... steps of the covariance: P becomes A (1 + P J)^-1 P A' + C. Ends where P is forgotten."""
    inner = np.linalg.inv(h @ qs @ h.T + rs)
    left = np.eye(len(f)) - qs @ h.T @ inner @ h
    a, c, j = left @ f, left @ qs, f.T @ h.T @ inner @ h @ f
    powers = [(a, c, j)]
    while len(powers) < most and np.abs(a).max() > 0:
        w = np.linalg.inv(np.eye(len(f)) + c @ j)
        a, c, j = a @ w @ a, a @ w @ c @ a.T + c, a.T @ w.T @ j @ a + j
        powers.append((a, c, j))
    return powers


def _covariance(steps: Column, start, powers: list[tuple]) -> Column:
    """The covariance ``steps`` steps after the matrix ``start``, by the powers of two in ``steps``."""
    n = len(start)
    table = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), *(M.literal(v).alias(x) for x, v in zip("acj", power))) for k, power in enumerate(powers)))

    def apply(p, t):
        kept = let(M.inverse(M.combined(M.product(p, t["j"], n), M.literal(M.identity(n))), n), lambda w: M.product(M.product(t["a"], w, n), p, n))
        return F.when(steps.bitwiseAND(t["bit"]) == 0, p).otherwise(M.combined(M.times_transposed(kept, t["a"]), t["c"]))

    return F.aggregate(table, M.literal(start), apply)


class _Gains:
    """Gains and traces of the covariance after 1, 2, 3 ... samples: they depend on no measurement. Ends where the covariance stands still.

    Where a gain does not exist (its matrix is singular) there are none from then on: ``lost``.
    """

    def __init__(self, f, h, qs, rs, start_p, guess):
        self.f, self.h, self.qs, self.rs, self.p = f, h, qs, rs, start_p
        self.gains, self.traces, self.done, self.lost = [guess], [np.trace(start_p)], False, None

    def upto(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.gains) < most and not self.done:
            ahead = self.f @ self.p @ self.f.T + self.qs
            try:
                gain = ahead @ self.h.T @ np.linalg.inv(self.h @ ahead @ self.h.T + self.rs)
            except np.linalg.LinAlgError:
                self.done, self.lost = True, len(self.gains) + 1
                break
            p = ahead - gain @ self.h @ ahead
            self.done, self.p = np.array_equal(p, self.p), p
            self.gains.append(gain)
            self.traces.append(np.trace(p))
        return np.array(self.gains), np.array(self.traces)


def _filtered(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], f, h, gains: _Gains) -> DataFrame:
    """keys, order, x, trace of samples dealt out by key and sorted. A task takes many keys' samples as arrays, and a step of all of them at a time."""
    n, names, kept = len(f), [*values], len(keys) + len(order)
    flat = scans.together(rows.select(*keys, *order, *(c.alias(k) for k, c in values.items())), *keys)
    nth = flat.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *values))).sortWithinPartitions(*keys, *order, *values)

    def states(nth, z, x) -> np.ndarray:
        """The state after each row; ``x`` is the one before the first, if that is not its key's first."""
        table, _ = gains.upto(int(nth.max()))
        gain = table[np.minimum(nth, len(table)) - 1]
        begins = np.union1d([0], np.flatnonzero(nth == 1))
        lengths = np.diff(np.append(begins, len(nth)))
        longest = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[longest], lengths[longest]
        now, out = np.zeros((len(begins), n)), np.empty((len(nth), n))
        if nth[0] != 1:
            now[begins == 0] = x
        open_ = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # keys that have a sample more
        for t, k in enumerate(open_):
            at = begins[:k] + t
            ahead = now[:k] @ f.T
            now = ahead + np.einsum("rij,rj->ri", gain[at], z[at] - ahead @ h.T)
            out[at] = now
        return out

    def block(batches: list[pa.RecordBatch], x) -> tuple[pa.RecordBatch, np.ndarray]:
        given = pa.Table.from_batches(batches).combine_chunks()
        nth = given["nth_"].to_numpy()
        out = states(nth, np.column_stack([given[k].to_numpy() for k in names]), x)
        _, traces = gains.upto(int(nth.max()))
        none = nth >= gains.lost if gains.lost else np.zeros(len(nth), bool)
        ends = pa.array(np.arange(0, out.size + 1, n, dtype=np.int32), mask=np.append(none, False))
        made = [pa.ListArray.from_arrays(ends, pa.array(out.ravel())), pa.array(traces[np.minimum(nth, len(traces)) - 1], mask=none)]
        columns = [given[c].chunk(0) for c in given.column_names[:kept]]
        return pa.RecordBatch.from_arrays([*columns, *made], names=[*given.column_names[:kept], "x", "trace"]), out[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, x = [], 0, None
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                out, x = block(held, x)
                held, count = [], 0
                yield out
        if count:
            yield block(held, x)[0]

    fields = flat.select(*keys, *order).schema.fields
    return nth.mapInArrow(run, StructType(fields).add("x", ArrayType(DoubleType())).add("trace", DoubleType()))


def matrix_kalman(
    rows: DataFrame, keys: list[str], order: list[str], values: list[str], transition=None, observe=None, q: float = 1e-5, r: float = 1e-2, split: int | None = None
) -> DataFrame:
    """Linear filter with a matrix state: predict with ``transition``, update with ``observe`` (identity by default).

    The first measurement sets the state through the pseudo-inverse of ``observe``, after a step of the covariance
    from the identity. Gives keys, order, x (array) and trace (of P). Samples with a null value are left out.
    Of a key that is split, the covariance before a chunk comes from the number of samples before it; of others the gains
    are worked out once for all keys.
    """
    m = len(values)
    n = m if transition is None else len(transition)
    f = np.eye(n) if transition is None else np.array(transition, float)
    h = np.eye(m, n) if observe is None else np.array(observe, float)
    qs, rs = q * np.eye(n), r * np.eye(m)
    start_p, guess, none = f @ f.T + qs, np.linalg.pinv(h), [0.0] * n
    z = lambda s: F.array(*(s[f"z{k}"] for k in range(m)))

    def gained(p, then):
        """then(gain, h p, p): the gain after a predicted covariance p."""
        ahead = M.combined(M.times_transposed(M.product(M.literal(f), p, n), M.literal(f)), M.literal(qs))

        def gain(t):
            spread = M.combined(M.times_transposed(t["hp"], M.literal(h)), M.literal(rs))
            return let(M.product(M.transpose(t["hp"], n), M.inverse(spread, m), m), lambda k: then(k, t["hp"], t["p"]))

        return let(let(ahead, lambda p: F.struct(p.alias("p"), M.product(M.literal(h), p, n).alias("hp"))), gain)

    def step(s, sample):
        """State after a sample."""
        moved = lambda k, x: M.added(x, M.apply(k, M.added(z(sample), M.apply(M.literal(h), x), -1)))
        later = gained(s["p"], lambda k, hp, p: F.struct((s["n"] + 1).alias("n"), moved(k, M.apply(M.literal(f), s["x"])).alias("x"), M.combined(p, M.product(k, hp, n), -1).alias("p")))
        begun = F.struct(F.lit(1).cast("long").alias("n"), M.apply(M.literal(guess), z(sample)).alias("x"), M.literal(start_p).alias("p"))
        return F.when(s["n"] == 0, begun).otherwise(later)

    def step_map(s, sample):
        """The map x -> a x + b after a sample more, and the covariance."""
        kept = lambda k: M.combined(M.literal(f), M.product(k, M.literal(h @ f), n), -1)
        after = lambda k, hp, p: let(kept(k), lambda t: F.struct((s["n"] + 1).alias("n"), M.product(t, s["a"], n).alias("a"), M.added(M.apply(t, s["b"]), M.apply(k, z(sample))).alias("b"), M.combined(p, M.product(k, hp, n), -1).alias("p")))
        begun = F.struct(F.lit(1).cast("long").alias("n"), M.literal(np.zeros((n, n))).alias("a"), M.apply(M.literal(guess), z(sample)).alias("b"), M.literal(start_p).alias("p"))
        return F.when(s["n"] == 0, begun).otherwise(gained(s["p"], after))

    present, named = rows.dropna(subset=values), {f"z{k}": F.col(v).cast("double") for k, v in enumerate(values)}
    kind, square = "struct<n:bigint,x:array<double>,p:array<array<double>>>", "array<array<double>>"
    if not split and not scans.is_long(present, keys):
        return _filtered(present, keys, order, named, f, h, _Gains(f, h, qs, rs, start_p, guess))
    size = F.struct(F.size("samples").cast("long").alias("n"))
    counted = scans.with_prefixes(scans.chunked(present, keys, order, named, split or scans.SPLIT), keys, scans.counts(), F.struct(size.alias("first"), size.alias("later")))
    p = _covariance(F.greatest(F.col("before.n") - 1, F.lit(0)), start_p, _riccati_powers(f, h, qs, rs))
    chunks = cut(counted.select(*keys, "block_", "samples", F.col("before.n").alias("n_"), p.alias("p_")))
    whole = F.struct(F.col("n_").alias("n"), M.literal(M.identity(n)).alias("a"), F.array(*map(F.lit, none)).alias("b"), F.col("p_").alias("p")).cast(f"struct<n:bigint,a:{square},b:array<double>,p:{square}>")
    maps = let(F.aggregate("samples", whole, step_map), lambda e: F.struct((e["n"] - F.col("n_")).alias("n"), e["a"].alias("a"), e["b"].alias("b")))
    part = let(maps, lambda e: F.struct(e.alias("first"), e.alias("later")))
    grouped = scans.with_prefixes(chunks, keys, scans.matrix_affine(n), part).withColumn("start", F.struct(F.col("n_").alias("n"), F.col("before.b").alias("x"), F.col("p_").alias("p")).cast(kind))
    pairs = grouped.select(*keys, F.explode(F.arrays_zip(F.col("samples").alias("s"), fold(F.col("samples"), kind, F.col("start"), step).alias("f"))).alias("e"))
    return pairs.select(*keys, *(F.col(f"e.s.{c}").alias(c) for c in order), F.col("e.f.x").alias("x"), M.trace(F.col("e.f.p")).alias("trace"))
