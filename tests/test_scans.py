"""Parallel scans against plain recursions; matrices as columns against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from envsense.config import DEFAULT
from envsense.functions import matrix as M
from envsense.operators import filters, scans


def series(spark, n, keys=2, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(None if k == 0 else f"d{k}", i, float(np.sin(i / 9) * 3 + rng.normal()), float(rng.normal())) for k in range(keys) for i in range(n + k)], "d string, t int, v double, u double").repartition(3)


def collected(df, *columns):
    return sorted(([r[c] for c in ("d", "t", *columns)] for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        np.testing.assert_allclose(np.hstack(x[2:]), np.hstack(y[2:]), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("split", [1, 7, 1000])
def test_split_filters_equal_the_fold(spark, split):
    rows = series(spark, 60)
    for run, columns in (
        (lambda **k: filters.kalman_1d(rows, ["d"], ["t"], "v", **k), ("x_prior", "x", "p", "gain")),
        (lambda **k: filters.kalman_3d(rows.withColumn("w", F.col("v") * 2), ["d"], ["t"], ("v", "u", "w"), **k), ("x", "y", "z", "p")),
        (lambda **k: filters.kalman_adaptive(rows, ["d"], ["t"], "v", **k), ("raw", "filtered", "p", "r")),
    ):
        close(collected(run(split=split), *columns), collected(run(), *columns))


def test_elements_are_scanned_in_groups(spark):
    rows = series(spark, 60)
    chunks = scans.chunked(rows, ["d"], ["t"], {"z": F.col("v")}, 2)
    done = scans.scanned(chunks, ["d"], scans.affine(), lambda s: F.struct(F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("a"), s["z"].alias("c")), fan=3)
    got = {(r.d, r.samples[0].t): (r.before.n, r.before.c) for r in done.collect()}
    sums = {}
    for d, t, v in collected(rows, "v"):
        sums.setdefault(d, [0.0]).append(sums[d][-1] + v if d in sums else v)
    assert len(got) >= 60
    for (d, t), (n, c) in got.items():
        assert n == t and abs(c - sums[d][t]) < 1e-9


def test_one_key_of_a_million_samples(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit(1).alias("d"), F.col("id").alias("t"), (F.sin(F.col("id") / 50) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    assert scans.is_long(rows, ["d"])
    got = filters.kalman_1d(rows, ["d"], ["t"], "v")
    values = np.array([r.v for r in rows.orderBy("t").select("v").collect()])
    x, p, want = values[0], 1 + 1e-5, np.empty(n)
    want[0] = x
    for k in range(1, n):
        m = p + 1e-5
        g = m / (m + 1e-2)
        x, p = x + g * (values[k] - x), (1 - g) * m
        want[k] = x
    some = {0, 1, 4095, 4096, 4097, 499_999, n - 1} | set(range(0, n, 9973))
    have = {r.t: r.x for r in got.where(F.col("t").isin([*some])).collect()}
    assert have.keys() == some and max(abs(have[t] - want[t]) for t in some) < 1e-9
    assert got.count() == n
    assert scans.chunked(rows, ["d"], ["t"], {"z": F.col("v")}).select(F.max(F.size("samples"))).first()[0] <= scans.SPLIT


def reference(zs, f, h, q, r):
    n, m = h.shape[1], h.shape[0]
    x, p, out = np.zeros(n), np.eye(n), []
    for k, z in enumerate(zs):
        x, p = f @ x, f @ p @ f.T + q * np.eye(n)
        if k == 0:
            x = np.linalg.pinv(h) @ z
        else:
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(m))
            x, p = x + gain @ (z - h @ x), p - gain @ h @ p
        out.append([x, np.trace(p)])
    return out


@pytest.mark.parametrize("split", [None, 5])
@pytest.mark.parametrize(
    "values, f, h",
    [
        (["v"], [[1, 0.1], [0, 1]], [[1, 0]]),
        (["v", "u"], [[1, 0.1, 0.005], [0, 1, 0.1], [0, 0, 0.9]], [[1, 0, 0.5], [0, 2, 0]]),
        (["v", "u"], None, None),
    ],
)
def test_matrix_filter_against_numpy(spark, split, values, f, h):
    rows = series(spark, 40)
    got = collected(filters.matrix_kalman(rows, ["d"], ["t"], values, f, h, q=1e-3, r=0.2, split=split), "x", "trace")
    eye = np.eye(len(values))
    want, data = [], collected(rows, "v", "u")
    for d in (None, "d1"):
        zs = [np.array(r[2 : 2 + len(values)]) for r in data if r[0] == d]
        want += [[d, t, *s] for t, s in enumerate(reference(zs, eye if f is None else np.array(f), eye if h is None else np.array(h), 1e-3, 0.2))]
    close(got, sorted(want, key=lambda r: (str(r[0]), r[1])))


def test_matrices_against_numpy(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 5):
        a, b = rng.normal(size=(n, n)), rng.normal(size=(n, n))
        a[0, 0] = 0.0 if n > 1 else a[0, 0]  # needs a pivot
        row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>")
        got = row.select(M.inverse(F.col("a"), n), M.product(F.col("a"), F.col("b"), n), M.trace(F.col("a")), M.apply(F.col("a"), F.get("b", F.lit(0)))).first()
        for x, y in zip(got, (np.linalg.inv(a), a @ b, np.trace(a), a @ b[0])):
            np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


def test_empty_series(spark):
    rows = series(spark, 5).limit(0)
    assert filters.kalman_1d(rows, ["d"], ["t"], "v", split=4).count() == filters.kalman_adaptive(rows, ["d"], ["t"], "v", DEFAULT, split=4).count() == 0
    assert filters.matrix_kalman(rows, ["d"], ["t"], ["v"]).count() == 0


def test_gains_are_found_once_for_all_keys(spark, monkeypatch):
    """ekf_identity: no fold over matrices for each sample; a key goes on from one block of rows to the next."""
    rng = np.random.default_rng(2)
    n = {"a": 900, "b": 1, "c": 350, None: 40}
    given = [(d, t, *rng.normal(size=2).tolist()) for d, k in n.items() for t in range(k)]
    rows = spark.createDataFrame(rng.permutation(np.array(given, object)).tolist(), "d string, t long, v double, u double").coalesce(1)
    monkeypatch.setattr(filters, "ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    f, h = [[1, 0.1], [0, 1]], [[1, 0], [0, 2]]
    out = filters.matrix_kalman(rows, ["d"], ["t"], ["v", "u"], f, h, q=1e-3, r=0.2)
    got = {(x.d, x.t): [*x.x, x.trace] for x in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(given)
    for d, k in n.items():
        for t, (x, trace) in enumerate(reference([np.array(r[2:]) for r in given if r[0] == d], np.array(f), np.array(h), 1e-3, 0.2)):
            np.testing.assert_allclose(got[d, t], [*x, trace], rtol=1e-9, atol=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan
    # Without noise and with two equal measurements there is no gain: null from the second sample on, as before.
    same = filters.matrix_kalman(rows.where("d = 'c'"), ["d"], ["t"], ["v", "u"], [[1]], [[1], [1]], q=0.0, r=0.0).orderBy("t").collect()
    assert same[0].x is not None and all(x.x is None and x.trace is None for x in same[1:])
