"""Buffers, clocks, schedules, the sensor model and messages: edge cases beside the rows against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from envsense.operators import clock, detect, features, fusion, sensor_model
from envsense.plans import queries as Q
from tests.conftest import SF


def test_buffer_bounded_by_time_and_number(spark):
    rows = [("d", t, k, float(v)) for k, (t, v) in enumerate([(0, 1), (1, 9), (2, 3), (10, 4), (10, 5), (15, 6)])] + [(None, 3, 0, 7.0), ("e", 1, 0, None)]
    df = spark.createDataFrame(rows, "d string, t long, k int, v double")
    got = {(r.d, r.k): (r.buffered, r.oldest, r.buffer_mean, r.buffer_max) for r in detect.sliding_buffer(df, ["d"], "t", ["t", "k"], "v", reach=5, most=2).collect()}
    # Three rows are near at t = 2: the number bounds them. A row of age 5 is out; rows of one moment see each other.
    assert got == {
        ("d", 0): (1, 0, 1.0, 1.0), ("d", 1): (2, 0, 5.0, 9.0), ("d", 2): (2, 1, 6.0, 9.0), ("d", 3): (2, 10, 4.5, 5.0), ("d", 4): (2, 10, 4.5, 5.0),
        ("d", 5): (1, 15, 6.0, 6.0), (None, 0): (1, 3, 7.0, 7.0), ("e", 0): (1, 1, None, None),
    }


def test_correlation_scores_the_current_row_alone(spark):
    rows = [("d", 0, True, False, False), ("d", 999, False, True, False), ("d", 1000, None, True, True), ("d", 1001, True, True, None)]
    df = spark.createDataFrame(rows, "d string, t long, anomaly boolean, audio_anomaly boolean, humanoid boolean")
    got = {r.t: (r.buffered, round(r.correlation_score, 6), r.is_correlated) for r in fusion.correlation_engine(df, ["d"], "t", reach=1000).collect()}
    assert got == {0: (1, 0.4, False), 999: (2, 0.4, False), 1000: (2, 0.6, True), 1001: (3, 0.8, True)}


def test_clocks_without_and_with_late_answers(spark):
    asked = spark.createDataFrame([("a", 0), ("a", 0), ("a", 100), ("a", 200), ("b", 5)], "device_id string, client_time long")
    answers = [("a", 0, 60, 4, 24), ("a", 0, 70, 4, 44), ("a", 100, 130, 0, 104), ("a", 200, 400, 0, 100), ("c", 1, 2, 0, 3)]
    given = spark.createDataFrame(answers, "device_id string, client_time long, server_time long, processing long, received_at long")
    trips = clock.round_trips(asked, given)
    assert sorted(tuple(r) for r in trips.collect()) == [("a", 0, 24, 20, 50.0), ("a", 100, 104, 4, 28.0)]
    packets = spark.createDataFrame([("a", 10, 1), ("a", 24, 2), ("a", 104, 3), ("a", 900, 4), ("b", 7, 5)], "device_id string, client_time long, side int")
    got = {r.side: (r.offset, r.server_time) for r in clock.corrected(packets, clock.best_offsets(trips)).collect()}
    assert got == {1: (0.0, 10.0), 2: (50.0, 74.0), 3: (28.0, 132.0), 4: (28.0, 928.0), 5: (0.0, 7.0)}


def test_schedule_halves_and_stops(spark):
    losses = {"flat": [1.0] * 30, "falls": [1 / (k + 1) for k in range(60)], "bad": [1.0, float("nan"), 0.5], "slow": [1 - 1e-6 * k for k in range(30)], "none": [None, 1.0]}
    df = spark.createDataFrame([(r, k, v) for r, vs in losses.items() for k, v in enumerate(vs)], "run string, k int, loss double")
    rows = {}
    for r in features.training_schedule(df, ["run"], ["k"], "loss").orderBy("epoch").collect():
        rows.setdefault(r.run, []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {"flat": 11, "falls": 50, "bad": 2, "slow": 30, "none": 1}
    assert [r.rate for r in rows["flat"]] == [1e-3] * 6 + [5e-4] * 5 and rows["flat"][-1].stopped
    # Too small a gain for the plateau is still one for stopping.
    assert [r.rate for r in rows["slow"]][-1] == 1e-3 / 2**4 and not rows["slow"][-1].stopped
    assert rows["falls"][-1].rate == 1e-3 and rows["falls"][-1].stopped


def test_sensor_model_is_judged_by_its_own_predictions(spark):
    rows = Q.labelled_features(spark, SF).persist()
    apart = sensor_model.held_out(F.col("event_id"))
    model = sensor_model.fit(rows.where(~apart), "label")
    out = sensor_model.predict(model, rows.where(apart)).select("event_id", "label", "predicted", "probability", "embedding").persist()
    frame = out.select("label", "predicted").toPandas()
    assert 100 < len(frame) < rows.count() / 3
    got = features.classification_metrics(out, "label", "predicted").first()
    n, right = duckdb.sql("SELECT count(*), count(*) FILTER (label = predicted) FROM frame").fetchall()[0]
    f1 = duckdb.sql("""SELECT avg(f) FROM (SELECT 2.0 * (SELECT count(*) FROM frame WHERE label = c AND predicted = c) / (SELECT count(*) FILTER (label = c) + count(*) FILTER (predicted = c) FROM frame) AS f
        FROM (SELECT label AS c FROM frame UNION SELECT predicted FROM frame))""").fetchall()[0][0]
    assert abs(got.accuracy - right / n) < 1e-12 and abs(got.macro_f1 - f1) < 1e-12
    assert got.accuracy > 0.9 > frame.label.value_counts(normalize=True).max() + 0.1
    # The output layer over the embedding gives the model's probabilities.
    net = model.stages[-1]
    width, classes = net.getLayers()[-2:]
    last = net.weights.toArray()[-(width * classes + classes) :]
    for r in out.limit(20).collect():
        assert len(r.embedding) == width == 64
        z = np.array(r.embedding) @ last[: width * classes].reshape(width, classes) + last[width * classes :]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p.max() - r.probability) < 1e-9 and sensor_model.classes(model)[p.argmax()] == r.predicted
    # Rows without features or a label are filled and predicted.
    gaps = rows.limit(3).drop("label").withColumns({"mag_mean": F.lit(None).cast("double"), "mag_std": F.lit(float("nan"))})
    assert sensor_model.predict(model, gaps).where("predicted is not null").count() == 3
    assert sensor_model.predict(model, rows.limit(0)).count() == 0


def test_generated_noise_of_the_one_shot_test(spark):
    rows = [detect.one_shot(spark, v, seed=s).first() for v, s in ((95.5, 1), (50.0, 1), (95.5, 1))]
    assert rows[0].anomaly and not rows[1].anomaly and rows[0] == rows[2]
    assert 45 < rows[1]["mean"] < 55 and 3 < rows[1]["std"] < 7 and rows[0]["std"] == pytest.approx(np.sqrt(rows[0]["std"] ** 2))


def test_clips_keep_columns_of_any_name(spark):
    events = spark.createDataFrame([("d", 10)], "device string, s long").select("device", F.timestamp_seconds("s").alias("ts"))
    packets = spark.createDataFrame([("d", k, k * 7) for k in range(20)], "device string, s long, _part long").select("device", F.timestamp_seconds("s").alias("ts"), "_part")
    out = fusion.event_clips(events, packets, "device", "ts", "2 SECONDS", "3 SECONDS")
    assert out.columns == ["device", "ts", "_part", "e_device", "e_ts"]
    assert sorted(r._part for r in out.collect()) == [7 * k for k in range(8, 14)]


def test_sensor_model_is_trained_from_blocks(spark):
    """sensor_model: the features are worked out once, not in each pass, and slopes are those of the loss over all rows."""
    r = np.random.default_rng(3)
    sizes, x, y = [3, 5, 4, 2], r.normal(size=(50, 3)), r.integers(0, 2, 50)
    w = r.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 2 + 2)
    loss, slopes = sensor_model.gradient(x, y, w, sizes)
    step = 1e-6 * np.eye(len(w))
    apart = [(sensor_model.gradient(x, y, w + s, sizes)[0] - sensor_model.gradient(x, y, w - s, sizes)[0]) / 2e-6 for s in step]
    np.testing.assert_allclose(slopes, apart, rtol=1e-4, atol=1e-5)
    blocks = spark.createDataFrame([(x[k : k + 16].tobytes(), y[k : k + 16].astype("<i4").tobytes()) for k in range(0, 50, 16)], "x binary, y binary").repartition(3)
    mean, by = sensor_model._loss(blocks, sizes)(w)
    assert abs(mean - loss / 50) < 1e-12 and np.abs(by - slopes / 50).max() < 1e-12
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    far = [("b" if a > 0.3 else "a" if b > 0 else "c", float(a), float(b)) for a, b, _ in np.tile(x, (4, 1))]
    rows = spark.createDataFrame([*far, ("a", None, float("nan"))], "label string, v double, u double").repartition(3).withColumn("v", counted("v"))
    model = sensor_model.fit(rows, "label", ("v", "u"), (6, 5), 40)
    assert seen.value == 201
    assert model.stages[-1].getLayers() == [2, 6, 5, 3]
    out = sensor_model.predict(model, rows.limit(200), ("v", "u")).collect()
    assert sum(r.label == r.predicted for r in out) > 180 and all(len(r.embedding) == 5 for r in out)


def test_minimum_of_a_bent_valley():
    """Quasi-Newton rounds: Rosenbrock's function from its usual start."""
    f = lambda v: ((1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2, np.array([-2 * (1 - v[0]) - 400 * v[0] * (v[1] - v[0] ** 2), 200 * (v[1] - v[0] ** 2)]))
    np.testing.assert_allclose(sensor_model.minimised(f, np.array([-1.2, 1.0]), 100), [1, 1], atol=1e-4)
    same = np.array([3.0, -2.0])
    assert sensor_model.minimised(f, same, 0) is same
