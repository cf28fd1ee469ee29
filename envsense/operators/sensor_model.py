"""A classifier of sensor feature vectors: a perceptron of three hidden layers, trained where the rows are.

Features are those of ``features.sensor_features``. Training is distributed: the prepared rows are kept once, as blocks of
numbers in the shared folder, and each round adds up the gradients that tasks find for all of their blocks with numpy (quasi-Newton
rounds over all rows, in doubles, as ``pyspark.ml`` takes them). Initial weights and the model are those of ``pyspark.ml``. The
values of the last hidden layer are a row's embedding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

#: Features of a row, hidden layers (the last one's values are the embedding), rounds of training, share of rows that are held out.
NUMBERS = ("mag_mean", "mag_std", "mag_max", "mag_min", "accel_mean", "gyro_mean", "last_yaw", "audio_peak_max", "humanoid_any", "bluetooth_mean")
HIDDEN, ROUNDS, HELD_OUT = (128, 64, 64), 60, 0.2
#: Rows of a block, earlier steps that a round knows, share of the loss that ends the training, tries for the length of a step.
BLOCK, MEMORY, LEAST_GAIN, TRIES = 4096, 10, 1e-6, 30


def held_out(key: Column, share: float = HELD_OUT) -> Column:
    """Whether a row is held out, by a hash of its key: the same rows in every run."""
    return F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)


def numbers(rows: DataFrame, names: tuple[str, ...] = NUMBERS) -> DataFrame:
    """The features as doubles; what is null or NaN is left to the imputer."""
    return rows.withColumns({n: F.col(n).cast("double") for n in names})


def fit(rows: DataFrame, label: str, names: tuple[str, ...] = NUMBERS, hidden: tuple[int, ...] = HIDDEN, rounds: int = ROUNDS, seed: int = 7) -> PipelineModel:
    """Trained on all rows with a label: means fill gaps, features are scaled to deviation 1, labels are numbered by frequency."""
    given = cut(numbers(rows.where(F.col(label).isNotNull()), names).select(*names, label))
    filled = [f"{n}_filled" for n in names]
    labels = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="frequencyDesc").fit(given)
    stages = [Imputer(inputCols=[*names], outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="vector", withMean=True)]
    prepared = Pipeline(stages=[labels, *stages]).fit(given)
    sizes = [len(names), *hidden, len(labels.labels)]
    net = MultilayerPerceptronClassifier(layers=sizes, labelCol="label_index", featuresCol="vector", predictionCol="predicted_index", probabilityCol="probability_vector", rawPredictionCol="raw_prediction", maxIter=0, seed=seed, blockSize=128)
    ready = prepared.transform(given)
    one = ready.limit(1)
    weights = minimised(_loss(_blocks(ready), sizes), net.fit(one).weights.toArray(), rounds)
    return PipelineModel(stages=[*prepared.stages, net.setInitialWeights(Vectors.dense(weights)).fit(one)])


def _blocks(ready: DataFrame) -> DataFrame:
    """x, y: the scaled features and the labels' indexes of up to ``BLOCK`` rows, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column(1), "<i4")
            parts = range(0, batch.num_rows, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(a[k : k + BLOCK]).tobytes() for k in parts], pa.binary()) for a in (x, y)], names=["x", "y"])

    made = ready.select(vector_to_array("vector").alias("x"), F.col("label_index").cast("int").alias("y")).mapInArrow(run, "x binary, y binary")
    return cut(made.repartition(4 * made.sparkSession.sparkContext.defaultParallelism))


def _layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each layer the matrix by columns, then what is added."""
    parts, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:]):
        parts.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return parts


def _through(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The rows, and the values of each layer for them."""
    out = [x]
    for w, b in layers:
        a = out[-1] @ w
        a += b
        np.exp(np.negative(a, out=a), out=a)
        a += 1
        out.append(np.reciprocal(a, out=a))
    return out


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """The sum over rows of the cross-entropy, and its slopes by the weights."""
    layers = _layers(weights, sizes)
    values = _through(x, layers[:-1])
    z = values[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    at = np.arange(len(y))
    own = z[at, y].sum()
    total = np.exp(z, out=z).sum(axis=1, keepdims=True)
    loss = float(np.log(total).sum() - own)
    z /= total
    z[at, y] -= 1
    slopes = []
    for k in range(len(layers) - 1, -1, -1):
        slopes += [z.sum(axis=0), (values[k].T @ z).ravel()]
        if k:
            z = z @ layers[k][0].T
            z *= values[k]
            z *= np.subtract(1, values[k], out=values[k])
    return loss, np.concatenate(slopes[::-1])


def _loss(blocks: DataFrame, sizes: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Weights to the mean loss of all rows and its slopes: a task adds up those of its blocks."""

    def of(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, slopes = 0, 0.0, np.zeros(weights.size)
            for batch in batches:
                for x, y in zip(batch.column(0), batch.column(1)):
                    labels = np.frombuffer(y.as_buffer(), "<i4")
                    more, by = gradient(np.frombuffer(x.as_buffer()).reshape(len(labels), sizes[0]), labels, weights, sizes)
                    n, loss, slopes = n + len(labels), loss + more, slopes + by
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([slopes.tobytes()], pa.binary())], names=["n", "loss", "slopes"])

        parts = blocks.mapInArrow(run, "n long, loss double, slopes binary").collect()
        n = sum(p.n for p in parts)
        return sum(p.loss for p in parts) / n, sum(np.frombuffer(p.slopes) for p in parts) / n

    return of


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int) -> np.ndarray:
    """Quasi-Newton rounds (limited memory) from x; steps are halved or doubled until they meet the Wolfe conditions."""
    (f, g), steps, seen = loss(x), [], []
    for _ in range(rounds):
        seen.append(f)
        if np.linalg.norm(g) <= max(LEAST_GAIN * abs(f), 1e-8) or len(seen) > 20 and max(seen[-20:]) - f <= LEAST_GAIN * abs(seen[0]):
            break
        d, shares = -g, []
        for s, y in reversed(steps):
            shares.append(s @ d / (s @ y))
            d = d - shares[-1] * y
        if steps:
            d = d * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), share in zip(steps, reversed(shares)):
            d = d + (share - y @ d / (s @ y)) * s
        slope, low, high, t = g @ d, 0.0, np.inf, 1.0 if steps else 1 / np.linalg.norm(g)
        for _ in range(TRIES):
            f_new, g_new = loss(x + t * d)
            if not f_new <= f + 1e-4 * t * slope:
                high = t
            elif g_new @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * t
        else:
            break  # no step is left that lowers the loss
        steps = [*steps, (t * d, g_new - g)][-MEMORY:]
        x, f, g = x + t * d, f_new, g_new
    return x


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame, names: tuple[str, ...] = NUMBERS) -> DataFrame:
    """The rows with ``predicted`` (a label), ``probability`` (of it) and ``embedding`` (the last hidden layer)."""
    label = model.stages[0].getInputCol()
    given = numbers(rows, names) if label in rows.columns else numbers(rows, names).withColumn(label, F.lit(None).cast("string"))
    named = F.get(F.array(*map(F.lit, classes(model))), F.col("predicted_index").cast("int"))
    out = model.transform(given).select(*rows.columns, named.alias("predicted"), F.array_max(vector_to_array("probability_vector")).alias("probability"), vector_to_array("vector").alias("embedding"))
    return _through_layers(model, out)


def _through_layers(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with their last column, an array of scaled features, taken through the hidden layers, a batch at a time."""
    net = model.stages[-1]
    sizes = net.getLayers()
    parts = _layers(net.weights.toArray(), sizes)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.asarray(batch.columns[-1].flatten()).reshape(batch.num_rows, sizes[0])
            a = _through(a, parts)[-1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, sizes[-2], dtype=np.int32)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
