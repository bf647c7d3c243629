"""Kernel features, support vector regression from Spark's linear learners, and classification without stored features."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators.prep import SEED

FOURIER_SIZE = 128
EPSILON = 0.1
ROUNDS = 25
NEAREST = 1e-3
# Kernel features of a table (rows x features) that are kept for Spark's learner; beyond, they are made anew in every pass.
KEPT_CELLS = 50_000_000
# Widths over which the corner of the hinge is rounded, one after the other; passes, and the share of the loss that ends a width.
CORNERS, PASSES, SMALL, FAILURES = (2.0, 0.5, 0.1, 0.02), 80, 1e-3, 8
# Rows that are expanded at once.
EXPANDED_ROWS = 20_000


def kernel_scale(vectors: DataFrame) -> float:
    """gamma = 1 / (features x variance over all entries)."""
    row = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")
                         ).select("s.*").first()
    mean, variance, n = row["mean"].toArray(), row["variance"].toArray(), row["count"]
    overall = (variance * (n - 1) / max(n, 1) + mean ** 2).mean() - mean.mean() ** 2
    return 1.0 / (len(mean) * overall) if overall > 0 else 1.0


class FourierFeatures:
    """Random Fourier features: inner products approximate the RBF kernel."""

    def __init__(self, inputs: int, gamma: float, size: int = FOURIER_SIZE, seed: int = SEED):
        self.inputs, self.gamma, self.size, self.seed = inputs, gamma, size, seed

    def to_dict(self) -> dict:
        return {"inputs": self.inputs, "gamma": self.gamma, "size": self.size, "seed": self.seed}

    def drawn(self):
        """The function of a matrix of rows."""
        draw = np.random.default_rng(self.seed)
        weights = draw.normal(0.0, np.sqrt(2 * self.gamma), (self.inputs, self.size))
        shift = draw.uniform(0.0, 2 * np.pi, self.size)
        factor = np.sqrt(2.0 / self.size)
        return lambda rows: factor * np.cos(rows @ weights + shift)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `expanded`."""
        expand = self.drawn()

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            if not len(v):
                return v
            return pd.Series(list(expand(np.vstack(v.to_numpy()))))

        return df.withColumn("expanded", array_to_vector(project(vector_to_array("features"))))


def fit_svr(vectors: DataFrame, c: float = 1.0, epsilon: float = EPSILON, rounds: int = ROUNDS):
    """Epsilon-insensitive regression by iteratively reweighted least squares.

    Each round is one weighted ridge fit on the cluster: rows outside the tube pull with
    weight C / distance towards its edge, rows inside do not pull.
    """
    model = LinearRegression(solver="normal", regParam=0.0, standardization=False).fit(vectors)
    best, lowest = model, None
    for _ in range(rounds):
        scored = model.transform(vectors).select("features", "label", "prediction")
        error = F.col("label") - F.col("prediction")
        beyond = F.abs(error) - F.lit(epsilon)
        weight = F.when(beyond > 0, F.lit(float(c)) / F.greatest(beyond, F.lit(NEAREST))).otherwise(0.0)
        pulled = scored.select("features", weight.alias("weight"), beyond.alias("beyond"),
                               (F.col("label") - F.signum(error) * F.lit(epsilon)).alias("label"))
        own = F.col("weight") * F.col("label")
        totals = pulled.agg(F.sum("weight").alias("w"), F.sum(own).alias("wy"), F.sum(own * F.col("label")).alias("wyy"),
                            F.sum(F.greatest("beyond", F.lit(0.0))).alias("loss")).first()
        objective = 0.5 * float(np.dot(model.coefficients, model.coefficients)) + c * totals["loss"]
        if lowest is not None and objective > lowest * (1 - 1e-6):
            if objective < lowest:
                best = model
            break
        best, lowest = model, objective
        if not totals["w"]:
            break
        # Spark's solver divides the penalty by the weighted deviation of the label.
        deviation = max(0.0, totals["wyy"] / totals["w"] - (totals["wy"] / totals["w"]) ** 2) ** 0.5
        if not deviation:
            break
        model = LinearRegression(solver="normal", regParam=deviation / totals["w"], standardization=False,
                                 weightCol="weight").fit(pulled.where("weight > 0"))
    # Labels that hardly leave the tube are fitted best by a constant.
    flat = LinearRegression(solver="normal", regParam=1e12, standardization=False).fit(vectors)
    return min((best, flat), key=lambda m: svr_objective(m, vectors, c, epsilon))


def svr_objective(model, vectors: DataFrame, c: float = 1.0, epsilon: float = EPSILON) -> float:
    """Half the squared coefficient norm plus C times the summed tube violations."""
    error = F.abs(F.col("label") - F.col("prediction")) - F.lit(epsilon)
    loss = model.transform(vectors).agg(F.sum(F.greatest(error, F.lit(0.0)))).first()[0]
    return 0.5 * float(np.dot(model.coefficients, model.coefficients)) + c * loss


@dataclass
class SvcModel:
    """Hyperplanes over kernel features, one against the rest for each class, or a single one for two classes."""
    expand: FourierFeatures
    weights: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction` from `features`."""
        expand, weights = self.expand.drawn(), self.weights

        @F.arrow_udf("double")
        def classes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                far = _design(expand, _matrix(vectors)) @ weights.T
                yield pa.array((far[:, 0] > 0 if len(weights) == 1 else far.argmax(axis=1)).astype(np.float64))

        return df.withColumn("prediction", classes(vector_to_array("features")))

    def save(self, path: str) -> None:
        meta = json.dumps({"expand": self.expand.to_dict(), "weights": self.weights.tolist()})
        SparkSession.getActiveSession().createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> "SvcModel":
        meta = json.loads(SparkSession.getActiveSession().read.text(path).first()[0])
        return SvcModel(FourierFeatures(**meta["expand"]), np.array(meta["weights"]))


def _matrix(vectors) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _design(expand, rows: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), expand(rows)]) if len(rows) else np.zeros((0, 1))


@dataclass
class _Hyperplane:
    """A class on its way: the accepted point, the step tried from it, the step's damping and the width of the hinge's corner."""
    point: np.ndarray
    trial: np.ndarray
    corner: int = 0
    loss: float = np.inf
    damping: float = 1e-6
    failures: int = 0
    slope: np.ndarray | None = None
    curve: np.ndarray | None = None
    done: bool = False

    def take(self, rows: float, loss: float, gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> None:
        """Goes on from the trial if it lowered the loss, else damps the step; a step that promises little sharpens the corner."""
        penalty = np.r_[0.0, np.full(len(gradient) - 1, ridge)]
        loss = loss / rows + 0.5 * (penalty * self.trial * self.trial).sum()
        if loss > self.loss and self.failures < FAILURES:
            self.failures, self.damping = self.failures + 1, self.damping * 10
        else:
            worse = loss > self.loss  # no damping helped: the point stays
            if not worse:
                self.slope, self.curve = gradient / rows + penalty * self.trial, hessian / rows + np.diag(penalty)
                self.point, self.loss = self.trial, loss
                self.damping = max(self.damping / 10, 1e-9)
            self.failures = 0
            if worse or 0.5 * self.slope @ self._step() <= SMALL * max(loss, 1e-300):
                self.corner, self.loss, self.trial = self.corner + 1, np.inf, self.point
                self.done = self.corner == len(CORNERS)
                return
        self.trial = self.point - self._step()

    def _step(self) -> np.ndarray:
        return np.linalg.solve(self.curve + np.diag(np.full(len(self.slope), self.damping)), self.slope)


def fit_svc(vectors: DataFrame, expand: FourierFeatures, c: float, rows: int, classes: int) -> SvcModel:
    """Mean hinge loss with ridge 1 / (C n), not on the intercept, over kernel features that are made anew in every pass.

    The hinge's corner is rounded over a width that shrinks, and all classes take their Newton steps in the same
    passes. A class that is not at its optimum after PASSES passes is reported and used as it is.
    """
    single, make = classes <= 2, expand.drawn()
    size = expand.size + 1
    planes = [_Hyperplane(np.zeros(size), np.zeros(size)) for _ in range(1 if single else classes)]
    table = vectors.select(vector_to_array("features").alias("x"), "label")
    table = table.coalesce(4 * table.sparkSession.sparkContext.defaultParallelism)
    for _ in range(PASSES):
        tried = [(i, p.trial, CORNERS[p.corner]) for i, p in enumerate(planes) if not p.done]
        if not tried:
            break

        def sums(batches, tried=tried):
            totals = {i: np.zeros(1 + size + size * size) for i, _, _ in tried}
            for batch in batches:
                for start in range(0, batch.num_rows, EXPANDED_ROWS):
                    part = batch.slice(start, EXPANDED_ROWS)
                    z, label = _design(make, _matrix(part.column("x"))), part.column("label").to_numpy()
                    for i, trial, width in tried:
                        sign = np.where(label == (1 if single else i), 1.0, -1.0)
                        short = 1 - sign * (z @ trial)
                        total, inside = totals[i], np.clip(short, 0.0, width)
                        total[0] += (inside * (short - inside / 2)).sum() / width
                        total[1:1 + size] -= (sign * inside / width) @ z
                        close = z[(short > 0) & (short <= width)]
                        total[1 + size:] += (close.T @ close / width).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["plane", "sums"])

        got = {i: np.zeros(1 + size + size * size) for i, _, _ in tried}
        for row in table.mapInArrow(sums, "plane long, sums binary").collect():
            got[row["plane"]] += np.frombuffer(row["sums"])
        for i, total in got.items():
            planes[i].take(rows, total[0], total[1:1 + size], total[1 + size:].reshape(size, size), 1 / (c * rows))
    left = sum(not p.done for p in planes)
    if left:
        warnings.warn(f"{left} of {len(planes)} support vector fits did not reach their optimum in {PASSES} passes", stacklevel=2)
    return SvcModel(expand, np.array([p.point for p in planes]))
