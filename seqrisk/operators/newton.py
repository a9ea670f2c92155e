"""Wide logistic regression by Newton's steps: in memory where a task can hold the training table, else one pass over its rows a step."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# These functions travel to the executors by value, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS, TOLERANCE = 100, 1e-10


def _sums(z: np.ndarray, y: np.ndarray, s: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of some rows, its falling slope and its curve."""
    raw = z @ beta
    p = 1 / (1 + np.exp(-raw))
    return float(s @ (np.logaddexp(0.0, raw) - y * raw)), z.T @ (s * (y - p)), (z.T * (s * p * (1 - p))) @ z


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), (x - mean) * scale])


def _scale(mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    flat = deviation <= 1e-12 * (1 + np.abs(mean))
    return np.where(flat, 0.0, 1 / np.where(flat, 1.0, deviation))


def _descend(at: Callable[[np.ndarray], tuple], mean: np.ndarray, scale: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """Intercept and factors on the original scale of the least ½‖w‖² + c · loss, intercept free; ``at`` gives ``_sums`` of all rows.

    Steps are halved until the objective does not grow.
    """
    ridge = np.ones(len(mean) + 1)
    ridge[0] = 0.0
    beta = np.zeros(len(ridge))

    def objective(beta: np.ndarray, loss: float) -> float:
        return 0.5 * float(ridge @ beta**2) + c * loss

    loss, slope, curve = at(beta)
    now = objective(beta, loss)
    for _ in range(STEPS):
        step = np.linalg.solve(c * curve + np.diag(np.maximum(ridge, 1e-12)), c * slope - ridge * beta)
        size = 1.0
        loss, slope, curve = at(beta + size * step)
        while size > 1e-6 and objective(beta + size * step, loss) > now + 1e-12 * abs(now):
            size /= 2
            loss, slope, curve = at(beta + size * step)
        beta, before = beta + size * step, now
        now = objective(beta, loss)
        if np.abs(size * step).max() < TOLERANCE or (before - now <= 1e-15 * abs(now) and np.abs(step).max() < 1e-7):
            break
    else:
        raise ValueError("a logistic regression did not come to rest")
    factors = beta[1:] * scale
    return float(beta[0] - factors @ mean), factors


def solve(x: np.ndarray, y: np.ndarray, s: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """Intercept and factors on the original scale of ½‖w‖² + c Σ s·loss over standardised columns, intercept free."""
    mean = x.mean(axis=0)
    scale = _scale(mean, x.std(axis=0))
    z = _standard(x, mean, scale)
    return _descend(lambda beta: _sums(z, y, s, beta), mean, scale, c)


def spread_logistic(train: DataFrame, column: str, use: Sequence[int], fill: Sequence[float], c: float, weight: Column) -> tuple[float, np.ndarray]:
    """``solve`` over rows in many tasks: a step is one pass, and what comes back is one row of sums."""
    use, fill, width = list(use), np.array(fill, float), len(use)
    rows = train.select(F.col("y_true").cast("double"), weight.cast("double").alias("_weight"), column)

    def added(make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)[:, use]
                total = total + make(batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.where(np.isnan(x), fill, x))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    total = total + np.frombuffer(part)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = rows.mapInArrow(run, "sums binary").repartition(1).mapInArrow(whole, "sums binary").first()
        if found is None:
            raise ValueError("No training rows")
        return np.frombuffer(found["sums"])

    n, positive, *total = added(lambda y, s, x: np.array([len(y), y.sum(), *x.sum(axis=0)]))
    if positive in (0, n):
        raise ValueError("The training rows have one class only")
    mean = np.array(total) / n
    scale = _scale(mean, np.sqrt(added(lambda y, s, x: ((x - mean) ** 2).sum(axis=0)) / n))

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def make(y: np.ndarray, s: np.ndarray, x: np.ndarray) -> np.ndarray:
            loss, slope, curve = _sums(_standard(x, mean, scale), y, s, beta)
            return np.concatenate([[loss], slope, curve.ravel()])

        sums = added(make)
        return float(sums[0]), sums[1 : width + 2], sums[width + 2 :].reshape(width + 1, width + 1)

    return _descend(at, mean, scale, c)


def fit_logistic(train: DataFrame, column: str, use: Sequence[int], fill: Sequence[float], c: float, weight: Column) -> tuple[float, np.ndarray]:
    """``solve`` in one task over ``train`` (y_true and an array), on some places of the array, missing numbers filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, s, x = [], [], []
        for batch in batches:
            y.append(batch.column(0).to_numpy())
            s.append(batch.column(1).to_numpy())
            own = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)[:, list(use)]
            x.append(np.where(np.isnan(own), np.array(fill), own))
        if y:
            y = np.concatenate(y)
            if len(np.unique(y)) < 2:
                raise ValueError("The training rows have one class only")
            start, factors = solve(np.concatenate(x), y, np.concatenate(s), c)
            yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([factors.tolist()])], ["start", "factors"])

    rows = train.select(F.col("y_true").cast("double"), weight.cast("double").alias("_weight"), column).coalesce(1)
    found = rows.mapInArrow(run, "start double, factors array<double>").first()
    if found is None:
        raise ValueError("No training rows")
    return found["start"], np.array(found["factors"])
