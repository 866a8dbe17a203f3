"""Support-vector regression with the epsilon-insensitive loss, solved in the primal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from venuekit.operators.models import fourier_waves
from venuekit.session import materialize

SMOOTHING = (1.0, 0.2, 0.04, 0.008, 0.001)  # widths of the loss's bend, as shares of the label's deviation
STEPS = (0.5, 0.25, 0.1, 0.03, 0.01)  # tried where a whole step is too long
NEWTON_STEPS = 10  # at each width
TOLERANCE = 1e-5


def bent_loss(excess: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of ``max(0, excess)`` with its bend rounded over ``width``."""
    bend = (excess > 0) & (excess <= width)
    loss = np.where(bend, excess**2 / (2 * width), np.where(excess > width, excess - width / 2, 0.0))
    return loss, np.where(bend, excess / width, (excess > width).astype(float)), np.where(bend, 1 / width, 0.0)


def fourier_features(x: np.ndarray, waves: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Random Fourier features and a column of ones."""
    out = np.ones((len(x), len(shifts) + 1))
    np.cos(x @ waves.T + shifts, out=out[:, :-1])
    out[:, :-1] *= np.sqrt(2.0 / len(shifts))
    return out


class FourierRegressionModel(Model, HasInputCols, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Linear model over random Fourier features, scored in batches; a row with a missing value has no prediction."""

    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "weight of each feature, the intercept last", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, predictionCol="prediction", gamma=None, weights=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, weights = self.getInputCols(), np.array(self.getOrDefault(self.weights))
        waves, shifts = fourier_waves(len(names), self.getOrDefault(self.gamma), len(weights) - 1)

        @F.pandas_udf(DoubleType())
        def predict(points: pd.DataFrame) -> pd.Series:
            return pd.Series(fourier_features(points.to_numpy(dtype=float), waves, shifts) @ weights)

        known = F.lit(True)
        for c in names:
            known = known & F.col(c).isNotNull()
        # numbers side by side: an array a row would be unpacked one by one
        point = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)])
        return dataset.withColumn(self.getPredictionCol(), F.when(known, predict(point)))


class EpsilonInsensitiveRegression(Estimator):
    """Minimises ``|w|^2 / 2 + C * sum(max(0, |y - w z(x) - b| - epsilon))`` over random Fourier features ``z``.

    Newton's method on a loss whose bend gets narrower; the last width changes the objective by at most
    ``C * width / 2`` per row. A pass over the rows sums loss, gradient and curvature per task, so what is shuffled and
    returned is of the size ``dims^2``. The fitted pipeline can be saved.
    """

    def __init__(self, columns: Sequence[str], label: str, c: float = 10.0, gamma: float | None = None, epsilon: float = 0.1,
                 dims: int = 100, prediction: str = "prediction"):
        super().__init__()
        self.columns, self.label, self.c, self.epsilon = list(columns), label, c, epsilon
        self.gamma = 1.0 / len(self.columns) if gamma is None else gamma
        self.dims, self.prediction = dims, prediction
        self.objective = None

    def copy(self, extra=None) -> EpsilonInsensitiveRegression:
        return EpsilonInsensitiveRegression(self.columns, self.label, self.c, self.gamma, self.epsilon, self.dims, self.prediction)

    def _rows(self, df: DataFrame) -> DataFrame:
        point = F.array(*[F.col(c).cast("double") for c in self.columns])
        usable = F.col(self.label).isNotNull()
        for c in self.columns:
            usable = usable & F.col(c).isNotNull()
        return materialize(df.filter(usable).select(point.alias("x"), F.col(self.label).cast("double").alias("y")), "svr-rows")

    def _sums(self, rows: DataFrame, models: list[np.ndarray], width: float) -> np.ndarray:
        """Loss, gradient and curvature at one model, or only the losses of several."""
        waves, shifts = fourier_waves(len(self.columns), self.gamma, self.dims)
        epsilon = self.epsilon

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for frame in frames:
                if frame.empty:
                    continue
                z = fourier_features(np.stack(frame["x"].to_numpy()), waves, shifts)
                y = frame["y"].to_numpy()
                if len(models) > 1:
                    part = np.array([bent_loss(np.abs(y - z @ m) - epsilon, width)[0].sum() for m in models])
                else:
                    residual = y - z @ models[0]
                    loss, slope, curve = bent_loss(np.abs(residual) - epsilon, width)
                    gradient = -(z * (slope * np.sign(residual))[:, None]).sum(0)
                    part = np.concatenate([[loss.sum()], gradient, ((z * curve[:, None]).T @ z).ravel()])
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

        sums = rows.mapInPandas(scan, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        found = sums.toPandas().sort_values("place")  # a number per cell of the model, squared
        return found["value"].to_numpy()

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        rows = self._rows(dataset)
        spread = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).first()
        if not spread["n"]:
            raise ValueError("no rows to fit")
        size = self.dims + 1
        model = np.zeros(size)
        model[-1] = spread["mean"]
        ridge = np.append(np.ones(self.dims), 0.0)  # the intercept is free

        def objective(m: np.ndarray, loss: float) -> float:
            return float((ridge * m) @ m / 2 + self.c * loss)

        for share in SMOOTHING:
            width = share * max(spread["std"], 1e-9)
            sums = self._sums(rows, [model], width)
            now = objective(model, sums[0])
            for _ in range(NEWTON_STEPS):
                curve = np.diag(ridge) + self.c * sums[size + 1 :].reshape(size, size)
                curve[-1, -1] += 1e-6 * self.c * spread["n"] / width
                step = -np.linalg.solve(curve, ridge * model + self.c * sums[1 : size + 1])
                trial = model + step
                after = self._sums(rows, [trial], width)
                if objective(trial, after[0]) >= now:  # too long: the best of shorter steps
                    trials = [model + t * step for t in STEPS]
                    values = [objective(m, loss) for m, loss in zip(trials, self._sums(rows, trials, width))]
                    if min(values) >= now:
                        break
                    trial = trials[int(np.argmin(values))]
                    after = self._sums(rows, [trial], width)
                before, model, sums = now, trial, after
                now = objective(model, sums[0])
                if before - now < TOLERANCE * abs(before):
                    break
        self.objective = objective(model, self._sums(rows, [model], 1e-12)[0])
        fitted = FourierRegressionModel(inputCols=self.columns, predictionCol=self.prediction, gamma=self.gamma, weights=[float(v) for v in model])
        return PipelineModel([fitted])
