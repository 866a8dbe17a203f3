"""Spark ML estimators for rating regression and classification, tuning and persistence."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
)
from pyspark.ml.evaluation import (
    Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from venuekit.session import materialize

SEED = 42


def linear_regression(label: str, **params) -> LinearRegression:
    return LinearRegression(labelCol=label, **params)


def ridge(label: str, n_rows: int, alpha: float = 1.0) -> LinearRegression:
    """L2 penalty ``alpha`` on the sum of squares; Spark averages the loss, hence ``alpha / n``."""
    return LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=alpha / n_rows, standardization=False)


def lasso(label: str, alpha: float = 1.0, max_iter: int = 2000) -> LinearRegression:
    return LinearRegression(labelCol=label, elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=max_iter)


def boosted_trees_regressor(label: str, **params) -> GBTRegressor:
    """Stands in for the usual boosting libraries; scores are comparable, not equal."""
    return GBTRegressor(labelCol=label, seed=SEED, **params)


def boosted_trees_classifier(label: str, **params) -> GBTClassifier:
    return GBTClassifier(labelCol=label, seed=SEED, **params)


def logistic_regression(label: str, max_iter: int = 1000, **params) -> LogisticRegression:
    return LogisticRegression(labelCol=label, maxIter=max_iter, **params)


def decision_tree_regressor(label: str, **params) -> DecisionTreeRegressor:
    """``minInstancesPerNode`` is the minimum leaf size; depth is at most 30."""
    return DecisionTreeRegressor(labelCol=label, seed=SEED, **params)


def decision_tree_classifier(label: str, **params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, seed=SEED, **params)


def random_forest_regressor(label: str, **params) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, seed=SEED, **params)


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array column to dense vector inside a pipeline."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(self.getInputCol()))


def fourier_waves(n_columns: int, gamma: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random features, the same for every fit."""
    rng = np.random.default_rng(SEED)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), size=(dims, n_columns)), rng.uniform(0.0, 2.0 * np.pi, size=dims)


def rbf_features(columns: Sequence[str], gamma: float, dims: int = 100, out: str = "rbf") -> list:
    """Random Fourier features (Rahimi & Recht 2007) whose dot product approximates an RBF kernel.

    One SQL expression over a constant table of waves, so the stage is saved with its pipeline.
    """
    weights, shifts = fourier_waves(len(columns), gamma, dims)
    number = lambda v: f"{float(v):.17g}D"
    waves = ", ".join(
        f"named_struct('w', array({', '.join(map(number, w))}), 'b', {number(b)})" for w, b in zip(weights, shifts)
    )
    point = ", ".join(f"cast(`{c}` as double)" for c in columns)
    inner = f"aggregate(zip_with(r.w, array({point}), (a, x) -> a * x), 0D, (s, v) -> s + v)"
    scaled = f"transform(array({waves}), r -> {number(np.sqrt(2.0 / dims))} * cos(r.b + {inner}))"
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} AS `{out}_waves` FROM __THIS__"),
        ArrayToVector(inputCol=f"{out}_waves", outputCol=out),
    ]


def support_vector_classifier(columns: Sequence[str], label: str, n_rows: int, c: float = 10.0,
                              gamma: float | None = None, dims: int = 100, weight: str | None = None) -> Pipeline:
    """Approximate RBF support-vector classification: random features and a hinge loss."""
    gamma = 1.0 / len(columns) if gamma is None else gamma
    linear = LinearSVC(labelCol=label, featuresCol="rbf", regParam=1.0 / (c * n_rows), maxIter=100)
    if weight:
        linear.setWeightCol(weight)
    return Pipeline(stages=[*rbf_features(columns, gamma, dims), linear])


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weights ``n / (classes * n_class)``, as for balanced classes; rows without a label weigh 0."""
    counts = materialize(df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")), "class-counts")
    totals = counts.agg((F.sum("_n") / F.count("*")).alias("w")).scalar()
    return df.join(counts, label, "left").withColumn(name, F.coalesce(totals / F.col("_n"), F.lit(0.0))).drop("_n")


def assembled(stage: Estimator, columns: Sequence[str], scale: bool = False) -> Pipeline:
    """Vector assembly, optional standard scaling learned inside the pipeline, then the estimator."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw_features" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, stage])


class MacroF1(Evaluator, HasLabelCol, HasPredictionCol):
    """Unweighted mean F1 over a fixed label set, for tuning."""

    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction", labels=()):
        super().__init__()
        self.labels = list(labels)
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        from venuekit.operators.metrics import class_report

        pairs = dataset.select(
            F.col(self.getLabelCol()).cast("int").alias("y"), F.col(self.getPredictionCol()).cast("int").alias("p")
        )
        return float(class_report(pairs, "y", "p", self.labels).agg(F.avg("f1")).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def evaluator(scoring: str, label: str, labels: Sequence = ()) -> Evaluator:
    """``r2``, ``rmse``, ``f1_weighted``, ``accuracy`` or ``f1_macro``."""
    if scoring in ("r2", "rmse", "mae", "mse"):
        return RegressionEvaluator(labelCol=label, metricName=scoring)
    if scoring == "f1_macro":
        return MacroF1(labelCol=label, labels=labels)
    names = {"f1_weighted": "f1", "accuracy": "accuracy"}
    return MulticlassClassificationEvaluator(labelCol=label, metricName=names[scoring])


def grid_search(estimator: Estimator, grid: list, train: DataFrame, scoring: Evaluator, fold: str, folds: int,
                parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validated grid search over given folds. Pass a materialised table: it is read many times."""
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=scoring, foldCol=fold,
                            numFolds=folds, parallelism=parallelism, seed=SEED)
    return search.fit(train)


def grid_table(spark: SparkSession, fitted: CrossValidatorModel) -> DataFrame:
    """Parameters, mean and deviation of every grid point."""
    rows = []
    for params, mean, std in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics, fitted.stdMetrics):
        named = ", ".join(sorted(f"{p.name}={v}" for p, v in params.items()))
        rows.append((named or "default", float(mean), float(std)))
    return spark.createDataFrame(rows, "params string, mean_score double, std_score double")


def cross_validated_score(estimator: Estimator, df: DataFrame, scoring: Evaluator, fold: str, folds: int) -> DataFrame:
    """Mean and population deviation of the score over the folds."""
    scores = []
    for i in range(folds):
        model = estimator.fit(df.filter(F.col(fold) != i))
        scores.append((float(scoring.evaluate(model.transform(df.filter(F.col(fold) == i)))),))
    table = df.sparkSession.createDataFrame(scores, "score double")
    return table.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def save_model(model: PipelineModel, path: str) -> PipelineModel:
    """Write the fitted pipeline and return what a reader gets back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def model_record(spark: SparkSession, name: str, n_rows: int, best: Mapping[str, object],
                 metrics: Mapping[str, float]) -> DataFrame:
    """One-row description of a trained model."""
    schema = (
        "model_name string, trained_on_date date, n_training_rows long, best_params map<string,string>, "
        "shared_test_accuracy double, shared_test_macro_f1 double, shared_test_n long"
    )
    row = (name, datetime.date.today(), n_rows, {k: str(v) for k, v in best.items()},
           float(metrics["accuracy"]), float(metrics["macro_f1"]), int(metrics["n"]))
    return spark.createDataFrame([row], schema)
