"""Importances, attributions and learning curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, Window, functions as F

from venuekit.operators.ranking import row_hash

PERMUTE_BUCKET_ROWS = 100_000


def feature_importances(df: DataFrame, model, names: Sequence[str]) -> DataFrame:
    """Importance per feature of a fitted tree model, largest first."""
    fitted = model.stages[-1] if isinstance(model, PipelineModel) else model
    rows = [(n, float(v)) for n, v in zip(names, fitted.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def linear_attributions(df: DataFrame, key: str, coefficients: dict[str, float | Column],
                        background: DataFrame | None = None) -> DataFrame:
    """Exact SHAP values of a linear model: ``coefficient * (x - mean(x))`` per row and feature."""
    names = list(coefficients)
    source = df if background is None else background
    means = source.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    cells = [
        F.struct(F.lit(c).alias("feature"), (coefficients[c] * (F.col(c) - F.col(f"_m.{c}"))).alias("attribution"))
        for c in names
    ]
    return df.withColumn("_m", means).select(key, F.inline(F.array(*cells)))


def least_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of a one-feature regression in one aggregation."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def permute_column(df: DataFrame, column: str, key: Sequence[str], buckets: int) -> DataFrame:
    """Replace a column by the value of the next row in hash order, wrapping around in each bucket."""
    shuffled = row_hash(*key, F.lit(column))
    rows = df.withColumn("_h", shuffled).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(buckets)))
    order = Window.partitionBy("_b").orderBy("_h")
    first = F.first(column).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.lead(F.lit(1)).over(order).isNull()
    moved = F.when(last, first).otherwise(F.lead(column).over(order))
    return rows.withColumn(column, moved).drop("_h", "_b")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], key: Sequence[str],
                           scoring: Evaluator) -> DataFrame:
    """Drop of the score when one column is permuted; for any fitted pipeline."""
    buckets = max(1, -(-df.count() // PERMUTE_BUCKET_ROWS))
    base = scoring.evaluate(model.transform(df))
    rows = []
    for c in columns:
        score = scoring.evaluate(model.transform(permute_column(df, c, key, buckets)))
        rows.append((c, float(base - score) if scoring.isLargerBetter() else float(score - base)))
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def learning_curve(estimator: Estimator, train: DataFrame, key: Sequence[str], scoring: Evaluator, fold: str,
                   folds: int, fractions: Sequence[float]) -> DataFrame:
    """Train and validation score per train fraction and fold; fractions are nested hash thresholds.

    The hash is salted, because the test rows were already cut off by the plain one.
    """
    share = F.conv(F.substring(row_hash(*key, F.lit("learning-curve")), 1, 15), 16, 10).cast("double") / float(16**15)
    marked = train.withColumn("_share", share)
    rows = []
    for fraction in fractions:
        for i in range(folds):
            used = marked.filter((F.col(fold) != i) & (F.col("_share") <= fraction))
            model = estimator.fit(used)
            held = marked.filter(F.col(fold) == i)
            rows.append((float(fraction), i, used.count(), float(scoring.evaluate(model.transform(used))),
                         float(scoring.evaluate(model.transform(held)))))
    schema = "fraction double, fold int, n_train long, train_score double, valid_score double"
    return train.sparkSession.createDataFrame(rows, schema)


def curve_means(curve: DataFrame) -> DataFrame:
    return curve.groupBy("fraction").agg(
        F.avg("n_train").alias("n_train"), F.avg("train_score").alias("train_score"),
        F.avg("valid_score").alias("valid_score"),
    )
