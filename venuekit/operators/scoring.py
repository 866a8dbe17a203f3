"""Batch scoring of new or unrated rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from venuekit.functions import scalars as S

# Class meaning and its output labels.
CLASS_LABELS = {1: "High Rating (>= 3.8)", 0: "Low Rating (< 3.8)"}


def score(model: PipelineModel, rows: DataFrame, *keep: str) -> DataFrame:
    return model.transform(rows).select(*keep, "prediction")


def bounded_rating(c: str = "prediction"):
    """Prediction clamped to the rating scale."""
    return S.clamp(c, 0.0, 5.0)


def class_name(c: str = "prediction"):
    return S.code_label(c, CLASS_LABELS)


def prediction_summary(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return scored.agg(
        F.count("*").alias("n"), F.min(prediction).alias("min_prediction"),
        F.max(prediction).alias("max_prediction"), F.avg(prediction).alias("mean_prediction"),
    )


def actual_vs_predicted(model: PipelineModel, df: DataFrame, key: str, label: str) -> DataFrame:
    return model.transform(df).select(key, F.col(label).alias("actual"), F.col("prediction").alias("predicted"))
