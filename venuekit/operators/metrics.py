"""Regression and classification metrics from one pass over (label, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def regression_metrics(pairs: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2 and MAPE.

    The total sum of squares comes from the population variance, which Spark merges
    between tasks in a numerically stable way.
    """
    y, p = F.col(label), F.col(prediction)
    rows = pairs.filter(y.isNotNull() & p.isNotNull())
    floor = F.lit(2.220446049250313e-16)
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("_var"),
        F.avg(F.abs(y - p) / F.greatest(F.abs(y), floor)).alias("mape"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var"))
    return agg.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mape")


def confusion_counts(pairs: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by, F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(pairs: DataFrame, label: str, prediction: str, labels: Sequence) -> DataFrame:
    """Counts for every pair of the fixed label set, zero filled."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], ["actual", "predicted"])
    counts = confusion_counts(pairs, label, prediction)
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_report(pairs: DataFrame, label: str, prediction: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label of the fixed set; a zero division gives 0.

    The confusion counts are tiny after the map-side aggregation; one row per label and
    side is derived from them.
    """
    counts = confusion_counts(pairs, label, prediction, by)
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.lit(True).alias("is_actual")),
                F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_actual")),
            )
        ).alias("_s"),
        "actual",
        "predicted",
        "n",
    ).select(*by, "_s.label", "_s.is_actual", "actual", "predicted", "n")
    hit = F.col("is_actual") & (F.col("actual") == F.col("predicted"))
    found = sides.filter(F.col("label").isin(*labels)).groupBy(*by, "label").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("is_actual"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_actual"), F.col("n")).otherwise(0)).alias("n_predicted"),
    )
    if by:
        strata = counts.select(*by).distinct()
        grid = strata.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    else:
        grid = pairs.sparkSession.createDataFrame([(v,) for v in labels], ["label"])
    filled = grid.join(found, [*by, "label"], "left").fillna(0, ["tp", "support", "n_predicted"])
    precision, recall = _ratio(F.col("tp"), F.col("n_predicted")), _ratio(F.col("tp"), F.col("support"))
    return filled.select(
        *by, "label", "support", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), "tp",
    )


def classification_metrics(pairs: DataFrame, label: str, prediction: str, labels: Sequence, average: str,
                           by: Sequence[str] = (), positive=1) -> DataFrame:
    """Accuracy, precision, recall and F1; ``average`` is ``binary``, ``weighted`` or ``macro``."""
    report = class_report(pairs, label, prediction, labels, by)
    accuracy = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy")
    )
    names = ["precision", "recall", "f1"]
    if average == "binary":
        mean = {m: F.max(F.when(F.col("label") == positive, F.col(m))) for m in names}
    elif average == "weighted":
        mean = {m: F.sum(F.col(m) * F.col("support")) / F.sum("support") for m in names}
    else:
        mean = {m: F.avg(m) for m in names}
    means = report.groupBy(*by).agg(*[expr.alias(m) for m, expr in mean.items()])
    if by:
        return accuracy.join(means, list(by))
    one = means.select(F.struct(*names).alias("_m")).scalar()
    return accuracy.withColumn("_m", one).select("n", "accuracy", *[F.col(f"_m.{m}").alias(m) for m in names])


def comparison(results: dict[str, DataFrame], order: str, descending: bool = True) -> DataFrame:
    """Metric rows of several models in one sorted table."""
    tables = [df.select(F.lit(name).alias("model"), *df.columns) for name, df in results.items()]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out.orderBy(F.desc(order) if descending else F.asc(order), "model")
