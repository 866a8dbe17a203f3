"""Registered queries: fitted models, tuning and explanations (no SQL counterpart)."""

from __future__ import annotations

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from venuekit.functions import lists as L, scalars as S
from venuekit.functions.constants import RATING_CLASSES, RATING_TIERS
from venuekit.operators import boosting as G, explain as X, features as E, kernel_shap as K, metrics as M, models as B
from venuekit.operators import scoring as P, splits as T, trees as R
from venuekit.operators.impute import fill_cascade, fill_median
from venuekit.operators.support_vectors import EpsilonInsensitiveRegression
from venuekit.plans.experiment import compare_variants
from venuekit.plans.registry import clean, query
from venuekit.session import materialize, scratch_path

FEATURES = ["online_order", "book_table", "location_code", "votes", "cost"]
FOLDS = 5


def split_first(rows: DataFrame) -> DataFrame:
    """Coded and imputed rows with a test flag; everything that is learned is learned on the train rows.

    Train rows without a rating get an imputed one. Test rows without one are left out: they could only be compared with
    the imputation itself. Locations that no train row has are coded -1.
    """
    flagged = materialize(T.random_split(rows, 0.2, ["row_id"]), "split")
    train = flagged.filter("NOT is_test")
    rated = flagged.filter("NOT is_test OR rate IS NOT NULL")
    filled = fill_cascade(rated, "rate", L.review_rating_mean("reviews_text"), fit_on=train).drop("reviews_text")
    costed = fill_median(filled, "cost", train)
    return E.encode_labels(costed, E.label_codes(train, "location"), "location")


def training_table(spark: SparkSession, sf: str) -> DataFrame:
    """The split rows with both targets and folds; written once for the many fits."""
    rows = clean(spark, sf).select("row_id", "location", "online_order", "book_table", "votes", "cost", "rate", "reviews_text")
    targets = split_first(rows).withColumn("high", S.high_rating("rate"))
    return materialize(T.row_folds(targets, ["row_id"], FOLDS), "training")


def _split(data: DataFrame):
    return data.filter("NOT is_test"), data.filter("is_test")


def _regression(spark, sf, make):
    """Fit on train, regression metrics of both sides."""
    train, _ = _split(data := training_table(spark, sf))
    model = make(train)
    return M.regression_metrics(model.transform(data), "rate", "prediction", ["is_test"])


def _one_hot(stage):
    def fit(train):
        from pyspark.ml import Pipeline

        prep = E.preprocessing(["online_order", "book_table", "votes", "cost"], ["location"])
        return Pipeline(stages=[prep, stage(train)]).fit(train)

    return fit


@query("m01_linear_regression")
def m01(spark, sf):
    return _regression(spark, sf, _one_hot(lambda t: B.linear_regression("rate")))


@query("m02_ridge")
def m02(spark, sf):
    return _regression(spark, sf, _one_hot(lambda t: B.ridge("rate", t.count())))


@query("m03_lasso")
def m03(spark, sf):
    return _regression(spark, sf, _one_hot(lambda t: B.lasso("rate", alpha=0.01)))


def _boosted(train, label, loss, **params):
    return G.fit_boosted_trees(train, FEATURES, label, ["row_id"], loss=loss, max_depth=3, **params)


@query("m04_boosted_trees")
def m04(spark, sf):
    """A hundred rounds of histogram boosting, each tree on eight rows of ten."""
    return _regression(spark, sf, lambda t: _boosted(t, "rate", "squared", row_share=0.8))


def _classes(spark, sf, make):
    train, _ = _split(data := training_table(spark, sf))
    pairs = make(train).transform(data).select("is_test", "high", F.col("prediction").cast("int").alias("prediction"))
    return M.classification_metrics(pairs, "high", "prediction", [0, 1], "weighted", by=["is_test"])


@query("m04_boosted_trees_classifier")
def m04_classes(spark, sf):
    return _classes(spark, sf, lambda t: _boosted(t, "high", "logistic", column_share=0.8))


@query("m05_logistic_regression")
def m05(spark, sf):
    return _classes(spark, sf, lambda t: B.assembled(B.logistic_regression("high"), FEATURES, scale=True).fit(t))


@query("m06_decision_tree")
def m06(spark, sf):
    return _regression(spark, sf, lambda t: B.assembled(B.decision_tree_regressor("rate", maxDepth=7, minInstancesPerNode=5), FEATURES).fit(t))


@query("m06_decision_tree_classifier")
def m06_classes(spark, sf):
    return _classes(spark, sf, lambda t: B.assembled(B.decision_tree_classifier("high", maxDepth=5), FEATURES).fit(t))


@query("m07_random_forest")
def m07(spark, sf):
    forest = lambda: B.random_forest_regressor("rate", numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt")
    return _regression(spark, sf, lambda t: B.assembled(forest(), FEATURES).fit(t))


def _scaled(train: DataFrame, data: DataFrame) -> DataFrame:
    return E.standardize(data.withColumns({c: F.col(c).cast("double") for c in FEATURES}), train, FEATURES)


@query("m08_support_vector_regression")
def m08(spark, sf):
    train, _ = _split(data := training_table(spark, sf))
    rows = _scaled(train, data)
    model = EpsilonInsensitiveRegression(FEATURES, "rate").fit(rows.filter("NOT is_test"))
    return M.regression_metrics(model.transform(rows), "rate", "prediction", ["is_test"])


@query("m08_support_vector_classification")
def m08_classes(spark, sf):
    train, _ = _split(data := training_table(spark, sf))
    rows = _scaled(train, data)
    fit_rows = B.balanced_weights(rows.filter("NOT is_test"), "high")
    model = B.support_vector_classifier(FEATURES, "high", fit_rows.count(), weight="weight").fit(fit_rows)
    pairs = model.transform(rows).select("is_test", "high", F.col("prediction").cast("int").alias("prediction"))
    return M.classification_metrics(pairs, "high", "prediction", [0, 1], "weighted", by=["is_test"])


@query("m10_grid_search")
def m10(spark, sf):
    train, _ = _split(training_table(spark, sf))
    tree = B.decision_tree_regressor("rate")
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [3, 5, 7]).addGrid(tree.minInstancesPerNode, [1, 5]).build()
    fitted = B.grid_search(B.assembled(tree, FEATURES), grid, train, B.evaluator("r2", "rate"), "fold", FOLDS)
    return B.grid_table(spark, fitted)


@query("m10_grid_search_macro_f1")
def m10_macro(spark, sf):
    train, _ = _split(training_table(spark, sf))
    tree = B.decision_tree_classifier("high")
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [3, 5]).build()
    fitted = B.grid_search(B.assembled(tree, FEATURES), grid, train, B.evaluator("f1_macro", "high", [0, 1]), "fold", FOLDS)
    return B.grid_table(spark, fitted)


@query("m11_cross_validated_score")
def m11(spark, sf):
    train, _ = _split(training_table(spark, sf))
    model = B.assembled(B.decision_tree_regressor("rate"), FEATURES)
    return B.cross_validated_score(model, train, B.evaluator("r2", "rate"), "fold", FOLDS)


@query("m17_score_unrated")
def m17(spark, sf):
    """Rows without a rating, scored by a forest trained on the rated ones."""
    rows = clean(spark, sf).withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    rated = rows.filter(F.col("rate").isNotNull())
    codes = E.label_codes(rated, "location")
    ready = materialize(E.encode_labels(rows, codes, "location").select("row_id", "rate", *FEATURES), "scoring")
    model = B.assembled(B.random_forest_regressor("rate", numTrees=100), FEATURES).fit(ready.filter("rate IS NOT NULL"))
    scored = P.score(model, ready.filter("rate IS NULL"), "row_id")
    return P.prediction_summary(scored.withColumn("prediction", P.bounded_rating()))


@query("m18_m22_reload_and_predict")
def m18(spark, sf):
    """Actual and predicted ratings by a reloaded model, and whether it agrees with the one in memory."""
    train, test = _split(training_table(spark, sf))
    model = B.assembled(B.decision_tree_regressor("rate"), FEATURES).fit(train)
    again = B.save_model(model, scratch_path(spark, "model"))
    pairs = P.actual_vs_predicted(model, test, "row_id", "rate")
    other = P.actual_vs_predicted(again, test, "row_id", "rate").withColumnRenamed("predicted", "reloaded").drop("actual")
    return pairs.join(other, "row_id").withColumn("same", F.col("predicted") == F.col("reloaded")).drop("reloaded")


@query("m19_feature_importances")
def m19(spark, sf):
    train, _ = _split(training_table(spark, sf))
    model = B.assembled(B.random_forest_regressor("rate", numTrees=100), FEATURES).fit(train)
    return X.feature_importances(train, model, FEATURES)


@query("m20_permutation_importance")
def m20(spark, sf):
    train, test = _split(training_table(spark, sf))
    model = B.assembled(B.decision_tree_regressor("rate"), FEATURES).fit(train)
    return X.permutation_importance(model, test, FEATURES, ["row_id"], B.evaluator("r2", "rate"))


@query("m20_tree_attributions")
def m20_trees(spark, sf):
    """Attributions of a tree for every test row; they add up to ``prediction - base``."""
    train, test = _split(training_table(spark, sf))
    model = B.assembled(B.decision_tree_regressor("rate", maxDepth=7, minInstancesPerNode=5), FEATURES).fit(train)
    trees = R.fitted_trees(train, model)
    found = R.tree_attributions(test, "row_id", trees, FEATURES)
    scored = P.score(model, test, "row_id").withColumn("base", F.lit(R.base_value(trees)))
    return found.join(scored, "row_id")


@query("m20_forest_attributions")
def m20_forest(spark, sf):
    """Mean absolute attribution per feature of a forest, over all test rows."""
    train, test = _split(training_table(spark, sf))
    model = B.assembled(B.random_forest_regressor("rate", numTrees=100), FEATURES).fit(train)
    return R.mean_attributions(R.tree_attributions(test, "row_id", R.fitted_trees(train, model), FEATURES))


@query("m20_boosted_attributions")
def m20_boosted(spark, sf):
    """Mean absolute attribution per feature of the boosted margin of a high rating, over all test rows."""
    train, test = _split(training_table(spark, sf))
    trees = _boosted(train, "high", "logistic", rounds=30).weighted_trees()
    return R.mean_attributions(R.tree_attributions(test, "row_id", trees, FEATURES))


@query("m20_kernel_attributions")
def m20_kernel(spark, sf):
    """Attributions of the support-vector model for every test row, from all 32 coalitions and a stated background."""
    train, _ = _split(data := training_table(spark, sf))
    rows = materialize(_scaled(train, data), "scaled")
    fit_rows = rows.filter("NOT is_test")
    model = EpsilonInsensitiveRegression(FEATURES, "rate").fit(fit_rows)
    return K.kernel_attributions(rows.filter("is_test"), "row_id", FEATURES, model.transform, fit_rows)


@query("m21_learning_curve")
def m21(spark, sf):
    train, _ = _split(training_table(spark, sf))
    model = B.assembled(B.decision_tree_regressor("rate"), FEATURES)
    fractions = [i / 10 for i in range(1, 11)]
    curve = X.learning_curve(model, train, ["row_id"], B.evaluator("r2", "rate"), "fold", FOLDS, fractions)
    return X.curve_means(curve)


@query("m25_variant_comparison")
def m25(spark, sf):
    return compare_variants(clean(spark, sf), "rate_tier", RATING_TIERS[1])


@query("m25_variant_comparison_classes")
def m25_classes(spark, sf):
    return compare_variants(clean(spark, sf), "rate_class", RATING_CLASSES)


@query("s08_s09_model_record")
def s09(spark, sf):
    train, test = _split(training_table(spark, sf))
    model = B.assembled(B.logistic_regression("high"), FEATURES, scale=True).fit(train)
    pairs = model.transform(test).select("high", F.col("prediction").cast("int").alias("prediction"))
    found = M.classification_metrics(pairs, "high", "prediction", [0, 1], "macro").first()
    metrics = {"accuracy": found["accuracy"], "macro_f1": found["f1"], "n": found["n"]}
    record = B.model_record(spark, "logistic_high_rating", train.count(), {"maxIter": 1000}, metrics)
    path = scratch_path(spark, "model_record")
    record.write.json(path)
    return spark.read.schema(record.schema).json(path)


