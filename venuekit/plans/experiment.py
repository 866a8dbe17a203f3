"""Imputed against complete-case neighbour models on one shared, group-aware test set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from venuekit.functions import scalars as S
from venuekit.operators.features import label_lists, label_table, standardize
from venuekit.operators.impute import impute_fitted
from venuekit.operators.metrics import classification_metrics, comparison
from venuekit.operators.neighbors import nearest, vote, vote_grid
from venuekit.operators.relational import complete_case, downsample_stratum
from venuekit.operators.splits import group_folds, group_split
from venuekit.session import materialize, scratch_path

# Neighbour counts and vote weights of the search grid.
NEIGHBOR_GRID = [3, 5, 7, 9, 11, 15]
WEIGHT_GRID = ["uniform", "distance"]
FOLDS = 5
NUMERIC = ["votes", "cost"]
CATEGORICAL = ["online_order", "book_table", "category", "listing"]
LISTS = ["tags", "kinds"]
CLUSTER = ["category", "listing"]  # rows that agree here are searched first
TARGETS = ["rate_class", "rate_tier"]


def population(clean: DataFrame) -> DataFrame:
    """Rated rows with a tag list, zero-vote rows thinned to a tenth, with both targets and a test flag.

    The second list of a row, ``kinds``, holds the family of its listing and its category.
    """
    # stored, because the cuts below read it several times
    rows = materialize(clean.select("row_id", "name", *NUMERIC, *CATEGORICAL, "tags", "rate").filter(F.size("tags") > 0), "listed")
    thinned = downsample_stratum(rows, F.col("votes") == 0, 0.10, ["row_id"]).filter(F.col("rate").isNotNull())
    kinds = F.array_compact(F.array(F.substring("listing", 1, 7), F.lower("category")))
    targets = thinned.withColumns({"rate_class": S.rate_class("rate"), "rate_tier": S.rating_tier("rate"), "kinds": kinds})
    split = group_split(targets, 0.2, "name").withColumn("is_complete", complete_case(NUMERIC + CATEGORICAL))
    return split.select("row_id", "name", *NUMERIC, *CATEGORICAL, *LISTS, *TARGETS, "is_test", "is_complete")


def _labels() -> Column:
    """All indicators of a row as one list: ``column=value`` of categories and of list elements."""
    single = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in CATEGORICAL]
    lists = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{c}="), v)) for c in LISTS]  # noqa: B023
    return F.concat(F.array_compact(F.array(*single)), *[F.array_compact(x) for x in lists])


def fitted_features(rows: DataFrame, fits: Sequence[Column], imputed: bool) -> DataFrame:
    """All rows once per condition of ``fits`` (its place in ``part``): ``features``, the scaled numbers, and ``ones``, the
    positions of the indicators that are one. Fills, scaling and indicators of a part are learned only on the rows where
    its condition holds; values those rows do not have give no indicator."""
    if imputed:
        filled = impute_fitted(rows, fits, NUMERIC, CATEGORICAL, part="part")
    else:
        filled = rows.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(len(fits))])))
    filled = filled.withColumn("_labels", _labels())
    known = filled.filter(F.array(*fits)[F.col("part")])
    codes = label_table(known, "_labels", scratch_path(rows.sparkSession, "indicators"), by="part")
    scaled = standardize(filled, known, NUMERIC, by="part")
    numbers = F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("double") for c in NUMERIC])
    kept = [c for c in rows.columns if c not in [*LISTS, *NUMERIC, "name"]]
    coded = label_lists(scaled.withColumn("features", numbers), "row_id", "_labels", codes, [*kept, "part", "features"], by="part")
    return materialize(coded.withColumnRenamed("codes", "ones"), "features")


def tune(train: DataFrame, target: str, labels: Sequence, imputed: bool) -> DataFrame:
    """Macro-F1 of every (k, weights) over the group folds; everything is fitted anew on the other folds.

    One neighbour search with the largest ``k`` serves all folds, where a row meets those of the other folds, and the
    whole grid, since the nearest 3 of 15 are the nearest 3.
    """
    ready = fitted_features(train, [F.col("fold") != i for i in range(FOLDS)], imputed)
    held, rest = ready.filter(F.col("fold") == F.col("part")), ready.filter(F.col("fold") != F.col("part"))
    found = nearest(held, rest, "row_id", "features", "row_id", "features", max(NEIGHBOR_GRID), payload=[target], cluster=CLUSTER,
                    ones="ones", by="part")
    votes = vote_grid(found.withColumnRenamed(target, "voted"), "voted", NEIGHBOR_GRID, WEIGHT_GRID)
    truth = train.select(F.col("row_id").alias("query_id"), F.col(target).alias("actual"), "fold")
    judged = materialize(votes.join(truth, "query_id"), "votes")
    pairs = judged.select("actual", "fold", F.explode("votes").alias("v")).select("actual", "fold", "v.*")
    per_fold = classification_metrics(pairs, "actual", "prediction", labels, "macro", by=["k", "weights", "fold"])
    return per_fold.groupBy("k", "weights").agg(F.avg("f1").alias("mean_f1"))


def best_setting(grid: DataFrame) -> tuple[int, str, float]:
    row = grid.orderBy(F.desc(F.round("mean_f1", 9)), "k", F.desc("weights")).first()
    return row["k"], row["weights"], row["mean_f1"]


def compare_variants(clean: DataFrame, target: str, labels: Sequence) -> DataFrame:
    """Both variants tuned on their own train rows and scored on the shared complete test rows.

    The imputed variant is also scored on the whole test set (``imputed_full_test``: broader, not to be ranked against
    the others). A row records a variant's setting, its score in the search and its number of train rows.
    """
    data = materialize(population(clean), "population")
    results = {}
    for name in ("imputed", "complete"):
        imputed = name == "imputed"
        rows = data if imputed else data.filter("is_complete")
        train = materialize(group_folds(rows.filter(~F.col("is_test")), "name", FOLDS), "folds")
        k, weights, score = best_setting(tune(train, target, labels, imputed))
        ready = fitted_features(rows, [~F.col("is_test")], imputed)
        fit_rows = ready.filter(~F.col("is_test"))
        test = ready.filter("is_test") if imputed else ready.filter("is_test AND is_complete")
        found = nearest(test, fit_rows, "row_id", "features", "row_id", "features", k, payload=[target], cluster=CLUSTER, ones="ones")
        truth = test.select(F.col("row_id").alias("query_id"), F.col(target).alias("actual"), "is_complete")
        pairs = materialize(vote(found, target, weights).join(truth, "query_id"), "votes")
        record = {"k": F.lit(k), "weights": F.lit(weights), "search_f1": F.lit(score), "n_train": F.lit(train.count())}
        for table, rows_of in ((name, pairs.filter("is_complete")), (f"{name}_full_test", pairs)):
            if imputed or table == name:
                results[table] = classification_metrics(rows_of, "actual", "prediction", labels, "macro").withColumns(record)
    return comparison(results, "f1")
