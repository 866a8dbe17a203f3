"""Registered queries: encoders, scalers, splits, metrics and neighbour models."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuekit.functions import lists as L, scalars as S
from venuekit.functions.constants import RATING_TIERS
from venuekit.operators import features as E, metrics as M, splits as T
from venuekit.operators.explain import least_squares, linear_attributions
from venuekit.operators.neighbors import knn_classify
from venuekit.operators.relational import complete_case
from venuekit.operators.scoring import bounded_rating, class_name
from venuekit.plans.registry import CLEAN, REVIEW_PATTERN, clean, query, rounded
from venuekit.sources.tables import table

TIERS = RATING_TIERS[1]
_H = "md5(CAST({c} AS VARCHAR))"

# --- encoders ------------------------------------------------------------------------------


@query(
    "f01_label_codes",
    CLEAN + """SELECT row_id, CAST(dense_rank() OVER (ORDER BY coalesce(category, 'nan')) - 1 AS INTEGER) AS category_code,
 CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS name_code FROM clean""",
)
def f01(spark, sf):
    rows = clean(spark, sf).select("row_id", "category", "name")
    coded = E.encode_labels(rows, E.label_codes(rows, "category"), "category")
    coded = E.encode_labels(coded, E.label_codes(rows, "name"), "name")
    return coded.select("row_id", "category_code", "name_code")


@query(
    "f02_one_hot_long",
    CLEAN + """, train AS (SELECT * FROM clean WHERE votes > 30) SELECT row_id, 'category' AS "column", category AS value FROM clean
 WHERE category IN (SELECT category FROM train) UNION ALL SELECT row_id, 'location', location FROM clean WHERE location IN (SELECT location FROM train)""",
)
def f02(spark, sf):
    rows = clean(spark, sf)
    return E.one_hot_long(rows, rows.filter("votes > 30"), "row_id", ["category", "location"])


_TAG_CODES = "SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT unnest(tags) AS tag FROM clean) AS d"


@query(
    "f03_multi_label_binarizer",
    CLEAN + f""", codes AS ({_TAG_CODES}), cells AS (SELECT row_id, list(DISTINCT code ORDER BY code) AS codes
 FROM (SELECT row_id, unnest(tags) AS tag FROM clean) AS u JOIN codes USING (tag) GROUP BY row_id)
SELECT row_id, CAST((SELECT count(*) FROM codes) AS INTEGER) AS n_labels, coalesce(codes, []) AS codes FROM clean LEFT JOIN cells USING (row_id)""",
)
def f03(spark, sf):
    """Every tag of every row as a sparse 0/1 vector over all tags."""
    rows = clean(spark, sf).select("row_id", "tags")
    size, codes, _ = E.sparse_cells("hot")
    return E.MultiLabelEncoder("tags", "hot", "row_id").fit(rows).transform(rows).select("row_id", size.alias("n_labels"), codes.alias("codes"))


@query(
    "f04_standard_scaling",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS pd
 FROM lineitem WHERE l_returnflag <> 'A') SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) AS l_quantity,
 round((l_extendedprice - pm) / pd, 6) AS l_extendedprice FROM lineitem, s""",
)
def f04(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    train = rows.filter("l_returnflag <> 'A'")
    out = E.standardize(rows.drop("l_returnflag"), train, ["l_quantity", "l_extendedprice"])
    return rounded(out, "l_quantity", "l_extendedprice")


@query(
    "f05_preprocessor",
    CLEAN + f""", tag_codes AS ({_TAG_CODES}),
 cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM clean WHERE category IS NOT NULL) AS d),
 locs AS (SELECT location, row_number() OVER (ORDER BY location) - 1 AS code FROM (SELECT DISTINCT location FROM clean WHERE location IS NOT NULL) AS d),
 n AS (SELECT (SELECT count(*) FROM cats) AS nc, (SELECT count(*) FROM locs) AS nl, (SELECT count(*) FROM tag_codes) AS nt),
 cells AS (SELECT row_id, 0 AS i, CAST(votes AS DOUBLE) AS v FROM clean UNION ALL SELECT row_id, 1, coalesce(cost, 0) FROM clean
  UNION ALL SELECT row_id, 2 + code, 1 FROM clean JOIN cats USING (category) UNION ALL SELECT row_id, 2 + nc + code, 1 FROM n, clean JOIN locs USING (location)
  UNION ALL SELECT DISTINCT row_id, 2 + nc + nl + code, 1 FROM n, (SELECT row_id, unnest(tags) AS tag FROM clean) AS u JOIN tag_codes USING (tag))
SELECT c.row_id, CAST(2 + nc + nl + nt AS INTEGER) AS width, coalesce(list(CAST(i AS INTEGER) ORDER BY i) FILTER (v <> 0), []) AS indices,
 coalesce(list(v ORDER BY i) FILTER (v <> 0), []) AS vals FROM n, clean c LEFT JOIN cells USING (row_id) GROUP BY c.row_id, nc, nl, nt""",
)
def f05(spark, sf):
    """The assembled vector of every row: numbers, two one-hot columns and all tags."""
    rows = clean(spark, sf).fillna({"cost": 0.0})
    model = E.preprocessing(["votes", "cost"], ["category", "location"], ["tags"], key="row_id").fit(rows)
    size, indices, values = E.sparse_cells("features")
    return model.transform(rows).select("row_id", size.alias("width"), indices.alias("indices"), values.alias("vals"))


@query(
    "f06_random_split",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_H.format(c='o_orderkey')}) <= ceil(count(*) OVER () * 0.3) AS is_test FROM orders""",
)
def f06(spark, sf):
    return T.random_split(table(spark, sf, "orders").select("o_orderkey"), 0.3, ["o_orderkey"])


@query(
    "f07_stratified_split",
    f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(c='o_orderkey')})
 <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders""",
)
def f07(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return T.stratified_split(rows, 0.2, "o_orderstatus", ["o_orderkey"])


@query(
    "f08_group_split",
    f"""WITH g AS (SELECT c, row_number() OVER (ORDER BY {_H.format(c='c')}) <= ceil(count(*) OVER () * 0.2) AS is_test
 FROM (SELECT DISTINCT o_custkey AS c FROM orders) AS d) SELECT o_orderkey, o_custkey, is_test FROM orders JOIN g ON c = o_custkey""",
)
def f08(spark, sf):
    return T.group_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 0.2, "o_custkey")


@query(
    "f09_group_folds",
    f"""WITH g AS (SELECT o_custkey AS c, row_number() OVER (ORDER BY count(*) DESC, {_H.format(c='o_custkey')}) - 1 AS r FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o_custkey, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM orders JOIN g ON c = o_custkey""",
)
def f09(spark, sf):
    return T.group_folds(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)


@query(
    "f10_shared_test",
    CLEAN + f""", g AS (SELECT name, row_number() OVER (ORDER BY {_H.format(c='name')}) <= ceil(count(*) OVER () * 0.2) AS is_test
 FROM (SELECT DISTINCT name FROM clean) AS d) SELECT row_id FROM clean JOIN g USING (name) WHERE is_test AND cost IS NOT NULL
 AND category IS NOT NULL""",
)
def f10(spark, sf):
    rows = T.group_split(clean(spark, sf).select("row_id", "name", "cost", "category"), 0.2, "name")
    return T.shared_test(rows, complete_case(["cost", "category"])).select("row_id")


@query(
    "f11_scoring_rows",
    CLEAN + """SELECT row_id, online_order, book_table, CAST(votes AS INTEGER) AS votes, category, coalesce(cost, 0) AS cost FROM clean""",
)
def f11(spark, sf):
    layout = {"online_order": "flag", "book_table": "flag", "votes": "int", "category": "string", "cost": "double"}
    return E.scoring_rows(clean(spark, sf), layout, ["row_id"])


# --- metrics -------------------------------------------------------------------------------

_LINES = """p AS (SELECT l_extendedprice AS y, l_quantity * (SELECT sum(l_extendedprice) / sum(l_quantity) FROM lineitem) AS p,
 l_returnflag AS split FROM lineitem)"""
_REGRESSION = """count(*) AS n, round(avg((y - p) * (y - p)), 1) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
 round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
 round(avg(abs(y - p) / abs(y)), 6) AS mape"""


def _price_pairs(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag")
    unit = rows.agg(F.sum("l_extendedprice") / F.sum("l_quantity")).scalar()
    return rows.select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * unit).alias("p"), F.col("l_returnflag").alias("split")
    )


def _round_regression(df):
    return rounded(rounded(rounded(df, "r2", "mape"), "rmse", "mae", digits=4), "mse", digits=1)


@query("m12_regression_metrics", f"WITH {_LINES} SELECT {_REGRESSION} FROM p")
def m12(spark, sf):
    return _round_regression(M.regression_metrics(_price_pairs(spark, sf), "y", "p"))


@query("m24_metrics_by_split", f"WITH {_LINES} SELECT split, {_REGRESSION} FROM p GROUP BY split")
def m24(spark, sf):
    return _round_regression(M.regression_metrics(_price_pairs(spark, sf), "y", "p", ["split"]))


def _tier(c: str) -> str:
    return f"CASE WHEN {c} < 3 THEN 'Low' WHEN {c} < 4 THEN 'Average' ELSE 'High' END"


_PAIRS = f"""rv AS (SELECT rate, list_avg(list_filter(list_transform(regexp_extract_all(reviews_text, '{REVIEW_PATTERN}', 0),
 lambda x: TRY_CAST(regexp_extract(x, 'Rated\\s*(\\d+\\.?\\d*)', 1) AS DOUBLE)), lambda x: x BETWEEN 1 AND 5)) AS review_rate FROM clean),
 pairs AS (SELECT {_tier('rate')} AS y, {_tier('review_rate')} AS p FROM rv WHERE rate IS NOT NULL AND review_rate IS NOT NULL),
 labels AS (SELECT unnest(['Low', 'Average', 'High', 'Unrated']) AS label),
 report AS (SELECT label, (SELECT count(*) FROM pairs WHERE y = label) AS support, (SELECT count(*) FROM pairs WHERE p = label) AS np,
 (SELECT count(*) FROM pairs WHERE y = label AND p = label) AS tp FROM labels),
 ratios AS (SELECT label, support, tp, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision,
 CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM report),
 full_report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ratios)"""
_LABELS = [*TIERS, "Unrated"]


def _tier_pairs(spark, sf):
    rows = clean(spark, sf).select("rate", L.review_rating_mean("reviews_text").alias("review_rate")).dropna()
    return rows.select(S.rating_tier("rate").alias("y"), S.rating_tier("review_rate").alias("p"))


@query("m13_metrics_weighted", CLEAN + f""", {_PAIRS} SELECT (SELECT count(*) FROM pairs) AS n,
 round((SELECT avg(CASE WHEN y = p THEN 1 ELSE 0 END) FROM pairs), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
 round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM full_report""")
def m13_weighted(spark, sf):
    out = M.classification_metrics(_tier_pairs(spark, sf), "y", "p", _LABELS, "weighted")
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query("m13_metrics_macro", CLEAN + f""", {_PAIRS} SELECT (SELECT count(*) FROM pairs) AS n,
 round((SELECT avg(CASE WHEN y = p THEN 1 ELSE 0 END) FROM pairs), 6) AS accuracy, round(avg(precision), 6) AS precision,
 round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM full_report""")
def m13_macro(spark, sf):
    out = M.classification_metrics(_tier_pairs(spark, sf), "y", "p", _LABELS, "macro")
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query("m13_metrics_binary", """WITH c AS (SELECT count(*) AS n, avg(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END) AS accuracy,
 count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE toxic = 0) AS np, count(*) FILTER (WHERE quality = 1) AS support
 FROM labels) SELECT n, round(accuracy, 6) AS accuracy, round(tp / np, 6) AS precision, round(tp / support, 6) AS recall,
 round(2 * tp / (np + support), 6) AS f1 FROM c""")
def m13_binary(spark, sf):
    pairs = table(spark, sf, "labels").select("quality", (1 - F.col("toxic")).alias("guess"))
    out = M.classification_metrics(pairs, "quality", "guess", [0, 1], "binary")
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query("m14_class_report", CLEAN + f""", {_PAIRS} SELECT label, support, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(f1, 6) AS f1 FROM full_report""")
def m14(spark, sf):
    report = M.class_report(_tier_pairs(spark, sf), "y", "p", _LABELS)
    return rounded(report, "precision", "recall", "f1")


@query("m15_confusion_matrix", CLEAN + f""", {_PAIRS} SELECT a.label AS actual, b.label AS predicted,
 (SELECT count(*) FROM pairs WHERE y = a.label AND p = b.label) AS n FROM labels a, labels b""")
def m15(spark, sf):
    return M.confusion_matrix(_tier_pairs(spark, sf), "y", "p", _LABELS)


@query("m16_comparison", f"WITH {_LINES}, q AS (SELECT y, 0.9 * p AS p FROM p) SELECT 'unit price' AS model, {_REGRESSION} FROM p UNION ALL SELECT 'discounted', {_REGRESSION} FROM q")
def m16(spark, sf):
    pairs = _price_pairs(spark, sf)
    lower = pairs.select("y", (0.9 * F.col("p")).alias("p"))
    results = {"unit price": M.regression_metrics(pairs, "y", "p"), "discounted": M.regression_metrics(lower, "y", "p")}
    return _round_regression(M.comparison(results, "r2"))


@query("m23_bounded_output", CLEAN + """SELECT row_id, least(5.0, greatest(0.0, votes / 10.0)) AS rating,
 CASE votes % 2 WHEN 1 THEN 'High Rating (>= 3.8)' ELSE 'Low Rating (< 3.8)' END AS label FROM clean""")
def m23(spark, sf):
    rows = clean(spark, sf).select("row_id", (F.col("votes") / 10.0).cast("double").alias("prediction"), (F.col("votes") % 2).alias("code"))
    return rows.select("row_id", bounded_rating().alias("rating"), class_name("code").alias("label"))


@query(
    "m20_linear_attributions",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem)
SELECT concat(l_orderkey, '-', l_linenumber) AS id, 'l_quantity' AS feature, round(b * (l_quantity - m), 4) AS attribution FROM lineitem, f""",
)
def m20(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_extendedprice"
    )
    slope = least_squares(rows, "l_quantity", "l_extendedprice").select("slope").scalar()
    return rounded(linear_attributions(rows, "id", {"l_quantity": slope}), "attribution", digits=4)


# --- neighbours ----------------------------------------------------------------------------


def _knn_sql(weights: str) -> str:
    vote = "count(*)" if weights == "uniform" else "sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END)"
    exact = "0" if weights == "uniform" else "count(*) FILTER (WHERE d = 0)"
    return f"""WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, row_number() OVER (ORDER BY {_H.format(c='vec_id')})
 <= ceil(count(*) OVER () * 0.2) AS is_test FROM embeddings),
 d AS (SELECT q.vec_id AS query_id, x.vec_id AS id, x.label, round(list_distance(q.e, x.e), 9) AS d FROM s q JOIN s x ON q.is_test AND NOT x.is_test),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM d),
 v AS (SELECT query_id, label, {exact} AS ex, round({vote}, 9) AS v FROM n WHERE r <= 7 GROUP BY query_id, label)
SELECT query_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ex DESC, v DESC, label) AS b FROM v) AS w WHERE b = 1"""


def _knn(spark, sf, weights):
    rows = T.random_split(table(spark, sf, "embeddings"), 0.2, ["vec_id"])
    return knn_classify(rows.filter("NOT is_test"), rows.filter("is_test"), "vec_id", "embedding", "label", 7, weights)


@query("m09_j07_knn_uniform", _knn_sql("uniform"))
def m09(spark, sf):
    return _knn(spark, sf, "uniform")


@query("m09_knn_distance", _knn_sql("distance"))
def m09_distance(spark, sf):
    return _knn(spark, sf, "distance")


