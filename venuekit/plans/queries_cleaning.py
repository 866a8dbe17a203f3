"""Registered queries: sources, parsing, projection, filters and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuekit.functions import lists as L, scalars as S, text as X
from venuekit.operators import impute as I, relational as R
from venuekit.operators.profile import category_lists, pass_rates
from venuekit.operators.ranking import exact_median
from venuekit.operators.splits import random_split
from venuekit.plans.cleaning import category_summary
from venuekit.plans.registry import (
    CLEAN, COST_SQL, NULL_SQL, RATE_SQL, REVIEW_PATTERN, REVIEW_TEXTS_SQL, VENUES, YES_SQL, clean, query,
    rounded, split_list_sql,
)
from venuekit.session import scratch_path
from venuekit.sources import readers, writers
from venuekit.session import materialize
from venuekit.sources.tables import VENUE_COLUMNS, table, venues

_MODE = "(SELECT {v} FROM {t} WHERE {v} IS NOT NULL GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1)"
_GROUP_MODE = (
    "SELECT listing, category AS mode FROM (SELECT listing, category, row_number() OVER (PARTITION BY listing "
    "ORDER BY count(*) DESC, category) AS r FROM {t} WHERE category IS NOT NULL GROUP BY listing, category) AS g WHERE r = 1"
)


@query(
    "flagship_category_summary",
    CLEAN + f""", modes AS ({_GROUP_MODE.format(t='clean')}), filled AS (
 SELECT coalesce(c.category, m.mode, 'Unknown') AS category, rate, coalesce(cost, (SELECT median(cost) FROM clean)) AS cost
 FROM clean c LEFT JOIN modes m ON c.listing = m.listing)
SELECT category, count(*) AS n_venues, round(avg(rate), 6) AS avg_rate, round(avg(cost), 6) AS avg_cost,
 round(avg(CASE WHEN rate >= 3.8 THEN 1 ELSE 0 END), 6) AS high_share FROM filled GROUP BY category""",
)
def flagship(spark, sf):
    return category_summary(venues(spark, sf))


# --- sources and sinks ---------------------------------------------------------------------

_CSV_SCHEMA = ", ".join(f"{c} {'long' if c in ('row_id', 'votes') else 'string'}" for c in VENUE_COLUMNS)
_TEXTS = [c for c in VENUE_COLUMNS if c not in ("row_id", "votes")]


@query(
    "s01_csv_scan",
    VENUES + "SELECT row_id, votes, " + ", ".join(f"{NULL_SQL(c)} AS {c}" for c in _TEXTS) + " FROM venues",
)
def s01(spark, sf):
    path = writers.write_csv(venues(spark, sf), scratch_path(spark, "csv"))
    return readers.read_csv(spark, path, _CSV_SCHEMA)


_MAP = {"venue": "name", "area": "location", "kind": "category", "price": "cost_text", "fax": "fax_number"}


@query(
    "s04_map_columns",
    VENUES + "SELECT name AS venue, location AS area, category AS kind, cost_text AS price, CAST(NULL AS VARCHAR) AS fax FROM venues",
)
def s04(spark, sf):
    raw = R.require_columns(venues(spark, sf), ["name", "location"])
    return R.map_columns(raw, _MAP)[0]


@query(
    "s05_s06_csv_sink_check",
    VENUES + "SELECT count(*) AS n_written, count(*) AS n_read, true AS matches FROM venues",
)
def s05(spark, sf):
    raw = venues(spark, sf)
    path = writers.write_csv(raw, scratch_path(spark, "csv"))
    return writers.check_sink(readers.without_placeholders(raw), readers.read_csv(spark, path, _CSV_SCHEMA))


_CATEGORIES = """SELECT 'category' AS "column", category AS value, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER)
 AS position FROM (SELECT DISTINCT category FROM clean WHERE category IS NOT NULL) AS a UNION ALL
SELECT 'listing', listing, CAST(dense_rank() OVER (ORDER BY listing) - 1 AS INTEGER)
 FROM (SELECT DISTINCT listing FROM clean) AS b"""


@query(
    "s07_category_json",
    CLEAN + """SELECT 'category' AS "column", CAST(count(DISTINCT category) AS BIGINT) AS n_values, min(category) AS first_value,
 max(category) AS last_value, min(votes) AS min_votes, max(votes) AS max_votes FROM clean UNION ALL
SELECT 'listing', count(DISTINCT listing), min(listing), max(listing), min(votes), max(votes) FROM clean""",
)
def s07(spark, sf):
    rows = clean(spark, sf)
    path = writers.write_json(category_lists(rows, ["category", "listing"]), scratch_path(spark, "categories"))
    votes = rows.agg(F.struct(F.min("votes").alias("low"), F.max("votes").alias("high"))).scalar()
    stored = spark.read.schema("column string, value string, position int").json(path)
    return stored.groupBy("column").agg(
        F.count("*").alias("n_values"), F.min("value").alias("first_value"), F.max("value").alias("last_value")
    ).withColumn("_v", votes).select(
        "column", "n_values", "first_value", "last_value", F.col("_v.low").alias("min_votes"), F.col("_v.high").alias("max_votes")
    )


@query(
    "s10_export_projection",
    CLEAN + """SELECT name, online_order, rate, votes, coalesce(location, 'Other') AS location,
 coalesce(category, 'Other') AS category, CASE WHEN rate IS NULL THEN 'Unknown' WHEN rate < 3 THEN 'Bad' WHEN rate < 4 THEN 'Good'
 ELSE 'Excellent' END AS sentiment, CASE online_order WHEN 1 THEN 'Yes' ELSE 'No' END AS online_order_label FROM clean""",
)
def s10(spark, sf):
    rows = clean(spark, sf).withColumn("sentiment", S.rating_word("rate"))
    wanted = ["name", "online_order", "rate", "sentiment", "votes", "location", "category", "not_there"]
    return writers.export_projection(rows, wanted, ["online_order"], {"location": "Other", "category": "Other"})


@query(
    "s11_reuse_or_build",
    "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source",
)
def s11(spark, sf):
    path = scratch_path(spark, "collection")
    build = lambda: table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")
    )
    readers.reuse_or_build(spark, path, build)
    return readers.reuse_or_build(spark, path, build)


# --- projections and filters ---------------------------------------------------------------


@query("p01_drop_columns", CLEAN + "SELECT row_id, name, rate, cost, votes FROM clean")
def p01(spark, sf):
    gone = ["url", "location", "category", "listing", "online_order", "book_table", "tags_text", "tags", "reviews_text", "menu_text"]
    return R.drop_columns(clean(spark, sf), gone)


@query("p02_p03_project_rename", "SELECT l_orderkey AS order_id, l_quantity AS quantity FROM lineitem")
def p02(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").withColumnsRenamed(
        {"l_orderkey": "order_id", "l_quantity": "quantity"}
    )


@query(
    "p04_filter",
    CLEAN + "SELECT row_id, name, votes FROM clean WHERE votes <> 0 AND location IS NOT NULL AND name <> ''",
)
def p04(spark, sf):
    keep = (F.col("votes") != 0) & F.col("location").isNotNull() & (F.col("name") != "")
    return clean(spark, sf).filter(keep).select("row_id", "name", "votes")


@query(
    "p05_drop_incomplete",
    CLEAN + """SELECT row_id, location, category, rate, cost FROM clean
 WHERE location IS NOT NULL AND category IS NOT NULL AND rate IS NOT NULL AND cost IS NOT NULL""",
)
def p05(spark, sf):
    return clean(spark, sf).select("row_id", "location", "category", "rate", "cost").dropna("any")


@query(
    "p06_drop_missing_subset",
    CLEAN + """SELECT count(*) AS n_kept, (SELECT count(*) FROM clean) - count(*) AS n_dropped FROM clean
 WHERE cost IS NOT NULL AND category IS NOT NULL""",
)
def p06(spark, sf):
    rows = clean(spark, sf)
    n = rows.agg(F.count("*")).scalar()
    return rows.dropna(subset=["cost", "category"]).agg(F.count("*").alias("n_kept")).withColumn(
        "n_dropped", n - F.col("n_kept")
    )


@query(
    "p07_labelled_split",
    CLEAN + """, r AS (SELECT row_id, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR))) AS i, count(*) OVER () AS n
 FROM clean WHERE rate IS NOT NULL) SELECT row_id, i <= ceil(n * 0.2) AS is_test FROM r""",
)
def p07(spark, sf):
    return random_split(R.labelled(clean(spark, sf), "rate"), 0.2, ["row_id"]).select("row_id", "is_test")


@query(
    "p08_update_where",
    CLEAN + "SELECT row_id, CASE WHEN votes = 0 THEN NULL ELSE rate END AS rate FROM clean",
)
def p08(spark, sf):
    rows = R.update_where(clean(spark, sf), F.col("votes") == 0, "rate", F.lit(None))
    return rows.select("row_id", "rate")


@query(
    "p09_complete_case_rate",
    CLEAN + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE cost IS NOT NULL AND category IS NOT NULL) AS n_complete,
 round(avg(CASE WHEN cost IS NOT NULL AND category IS NOT NULL THEN 1 ELSE 0 END), 6) AS complete_rate FROM clean""",
)
def p09(spark, sf):
    from venuekit.operators.profile import complete_case_rate

    return rounded(complete_case_rate(clean(spark, sf), R.complete_case(["cost", "category"])), "complete_rate")


@query(
    "p10_numeric_columns",
    """SELECT sum(l_orderkey)::BIGINT AS l_orderkey, sum(l_partkey)::BIGINT AS l_partkey, sum(l_suppkey)::BIGINT AS l_suppkey,
 sum(l_linenumber)::BIGINT AS l_linenumber, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
 round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem""",
)
def p10(spark, sf):
    rows = table(spark, sf, "lineitem")
    types = dict(rows.dtypes)
    total = lambda c: F.round(F.sum(c), 2) if types[c] == "double" else F.sum(c)
    return rows.agg(*[total(c).alias(c) for c in R.columns_of_type(rows, "numeric")])


@query(
    "p11_split_by_flag",
    CLEAN + """SELECT count(*) FILTER (WHERE rate IS NOT NULL) AS n_rated, count(*) FILTER (WHERE rate IS NULL) AS n_unrated,
 max(votes) FILTER (WHERE rate IS NULL) AS max_unrated_votes FROM clean""",
)
def p11(spark, sf):
    rated, unrated = R.split_by_flag(clean(spark, sf), F.col("rate").isNotNull())
    n = rated.agg(F.count("*")).scalar()
    return unrated.agg(F.count("*").alias("n_unrated"), F.max("votes").alias("max_unrated_votes")).withColumn("n_rated", n)


# --- scalar functions ----------------------------------------------------------------------


@query(
    "c01_null_tokens",
    VENUES + f"SELECT row_id, {NULL_SQL('category')} AS category, {NULL_SQL('rate_text')} AS rate_text FROM venues",
)
def c01(spark, sf):
    return venues(spark, sf).select("row_id", S.null_tokens("category").alias("category"), S.null_tokens("rate_text").alias("rate_text"))


@query(
    "c02_parse_rate",
    VENUES + f"""SELECT row_id, {RATE_SQL} AS rate, TRY_CAST(trim(regexp_replace(trim(rate_text), '/5\\s*$', '')) AS DOUBLE)
 AS rate_of_five FROM venues""",
)
def c02(spark, sf):
    return venues(spark, sf).select("row_id", S.parse_rate("rate_text").alias("rate"), S.parse_rate_of_five("rate_text").alias("rate_of_five"))


@query(
    "c03_c04_parse_cost",
    VENUES + f"SELECT row_id, {COST_SQL} AS cost, TRY_CAST(cost_text AS DOUBLE) AS plain FROM venues",
)
def c03(spark, sf):
    return venues(spark, sf).select("row_id", S.parse_cost("cost_text").alias("cost"), S.to_double("cost_text").alias("plain"))


@query(
    "c05_clean_name",
    VENUES + "SELECT row_id, trim(regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g')) AS name FROM venues",
)
def c05(spark, sf):
    return venues(spark, sf).select("row_id", S.clean_name("name").alias("name"))


@query(
    "c06_normalize_text",
    "SELECT page_id, nullif(lower(regexp_replace(trim(html, E' \\t\\n\\r\\f\\v'), '  +', ' ', 'g')), '') AS html FROM pages",
)
def c06(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.normalize_text("html", "lower").alias("html"))


@query(
    "c07_c08_c23_lists",
    VENUES + f"""SELECT row_id, nullif(array_to_string({split_list_sql('tags_text')}, ', '), '') AS tags,
 CAST(len({split_list_sql('tags_text')}) AS BIGINT) AS n_tags, list_contains({split_list_sql('tags_text')}, 'red') AS is_red FROM venues""",
)
def c07(spark, sf):
    items = L.split_list("tags_text", "lower")
    return venues(spark, sf).select(
        "row_id", L.normalize_list("tags_text", "lower").alias("tags"), F.size(items).cast("long").alias("n_tags"),
        F.array_contains(items, "red").alias("is_red"),
    )


@query(
    "c09_yes_no",
    VENUES + f"""SELECT row_id, {YES_SQL.format(c='online_order')} AS code,
 CASE WHEN {YES_SQL.format(c='online_order')} = 1 THEN 'Yes' ELSE 'No' END AS word FROM venues""",
)
def c09(spark, sf):
    return venues(spark, sf).select("row_id", S.yes_no_code("online_order").alias("code"), S.yes_no("online_order").alias("word"))


@query(
    "c10_buckets",
    CLEAN + """SELECT row_id, CASE WHEN rate IS NULL THEN 'Unknown' WHEN rate < 3 THEN 'Bad' WHEN rate < 4 THEN 'Good' ELSE 'Excellent'
 END AS word, CASE WHEN rate < 3 THEN 'Low' WHEN rate < 4 THEN 'Average' WHEN rate IS NOT NULL THEN 'High' END AS tier,
 CASE WHEN votes < 3 THEN 'low' ELSE 'normal' END AS quality FROM clean""",
)
def c10(spark, sf):
    return clean(spark, sf).select(
        "row_id", S.rating_word("rate").alias("word"), S.rating_tier("rate").alias("tier"), S.review_quality("votes").alias("quality")
    )


@query(
    "c11_binary_targets",
    CLEAN + """SELECT row_id, CASE WHEN rate >= 3.8 THEN 1 ELSE 0 END AS high,
 CASE WHEN rate > (SELECT median(rate) FROM clean) THEN 1 ELSE 0 END AS above_median FROM clean""",
)
def c11(spark, sf):
    rows = clean(spark, sf)
    median = exact_median(rows, "rate").scalar()
    return rows.select("row_id", S.high_rating("rate").alias("high"), S.high_rating("rate", median, strict=True).alias("above_median"))


@query(
    "c12_c13_c14_rounding",
    CLEAN + """SELECT row_id, CAST(round_even(rate, 0) AS INTEGER) AS rate_class, rint AS half_steps,
 CASE WHEN rate IS NOT NULL THEN least(5.0, greatest(0.0, rate * 2 - 3)) END AS clamped
 FROM (SELECT *, round_even(rate / 2 * 10, 0) / 10 AS rint FROM clean) AS c""",
)
def c12(spark, sf):
    return clean(spark, sf).select(
        "row_id", S.rate_class("rate").alias("rate_class"), S.round_even(F.col("rate") / 2, 1).alias("half_steps"),
        S.clamp(F.col("rate") * 2 - 3).alias("clamped"),
    )


@query(
    "c15_code_label",
    CLEAN + """SELECT row_id, CASE votes % 3 WHEN 0 THEN 'Low Rating (< 3.8)' WHEN 1 THEN 'High Rating (>= 3.8)'
 ELSE concat('Category ', votes % 3) END AS label FROM clean""",
)
def c15(spark, sf):
    from venuekit.operators.scoring import CLASS_LABELS

    return clean(spark, sf).select("row_id", S.code_label(F.col("votes") % 3, CLASS_LABELS).alias("label"))


@query(
    "c16_review_texts",
    CLEAN + f"SELECT row_id, array_to_string({REVIEW_TEXTS_SQL.format(c='reviews_text')}, ' | ') AS texts FROM clean",
)
def c16(spark, sf):
    return clean(spark, sf).select("row_id", F.array_join(L.review_texts("reviews_text"), " | ").alias("texts"))


@query(
    "c17_review_rating_mean",
    CLEAN + f""", r AS (SELECT row_id, list_filter(list_transform(regexp_extract_all(reviews_text, '{REVIEW_PATTERN}', 0),
 lambda x: TRY_CAST(regexp_extract(x, 'Rated\\s*(\\d+\\.?\\d*)', 1) AS DOUBLE)), lambda x: x BETWEEN 1 AND 5) AS v FROM clean)
SELECT row_id, round(list_avg(v), 6) AS rating FROM r""",
)
def c17(spark, sf):
    return clean(spark, sf).select("row_id", F.round(L.review_rating_mean("reviews_text"), 6).alias("rating"))


@query(
    "c18_string_items",
    CLEAN + """SELECT row_id, array_to_string(list_transform(regexp_extract_all(menu_text, '(''[^'']*''|"[^"]*")', 1),
 lambda x: trim(substr(x, 2, length(x) - 2))), ' | ') AS items FROM clean""",
)
def c18(spark, sf):
    return clean(spark, sf).select("row_id", F.array_join(L.string_items("menu_text"), " | ").alias("items"))


@query(
    "c22_word_counts",
    """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words,
 CAST(length(text) AS BIGINT) AS n_characters FROM documents""",
)
def c22(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.word_count("text").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_characters")
    )


@query(
    "c24_default",
    CLEAN + "SELECT row_id, coalesce(location, 'an unspecified location') AS location, coalesce(cost, -1) AS cost FROM clean",
)
def c24(spark, sf):
    return clean(spark, sf).select("row_id", S.default("location", "an unspecified location").alias("location"), S.default("cost", -1.0).alias("cost"))


# --- imputation ----------------------------------------------------------------------------


@query("i01_fill_median", CLEAN + "SELECT row_id, coalesce(cost, (SELECT median(cost) FROM clean)) AS cost FROM clean")
def i01(spark, sf):
    return I.fill_median(clean(spark, sf).select("row_id", "cost"), "cost")


@query("i02_fill_mean", CLEAN + "SELECT row_id, round(coalesce(rate, (SELECT avg(rate) FROM clean)), 6) AS rate FROM clean")
def i02(spark, sf):
    return rounded(I.fill_mean(clean(spark, sf).select("row_id", "rate"), "rate"), "rate")


@query(
    "i03_fill_mode",
    CLEAN + f"SELECT row_id, coalesce(category, {_MODE.format(v='category', t='clean')}) AS category FROM clean",
)
def i03(spark, sf):
    return I.fill_mode(clean(spark, sf).select("row_id", "category"), "category")


@query(
    "i04_fill_group_mode",
    CLEAN + f""", modes AS ({_GROUP_MODE.format(t='clean')})
SELECT row_id, c.listing, coalesce(category, mode, 'Unknown') AS category FROM clean c LEFT JOIN modes m ON c.listing = m.listing""",
)
def i04(spark, sf):
    return I.fill_group_mode(clean(spark, sf).select("row_id", "listing", "category"), "category", "listing")


@query(
    "i05_fill_cascade",
    CLEAN + f""", r AS (SELECT row_id, coalesce(rate, list_avg(list_filter(list_transform(regexp_extract_all(reviews_text,
 '{REVIEW_PATTERN}', 0), lambda x: TRY_CAST(regexp_extract(x, 'Rated\\s*(\\d+\\.?\\d*)', 1) AS DOUBLE)),
 lambda x: x BETWEEN 1 AND 5))) AS rate FROM clean)
SELECT row_id, round_even(coalesce(rate, (SELECT avg(rate) FROM r)) * 10, 0) / 10 AS rate FROM r""",
)
def i05(spark, sf):
    rows = clean(spark, sf).select("row_id", "rate", "reviews_text")
    return I.fill_cascade(rows, "rate", L.review_rating_mean("reviews_text")).drop("reviews_text")


@query(
    "i06_fill_constants",
    CLEAN + "SELECT row_id, coalesce(category, 'Unknown') AS category, coalesce(location, 'Other') AS location, coalesce(cost, 0) AS cost FROM clean",
)
def i06(spark, sf):
    rows = clean(spark, sf).select("row_id", "category", "location", "cost")
    return I.fill_constants(rows, {"category": "Unknown", "location": "Other", "cost": 0.0})


@query(
    "i07_fitted_imputers",
    CLEAN + f""", r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR))) > ceil((count(*) OVER ()) * 0.2) AS is_train
 FROM clean), train AS (SELECT * FROM r WHERE is_train)
SELECT row_id, coalesce(cost, (SELECT median(cost) FROM train)) AS cost,
 coalesce(category, {_MODE.format(v='category', t='train')}) AS category FROM r""",
)
def i07(spark, sf):
    rows = materialize(random_split(clean(spark, sf).select("row_id", "cost", "category"), 0.2, ["row_id"]), "split")
    return I.impute_fitted(rows, rows.filter(~F.col("is_test")), ["cost"], ["category"]).drop("is_test")


@query(
    "a23_pass_rates",
    CLEAN + """SELECT round(avg(CASE WHEN rate >= 3.8 THEN 1 WHEN rate IS NOT NULL THEN 0 END) * 100, 6) AS high_rate,
 round(avg(online_order) * 100, 6) AS online_rate FROM clean""",
)
def a23(spark, sf):
    flags = clean(spark, sf).select((F.col("rate") >= 3.8).alias("high"), (F.col("online_order") == 1).alias("online"))
    return rounded(pass_rates(flags, ["high", "online"]), "high_rate", "online_rate")


