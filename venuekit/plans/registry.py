"""Named queries over the given tables, each with an equivalent SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from venuekit.functions.constants import MISSING_TOKENS
from venuekit.plans.cleaning import clean_venues
from venuekit.session import spread
from venuekit.sources.tables import VENUES_CTE, table, venues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_venues(venues(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table, spread over the cores when it comes in few splits."""
    return spread(table(spark, sf_dir, "documents"))


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as reviews: a source in a language plays the venue."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("name"), F.col("lang").alias("location"), "text"
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bigints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _null(c: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
    return f"CASE WHEN trim({c}) NOT IN ({tokens}) THEN {c} END"


def split_list_sql(c: str) -> str:
    items = f"list_transform(string_split({c}, ','), lambda x: lower(trim(x)))"
    return f"coalesce(list_filter({items}, lambda x: x <> ''), CAST([] AS VARCHAR[]))"


NULL_SQL = _null
RATE_SQL = "TRY_CAST(trim(split_part(rate_text, '/', 1)) AS DOUBLE)"
COST_SQL = "TRY_CAST(replace(trim(cost_text), ',', '') AS DOUBLE)"
YES_SQL = "CASE WHEN lower(trim({c})) IN ('yes', '1', 'true') THEN 1 ELSE 0 END"
VENUES = f"WITH {VENUES_CTE} "
CLEAN_CTE = f"""clean AS (SELECT row_id, trim(regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g')) AS name,
 {_null('location')} AS location, {_null('category')} AS category, listing, {RATE_SQL} AS rate, {COST_SQL} AS cost,
 {YES_SQL.format(c='online_order')} AS online_order, {YES_SQL.format(c='book_table')} AS book_table, votes, tags_text,
 {split_list_sql('tags_text')} AS tags, reviews_text, menu_text FROM (SELECT DISTINCT * FROM venues) AS d)"""
CLEAN = f"WITH {VENUES_CTE}, {CLEAN_CTE}"
REVIEW_PATTERN = r"""\((?:''[^'']*''|"[^"]*"), (''[^'']*''|"[^"]*")\)"""
_TEXT = "replace(substr(x, 2, length(x) - 2), concat(chr(92), 'n'), chr(10))"
REVIEW_TEXTS_SQL = (
    "list_filter(list_transform(regexp_extract_all({c}, '" + REVIEW_PATTERN + "', 1), "
    "lambda x: trim(regexp_replace(" + _TEXT + ", '^RATED\\s*', '', 'i'))), lambda x: x <> '')"
)
REVIEW_CTES = f"""review_lists AS (SELECT row_id, name, location, {REVIEW_TEXTS_SQL.format(c='reviews_text')} AS texts FROM clean),
 reviews AS (SELECT concat(row_id, '-', i - 1) AS review_id, row_id, name, location, texts[i] AS text
 FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM review_lists) AS u)"""
