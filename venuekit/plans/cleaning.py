"""Raw listing rows to a typed, de-duplicated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from venuekit.functions import lists as L, scalars as S
from venuekit.operators.impute import fill_group_mode, fill_median


def clean_venues(raw: DataFrame) -> DataFrame:
    """Parse every column once; duplicates are dropped before parsing, on the raw bytes."""
    return raw.dropDuplicates().select(
        "row_id",
        S.clean_name("name").alias("name"),
        S.null_tokens("location").alias("location"),
        S.null_tokens("category").alias("category"),
        "listing",
        S.parse_rate("rate_text").alias("rate"),
        S.parse_cost("cost_text").alias("cost"),
        S.yes_no_code("online_order").alias("online_order"),
        S.yes_no_code("book_table").alias("book_table"),
        "votes",
        "tags_text",
        L.split_list("tags_text", "lower").alias("tags"),
        "reviews_text",
        "menu_text",
    )


def category_summary(raw: DataFrame) -> DataFrame:
    """Average rating, median cost and share of high ratings per category, after cleaning."""
    clean = clean_venues(raw).select("category", "listing", "rate", "cost")
    filled = fill_median(fill_group_mode(clean, "category", "listing"), "cost")
    return filled.groupBy("category").agg(
        F.count("*").alias("n_venues"),
        F.round(F.avg("rate"), 6).alias("avg_rate"),
        F.round(F.avg("cost"), 6).alias("avg_cost"),
        F.round(F.avg(S.high_rating("rate")), 6).alias("high_share"),
    )
