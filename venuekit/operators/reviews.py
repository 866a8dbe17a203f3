"""Review lists to one row per review, and per-venue roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from venuekit.functions import constants as K, lists as L, scalars as S, text as X
from venuekit.operators.ranking import row_hash, top_k

VENUE_KEY = ("name", "location")


def explode_reviews(df: DataFrame, column: str, keys: Sequence[str], row_key: str) -> DataFrame:
    """One row per non-empty review text with a unique ``review_id``."""
    texts = df.select(row_key, *keys, F.posexplode(L.review_texts(column)).alias("_pos", "text"))
    review_id = F.concat_ws("-", row_key, "_pos").alias("review_id")
    return texts.filter(F.col("text") != "").select(review_id, *keys, "text")


def explode_keywords(df: DataFrame, column: str, keep: Sequence[str], name: str = "keyword") -> DataFrame:
    """One row per item of a comma list, parent columns kept."""
    return df.select(*keep, F.explode(L.split_list(column)).alias(name))


def within_budget(reviews: DataFrame, keys: Sequence[str], review_id: str, text: str,
                  budget: int = K.REVIEW_WORD_BUDGET) -> DataFrame:
    """Reviews of a group in pseudo-random order with their running word total, up to the budget.

    Texts without a word are left out, so only the first ``budget`` texts of a group can
    count. They are found by the salted cut, which keeps a hot group out of any single
    task before the running sum is taken.
    """
    rows = reviews.select(*keys, review_id, text, X.word_count(text).alias("_w"))
    rows = rows.filter(F.col("_w") > 0).withColumn("_h", row_hash(review_id))
    first = top_k(rows, keys, [F.col("_h"), F.col(review_id)], budget, salt=[review_id])
    running = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = first.withColumn("words_so_far", F.sum("_w").over(running))
    return totals.filter(F.col("words_so_far") <= budget).drop("_w", "_h")


def budgeted_text(reviews: DataFrame, keys: Sequence[str], review_id: str, text: str,
                  budget: int = K.REVIEW_WORD_BUDGET, name: str = "clean_review") -> DataFrame:
    """The reviews within the budget joined to one text per group, at most ``budget`` of them.

    Every group with a complete key has a row; its text is empty if nothing fits.
    """
    kept = within_budget(reviews, keys, review_id, text, budget)
    ordered = F.array_sort(F.collect_list(F.struct("rank", text)))
    joined = kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[text]), " ").alias(name))
    groups = reviews.dropna(subset=list(keys)).select(*keys).distinct()
    return groups.join(joined, list(keys), "left").fillna("", [name])


def venue_rollup(scored: DataFrame, keys: Sequence[str] = VENUE_KEY) -> DataFrame:
    """Averages, label counts, tier, positive ratio and quality flag per venue.

    ``scored`` holds one row per review: keys, ``sentiment_compound``,
    ``sentiment_label``, ``n_words``, ``n_chars``. Rows without a key are dropped. Scores have
    four decimals and are added as integers, so the mean does not depend on the order of rows.
    """
    label = F.col("sentiment_label")
    points = F.round(F.col("sentiment_compound") * 10_000).cast("long")
    rows = scored.dropna(subset=list(keys))
    agg = rows.groupBy(*keys).agg(
        (F.sum(points) / F.count("sentiment_compound") / 10_000).alias("avg_sentiment_score"),
        F.count_if(label == "Positive").alias("positive_review_count"),
        F.count_if(label == "Negative").alias("negative_review_count"),
        F.count_if(label == "Neutral").alias("neutral_review_count"),
        F.count("sentiment_compound").alias("total_reviews_parsed"),
        F.avg("n_words").alias("avg_review_length"),
        F.avg("n_chars").alias("avg_character_count"),
    )
    ratio = F.col("positive_review_count") / F.col("total_reviews_parsed")
    return agg.select(
        "*",
        S.sentiment_tier(F.round("avg_sentiment_score", 9)).alias("dominant_sentiment"),
        S.round_even(ratio, 3).alias("positive_ratio"),
        S.review_quality("total_reviews_parsed").alias("review_quality_flag"),
    )
