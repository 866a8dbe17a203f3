"""Text enrichment: reviews to scores, keywords and venue roll-ups, joined back to the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from venuekit.functions import lists as L, text as X
from venuekit.operators import keywords as W
from venuekit.operators.relational import require_columns
from venuekit.operators.reviews import VENUE_KEY, budgeted_text, explode_reviews, venue_rollup
from venuekit.operators.sentiment import score_reviews

KEY = list(VENUE_KEY)


def review_rows(df: DataFrame) -> DataFrame:
    """Reviews of all listings, counted and cleaned."""
    rows = explode_reviews(df.dropna(subset=KEY), "reviews_text", KEY, "row_id")
    return rows.select("*", X.word_count("text").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


def venue_profiles(df: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """One row per venue that has reviews: sentiment roll-up, budgeted text and keywords."""
    require_columns(df, ["row_id", *KEY, "reviews_text", "tags_text"])
    reviews = review_rows(df)
    scored = score_reviews(reviews, "review_id", "text", [*KEY, "n_words", "n_chars"], lexicon)
    cleaned = reviews.select(*KEY, "review_id", X.clean_text("text").alias("_clean"))
    texts = budgeted_text(cleaned, KEY, "review_id", "_clean")
    agg = venue_rollup(scored, KEY).join(texts, KEY, "left").fillna("", ["clean_review"])
    scores = W.tfidf(agg.select(*KEY, "clean_review"), KEY, "clean_review")
    terms = W.ranked_list(W.top_keywords(scores, KEY), KEY, "term", "review_keywords_list")
    dishes = W.dish_keywords(df, KEY, "row_id", "tags_text")
    joined = agg.join(terms, KEY, "left").join(dishes, KEY, "left")
    return W.merge_keywords(joined, "dish_keywords_list", "review_keywords_list")


def enrich(df: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Every listing with its venue profile and where the profile came from."""
    profiles = venue_profiles(df, lexicon).withColumn("_found", F.lit(True))
    own = F.size(L.review_texts("reviews_text")) > 0
    source = F.when(F.col("_found").isNull(), "none").when(~own, "inherited").otherwise("direct")
    return df.join(profiles, KEY, "left").withColumn("nlp_source", source).drop("_found")


def source_counts(enriched: DataFrame) -> DataFrame:
    """Class totals; the three classes add up to all rows."""
    source = F.col("nlp_source")
    return enriched.agg(
        F.count_if(source == "direct").alias("n_direct"),
        F.count_if(source == "inherited").alias("n_inherited"),
        F.count_if(source == "none").alias("n_none"),
        F.count("*").alias("n_total"),
    )
