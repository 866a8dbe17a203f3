"""Lexicon sentiment (Hutto & Gilbert 2014): valences, boosters, negations, idioms, contrast, capitals and marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from venuekit.functions import constants as K, scalars as S, text as X


BROADCAST_WORDS = 200_000


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.VALENCE.items()), "word string, valence double")


def _shouted(token: Column) -> Column:
    return (F.length(token) > 1) & (token == F.upper(token))


def _idiom_ends(low: Column) -> Column:
    """For each token the number of words of the longest idiom that ends there, 0 for none."""

    def longest(_: Column, i: Column) -> Column:
        found = F.lit(0)
        for n in sorted({len(p.split()) for p in K.IDIOMS}):
            run = F.array_join(F.slice(low, F.greatest(i - n + 2, F.lit(1)), F.lit(n)), " ")
            listed = run.isin(*[p for p in K.IDIOMS if len(p.split()) == n])
            found = F.when((i >= n - 1) & listed, n).otherwise(found)
        return found

    return F.transform(low, longest)


def _context(raw: Column, low: Column, ends: Column, contrast: Column, mixed: Column) -> Column:
    """Each token with its three predecessors, their stress, its side of the contrast and its idiom."""
    valences = F.create_map(*[F.lit(v) for pair in K.IDIOMS.items() for v in pair])

    def one(token: Column, i: Column) -> Column:
        before = [F.get(low, i - d).alias(f"before{d}") for d in (1, 2, 3)]
        stress = [(mixed & F.coalesce(_shouted(F.get(raw, i - d)), F.lit(False))).alias(f"stress{d}") for d in (0, 1, 2, 3)]
        side = F.when((contrast == 0) | (i + 1 == contrast), 1.0).when(i + 1 < contrast, K.CONTRAST_BEFORE).otherwise(K.CONTRAST_AFTER)
        n = F.coalesce(F.get(ends, i), F.lit(0))
        words = F.array_join(F.slice(low, F.greatest(i - n + 2, F.lit(1)), F.greatest(n, F.lit(1))), " ")
        idiom = F.when(n > 0, F.element_at(valences, words))
        inside = F.lit(False)
        for d in range(max(len(p.split()) for p in K.IDIOMS)):
            inside = inside | F.coalesce(F.get(ends, i + d) > d, F.lit(False))
        return F.struct(token.alias("word"), *before, *stress, side.alias("side"), idiom.alias("idiom"), inside.alias("inside"))

    return F.transform(low, one)


def _signed_valence() -> Column:
    """Valence of an idiom or lexicon hit after stress, boosters, negation and contrast; NULL for other words."""
    stressed = lambda d: F.when(F.col(f"stress{d}"), K.CAPITALS_STEP).otherwise(0.0)
    boost, negated = F.lit(0.0), F.lit(False)
    for d, damp in zip((1, 2, 3), K.BOOST_DAMPING):
        word, step = F.col(f"before{d}"), (F.lit(K.BOOST_STEP) + stressed(d)) * damp
        boost = boost + F.when(word.isin(*K.BOOSTERS_UP), step).when(word.isin(*K.BOOSTERS_DOWN), -step).otherwise(0.0)
        negated = negated | F.coalesce(word.isin(*K.NEGATIONS), F.lit(False))
    boosted = F.col("valence") + F.signum("valence") * (boost + stressed(0))
    own = F.when(F.col("valence").isNotNull() & ~F.col("inside"), F.when(negated, boosted * K.NEGATION_FACTOR).otherwise(boosted))
    return F.coalesce(F.col("idiom"), own) * F.col("side")


def score_reviews(reviews: DataFrame, review_id: str, text: str, carry: Sequence[str] = (),
                  lexicon: DataFrame | None = None) -> DataFrame:
    """Compound score in [-1, 1] and three-way label per review.

    Tokens meet the lexicon in an equi-join, broadcast when the lexicon was counted to be
    small. Tokens then stay where their review is, and the map-side aggregation leaves one
    narrow row per review for the shuffle. A larger lexicon is joined by word.
    """
    lexicon = default_lexicon(reviews.sparkSession) if lexicon is None else lexicon
    if lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        lexicon = F.broadcast(lexicon)
    marks = (X.exclamations(text) * F.lit(K.EXCLAMATION_STEP) + X.questions(text)).alias("_marks")
    tokens = reviews.select(review_id, *carry, marks, X.sentiment_tokens(text).alias("_t")).withColumn("_l", F.transform("_t", F.lower))
    shouted = F.size(F.filter("_t", _shouted))
    last_words = F.array(*[F.lit(p.split()[-1]) for p in K.IDIOMS])
    tokens = tokens.withColumns({
        "_but": F.array_position("_l", K.CONTRAST), "_mixed": (shouted > 0) & (shouted < F.size("_t")),
        "_ends": F.when(F.arrays_overlap("_l", last_words), _idiom_ends(F.col("_l"))).otherwise(F.array().cast("array<int>")),
    })
    context = _context(*[F.col(c) for c in ("_t", "_l", "_ends", "_but", "_mixed")])
    words = tokens.select(review_id, *carry, "_marks", F.explode_outer(context).alias("_c"))
    words = words.select(review_id, *carry, "_marks", "_c.*")
    sums = (
        words.join(lexicon, "word", "left").withColumn("_v", _signed_valence())
        .groupBy(review_id, *carry, "_marks")
        .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"), F.count("_v").alias("n_hits"))
    )
    total = F.col("_s") + F.signum(F.round("_s", 9)) * F.col("_marks")
    compound = F.round(total / F.sqrt(total * total + K.NORMALIZER), 4)
    return sums.select(
        review_id, *carry, "n_hits", compound.alias("sentiment_compound"), S.sentiment_label(compound).alias("sentiment_label")
    )
