"""Text cleaning and tokenising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from venuekit.functions import constants as K
from venuekit.functions.scalars import _col, let, strip

# Fixed patterns.
_URL = r"http\S+|www\S+"
_WORD = r"[\p{L}\p{N}_]{2,}"
_SENTIMENT_WORD = r"[A-Za-z]+"


def words(c: Column | str) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def singular(c: Column) -> Column:
    """Lemma of a noun: the table of exceptions first, then the ending rules of the public WordNet morphology."""
    n = F.length(c)
    table = F.create_map(*[F.lit(v) for pair in K.LEMMA_EXCEPTIONS.items() for v in pair])
    return (
        F.when(c.isin(*K.LEMMA_EXCEPTIONS), F.element_at(table, c))
        .when(c.rlike("(ss|us|is)$") | (n <= 3), c)
        .when(c.rlike("ies$") & (n > 4), F.concat(F.substr(c, F.lit(1), n - 3), F.lit("y")))
        .when(c.rlike("(ss|x|z|ch|sh)es$"), F.substr(c, F.lit(1), n - 2))
        .when(c.rlike("men$") & (n > 4), F.concat(F.substr(c, F.lit(1), n - 3), F.lit("man")))
        .when(c.rlike("s$"), F.substr(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def keyword_tokens(c: Column | str, stop_words: Sequence[str] = K.STOP_WORDS) -> Column:
    """Letters-only lower-case tokens longer than two, stop words removed, singular form."""
    text = F.regexp_replace(F.regexp_replace(_col(c), _URL, ""), r"[^a-zA-Z\s]", " ")
    tokens = F.split(F.lower(strip(text)), r"\s+")
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*stop_words))
    return F.transform(kept, singular)


def clean_text(c: Column | str, stop_words: Sequence[str] = K.STOP_WORDS) -> Column:
    return F.array_join(keyword_tokens(c, stop_words), " ")


def index_terms(c: Column | str) -> Column:
    """Tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(_WORD), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by the pairs of neighbours."""

    def extend(t: Column) -> Column:
        n = F.size(t)
        left, right = F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(t, F.lit(2), n)
        pairs = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n > 1, F.concat(t, pairs)).otherwise(t)

    return let(tokens, extend)


def sentiment_tokens(c: Column | str) -> Column:
    """Letter runs as written; apostrophes vanish so that ``isn't`` reads ``isnt``."""
    return F.regexp_extract_all(F.replace(_col(c), F.lit("'"), F.lit("")), F.lit(_SENTIMENT_WORD), F.lit(0))


def questions(c: Column | str) -> Column:
    """Strength of repeated question marks."""
    c = _col(c)
    n = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return F.when(n > 3, K.QUESTIONS_MANY).when(n > 1, n * F.lit(K.QUESTION_STEP)).otherwise(0.0)


def exclamations(c: Column | str) -> Column:
    c = _col(c)
    return F.least(F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit(""))), F.lit(K.MAX_EXCLAMATIONS))
