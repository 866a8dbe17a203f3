"""Parsing, normalising and bucketing of scalar columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from venuekit.functions import constants as K

_BLANKS = " \t\n\r\f\x0b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive value once for an expression that mentions it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Trim every kind of blank at both ends."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def null_if(c: Column, *values) -> Column:
    return F.when(~c.isin(*values), c)


def null_tokens(c: Column | str, tokens: Sequence[str] = K.MISSING_TOKENS) -> Column:
    """NULL for placeholder spellings, anything else unchanged."""
    c = _col(c)
    return F.when(~strip(c).isin(*tokens), c)


def to_double(c: Column | str) -> Column:
    """Numeric or NULL; never NaN, never an error."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_rate(c: Column | str) -> Column:
    """``'4.1/5'``, ``'4.1 /5'`` -> 4.1; ``NEW``, ``-``, junk -> NULL."""
    return to_double(strip(F.split_part(_col(c), F.lit("/"), F.lit(1))))


def parse_rate_of_five(c: Column | str) -> Column:
    """Only a trailing ``/5`` is dropped, so ``'8/10'`` is NULL here."""
    return to_double(strip(F.regexp_replace(strip(c), r"/5\s*$", "")))


def parse_cost(c: Column | str) -> Column:
    """``'1,200'`` -> 1200.0."""
    return to_double(F.replace(strip(c), F.lit(","), F.lit("")))


def _cased(c: Column, case: str | None) -> Column:
    if case in (None, "none"):
        return c
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}[case](c)


def clean_name(c: Column | str, case: str | None = None) -> Column:
    """Letters, digits and blanks only, then trimmed.

    ``case='title'`` uses ``initcap``, which starts a word after a blank only.
    """
    return _cased(strip(F.regexp_replace(_col(c), r"[^a-zA-Z0-9\s]", "")), case)


def normalize_text(c: Column | str, case: str | None = None) -> Column:
    """Trim, collapse runs of blanks, optional case, empty -> NULL."""
    return null_if(_cased(F.regexp_replace(strip(c), "  +", " "), case), "")


def yes_no_code(c: Column | str) -> Column:
    """1 for a yes spelling, 0 for everything else including NULL."""
    return F.when(F.lower(strip(_col(c).cast("string"))).isin(*K.YES_TOKENS), 1).otherwise(0)


def yes_no(c: Column | str) -> Column:
    return F.when(yes_no_code(c) == 1, "Yes").otherwise("No")


def below(c: Column | str, edges: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """First label whose edge is above the value; the last label is open-ended."""
    c = _col(c)
    out = F.when(c.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def rating_word(c: Column | str, missing: str | None = "Unknown") -> Column:
    return below(c, *K.RATING_WORDS, missing=missing)


def rating_tier(c: Column | str) -> Column:
    return below(c, *K.RATING_TIERS)


def sentiment_label(c: Column | str, cut: float = K.SENTIMENT_CUT) -> Column:
    c = _col(c)
    return F.when(c >= cut, "Positive").when(c <= -cut, "Negative").when(c.isNotNull(), "Neutral")


def sentiment_tier(c: Column | str) -> Column:
    c = _col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in K.SENTIMENT_TIERS:
        out = out.when(c >= edge, label)
    return out.otherwise(K.SENTIMENT_LOWEST_TIER)


def review_quality(n: Column | str) -> Column:
    return F.when(_col(n) < K.LOW_REVIEW_COUNT, "low").otherwise("normal")


def high_rating(c: Column | str, threshold: float | Column = K.HIGH_RATING, strict: bool = False) -> Column:
    """Binary target; a missing rating is class 0."""
    c = _col(c)
    return F.coalesce(((c > threshold) if strict else (c >= threshold)).cast("int"), F.lit(0))


def rate_class(c: Column | str) -> Column:
    """Half-to-even rounding to an integer class."""
    return F.bround(_col(c)).cast("int")


def clamp(c: Column | str, low: float = 0.0, high: float = 5.0) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def code_label(c: Column | str, labels: dict[int, str], prefix: str = "Category ") -> Column:
    """Map a code to its label; unknown codes read ``Category <code>``."""
    c = _col(c).cast("int")
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for code, label in labels.items():
        out = out.when(c == code, label)
    return out.otherwise(F.concat(F.lit(prefix), c.cast("string")))


def default(c: Column | str, value) -> Column:
    """``value`` where the column is NULL or (for doubles) NaN."""
    c = _col(c)
    return F.coalesce(F.when(c.cast("string") != "NaN", c), value if isinstance(value, Column) else F.lit(value))


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Half-to-even rounding of the stored double, as binary floats are rounded by ``rint``.

    ``bround`` works on the decimal spelling, where 0.25 and 3.45 are exact ties;
    scaling first and using ``rint`` treats them the way a float array library does.
    """
    scale = float(10**digits)
    return F.rint(_col(c) * scale) / scale
