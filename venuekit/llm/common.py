"""Small expressions shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns: words by white space, and words for n-gram matching.
WORD = r"[^\x20\x09-\x0D]+"
NGRAM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a text in order; null gives no words."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(doc_id: Column, text: Column) -> Column:
    """128-bit key of a row's id and whole text; rows that repeat both share it."""
    shown = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.md5(shown.cast("binary"))


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add, whatever they held."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
