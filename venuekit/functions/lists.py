"""Comma lists, list literals and small array helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from venuekit.functions.scalars import _cased, _col, let, null_if, strip, to_double

# Fixed patterns of a list literal: quoted strings may hold escaped quotes. Possessive
# quantifiers keep the Java matcher iterative, so long reviews cannot overflow its stack.
_SINGLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_QUOTED = f"(?:{_SINGLE}|{_DOUBLE})"
_BARE = r"""[^'"\[\](),]++"""
_PAIR = rf"\(\s*(?:{_QUOTED}|{_BARE})\s*,\s*({_QUOTED})\s*,?\s*\)"
_ONLY_COMMAS = r"^\s*\[[\s,]*\]\s*$"
_RATED = r"Rated\s*(\d+\.?\d*)"
_SLASH = "\ue000"  # private-use character that stands in for an escaped backslash


def split_list(c: Column | str, case: str | None = None) -> Column:
    """Comma list to array; blanks trimmed, empty items dropped, NULL -> empty array."""
    items = F.transform(F.split(_col(c), ","), lambda x: _cased(strip(x), case))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def normalize_list(c: Column | str, case: str | None = None) -> Column:
    """Comma list with tidy separators; NULL when nothing is left."""
    return join_or_null(split_list(c, case))


def join_or_null(c: Column | str, sep: str = ", ") -> Column:
    return null_if(F.array_join(_col(c), sep), "")


def ordered_union(a: Column | str, b: Column | str) -> Column:
    """Items of ``a`` then new items of ``b``, first occurrence kept."""
    return F.array_distinct(F.concat(_col(a), _col(b)))


def _decode_marked(c: Column, marker: str, digits: int) -> Column:
    """Replace ``marker`` + hex digits by the character it names."""
    pad = "0" * (4 - digits)

    def one(piece: Column, i: Column) -> Column:
        code = F.concat(F.lit(pad), F.substring(piece, 1, digits))
        char = F.decode(F.unhex(code), "UTF-16BE")
        known = piece.rlike(f"^[0-9a-fA-F]{{{digits}}}")
        return F.when(i == 0, piece).when(known, F.concat(char, F.substr(piece, F.lit(digits + 1)))).otherwise(piece)

    return F.array_join(F.transform(F.split(c, marker), one), "")


def _resolve(body: Column) -> Column:
    out = F.replace(body, F.lit("\\\\"), F.lit(_SLASH))
    for escape, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"')):
        out = F.replace(out, F.lit(escape), F.lit(char))
    out = _decode_marked(_decode_marked(out, r"\\x", 2), r"\\u", 4)
    return F.when(F.instr(body, "\\") > 0, F.replace(out, F.lit(_SLASH), F.lit("\\"))).otherwise(body)


def unquote(c: Column) -> Column:
    """Value of a quoted string literal: quotes dropped, escapes resolved."""
    return let(let(c, lambda q: F.substr(q, F.lit(2), F.length(q) - 2)), _resolve)


def _items(c: Column, pattern: str) -> Column:
    """All matches, or an empty array when anything but commas stands between them."""
    clean = F.regexp_replace(c, pattern, "").rlike(_ONLY_COMMAS)
    none = F.array().cast("array<string>")
    return F.when(clean, F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(none)


def review_pairs(c: Column | str) -> Column:
    """Raw ``(rating, text)`` tuples of a review-list literal; malformed -> empty."""
    return _items(_col(c), _PAIR)


def review_texts(c: Column | str, drop_marker: bool = True) -> Column:
    """Review texts without the leading ``RATED`` marker; empty ones dropped."""

    def text(pair: Column) -> Column:
        value = unquote(F.regexp_extract(pair, _PAIR, 1))
        if drop_marker:
            value = F.regexp_replace(value, r"(?i)^RATED\s*\n?", "")
        return strip(value)

    return F.filter(F.transform(review_pairs(c), text), lambda x: x != "")


def review_rating_mean(c: Column | str) -> Column:
    """Mean of the ratings in 1..5 named by the tuples; NULL when there is none."""
    found = F.transform(review_pairs(c), lambda p: to_double(F.regexp_extract(p, _RATED, 1)))
    valid = F.filter(found, lambda x: x.between(1.0, 5.0))
    total = F.aggregate(valid, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(valid) > 0, total / F.size(valid))


def string_items(c: Column | str) -> Column:
    """Items of a list-of-strings literal, trimmed; malformed or NULL -> empty."""
    return F.transform(_items(_col(c), _QUOTED), lambda x: strip(unquote(x)))
