"""Hand-written expectations for parsing, rounding and list literals."""

import ast

import pytest
from pyspark.sql import functions as F

from venuekit.functions import lists as L, scalars as S, text as X


def values(spark, data, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_parse_rate(spark):
    data = ["4.1/5", "4.1 /5", "NEW", "-", None, "nan", "abc", "/5", " 3 "]
    assert values(spark, data, S.parse_rate("v")) == [4.1, 4.1, None, None, None, None, None, None, 3.0]


def test_parse_rate_of_five_keeps_other_scales_out(spark):
    assert values(spark, ["4.1/5", "8/10", "4 /5 "], S.parse_rate_of_five("v")) == [4.1, None, 4.0]


def test_parse_cost(spark):
    assert values(spark, ["300", "1,200", "", "None", None, " 1,000 "], S.parse_cost("v")) == [300.0, 1200.0, None, None, None, 1000.0]


def test_missing_tokens(spark):
    data = ["NEW", " n/a ", "", "  ", "#N/A", "null", "Nan", "ok"]
    assert values(spark, data, S.null_tokens("v")) == [None] * 6 + ["Nan", "ok"]


def test_half_rounding(spark):
    assert values(spark, [0.5, 1.5, 2.5, 3.5, None], S.rate_class("v"), "double") == [0, 2, 2, 4, None]
    assert values(spark, [0.25, 0.35, 4.05], S.round_even("v", 1), "double") == [0.2, 0.4, 4.0]


def test_missing_rating_is_class_zero_and_unknown(spark):
    assert values(spark, [3.8, 3.7, None], S.high_rating("v"), "double") == [1, 0, 0]
    assert values(spark, [2.9, 3.0, 4.0, None], S.rating_word("v"), "double") == ["Bad", "Good", "Excellent", "Unknown"]


def test_sentiment_tiers(spark):
    data = [0.5, 0.2, -0.05, -0.2, -0.21, None]
    assert values(spark, data, S.sentiment_tier("v"), "double") == [
        "Highly Positive", "Positive", "Mixed", "Negative", "Highly Negative", None]
    assert values(spark, [0.05, 0.04, -0.05], S.sentiment_label("v"), "double") == ["Positive", "Neutral", "Negative"]


def test_names_and_text(spark):
    assert values(spark, ["  café Déjà!! ", "#1 Grill "], S.clean_name("v")) == ["caf Dj", "1 Grill"]
    assert values(spark, ["  a   b ", " ", "Ab"], S.normalize_text("v", "lower")) == ["a b", None, "ab"]
    assert values(spark, ["yes ", "TRUE", "1", "No", None], S.yes_no_code("v")) == [1, 1, 1, 0, 0]


def test_clamp_and_labels(spark):
    assert values(spark, [-1.0, 2.5, 9.0, None], S.clamp("v"), "double") == [0.0, 2.5, 5.0, None]
    assert values(spark, [0, 1, 7], S.code_label("v", {0: "low", 1: "high"}), "int") == ["low", "high", "Category 7"]


def test_comma_lists(spark):
    assert values(spark, ["A, b ,, C,", None, " , "], L.split_list("v", "lower")) == [["a", "b", "c"], [], []]
    assert values(spark, ["A, b ,", " , "], L.normalize_list("v")) == ["A, b", None]


REVIEWS = [
    [("Rated 4.0", "RATED\n  It's \"fine\""), ("Rated 3.5", "RATED\n plain")],
    [(None, "no rating"), ("Rated 6.0", "too high"), ("Rated 1.0", "")],
    [("Rated 2.0", "tab\there \\ slash \\n not a break, (parens) [brackets]")],
    [("Rated 5.0", "caf\x83 \xe9 ₹")],
    [("Rated 3.0", "x" * 20000 + "\n" + "it's \\' " * 4000)],
    [],
]


def expected_reviews(pairs):
    import re

    texts = [re.sub(r"^RATED\s*\n?", "", str(t), flags=re.IGNORECASE).strip() for _, t in pairs]
    found = [float(m.group(1)) for p in pairs if (m := re.search(r"Rated\s*(\d+\.?\d*)", str(p)))]
    valid = [v for v in found if 1.0 <= v <= 5.0]
    return [t for t in texts if t], (sum(valid) / len(valid) if valid else None)


@pytest.mark.parametrize("escape", [repr, ascii])
def test_review_literals_agree_with_a_literal_parser(spark, escape):
    literals = [escape(p) for p in REVIEWS]
    assert [ast.literal_eval(t) for t in literals] == REVIEWS
    got_texts = values(spark, literals, L.review_texts("v"))
    got_means = values(spark, literals, L.review_rating_mean("v"))
    want = [expected_reviews(p) for p in REVIEWS]
    assert got_texts == [w[0] for w in want]
    assert got_means == [w[1] for w in want]


@pytest.mark.parametrize("bad", ["[broken", "", "nan", "[('Rated 1.0', 'open]", "[('Rated 1.0', 'a') x]", None])
def test_malformed_reviews_are_empty(spark, bad):
    assert values(spark, [bad], L.review_texts("v"))[0] in ([], None if bad is None else [])
    assert values(spark, [bad], L.review_rating_mean("v")) == [None]


def test_string_items(spark):
    data = [repr(["Soup ", "Chef's \"special\""]), "[]", "[oops", "'text'"]
    assert values(spark, data, L.string_items("v")) == [["Soup", "Chef's \"special\""], [], [], []]


def test_keyword_cleaning(spark):
    data = ["The FRIES at http://x.y/z weren't dishes, 2 boxes of berries & glass!"]
    assert values(spark, data, X.clean_text("v")) == ["fry dish box berry glass"]


def test_bigrams(spark):
    assert values(spark, ["a1 b2 c3", "one", "x"], X.with_bigrams(X.index_terms("v"))) == [
        ["a1", "b2", "c3", "a1 b2", "b2 c3"], ["one"], []]


def test_ordered_union_keeps_first_occurrence(spark):
    df = spark.createDataFrame([(["b", "a"], ["c", "b", "d"])], "x array<string>, y array<string>")
    assert df.select(L.ordered_union("x", "y")).first()[0] == ["b", "a", "c", "d"]


def test_default_replaces_nan_and_null(spark):
    assert values(spark, [1.0, float("nan"), None], S.default("v", -1.0), "double") == [1.0, -1.0, -1.0]


def test_word_count(spark):
    assert values(spark, ["a  b\nc ", "", "   "], F.col("v").isNotNull() & True) == [True] * 3
    assert values(spark, ["a  b\nc ", "", "   "], X.word_count("v")) == [3, 0, 0]
