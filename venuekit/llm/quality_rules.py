"""Weak supervision over quality rules: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from venuekit.llm.common import replace_columns

# Symbols counted by the base features, and frequent function words of four languages.
SYMBOLS = "#*$%&|<>"
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are as with they be at this from have or by one had not but what all were when we there can an your which "
    "le la les de des et un une du en est que qui dans pour par sur au avec il ne se pas plus ce "
    "der die das und ist von zu den mit sich auf für im dem nicht ein eine als auch es an werden aus "
    "el los las del y en un una que es por con para su al lo como más o pero sus".split()
)
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_function", "n_marks"]
GOOD, BAD, ABSTAIN = 1, -1, 0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ROUNDS, PSEUDO = 50, 1.0

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = re.compile(r"[!?]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")


def text_features(text: str) -> tuple[int, ...]:
    """Counts of one text, in the order of ``FEATURES``."""
    words = _WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        covered = bytearray(n)
        for i, gram in enumerate(grams):
            if counts[gram] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeated = sum(covered)
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
        len(_UPPER.findall(text)), len(_LETTER.findall(text)), sum(w.lower() in FUNCTION_WORDS for w in words), len(_MARKS.findall(text)),
    )


def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(t or "") for t in texts], columns=FEATURES, dtype="int64")


def rule_votes() -> dict[str, Column]:
    """Each rule's vote from the feature columns: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(share: Column, bad: Column, good: Column, when: Column | None = None) -> Column:
        voted = F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
        return (voted if when is None else F.when(when, voted).otherwise(ABSTAIN)).cast("int")

    symbols = F.col("n_symbols") / n
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    function = F.col("n_function") / n
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeat = F.col("n_repeat_words") / n
    length = F.col("word_chars") / n
    marks = F.col("n_marks") / n
    enough = F.col("n_words") >= 20
    return {
        "symbols": vote(symbols, symbols > 0.15, symbols < 0.02),
        "capitals": vote(upper, upper > 0.3, upper < 0.1, F.col("n_letters") > 0),
        "function_words": vote(function, function < 0.01, function > 0.06, enough),
        "line_repeats": vote(dup, dup > 0.3, dup == 0, F.col("n_lines") > 2),
        "word_repeats": vote(repeat, repeat > 0.25, repeat < 0.1, enough),
        "word_length": vote(length, (length < 3) | (length > 10), length.between(4, 7), enough),
        "marks": vote(marks, marks > 0.1, marks == 0, enough),
    }


def fit_rules(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents and ``log P(vote | good) - log P(vote | bad)`` per rule and vote (-1, 0, 1).

    Expectation-maximisation over distinct vote patterns. The start is the share of good votes among
    those cast. Every rule keeps a bad vote at least as likely in bad documents as in good ones, so the
    two classes cannot change places.
    """
    rules = patterns.shape[1]
    if not len(counts):
        return 0.0, np.zeros((rules, 3))
    cast = np.maximum((patterns != 0).sum(1), 1)
    good = np.clip(((patterns == 1).sum(1) - 2.0 * (patterns == -1).sum(1)) / cast / 2 + 0.5, 0.02, 0.98)
    hit = np.stack([patterns == v for v in (-1, 0, 1)], 2)
    weights, prior = np.zeros((rules, 3)), 0.0
    for _ in range(rounds):
        of_good, of_bad = counts * good, counts * (1 - good)
        p_good = (np.einsum("p,prv->rv", of_good, hit) + PSEUDO) / (of_good.sum() + 3 * PSEUDO)
        p_bad = (np.einsum("p,prv->rv", of_bad, hit) + PSEUDO) / (of_bad.sum() + 3 * PSEUDO)
        weights = np.log(p_good) - np.log(p_bad)
        weights[:, 0], weights[:, 2] = np.minimum(weights[:, 0], 0), np.maximum(weights[:, 2], 0)
        prior = float(np.log((of_good.sum() + PSEUDO) / (of_bad.sum() + PSEUDO)))
        scores = prior + np.einsum("rv,prv->p", weights, hit)
        good = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    return prior, weights


def score_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every document with its features, ``base_failed``, ``quality`` (posterior) and ``kept``.

    All documents are counted by vote pattern, at most 3 to the number of rules whatever the corpus
    holds; the patterns are fitted and the posterior is then a sum of the fitted weights of a row's votes.

    A null text counts as empty: no words, so it fails the base rule. Repeated rows get equal results,
    an empty table gives no rows, and columns that carry a result's name are replaced.
    """
    votes = rule_votes()
    features = F.pandas_udf(_features, ", ".join(f"{name} long" for name in FEATURES))
    base = replace_columns(docs, *FEATURES, "_features", *[f"_vote_{r}" for r in votes], "base_failed", "quality", "kept")
    featured = base.withColumn("_features", features(F.col(text_col))).select(*base.columns, "_features.*")
    named = {f"_vote_{rule}": v for rule, v in votes.items()}
    counted = featured.select(*[v.alias(c) for c, v in named.items()]).groupBy(*named).agg(F.count("*").alias("_n")).collect()
    patterns = np.array([row[:-1] for row in counted], dtype=int).reshape(len(counted), len(votes))
    prior, weights = fit_rules(patterns, np.array([row[-1] for row in counted], dtype=float))
    score = F.lit(prior)
    for (_, vote), w in zip(votes.items(), weights):
        score = score + F.when(vote == BAD, float(w[0])).when(vote == GOOD, float(w[2])).otherwise(float(w[1]))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    scored = featured.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-score))})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
