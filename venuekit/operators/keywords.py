"""TF-IDF keywords, dish keywords and their merge."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from venuekit.functions import constants as K, lists as L, text as X
from venuekit.operators.profile import item_frequencies
from venuekit.operators.ranking import first_by_key, top_k
from venuekit.session import materialize

BROADCAST_TERMS = 100_000
HELD_TERMS = 500_000  # rows that a task holds before it passes them on
HELD_CHARACTERS = 8_000_000  # of the documents that a task counts together


def term_counts(docs: DataFrame, keys: Sequence[str], terms: Column) -> DataFrame:
    """``(keys, term, tf)``; counted per document on the map side before the shuffle.

    The explicit null filter is the one a later join on ``term`` would add; with it every
    consumer plans the same exchange, and Spark runs it once.
    """
    exploded = docs.select(*keys, F.explode(terms).alias("term")).filter(F.col("term").isNotNull())
    return exploded.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_terms(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``(keys, _texts, _rows)``: the terms of each text of a document, blank-separated, and its number of rows; stored."""
    joined = F.array_join(X.index_terms(text), " ")
    return materialize(docs.groupBy(*keys).agg(F.collect_list(joined).alias("_texts"), F.count("*").alias("_rows")), "terms")


def _with_pairs(texts: Sequence[str]) -> list[str]:
    """Terms and pairs of neighbours of all texts of a document."""
    out = []
    for text in texts:
        if text:
            found = text.split(" ")
            out += found
            out += [f"{a} {b}" for a, b in zip(found, found[1:])]
    return out


def _counted(documents: list[Sequence[str]]) -> pd.DataFrame:
    """``term, df, total_tf`` of some documents; terms are numbers until the distinct ones are known."""
    texts = [(i, t.split(" ")) for i, doc in enumerate(documents) for t in doc if t]
    if not texts:
        return pd.DataFrame({"term": [], "df": [], "total_tf": []})
    sizes = [len(t) for _, t in texts]
    codes, names = pd.factorize(np.array([w for _, t in texts for w in t], dtype=object))
    codes, doc, text = codes.astype(np.int64), np.repeat([i for i, _ in texts], sizes), np.repeat(np.arange(len(texts)), sizes)
    paired = text[1:] == text[:-1]
    # a term is its number, a pair lies above all terms; then the document
    pairs = (codes[:-1][paired] + 1) * len(names) + codes[1:][paired]
    cells, times = np.unique(np.r_[codes * len(documents) + doc, pairs * len(documents) + doc[1:][paired]], return_counts=True)
    terms = cells // len(documents)
    start = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    terms = terms[start]
    single = np.searchsorted(terms, len(names))
    above = terms[single:]
    spelt = np.r_[names[terms[:single]], names[above // len(names) - 1] + " " + names[above % len(names)]]
    return pd.DataFrame({"term": spelt, "df": np.diff(np.r_[start, len(cells)]), "total_tf": np.add.reduceat(times, start)})


def term_statistics(terms: DataFrame) -> DataFrame:
    """``term, df, total_tf`` over stored documents; a task adds up many documents before anything is moved."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for texts in frame["_texts"]:
                held.append(texts)
                size += sum(map(len, texts))
                if size >= HELD_CHARACTERS:
                    yield _counted(held)
                    held, size = [], 0
        yield _counted(held)

    partial = terms.select("_texts").mapInPandas(count, "term string, df long, total_tf long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def vocabulary(stats: DataFrame, n_docs: int, max_df: float = K.MAX_DF, min_df: int = 1, max_terms: int = K.MAX_TERMS) -> DataFrame:
    """The ``max_terms`` most frequent terms within the document-frequency limits, ties by term."""
    usable = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(n_docs) * F.lit(max_df)))
    return usable.orderBy(F.desc("total_tf"), "term").limit(max_terms)


def tfidf(docs: DataFrame, keys: Sequence[str], text: str, max_df: float = K.MAX_DF, min_df: int = 1,
          max_terms: int = K.MAX_TERMS) -> DataFrame:
    """Sublinear TF-IDF over uni- and bigrams in long form, L2-normalised per document.

    Texts are split once and stored by document. Term statistics are added up within tasks before they are exchanged. A
    vocabulary of at most ``BROADCAST_TERMS`` goes to the tasks, which score whole documents, so no row of a document and
    a term is moved; a larger one meets the counts in a join.
    """
    terms = document_terms(docs, keys, text)
    n_docs = terms.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    words = vocabulary(term_statistics(terms), n_docs, max_df, min_df, max_terms)
    if max_terms <= BROADCAST_TERMS:
        return _scored_in_tasks(terms, keys, words.select("term", "df").toPandas(), n_docs)
    split = F.flatten(F.transform("_texts", lambda t: X.with_bigrams(F.filter(F.split(t, " "), lambda w: w != ""))))
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    weight = (1 + F.log(F.col("tf").cast("double"))) * idf
    weighted = term_counts(terms, keys, split).join(words, "term").select(*keys, "term", "tf", "df", weight.alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "term", "tf", "df", (F.col("_w") / norm).alias("score"))


def _scored_in_tasks(terms: DataFrame, keys: Sequence[str], words: pd.DataFrame, n_docs: int) -> DataFrame:
    names, df = words["term"].to_numpy(dtype=object), words["df"].to_numpy(dtype=np.int64)
    places = terms.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    keys = list(keys)
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([*[terms.schema[c] for c in keys], T.StructField("term", T.StringType()), T.StructField("tf", long),
                           T.StructField("df", long), T.StructField("score", double)])

    def rows_of(frame: pd.DataFrame, at: list[int], term: list[int], tf: list[int]) -> pd.DataFrame:
        at, term, tf = np.array(at, np.int64), np.array(term, np.int64), np.array(tf, np.int64)
        weight = (1 + np.log(tf)) * idf[term]
        norm = np.sqrt(np.bincount(at, weight * weight, len(frame)))
        found = frame[keys].iloc[at].reset_index(drop=True)
        return found.assign(term=names[term], tf=tf, df=df[term], score=weight / norm[at])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = places.value
        for frame in frames:
            at, term, tf = [], [], []
            for i, texts in enumerate(frame["_texts"]):
                found = Counter(map(known.get, _with_pairs(texts)))
                found.pop(None, None)
                at += [i] * len(found)
                term += found
                tf += found.values()
                if len(at) >= HELD_TERMS:  # whole documents only
                    yield rows_of(frame, at, term, tf)
                    at, term, tf = [], [], []
            if at:
                yield rows_of(frame, at, term, tf)

    return terms.select(*keys, "_texts").mapInPandas(score, schema)


def top_keywords(scores: DataFrame, keys: Sequence[str], n: int = K.REVIEW_KEYWORDS) -> DataFrame:
    """The ``n`` best terms per document with positive score, ties by term. A document has at most
    ``max_terms`` rows here, so its group is bounded."""
    order = [F.desc(F.round("score", 9)), F.asc("term")]
    return top_k(scores.filter(F.col("score") > 0), keys, order, n)


def ranked_list(ranked: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Top-n rows back to one ordered array per key."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", item)))
    return ranked.groupBy(*keys).agg(F.transform(ordered, lambda x: x[item]).alias(name))


def dish_keywords(df: DataFrame, keys: Sequence[str], row_key: str, column: str,
                  n: int = K.DISH_KEYWORDS, name: str = "dish_keywords_list") -> DataFrame:
    """Distinct dishes of a venue's first listing, ranked by frequency over the whole table."""
    lists = df.filter(F.col(column).isNotNull()).select(
        *keys, row_key, L.split_list(column, "lower").alias("_dishes")
    )
    frequency = materialize(item_frequencies(lists, "_dishes", "dish"), "dish-frequency")
    first = first_by_key(lists.dropna(subset=list(keys)), keys, row_key)
    dishes = first.select(*keys, F.explode(F.array_distinct("_dishes")).alias("dish"))
    ranked = top_k(dishes.join(frequency, "dish"), keys, [F.desc("n"), F.asc("dish")], n)
    found = ranked_list(ranked, keys, "dish", name)
    empty = F.array().cast("array<string>")
    return first.select(*keys).join(found, list(keys), "left").withColumn(name, F.coalesce(name, empty))


def merge_keywords(df: DataFrame, dishes: str, terms: str) -> DataFrame:
    """Joined keyword strings, dish terms first."""
    empty = F.array().cast("array<string>")
    dish, term = F.coalesce(F.col(dishes), empty), F.coalesce(F.col(terms), empty)
    return df.select(
        *[c for c in df.columns if c not in (dishes, terms)],
        F.array_join(L.ordered_union(dish, term), ", ").alias("keywords"),
        L.join_or_null(dish).alias("dish_keywords"),
        L.join_or_null(term).alias("review_keywords"),
        (F.size(dish) > 0).alias("keywords_dish_enriched"),
    )
