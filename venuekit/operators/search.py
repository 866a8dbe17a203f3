"""Similarity search and retrieval reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from venuekit.functions import constants as K
from venuekit.functions.vectors import cosine
from venuekit.operators.neighbors import nearest
from venuekit.operators.relational import with_probe


def similar_rows(df: DataFrame, key: str, features: Sequence[str], probe_id, k: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows most similar to one probe row by cosine with kept columns, itself excluded, ties by key.

    The probe is a one-row scalar subquery; the rest is a scan with a top-k.
    """
    vectors = df.select(key, *keep, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    probe = vectors.filter(F.col(key) == F.lit(probe_id)).select("_v")
    paired = with_probe(vectors.filter(F.col(key) != F.lit(probe_id)), probe)
    scored = paired.select(key, *keep, F.round(cosine("_v", "probe__v"), 9).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def search(index: DataFrame, queries: DataFrame, k: int = K.TOP_K, where: Column | None = None,
           index_id: str = "chunk_id", query_id: str = "query_id", vector: str = "embedding",
           payload: Sequence[str] = (), skip_self: bool = False) -> DataFrame:
    """Top-k by cosine, optionally among rows that match a metadata filter."""
    pool = index if where is None else index.filter(where)
    return nearest(queries, pool, query_id, vector, index_id, vector, k, "cosine", payload, skip_self)


def source_listing(hits: DataFrame) -> DataFrame:
    """Type, name (or question) and score of retrieved rows."""
    return hits.select(
        "query_id", "rank", F.col("meta.doc_type").alias("doc_type"),
        F.coalesce("meta.name", "meta.question").alias("source"), F.round("score", 3).alias("score"),
    )


def retrieval_report(hits: DataFrame, expected: DataFrame, found: str = "label", wanted: str = "expected") -> DataFrame:
    """Per query: number of sources, whether any has the expected label, and its reciprocal rank."""
    match = F.col(found) == F.col(wanted)
    rows = expected.join(hits, "query_id", "left")
    return rows.groupBy("query_id").agg(
        F.count("rank").alias("num_source_nodes"),
        F.coalesce(F.bool_or(match), F.lit(False)).alias("hit"),
        F.coalesce(1.0 / F.min(F.when(match, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
    )
