"""Registered queries: documents, chunks, vectors and search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from venuekit.functions import lists as L
from venuekit.functions.constants import FAQS, META_FIELDS, NARRATIVE, NARRATIVE_MISSING, NARRATIVE_SENTENCES
from venuekit.operators import corpus as D, index as I, search as Q
from venuekit.operators.profile import pass_rates
from venuekit.plans.enrichment import enrich
from venuekit.plans.queries_text import ENRICHED, PROFILE_CTES
from venuekit.plans.registry import CLEAN, clean, documents, query, rounded
from venuekit.session import delete_on_exit, materialize, scratch_path
from venuekit.sources.tables import table


def venue_fields(rows):
    """Enriched venue columns under the names the document builder expects."""
    return rows.select(
        "row_id", "name", "location", F.col("category").alias("rest_type"), L.normalize_list("tags_text").alias("cuisines"),
        F.col("cost").alias("cost_for_two"), "rate", F.col("menu_text").alias("menu_item"),
        F.col("reviews_text").alias("reviews_list"), F.col("online_order").cast("string").alias("online_order"),
        F.col("book_table").cast("string").alias("book_table"), "clean_review", "dominant_sentiment", "avg_sentiment_score",
        "positive_ratio", "keywords", "dish_keywords", "review_quality_flag", "nlp_source",
    )


def venue_corpus(spark, sf):
    """A document for every venue, from the listing and its enrichment."""
    return D.venue_documents(venue_fields(enrich(clean(spark, sf))), "row_id")


_ITEMS = "list_transform(regexp_extract_all(menu_text, '(''[^'']*''|\"[^\"]*\")', 1), lambda x: trim(substr(x, 2, length(x) - 2)))"
_RAW_TEXTS = (
    "list_filter(list_transform(regexp_extract_all(reviews_text, '\\((?:''[^'']*''|\"[^\"]*\"), (''[^'']*''|\"[^\"]*\")\\)', 1), lambda x: trim(replace("
    "substr(x, 2, length(x) - 2), concat(chr(92), 'n'), chr(10)))), lambda x: x <> '')"
)
_SQL_FIELDS = {
    "name": "c.name", "rest_type": "category", "location": "c.location", "dish_liked": "NULL", "cost_for_two": "CAST(CAST(cost AS BIGINT) AS VARCHAR)",
    "cuisines": "nullif(array_to_string(list_filter(list_transform(string_split(tags_text, ','), lambda x: trim(x)), lambda x: x <> ''), ', '), '')",
    "rate": "CAST(c.rate AS VARCHAR)", "dominant_sentiment": "nullif(dominant_sentiment, '')", "keywords": "nullif(keywords, '')",
    "menu_item": f"nullif(array_to_string({_ITEMS}, ', '), '')", "clean_review": f"coalesce(nullif(clean_review, ''), nullif(array_to_string({_RAW_TEXTS}, ' '), ''))",
}


def _narrative_sql() -> str:
    """The template as SQL: texts and fields in turn."""
    def text(template, fields):
        parts = re.split(r"\{(\w*)\}", template)
        return " || ".join(fields[p] if i % 2 else f"'{p}'" for i, p in enumerate(parts))

    fields = {n: f"coalesce({_SQL_FIELDS[n]}, '{missing}')" for n, missing in NARRATIVE_MISSING.items()}
    fields |= {n: f"coalesce({text(sentence, {'': _SQL_FIELDS[n]})}, '')" for n, sentence in NARRATIVE_SENTENCES.items()}
    return text(NARRATIVE, fields)


_CORPUS = CLEAN + f", {PROFILE_CTES}, {ENRICHED}"


@query("c25_narrative", f"{_CORPUS} SELECT concat('venue-', c.row_id) AS doc_id, {_narrative_sql()} AS text FROM clean c JOIN enriched USING (row_id)")
def c25(spark, sf):
    return venue_corpus(spark, sf).select("doc_id", "text")


@query(
    "c26_metadata",
    _CORPUS + f"""SELECT concat('venue-', c.row_id) AS doc_id, 'restaurant' AS doc_type, c.name, c.location, {_SQL_FIELDS['cuisines']} AS cuisines,
 category AS rest_type, cost AS cost_for_two, c.rate AS rating, false AS rating_is_imputed, CAST(online_order AS VARCHAR) AS online_order,
 CAST(book_table AS VARCHAR) AS book_table, len({_ITEMS}) > 0 AS menu_available, round(avg_sentiment_score, 9) AS sentiment_score,
 dominant_sentiment AS sentiment_label, positive_ratio, keywords, dish_keywords, review_quality_flag AS review_quality, nlp_source
 FROM clean c JOIN enriched USING (row_id)""",
)
def c26(spark, sf):
    fields = [f for f in META_FIELDS if f != "question"]
    return rounded(venue_corpus(spark, sf).select("doc_id", *[f"meta.{f}" for f in fields]), "sentiment_score", digits=9)


@query(
    "c27_faq_union",
    CLEAN + f"SELECT 'restaurant' AS doc_type, count(*) AS n FROM clean UNION ALL SELECT 'faq', {len(FAQS)}",
)
def c27(spark, sf):
    docs = venue_corpus(spark, sf).unionByName(D.faq_documents(spark))
    return docs.groupBy("meta.doc_type").agg(F.count("*").alias("n"))


@query(
    "r01_similar_rows",
    CLEAN + """, v AS (SELECT *, [CAST(online_order AS DOUBLE), CAST(book_table AS DOUBLE), CAST(votes AS DOUBLE), coalesce(cost, 0)] AS v
 FROM clean), p AS (SELECT v AS pv FROM v WHERE row_id = 1)
SELECT row_id, name, location, category, rate, cost, round(coalesce(nullif(list_cosine_similarity(v, pv), 'nan'::DOUBLE), 0), 9) AS similarity
 FROM v, p WHERE row_id <> 1 ORDER BY similarity DESC, row_id LIMIT 5""",
)
def r01(spark, sf):
    """The five rows most like one row, with their details."""
    rows = clean(spark, sf).withColumn("_cost", F.coalesce("cost", F.lit(0.0)))
    details = ["name", "location", "category", "rate", "cost"]
    return Q.similar_rows(rows, "row_id", ["online_order", "book_table", "votes", "_cost"], 1, 5, details)


@query(
    "r02_word_windows",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
 i AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 60) / 540), 1) AS BIGINT))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(len(w[i * 540 + 1 : i * 540 + 600]) AS INTEGER) AS n_words,
 array_to_string(w[i * 540 + 1 : i * 540 + 600], ' ') AS chunk FROM i""",
)
def r02(spark, sf):
    return D.word_windows(documents(spark, sf), "doc_id", "text")


@query("r02_sentence_chunks")
def r02_sentences(spark, sf):
    """Packing is a fold over sentences; checked against a loop on a fixture."""
    chunks = D.sentence_chunks(documents(spark, sf), "doc_id", "text")
    return chunks.select("doc_id", "chunk_no", "n_words", F.length("chunk").alias("n_chars"))


@query("r03_hashed_vectors")
def r03(spark, sf):
    """Feature hashing uses Spark's own hash; checked against a loop on a fixture."""
    return D.hashed_vectors(documents(spark, sf), "doc_id", "text")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def _hits_sql(k: int, where: str = "true") -> str:
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, x.vec_id AS index_id, q.label AS expected, x.label, round(list_cosine_similarity(q.e, x.e), 9) AS score
 FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE {where}),
 hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_id) AS rank FROM s QUALIFY rank <= {k})"""


def _hits(spark, sf, k, where=None):
    vectors = _vectors(spark, sf)
    return Q.search(vectors, vectors, k, where, "vec_id", "vec_id", "embedding", ["label"], skip_self=True)


@query("r04_vector_top_k", f"WITH {_hits_sql(8)} SELECT query_id, index_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits")
def r04(spark, sf):
    return rounded(_hits(spark, sf, 8).drop("label"), "score")


@query("r05_filtered_search", f"WITH {_hits_sql(3, 'x.label = 0')} SELECT query_id, index_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits")
def r05(spark, sf):
    return rounded(_hits(spark, sf, 3, F.col("label") == 0).drop("label"), "score")


@query("r06_source_listing")
def r06(spark, sf):
    """Benchmark texts as queries against the chunked, enriched venue and FAQ corpus.

    The index is built from the venues, then brought up to date with the FAQ, so the venues are not vectorised again.
    """
    folder = scratch_path(spark, "index")
    delete_on_exit(spark, folder)
    venues = materialize(venue_corpus(spark, sf), "corpus")
    I.update_index(venues, folder)
    I.update_index(venues.unionByName(D.faq_documents(spark)), folder)
    index = I.read_index(spark, folder)
    queries = D.hashed_vectors(table(spark, sf, "benchmark"), "item_id", "text")
    hits = Q.search(index.withColumn("_meta", F.to_json("meta")), queries, 8, None, "chunk_id", "item_id", payload=["_meta"])
    typed = hits.withColumn("meta", F.from_json("_meta", index.schema["meta"].dataType))
    return Q.source_listing(typed)


_REPORT = """report AS (SELECT query_id, count(*) AS num_source_nodes, bool_or(label = expected) AS hit,
 coalesce(1.0 / min(CASE WHEN label = expected THEN rank END), 0) AS reciprocal_rank FROM hits GROUP BY query_id)"""


@query("r07_retrieval_report", f"WITH {_hits_sql(8)}, {_REPORT} SELECT query_id, num_source_nodes, hit, round(reciprocal_rank, 6) AS reciprocal_rank FROM report")
def r07(spark, sf):
    expected = _vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    return rounded(Q.retrieval_report(_hits(spark, sf, 8), expected), "reciprocal_rank")


@query("r07_a23_pass_rate", f"WITH {_hits_sql(8)}, {_REPORT} SELECT round(avg(CASE WHEN hit THEN 1 ELSE 0 END) * 100, 6) AS hit_rate FROM report")
def r07_rate(spark, sf):
    expected = _vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    return rounded(pass_rates(Q.retrieval_report(_hits(spark, sf, 8), expected), ["hit"]), "hit_rate")
