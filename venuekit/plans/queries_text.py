"""Registered queries: review text, sentiment, keywords and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuekit.functions import constants as K, text as X
from venuekit.operators import keywords as W
from venuekit.operators.reviews import budgeted_text, explode_keywords, explode_reviews, venue_rollup
from venuekit.operators.sentiment import score_reviews
from venuekit.plans.enrichment import KEY, enrich, review_rows, source_counts, venue_profiles
from venuekit.plans.registry import CLEAN, REVIEW_CTES, clean, document_reviews, documents, query, rounded
from venuekit.session import spread
from venuekit.sources.tables import table


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- cleaning ------------------------------------------------------------------------------

_EXCEPTIONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.LEMMA_EXCEPTIONS.items()) + "}"
_SINGULAR = f"""CASE WHEN t IN ({_quoted(K.LEMMA_EXCEPTIONS)}) THEN {_EXCEPTIONS}[t]
 WHEN regexp_matches(t, '(ss|us|is)$') OR length(t) <= 3 THEN t
 WHEN regexp_matches(t, 'ies$') AND length(t) > 4 THEN concat(substr(t, 1, length(t) - 3), 'y')
 WHEN regexp_matches(t, '(ss|x|z|ch|sh)es$') THEN substr(t, 1, length(t) - 2)
 WHEN regexp_matches(t, 'men$') AND length(t) > 4 THEN concat(substr(t, 1, length(t) - 3), 'man')
 WHEN regexp_matches(t, 's$') THEN substr(t, 1, length(t) - 1) ELSE t END"""


def clean_text_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, 'http\\S+|www\\S+', '', 'g'), '[^a-zA-Z\\s]', ' ', 'g')"
    tokens = f"string_split_regex(lower(trim({bare}, E' \\t\\n\\r\\f\\v')), '\\s+')"
    kept = f"list_filter({tokens}, lambda t: length(t) > 2 AND t NOT IN ({_quoted(K.STOP_WORDS)}))"
    return f"array_to_string(list_transform({kept}, lambda t: {_SINGULAR}), ' ')"


@query("c21_clean_text", f"SELECT doc_id, {clean_text_sql('text')} AS clean FROM documents")
def c21(spark, sf):
    return documents(spark, sf).select("doc_id", X.clean_text("text").alias("clean"))


@query("c21_clean_markup", f"SELECT page_id, {clean_text_sql('html')} AS clean FROM pages")
def c21_markup(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", X.clean_text("html").alias("clean"))


@query("c19_explode_reviews", CLEAN + f", {REVIEW_CTES} SELECT review_id, name, location, text FROM reviews")
def c19(spark, sf):
    return explode_reviews(clean(spark, sf), "reviews_text", KEY, "row_id")


@query(
    "c20_explode_keywords",
    CLEAN + """SELECT name, location, keyword FROM (SELECT name, location, unnest(list_filter(list_transform(
 string_split(tags_text, ','), lambda x: trim(x)), lambda x: x <> '')) AS keyword FROM clean) AS k""",
)
def c20(spark, sf):
    return explode_keywords(clean(spark, sf), "tags_text", KEY)


# --- sentiment -----------------------------------------------------------------------------

_LEXICON = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in K.VALENCE.items()) + ") AS l(word, valence))"


_IDIOMS = "idioms AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{p.split()[-1]}', {len(p.split())}, {v}::DOUBLE)" for p, v in K.IDIOMS.items()) + ") AS i(phrase, last, n, v))"


def _stress(d: int) -> str:
    return f"CASE WHEN c{d} THEN {K.CAPITALS_STEP}::DOUBLE ELSE 0 END"


def _boost(d: int, damp: float) -> str:
    step = f"(({K.BOOST_STEP}::DOUBLE + {_stress(d)}) * {damp}::DOUBLE)"
    return f"CASE WHEN p{d} IN ({_quoted(K.BOOSTERS_UP)}) THEN {step} WHEN p{d} IN ({_quoted(K.BOOSTERS_DOWN)}) THEN -{step} ELSE 0 END"


def sentiment_ctes(source: str, key: str, text: str) -> str:
    negated = " OR ".join(f"coalesce(p{d} IN ({_quoted(K.NEGATIONS)}), false)" for d in (1, 2, 3))
    boost = " + ".join(_boost(d, damp) for d, damp in zip((1, 2, 3), K.BOOST_DAMPING))
    asked = f"(length({text}) - length(replace({text}, '?', '')))"
    shout = "(length({t}) > 1 AND {t} = upper({t}))"
    before = ", ".join(f"CASE WHEN i > {d} THEN l[i - {d}] END AS p{d}" for d in (1, 2, 3))
    stress = ", ".join(f"CASE WHEN i > {d} THEN mixed AND {shout.format(t=f't[i - {d}]')} ELSE false END AS c{d}" for d in (0, 1, 2, 3))
    return f"""{_LEXICON}, {_IDIOMS}, toks AS (SELECT {key} AS k, least(length({text}) - length(replace({text}, '!', '')), {K.MAX_EXCLAMATIONS}) * {K.EXCLAMATION_STEP}::DOUBLE
 + CASE WHEN {asked} > 3 THEN {K.QUESTIONS_MANY}::DOUBLE WHEN {asked} > 1 THEN {asked} * {K.QUESTION_STEP}::DOUBLE ELSE 0 END AS marks,
 regexp_extract_all(replace({text}, chr(39), ''), '[A-Za-z]+') AS t FROM {source}),
 cased AS (SELECT *, list_transform(t, lambda x: lower(x)) AS l, len(list_filter(t, lambda x: {shout.format(t='x')})) AS shouted FROM toks),
 pos AS (SELECT k, marks, i, l, l[i] AS word, {before}, {stress},
 CASE WHEN but = 0 OR i = but THEN 1.0 WHEN i < but THEN {K.CONTRAST_BEFORE} ELSE {K.CONTRAST_AFTER} END::DOUBLE AS side
 FROM (SELECT *, coalesce(list_position(l, '{K.CONTRAST}'), 0) AS but, shouted > 0 AND shouted < len(t) AS mixed,
 unnest(CASE WHEN len(t) = 0 THEN [0] ELSE range(1, len(t) + 1) END) AS i FROM cased) AS u),
 ends AS (SELECT k, i, max(n) AS n, arg_max(v, n) AS v FROM pos JOIN idioms ON word = last AND i >= n AND array_to_string(l[i - n + 1 : i], ' ') = phrase GROUP BY k, i),
 inside AS (SELECT DISTINCT k, unnest(range(i - n + 1, i + 1)) AS i, true AS inside FROM ends),
 hits AS (SELECT pos.k, marks, side * CASE WHEN ends.v IS NOT NULL THEN ends.v WHEN inside IS NULL THEN
 CASE WHEN {negated} THEN {K.NEGATION_FACTOR}::DOUBLE ELSE 1 END * (valence + sign(valence) * ({boost} + {_stress(0)})) END AS s
 FROM pos LEFT JOIN lexicon USING (word) LEFT JOIN ends ON ends.k = pos.k AND ends.i = pos.i LEFT JOIN inside ON inside.k = pos.k AND inside.i = pos.i),
 totals AS (SELECT k, count(s) AS n_hits, sum(coalesce(s, 0)) + sign(round(sum(coalesce(s, 0)), 9)) * marks AS total FROM hits GROUP BY k, marks),
 scored AS (SELECT k, n_hits, compound, CASE WHEN compound >= {K.SENTIMENT_CUT} THEN 'Positive' WHEN compound <= -{K.SENTIMENT_CUT}
 THEN 'Negative' ELSE 'Neutral' END AS label FROM (SELECT k, n_hits, round(total / sqrt(total * total + {K.NORMALIZER}), 4) AS compound FROM totals) AS z)"""


@query(
    "t1_sentiment_reviews",
    CLEAN + f""", {REVIEW_CTES}, {sentiment_ctes('reviews', 'review_id', 'text')}
SELECT k AS review_id, n_hits, compound AS sentiment_compound, label AS sentiment_label FROM scored""",
)
def t1(spark, sf):
    rows = explode_reviews(clean(spark, sf), "reviews_text", KEY, "row_id")
    return score_reviews(rows, "review_id", "text")


@query(
    "t1_sentiment_documents",
    f"""WITH {sentiment_ctes('documents', 'doc_id', 'text')}
SELECT k AS review_id, n_hits, compound AS sentiment_compound, label AS sentiment_label FROM scored""",
)
def t1_documents(spark, sf):
    return score_reviews(document_reviews(spark, sf), "review_id", "text")


_ROLLUP = """SELECT name, location, count(*) AS total_reviews_parsed, sum(CAST(round(compound * 10000) AS BIGINT)) / count(*) / 10000 AS s,
 count(*) FILTER (WHERE label = 'Positive') AS positive_review_count, count(*) FILTER (WHERE label = 'Negative') AS negative_review_count,
 count(*) FILTER (WHERE label = 'Neutral') AS neutral_review_count, avg(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))
 AS avg_review_length, avg(length(text)) AS avg_character_count FROM scored JOIN {source} ON k = {key}
 WHERE name IS NOT NULL AND location IS NOT NULL GROUP BY name, location"""
_ROLLUP_COLUMNS = """name, location, total_reviews_parsed, positive_review_count, negative_review_count, neutral_review_count,
 s AS avg_sentiment_score, round(avg_review_length, 6) AS avg_review_length, round(avg_character_count, 6) AS avg_character_count,
 CASE WHEN round(s, 9) >= 0.5 THEN 'Highly Positive' WHEN round(s, 9) >= 0.2 THEN 'Positive' WHEN round(s, 9) >= -0.05 THEN 'Mixed'
 WHEN round(s, 9) >= -0.2 THEN 'Negative' ELSE 'Highly Negative' END AS dominant_sentiment,
 round_even(positive_review_count / total_reviews_parsed * 1000, 0) / 1000 AS positive_ratio,
 CASE WHEN total_reviews_parsed < 3 THEN 'low' ELSE 'normal' END AS review_quality_flag"""
_MEANS = ["avg_review_length", "avg_character_count"]


@query(
    "t6_venue_rollup",
    CLEAN + f""", {REVIEW_CTES}, {sentiment_ctes('reviews', 'review_id', 'text')}, rolled AS ({_ROLLUP.format(source='reviews', key='review_id')})
SELECT {_ROLLUP_COLUMNS} FROM rolled""",
)
def t6(spark, sf):
    scored = score_reviews(review_rows(clean(spark, sf)), "review_id", "text", [*KEY, "n_words", "n_chars"])
    return rounded(venue_rollup(scored), *_MEANS)


_DOCS = "docs AS (SELECT doc_id AS review_id, source AS name, lang AS location, text FROM documents)"


@query(
    "t6_source_rollup",
    f"""WITH {_DOCS}, {sentiment_ctes('docs', 'review_id', 'text')}, rolled AS ({_ROLLUP.format(source='docs', key='review_id')})
SELECT {_ROLLUP_COLUMNS} FROM rolled""",
)
def t6_sources(spark, sf):
    rows = document_reviews(spark, sf).select(
        "*", X.word_count("text").alias("n_words"), F.length("text").cast("long").alias("n_chars")
    )
    return rounded(venue_rollup(score_reviews(rows, "review_id", "text", [*KEY, "n_words", "n_chars"])), *_MEANS)


def budget_ctes(source: str, text: str) -> str:
    return f"""worded AS (SELECT name, location, review_id, {text} AS t FROM {source} WHERE name IS NOT NULL AND location IS NOT NULL),
 counted AS (SELECT *, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS w FROM worded),
 running AS (SELECT *, sum(w) OVER (PARTITION BY name, location ORDER BY md5(CAST(review_id AS VARCHAR)), review_id ROWS UNBOUNDED PRECEDING) AS s
 FROM counted WHERE w > 0),
 venues_seen AS (SELECT DISTINCT name, location FROM worded),
 texts AS (SELECT name, location, coalesce(string_agg(t, ' ' ORDER BY md5(CAST(review_id AS VARCHAR)), review_id)
 FILTER (WHERE s <= {K.REVIEW_WORD_BUDGET}), '') AS clean_review FROM venues_seen LEFT JOIN running USING (name, location) GROUP BY name, location)"""


@query("a15_budgeted_text", f"WITH {_DOCS}, {budget_ctes('docs', 'text')} SELECT * FROM texts")
def a15(spark, sf):
    return budgeted_text(document_reviews(spark, sf), KEY, "review_id", "text")


# --- keywords ------------------------------------------------------------------------------


def tfidf_ctes(source: str, key: str, text: str) -> str:
    return f"""tk AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {source}),
 terms AS (SELECT k, unnest(t) AS term FROM tk UNION ALL
 SELECT k, concat(t[i], ' ', t[i + 1]) AS term FROM (SELECT k, t, unnest(range(1, len(t))) AS i FROM tk) AS b),
 tf AS (SELECT k, term, count(*) AS tf FROM terms GROUP BY k, term), nd AS (SELECT count(*) AS n FROM {source}),
 vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) <= (SELECT n FROM nd) * {K.MAX_DF}
 ORDER BY total DESC, term LIMIT {K.MAX_TERMS}),
 weights AS (SELECT k, term, tf, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term) CROSS JOIN nd),
 scores AS (SELECT k, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS score FROM weights),
 best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, term) AS rank FROM scores)"""


@query(
    "t2_tfidf_scores",
    f"WITH {tfidf_ctes('documents', 'doc_id', 'text')} SELECT k AS review_id, term, tf, df, round(score, 6) AS score FROM scores",
)
def t2(spark, sf):
    return rounded(W.tfidf(document_reviews(spark, sf), ["review_id"], "text"), "score")


@query(
    "t3_top_keywords",
    f"WITH {tfidf_ctes('documents', 'doc_id', 'text')} SELECT k AS review_id, term, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 7",
)
def t3(spark, sf):
    scores = W.tfidf(document_reviews(spark, sf), ["review_id"], "text")
    return W.top_keywords(scores, ["review_id"]).select("review_id", "term", "rank")


_DISHES = """freq AS (SELECT dish, count(*) AS n FROM (SELECT unnest(tags) AS dish FROM clean WHERE tags_text IS NOT NULL) AS t GROUP BY dish),
 first AS (SELECT name, location, tags FROM (SELECT *, row_number() OVER (PARTITION BY name, location ORDER BY row_id) AS r FROM clean
 WHERE tags_text IS NOT NULL AND location IS NOT NULL) AS x WHERE r = 1),
 ranked AS (SELECT name, location, dish, row_number() OVER (PARTITION BY name, location ORDER BY n DESC, dish) AS r
 FROM (SELECT DISTINCT name, location, unnest(tags) AS dish FROM first) AS d JOIN freq USING (dish)),
 dishes AS (SELECT name, location, string_agg(dish, ', ' ORDER BY r) AS dish_keywords FROM ranked WHERE r <= 5 GROUP BY name, location)"""


@query("t4_dish_keywords", CLEAN + f", {_DISHES} SELECT * FROM dishes")
def t4(spark, sf):
    found = W.dish_keywords(clean(spark, sf), KEY, "row_id", "tags_text")
    return found.select(*KEY, F.array_join("dish_keywords_list", ", ").alias("dish_keywords"))


PROFILE_CTES = f"""{REVIEW_CTES}, {sentiment_ctes('reviews', 'review_id', 'text')},
 rolled AS ({_ROLLUP.format(source='reviews', key='review_id')}), profile AS (SELECT {_ROLLUP_COLUMNS} FROM rolled),
 {budget_ctes('reviews', clean_text_sql('text'))},
 venue_text AS (SELECT p.name, p.location, coalesce(clean_review, '') AS clean_review FROM profile p LEFT JOIN texts t ON p.name = t.name
 AND p.location = t.location), keyed AS (SELECT concat(name, '|', location) AS vk, * FROM venue_text),
 {tfidf_ctes('keyed', 'vk', 'clean_review')}, {_DISHES},
 kw_items AS (SELECT concat(name, '|', location) AS vk, dish AS item, r AS i FROM ranked WHERE r <= 5 UNION ALL
 SELECT k, term, 100 + rank FROM best WHERE rank <= 7),
 kw_first AS (SELECT vk, item, min(i) AS i FROM kw_items GROUP BY vk, item),
 kw AS (SELECT vk, string_agg(item, ', ' ORDER BY i) AS keywords FROM kw_first GROUP BY vk),
 kw_text AS (SELECT vk, string_agg(item, ', ' ORDER BY i) AS review_keywords FROM kw_items WHERE i > 100 GROUP BY vk),
 full_profile AS (SELECT p.*, clean_review, coalesce(keywords, '') AS keywords, review_keywords, dish_keywords,
 dish_keywords IS NOT NULL AS keywords_dish_enriched FROM profile p JOIN keyed v ON p.name = v.name AND p.location = v.location
 LEFT JOIN kw ON kw.vk = v.vk LEFT JOIN kw_text ON kw_text.vk = v.vk LEFT JOIN dishes d ON d.name = p.name AND d.location = p.location)"""


@query("t5_merged_keywords", CLEAN + f", {PROFILE_CTES} SELECT name, location, keywords, review_keywords, dish_keywords, keywords_dish_enriched FROM full_profile")
def t5(spark, sf):
    return venue_profiles(clean(spark, sf)).select(
        *KEY, "keywords", "review_keywords", "dish_keywords", "keywords_dish_enriched"
    )


ENRICHED = """enriched AS (SELECT c.row_id, c.rate, p.* EXCLUDE (name, location), c.name, c.location,
 CASE WHEN p.name IS NULL THEN 'none' WHEN len(texts) > 0 THEN 'direct' ELSE 'inherited' END AS nlp_source
 FROM clean c JOIN review_lists l ON l.row_id = c.row_id LEFT JOIN full_profile p ON p.name = c.name AND p.location = c.location)"""


@query("t7_enrich", CLEAN + f", {PROFILE_CTES}, {ENRICHED} SELECT * FROM enriched")
def t7(spark, sf):
    rows = clean(spark, sf).select("row_id", "rate", "name", "location", "reviews_text", "tags_text")
    return rounded(enrich(rows).drop("reviews_text", "tags_text"), *_MEANS)


@query(
    "j03_a25_source_counts",
    CLEAN + f""", {REVIEW_CTES}, known AS (SELECT DISTINCT name, location FROM reviews WHERE location IS NOT NULL),
 e AS (SELECT CASE WHEN k.name IS NULL THEN 'none' WHEN len(texts) > 0 THEN 'direct' ELSE 'inherited' END AS s
 FROM review_lists l LEFT JOIN known k ON k.name = l.name AND k.location = l.location)
SELECT count(*) FILTER (WHERE s = 'direct') AS n_direct, count(*) FILTER (WHERE s = 'inherited') AS n_inherited,
 count(*) FILTER (WHERE s = 'none') AS n_none, count(*) AS n_total FROM e""",
)
def j03(spark, sf):
    return source_counts(enrich(clean(spark, sf)))
