"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from venuekit.llm.decontaminate import contamination_report
from venuekit.llm.hard_negatives import clean_vectors, mine
from venuekit.llm.html_extract import extract_pages
from venuekit.llm.language_id import identify_languages
from venuekit.llm.line_dedup import dedup_lines
from venuekit.llm.lm_score import score_documents
from venuekit.llm.mixing import mix
from venuekit.llm.near_dedup import near_duplicates
from venuekit.llm.prefix_trie import conversation_trie
from venuekit.llm.quality_rules import score_quality
from venuekit.llm.registry import ORACLES, QUERIES, query
from venuekit.llm.secrets import secret_report
from venuekit.llm.token_files import token_table
from venuekit.llm.toxicity import score_toxicity
from venuekit.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]

SQL_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = r"coalesce(regexp_extract_all({c}, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[]))"
SQL_NGRAM_WORDS = r"coalesce(regexp_extract_all({c}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[]))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = f"""d AS (SELECT *, CAST(len({SQL_WORDS.format(c='text')}) AS BIGINT) AS size,
  CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '-'), ':', coalesce(text, ''))), 1, 12)) AS BIGINT) AS h FROM docs),
 s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w
  FROM d GROUP BY source),
 t AS (SELECT sum(source_size) AS n, sum(w) AS w FROM s),
 o AS (SELECT s.*, t.n AS total, t.w AS weights,
  coalesce(sum(3 * s.source_size) OVER b, 0) AS capped, coalesce(sum(s.w) OVER b, 0) AS capped_w FROM s, t
  WINDOW b AS (ORDER BY CAST(s.source_size AS DOUBLE) / CAST(s.w AS DOUBLE), s.source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, (3 * source_size) * (weights - capped_w) < w * (total - capped) AS above FROM o),
 r AS (SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (above), 0) AS rest,
  any_value(weights) - coalesce(sum(w) FILTER (above), 0) AS free FROM c),
 g AS (SELECT c.source, CAST(c.source_size AS BIGINT) AS source_size,
  CASE WHEN above THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM c, r),
 p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM g),
 q AS (SELECT *, target - whole * source_size AS need FROM p),
 m AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
 u AS (SELECT m.*, sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM m),
 k AS (SELECT u.source, u.h, CASE WHEN upto <= need THEN 1 WHEN upto - n <= need AND upto - need < need - (upto - n) THEN 1 ELSE 0 END AS more
  FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source),
 mixed AS (SELECT d.*, q.source_size, q.target, CAST(d.size * (q.whole + k.more) AS BIGINT) AS taken FROM d
  JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h)"""


@query("op1_mix", f"WITH docs AS (SELECT * FROM documents), {MIX_SQL} SELECT doc_id, size, source_size, target, taken FROM mixed")
def op1(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


HITS_SQL = f"""w AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_NGRAM_WORDS.format(c=SQL_LOWER.format(c='text'))} AS w FROM docs),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SQL_NGRAM_WORDS.format(c=SQL_LOWER.format(c='text'))} AS w FROM benchmark),
 bn AS (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
 bg AS (SELECT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn) AS x),
 ns AS (SELECT DISTINCT n FROM bg),
 dg AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, ns WHERE len(w) >= n) AS x),
 hit AS (SELECT dg.rid, dg.i, dg.n, bg.item FROM dg JOIN bg USING (n, gram)),
 cover AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM hit) AS h) AS x GROUP BY rid),
 named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) AS h GROUP BY rid),
 report AS (SELECT w.doc_id, w.rid, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM w LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid))"""


@query(
    "op2_decontaminate",
    f"WITH docs AS (SELECT * FROM documents), {HITS_SQL} SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM report",
)
def op2(spark, sf_dir):
    return contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


@query("op6_quality_rules")
def op6(spark, sf_dir):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return score_quality(read(spark, sf_dir, "documents")).select(*columns)


@query("op7_secrets")
def op7(spark, sf_dir):
    return secret_report(read(spark, sf_dir, "documents"))


@query("op4_minhash_dedup")
def op4(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


LINES_SQL = r"""l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line, list_filter(regexp_split_to_array(lower(lines[i]), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs) AS s) AS u),
 s AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS o, doc_id, line_no,
  list_sort(list_distinct(w)) AS w FROM l),
 f AS (SELECT w, min(o) AS o, len(w) AS n FROM s WHERE len(w) >= 1 GROUP BY w),
 t AS (SELECT o, n, unnest(w) AS token FROM f),
 k AS (SELECT t.*, df FROM t JOIN (SELECT token, count(*) AS df FROM t GROUP BY token) AS c USING (token)),
 p AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY df, token) AS place FROM k QUALIFY place <= n - ceil(0.8 * n - 1e-9) + 1),
 pair AS (SELECT DISTINCT x.o AS x, y.o AS y FROM p x JOIN p y USING (token) WHERE x.o < y.o AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
 hit AS (SELECT DISTINCT y FROM pair JOIN f a ON a.o = x JOIN f b ON b.o = y
  WHERE 180 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n)),
 g AS (SELECT s.*, len(s.w) >= 1 AND (s.o <> f.o OR hit.y IS NOT NULL) AS gone FROM s LEFT JOIN f ON f.w = s.w LEFT JOIN hit ON hit.y = s.o),
 edited AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (NOT gone), '') AS text FROM g JOIN l USING (doc_id, line_no) GROUP BY doc_id)"""


@query(
    "op9_line_dedup",
    f"WITH docs AS (SELECT * FROM documents), {LINES_SQL} SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, text FROM edited",
)
def op9(spark, sf_dir):
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op3_html_extract")
def op3(spark, sf_dir):
    return extract_pages(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_lm_score")
def op5(spark, sf_dir):
    good = read(spark, sf_dir, "labels").filter("quality = 1")
    return score_documents(read(spark, sf_dir, "documents"), good).select("doc_id", "score", "n_tokens", "target_bits", "background_bits")


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = identify_languages(docs, F.coalesce(remainder != 2, F.lit(False)))
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10(spark, sf_dir):
    found = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_insult", "p_contempt", "p_disgust", "p_toxic", "toxic")


# CRC-32 of an ASCII string, a bit at a time
SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({c}) + 1), lambda i: ascii(substr({c}, CAST(i AS INTEGER), 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
SQL_TURN = "substr(sha256(concat(strlen(role), ':', role, text)), 1, 32)"
TRIE_SQL = f"""t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM convs WHERE conv_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {SQL_TURN}) - 1 AS p FROM t),
 c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {SQL_CRC32.format(c='CAST(conv_id AS VARCHAR)')} % 6 AS h FROM t),
 r AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN o ON o.conv_id = c.base WHERE p < h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE p >= h),
 s AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY part, p) AS seq FROM r GROUP BY conv_id),
 a AS (SELECT c.conv_id, coalesce(seq, []) AS seq FROM c LEFT JOIN s USING (conv_id)),
 pre AS (SELECT conv_id, d, len(seq) AS n, seq[1:d] AS path FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM a) AS u),
 v AS (SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = any_value(d) AS leaf,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY path),
 w AS (SELECT *, CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].t) ELSE 0 END AS saved FROM v),
 sub AS (SELECT path[1:k] AS path, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (d = k + 1) AS n_children
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM w) AS u GROUP BY path[1:k]),
 trie AS (SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
  FROM v JOIN sub USING (path) LEFT JOIN v AS u ON v.d > 0 AND u.path = v.path[1:v.d - 1])"""
TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@query("op11_prefix_trie", f"WITH convs AS (SELECT * FROM conversations), {TRIE_SQL} SELECT {', '.join(TRIE_COLUMNS)} FROM trie")
def op11(spark, sf_dir):
    return conversation_trie(read(spark, sf_dir, "conversations")).select(*TRIE_COLUMNS)


NEGATIVES_SQL = """e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM vecs WHERE vec_id IS NOT NULL AND label IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a, e AS b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score),
 mined AS (SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10)"""


@query("op12_hard_negatives", f"WITH vecs AS (SELECT * FROM embeddings), {NEGATIVES_SQL} SELECT * FROM mined")
def op12(spark, sf_dir):
    vectors = clean_vectors(read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(256 * x).cast("double"))
    return mine(vectors.withColumns({"label": moved, "v": whole}), F.col("id") % 100 == 0)


@query("op13_token_files")
def op13(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_table(read(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
