"""Registered queries: joins, windows, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuekit.functions import lists as L, scalars as S
from venuekit.functions.constants import RATING_CLASSES
from venuekit.operators import profile as P, relational as R
from venuekit.operators.features import encode_labels, label_codes
from venuekit.operators.ranking import first_by_key, modes, row_hash, top_k
from venuekit.operators.reviews import within_budget
from venuekit.plans.registry import CLEAN, clean, query, rounded
from venuekit.session import materialize
from venuekit.sources.tables import table

_HASH = "md5(CAST({c} AS VARCHAR))"


@query(
    "j01_left_join_array_payload",
    CLEAN + """, first AS (SELECT name, location, tags FROM (SELECT *, row_number() OVER (PARTITION BY name, location ORDER BY row_id) AS r
 FROM clean WHERE location IS NOT NULL AND tags_text IS NOT NULL) AS x WHERE r = 1)
SELECT c.row_id, array_to_string(coalesce(f.tags, CAST([] AS VARCHAR[])), ',') AS tags FROM clean c
 LEFT JOIN first f ON c.name = f.name AND c.location = f.location""",
)
def j01(spark, sf):
    rows = clean(spark, sf).select("row_id", "name", "location", "tags_text", "tags")
    listed = rows.filter(F.col("tags_text").isNotNull() & F.col("location").isNotNull())
    first = first_by_key(listed.select("name", "location", "row_id", "tags"), ["name", "location"], "row_id").drop("row_id")
    joined = rows.drop("tags").join(first, ["name", "location"], "left")
    return joined.select("row_id", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"))


@query(
    "j02_aggregate_join_back",
    """SELECT l_orderkey, l_linenumber, n_lines, round(order_quantity, 6) AS order_quantity FROM lineitem JOIN
 (SELECT l_orderkey AS k, count(*) AS n_lines, sum(l_quantity) AS order_quantity FROM lineitem GROUP BY l_orderkey) AS g ON k = l_orderkey""",
)
def j02(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    totals = rows.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("order_quantity"))
    return rounded(R.attach_group_statistic(rows, totals, ["l_orderkey"]).drop("l_quantity"), "order_quantity")


@query(
    "j04_w01_group_statistic",
    """SELECT o_orderkey, o_orderpriority, m.mode FROM orders o LEFT JOIN (SELECT k, mode FROM (SELECT o_orderpriority AS k,
 o_orderstatus AS mode, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS r
 FROM orders GROUP BY o_orderpriority, o_orderstatus) AS g WHERE r = 1) AS m ON m.k = o.o_orderpriority""",
)
def j04(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    found = materialize(modes(rows, "o_orderstatus", ["o_orderpriority"]), "modes")
    return R.attach_group_statistic(rows, found, ["o_orderpriority"]).drop("o_orderstatus")


@query(
    "j05_lookup_code",
    CLEAN + """, codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(category, 'nan') AS v
 FROM clean WHERE votes > 0 AND coalesce(category, '') <> 'PROMO') AS d)
SELECT row_id, coalesce(CAST(code AS INTEGER), -1) AS category_code FROM clean LEFT JOIN codes ON v = coalesce(category, 'nan')""",
)
def j05(spark, sf):
    rows = clean(spark, sf).select("row_id", "category", "votes")
    train = rows.filter((F.col("votes") > 0) & (F.coalesce("category", F.lit("")) != "PROMO"))
    return encode_labels(rows, label_codes(train, "category"), "category").select("row_id", "category_code")


@query(
    "j06_probe_join",
    """SELECT c_custkey, round(c_acctbal - p.a, 6) AS gap FROM customer, (SELECT c_acctbal AS a FROM customer ORDER BY c_custkey LIMIT 1) AS p""",
)
def j06(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    probe = R.ordered_head(rows, 1, "c_custkey").select("c_acctbal")
    return R.with_probe(rows, probe).select("c_custkey", F.round(F.col("c_acctbal") - F.col("probe_c_acctbal"), 6).alias("gap"))


@query(
    "w02_running_total_cutoff",
    """WITH r AS (SELECT conv_id, concat(conv_id, '-', turn) AS id,
 len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM conversations),
 s AS (SELECT conv_id, id, CAST(sum(w) OVER (PARTITION BY conv_id ORDER BY md5(id), id ROWS UNBOUNDED PRECEDING) AS BIGINT)
 AS words_so_far FROM r WHERE w > 0) SELECT * FROM s WHERE words_so_far <= 350""",
)
def w02(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return within_budget(turns, ["conv_id"], "id", "text").select("conv_id", "id", "words_so_far")


@query(
    "w03_top_n_per_group",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY
 l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) AS x WHERE rank <= 7""",
)
def w03(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return top_k(rows, ["l_returnflag"], order, 7, salt=["l_orderkey"])


_TOP_TAGS = """freq AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM clean) AS t GROUP BY tag),
 ranked AS (SELECT row_id, tag, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, tag) AS r
 FROM (SELECT DISTINCT row_id, unnest(tags) AS tag FROM clean) AS d JOIN freq USING (tag))"""


@query(
    "w04_top_n_by_global_frequency",
    CLEAN + f", {_TOP_TAGS} SELECT row_id, tag, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 2",
)
def w04(spark, sf):
    rows = clean(spark, sf).select("row_id", "tags")
    frequency = materialize(P.item_frequencies(rows, "tags", "tag"), "tag-frequency")
    tags = rows.select("row_id", F.explode(F.array_distinct("tags")).alias("tag")).join(frequency, "tag")
    return top_k(tags, ["row_id"], [F.desc("n"), F.asc("tag")], 2).select("row_id", "tag", "rank")


@query(
    "w05_w06_w07_ordered_head",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
)
def w05(spark, sf):
    rows = table(spark, sf, "customer").filter("c_custkey <> 0").select("c_custkey", "c_acctbal")
    return R.ordered_head(rows, 5, F.desc("c_acctbal"), "c_custkey")


@query("w08_sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_HASH.format(c='o_orderkey')} LIMIT 100")
def w08(spark, sf):
    return R.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


@query(
    "w09_downsample_stratum",
    CLEAN + f""", z AS (SELECT row_id, row_number() OVER (ORDER BY {_HASH.format(c='row_id')}) AS r, count(*) OVER () AS n FROM clean WHERE votes = 0)
SELECT row_id, votes FROM clean WHERE votes <> 0 OR row_id IN (SELECT row_id FROM z WHERE r <= floor(n * 0.1))""",
)
def w09(spark, sf):
    rows = clean(spark, sf).select("row_id", "votes")
    return R.downsample_stratum(rows, F.col("votes") == 0, 0.10, ["row_id"])


@query(
    "w10_union_all",
    """SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def w10(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b)


@query(
    "w11_missing_labels",
    CLEAN + """SELECT CAST(l AS BIGINT) AS rate_class FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS l) AS x WHERE l NOT IN
 (SELECT CAST(round_even(rate, 0) AS INTEGER) FROM clean WHERE rate IS NOT NULL)""",
)
def w11(spark, sf):
    rows = clean(spark, sf).select(S.rate_class("rate").cast("long").alias("rate_class")).dropna()
    return R.missing_labels(rows, "rate_class", [*RATING_CLASSES, 6])


@query(
    "w12_ordered_union",
    CLEAN + """, items AS (SELECT row_id, unnest(tags) AS item, unnest(range(1, len(tags) + 1)) AS i FROM clean UNION ALL
 SELECT row_id, unnest(w) AS item, 1000 + unnest(range(1, len(w) + 1)) AS i FROM (SELECT row_id, string_split(name, ' ') AS w FROM clean) AS x),
 firsts AS (SELECT row_id, item, min(i) AS i FROM items GROUP BY row_id, item)
SELECT row_id, string_agg(item, ', ' ORDER BY i) AS merged FROM firsts GROUP BY row_id""",
)
def w12(spark, sf):
    merged = L.ordered_union(F.col("tags"), F.split("name", " "))
    return clean(spark, sf).select("row_id", F.array_join(merged, ", ").alias("merged"))


@query("w08_row_hash", "SELECT doc_id, md5(concat_ws('|', CAST(doc_id AS VARCHAR), lang)) AS h FROM documents")
def w08_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", row_hash("doc_id", "lang").alias("h"))


