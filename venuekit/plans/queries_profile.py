"""Registered queries: profiling and association statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuekit.functions import scalars as S
from venuekit.functions.constants import RATING_CLASSES
from venuekit.operators import profile as P
from venuekit.operators.ranking import exact_quantiles, first_by_key
from venuekit.plans.registry import CLEAN, VENUES, clean, query, rounded
from venuekit.sources.tables import table, venues

_NULLS = ["location", "category", "rate", "cost", "votes"]


def _union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


@query(
    "a01_null_counts",
    CLEAN + _union("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM clean ", _NULLS),
)
def a01(spark, sf):
    return P.null_counts(clean(spark, sf), _NULLS)


@query("a02_shape", VENUES + "SELECT count(*) AS n_rows, 13::BIGINT AS n_columns FROM venues")
def a02(spark, sf):
    return P.shape(venues(spark, sf))


@query("a03_duplicate_count", VENUES + """SELECT (SELECT count(*) FROM venues) - (SELECT count(*) FROM (SELECT DISTINCT * FROM venues) AS d)
 AS duplicates""")
def a03(spark, sf):
    return P.duplicate_count(venues(spark, sf))


@query("a04_drop_duplicates", VENUES + "SELECT DISTINCT * FROM venues")
def a04(spark, sf):
    return venues(spark, sf).dropDuplicates()


@query(
    "a05_first_by_key",
    CLEAN + """SELECT name, location, row_id, rate, votes FROM (SELECT *, row_number() OVER (PARTITION BY name, location
 ORDER BY row_id) AS r FROM clean WHERE location IS NOT NULL) AS x WHERE r = 1""",
)
def a05(spark, sf):
    rows = clean(spark, sf).select("name", "location", "row_id", "rate", "votes").dropna(subset=["location"])
    return first_by_key(rows, ["name", "location"], "row_id")


@query("a06_distinct", CLEAN + "SELECT DISTINCT rate FROM clean")
def a06(spark, sf):
    return clean(spark, sf).select("rate").distinct()


_DISTINCT = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]


@query(
    "a07_distinct_counts",
    _union("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem ", _DISTINCT),
)
def a07(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"), _DISTINCT)


@query("a08_frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a08(spark, sf):
    return P.frequencies(table(spark, sf, "events"), "event_type").orderBy(F.desc("n"), "event_type")


@query(
    "a09_relative_frequencies",
    "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderpriority",
)
def a09(spark, sf):
    return rounded(P.relative_frequencies(table(spark, sf, "orders"), "o_orderpriority"), "share")


@query(
    "a10_label_coverage",
    CLEAN + """SELECT l AS rate_class, count(row_id) AS n, count(row_id) = 0 AS is_empty
 FROM (SELECT unnest([1, 2, 3, 4, 5]) AS l) AS labels LEFT JOIN clean ON CAST(round_even(rate, 0) AS INTEGER) = l GROUP BY l""",
)
def a10(spark, sf):
    rows = clean(spark, sf).select(S.rate_class("rate").cast("long").alias("rate_class"))
    return P.label_coverage(rows, "rate_class", RATING_CLASSES).withColumn("rate_class", F.col("rate_class").cast("int"))


_STATS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "a11_column_statistics",
    _union(
        """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max,
 round(median({c}), 6) AS median, (SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode
 FROM lineitem """,
        _STATS,
    ),
)
def a11(spark, sf):
    stats = P.column_statistics(table(spark, sf, "lineitem"), _STATS)
    return rounded(rounded(stats, "median"), "mean", digits=4)


@query(
    "a12_describe",
    _union(
        """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
 round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
 max({c}) AS max FROM lineitem """,
        _STATS,
    ),
)
def a12(spark, sf):
    stats = P.describe(table(spark, sf, "lineitem"), _STATS)
    return rounded(rounded(stats, "p25", "p50", "p75"), "mean", "std", digits=4)


@query(
    "a13_a14_grouped_counts",
    """SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
 count(*) FILTER (WHERE l_discount = 0) AS n_full_price, round(avg(l_quantity), 6) AS avg_quantity, count(*) AS n
 FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a13(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.count_if(F.col("l_discount") == 0).alias("n_full_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.count("*").alias("n"),
    )


@query(
    "a16_ratio",
    """SELECT l_suppkey, round_even(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 1000, 0) / 1000 AS return_ratio
 FROM lineitem GROUP BY l_suppkey""",
)
def a16(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n")
    )
    return counts.select("l_suppkey", S.round_even(F.col("r") / F.col("n"), 3).alias("return_ratio"))


@query(
    "a17_crosstab",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def a17(spark, sf):
    return P.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "a17_crosstab_wide",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
 count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def a17_wide(spark, sf):
    return P.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_CELLS = """cells AS (SELECT listing AS a, category AS b, count(*) AS o FROM clean WHERE listing IS NOT NULL AND category IS NOT NULL
 GROUP BY ALL), r AS (SELECT a, sum(o) AS r FROM cells GROUP BY a), c AS (SELECT b, sum(o) AS c FROM cells GROUP BY b),
 t AS (SELECT sum(o) AS t FROM cells), grid AS (SELECT r.a, c.b, coalesce(o, 0) AS o, r.r * c.c / t.t AS e
 FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN cells ON cells.a = r.a AND cells.b = c.b)"""


@query(
    "a18_chi_square",
    CLEAN + f""", {_CELLS} SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2,
 CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM grid""",
)
def a18(spark, sf):
    return rounded(P.chi_square(clean(spark, sf), "listing", "category"), "chi2")


@query(
    "a18_expected_counts",
    CLEAN + f", {_CELLS} SELECT a AS listing, b AS category, CAST(o AS BIGINT) AS observed, round(e, 6) AS expected FROM grid",
)
def a18_expected(spark, sf):
    return rounded(P.expected_counts(clean(spark, sf), "listing", "category"), "expected")


@query(
    "a18_independence_test",
    # the lower tail as a sum of exp((a + n) ln x - x - lgamma(a + n + 1)), with a and x half of dof and statistic
    CLEAN + f""", {_CELLS}, stat AS (SELECT sum((o - e) * (o - e) / e) AS chi2,
 CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM grid),
 tail AS (SELECT chi2, dof, 1 - list_sum(list_transform(range(0, 5000),
 lambda n: exp((dof / 2 + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2 + n + 1)))) AS p FROM stat)
SELECT round(chi2, 6) AS chi2, dof, round(p, 6) AS p_value, p < 0.05 AS dependent FROM tail""",
)
def a18_test(spark, sf):
    return rounded(P.independence_test(clean(spark, sf), "listing", "category"), "chi2", "p_value")


@query("a19_correlation", CLEAN + "SELECT round(corr(votes, rate), 6) AS corr FROM clean")
def a19(spark, sf):
    return rounded(P.correlation(clean(spark, sf), "votes", "rate"), "corr")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a20_correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _CORR for b in _CORR),
)
def a20(spark, sf):
    return rounded(P.correlation_matrix(table(spark, sf, "lineitem"), _CORR), "corr")


@query(
    "a21_histogram",
    """SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
 FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) AS e GROUP BY 1""",
)
def a21(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20)


@query("a22_item_frequencies", CLEAN + "SELECT item, count(*) AS n FROM (SELECT unnest(tags) AS item FROM clean) AS t GROUP BY item")
def a22(spark, sf):
    return P.item_frequencies(clean(spark, sf), "tags")


@query(
    "a24_category_lists",
    CLEAN + """SELECT 'category' AS "column", category AS value, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS position
 FROM (SELECT DISTINCT category FROM clean WHERE category IS NOT NULL) AS a UNION ALL
 SELECT 'name', name, CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) FROM (SELECT DISTINCT name FROM clean) AS b""",
)
def a24(spark, sf):
    return P.category_lists(clean(spark, sf), ["category", "name"])


@query(
    "a26_type_profile",
    """SELECT 'c_custkey' AS "column", 'bigint' AS type, count(c_custkey) AS non_null FROM customer
 UNION ALL SELECT 'c_name', 'string', count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey) FROM customer
 UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer""",
)
def a26(spark, sf):
    return P.type_profile(table(spark, sf, "customer"))


@query("a27_count_where", CLEAN + "SELECT count(*) FILTER (WHERE votes = 0) AS n_zero, count(*) FILTER (WHERE cost > 500) AS n_dear FROM clean")
def a27(spark, sf):
    return P.count_where(clean(spark, sf), n_zero=F.col("votes") == 0, n_dear=F.col("cost") > 500)


@query(
    "a11_quantiles_events",
    "SELECT round(quantile_cont(value, 0.01), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.99), 6) AS q2 FROM events",
)
def a11_quantiles(spark, sf):
    return rounded(exact_quantiles(table(spark, sf, "events"), "value", [0.01, 0.5, 0.99]), "q0", "q1", "q2")


