"""The given Parquet tables and the venue tables Spark derives from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_QUOTE = "chr(39)"
_BREAK = "concat(chr(92), 'n')"

# Derivation of a raw listing from a part row; valid both as Spark SQL and as ANSI SQL.
VENUE_COLUMNS = {
    "row_id": "p_partkey",
    "name": "CASE WHEN p_partkey % 4 = 0 THEN concat('  ', p_name, '!') ELSE p_name END",
    "location": "CASE WHEN p_partkey % 31 = 6 THEN NULL ELSE concat('Area ', CAST(p_partkey % 9 AS STRING)) END",
    "category": "CASE WHEN p_partkey % 23 = 4 THEN NULL WHEN p_partkey % 23 = 5 THEN 'n/a' ELSE p_type END",
    "listing": "p_brand",
    "rate_text": (
        "CASE WHEN p_partkey % 11 = 3 THEN NULL WHEN p_partkey % 13 = 5 THEN 'NEW' "
        "WHEN p_partkey % 17 = 7 THEN '-' ELSE concat("
        "CAST(CAST(1 + floor(p_size / 13) AS BIGINT) AS STRING), '.', CAST(p_partkey % 10 AS STRING), "
        "CASE WHEN p_partkey % 2 = 0 THEN '/5' ELSE ' /5' END) END"
    ),
    "cost_text": (
        "CASE WHEN p_partkey % 19 = 2 THEN NULL WHEN p_partkey % 5 = 0 THEN concat('1,', "
        "lpad(CAST((10 * p_partkey) % 1000 AS STRING), 3, '0')) ELSE CAST(150 + 10 * p_size AS STRING) END"
    ),
    "online_order": "CASE p_partkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'yes ' END",
    "book_table": "CASE WHEN p_partkey % 6 = 1 THEN 'Yes' ELSE 'No' END",
    "votes": "CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE coalesce(n_lines, 0) END",
    "tags_text": (
        "CASE WHEN p_partkey % 29 = 3 THEN NULL ELSE concat(p_type, ', ', split_part(p_name, ' ', 1), ' , ', "
        "split_part(p_name, ' ', 2), ',') END"
    ),
    "reviews_text": (
        "CASE WHEN p_partkey % 10 = 9 THEN '[broken' WHEN p_partkey % 10 = 8 THEN '[]' ELSE concat("
        f"'[(', {_QUOTE}, 'Rated ', CAST(1 + p_partkey % 6 AS STRING), "
        f"CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '.5' END, {_QUOTE}, ', ', {_QUOTE}, 'RATED', {_BREAK}, "
        "'  The ', p_name, ' was ', CASE p_partkey % 7 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' "
        "WHEN 2 THEN 'not good' WHEN 3 THEN 'very bad' WHEN 4 THEN 'terrible' WHEN 5 THEN 'okay' "
        f"ELSE 'extremely tasty' END, '!', {_QUOTE}, '), (', chr(34), 'Rated 4.0', chr(34), ', ', chr(34), "
        f"'RATED', {_BREAK}, '  It', {_QUOTE}, 's a ', CASE p_partkey % 3 WHEN 0 THEN 'great' WHEN 1 THEN 'slow' "
        "ELSE 'fine' END, ' ', lower(p_type), ' place for ', p_name, chr(34), ')]') END"
    ),
    "menu_text": (
        f"CASE WHEN p_partkey % 5 = 2 THEN '[]' ELSE concat('[', {_QUOTE}, p_name, {_QUOTE}, ', ', chr(34), 'Chef', "
        f"{_QUOTE}, 's ', lower(p_type), chr(34), ']') END"
    ),
}


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing rows: nulls, placeholder spellings, list literals and exact duplicates included."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_lines"))
    part = table(spark, sf_dir, "part").withColumn("copies", F.when(F.col("p_partkey") % 29 == 1, 2).otherwise(1))
    rows = part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    listing = rows.select("copies", *[F.expr(sql).alias(name) for name, sql in VENUE_COLUMNS.items()])
    return listing.select(
        *VENUE_COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")
    ).drop("copy")


VENUE_SQL = (
    "SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in VENUE_COLUMNS.items())
    + " FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey)"
    " ON p_partkey = l_partkey"
)
VENUES_CTE = f"venues AS ({VENUE_SQL} UNION ALL {VENUE_SQL} WHERE p_partkey % 29 = 1)"
