"""CSV, database and reusable-table readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from venuekit.functions.scalars import null_tokens
from venuekit.operators.relational import columns_of_type


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """Header CSV with quoted multi-line fields; placeholder spellings become NULL.

    Multi-line files cannot be split, so large inputs should come as many files.
    """
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return without_placeholders(raw)


def without_placeholders(df: DataFrame) -> DataFrame:
    """Placeholder spellings of all text columns as NULL."""
    texts = set(columns_of_type(df, "string"))
    return df.select(*[null_tokens(f"`{c}`").alias(c) if c in texts else f"`{c}`" for c in df.columns])


def jdbc_url(url: str) -> str:
    """Service URLs (``postgres://``, ``postgresql://``) to JDBC URLs."""
    for scheme in ("postgres://", "postgresql://"):
        if url.startswith(scheme):
            return "jdbc:postgresql://" + url[len(scheme):]
    return url if url.startswith("jdbc:") else f"jdbc:{url}"


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a database scan; with a numeric column the scan is split into ranges."""
    options = {"url": jdbc_url(url), "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column:
        if None in (lower, upper, partitions):
            raise ValueError("a partitioned scan needs lower, upper and partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **split) -> DataFrameReader | DataFrame:
    """Database scan; column pruning and filters are pushed to the server by Spark."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **split)).load()


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A stored table: read it when it exists and has rows, otherwise build and write it."""
    if not rebuild:
        try:
            stored = spark.read.parquet(path)
            if not stored.isEmpty():
                return stored
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
