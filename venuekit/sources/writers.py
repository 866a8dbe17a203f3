"""CSV, JSON and export sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from venuekit.functions.scalars import yes_no

QUOTE = '"'


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, one file per task, written so that :func:`venuekit.sources.readers.read_csv` reads it back."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", QUOTE)
        .option("escape", QUOTE)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def _fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """Row count, and a sum of hashes per column and of whole rows: the same for any order, and summed by every task."""

    def total(*shown: Column) -> Column:
        return F.sum(F.xxhash64(*shown).cast("decimal(38,0)"))

    shown = {c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("missing")) for c in columns}
    sums = [total(v).alias(c) for c, v in shown.items()]
    return F.struct(F.count("*").alias("n"), total(*shown.values()).alias("rows"), F.struct(*sums).alias("columns"))


def sink_differences(written: DataFrame, read: DataFrame) -> DataFrame:
    """``column, same`` for every column of either side, and for whole rows under the name ``*``.

    Values are compared as text and as multisets: a changed, lost or doubled value shows in its column, values that
    changed places between rows show in ``*``. Each side is one aggregation.
    """
    both = [c for c in written.columns if c in read.columns]
    left, right = written.agg(_fingerprint(written, both).alias("l")), read.agg(_fingerprint(read, both).alias("r")).scalar()
    same = {c: F.col(f"l.columns.`{c}`").eqNullSafe(F.col(f"r.columns.`{c}`")) for c in both}
    same |= {c: F.lit(False) for c in [*written.columns, *read.columns] if c not in both}
    same["*"] = (F.col("l.n") == F.col("r.n")) & F.col("l.rows").eqNullSafe(F.col("r.rows")) & F.lit(written.columns == read.columns)
    flags = left.withColumn("r", right).select(F.array(*same.values()).alias("flags"))
    names = F.array(*[F.lit(c) for c in same])
    return flags.select(F.inline(F.arrays_zip(names.alias("column"), F.col("flags").alias("same"))))


def check_sink(written: DataFrame, read: DataFrame) -> DataFrame:
    """Row counts on both sides of a sink, and whether columns, rows and values agree."""
    differences = sink_differences(written, read)
    same = differences.agg(F.bool_and("same")).scalar()
    left = written.agg(F.count("*").alias("n_written"))
    return left.select("n_written", read.agg(F.count("*")).scalar().alias("n_read"), same.alias("matches"))


def export_projection(df: DataFrame, columns: Sequence[str], labels: Sequence[str] = ("online_order", "book_table"),
                      sentinels: dict[str, str] | None = None) -> DataFrame:
    """The wanted columns that exist, yes/no label columns, and sentinels for missing categories."""
    sentinels = sentinels or {}
    present = [c for c in columns if c in df.columns]
    cols = [F.coalesce(F.col(c), F.lit(sentinels[c])).alias(c) if c in sentinels else F.col(c) for c in present]
    return df.select(*cols, *[yes_no(c).alias(f"{c}_label") for c in labels if c in present])
