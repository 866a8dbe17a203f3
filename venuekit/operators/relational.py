"""Projection, filter, join, set and sampling operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from venuekit.operators.ranking import hash_take



def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before any job when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Logical names from physical columns; absent ones become NULL strings and are reported."""
    missing = [logical for logical, physical in mapping.items() if physical not in df.columns]
    cols = [
        (F.col(f"`{physical}`") if logical not in missing else F.lit(None).cast("string")).alias(logical)
        for logical, physical in mapping.items()
    ]
    return df.select(*cols), missing


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Column names by kind: ``string``, ``numeric`` or ``boolean``."""
    kinds = {"string": T.StringType, "numeric": T.NumericType, "boolean": T.BooleanType}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds[kind])]


def split_by_flag(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the flag holds, and all others (a NULL flag counts as not held)."""
    held = F.coalesce(flag, F.lit(False))
    return df.filter(held), df.filter(~held)


def update_where(df: DataFrame, mask: Column, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(mask, value).otherwise(F.col(column)))


def complete_case(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows usable for training."""
    return df.filter(F.col(label).isNotNull())


def attach_group_statistic(df: DataFrame, statistic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Align a per-group table with the rows; a NULL key finds nothing.

    No join hint: Spark broadcasts the statistic when its measured size allows, and
    otherwise splits skewed partitions of the row side.
    """
    return df.join(statistic, list(keys), "left")


def lookup_code(df: DataFrame, codes: DataFrame, column: str, code: str, unseen: int = -1) -> DataFrame:
    """Code of a value from a persisted code table, ``unseen`` where it has none."""
    return df.join(codes, column, "left").withColumn(code, F.coalesce(F.col(code), F.lit(unseen)).cast("int"))


def with_probe(df: DataFrame, probe: DataFrame, prefix: str = "probe_") -> DataFrame:
    """Put the columns of a one-row DataFrame next to every row, as a scalar subquery."""
    one = probe.select(F.struct(*probe.columns).alias("_p")).scalar()
    out = df.withColumn("_p", one)
    return out.select(*df.columns, *[F.col(f"_p.{c}").alias(prefix + c) for c in probe.columns])


def sample_rows(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the same ones on every run."""
    size = lambda total: F.least(total, F.lit(n))
    return hash_take(df, key, size, "_taken").filter("_taken").drop("_taken")


def downsample_stratum(df: DataFrame, stratum: Column, fraction: float, key: Sequence[str]) -> DataFrame:
    """Keep ``floor(fraction * n)`` rows of the stratum and every other row."""
    held = F.coalesce(stratum, F.lit(False))
    part = lambda total: F.floor(total * F.lit(fraction))
    marked = hash_take(df, key, part, "_taken", where=held)
    return marked.filter(~held | F.col("_taken")).drop("_taken")


def missing_labels(df: DataFrame, column: str, labels: Sequence) -> DataFrame:
    """Labels of a fixed set that never occur."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in labels], [column])
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def ordered_head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


