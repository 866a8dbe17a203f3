"""Counts, distributions and association statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from venuekit.operators.ranking import modes, quantiles_by_column, sorted_codes
from venuekit.session import materialize

GRID_BLOCKS = 64


def _unpivot_aggregate(row: DataFrame, columns: Sequence[str], fields: Sequence[str], key: str = "column") -> DataFrame:
    """One wide row ``<column>__<field>`` to one row per column."""
    structs = [
        F.struct(F.lit(c).alias(key), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns
    ]
    return row.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, all columns in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__nulls") for c in columns])
    return _unpivot_aggregate(row, columns, ["nulls"])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row; copies are combined on the map side."""
    return df.groupBy(*df.columns).agg((F.count("*") - 1).alias("_extra")).agg(
        F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicates")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column. The exact form counts a deduplicated long table."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"{c}__n_distinct") for c in columns])
        return _unpivot_aggregate(row, columns, ["n_distinct"])
    values = stack_values(df, columns).filter(F.col("value").isNotNull()).distinct()
    found = values.groupBy("column").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], ["column"])
    return names.join(found, "column", "left").fillna(0, ["n_distinct"])


def stack_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, value)`` with values as strings."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("_s")).select("_s.*")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def relative_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares; the total is summed from the counts, not from a second scan."""
    counts = frequencies(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def label_coverage(df: DataFrame, column: str, labels: Sequence) -> DataFrame:
    """Counts over a fixed label set, zero filled, with a flag for labels that never occur."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in labels], [column])
    counts = df.filter(F.col(column).isin(*labels)).groupBy(column).agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return wanted.join(counts, column, "left").select(column, n.alias("n"), (n == 0).alias("is_empty"))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, median, mode, min and max per numeric column."""
    fields = ["n", "mean", "min", "max"]
    row = df.agg(
        *[
            agg(F.col(c).cast("double")).alias(f"{c}__{f}")
            for c in columns
            for f, agg in zip(fields, (F.count, F.avg, F.min, F.max))
        ]
    )
    stats = _unpivot_aggregate(row, columns, fields)
    median = quantiles_by_column(df, columns, [0.5]).withColumnRenamed("q0", "median")
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("_s")
    ).select("_s.*")
    return stats.join(median, "column", "left").join(modes(stacked, "v", ["column"]), "column", "left")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles, max; one row per column."""
    fields = ["n", "mean", "std", "min", "max"]
    row = df.agg(
        *[
            agg(F.col(c).cast("double")).alias(f"{c}__{f}")
            for c in columns
            for f, agg in zip(fields, (F.count, F.avg, F.stddev_samp, F.min, F.max))
        ]
    )
    quartiles = quantiles_by_column(df, columns, [0.25, 0.5, 0.75])
    named = quartiles.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    return _unpivot_aggregate(row, columns, fields).join(named, "column", "left")


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """Number of rows meeting each condition, in one pass."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def pass_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of true values in per cent; NULL flags do not count."""
    return df.agg(*[(F.avg(F.col(c).cast("int")) * 100).alias(f"{c}_rate") for c in flags])


def complete_case_rate(df: DataFrame, complete: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(complete).alias("n_complete"),
        F.avg(complete.cast("int")).alias("complete_rate"),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form, pairs with a NULL left out."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """One column per given value of ``b``, zero filled."""
    return df.dropna(subset=[a, b]).groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).fillna(0)


def expected_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts on the complete grid of both label sets.

    The grid is the result. The labels of ``b`` lie in hash blocks; every label of ``a``
    visits each block by an equi-join, so neither label set is gathered in one place.
    """
    cells = materialize(crosstab(df, a, b), "cells")
    rows = cells.groupBy(a).agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("col_total"))
    total = cells.agg(F.sum("n")).scalar()
    blocks = cols.withColumn("_block", F.pmod(F.xxhash64(b), F.lit(GRID_BLOCKS)))
    visits = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID_BLOCKS - 1).cast("long"))))
    grid = visits.join(blocks, "_block").drop("_block")
    expected = F.col("row_total").cast("double") * F.col("col_total") / total
    return grid.join(cells, [a, b], "left").select(
        a, b, F.coalesce("n", F.lit(0)).alias("observed"), expected.alias("expected")
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence statistic and degrees of freedom from the observed cells alone.

    Uses ``sum((o-e)^2/e) = sum(o * (o-e) / e)``: empty cells add nothing, so the grid is
    never built. With one degree of freedom the Yates correction applies to the four cells
    of the table.
    """
    cells = materialize(crosstab(df, a, b), "cells")
    rows = cells.groupBy(a).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").cast("double")).scalar()
    joined = cells.join(rows, a).join(cols, b).withColumn("e", F.col("r").cast("double") * F.col("c") / total)
    ratio = joined.agg(
        F.greatest(F.sum(F.col("n") * (F.col("n") - F.col("e")) / F.col("e")), F.lit(0.0)).alias("raw"),
        # in a 2x2 table |o - e| is the same in every cell
        F.max(F.abs(F.col("n") - F.col("e"))).alias("gap"),
    )
    dof = (rows.agg(F.count("*")).scalar() - 1) * (cols.agg(F.count("*")).scalar() - 1)
    raw = F.col("raw")
    gap = F.col("gap")
    shrink = F.pow((gap - F.least(F.lit(0.5), gap)) / gap, 2)
    corrected = F.when((dof == 1) & (gap > 0), raw * shrink).otherwise(raw)
    return ratio.select(corrected.alias("chi2"), dof.cast("long").alias("dof"))


def chi_square_tail(x: float, dof: int) -> float:
    """Probability that a chi-square variable exceeds ``x``: the regularised upper incomplete gamma function."""
    a, x = dof / 2, x / 2
    if dof < 1 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series of the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    # continued fraction of the upper part, by the modified Lentz method
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1_000_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def independence_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Statistic, degrees of freedom, p-value and decision; two by two tables are corrected as in ``chi_square``."""

    def tail(chi2: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(x, k) for x, k in zip(chi2, dof)], dtype="float64")

    p_value = F.pandas_udf(tail, "double")("chi2", "dof")  # one row
    return chi_square(df, a, b).withColumn("p_value", p_value).withColumn("dependent", F.col("p_value") < alpha)


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations in long form, from one aggregation over the upper triangle."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    both = [(a, b, f"{a}__{b}") for a, b in pairs] + [(b, a, f"{a}__{b}") for a, b in pairs if a != b]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{c}`").alias("corr")) for a, b, c in both]
    return row.select(F.explode(F.array(*cells)).alias("_s")).select("_s.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls into the last bin."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    edges = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    placed = values.withColumn("_e", edges)
    width = (F.col("_e.high") - F.col("_e.low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_e.low")) / width), F.lit(bins - 1)))
    return placed.groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def item_frequencies(df: DataFrame, items: str, name: str = "item") -> DataFrame:
    """Occurrences of each array element over the whole table."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def category_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values of each column in long form with their position.

    Kept as rows: a column may hold any number of distinct values.
    """
    values = stack_values(df, columns).filter(F.col("value").isNotNull()).distinct()
    return sorted_codes(values, "value", "position", by=["column"])


def type_profile(df: DataFrame) -> DataFrame:
    """Type and non-null count per column."""
    columns = df.columns
    types = dict(df.dtypes)
    row = df.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"{c}__non_null") for c in columns],
        *[F.lit(types[c]).alias(f"{c}__type") for c in columns],
    )
    return _unpivot_aggregate(row, columns, ["type", "non_null"])
