"""Missing-value fills. Statistics are scalar subqueries or per-group tables, never collected to the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from venuekit.functions.scalars import round_even
from venuekit.operators.ranking import exact_median, modes, modes_by_column, quantiles_by_column
from venuekit.operators.relational import attach_group_statistic
from venuekit.session import materialize


def fill_median(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Exact column median, learned from ``fit_on`` (for example the train rows) when given."""
    source = df if fit_on is None else fit_on
    return df.withColumn(column, F.coalesce(F.col(column), exact_median(source, column).scalar()))


def fill_mean(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    source = df if fit_on is None else fit_on
    return df.withColumn(column, F.coalesce(F.col(column), source.agg(F.avg(column)).scalar()))


def fill_mode(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    source = df if fit_on is None else fit_on
    return df.withColumn(column, F.coalesce(F.col(column), modes(source, column).scalar()))


def fill_group_mode(df: DataFrame, column: str, by: str, sentinel: str = "Unknown") -> DataFrame:
    """Mode of the row's group, ``sentinel`` if the group has none; rows without a group stay as they are.

    The modes are stored first, so that their real size decides how they are joined.
    """
    table = materialize(modes(df.filter(F.col(by).isNotNull()), column, [by], "_mode"), "modes")
    filled = F.when(F.col(by).isNotNull(), F.coalesce(column, "_mode", F.lit(sentinel))).otherwise(F.col(column))
    return attach_group_statistic(df, table, [by]).withColumn(column, filled).select(*df.columns)


def fill_cascade(df: DataFrame, column: str, second: Column, digits: int = 1, fit_on: DataFrame | None = None) -> DataFrame:
    """Value, else a derived value, else the mean of both (of ``fit_on`` when given), rounded half to even."""
    step = lambda rows: rows.withColumn(column, F.coalesce(F.col(column), second))
    source = None if fit_on is None else step(fit_on)
    return fill_mean(step(df), column, source).withColumn(column, round_even(column, digits))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def impute_fitted(df: DataFrame, train: DataFrame | Sequence[Column], numeric: Sequence[str], categorical: Sequence[str],
                  part: str = "part") -> DataFrame:
    """Medians and modes learned on the train rows, applied to all rows; all columns share the passes.

    ``train`` may be a list of conditions, each for the train rows of one part. All parts share the passes too; every row
    then comes once per part, filled by what the part's train rows tell, with the place of the condition in ``part``.
    """
    if not isinstance(train, DataFrame):
        return _impute_parts(df, train, numeric, categorical, part)
    medians = {r["column"]: r["q0"] for r in quantiles_by_column(train, numeric, [0.5]).collect()} if numeric else {}
    fills = {c: F.coalesce(F.col(c), F.lit(medians.get(c))) for c in numeric}
    if categorical:
        table = modes_by_column(train, categorical)
        df = df.withColumn("_modes", table.select(F.struct(*categorical)).scalar())
        fills |= {c: F.coalesce(F.col(c), F.col(f"_modes.{c}")) for c in categorical}
    return df.withColumns(fills).drop("_modes")


def _impute_parts(df: DataFrame, fits: Sequence[Column], numeric: Sequence[str], categorical: Sequence[str], part: str) -> DataFrame:
    parts = range(len(fits))
    split = lambda rows, columns, flags: rows.select("*", *[F.when(flags[i], F.col(c)).alias(f"_{i}_{c}") for i in parts for c in columns])
    names = lambda columns: [f"_{i}_{c}" for i in parts for c in columns]
    learned: dict[str, object] = {}
    if numeric:
        learned |= {r["column"]: r["q0"] for r in quantiles_by_column(split(df, numeric, fits), names(numeric), [0.5]).collect()}
    if categorical:
        counts = df.groupBy(*[f.alias(f"_fit{i}") for i, f in enumerate(fits)], *categorical).agg(F.count("*").alias("_n"))
        cells = split(counts, categorical, [F.col(f"_fit{i}") for i in parts])
        learned |= modes_by_column(cells, names(categorical), "_n").first().asDict()
    copies = df.withColumn(part, F.explode(F.array(*[F.lit(i) for i in parts])))

    def filled(c: str) -> Column:
        kind = "double" if c in numeric else df.schema[c].dataType
        return F.coalesce(F.col(c), F.array(*[F.lit(learned.get(f"_{i}_{c}")).cast(kind) for i in parts])[F.col(part)])

    return copies.withColumns({c: filled(c) for c in [*numeric, *categorical]})
