"""Encoders, scalers and scoring rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F, types as T

from venuekit.functions import scalars as S
from venuekit.operators.ranking import sorted_codes
from venuekit.operators.relational import lookup_code
from venuekit.session import materialize, scratch_path

MISSING_LABEL = "nan"
MAP_LABELS = 100_000  # labels that every task may hold


def label_codes(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Code table of a column: sorted distinct values, missing counted as the value ``nan``.

    Stored in the shared folder, because scoring must reuse the training codes.
    """
    filled = df.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL)).alias(column))
    return materialize(sorted_codes(filled.distinct(), column, code or f"{column}_code"), "codes")


def encode_labels(df: DataFrame, codes: DataFrame, column: str, unseen: int = -1) -> DataFrame:
    """Adds ``<column>_code``; missing is ``nan``, values outside the table get ``unseen``."""
    filled = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL)))
    return lookup_code(filled, codes, column, f"{column}_code", unseen)


def one_hot_long(df: DataFrame, train: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Active indicator per row and column; values not seen in training give no indicator."""
    rows = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("_s")).select(key, "_s.column", "_s.value")
    known = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("_s")).select("_s.column", "_s.value").filter(F.col("value").isNotNull()).distinct()
    return rows.join(materialize(known, "categories"), ["column", "value"]).select(key, "column", "value")


def label_lists(df: DataFrame, key: str, column: str, codes: DataFrame, keep: Sequence[str] | None = None,
                by: str | None = None) -> DataFrame:
    """``key, codes``: sorted codes of the known elements of an array column; rows without any are left out.

    Elements meet the code table by a join, so neither the table nor a row has a limit; a row gathers its own list only.
    With ``keep``, all rows come with these columns, and one without known elements has an empty list; while the table
    has at most ``MAP_LABELS`` rows, each task then looks the elements up and no row moves. With ``by`` (whole numbers
    from 0) the codes are those of the row's own number.
    """
    by_key = [by] if by else []
    if keep is not None and codes.limit(MAP_LABELS + 1).count() <= MAP_LABELS:
        return _mapped_lists(df, column, codes, keep, by)
    elements = df.select(key, *by_key, F.explode(F.array_distinct(F.col(column).cast("array<string>"))).alias("label"))
    lists = elements.join(codes, ["label", *by_key]).groupBy(key, *by_key).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    if keep is None:
        return lists
    rows = df.join(lists, [key, *by_key], "left")
    return rows.select(*keep, F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))


def _mapped_lists(df: DataFrame, column: str, codes: DataFrame, keep: Sequence[str], by: str | None) -> DataFrame:
    known = codes.select((F.col(by) if by else F.lit(0)).cast("int").alias("part"), "label", "code").toPandas()
    labels = sorted(set(known["label"]))
    at = {label: i for i, label in enumerate(labels)}
    cells = np.full((int(known["part"].max()) + 1 if len(known) else 1, len(labels) + 1), -1, np.int32)
    cells[known["part"], known["label"].map(at).astype(int)] = known["code"]
    rows = df.select(*keep, F.col(column).cast("array<string>").alias("_list"), (F.col(by) if by else F.lit(0)).cast("int").alias("_part"))
    kept = list(keep)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = cells, pa.array(labels, pa.string())
        for batch in batches:
            lists = batch["_list"]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            place = pc.fill_null(pc.index_in(lists.flatten(), value_set=names, skip_nulls=True), len(labels)).to_numpy(zero_copy_only=False)
            part = batch["_part"].to_numpy()
            found = np.where(part < len(table), part, 0)
            code = np.where((part < len(table))[owner], table[found[owner], place], -1)
            owner, code = owner[code >= 0], code[code >= 0]
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            first = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])][: len(owner)]
            owner, code = owner[first], code[first]
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))].astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], out], [*kept, "codes"])

    out_type = T.StructType([*[rows.schema[c] for c in kept], T.StructField("codes", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(look_up, out_type)


def label_table(df: DataFrame, column: str, path: str, by: str | None = None) -> DataFrame:
    """Code table of the distinct elements of an array column (per ``by``) in byte order, written to ``path``."""
    keys = [by] if by else []
    elements = df.select(*keys, F.explode(F.col(column).cast("array<string>")).alias("label"))
    sorted_codes(elements.filter(F.col("label").isNotNull()).distinct(), "label", by=keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


class MultiLabelModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Lists to sparse 0/1 vectors by a stored code table; unknown elements are ignored, a missing list is all zero."""

    keyCol = Param(Params._dummy(), "keyCol", "unique column of a row", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "folder of the code table", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of labels", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, keyCol=None, path=None, size=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, key = self.getOrDefault(self.size), self.getOrDefault(self.keyCol)
        codes = dataset.sparkSession.read.parquet(self.getOrDefault(self.path))
        lists = label_lists(dataset, key, self.getInputCol(), codes).withColumnRenamed("codes", "_codes")

        @F.pandas_udf(VectorUDT())
        def sparse(found: pd.Series) -> pd.DataFrame:
            ones = [np.ones(len(f)) for f in found]
            return pd.DataFrame({"type": np.zeros(len(found), np.int8), "size": np.full(len(found), size, np.int32), "indices": found, "values": ones})

        none = F.array().cast("array<int>")
        joined = dataset.join(lists, key, "left").withColumn(self.getOutputCol(), sparse(F.coalesce("_codes", none)))
        return joined.drop("_codes")


class MultiLabelEncoder(Estimator, HasInputCol, HasOutputCol):
    """Learns the sorted labels of an array column; the table is stored below the shared folder, however long it is."""

    def __init__(self, column: str, out: str, key: str, path: str | None = None):
        super().__init__()
        self.column, self.out, self.key, self.path = column, out, key, path

    def copy(self, extra=None) -> MultiLabelEncoder:
        return MultiLabelEncoder(self.column, self.out, self.key, self.path)

    def _fit(self, dataset: DataFrame) -> MultiLabelModel:
        path = self.path or scratch_path(dataset.sparkSession, "labels")
        size = label_table(dataset, self.column, path).count()
        return MultiLabelModel(inputCol=self.column, outputCol=self.out, keyCol=self.key, path=path, size=size)


def scale_statistics(train: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """One row ``stats`` (per ``by``): mean and population deviation per column."""
    parts = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    return train.groupBy(*([by] if by else [])).agg(F.struct(*parts).alias("stats"))


def standardize(df: DataFrame, train: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """``(x - mean) / std`` with train statistics; a constant column is only centred.

    With ``by`` (a few values) the statistics are those of the train rows with the row's own value.
    """
    if by:
        # stored, so that the real size decides how they are joined
        stats = materialize(scale_statistics(train, columns, by).withColumnRenamed("stats", "_s"), "scales")
        marked = df.join(stats, by, "left")
    else:
        marked = df.withColumn("_s", scale_statistics(train, columns).scalar())

    def scaled(c: str) -> Column:
        std = F.col(f"_s.{c}.std")
        return ((F.col(c) - F.col(f"_s.{c}.mean")) / F.when(std > 0, std).otherwise(1.0)).alias(c)

    return marked.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def preprocessing(numeric: Sequence[str], categorical: Sequence[str], multi_label: Sequence[str] = (),
                  out: str = "features", key: str | None = None) -> Pipeline:
    """Numeric columns as they are, categories one-hot (unseen and missing all zero), lists multi-hot by ``key``."""
    indexed, hot = [f"{c}_ix" for c in categorical], [f"{c}_oh" for c in categorical]
    stages = []
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        ]
    if multi_label and key is None:
        raise ValueError("lists need the key of a row")
    stages += [MultiLabelEncoder(c, f"{c}_mh", key) for c in multi_label]
    inputs = [*numeric, *hot, *[f"{c}_mh" for c in multi_label]]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol=out)])


def sparse_cells(vector: str) -> tuple[Column, Column, Column]:
    """Size, indices and values of the cells of a vector column that are not zero."""
    raw = F.unwrap_udt(vector)
    dense = F.transform(raw["values"], lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    listed = F.zip_with(raw["indices"], raw["values"], lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    cells = F.filter(F.when(raw["type"] == 0, listed).otherwise(dense), lambda x: x["v"] != 0)
    size = F.when(raw["type"] == 0, raw["size"]).otherwise(F.size(raw["values"]))
    return size, F.transform(cells, lambda x: x["i"]), F.transform(cells, lambda x: x["v"])


def scoring_rows(df: DataFrame, layout: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Typed feature rows in a fixed order: ``flag`` columns coded 0/1, others cast; missing numbers are 0."""

    def build(name: str, kind: str) -> Column:
        if kind == "flag":
            return S.yes_no_code(name).alias(name)
        if kind == "string":
            return F.col(name).cast("string").alias(name)
        return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind)).alias(name)

    return df.select(*keep, *[build(n, k) for n, k in layout.items()])
