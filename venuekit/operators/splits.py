"""Deterministic exact-size splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from venuekit.operators.ranking import hash_cut, hash_take, row_hash
from venuekit.session import materialize


def random_split(df: DataFrame, test_size: float, key: Sequence[str], flag: str = "is_test") -> DataFrame:
    """Marks ``ceil(test_size * n)`` rows."""
    return hash_take(df, key, lambda n: F.ceil(n * F.lit(test_size)), flag)


def stratified_split(df: DataFrame, test_size: float, label: str, key: Sequence[str], flag: str = "is_test") -> DataFrame:
    return hash_take(df, key, lambda n: F.ceil(n * F.lit(test_size)), flag, by=[label])


def group_split(df: DataFrame, test_size: float, group: str, flag: str = "is_test") -> DataFrame:
    """``ceil(test_size * groups)`` whole groups are test rows.

    The cut is found on the distinct groups; each row then decides by hashing its own
    group, so the big table is not shuffled and hot groups cost nothing.
    """
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    cut = hash_cut(groups, [group], lambda n: F.ceil(n * F.lit(test_size))).select("cut").scalar()
    return df.withColumn(flag, F.coalesce(row_hash(group) <= cut, F.lit(False)))


def group_folds(df: DataFrame, group: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """Fold per row, groups kept whole; groups in descending size are dealt back and forth.

    Rows without a group belong to no fold: they get -1, so they are never held out.
    The global order (size, hash) is built from per-size and per-prefix offsets, so no
    window spans all groups.
    """
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_h", row_hash(group)).withColumn("_p", F.substring("_h", 1, 3))
    cells = sizes.groupBy("_size", "_p").agg(F.count("*").alias("_n"))
    per_size = cells.groupBy("_size").agg(F.sum("_n").alias("_n"))
    # one row per distinct group size: at most sqrt(2 * rows) of them
    larger = Window.orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    size_offset = per_size.select("_size", F.coalesce(F.sum("_n").over(larger), F.lit(0)).alias("_o1"))
    # at most 4,096 prefixes per size
    earlier = Window.partitionBy("_size").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cell_offset = cells.select("_size", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o2"))
    within = F.row_number().over(Window.partitionBy("_size", "_p").orderBy("_h", group)) - 1
    ranked = sizes.withColumn("_rn", within).join(cell_offset, ["_size", "_p"]).join(size_offset, "_size")
    rank = F.col("_o1") + F.col("_o2") + F.col("_rn")
    turn, place = F.floor(rank / k), rank % k
    dealt = F.when(turn % 2 == 0, place).otherwise(k - 1 - place)
    folds = ranked.select(group, dealt.cast("int").alias(fold))
    return df.join(materialize(folds, "folds"), group, "left").fillna(-1, [fold])


def row_folds(df: DataFrame, key: Sequence[str], k: int = 5, fold: str = "fold") -> DataFrame:
    """Fold per row from the first 60 bits of its hash; a map-only step."""
    bits = F.conv(F.substring(row_hash(*key), 1, 15), 16, 10).cast("long")
    return df.withColumn(fold, (bits % k).cast("int"))


def shared_test(df: DataFrame, complete, flag: str = "is_test") -> DataFrame:
    """Test rows every model can score."""
    return df.filter(F.col(flag) & complete)
