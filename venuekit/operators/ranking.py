"""Exact ranks, cuts and quantiles that never gather a large group in one task."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from venuekit.session import materialize

HASH_DIGITS = 4
BUCKETS = 4_096  # parts of a histogram
MAX_PASSES = 256


def row_hash(*cols: Column | str) -> Column:
    """A reproducible pseudo-random order that does not depend on partitioning."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, salt: Sequence[str] = (),
          salts: int = 64, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    With ``salt`` columns a group is first cut to ``k`` rows in each of ``salts``
    slices, so a group that holds a third of the table is sorted by many tasks and
    at most ``k * salts`` of its rows meet in one. Spark also applies the limit on
    the map side of both shuffles.
    """
    if salt:
        slice_of = F.pmod(F.xxhash64(*salt), F.lit(salts))
        first = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", slice_of)
            .withColumn(rank, F.row_number().over(first))
            .filter(F.col(rank) <= k)
            .drop("_slice", rank)
        )
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One row per key, the first in ``order``; combined on the map side, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def hash_cut(df: DataFrame, key: Sequence[str], take: Callable[[Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """Cut-off hash such that exactly ``take(n)`` rows of each stratum lie at or below it.

    Returns ``by..., n, n_take, cut`` (``cut`` NULL when nothing is taken). The key
    must be unique. Rows are counted per hash prefix with map-side combining; only
    the rows sharing the prefix of the boundary, one in 65,536, are ranked.
    """
    by = list(by)
    hashed = df.select(*by, row_hash(*key).alias("_h")).withColumn("_bucket", F.substring("_h", 1, HASH_DIGITS))
    counts = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    # at most 65,536 rows per stratum enter these windows
    running = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.select(
        "*", F.sum("_n").over(running).alias("_upto"), F.sum("_n").over(Window.partitionBy(*by)).alias("n")
    ).withColumn("n_take", take(F.col("n")).cast("long"))
    edge = (F.col("n_take") > F.col("_upto") - F.col("_n")) & (F.col("n_take") <= F.col("_upto"))
    boundary = totals.filter(edge).select(
        *by, "_bucket", "n", "n_take", (F.col("n_take") - F.col("_upto") + F.col("_n")).alias("_nth")
    )
    # one row per stratum; stored first when there are strata, so that its real size is known
    inside = hashed.join(materialize(boundary, "boundary") if by else F.broadcast(boundary), [*by, "_bucket"])
    nth = Window.partitionBy(*by, "_bucket").orderBy("_h")
    cut = (
        inside.withColumn("_rank", F.row_number().over(nth))
        .filter(F.col("_rank") == F.col("_nth"))
        .select(*by, "n", "n_take", F.col("_h").alias("cut"))
    )
    return cut


def hash_take(df: DataFrame, key: Sequence[str], take: Callable[[Column], Column], flag: str,
              by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Mark exactly ``take(n)`` pseudo-random rows (per stratum); a map-only step after the cut is known.

    Cuts of strata are stored first: their measured size then decides at planning time
    whether the join broadcasts them, so the big side need not be shuffled.
    """
    population = df if where is None else df.filter(where)
    cut = hash_cut(population, key, take, by)
    if by:
        strata = materialize(cut.select(*by, F.col("cut").alias("_cut")), "cuts")
        keyed = df.join(strata, list(by), "left")
        return keyed.withColumn(flag, F.coalesce(row_hash(*key) <= F.col("_cut"), F.lit(False))).drop("_cut")
    return df.withColumn(flag, F.coalesce(row_hash(*key) <= cut.select("cut").scalar(), F.lit(False)))


def ranked(values: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """0-based position of every row in a total order.

    Rows are dealt out by range, stored, and ranked inside their own slice; the sizes of
    the slices (one row per partition) give the offsets, so no task sees more than a slice.
    """
    dealt = values.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    slices = materialize(dealt, "slices")
    sizes = slices.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    placed = slices.withColumn("_rn", within).join(offsets, "_slice")
    return placed.withColumn(name, F.col("_offset") + F.col("_rn") - 1).drop("_slice", "_rn", "_offset")


def sorted_codes(values: DataFrame, column: str, code: str = "code", by: Sequence[str] = ()) -> DataFrame:
    """0-based rank of distinct values in byte order (per ``by``), from one range-dealt order."""
    known = values.filter(F.col(column).isNotNull()).select(*by, column)
    placed = ranked(known, [F.col(c) for c in [*by, column]], "_at")
    if not by:
        return placed.select(column, F.col("_at").cast("int").alias(code))
    starts = placed.groupBy(*by).agg(F.min("_at").alias("_start"))
    return placed.join(starts, list(by)).select(*by, column, (F.col("_at") - F.col("_start")).cast("int").alias(code))


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles as one row of columns ``q0, q1, ...``; no row if there is no value."""
    return quantiles_by_column(df, [column], qs).drop("column")


def quantiles_by_column(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """As :func:`exact_quantiles`, one row per column name with a value; missing and NaN values do not count.

    Histograms are narrowed until they meet a value: a pass counts the values between the bounds of each searched
    position in ``BUCKETS`` parts, and the least and the greatest value of the part that holds the position are the next
    bounds. Every pass splits what is left, two to four passes find values of any distribution one meets. Nothing is
    ordered, and the driver sees histograms only.
    """
    spark, number = df.sparkSession, {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    values = materialize(df.select(*[v.alias(f"v{i}") for i, v in enumerate(number.values())]), "quantile-values")
    names = list(number)
    stats = values.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    found: dict[tuple[int, int], float] = {}
    searched: dict[tuple, set[int]] = {}  # (column, least value, greatest value, number of values below) -> positions
    spots = {}
    for i in range(len(names)):
        if stats[f"n{i}"]:
            exact = [(stats[f"n{i}"] - 1) * float(q) for q in qs]
            spots[i] = [(math.floor(p), math.ceil(p), p - math.floor(p)) for p in exact]
            searched[(i, stats[f"lo{i}"], stats[f"hi{i}"], 0)] = {p for low, high, _ in spots[i] for p in (low, high)}
    for _ in range(MAX_PASSES):
        for (i, lo, hi, _below), positions in list(searched.items()):
            if lo == hi:
                found.update({(i, p): lo for p in positions})
        searched = {k: v for k, v in searched.items() if k[1] != k[2]}
        if not searched:
            break
        searched = _narrowed(values, searched)
    else:
        raise ValueError("quantiles did not settle")
    rows = []
    for i, places in spots.items():
        ends = [(found[i, low], found[i, high], weight) for low, high, weight in places]
        rows.append((names[i], *[low + (high - low) * weight if low < high else low for low, high, weight in ends]))
    return spark.createDataFrame(rows, "column string" + "".join(f", q{j} double" for j in range(len(qs))))


def _narrowed(values: DataFrame, searched: dict[tuple, set[int]]) -> dict[tuple, set[int]]:
    """One pass: the bounds and counts of the parts that hold the searched positions."""
    largest, keys, cells = sys.float_info.max, list(searched), []
    clip = lambda v: F.greatest(F.least(v, F.lit(largest)), F.lit(-largest))
    for k, (i, lo, hi, _below) in enumerate(keys):
        v, low, high = F.col(f"v{i}"), max(lo, -largest), min(hi, largest)
        # scaled by a power of two, so that a range is neither infinite nor empty; rounding keeps the order of parts
        scale = 0.5 if max(abs(low), abs(high)) > 1 else 2.0**64
        part = F.floor((clip(v) * scale - low * scale) / (high * scale - low * scale) * BUCKETS)
        inside = v.between(F.lit(lo), F.lit(hi))
        cells.append(F.when(inside, F.struct(F.lit(k).alias("k"), F.least(part, F.lit(BUCKETS)).alias("part"), v.alias("v"))))
    counted = values.select(F.explode(F.array(*cells)).alias("c")).filter("c IS NOT NULL").groupBy("c.k", "c.part")
    rows = counted.agg(F.count("*").alias("n"), F.min("c.v").alias("lo"), F.max("c.v").alias("hi")).collect()
    upto = [key[3] for key in keys]
    narrower: dict[tuple, set[int]] = {}
    for row in sorted(rows, key=lambda r: (r["k"], r["part"])):
        k, below = row["k"], upto[row["k"]]
        held = {p for p in searched[keys[k]] if below <= p < below + row["n"]}
        if held:
            narrower.setdefault((keys[k][0], row["lo"], row["hi"], below), set()).update(held)
        upto[k] += row["n"]
    return narrower


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, one column ``median``."""
    return exact_quantiles(df, column, [0.5]).agg(F.max("q0").alias("median"))


def modes(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties.

    Values are counted first (combined on the map side), so a group is reduced to
    its distinct values before anything is compared.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(column).alias("value")))["value"]
    return counts.groupBy(*by).agg(best.alias(name))


def modes_by_column(df: DataFrame, columns: Sequence[str], count: str | None = None) -> DataFrame:
    """One row with the mode of every column under its name, counted in one pass; ties and missing as in :func:`modes`.

    A column ``count`` tells how many rows each row stands for.
    """
    typed = [
        F.struct(F.lit(i).alias("i"), *[(F.col(c) if i == j else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{j}") for j, c in enumerate(columns)])
        for i in range(len(columns))
    ]
    weight = F.col(count) if count else F.lit(1)
    cells = df.select(F.explode(F.array(*typed)).alias("s"), weight.cast("long").alias("w")).select("s.*", "w")
    counts = cells.groupBy("i", *[f"v{j}" for j in range(len(columns))]).agg(F.sum("w").alias("n"))
    best = [
        F.min_by(f"v{j}", F.when((F.col("i") == j) & F.col(f"v{j}").isNotNull(), F.struct(-F.col("n"), F.col(f"v{j}")))).alias(c)
        for j, c in enumerate(columns)
    ]
    return counts.agg(*best)
