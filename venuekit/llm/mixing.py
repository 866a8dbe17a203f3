"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from venuekit.llm.common import content_key, replace_columns, word_count
from venuekit.operators.ranking import ranked
from venuekit.session import materialize

BITS, LEVELS = 12, 4


def mix_hash(id_col: str, text_col: str) -> Column:
    """48 bits of the row's content; the order in which a source's documents are taken."""
    return F.conv(F.substring(content_key(F.col(id_col), F.col(text_col)), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int, budget: int | None = None) -> DataFrame:
    """``source, source_size, target``: weights deal the budget out, no target exceeds ``cap`` times its source.

    Only sums come to the driver. Each round caps the sources above their limit and shares the
    rest anew by weight; capped sources stay capped, so the loop ends.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code_point = ranked(per_source, [F.col("source").asc_nulls_last()], "_at")
    repeated = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    table = materialize(by_code_point.select("source", "source_size", repeated.alias("weight")), "sources")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = table.agg(F.sum(big("weight")), F.sum(big("source_size"))).first()
    weight, amount = int(total[0] or 0), int(total[1] or 0)
    budget = amount if budget is None else budget
    rest, above = budget, F.lit(False)
    while weight:
        product = lambda c, n: big(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")
        above = product("source_size", cap * weight) < product("weight", rest)
        free = F.when(~above, big("weight"))
        capped = F.when(above, big("source_size"))
        sums = table.agg(F.sum(free), F.sum(capped)).first()
        left = int(sums[0] or 0)
        if left in (0, weight):
            break
        weight, rest = left, budget - cap * int(sums[1] or 0)
    share = (F.col("weight").cast("double") * F.lit(float(rest))) / F.lit(float(max(weight, 1)))
    target = F.when(above, (F.col("source_size") * cap).cast("double")).otherwise(share)
    return table.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = (1, 2, 3), cap: int = 3, budget: int | None = None) -> DataFrame:
    """One row per source: its size, target, whole repeats, and the hash up to which one more copy is taken.

    Sizes are summed by source and hash bucket; the bucket in which a source's budget ends is found
    by a running sum over at most 4,096 buckets and alone is split further. After four levels a
    bucket is one hash value. Nothing is sorted and no source is gathered.
    """
    sized = materialize(
        docs.select(
            F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mix_hash(id_col, text_col).alias("h")
        ),
        "mix-sizes",
    )
    targets = source_targets(sized, weights, cap, budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = materialize(
        targets.withColumn("whole", F.least(whole, F.lit(cap)).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    edge = plan.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        rows = sized
        if level:
            inside = edge.select(F.col("source").alias("_s"), "prefix")
            rows = sized.join(
                inside, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))
            )
        histogram = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        known = edge.select(F.col("source").alias("_s"), "need", "below")
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        summed = histogram.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("upto", F.col("below") + upto)
        crossed = summed.filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
        edge = materialize(
            crossed.select("source", "need", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("below"), "n"),
            "mix-edge",
        )
    # the hash value on the boundary is taken when that comes nearer to the target
    nearer = F.col("below") + F.col("n") - F.col("need") < F.col("need") - F.col("below")
    cut = F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    cuts = edge.select(F.col("source").alias("_s"), cut.alias("cut"))
    joined = plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    return materialize(joined.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")), "mix")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (1, 2, 3), cap: int = 3, budget: int | None = None) -> DataFrame:
    """Every document with the words that the mix takes of it.

    Adds ``size, source_size, target, taken`` and replaces columns of those names. A document is
    repeated ``floor(target / source_size)`` times, and once more if its hash is at or below its
    source's threshold, so nothing exceeds ``cap`` times its size.

    A null source is a source of its own, last in order. A null or empty text has size 0 and takes
    nothing. Rows with the same id and text share their hash and are taken together. An empty table
    gives no rows. Reruns agree, since the hash depends on the row's content alone.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, weights, cap, budget).withColumnRenamed("source", "_source")
    base = replace_columns(docs, "size", "source_size", "target", "taken")
    sized = base.withColumns({"_h": mix_hash(id_col, text_col), "size": word_count(F.col(text_col))})
    joined = sized.join(plan, F.col(source_col).eqNullSafe(F.col("_source")), "left")
    copies = F.col("whole") + F.when(F.col("_h") <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn("taken", (F.col("size") * copies).cast("long")).drop("_h", "_source", "whole", "cut")
