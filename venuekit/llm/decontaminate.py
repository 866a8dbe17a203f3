"""Benchmark decontamination: n-gram windows of the test items, looked up in the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from venuekit.llm.common import NGRAM_WORD, ascii_lower, content_key, replace_columns, words
from venuekit.session import materialize

WINDOW = 13
BROADCAST_WINDOWS = 1_000_000


def _ngrams(tokens: Column, n: int) -> Column:
    """Array of (first word's index, hash, ``n``) of the windows of ``n`` words."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    hashed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(tokens, i, n)).alias("h"), F.lit(n).alias("n")))
    return F.when(F.size(tokens) >= n, hashed).otherwise(F.array().cast("array<struct<at:int,h:bigint,n:int>>"))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``h, gram, n, items``: distinct windows of the items; an item of fewer words is one window."""
    tokens = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.col(text_col)), NGRAM_WORD).alias("w")
    ).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - n + 1))
    grams = tokens.select("item", "w", n.alias("n"), starts.alias("i")).select("item", "n", F.slice("w", F.col("i"), F.col("n")).alias("g"))
    keyed = grams.select("item", "n", F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"))
    return keyed.groupBy("h", "gram", "n").agg(F.collect_set("item").alias("items"))


def mark_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: ``_key, doc_id, n_words, n_hit, spans, items`` of verified window occurrences.

    The hashes of a document's windows are looked up in the hash set of the items' windows in the
    same pass that reads the text; only hits and one short row per document are exchanged. The set is
    broadcast when it was counted to hold at most ``broadcast_windows`` windows, else the same join
    is a shuffle join on the window hash. A hit counts only if its words equal the window's words.
    ``spans`` holds ``(at, end)`` in 1-based word positions, end exclusive.
    """
    grams = materialize(item_windows(items, item_col, item_text, window), "windows")
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # at most ``window`` values
    small = grams.count() <= broadcast_windows
    tokens = docs.select(
        F.col(id_col).alias("doc_id"), content_key(F.col(id_col), F.col(text_col)).alias("_key"),
        words(ascii_lower(F.col(text_col)), NGRAM_WORD).alias("_w"),
    )
    # position 0 stands for the document itself
    itself = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("_key").alias("h"), F.lit(0).alias("n")))
    all_windows = [_ngrams(F.col("_w"), n) for n in lengths]
    exploded = tokens.select("doc_id", "_key", "_w", F.explode(F.concat(itself, *all_windows)).alias("_x"))
    placed = exploded.select("doc_id", "_key", "_w", F.col("_x.at").alias("at"), F.col("_x.h").alias("_h"), F.col("_x.n").alias("_n"))
    said = F.array_join(F.slice("_w", F.greatest(F.col("at"), F.lit(1)), F.col("_n")), " ")
    n_words = F.when(F.col("at") == 0, F.size("_w"))
    if not small:  # what the shuffle moves for a window is its own words, never the document's
        placed = placed.select("doc_id", "_key", "at", "_h", "_n", said.alias("_said"), n_words.alias("_words"))
        said, n_words = F.col("_said"), F.col("_words")
    known = grams.withColumnsRenamed({"h": "_gh", "n": "_gn"})
    joined = placed.join(
        F.broadcast(known) if small else known,
        (F.col("_h") == F.col("_gh")) & (F.col("_n") == F.col("_gn")) & (F.col("at") > 0), "left",
    ).filter((F.col("at") == 0) | F.col("gram").isNotNull())
    same = said == F.col("gram")
    found = joined.select(
        "doc_id", "_key", "at", n_words.alias("_words"),
        F.when((F.col("at") > 0) & same, F.struct(F.col("at"), (F.col("at") + F.col("_n")).alias("end"))).alias("_span"),
        F.when((F.col("at") > 0) & same, F.col("items")).alias("_items"),
    )
    grouped = found.groupBy("doc_id", "_key").agg(
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("_copies"), F.max("_words").alias("_words"),
        F.array_sort(F.collect_set("_span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("items"),
    )
    # words in the union of the spans: what each span adds beyond the furthest end before it
    nothing = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", nothing, lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], acc["end"]))).alias("hit"),
        F.greatest(acc["end"], s["end"]).alias("end"),
    ))["hit"]
    counted = grouped.withColumns({"n_words": F.col("_words").cast("long"), "n_hit": covered.cast("long")})
    return counted.select("doc_id", "_key", "_copies", "n_words", "n_hit", "spans", "items")


def is_contaminated(percent: int = 5) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def contamination_report(docs: DataFrame, items: DataFrame, percent: int = 5, **options) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and its hit ``spans``.

    A null or empty text has no words and no hits. Rows that repeat id and text each get their own
    (equal) row. A null item id counts as the empty name. No items, or none with words, leave every
    document clean. Empty tables give no rows. Other columns play no part.
    """
    marked = mark_contamination(docs, items, **options)
    rows = marked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(percent).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 5, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns; nulls and repeats as in the report.

    Only the keys of contaminated documents are joined back.
    """
    marked = mark_contamination(docs, items, id_col, text_col, **options)
    bad = materialize(marked.filter(is_contaminated(percent)).select(F.col("_key").alias("_bad")).distinct(), "contaminated")
    keyed = replace_columns(docs, "_key").withColumn("_key", content_key(F.col(id_col), F.col(text_col)))
    return keyed.join(bad, F.col("_key") == F.col("_bad"), "left_anti").drop("_key")
