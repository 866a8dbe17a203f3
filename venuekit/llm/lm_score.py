"""Cross-entropy difference: how much better a target model than a background model predicts a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from venuekit.llm.common import replace_columns
from venuekit.session import materialize

ORDER, SLOT_BITS = 4, 20
FILTER_BITS = 24  # of the filter that goes before the join with the target ids
MIN_COUNT = 2
SMOOTHING = 20.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = [9, 10, 11, 12, 13, 32]


def characters(text: str) -> np.ndarray:
    """Code points of the text, white space as one sign."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[np.isin(points, _SPACES)] = 32
    return points


def ngram_slots(ids: np.ndarray, order: int, bits: int = SLOT_BITS) -> list[np.ndarray]:
    """For n = 1 to ``order`` the slot of the n-gram that ends at each place; the text is preceded by begin signs."""
    padded = np.concatenate([np.zeros(order - 1, np.uint64), ids.astype(np.uint64)])
    codes = np.zeros(len(ids), np.uint64)
    out = []
    for n in range(order):
        codes += padded[order - 1 - n : len(padded) - n]
        codes += np.uint64(1)
        codes *= _ODD
        codes ^= codes >> np.uint64(31)
        out.append((((codes + np.uint64(n)) * _ODD) >> np.uint64(64 - bits)).view(np.int64))
    return out


def vocabulary(docs: DataFrame, text_col: str, min_count: int = MIN_COUNT) -> np.ndarray:
    """Sorted code points that occur at least ``min_count`` times in the corpus; both models share them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = "".join(t for t in batch["t"] if t)
            points, n = np.unique(characters(texts), return_counts=True)
            yield pd.DataFrame({"point": points.astype("int64"), "n": n.astype("int64")})

    counted = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    # bounded by the number of Unicode code points
    return np.array(sorted(r[0] for r in counted.filter(F.col("n") >= min_count).select("point").collect()), dtype=np.uint32)


def to_ids(points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 + place in the vocabulary; 0 for characters outside it."""
    if not len(known):
        return np.zeros(len(points), np.int64)
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    return np.where(known[at] == points, at + 1, 0)


def id_table(known: np.ndarray) -> np.ndarray:
    """The id of every code point, white space as one sign, so that a text's ids are one lookup."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[_SPACES] = 32
    return to_ids(points, known).astype(np.uint32)


def text_ids(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def likely_among(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits set at the hashes of all ids, gathered as words of 32 bits: a Bloom filter of fixed size."""
    placed = ids.select(_place(F.col(column), bits).alias("at"))
    words = placed.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS int))")).alias("set"))
    table = np.zeros(2 ** (bits - 5), np.uint32)
    for part in words.toPandas().itertuples(index=False):  # at most 2^(bits - 5) rows
        table[part.word] = part.set
    return table


def _place(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def of_targets(docs: DataFrame, targets: DataFrame, id_col: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` whose id is among the distinct ``_id`` of ``targets``.

    A filter of the ids goes before the join, so that of the other documents only a few false hits are
    moved; the join decides. The filter has ``2^bits`` bits whatever the number of ids: a full one is
    slower, not wrong.
    """
    shared = docs.sparkSession.sparkContext.broadcast(likely_among(targets, "_id", bits))

    def hit(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    likely = F.pandas_udf(hit, "boolean")
    return docs.filter(likely(_place(F.col(id_col), bits))).join(targets, F.col(id_col) == F.col("_id"), "left_semi")


def count_ngrams(docs: DataFrame, text_col: str, known: np.ndarray, order: int = ORDER) -> DataFrame:
    """``n, slot, times``: how often each n-gram occurs in the documents.

    Each task sums its documents into tables of ``2^SLOT_BITS`` slots per order and passes on the slots
    in use, so memory is fixed, every n-gram of every document is counted, and the exchange grows with
    the number of tasks.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((order, 2**SLOT_BITS), np.int64)
        ids = id_table(known)
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        waiting = 0

        def add() -> None:
            for n, slots in enumerate(held):
                if slots:
                    table[n] += np.bincount(np.concatenate(slots), minlength=2**SLOT_BITS)
                    slots.clear()

        for batch in batches:
            for text in batch["t"]:
                if text:
                    found = ngram_slots(text_ids(text, ids), order)
                    waiting += len(found[0])
                    for slots, more in zip(held, found):
                        slots.append(more)
                    if waiting >= 2**SLOT_BITS:
                        add()
                        waiting = 0
        add()
        for n in range(order):
            used = np.flatnonzero(table[n])
            yield pd.DataFrame({"n": n, "slot": used, "times": table[n, used]})

    counted = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "n int, slot long, times long")
    return counted.groupBy("n", "slot").agg(F.sum("times").alias("times"))


def log_probabilities(held: list[np.ndarray], size: int, totals: np.ndarray) -> np.ndarray:
    """Bits of each character in each model: every order is smoothed with ``SMOOTHING`` counts of the next lower one.

    ``held[n]`` has the counts of the n-gram that ends at each place, a column for each model; the context of
    a character is the n-gram that ends before it.
    """
    p = (held[0] + 1.0) / (totals + size + 1)
    for n in range(1, len(held)):
        context = np.zeros_like(p)
        context[1:] = held[n - 1][:-1]
        p *= SMOOTHING
        p += np.minimum(held[n], context)
        context += SMOOTHING
        p /= context
    return np.log2(p)


def mean_losses(slots: list[np.ndarray], counts: np.ndarray, size: int, totals: np.ndarray, without_own: bool = False) -> list[float]:
    """Mean loss in bits in each model. ``counts`` holds the counts of all models of a slot side by side.

    ``without_own`` takes the text's own n-grams off the counts, for a text that was counted itself.
    """
    held = [counts[n].take(at, axis=0) for n, at in enumerate(slots)]
    if without_own:
        for found, at in zip(held, slots):
            _, place, times = np.unique(at, return_inverse=True, return_counts=True)
            found -= times[place][:, None]
            np.maximum(found, 0, out=found)
        totals = totals - len(slots[0])
    return (-np.ascontiguousarray(log_probabilities(held, size, totals).T).mean(1)).tolist()


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Every document with ``score, n_tokens, target_bits, background_bits``; columns of those names are replaced.

    ``target_ids`` names the target documents (column ``id_col``). Target and background model are matched:
    characters of one shared vocabulary, one order, one smoothing, one table size. ``score`` is the mean
    difference of their losses in bits per token; below 0 the target model predicts the text better.

    A target document is scored without its own counts in both models, so it does not vouch for itself.

    A null or empty text has no tokens and score null. Rows with equal texts score alike. Ids in
    ``target_ids`` may repeat; null ids name no document. Without targets the target model is uniform.
    """
    base = replace_columns(docs, "n_tokens", "target_bits", "background_bits", "score", "_s", "_id")
    chosen = materialize(target_ids.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull()).distinct(), "targets")
    known = vocabulary(base, text_col)
    # target and background side by side; whole numbers up to 2^53 are exact
    tables = np.zeros((order, 2**SLOT_BITS, 2))
    # at most order * 2^SLOT_BITS rows each
    for place, rows in enumerate((of_targets(base.select(id_col, text_col), chosen, id_col), base)):
        for part in materialize(count_ngrams(rows, text_col, known, order), "ngrams").toPandas().itertuples(index=False):
            tables[part.n, part.slot, place] = part.times
    totals = tables[0].sum(0)
    model = docs.sparkSession.sparkContext.broadcast(tables)
    among = docs.sparkSession.sparkContext.broadcast(likely_among(chosen, "_id", FILTER_BITS))

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counts, ids = model.value, id_table(known)
        for texts, places in batches:
            rows = []
            at = places.to_numpy()
            likely = (among.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            for text, check in zip(texts, likely):
                if not text:
                    rows.append((None, None, None, None, 0))
                    continue
                slots = ngram_slots(text_ids(text, ids), order)
                losses = [loss for own in ([False, True] if check else [False]) for loss in mean_losses(slots, counts, len(known), totals, own)]
                rows.append((*losses, *[None] * (4 - len(losses)), len(slots[0])))
            yield pd.DataFrame(rows, columns=["t", "b", "own_t", "own_b", "n"])

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    scored = F.pandas_udf(score, "t double, b double, own_t double, own_b double, n long")
    counted = base.withColumn("_s", scored(F.col(text_col), F.coalesce(_place(F.col(id_col), FILTER_BITS), F.lit(0))))
    # few numbers a row: a document's text is read before this join
    flagged = counted.join(chosen, F.col(id_col) == F.col("_id"), "left")
    bits = {f"{name}_bits": F.when(F.col("_id").isNotNull(), F.col(f"_s.own_{c}")).otherwise(F.col(f"_s.{c}")) for name, c in (("target", "t"), ("background", "b"))}
    return flagged.withColumns(bits).select(
        *base.columns, (F.col("target_bits") - F.col("background_bits")).alias("score"), F.col("_s.n").alias("n_tokens"), "target_bits", "background_bits"
    )
