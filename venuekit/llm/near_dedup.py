"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from venuekit.llm.common import ascii_lower, content_key, replace_columns, words
from venuekit.session import materialize

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 40, 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * _ODD[2]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_codes(word_codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles; fewer words than ``size`` are one shingle."""
    n = len(word_codes)
    if not n:
        return np.empty(0, np.uint64)
    w = word_codes.astype(np.int64).view(np.uint64)
    k = min(size, n)
    codes = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        codes = _mix(codes * _ODD[0] + w[i : n - k + 1 + i])
    return np.unique(codes)


def sketch(codes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a set: ``t`` coordinates, each equal in two sets with their Jaccard similarity.

    In round ``i < t`` every element throws one value into a hashed bin; a bin keeps its least
    ``(round, value)``, so later rounds change empty bins only. Rounds end once all bins are full. Round
    ``t + j`` throws everything into bin ``j``, so after ``2t`` rounds no bin is empty, however small the set.
    """
    full = np.iinfo(np.uint64).max
    out = np.full(t, full, np.uint64)
    for i in range(2 * t):
        h = _mix(codes ^ _mix(np.array([i + 1], np.uint64) * _ODD[0]))
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        if i < t:
            np.minimum.at(out, (h & np.uint64(0xFFFF)).astype(np.int64) % t, value)
        elif out[i - t] == full:
            out[i - t] = value.min()
        if not (out == full).any():
            return out
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = _mix(keys * _ODD[0] + signature.reshape(bands, rows)[:, r])
    return keys.view(np.int64)


def shingle_set(text: str, size: int) -> frozenset:
    """The shingles themselves, for the exact check."""
    w = _WORD.findall(text.translate(_LOWER))
    return frozenset(zip(*[w[i:] for i in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def _sketched(size: int, bands: int, rows: int):
    """UDF from word codes to the size and 128-bit code of the shingle set and its band keys."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out = []
            for word_codes in series:
                codes = shingle_codes(np.asarray(word_codes), size)
                if not len(codes):
                    out.append((0, None, []))
                    continue
                with np.errstate(over="ignore"):
                    keys = band_keys(sketch(codes, bands * rows), bands, rows)
                    twice = (int(np.bitwise_xor.reduce(_mix(codes))), int(_mix(codes ^ _ODD[1]).sum(dtype=np.uint64)))
                out.append((len(codes), f"{twice[0]:016x}{twice[1]:016x}", keys))
            yield pd.DataFrame(out, columns=["n_shingles", "set_code", "bands"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "n_shingles long, set_code string, bands array<long>")


def _word_codes(text_col: str) -> Column:
    return F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of class codes whose full shingle sets are similar enough.

    ``a`` may be shared by very many pairs: the texts of ``b`` are joined first, and the second join,
    skewed on ``a``, is one whose partitions Spark splits.
    """
    b_texts = texts.withColumnsRenamed({"c": "b", "text": "tb"})
    a_texts = texts.withColumnsRenamed({"c": "a", "text": "ta"})
    both = pairs.join(b_texts, "b").join(a_texts, "a").select("a", "b", "ta", "tb")

    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        last, known = None, frozenset()
        out = []
        for ta, tb in zip(left, right):
            if ta is not last and ta != last:
                last, known = ta, shingle_set(ta, size)
            other = shingle_set(tb, size)
            common = len(known & other)
            out.append(100 * common >= percent * (len(known) + len(other) - common))
        return pd.Series(out)

    check = F.pandas_udf(similar, "boolean")
    return both.filter(check("ta", "tb")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable, for the nodes of ``edges`` ``(a, b)``.

    Large-star and small-star steps by turns; each moves every node to the least node it sees, so the
    edges become stars around the components' least nodes. Minima combine on the map side and every
    step is stored, so a hot centre or a lost executor costs little. Steps go on until none changes an edge:
    labels only fall, so that comes, after some logarithm of the longest path.
    """
    flipped = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(flipped(edges))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        smaller = down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = smaller.groupBy("a").agg(F.min("b").alias("m"))
        small = smaller.join(low, "a").select("a", "b", "m")
        stars = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(stars.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _differences(rooted: DataFrame, centres: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``a, c, root, n, a_root, a_n, d``: what the set of each member ``c`` of a bucket and the set of its centre ``a`` do not share.

    ``rooted`` holds ``c, band, root, n_shingles``, ``centres`` the buckets ``band`` in question and their centres ``a``.
    """
    classes = rooted.select("c", "root", F.col("n_shingles").alias("n")).distinct()
    centre = classes.withColumnsRenamed({"c": "a", "root": "a_root", "n": "a_n"})
    around = rooted.join(centres, "band").filter("c <> a").select("a", "c", "root", F.col("n_shingles").alias("n")).distinct()
    coded = texts.select("c", _word_codes("text").alias("w"))
    both = around.join(centre, "a").join(coded, "c").join(coded.withColumnsRenamed({"c": "a", "w": "wa"}), "a")

    def apart(left: pd.Series, right: pd.Series) -> pd.Series:
        last, known = None, np.empty(0, np.uint64)
        out = []
        for wa, w in zip(left, right):
            if last is None or not np.array_equal(wa, last):
                last, known = wa, shingle_codes(np.asarray(wa), size)
            out.append(np.setxor1d(known, shingle_codes(np.asarray(w), size), assume_unique=True).view(np.int64))
        return pd.Series(out)

    difference = F.pandas_udf(apart, "array<long>")
    return both.select("a", "c", "root", "n", "a_root", "a_n", difference("wa", "w").alias("d"))


def _pairs_by_differences(away: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of members of one centre and different components that can be linked.

    With ``p = percent / 100`` and ``k = (1 - p) / (1 + p)``, sets of ``n`` and ``m`` elements are linked if they differ in at
    most ``k (n + m)``. Their differences from a common centre, ``d`` and ``e`` in number, share ``o`` elements, and the sets
    differ in ``d + e - 2 o``. So ``2 o >= d + e - k (n + m)``. Where that asks for no common element, both are linked with the
    centre and are in its component. All others meet in one of the rarest elements of their differences, by a prefix
    and a positional filter as for set joins; elements that no other member has take no part.
    """
    k = (100.0 - percent) / (100.0 + percent)
    items = away.select("a", "c", F.explode("d").alias("e"))
    shared = items.groupBy("a", "e").agg(F.count("*").alias("times")).filter("times > 1")
    common = items.join(shared, ["a", "e"]).groupBy("a", "c").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("s"))
    sized = away.select("a", "c", "root", "n", "a_root", F.col("a_n"), F.size("d").alias("nd")).join(common, ["a", "c"])
    # the least number of common elements with any partner; members of the centre's component only have partners outside it
    any_partner = F.col("nd") - F.col("n") * (100.0 - percent) / percent
    outside = (F.col("nd") + k * (F.col("a_n") - F.col("n"))) / 2
    need = F.ceil(F.when(F.col("root") == F.col("a_root"), F.greatest(any_partner, outside)).otherwise(any_partner) - 1e-6)
    length = (F.size("s") - F.greatest(need, F.lit(1)) + 1).cast("int")
    head = F.slice("s", F.lit(1), F.greatest(length, F.lit(0)))
    listed = sized.select("a", "c", "root", "a_root", "n", "nd", F.size("s").alias("ns"), F.posexplode(F.transform(head, lambda x: x["e"])).alias("i", "e"))
    entries = materialize(listed, "difference-prefixes")

    x = entries.filter("root <> a_root").drop("a_root").withColumnsRenamed({"c": "xc", "root": "xr", "n": "xn", "nd": "xd", "ns": "xs", "i": "xi"})
    y = entries.withColumnsRenamed({"c": "yc", "root": "yr", "n": "yn", "nd": "yd", "ns": "ys", "i": "yi"})
    other = (F.col("xr") < F.col("yr")) | ((F.col("yr") == F.col("a_root")) & (F.col("xr") != F.col("yr")))
    alike = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent
    most = F.least("xi", "yi") + F.least(F.col("xs") - F.col("xi"), F.col("ys") - F.col("yi"))
    enough = 2 * most >= F.col("xd") + F.col("yd") - k * (F.col("xn") + F.col("yn")) - 1e-6
    met = x.join(y, ["a", "e"]).filter(other & alike & enough)
    return met.select(F.least("xc", "yc").alias("a"), F.greatest("xc", "yc").alias("b")).distinct()


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                      bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, key, n_shingles, set_code)`` of every document, and the verified links between its distinct sets.

    Documents with equal shingle sets are one class from the start. Classes that share a band meet in
    its bucket. First each is compared with the bucket's most shared member only, which links almost
    all of a group of copies at the cost of one comparison each. Then pairs of one bucket that are
    still in different components are compared, but only those whose differences from that member
    overlap far enough, so that no link that joins components is lost.
    """
    # word codes, not words, cross to Python
    sketched = docs.select(
        F.col(id_col).alias("doc_id"), content_key(F.col(id_col), F.col(text_col)).alias("key"),
        _sketched(size, bands, rows)(_word_codes(text_col)).alias("s"),
    ).select("doc_id", "key", "s.*")
    table = materialize(sketched, "sketches")
    nodes = table.select("doc_id", "key", "n_shingles", "set_code")

    first = F.min_by(F.struct("bands", "n_shingles"), "key").alias("s")
    one = table.filter(F.col("set_code").isNotNull()).groupBy("set_code").agg(first, F.min("key").alias("key"))
    placed = one.select(F.col("set_code").alias("c"), "key", "s.n_shingles", F.explode("s.bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(placed.join(sizes, "band"), "buckets")
    shared = met.groupBy("c").agg(F.sum("n").alias("weight"))
    members = met.select("c", "band").join(shared, "c")
    # the member that meets most others leads its bucket; ties go to the least code
    leaders = materialize(members.groupBy("band").agg(F.max(F.struct("weight", "c"))["c"].alias("a")), "leaders")
    starred = met.select("c", "band").join(leaders, "band").filter("c <> a").select("a", F.col("c").alias("b")).distinct()
    stars = materialize(starred, "stars")
    wanted = met.select("c", "key").distinct()
    in_buckets = docs.select(content_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = materialize(in_buckets.join(wanted, "key").dropDuplicates(["key"]).select("c", "text"), "texts")

    links = materialize(_verified(stars, texts, size, percent), "links")
    roots = components(links)
    labels = met.join(roots, F.col("c") == F.col("node"), "left").select("c", "band", "n_shingles", F.coalesce("root", "c").alias("root"))
    rooted = materialize(labels, "rooted")
    split = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("band")
    centres = leaders.join(split, "band")
    away = materialize(_differences(rooted, centres, texts, size), "differences")
    seen = stars.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    fresh = _pairs_by_differences(away, percent).join(seen, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
    pairs = materialize(fresh, "pairs")
    more = materialize(_verified(pairs, texts, size, percent), "links")
    return nodes, links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, key, n_shingles, component_id, kept``.

    ``component_id`` is the least id reachable by links, ``kept`` marks the document that bears it.

    A text without words (null or empty) is linked with nothing and keeps its own id. Rows are documents
    of their own even if an id repeats; a null id names a component only if all its members are null.
    Texts of fewer words are one shingle. An empty table gives no rows; other columns play no part.
    """
    nodes, links = duplicate_classes(docs, id_col, text_col, **options)
    roots = components(links)
    labelled = nodes.join(roots, F.col("set_code") == F.col("node"), "left").select(
        "doc_id", "key", "n_shingles", F.coalesce("root", "set_code").alias("class")
    )
    least = labelled.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("_least"))
    named = labelled.join(materialize(least, "least"), "class", "left")
    component = F.coalesce(F.when(F.col("class").isNotNull(), F.col("_least")), F.col("doc_id"))
    return named.select("doc_id", "key", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near duplicates, all columns as they were; nulls and empties stay.

    Rows that repeat both id and text are one document listed again and stay or go together. Only the
    keys of the documents to remove are joined back.
    """
    verdict = near_duplicates(docs, id_col, text_col, **options)
    gone = materialize(verdict.filter(~F.col("kept")).select("key").distinct(), "near-duplicates")
    keyed = replace_columns(docs, "_key").withColumn("_key", content_key(F.col(id_col), F.col(text_col)))
    return keyed.join(gone, F.col("_key") == F.col("key"), "left_anti").drop("_key")
