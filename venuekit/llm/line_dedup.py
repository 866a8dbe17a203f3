"""Line deduplication by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from venuekit.llm.common import replace_columns
from venuekit.operators.ranking import ranked
from venuekit.session import materialize

PERCENT, SHINGLE = 80, 1  # a token is a run of so many words
RARITY_BITS, BLOOM_BITS = 22, 24
GROWTH = 16  # lines of a code that are compared with the next ones, as a multiple of the round before
_OTHER_SPACE = r"[\x09-\x0D]"


def line_words(line: Column) -> Column:
    """Words of a line; the usual line is split at plain spaces without a pattern."""
    split = F.when(line.rlike(_OTHER_SPACE), F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))
    return F.array_remove(split, "")


def _once(name: str, value: Column) -> Column:
    """A generator of the one value: what is built on it, filters too, does not evaluate it again."""
    return F.inline(F.array(F.struct(value.alias(name))))


def packed_table(cells: DataFrame, cell_bits: int, total_bits: int) -> Column:
    """Cells ``i, v`` as one array of ``2^total_bits / (64 / cell_bits)`` longs: a lookup table of fixed size."""
    per_long = 64 // cell_bits
    placed = cells.select(
        (F.col("i") / per_long).cast("long").alias("at"),
        F.call_function("shiftleft", F.col("v").cast("long"), ((F.col("i") % per_long) * cell_bits).cast("int")).alias("w"),
    )
    words = placed.groupBy("at").agg(F.bit_or("w").alias("w"))
    all_words = cells.sparkSession.range(2**total_bits // per_long).withColumnRenamed("id", "at").join(words, "at", "left")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("w", F.lit(0)).cast("long").alias("w"))))
    table = materialize(all_words.agg(F.transform(ordered, lambda x: x["w"]).alias("t")), "table")
    return table.select("t").scalar()


def packed_lookup(table: Column, i: Column, cell_bits: int) -> Column:
    per_long = 64 // cell_bits
    word = F.element_at(table, (F.shiftright(i, per_long.bit_length() - 1) + 1).cast("int"))
    place = (i.bitwiseAND(F.lit(per_long - 1)) * cell_bits).cast("int")
    return F.call_function("shiftright", word, place).bitwiseAND(F.lit(2**cell_bits - 1))


def shingles(words: Column, size: int, of: Callable[[Column], Column]) -> Column:
    """Distinct runs of ``size`` words, each as ``of`` shows it."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: of(F.slice(words, i, size))))


def _run_hashes(hashes: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, by the hashes of the words (at least ``size`` of them)."""
    if size == 1:
        return hashes
    starts = F.slice(hashes, F.lit(1), F.size(hashes) - (size - 1))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, size)]))


def _bucket(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit(2**bits - 1))


def rarity_table(docs: DataFrame, text_col: str, size: int = SHINGLE, bits: int = RARITY_BITS) -> Column:
    """Step (0 to 15) on a logarithmic scale of the corpus count of the tokens in each of ``2^bits`` hash buckets.

    All tokens of all texts are counted; the table has the same 2 MB whatever the corpus holds. Step 0 is a count of
    one: its token is in one line only.
    """
    if size == 1:
        split = F.split(F.lower(text_col), r"[\x20\x09-\x0D]+")
        hashed = docs.select(F.explode(split).alias("w")).filter("w <> ''").select(_bucket(F.xxhash64("w"), bits).alias("i"))
    else:
        words = docs.select(_once("h", F.transform(line_words(F.lower(text_col)), lambda w: F.xxhash64(w)))).filter(F.size("h") >= size)
        hashed = words.select(F.explode(_run_hashes(F.col("h"), size)).alias("t")).select(_bucket(F.col("t"), bits).alias("i"))
    counts = materialize(hashed.groupBy("i").agg(F.count("*").alias("n")), "token-counts")
    total = counts.agg(F.sum("n").alias("n")).select("n").scalar()
    # logarithmic steps from a count of two to the whole corpus
    step = F.greatest(F.log2(total.cast("double")) / 14, F.lit(1.0))
    more = F.least(F.lit(15), 1 + F.floor(F.log2("n") / step))
    return packed_table(counts.select("i", F.when(F.col("n") == 1, 0).otherwise(more).alias("v")), 4, bits)


def _least_overlap(n: Column, percent: int) -> Column:
    """Least number of shared words with any similar line."""
    return F.ceil(n * percent / 100.0 - 1e-9).cast("int")


def _parity(hashes: Column, half: int) -> Column:
    """Half of a map of 128 bits: a bit tells whether an odd number of tokens falls on it."""

    def flip(bits: Column, h: Column) -> Column:
        on = F.shiftrightunsigned(h, 62).bitwiseAND(F.lit(1))
        return bits.bitwiseXOR(F.call_function("shiftleft", on if half else 1 - on, F.shiftrightunsigned(h, 56).cast("int").bitwiseAND(F.lit(63))))

    return F.aggregate(hashes, F.lit(0).cast("long"), flip)


def _line_table(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """``doc_id, dk, line_no, id, c1, c2, n, b1, b2, skip, prefix`` of every line with at least ``size`` words.

    ``id`` numbers the lines in the order of document id (nulls first), text hash and line number. The tokens of a line are
    its distinct runs of ``size`` words, ``n`` in number; ``c1, c2`` is the 128-bit hash of their set, ``b1, b2`` its
    parity map. The rarest tokens, by the rarity table, then by hash, one order for the whole corpus, are the prefix. Its first
    ``skip`` tokens are in no other line; ``prefix`` holds 31-bit codes of the others.
    """
    rarity = rarity_table(docs, text_col, size)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("dk"), F.col(text_col).alias("text"))
    breaks = F.regexp_count("text", F.lit("\n"))
    listed = keyed.select("doc_id", "dk", breaks.alias("last")).filter("last IS NOT NULL").distinct()
    numbered = ranked(listed, [F.col("doc_id").asc_nulls_first(), F.col("dk")], "o")
    places = materialize(numbered.withColumnsRenamed({"doc_id": "_d", "dk": "_k"}), "documents")
    room = places.agg(F.max("last") + 1).scalar().cast("long")

    lines = keyed.select("doc_id", "dk", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    worded = lines.select("doc_id", "dk", "line_no", _once("h", F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)))).filter(F.size("h") >= size)
    sets = worded.select("doc_id", "dk", "line_no", _once("u", F.sort_array(F.array_distinct(_run_hashes(F.col("h"), size)))))
    enough = sets.withColumn("_rarity", rarity)

    def key(h: Column) -> Column:
        rare = packed_lookup(F.col("_rarity"), _bucket(h, RARITY_BITS), 4)
        return F.shiftleft(rare, 32).bitwiseOR(F.shiftright(h, 24).bitwiseAND(F.lit(0x7FFFFFFF)))

    n = F.size("u")
    head = F.slice(F.sort_array(F.transform("u", key)), F.lit(1), n - _least_overlap(n, percent) + 1)
    described = enough.select(
        "doc_id", "dk", "line_no", F.xxhash64("u").alias("c1"), F.xxhash64(F.lit(1), "u").alias("c2"), n.alias("n"),
        _parity(F.col("u"), 0).alias("b1"), _parity(F.col("u"), 1).alias("b2"), head.alias("head"),
    )
    codes = F.transform(F.filter("head", lambda k: k >= 2**32), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    cut = described.select("doc_id", "dk", "line_no", "c1", "c2", "n", "b1", "b2", F.size("head").alias("_h"), codes.alias("prefix"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("dk") == F.col("_k"))
    placed = cut.join(places, same).withColumn("id", F.col("o") * room + F.col("line_no"))
    skip = (F.col("_h") - F.size("prefix")).alias("skip")
    return placed.select("doc_id", "dk", "line_no", "id", "c1", "c2", "n", "b1", "b2", skip, "prefix")


def _may_match(percent: int) -> Column:
    """Length, positional and parity filters for entries ``x`` and ``y`` of one code.

    A token that is in one of two sets only flips one bit of the map, so sets differ in as many tokens as their maps in bits,
    or in more; those that overlap far enough differ in few.
    """
    both = F.col("nx") + F.col("ny")
    need = F.ceil(both * percent / (100.0 + percent) - 1e-9)
    after = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    bound = F.lit(1) + F.least("px", "py") + after - 1
    short, long = F.least("nx", "ny"), F.greatest("nx", "ny")
    apart = F.bit_count(F.col("b1x").bitwiseXOR(F.col("b1y"))) + F.bit_count(F.col("b2x").bitwiseXOR(F.col("b2y")))
    return (short * 100 >= long * percent) & (bound >= need) & (apart <= both - 2 * need)


def _similar(pairs: DataFrame, docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """The pairs ``x, y`` of line ids whose whole token sets are similar.

    The words are read again from the documents. A bit table of fixed size over the wanted lines and their documents keeps
    the others from being split and exchanged; what passes it by chance falls out in the join.
    """
    wanted = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "_i")
    found_at = lines.join(wanted, F.col("id") == F.col("_i")).select("id", "doc_id", "dk", "line_no").distinct()
    places = materialize(found_at, "wanted-lines")
    whole, place = F.xxhash64("doc_id", "dk"), F.xxhash64("doc_id", "dk", "line_no")
    marks = places.select(F.explode(F.array(_bucket(whole, BLOOM_BITS), _bucket(place, BLOOM_BITS))).alias("i")).distinct()
    bloom = packed_table(marks.withColumn("v", F.lit(1)), 1, BLOOM_BITS)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("dk"), F.col(text_col).alias("text"))
    some = keyed.filter(packed_lookup(bloom, _bucket(whole, BLOOM_BITS), 1) == 1)
    split = some.select("doc_id", "dk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    passed = split.filter(packed_lookup(bloom, _bucket(place, BLOOM_BITS), 1) == 1)
    named = places.withColumnsRenamed({"doc_id": "_d", "dk": "_k", "line_no": "_l"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("dk") == F.col("_k")) & (F.col("line_no") == F.col("_l"))
    found = passed.join(named, same).groupBy("id").agg(F.min("line").alias("line"))
    worded = found.select("id", _once("v", line_words(F.lower("line"))))
    tokens = materialize(worded.select("id", shingles(F.col("v"), size, lambda g: F.array_join(g, " ")).alias("w")), "line-tokens")
    both = pairs.join(tokens.select(F.col("id").alias("y"), F.col("w").alias("wy")), "y").join(
        tokens.select(F.col("id").alias("x"), F.col("w").alias("wx")), "x"
    )
    common = F.size(F.array_intersect("wx", "wy"))
    return both.filter(common * (100 + percent) >= (F.size("wx") + F.size("wy")) * percent).select("x", "y")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                   size: int = SHINGLE) -> DataFrame:
    """``doc_id, dk, gone``: per document the numbers of the lines that repeat an earlier one.

    A line repeats an earlier line if their sets of tokens (lower-case words, or runs of ``size`` of them) have a
    Jaccard similarity of at least ``percent`` / 100. Lines stand in the order of id (nulls first), text hash and
    line number; lines with fewer than ``size`` words neither repeat nor are repeated.

    Lines with equal sets are one class and only a class's first line is joined. Every first line
    is compared with the earliest line of each of its prefix tokens; that settles most of a family of
    copies with one comparison each. Lines still without a match then meet the other earlier lines that share a prefix token and
    pass the length, positional and parity filters: first the 15 next of each token, then 16 times as many in every round, until
    all were met. Members of a family that are unlike its first line but like another mostly leave within the first
    rounds, at a few comparisons each. Candidates are verified on whole lines.
    """
    lines = materialize(_line_table(docs, id_col, text_col, percent, size), "lines")
    firsts = materialize(lines.groupBy("c1", "c2").agg(F.min("id").alias("first")).select("first"), "first-lines")

    own = lines.join(firsts, F.col("id") == F.col("first"), "left_semi")
    listed = own.select("id", "n", "skip", "b1", "b2", F.posexplode("prefix").alias("at", "code"))
    entries = listed.select("code", "id", "n", (F.col("at") + F.col("skip")).alias("p"), "b1", "b2")
    parts = entries.columns[1:]
    group = Window.partitionBy("code").orderBy("id")
    so_far = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = entries.withColumns({f"{c}x": F.first(c).over(so_far) for c in parts} | {"rank": F.row_number().over(group)}).filter("id > idx")
    followers = materialize(led.withColumnsRenamed({c: f"{c}y" for c in parts}), "followers")
    tried = materialize(followers.filter(_may_match(percent)).select(F.col("idx").alias("x"), F.col("idy").alias("y")).distinct(), "star-pairs")
    hits = materialize(_similar(tried, docs, lines, id_col, text_col, percent, size).select("y").distinct(), "matched")

    # both lines of the pairs left come after the earliest line of a code they share
    later = followers.select("code", *[f"{c}y" for c in parts])
    earlier = followers.select("code", *[F.col(f"{c}y").alias(f"{c}x") for c in parts], "rank")
    largest = followers.agg(F.max("rank")).first()[0] or 0
    low = 1
    while low < largest:
        asked = later.join(hits, F.col("idy") == F.col("y"), "left_anti")
        some = earlier.filter((F.col("rank") > low) & (F.col("rank") <= low * GROWTH)).drop("rank")
        met = asked.join(some, "code").filter((F.col("idx") < F.col("idy")) & _may_match(percent))
        pairs = met.select(F.col("idx").alias("x"), F.col("idy").alias("y")).distinct().join(tried, ["x", "y"], "left_anti")
        untried = materialize(pairs, "pairs")
        found = _similar(untried, docs, lines, id_col, text_col, percent, size).select("y").distinct()
        hits, tried = materialize(hits.unionByName(found), "matched"), tried.unionByName(untried)
        low *= GROWTH

    kept = materialize(firsts.join(hits, F.col("first") == F.col("y"), "left_anti"), "kept-lines")
    gone = lines.select("id", "doc_id", "dk", "line_no").join(kept, F.col("id") == F.col("first"), "left_anti")
    return gone.groupBy("doc_id", "dk").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every document with the lines removed that repeat an earlier line; adds ``n_lines`` and ``n_removed``.

    The other lines keep their order, wording and line breaks. A null text has no lines and stays null;
    an empty text stays empty; a text that loses all lines becomes empty and its row stays. Rows with
    the same id and text are one document and lose the same lines. An empty table gives no rows.
    Columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    gone = materialize(repeated_lines(docs, id_col, text_col, **options), "gone-lines")
    named = gone.withColumnsRenamed({"doc_id": "_d", "dk": "_k"})
    base = replace_columns(docs, "n_lines", "n_removed", "_dk").withColumn("_dk", F.xxhash64(text_col))
    joined = base.join(named, F.col(id_col).eqNullSafe(F.col("_d")) & (F.col("_dk") == F.col("_k")), "left")
    split = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("gone", i)), "\n")
    removed = F.coalesce(F.size("gone"), F.lit(0))
    counted = joined.withColumns({
        "n_lines": F.coalesce(F.size(split), F.lit(0)), "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(removed),
        text_col: F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(left),
    })
    return counted.drop("_dk", "_d", "_k", "gone")
