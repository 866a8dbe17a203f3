"""Documents, chunks and vectors for retrieval."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from venuekit.functions import constants as K, lists as L, scalars as S, text as X

def _number(c: str) -> Column:
    """A double as text: whole numbers without a fraction."""
    value = F.col(c)
    whole = value == F.floor(value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def filled(template: str, fields: Mapping[str, Column]) -> Column:
    """Text of a template whose ``{names}`` stand for columns."""
    parts = re.split(r"\{(\w*)\}", template)  # text and names in turn
    return F.concat(*[fields[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def narrative(df: DataFrame) -> Column:
    """Descriptive text of a venue by the template of :mod:`constants`; absent columns count as missing."""
    empty_list = F.array().cast("array<string>")

    def value(name: str) -> Column:
        """Text of a column, NULL when absent, missing or empty."""
        return S.null_if(F.col(name).cast("string"), "") if name in df.columns else F.lit(None).cast("string")

    def joined(name: str, parse, sep: str) -> Column:
        return S.null_if(F.array_join(F.coalesce(parse(name), empty_list), sep), "") if name in df.columns else F.lit(None)

    own = joined("reviews_list", lambda c: L.review_texts(c, drop_marker=False), " ")
    found = {name: value(name) for name in [*K.NARRATIVE_MISSING, *K.NARRATIVE_SENTENCES]}
    found["cost_for_two"] = _number("cost_for_two") if "cost_for_two" in df.columns else F.lit(None)
    found["menu_item"] = joined("menu_item", L.string_items, ", ")
    found["clean_review"] = F.coalesce(found["clean_review"], own)
    fields = {name: F.coalesce(found[name], F.lit(missing)) for name, missing in K.NARRATIVE_MISSING.items()}
    fields |= {name: F.coalesce(filled(sentence, {"": found[name]}), F.lit("")) for name, sentence in K.NARRATIVE_SENTENCES.items()}
    return filled(K.NARRATIVE, fields)


def metadata(df: DataFrame) -> Column:
    """Typed metadata of a venue document; NULL where the source column is absent or missing."""
    source = {"rating": "rate", "sentiment_score": "avg_sentiment_score", "sentiment_label": "dominant_sentiment",
              "review_quality": "review_quality_flag", "rating_is_imputed": "is_rate_imputed"}

    def field(name: str, kind: str) -> Column:
        column = source.get(name, name)
        if name == "doc_type":
            value = F.lit("restaurant")
        elif name == "menu_available":
            value = F.size(L.string_items("menu_item")) > 0 if "menu_item" in df.columns else F.lit(False)
            value = F.coalesce(value, F.lit(False))
        elif name == "rating_is_imputed":
            value = F.coalesce(F.col(column), F.lit(False)) if column in df.columns else F.lit(False)
        else:
            value = F.col(column) if column in df.columns else F.lit(None)
        return value.cast(kind).alias(name)

    return F.struct(*[field(n, k) for n, k in K.META_FIELDS.items()])


def venue_documents(df: DataFrame, key: str) -> DataFrame:
    """``(doc_id, text, meta)``; rows without a name are dropped."""
    named = df.filter(F.col("name").isNotNull())
    return named.select(F.concat(F.lit("venue-"), F.col(key).cast("string")).alias("doc_id"),
                        narrative(named).alias("text"), metadata(named).alias("meta"))


def faq_documents(spark: SparkSession, faqs: Sequence[tuple[str, str]] = K.FAQS) -> DataFrame:
    rows = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(faqs)], "i int, q string, a string")
    fields = {"doc_type": F.lit("faq"), "question": F.col("q")}
    meta = F.struct(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in K.META_FIELDS.items()])
    text = F.concat(F.lit("Q: "), F.col("q"), F.lit(" A: "), F.col("a"))
    return rows.select(F.concat(F.lit("faq-"), F.col("i").cast("string")).alias("doc_id"), text.alias("text"), meta.alias("meta"))


def word_windows(docs: DataFrame, key: str, text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Fixed windows of ``size`` words that share ``overlap`` words; a narrow, one-row-in step."""
    step = size - overlap
    counted = docs.select(key, *keep, X.words(text).alias("_w")).withColumn("_n", F.size("_w"))
    last = F.greatest(F.ceil((F.col("_n") - overlap) / step) - 1, F.lit(0)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("chunk_no"), F.slice("_w", i * step + 1, F.lit(size)).alias("_c")),
    )
    cut = counted.filter(F.col("_n") > 0).select(key, *keep, F.inline(pieces))
    return cut.select(key, *keep, "chunk_no", F.size("_c").alias("n_words"), F.array_join("_c", " ").alias("chunk"))


def sentence_chunks(docs: DataFrame, key: str, text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Whole sentences packed up to ``size`` words; a chunk repeats up to ``overlap`` words of
    trailing sentences of the one before. A sentence above ``size`` is first cut into windows.

    Packing depends on what came before, so it is a fold over the sentences of one row.
    """
    sentences = F.split(F.col(text), r"(?<=[.!?])\s+|\n+")
    pieces = F.flatten(
        F.transform(
            F.filter(F.transform(sentences, X.words), lambda w: F.size(w) > 0),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")),
                lambda i: F.slice(w, i * size + 1, F.lit(size)),
            ),
        )
    )
    piece_type, chunk_type = "array<array<string>>", "array<array<array<string>>>"
    words_in = lambda cur: F.aggregate(cur, F.lit(0), lambda n, w: n + F.size(w))

    def tail(cur: Column, room: Column) -> Column:
        """The longest run of trailing pieces within the overlap and the room left."""
        start = F.struct(F.array().cast(piece_type).alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def take(acc: Column, w: Column) -> Column:
            fits = acc["open"] & (acc["n"] + F.size(w) <= F.least(F.lit(overlap), room))
            return F.struct(
                F.when(fits, F.concat(F.array(w), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
                F.when(fits, acc["n"] + F.size(w)).otherwise(acc["n"]).alias("n"),
                fits.alias("open"),
            )

        return F.aggregate(F.reverse(cur), start, take)["kept"]

    def pack(acc: Column, w: Column) -> Column:
        full = (acc["n"] + F.size(w) > size) & (F.size(acc["cur"]) > 0)
        carried = tail(acc["cur"], F.lit(size) - F.size(w))
        cur = F.when(full, F.concat(carried, F.array(w))).otherwise(F.concat(acc["cur"], F.array(w)))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            cur.alias("cur"),
            F.when(full, words_in(carried) + F.size(w)).otherwise(acc["n"] + F.size(w)).alias("n"),
        )

    zero = F.struct(F.array().cast(chunk_type).alias("done"), F.array().cast(piece_type).alias("cur"), F.lit(0).alias("n"))
    packed = F.aggregate(pieces, zero, pack, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    chunks = docs.select(key, *keep, F.posexplode(packed).alias("chunk_no", "_c")).filter(F.size("_c") > 0)
    flat = F.flatten("_c")
    return chunks.select(key, *keep, "chunk_no", F.size(flat).alias("n_words"), F.array_join(flat, " ").alias("chunk"))


def hashed_vectors(docs: DataFrame, key: str, text: str, dims: int = K.VECTOR_DIMS, keep: Sequence[str] = (),
                   name: str = "embedding") -> DataFrame:
    """Unit vectors by feature hashing of terms and bigrams; map-only, without model or corpus state.

    Texts without terms get the zero vector.
    """
    terms = docs.select(key, *keep, X.with_bigrams(X.index_terms(text)).alias("_terms"))
    counted = HashingTF(numFeatures=dims, inputCol="_terms", outputCol="_counts").transform(terms)
    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.select(key, *keep, vector_to_array("_unit").alias(name))
