"""A stored index of chunks and vectors that is brought up to date instead of built again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from venuekit.operators.corpus import hashed_vectors, sentence_chunks
from venuekit.session import materialize


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    stored = context._jvm.org.apache.hadoop.fs.Path(path)
    return stored.getFileSystem(context._jsc.hadoopConfiguration()).exists(stored)


def _last_build(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """Number and documents (``doc_id, content, segment``) of the last finished build; -1 and None before the first."""
    if not _exists(spark, f"{folder}/documents"):
        return -1, None
    builds = spark.read.parquet(f"{folder}/documents")
    last = builds.agg(F.max("build")).first()[0]
    return (-1, None) if last is None else (last, builds.filter(F.col("build") == last).drop("build"))


def update_index(docs: DataFrame, folder: str, text: str = "text", keep: Sequence[str] = ("meta",)) -> dict[str, int]:
    """Bring the index in ``folder`` in line with ``docs`` (``doc_id``, a text and kept columns).

    Documents are told apart by a hash of their text and kept columns. Only new or changed ones are cut into chunks and
    vectorised, as a new segment; the list of documents of the build says which segment holds each of them, and leaves
    out those that are gone. Nothing is written when nothing changed. Returns the number of the build and of the
    documents that were ``indexed``, ``reused`` and ``removed``.
    """
    spark = docs.sparkSession
    last, known = _last_build(spark, folder)
    content = F.sha2(F.to_json(F.struct(text, *keep), {"ignoreNullFields": "false"}), 256)
    hashed = materialize(docs.select("doc_id", text, *keep, content.alias("content")).dropDuplicates(["doc_id", "content"]), "hashed")
    if known is None:
        known = spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content string, segment int")
    changed = materialize(hashed.join(known, ["doc_id", "content"], "left_anti"), "changed")
    reused = known.join(hashed.select("doc_id", "content"), ["doc_id", "content"], "left_semi")
    counts = {"indexed": changed.count(), "reused": reused.count()}
    counts["removed"] = known.count() - counts["reused"]
    if last >= 0 and not counts["indexed"] and not counts["removed"]:
        return {"build": last, **counts}
    build = last + 1
    chunks = sentence_chunks(changed, "doc_id", text, keep=["content", *keep])
    chunks = chunks.withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")))
    vectors = hashed_vectors(chunks, "chunk_id", "chunk", keep=["doc_id", "content", "chunk_no", "chunk", *keep])
    vectors.write.mode("overwrite").parquet(f"{folder}/chunks/segment={build}")
    listed = reused.unionByName(changed.select("doc_id", "content", F.lit(build).alias("segment")))
    listed.write.mode("overwrite").parquet(f"{folder}/documents/build={build}")  # a build counts from here on
    return {"build": build, **counts}


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, vectors and kept columns of the last build."""
    _, known = _last_build(spark, folder)
    if known is None:
        raise ValueError(f"{folder} holds no index")
    return spark.read.parquet(f"{folder}/chunks").join(known, ["doc_id", "content", "segment"]).drop("content", "segment")
