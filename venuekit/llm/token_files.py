"""Token-id files: every document's ids as a frame of its own, compressed with one shared dictionary.

A folder holds ``dictionary.zdict``; shards, each a ``.bin`` file of frames and an ``.idx`` file with the hash of the
dictionary, document ids, frame offsets and running id counts; and ``manifest``, a table with a row per shard. Shards
follow each other in ascending order of documents, so one document is read by one seek. Files are written under a
temporary name and moved, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import array
import contextlib
import functools
import hashlib
import os
import struct
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from venuekit.llm.files import get, open_folder, put
from venuekit.session import delete_on_exit, materialize

MAGIC = b"VKTOKEN1"
_HEAD = struct.Struct("<8s32sQQB")  # magic, dictionary hash, documents, ids, bytes of an id
END_ID = 1
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 2_048, 4_000  # the dictionary's sample: so many documents of at most so many characters
SHARD_BYTES = 32 << 20  # a shard is closed when its frames reach this
FRAME_LEVEL = 3
CACHED_WORDS, CACHED_CHARS = 500_000, 64
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PUNCTUATION = ".,;:!?"
_LATIN_END, _WIDE_CAPITAL = "\u0180", "\u0130"  # the one Latin capital whose lower case is two characters
_MANIFEST = "part long, piece long, name string, n_docs long, n_ids long, n_bytes long, first_doc long, last_doc long"
_ROW = "doc_id long, start long, n_tokens long, ids binary"


# --- tokens -------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1 << 16)
def _ends_word(char: str) -> bool:
    """Whether a character is a letter or digit and stays one when composed and put in lower case."""
    plain = unicodedata.normalize("NFC", char)
    return (char + plain + plain.lower()).isalnum()


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word tokenized once.

    White space separates words for such a tokenizer, so a text's ids are those of its pieces between spaces and line
    breaks. Closing punctuation after a letter or digit starts a word of its own too. Words of Latin letters go to the
    tokenizer's model directly, in the form that its normalizer and byte alphabet give them, if single letters show that
    this is the same. The cache saves time only: it is emptied when full and does not hold long pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {"": b""}
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(ord(_LATIN_END))) if c.isalpha() and c != _WIDE_CAPITAL]
        self.form = {c: alphabet.pre_tokenize_str(c)[0][0] for c in letters}
        probes = [c + more for c in letters for more in ("", "a", "É")]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)]
        self.latin = [self._model_ids(p.lower()) for p in probes] == whole

    def _model_ids(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join([self.form[c] for c in word])
        return [t.id for t in self.model.tokenize(word)]

    def _bytes(self, ids: list[int]) -> bytes:
        packed = array.array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _learn(self, pieces: set[str]) -> None:
        known, parts, latin, rest = self.known, [], set(), set()
        for piece in pieces:
            core = piece.rstrip(_PUNCTUATION)
            form = core if core and len(core) < len(piece) and _ends_word(core[-1]) else piece
            tail = piece[len(form) :]
            if self.latin and form.isalpha() and max(form) < _LATIN_END and _WIDE_CAPITAL not in form:
                form = form.lower()
                latin.add(form)
            else:
                rest.add(form)
            rest.add(tail)
            parts.append((piece, form, tail))
        for form in latin:
            if form not in known:
                known[form] = self._bytes(self._model_ids(form))
        rest = [p for p in rest if p not in known]
        for p, encoding in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[p] = self._bytes(encoding.ids)
        known.update({piece: known[form] + known[tail] for piece, form, tail in parts})

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*pieces).difference(self.known)
        self._learn(new)
        out = [b"".join(list(map(self.known.__getitem__, some))) for some in pieces]
        for piece in new:
            if len(piece) > CACHED_CHARS:
                for p in (piece, piece.rstrip(_PUNCTUATION), piece.rstrip(_PUNCTUATION).lower()):
                    self.known.pop(p, None)
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian ids of each text, ``width`` bytes an id."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > 1 << 20:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# --- the dictionary -------------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves; none without samples."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def sample_dictionary(docs: DataFrame, path: str, text_col: str = "text", sample: int = SAMPLE_DOCUMENTS,
                      size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of the ``sample`` short documents of the lowest hashes (the sample bounds memory, not what is written).

    Hashes are cut first, so a partition sends only numbers; rows that repeat a document count once.
    """
    hashed = docs.select(F.col(text_col).alias("text"), F.xxhash64("doc_id", text_col).alias("h"))
    short = hashed.filter(F.char_length("text").between(1, SAMPLE_CHARS))
    lowest = short.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h"))
    chosen = short.filter(F.col("h") <= lowest.scalar()).groupBy("h").agg(F.min("text").alias("text"))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((h, t) for frame in frames for h, t in zip(frame["h"], frame["text"]))
        data = train_dictionary([ids for ids in encoder(path).encode(t for _, t in rows) if ids], size)
        yield pd.DataFrame({"data": [data]})

    found = chosen.repartition(1).mapInPandas(train, "data binary").first()
    return bytes(found["data"]) if found else b""


# --- files ----------------------------------------------------------------------------------


def pack_index(digest: bytes, width: int, docs: list[int | None], ends: list[int], counts: list[int]) -> bytes:
    """Index of a shard: header; ids with a byte each for null; frame offsets and running id counts; checksum."""
    body = b"".join([
        _HEAD.pack(MAGIC, digest, len(docs), counts[-1], width), np.array([d or 0 for d in docs], "<i8").tobytes(),
        bytes(d is None for d in docs), np.array(ends, "<u8").tobytes(), np.array(counts, "<u8").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class ShardIndex:
    """An index file: ``docs`` (None for null), ``ends`` and ``counts``, both starting at 0."""

    def __init__(self, data: bytes):
        body, check = data[:-4], struct.unpack("<I", data[-4:])[0]
        magic, self.digest, n, self.n_ids, self.width = _HEAD.unpack_from(body)
        if magic != MAGIC or zlib.crc32(body) != check:
            raise ValueError("not an intact token index")
        at = _HEAD.size
        docs, null = np.frombuffer(body, "<i8", n, at), np.frombuffer(body, "u1", n, at + 8 * n)
        self.docs = [None if gone else int(d) for d, gone in zip(docs, null)]
        self.ends = np.frombuffer(body, "<u8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(body, "<u8", n + 1, at + 17 * n + 8)


def _frames(path: str, dictionary: bytes, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Texts to compressed frames of ids."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(path)
        end = end_id.to_bytes(words.width, "little")
        compressor = zstandard.ZstdCompressor(level=FRAME_LEVEL, dict_data=_dictionary(dictionary))
        for frame in frames:
            for at in range(0, len(frame), 512):
                some = frame.iloc[at : at + 512]
                sizes, packed = [], []
                for ids in words.encode(some["text"]):
                    sizes.append(len(ids) // words.width + 1)
                    packed.append(compressor.compress(ids + end))
                yield some.drop(columns="text").assign(n=sizes, frame=packed)

    return build


def _shards(folder: str, digest: bytes, width: int, shard_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sorted frames of a partition to shard files; yields the manifest's rows."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, piece = TaskContext.get().partitionId(), 0
        held, docs, ends, counts = [], [], [0], [0]

        def close() -> pd.DataFrame:
            name = f"shard-{part:06d}-{piece:06d}"
            put(folder, f"{name}.bin", held)
            put(folder, f"{name}.idx", [pack_index(digest, width, docs, ends, counts)])
            row = (part, piece, name, len(docs), counts[-1], ends[-1], docs[0], docs[-1])
            columns = [c.split()[0] for c in _MANIFEST.split(", ")]
            return pd.DataFrame([row], columns=columns).astype({"first_doc": "Int64", "last_doc": "Int64"})

        for frame in frames:
            for doc, null, n, data in zip(frame["doc"], frame["no_id"], frame["n"], frame["frame"]):
                held.append(data)
                docs.append(None if null else int(doc))
                ends.append(ends[-1] + len(data))
                counts.append(counts[-1] + int(n))
                if ends[-1] >= shard_bytes:
                    yield close()
                    piece += 1
                    held, docs, ends, counts = [], [], [0], [0]
        if docs:
            yield close()

    return write


def write_token_files(docs: DataFrame, folder: str, path: str, text_col: str = "text", end_id: int = END_ID,
                      shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of every whole text below ``folder`` in ascending order of ``doc_id``.

    Null texts are empty: their only id is ``end_id``. A null ``doc_id`` comes first, rows of one ``doc_id`` follow each
    other by a hash of their text, repeated rows are all written, an empty table gives a dictionary and no shard. Texts
    are not shuffled, only their frames.
    """
    spark = docs.sparkSession
    dictionary = sample_dictionary(docs, path, text_col)
    digest = hashlib.sha256(dictionary).digest()
    put(folder, "dictionary.zdict", [dictionary])
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    framed = rows.mapInPandas(_frames(path, dictionary, end_id), "doc long, no_id boolean, h long, n long, frame binary")
    with _batches(spark, BATCH_ROWS):
        stored = materialize(framed.withColumn("row", F.monotonically_increasing_id()), "token-frames")
    order = [F.col("no_id").desc(), F.col("doc"), F.col("h"), F.col("row")]
    dealt = stored.repartitionByRange(*order).sortWithinPartitions(*order)
    width = encoder(path).width
    with _batches(spark, BATCH_ROWS):
        manifest = materialize(dealt.mapInPandas(_shards(folder, digest, width, shard_bytes), _MANIFEST), "token-manifest")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed.write.mode("overwrite").parquet(f"{folder}/manifest")


@contextlib.contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand at most ``rows`` rows to Python at a time: whole texts and frames are long."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def _open_shard(folder: str, name: str, dictionary: bytes) -> ShardIndex:
    index = ShardIndex(get(folder, f"{name}.idx"))
    if index.digest != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{name} was written with another dictionary")
    return index


def _ids(index: ShardIndex, data: bytes, decompressor: zstandard.ZstdDecompressor) -> bytes:
    """Ids of a frame as little-endian unsigned 32-bit integers."""
    return np.frombuffer(decompressor.decompress(data), f"<u{index.width}").astype("<u4").tobytes()


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in a folder; ``ids`` as 32-bit little-endian integers."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = get(folder, "dictionary.zdict")
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        fs, root = open_folder(folder)
        for frame in frames:
            for name, start in zip(frame["name"], frame["start"]):
                index, out, held = _open_shard(folder, name, dictionary), [], 0
                with fs.open_input_stream(f"{root}/{name}.bin") as source:
                    for i, doc in enumerate(index.docs):
                        ids = _ids(index, source.read(int(index.ends[i + 1] - index.ends[i])), decompressor)
                        out.append((doc, int(start + index.counts[i]), len(ids) // 4, ids))
                        held += len(ids)
                        if held > 8 << 20 or len(out) >= 4_096:
                            yield _rows(out)
                            out, held = [], 0
                if out:
                    yield _rows(out)

    shards = spark.read.parquet(f"{folder}/manifest").select("name", "start")
    return shards.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(read, _ROW)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of :func:`read_token_files` of some documents, read by their offsets: shards without them stay closed."""
    wanted = sorted(set(doc_ids))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = get(folder, "dictionary.zdict")
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        fs, root = open_folder(folder)
        for frame in frames:
            for name, start in zip(frame["name"], frame["start"]):
                index, out = _open_shard(folder, name, dictionary), []
                with fs.open_input_file(f"{root}/{name}.bin") as source:
                    for i, doc in enumerate(index.docs):
                        if doc in chosen:
                            source.seek(int(index.ends[i]))
                            ids = _ids(index, source.read(int(index.ends[i + 1] - index.ends[i])), decompressor)
                            out.append((doc, int(start + index.counts[i]), len(ids) // 4, ids))
                if out:
                    yield _rows(out)

    chosen = frozenset(wanted)
    shards = spark.read.parquet(f"{folder}/manifest")
    holds = F.exists(F.lit(wanted).cast("array<long>"), lambda d: d.between(F.coalesce("first_doc", F.lit(-(2**63))), F.col("last_doc")))
    return shards.filter(holds).select("name", "start").repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, _ROW)


def token_table(docs: DataFrame, folder: str, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files of ``docs`` and read them back; the folder goes when the session ends."""
    delete_on_exit(docs.sparkSession, folder)
    write_token_files(docs, folder, path, shard_bytes=shard_bytes)
    return read_token_files(docs.sparkSession, folder)
