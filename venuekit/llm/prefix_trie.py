"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A conversation becomes a byte string, 16 bytes for each turn, so that byte order is turn order. The strings are dealt out
by range; a run of neighbours is put into one radix tree, whose nodes grow from 4 to 16, 48 and 256 places and hold the
bytes that all keys below share only once. Depths that are a multiple of 16 bytes are trie nodes. Every figure of a node
adds up over trees, because each key knows how many turns it shares with its neighbours in the whole order: the first key
of a prefix owns its node, the last one tells whether the node has children.

Long conversations are cut into segments of ``SEGMENT`` turns, each a key of its own below the node where the segment
before ended. No row, tree or task holds a whole conversation, group of copies or subtree.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from venuekit.operators.ranking import ranked
from venuekit.session import materialize

WIDTH = 16  # bytes of a turn id
SEGMENT = 256  # turns of one key
BLOCK_BYTES = 4 << 20  # keys of one tree
UNKNOWN = -2
ORDER = ["seg", "p1", "p2", "key", "continues", "conv_id"]  # of segments

_NODE = "depth long, a long, b long, pa long, pb long, turn_key string, conv_id long, n_convs long, n_children long, n_leaves long, total long, own long, ids array<long>"


# --- turns and paths -----------------------------------------------------------------------


def turn_key(role: Column, text: Column) -> Column:
    """Id of a turn as 32 hex digits: 128 bits of a digest of the role, its length and the text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(framed.cast("binary"), 256), 1, 2 * WIDTH)


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv_id, pos, turn_key, n``: turns by position; ``n`` is the number of code points of the text.

    Rows without ``conv_id`` take no part. Turns are ordered by ``turn``, null first, ties by ``turn_key``; a repeated
    row is a turn of its own. Texts are not shuffled.
    """
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        turn_key(F.col(role_col), F.col(text_col)).alias("turn_key"),
        F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).alias("n"),
    )
    placed = materialize(
        ranked(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_key")], "at").drop("turn"), "turns"
    )
    starts = placed.groupBy("conv_id").agg(F.min("at").alias("start"))
    return placed.join(starts, "conv_id").select("conv_id", (F.col("at") - F.col("start")).alias("pos"), "turn_key", "n")


def share_openings(turns: DataFrame, base: Column, length: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first ``length`` turns of conversation ``base`` in place of their own.

    Returns the rebuilt turns and the ids of all conversations, the turnless ones included. ``base`` and ``length`` (at
    most ``longest``) are expressions over ``conv_id``; a base that is absent gives no turns, a short one all it has.
    """
    turns = materialize(turns, "own-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    heads = turns.filter(F.col("pos") < longest).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_key", "n"))).alias("head")
    )
    convs = sizes.select("conv_id", base.cast("long").alias("base"), length.cast("int").alias("h")).join(heads, "base", "left")
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array())
    convs = convs.select("conv_id", "h", F.coalesce(head, F.array()).alias("head"))
    convs = materialize(convs, "openings")
    opening = convs.select("conv_id", F.inline("head"))
    rest = turns.join(convs.select("conv_id", "h", F.size("head").alias("taken")), "conv_id").filter(F.col("pos") >= F.col("h"))
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "n")
    return opening.unionByName(rest), convs.select("conv_id")


def _hash_halves(value: Column) -> list[Column]:
    digest = F.sha2(value, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)]


def _segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """Keys of at most ``segment`` turns; ``p1, p2`` identify what precedes a segment, ``q1, q2`` what it ends at."""
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).cast("long").alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_key", "n"))).alias("t")
    )
    keyed = cut.select(
        "conv_id", "seg", F.unhex(F.array_join(F.transform("t", lambda x: x["turn_key"]), "")).alias("key"),
        F.transform("t", lambda x: x["n"].cast("int")).alias("lens"),
    )
    bare = convs.join(keyed.filter("seg = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("seg"), F.lit(b"").alias("key"), F.array().cast("array<int>").alias("lens")
    )
    h1, h2 = _hash_halves(F.concat(F.col("seg").cast("string").cast("binary"), F.lit(b":"), F.col("key")))
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
    keyed = materialize(keyed.unionByName(bare).withColumns({"h1": h1, "h2": h2, "sum": total}), "segments")
    # only conversations of several segments enter the window, a slim row for each segment
    several = keyed.groupBy("conv_id").agg(F.max("seg").alias("top")).filter("top > 0")
    order = Window.partitionBy("conv_id").orderBy("seg")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    chain = keyed.select("conv_id", "seg", "h1", "h2", "sum").join(several, "conv_id").select(
        "conv_id", "seg", "top", F.coalesce(F.sum("sum").over(after), F.lit(0)).alias("later_total"),
        *[F.coalesce(F.bit_xor(f"h{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)],
    )
    linked = keyed.join(chain, ["conv_id", "seg"], "left").na.fill(0, ["top", "later_total", "p1", "p2"])
    return linked.select(
        "conv_id", "seg", "top", "key", "lens", "later_total", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), (F.col("seg") < F.col("top")).alias("continues"),
    )


# --- neighbours in the whole order ----------------------------------------------------------


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of whole turns that two keys begin with alike."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // WIDTH


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for frame in frames:
        frame["prev"] = UNKNOWN
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        groups, keys = list(zip(frame["seg"], frame["p1"], frame["p2"])), list(frame["key"])
        prev = frame["prev"].to_numpy(copy=True)
        for i in range(1, len(keys)):
            prev[i] = shared_turns(keys[i - 1], keys[i]) if groups[i - 1] == groups[i] else -1
        frame["prev"] = prev
        frame["next"] = np.append(prev[1:], UNKNOWN)
        held = frame.iloc[-1:].drop(columns="next")
        if len(frame) > 1:
            yield frame.iloc[:-1]
    if held is not None:
        yield held.assign(next=UNKNOWN)


@F.pandas_udf(LongType())
def _shared(alike: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_turns(x, y) if same else -1 for same, x, y in zip(alike, a, b)], dtype="int64")


def _linked(segments: DataFrame) -> DataFrame:
    """Segments in key order with the turns shared with the rows before and after (-1: another group, or none).

    Equal keys that go on in a later segment come last. Copies are dealt out by their ids, so no slice holds a whole
    group of copies. Only the first and the last row of a slice wait for the slices beside it.
    """
    dealt = segments.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_slice", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, StructField("prev", LongType()), StructField("next", LongType())])
    runs = materialize(dealt.mapInPandas(_neighbours, schema), "runs")
    edges = runs.filter((F.col("prev") == UNKNOWN) | (F.col("next") == UNKNOWN))
    beside = Window.orderBy("_slice", F.col("prev") != UNKNOWN)  # at most two rows a slice
    same = [F.lag(c).over(beside).alias(f"_before_{c}") for c in ("seg", "p1", "p2", "key")]
    other = [F.lead(c).over(beside).alias(f"_after_{c}") for c in ("seg", "p1", "p2", "key")]
    edges = edges.select("*", *same, *other)

    def reach(side: str) -> Column:
        alike = F.lit(True)
        for c in ("seg", "p1", "p2"):
            alike = alike & F.col(c).eqNullSafe(F.col(f"_{side}_{c}"))
        return _shared(alike, F.col("key"), F.coalesce(F.col(f"_{side}_key"), F.lit(b"")))

    # the other rows of a slice lie between its two edges: each edge is a slice of its own from here on
    edges = edges.withColumns({
        "_slice": (-2 * F.col("_slice") - F.when(F.col("prev") == UNKNOWN, 1).otherwise(2)).cast("int"),
        "prev": F.when(F.col("prev") == UNKNOWN, reach("before")).otherwise(F.col("prev")),
        "next": F.when(F.col("next") == UNKNOWN, reach("after")).otherwise(F.col("next")),
    })
    return runs.filter((F.col("prev") != UNKNOWN) & (F.col("next") != UNKNOWN)).unionByName(edges.select(*runs.columns))


def _with_later(linked: DataFrame) -> DataFrame:
    """Adds what the later segments of the same conversation own: text lengths, leaves, and whether the next one is a new child."""
    linked = materialize(linked, "linked")
    n_turns = F.size("lens")
    own = F.aggregate(F.slice("lens", F.greatest("prev", F.lit(0)).cast("int") + 1, F.greatest(n_turns, F.lit(1))), F.lit(0).cast("long"), lambda s, x: s + x)
    leaf = (~F.col("continues") & (F.col("next") < n_turns)).cast("long")
    slim = linked.filter("top > 0").select("conv_id", "seg", own.alias("own"), leaf.alias("leaf"), (F.col("prev") <= 0).cast("long").alias("fresh"))
    order = Window.partitionBy("conv_id").orderBy("seg")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    later = slim.select(
        "conv_id", "seg", F.sum("own").over(after).alias("later_own"), F.sum("leaf").over(after).alias("later_leaf"),
        F.lead("fresh").over(order).alias("later_child"),
    )
    alone = linked.filter("top = 0").select("*", *[F.lit(0).cast("long").alias(c) for c in ("later_own", "later_leaf", "later_child")])
    joined = linked.filter("top > 0").join(later, ["conv_id", "seg"]).na.fill(0, ["later_own", "later_leaf", "later_child"])
    # dealt anew: the ends of a node must stay in order within a slice
    again = joined.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_slice", -1 - F.spark_partition_id())
    return alone.unionByName(again).withColumn("leaf", leaf)


# --- the radix tree -------------------------------------------------------------------------


class RadixNode:
    """An adaptive node: 4 or 16 sorted bytes with their children, a 256-byte index of 48 children, or 256 children."""

    __slots__ = ("prefix", "end", "rows", "room", "index", "kids")

    def __init__(self, prefix: bytes, end: int):
        self.prefix, self.end, self.rows = prefix, end, []
        self.room, self.index, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> RadixNode | None:
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            return self.kids[self.index[byte] - 1] if self.index[byte] else None
        at = bisect_left(self.index, byte)
        return self.kids[at] if at < len(self.index) and self.index[at] == byte else None

    def add(self, byte: int, kid: RadixNode) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room == 256:
            self.kids[byte] = kid
        elif self.room == 48:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)
        else:
            at = bisect_left(self.index, byte)
            self.index.insert(at, byte)
            self.kids.insert(at, kid)

    def replace(self, byte: int, kid: RadixNode) -> None:
        at = byte if self.room == 256 else self.index[byte] - 1 if self.room == 48 else bisect_left(self.index, byte)
        self.kids[at] = kid

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray(256)
            for place, byte in enumerate(self.index, 1):
                index[byte] = place
            self.room, self.index = 48, index
        else:
            kids = [None] * 256
            for byte, place in enumerate(self.index):
                if place:
                    kids[byte] = self.kids[place - 1]
            self.room, self.index, self.kids = 256, bytearray(), kids

    def children(self) -> list[RadixNode]:
        return [k for k in self.kids if k is not None]


class RadixTree:
    """Keys of any length with path compression; a key that ends inside another one is kept at its own node."""

    def __init__(self):
        self.root = RadixNode(b"", 0)

    def insert(self, key: bytes, row: int) -> None:
        above, byte, node, at = None, 0, self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                node = self._split(above, byte, node, at, key)
            at = node.end
            if at == len(key):
                node.rows.append(row)
                return
            above, byte = node, key[at]
            node = above.child(byte)
            if node is None:
                leaf = RadixNode(key[at + 1 :], len(key))
                leaf.rows.append(row)
                above.add(byte, leaf)
                return
            at += 1

    @staticmethod
    def _split(above: RadixNode, byte: int, node: RadixNode, at: int, key: bytes) -> RadixNode:
        same, prefix = 0, node.prefix
        while same < len(prefix) and at + same < len(key) and prefix[same] == key[at + same]:
            same += 1
        upper = RadixNode(prefix[:same], at + same)
        upper.add(prefix[same], node)
        node.prefix = prefix[same + 1 :]
        above.replace(byte, upper)
        return upper


def _node_id(seg: int, p1: int, p2: int) -> bytes:
    return hashlib.blake2b(struct.pack(">qqq", seg, p1, p2), digest_size=WIDTH).digest()


class _Run:
    """One tree over neighbouring segments of one group, and the trie nodes it stands for."""

    def __init__(self, seg: int, p1: int, p2: int, segment: int):
        self.seg, self.root_id, self.segment = seg, _node_id(seg, p1, p2), segment
        self.tree, self.rows, self.bytes = RadixTree(), [], 0

    def add(self, row) -> None:
        self.tree.insert(row.key, len(self.rows))
        self.rows.append(row)
        self.bytes += len(row.key) + 64

    def _ids(self, row, first: int, last: int) -> list[bytes]:
        """Ids of the nodes on a row's path at local depths ``first`` to ``last``."""
        digest = hashlib.blake2b(self.root_id, digest_size=WIDTH)
        digest.update(row.key[: WIDTH * max(first, 0)])
        found = []
        for k in range(first, last + 1):
            if k > first:
                digest.update(row.key[WIDTH * (k - 1) : WIDTH * k])
            if k == 0:
                found.append(self.root_id)
            elif k == self.segment:
                found.append(_node_id(self.seg + 1, row.q1, row.q2))
            else:
                found.append(digest.copy().digest())
        return found

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_NODE``; children are summed before their parents, without recursion."""
        order, stack = [], [(self.tree.root, None)]
        while stack:
            node, above = stack.pop()
            order.append((node, above))
            stack.extend((kid, node) for kid in node.children())
        sums = {}
        for node, above in reversed(order):
            figures = sums.pop(id(node), None) or [0, None, None, 0, 0, 0, 0, None]
            for i in node.rows:
                row = self.rows[i]
                _merge(figures, (1, row.conv_id, row.prev, row.later_total, row.later_own, row.later_leaf + row.leaf, row.later_child, i))
            cnt, conv, prev, total, own, leaves, fresh, some = figures
            depth = node.end // WIDTH
            top = above.end // WIDTH + 1 if above is not None else 0
            if some is None:  # the root of an empty tree
                continue
            row = self.rows[some]
            ids = self._ids(row, top - 1, depth) if depth >= top else []
            for k in range(depth, top - 1, -1):
                if k == 0 and self.seg > 0:
                    break
                length = int(row.lens[k - 1]) if k else 0
                mine = prev < k
                total += cnt * length
                own += length if mine else 0
                ends = None
                if k * WIDTH == node.end and node.rows:
                    ends = sorted(self.rows[i].conv_id for i in node.rows if not self.rows[i].continues) or None
                a, b = struct.unpack(">qq", ids[k - top + 1])
                pa, pb = struct.unpack(">qq", ids[k - top]) if k or self.seg else (None, None)
                yield (self.seg * self.segment + k, a, b, pa, pb, row.key[WIDTH * (k - 1) : WIDTH * k].hex() if k else None,
                       conv, cnt, fresh, leaves, total, own, ends)
                fresh = int(mine)
            if above is not None:
                _merge(sums.setdefault(id(above), [0, None, None, 0, 0, 0, 0, None]), (cnt, conv, prev, total, own, leaves, fresh, some))


def _merge(into: list, values: tuple) -> None:
    for i in (0, 3, 4, 5, 6):
        into[i] += values[i]
    for i in (1, 2):
        into[i] = values[i] if into[i] is None else min(into[i], values[i])
    into[7] = values[7] if into[7] is None else into[7]


def _partial_nodes(segment: int, block_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Trees over runs of neighbours, a new one at each group, slice and ``block_bytes``."""
    columns = [c.split()[0] for c in _NODE.split(", ")]

    def table(rows: list[tuple]) -> pd.DataFrame:
        # column by column: parent ids may be missing and must not pass through floats
        return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in ("pa", "pb") else list(v) for c, v in zip(columns, zip(*rows))})

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            run, group, out = None, None, []
            for row in frame.itertuples(index=False):
                here = (row.slice_no, row.seg, row.p1, row.p2)
                if here != group or run.bytes > block_bytes:
                    if run is not None:
                        out.extend(run.nodes())
                    run, group = _Run(row.seg, row.p1, row.p2, segment), here
                run.add(row)
                if len(out) > 50_000:
                    yield table(out)
                    out = []
            for node in run.nodes() if run is not None else ():
                out.append(node)
                if len(out) > 50_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    return build


# --- the trie -------------------------------------------------------------------------------


def partial_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of each tree, before those of different trees are added up; stored."""
    ready = _with_later(_linked(_segments(turns, convs, segment))).withColumnRenamed("_slice", "slice_no")
    return materialize(ready.mapInPandas(_partial_nodes(segment, block_bytes), _NODE), "partial-nodes")


def trie_nodes(partial: DataFrame) -> DataFrame:
    """One row per node: ``a, b`` (its id), ``depth``, ``turn_key`` of its last turn, ``conv_id`` and ``parent_conv_id``
    (smallest members), ``n_convs, n_children, n_leaves, saved_tokens``."""
    merged = partial.groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("depth", "pa", "pb", "turn_key")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")], (F.sum("total") - F.sum("own")).alias("saved_tokens"),
    )
    merged = materialize(merged, "nodes")
    parents = merged.filter("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return merged.join(parents, ["pa", "pb"], "left").drop("pa", "pb")


def trie_ends(partial: DataFrame) -> DataFrame:
    """Pieces ``a, b, first, ids``: conversations that end at a node, ascending; pieces of a node do not overlap."""
    return partial.filter(F.col("ids").isNotNull()).select("a", "b", F.element_at("ids", 1).alias("first"), "ids")


def _end_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    node, digest, last = None, None, None
    for frame in frames:
        found = []
        for a, b, ids in zip(frame["a"], frame["b"], frame["ids"]):
            if (a, b) != node:
                if node is not None:
                    found.append((*node, digest.hexdigest()))
                node, digest, last = (a, b), hashlib.sha256(), None
            if last is not None and ids[0] < last:
                raise ValueError("pieces of a node's ends overlap")
            digest.update(((b"" if last is None else b",") + ",".join(map(str, ids)).encode()))
            last = ids[-1]
        yield pd.DataFrame(found, columns=["a", "b", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of each node's ends; a group of any size passes as a stream of pieces."""
    dealt = ends.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return dealt.mapInPandas(_end_digests, "a long, b long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The trie of all conversations, each opened by turns of the first of its hundred.

    Conversation ``c`` begins with the first ``crc32(c) % 6`` turns of ``c - c % 100`` and goes on with its own later
    turns. Returns a row per node as :func:`trie_nodes`, with ``ends_sha256``. Null roles and texts count as empty, rows
    without ``conv_id`` take no part, ties of ``turn`` are ordered by the turn's id, repeated rows are further turns,
    other columns are ignored, and an empty table has no nodes.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    turns, convs = share_openings(ordered_turns(conversations), F.col("conv_id") - F.col("conv_id") % 100, h, 5)
    partial = partial_trie(turns, convs, segment, block_bytes)
    nodes = trie_nodes(partial).join(end_digests(trie_ends(partial)), ["a", "b"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
