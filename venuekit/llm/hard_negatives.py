"""Hard-negative mining by cover trees over norm-augmented vectors.

Every vector gets one more coordinate that brings all of them to the same length, so a small distance is a large inner
product. Neighbouring vectors make a block and a block a cover tree: the children of a node lie further apart than the covering
radius of their level, and every vector below a child lies within its radius.
For a query of length ``q`` the inner products below a node differ from that of its centre by at most ``q`` times the
radius. The search opens nodes best first, skips those whose bounds lie outside of every window or below the scores
already found, and verifies the vectors of the others one by one with exact integer products.

Trees and query blocks are files in the shared folder; a task reads the trees its row names. What is shuffled are the
vectors once, and the first few scores of each query and group of trees.
"""

from __future__ import annotations

import functools
import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from venuekit.llm.files import get, put
from venuekit.operators.ranking import row_hash
from venuekit.session import delete_on_exit, materialize, scratch_path

PIVOTS = 16  # coarsest centres, by which vectors are dealt into blocks
BLOCK = 2_048  # vectors of a tree
QUERY_BLOCK = 512
GROUP = 4  # trees that a task searches for one query block
LEAF = 256  # vectors verified together
BASE = 1.3  # covering radii of successive levels
_POOL = 8  # smaller children are verified with their parent
EXACT = 2**53

_POINT = "id long, label long, v array<double>, aux double, pivot int, far double"
_FILE = "part long, piece long, name string"
_FOUND = "key long, slot int, id long, score long"


# --- the tree -------------------------------------------------------------------------------


class CoverTree:
    """Nodes ``centre, radius``; the vectors verified with a node and its children stand together, children follow."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, centre: np.ndarray, radius: np.ndarray,
                 bags: np.ndarray, kids: np.ndarray):
        self.points, self.ids, self.labels = points, ids, labels
        self.centre, self.radius, self.bags, self.kids = centre, radius, bags, kids

    @classmethod
    def build(cls, points: np.ndarray, aux: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> CoverTree:
        whole = np.column_stack([points, aux])

        def spans(centre: int, members: np.ndarray) -> np.ndarray:
            return np.sqrt(((whole[members] - whole[centre]) ** 2).sum(1))

        everything = np.arange(len(points))
        nodes, order, at = [(0, everything, spans(0, everything))], [], 0
        centre, radius, bags, kids = [], [], [], []
        while at < len(nodes):  # breadth first: the children of a node are numbered in a row
            c, members, far = nodes[at]
            r = float(far.max()) if len(far) else 0.0
            bag, first = [], len(nodes)
            if len(members) <= leaf or r == 0.0:
                bag.append(members)
            else:
                left, left_far, head = members, far, c
                while len(left):
                    near = left_far <= r / BASE
                    taken, taken_far = left[near], left_far[near]
                    if len(taken) <= _POOL:
                        bag.append(taken)
                    else:
                        nodes.append((head, taken, taken_far))
                    left = left[~near]
                    if len(left):
                        head = int(left[0])
                        left_far = spans(head, left)
            centre.append(c)
            radius.append(r * (1 + 1e-9) + 1e-6)
            kids.append((first, len(nodes)))
            held = np.sort(np.concatenate(bag)) if bag else everything[:0]
            start = sum(len(b) for b in order)
            order.append(held[np.argsort(ids[held], kind="stable")])
            bags.append((start, start + len(held)))
            at += 1
        dealt = np.concatenate(order)
        return cls(points[dealt], ids[dealt], labels[dealt], points[centre], np.array(radius), np.array(bags), np.array(kids))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points.astype(np.float64), ids=self.ids, labels=self.labels, centre=self.centre,
                 radius=self.radius, bags=self.bags, kids=self.kids)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as held:
            return cls(**{k: held[k] for k in held.files})


class Slots:
    """Open searches: a query's window of scores, ``low`` to ``high``, and the best ``k`` found in it so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, owner: np.ndarray, low: np.ndarray,
                 high: np.ndarray, k: int, same_label: bool):
        self.q, self.ids, self.labels, self.owner = queries, ids, labels, owner
        self.length = np.sqrt((queries**2).sum(1))
        self.low, self.high, self.k, self.same = low.astype(float), high.astype(float), k, same_label
        n = len(owner)
        self.floor, self.floor_id = self.low.copy(), np.full(n, np.iinfo(np.int64).max)
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def open(self, products: np.ndarray, radius: float) -> tuple[np.ndarray, float]:
        """Slots that a node may add to, by its centre's products with all queries, and its best bound."""
        reach = self.length * radius
        reach += np.abs(products) * 1e-12
        upper, lower = (products + reach)[self.owner], (products - reach)[self.owner]
        active = np.flatnonzero((upper >= self.floor) & (lower <= self.high))
        return active, float(upper[active].max()) if len(active) else -np.inf

    def verify(self, active: np.ndarray, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        rows, where = np.unique(self.owner[active], return_inverse=True)
        product = self.q[rows] @ points.T
        allowed = (labels[None, :] == self.labels[rows][:, None]) == self.same
        allowed &= ids[None, :] != self.ids[rows][:, None]
        product = np.where(allowed, product, np.nan)[where]
        floor, at = self.floor[active][:, None], self.floor_id[active][:, None]
        fits = ((product > floor) | ((product == floor) & (ids[None, :] < at))) & (product <= self.high[active][:, None])
        i, j = np.nonzero(fits)
        if not len(i):
            return
        slot = np.concatenate([self.slot, active[i]])
        score, found = np.concatenate([self.score, product[i, j]]), np.concatenate([self.id, ids[j]])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], found[keep]
        full = rank == self.k - 1
        self.floor[slot[full]], self.floor_id[slot[full]] = score[full], found[full]


def search(tree: CoverTree, slots: Slots) -> int:
    """Best-first descent; returns the number of vectors that were verified."""
    verified, count = 0, 0
    first = slots.q @ tree.centre[0]
    active, best = slots.open(first, tree.radius[0])
    heap = [(-best, count, 0, first)] if len(active) else []
    while heap:
        _, _, node, products = heapq.heappop(heap)
        active, _ = slots.open(products, tree.radius[node])  # scores found since may close it
        if not len(active):
            continue
        start, end = tree.bags[node]
        for at in range(start, end, LEAF):
            piece = slice(at, min(end, at + LEAF))
            slots.verify(active, tree.points[piece], tree.ids[piece], tree.labels[piece])
            verified += piece.stop - piece.start
        lo, hi = tree.kids[node]
        if hi > lo:
            product = slots.q @ tree.centre[lo:hi].T
            for kid in range(lo, hi):
                below, best = slots.open(product[:, kid - lo], tree.radius[kid])
                if len(below):
                    count += 1
                    heapq.heappush(heap, (-best, count, kid, product[:, kid - lo]))
    return verified


# --- blocks ---------------------------------------------------------------------------------


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, v``: rows without id, label or vector, or with a null or non-finite component, take no part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
    return rows.filter(F.when(usable, finite).otherwise(False)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")
    )


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    if len(vectors) and all(len(v) == dims for v in vectors):
        return np.stack(vectors.to_numpy()).astype(float)
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _augmented(points: DataFrame) -> tuple[DataFrame, int]:
    """Stored points with the added coordinate, nearest pivot and distance to it."""
    points = materialize(points, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = points.agg(F.max(norm).alias("norm"), F.max(F.size("v")).alias("dims")).first()
    longest, dims = top["norm"] or 0.0, top["dims"] or 0
    if longest >= EXACT:
        raise ValueError("components are too large for exact inner products in 53 bits")
    chosen = points.select("v", row_hash("id").alias("h")).orderBy("h").limit(PIVOTS).select("v").toPandas()
    centres = _matrix(chosen["v"], dims)
    centres = np.column_stack([centres, np.sqrt(np.maximum(longest - (centres**2).sum(1), 0))])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            v = _matrix(frame["v"], dims)
            aux = np.sqrt(np.maximum(longest - (v**2).sum(1), 0))
            apart = 2 * longest - 2 * np.column_stack([v, aux]) @ centres.T
            pivot = apart.argmin(1)
            far = np.sqrt(np.maximum(apart[np.arange(len(v)), pivot], 0))
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "v": list(v), "aux": aux, "pivot": pivot, "far": far})

    return materialize(points.mapInPandas(place, _POINT), "points"), dims


def _files(frames: Iterator[pd.DataFrame], size: int, save: Callable[[str, pd.DataFrame], None]) -> Iterator[pd.DataFrame]:
    """Cut the sorted rows of a partition into files of ``size`` rows of one pivot, and name them."""
    part, piece, held = TaskContext.get().partitionId(), 0, None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        while len(held):
            same = (held["pivot"] == held["pivot"].iat[0]).to_numpy()
            n = min(size, len(same) if same.all() else int(same.argmin()))
            if n < size and n == len(held):
                break  # more rows may follow
            name = f"{part:06d}-{piece:06d}"
            save(name, held.iloc[:n])
            yield pd.DataFrame([(part, piece, name)], columns=["part", "piece", "name"])
            held, piece = held.iloc[n:].reset_index(drop=True), piece + 1
    if held is not None and len(held):
        name = f"{part:06d}-{piece:06d}"
        save(name, held)
        yield pd.DataFrame([(part, piece, name)], columns=["part", "piece", "name"])


def _dealt(points: DataFrame) -> DataFrame:
    order = ["pivot", "far", "id"]
    return points.repartitionByRange(*order).sortWithinPartitions(*order)


def build_trees(points: DataFrame, folder: str, dims: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A cover tree of every block as ``tree-<name>``; returns the stored names."""

    def save(name: str, rows: pd.DataFrame) -> None:
        tree = CoverTree.build(_matrix(rows["v"], dims), rows["aux"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy(), leaf)
        put(folder, f"tree-{name}", [tree.pack()])

    return materialize(_dealt(points).mapInPandas(lambda frames: _files(frames, block, save), _FILE), "trees")


def _query_blocks(queries: DataFrame, folder: str, dims: int, kind: str) -> DataFrame:
    """Blocks of queries with their windows as ``<kind>-<name>``."""

    def save(name: str, rows: pd.DataFrame) -> None:
        owner = np.repeat(np.arange(len(rows)), [len(w) for w in rows["low"]])
        number = np.concatenate([np.arange(len(w)) for w in rows["low"]])
        out = io.BytesIO()
        np.savez(out, v=_matrix(rows["v"], dims), key=rows["key"].to_numpy(), id=rows["id"].to_numpy(), label=rows["label"].to_numpy(), owner=owner,
                 number=number, low=np.concatenate(rows["low"].to_list()), high=np.concatenate(rows["high"].to_list()))
        put(folder, f"{kind}-{name}", [out.getvalue()])

    return materialize(_dealt(queries).mapInPandas(lambda frames: _files(frames, QUERY_BLOCK, save), _FILE), kind)


def _search_all(trees: DataFrame, blocks: DataFrame, folder: str, kind: str, k: int, same_label: bool) -> DataFrame:
    """The best ``k`` of each query and window in each group of trees: ``key, slot, id, score``."""
    spark = trees.sparkSession
    n_trees = trees.count()
    groups = -(-n_trees // GROUP)
    numbered = trees.withColumn("n", F.row_number().over(Window.orderBy("part", "piece")) - 1)  # a row for 2,048 vectors
    grouped = numbered.groupBy(F.floor(F.col("n") / GROUP).cast("long").alias("g")).agg(F.array_sort(F.collect_list("name")).alias("trees"))
    if not groups:
        return spark.createDataFrame([], _FOUND)
    pairs = blocks.select(F.col("name").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    pairs = pairs.join(grouped, "g").repartition(4 * spark.sparkContext.defaultParallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = functools.lru_cache(maxsize=2 * GROUP)(lambda name: CoverTree.unpack(get(folder, f"tree-{name}")))
        for frame in frames:
            for block, names in zip(frame["block"], frame["trees"]):
                with np.load(io.BytesIO(get(folder, f"{kind}-{block}"))) as held:
                    b = {name: held[name] for name in held.files}
                slots = Slots(b["v"], b["id"], b["label"], b["owner"], b["low"], b["high"], k, same_label)
                for name in names:
                    search(load(name), slots)
                at = slots.slot
                yield pd.DataFrame({"key": b["key"][b["owner"][at]], "slot": b["number"][at].astype("int32"), "id": slots.id, "score": slots.score.astype("int64")})

    return pairs.mapInPandas(run, _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# --- mining ---------------------------------------------------------------------------------


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Positives of each anchor, and for each of them the highest scoring negatives within a window of its score.

    ``vectors`` holds ``id, label, v`` with whole-numbered components, as :func:`clean_vectors` and a rounding give
    them; ``is_anchor`` is an expression over ``id``. A positive is one of the ``n_positives`` rows of the anchor's
    label (another ``id``) of the highest inner product with it; a negative has another label and
    ``low * positive <= 100 * score <= high * positive``. Higher scores come first, ties by smaller ``id``; fewer are
    returned where there are fewer. A tree holds ``block`` vectors at most and verifies ``leaf`` together. Repeated rows each count, as candidates and as anchors. Shorter vectors count as
    ending in zeros. An empty table gives no rows. Squared lengths of 2^53 or more are refused, because products would
    not be exact.
    """
    spark = vectors.sparkSession
    folder = scratch_path(spark, "cover-trees")
    delete_on_exit(spark, folder)
    points, dims = _augmented(vectors)
    trees = build_trees(points, folder, dims, block, leaf)
    anchors = materialize(points.filter(is_anchor).withColumn("key", F.monotonically_increasing_id()), "anchors")
    everything = anchors.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    blocks = _query_blocks(everything, folder, dims, "anchors")
    positives = _first(_search_all(trees, blocks, folder, "anchors", n_positives, True), ["key"], n_positives)
    positives = materialize(positives.select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    lowest, highest = F.ceil(low * F.col("positive_score") / 100), F.floor(high * F.col("positive_score") / 100)
    windows = positives.select("key", F.struct("rank", lowest.cast("double").alias("low"), highest.cast("double").alias("high")).alias("w"))
    windows = windows.groupBy("key").agg(F.array_sort(F.collect_list("w")).alias("w"))  # at most n_positives
    asked = anchors.join(windows, "key").withColumns({"low": F.col("w.low"), "high": F.col("w.high")}).drop("w")
    blocks = _query_blocks(asked, folder, dims, "windows")
    negatives = _first(_search_all(trees, blocks, folder, "windows", n_negatives, False), ["key", "slot"], n_negatives)
    negatives = negatives.select("key", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("key", F.col("id").alias("anchor_id")).join(positives.withColumnRenamed("rank", "place"), "key")
    return named.join(negatives, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
