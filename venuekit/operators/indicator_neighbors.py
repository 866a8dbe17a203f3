"""Exact nearest neighbours of rows that hold a few numbers and a set of indicators.

The squared distance of two rows is that of their numbers plus the number of indicators that only one of them has, so
no indicator is ever written out as a column of zeros and ones. Index rows of like order form cells, those of a cell form
leaves. What a cell or leaf holds (indicators by bucket, the least number of them, ranges of the numbers) bounds the
distance to all of its rows from below; a query meets its best cell first, then the cells and leaves within its reach.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from venuekit.operators.neighbors import DIGITS, _first_of_rows
from venuekit.session import materialize, spread

CELL_ROWS = 65_536
MAX_CELLS = 4_096
CELL_BUCKETS = 4_096  # indicators of a cell are kept by bucket, so a box is bounded whatever their number
LEAF_BUCKETS = 1_024
LEAF_ROWS = 256
QUERY_BLOCK = 8_192
MAP_BITS = 256
_SORT_CODES = 12
_QUERY_SLICE = 512
_CHUNK = 2_000_000
_TURNS = (2, 8, 32, None)  # leaves a query meets before its reach is narrowed again


class Rows:
    """Numbers and sorted sets of codes of some rows, the sets behind each other."""

    def __init__(self, numbers: np.ndarray, codes: np.ndarray, sizes: np.ndarray):
        self.numbers, self.codes, self.sizes = numbers, codes, sizes
        self.starts = np.r_[0, np.cumsum(sizes)]

    @classmethod
    def of(cls, numbers: pa.Array, codes: pa.Array) -> Rows:
        values, widths = _flat(numbers)
        flat, sizes = _flat(codes)
        table = values.astype(float).reshape(len(widths), -1) if len(widths) else np.zeros((0, 0))
        return cls(table, flat.astype(np.int64), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def padded(self, values: np.ndarray, fill: int, width: int | None = None) -> np.ndarray:
        """``values`` (one per code) as a row per set, ``fill`` behind its end."""
        place = np.arange(len(self.codes)) - np.repeat(self.starts[:-1], self.sizes)
        width = int(self.sizes.max(initial=0)) if width is None else min(width, int(self.sizes.max(initial=0)))
        out, kept = np.full((len(self), width), fill, np.int64), place < width
        out[self.owners[kept], place[kept]] = values[kept]
        return out

    def combined(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        """``values`` (one per code) put together within each set; an empty set gives 0."""
        out, filled = np.zeros(len(self), values.dtype), self.sizes > 0
        if filled.any():
            out[filled] = ufunc.reduceat(values, self.starts[:-1][filled])
        return out


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _reach(score: np.ndarray) -> np.ndarray:
    """Greatest squared distance that may be rounded to ``score`` or less; no limit if there is no number."""
    return np.where(np.isfinite(score), (score + 0.6 * 10.0**-DIGITS) ** 2 * (1 + 1e-12), np.inf)


def _least(held: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, fewest: np.ndarray,
           low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of queries (rows) to the rows of boxes (columns).

    ``held`` tells for each bucket which boxes have an indicator of it, its last row is empty. At most the indicators of a
    query that a box has are shared by one of its rows; all others of both sides differ.
    """
    shared = np.zeros((len(buckets), held.shape[1]), np.uint8 if buckets.shape[1] < 256 else np.int64)
    for j in range(buckets.shape[1]):
        shared += held[buckets[:, j]]
    shared = shared.astype(np.float64)
    out = sizes[:, None] - shared
    np.subtract(fewest[None], shared, out=shared)
    out += np.maximum(shared, 0, out=shared)
    for d in range(numbers.shape[1]):
        own = numbers[:, d, None]
        gap = np.maximum(low[:, d][None] - own, own - high[:, d][None])
        np.maximum(gap, 0, out=gap)
        out += np.square(gap, out=gap)
    return out * (1 - 1e-12)


def _box(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the columns; without a number the range is empty and bounds nothing."""
    low, high = np.fmin.reduce(numbers, 0), np.fmax.reduce(numbers, 0)
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


class Leaves:
    """The rows of a cell in order of their indicators and numbers, cut into leaves."""

    def __init__(self, rows: Rows, queries: Rows, ids: np.ndarray):
        known, places = np.unique(rows.codes, return_inverse=True)
        counts = np.bincount(places, minlength=len(known))
        frequent = np.argsort(-counts, kind="stable")
        rank = np.empty(len(known) + 1, np.int64)
        rank[frequent], rank[-1] = np.arange(len(known)), -1
        at = np.searchsorted(known, queries.codes)
        met = known[np.minimum(at, len(known) - 1)] == queries.codes if len(known) else np.zeros(len(at), bool)
        # codes that no row of the cell has differ from every row: they are only counted
        self.query_ranks, self.n_known = np.where(met, rank[np.where(met, at, -1)], -1), len(known)
        keep = Rows(queries.numbers, self.query_ranks[met], queries.combined(np.add, met.astype(np.int64)))
        self.alien = (queries.sizes - keep.sizes).astype(float)
        self.words = max(1, min(MAP_BITS, len(known)) + 63 >> 6)
        self.exact = len(known) <= 64 * self.words
        ranks = rank[places]

        # the rarest codes that fill a leaf come first: rows that share them are close
        turn = np.empty(len(known), np.int64)
        turn[np.lexsort((counts, counts < LEAF_ROWS))] = np.arange(len(known))
        turns = turn[places]
        sort_codes = rows.padded(turns[np.lexsort((turns, rows.owners))], len(known), _SORT_CODES)
        order = np.lexsort([*rows.numbers.T[::-1], *sort_codes.T[::-1]])
        self.n, self.leaves = len(rows), max(1, -(-len(rows) // LEAF_ROWS))
        full = np.r_[order, np.full(self.leaves * LEAF_ROWS - len(order), order[-1])]
        self.rows, self.ids = full, ids[full]
        shape = (self.leaves, LEAF_ROWS)
        self.maps = [m[full].reshape(shape) for m in self._maps(rows, ranks)]
        self.query_maps = self._maps(keep, keep.codes)
        self.numbers = [rows.numbers[full, d].reshape(shape) for d in range(rows.numbers.shape[1])]
        boxes = [_box(c.T) for c in self.numbers]
        self.low, self.high = (np.array([b[i] for b in boxes]).T.reshape(self.leaves, len(boxes)) for i in (0, 1))
        self.fewest = rows.sizes[full].reshape(shape).min(1).astype(float)

        n_buckets, leaf_of = min(LEAF_BUCKETS, max(1, len(known))), np.empty(len(rows), np.int64)
        leaf_of[order] = np.arange(len(rows)) // LEAF_ROWS
        self.held = np.zeros((n_buckets + 1, self.leaves), np.uint8)
        self.held[ranks % n_buckets, leaf_of[rows.owners]] = 1
        self.query_buckets = keep.padded(keep.codes % n_buckets, n_buckets)
        self.known_rows, self.keep, self.ranks = rows, keep, ranks
        self.pairs_of_codes = None

    def _maps(self, rows: Rows, ranks: np.ndarray) -> list[np.ndarray]:
        """Parity of the codes of each bit: maps of two sets differ in no more bits than the sets in codes, and in just as
        many if each code has its own bit."""
        bits = ranks % (64 * self.words)
        one = np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64))
        return [rows.combined(np.bitwise_xor, np.where(bits >> 6 == w, one, np.uint64(0))) for w in range(self.words)]

    def bounds(self, some: slice) -> np.ndarray:
        own = self.keep.sizes[some] + self.alien[some]
        return _least(self.held, self.query_buckets[some], own, self.keep.numbers[some], self.fewest, self.low, self.high)

    def differences(self, queries: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Bits in which the map of each query differs from those of the rows of the leaf beside it."""
        total = None
        for theirs, mine in zip(self.maps, self.query_maps, strict=True):
            found = theirs[leaves]
            bits = np.bitwise_count(np.bitwise_xor(found, mine[queries][:, None], out=found))
            total = bits.astype(np.uint16 if self.words > 3 else np.uint8, copy=False) if total is None else np.add(total, bits, out=total)
        return total

    def distances(self, queries: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Squared distances (lower bounds of them unless ``exact``) of each query to the rows of the leaf beside it."""
        total = self.differences(queries, leaves) + self.alien[queries][:, None]
        for d, theirs in enumerate(self.numbers):
            diff = theirs[leaves] - self.keep.numbers[queries, d][:, None]
            total += np.square(diff, out=diff)
        return total

    def within(self, queries: np.ndarray, leaves: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, places of rows and distances as of :meth:`distances`, as far as they are in reach; few rows pass by
        their indicators, so only their numbers are read."""
        room = np.floor(np.minimum(reach - self.alien[queries], 64.0 * self.words))
        pairs = np.flatnonzero(room >= 0)
        apart = self.differences(queries[pairs], leaves[pairs])
        at = np.flatnonzero(apart <= np.minimum(room[pairs], np.iinfo(apart.dtype).max).astype(apart.dtype)[:, None])
        pair = pairs[at // LEAF_ROWS]
        cell, mine = leaves[pair] * LEAF_ROWS + at % LEAF_ROWS, queries[pair]
        total = apart.reshape(-1)[at] + self.alien[mine]
        for d, theirs in enumerate(self.numbers):
            total += (theirs.reshape(-1)[cell] - self.keep.numbers[mine, d]) ** 2
        kept = ~(total > reach[pair])
        return pair[kept], cell[kept], total[kept]

    def exact_distances(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Squared distances of each query to the row at the place beside it."""
        if self.pairs_of_codes is None:
            self.pairs_of_codes = np.sort(self.known_rows.owners * self.n_known + self.ranks)
        rows, sizes = self.rows[cells], self.keep.sizes[queries]
        owner = np.repeat(np.arange(len(queries)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wanted = rows[owner] * self.n_known + self.keep.codes[self.keep.starts[queries][owner] + place]
        at = np.minimum(np.searchsorted(self.pairs_of_codes, wanted), len(self.pairs_of_codes) - 1)
        shared = np.bincount(owner[self.pairs_of_codes[at] == wanted], minlength=len(queries)) if len(owner) else np.zeros(len(queries))
        total = self.known_rows.sizes[rows] + sizes + self.alien[queries] - 2.0 * shared
        for d in range(self.keep.numbers.shape[1]):
            total += (self.known_rows.numbers[rows, d] - self.keep.numbers[queries, d]) ** 2
        return total


def best_rows(queries: Rows, index: Rows, ids: np.ndarray, k: int, worst: np.ndarray, own_ids: np.ndarray | None = None,
              stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(queries, rows, scores)``: the ``k`` nearest index rows of each query with scores up to ``worst``, ties by ``ids``.

    ``own_ids`` are ids of the queries that may not be found. ``stats`` receives the number of ``pairs`` compared.
    """
    if not len(index) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    tree, found = Leaves(index, queries, ids), []
    by_id = np.argsort(ids, kind="stable")
    places = np.empty(len(ids), np.int64)
    places[by_id] = np.arange(len(ids))
    place_of = places[tree.rows]
    spare = 0 if own_ids is None else 1
    for start in range(0, len(queries), _QUERY_SLICE):
        some = slice(start, min(start + _QUERY_SLICE, len(queries)))
        bounds, reach = tree.bounds(some), _reach(worst[some])
        rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        waiting = np.ones(bounds.shape, bool)
        for turn in _TURNS:
            near = waiting & ~(bounds > reach[:, None])
            if turn is not None and turn < bounds.shape[1]:
                order = np.argpartition(np.where(near, bounds, np.inf), turn - 1, axis=1)[:, :turn]
                picked = np.zeros_like(near)
                np.put_along_axis(picked, order, True, axis=1)
                near &= picked
            waiting &= ~near
            who, leaf = np.nonzero(near)
            if stats is not None:
                stats["pairs"] = stats.get("pairs", 0) + len(who) * LEAF_ROWS
            step, parts = max(1, _CHUNK // LEAF_ROWS), [(rows, cols, scores)]
            for i in range(0, len(who), step):
                q, at = who[i : i + step], leaf[i : i + step]
                most = reach[q]
                if np.isfinite(most).all():
                    r, cell, squares = tree.within(q + start, at, most)
                else:
                    apart = tree.distances(q + start, at)
                    if tree.exact and LEAF_ROWS > 4 * (k + spare):
                        # padding repeats a row of the last leaf, so it gives no such limit there
                        kth = np.partition(apart, k + spare - 1, axis=1)[:, k + spare - 1]
                        kth = np.where((at < tree.leaves - 1) & np.isfinite(kth), kth, np.inf)
                        most = np.minimum(most, _reach(np.sqrt(kth) + 10.0**-DIGITS))
                    r, c = np.nonzero(~(apart > most[:, None]))
                    cell, squares = at[r] * LEAF_ROWS + c, apart[r, c]
                kept = cell < tree.n
                if own_ids is not None:
                    kept &= tree.ids[cell] != own_ids[q[r] + start]
                r, cell, squares = r[kept], cell[kept], squares[kept]
                if not tree.exact:
                    squares = tree.exact_distances(q[r] + start, cell)
                    kept = ~(squares > most[r])
                    r, cell, squares = r[kept], cell[kept], squares[kept]
                parts.append((q[r], place_of[cell], np.round(np.sqrt(squares), DIGITS)))
            if len(parts) > 1:
                merged = [np.concatenate(p) for p in zip(*parts, strict=True)]
                rows, cols, scores, place = _first_of_rows(*merged, k)
                last = place == k - 1
                reach[rows[last]] = np.minimum(reach[rows[last]], _reach(scores[last]))
        found.append((rows + start, by_id[cols], scores))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _packed(dealt: DataFrame) -> DataFrame:
    """A row per cell, stored: its number, set, indicators by bucket, least number of indicators, ranges of the numbers,
    and all of its rows as one Arrow stream ``packed``, so that a cell is sent on as a whole."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]  # a partition has about the rows of a cell
        if not held:
            return
        table = pa.Table.from_batches(held)
        cell = table["_cell"].to_numpy()
        for c in np.unique(cell):
            mine = table.filter(pa.array(cell == c))
            rows = Rows.of(mine["_vec"], mine["_ones"])
            bits = np.zeros(CELL_BUCKETS, bool)
            bits[rows.codes % CELL_BUCKETS] = True
            stream = pa.BufferOutputStream()
            with pa.ipc.new_stream(stream, (body := mine.drop_columns(["_cell", "_by"]).combine_chunks()).schema) as writer:
                writer.write_table(body)
            ranges = [pa.array([side.tolist()], pa.list_(pa.float64())) for side in _box(rows.numbers)]
            yield pa.RecordBatch.from_arrays([
                pa.array([c], pa.int64()), pa.array([mine["_by"][0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary()),
                pa.array([int(rows.sizes.min())], pa.int64()), *ranges, pa.array([stream.getvalue().to_pybytes()], pa.binary()),
            ], ["_cell", "part", "bits", "fewest", "low", "high", "packed"])

    schema = "_cell long, part long, bits binary, fewest long, low array<double>, high array<double>, packed binary"
    return materialize(dealt.mapInArrow(pack, schema), "cells")


def _cell_boxes(cells: DataFrame) -> tuple[np.ndarray, ...]:
    """Of each cell, at most about ``MAX_CELLS``: number, set, indicators by bucket, least number of them, ranges."""
    found = cells.drop("packed").orderBy("_cell").collect()
    number, part, fewest = (np.array([r[c] for r in found], np.int64) for c in ("_cell", "part", "fewest"))
    bits = np.array([np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)) for r in found])
    held = np.vstack([bits.T, np.zeros((1, len(found)), np.uint8)])
    return number, part, held, fewest.astype(float), np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def _cell_bounds(rows: Rows, by: np.ndarray, boxes: tuple[np.ndarray, ...]) -> np.ndarray:
    """Lower bounds of the squared distances to the cells; infinite for those of other sets."""
    _, part, held, fewest, low, high = boxes
    out = _least(held, rows.padded(rows.codes % CELL_BUCKETS, CELL_BUCKETS), rows.sizes.astype(float), rows.numbers, fewest, low, high)
    return np.where(by[:, None] == part[None], np.where(np.isnan(out), 0, out), np.inf)


def nearest_sets(q: DataFrame, x: DataFrame, k: int, payload: Sequence[str], skip_self: bool, out_type: T.StructType,
                 order: Sequence[str], stats: dict | None = None) -> DataFrame:
    """Candidates ``(_qid, _id, _score, payload...)`` that hold the ``k`` best of each query.

    ``q`` has ``_qid, _qvec, _qones, _by`` and ``x`` ``_id, _vec, _ones, _by, payload..., order...``; a query meets the rows
    with its own ``_by`` only. Rows that agree in ``order`` share a cell as far as possible, it changes no result. ``stats``
    receives the numbers of ``pairs`` of a query and a cell of its set, and of those that were ``searched``.
    """
    spark = x.sparkSession
    size = x.agg(F.count("*").alias("n"), F.coalesce(F.max("_by"), F.lit(0)).alias("by")).first()
    if not size["n"]:
        return spark.createDataFrame([], out_type)
    n_cells = min(MAX_CELLS, -(-size["n"] // CELL_ROWS))
    number = F.spark_partition_id().cast("long") * (size["by"] + 1) + F.col("_by")
    dealt = x.repartitionByRange(n_cells, *[F.col(c) for c in ("_by", *order, "_id")]).withColumn("_cell", number)
    xc = _packed(dealt.select("_id", "_vec", "_ones", "_by", *payload, "_cell"))
    shared = spark.sparkContext.broadcast(_cell_boxes(xc))
    id_type = q.schema["_qid"].dataType
    asked = T.StructType([
        T.StructField("_qid", id_type), *[T.StructField(c, q.schema[c].dataType) for c in ("_qvec", "_qones", "_by")],
        T.StructField("_cell", T.LongType()), T.StructField("_worst", T.DoubleType()),
    ])

    def go_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        step = max(1, _CHUNK // max(1, len(boxes[0])))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                bounds = _cell_bounds(Rows.of(part["_qvec"], part["_qones"]), part["_by"].to_numpy(), boxes)
                home = bounds.argmin(1)
                some = np.isfinite(bounds[np.arange(len(home)), home])
                kept = part.filter(pa.array(some))
                columns = [*[kept[c] for c in ("_qid", "_qvec", "_qones", "_by")], pa.array(boxes[0][home[some]]), pa.array(np.full(some.sum(), np.inf))]
                yield pa.RecordBatch.from_arrays(columns, asked.fieldNames())

    own = materialize(spread(q).select("_qid", "_qvec", "_qones", "_by").mapInArrow(go_home, asked), "home-cells")
    first = materialize(_meet(own, xc, k, payload, skip_self, out_type, asked, shared), "first-cell")
    others = first.filter("_cell IS NOT NULL").select(*asked.fieldNames())
    if stats is not None:
        number, part, *_ = shared.value
        cells = {int(p): int((part == p).sum()) for p in np.unique(part)}
        n = {r["_by"]: r["count"] for r in own.groupBy("_by").count().collect()}
        stats.update(pairs=sum(v * cells.get(p, 0) for p, v in n.items()), searched=sum(n.values()) + others.count())
    found = first.filter("_cell IS NULL").select(*out_type.fieldNames())
    return found.unionByName(_meet(others, xc, k, payload, skip_self, out_type, asked, None).select(*out_type.fieldNames()))


def _meet(asked_rows: DataFrame, xc: DataFrame, k: int, payload: Sequence[str], skip_self: bool, out_type: T.StructType,
          asked: T.StructType, shared) -> DataFrame:
    """The best of each query in the cell it is led to; with the boxes ``shared`` also a row for each other cell in reach.

    The queries of a cell are dealt over slices, which bounds a task; a cell is sent once to each of its slices.
    """
    spark = xc.sparkSession
    # rows of both kinds in one table, the columns of the other kind are missing
    out = T.StructType([T.StructField(f.name, f.dataType) for f in (*out_type.fields, *[f for f in asked.fields if f.name != "_qid"])])
    counts = asked_rows.groupBy("_cell").count().collect()  # a row per cell
    if not counts:
        return spark.createDataFrame([], out)
    sliced = [(r["_cell"], -(-r["count"] // QUERY_BLOCK)) for r in counts]
    slices = F.broadcast(spark.createDataFrame(sliced, "_cell long, _slices int"))
    groups = sum(n for _, n in sliced)
    parts = min(groups, MAX_CELLS)
    keys = ["_cell", "_slice"]
    left = asked_rows.join(slices, "_cell").withColumn("_slice", F.pmod(F.xxhash64("_qid"), F.col("_slices")).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    right = xc.join(slices, "_cell").select("_cell", "packed", copies)
    left, right = left.drop("_slices").repartition(parts, *keys), right.repartition(parts, *keys)
    names, n_found = out.fieldNames(), len(out_type.fields)

    def meet(queries: pa.Table, cell: pa.Table) -> pa.Table:
        index = pa.concat_tables([pa.ipc.open_stream(stream.as_buffer()).read_all() for stream in cell["packed"]])
        q, x = Rows.of(queries["_qvec"], queries["_qones"]), Rows.of(index["_vec"], index["_ones"])
        worst = queries["_worst"].to_numpy().astype(float)
        ids = index["_id"].to_numpy()
        who, rows, scores = best_rows(q, x, ids, k, worst, queries["_qid"].to_numpy() if skip_self else None)
        near = index.take(pa.array(rows))
        columns = [queries["_qid"].take(pa.array(who)), near["_id"], pa.chunked_array([pa.array(scores, pa.float64())]), *[near[c] for c in payload]]
        columns += [pa.chunked_array([pa.nulls(len(who), queries[c].type)]) for c in names[n_found:]]
        table = pa.Table.from_arrays(columns, names)
        if shared is None or not queries.num_rows:
            return table
        # the k-th best found here is the reach of a query in other cells
        boxes, last = shared.value, np.full(len(q), np.inf)
        n = np.bincount(who, minlength=len(q))
        np.maximum.at(most := np.full(len(q), -np.inf), who, np.where(np.isnan(scores), np.inf, scores))
        last[n >= k] = most[n >= k]
        by, home = queries["_by"].to_numpy(), queries["_cell"].to_numpy()
        reach, tables = _reach(last), [table]
        step = max(1, _CHUNK // max(1, len(boxes[0])))
        for start in range(0, len(q), step):
            part = queries.slice(start, step)
            bounds = _cell_bounds(Rows.of(part["_qvec"], part["_qones"]), by[start : start + step], boxes)
            near = np.isfinite(bounds) & ~(bounds > reach[start : start + step, None])
            near &= boxes[0][None] != home[start : start + step, None]
            asks, cells = np.nonzero(near)
            on = part.take(pa.array(asks))
            nothing = [pa.chunked_array([pa.nulls(len(asks), f.type)]) for f in list(table.schema)[1:n_found]]
            ahead = {c: on[c] for c in ("_qvec", "_qones", "_by")} | {
                "_cell": pa.chunked_array([pa.array(boxes[0][cells], pa.int64())]),
                "_worst": pa.chunked_array([pa.array(last[start:][asks], pa.float64())])}
            tables.append(pa.Table.from_arrays([on["_qid"], *nothing, *[ahead[c] for c in names[n_found:]]], names))
        return pa.concat_tables(tables)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)
