"""Exact nearest neighbours and top-k vector search.

Scores are computed on blocks with numpy inside Spark tasks: a matrix product finds the
pairs that can be among the best, and those are scored exactly. A task hands on at most
``k`` candidates per query, never all pairs. A query set of checked size is broadcast to
the partitions of the index. Otherwise the index is cut into cells of like rows; each query
meets the cell of the nearest centre, and then the cells whose box and ranges of distances
to pivots leave room for a closer neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from venuekit.operators.ranking import ranked, row_hash, top_k
from venuekit.session import materialize, spread

BROADCAST_CELLS = 4_000_000
BROADCAST_ROWS = 65_536  # queries that meet every row; more are led to cells
QUERY_BLOCK = 16_384
INDEX_BLOCK = 8_192
MAX_CELLS = 4_096
PIVOTS = 32
_QUERY_SLICE = 512
_FIRST_COLUMNS = 1_024
_CHUNK_CELLS = 4_000_000
DIGITS = 9


def _scores(queries: np.ndarray, block: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is closer: Euclidean distance or negated cosine, rounded so that ties are stable."""
    if metric == "cosine":
        qn, bn = np.linalg.norm(queries, axis=1), np.linalg.norm(block, axis=1)
        scale = np.outer(np.where(qn > 0, qn, 1.0), np.where(bn > 0, bn, 1.0))
        return np.round(-(queries @ block.T) / scale, DIGITS)
    out = np.empty((len(queries), len(block)))
    step = max(1, _CHUNK_CELLS // max(1, block.size))
    for start in range(0, len(queries), step):
        diff = queries[start : start + step, None, :] - block[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return np.round(out, DIGITS)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k smallest per row; ties by position (columns are in id order)."""
    m = scores.shape[1]
    if m <= k:
        return np.broadcast_to(np.arange(m), scores.shape)
    ticks = np.rint(scores * 10**DIGITS)
    if np.abs(ticks).max() < 2**61 / m:
        unique = ticks.astype(np.int64) * m + np.arange(m)
        return np.argpartition(unique, k - 1, axis=1)[:, :k]
    return np.argsort(scores, axis=1, kind="stable")[:, :k]


def _paired_scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of ``a`` with the same rows of ``b``."""
    if metric == "cosine":
        an, bn = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return np.round(-np.einsum("ij,ij->i", a, b) / (np.where(an > 0, an, 1.0) * np.where(bn > 0, bn, 1.0)), DIGITS)
    return np.round(np.sqrt(np.einsum("ij,ij->i", a - b, a - b)), DIGITS)


def _first_of_rows(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int):
    """The ``k`` least scores of each row, ties by column."""
    order = np.lexsort((cols, scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[place < k], cols[place < k], scores[place < k], place[place < k]


def _best_pairs(queries: np.ndarray, vectors: np.ndarray, k: int, metric: str, worst: np.ndarray):
    """``(rows, cols, scores)`` of the ``k`` best columns per row with scores up to ``worst``, ties by column.

    Columns pass in growing parts. A matrix product orders them up to rounding; only those that can beat the ``k``-th best
    so far are scored exactly.
    """
    if metric == "cosine":
        qn, vn = np.linalg.norm(queries, axis=1, keepdims=True), np.linalg.norm(vectors, axis=1, keepdims=True)
        left, right = -queries / np.where(qn > 0, qn, 1.0), vectors / np.where(vn > 0, vn, 1.0)
        own, square, error = np.zeros(len(queries)), np.zeros(len(vectors)), np.full(len(queries), 1e-12)
    else:
        centre = vectors.mean(0)
        left, right = queries - centre, vectors - centre
        own, square = (left**2).sum(1), (right**2).sum(1)
        left, error = -2 * left, 1e-12 * (own + square.max())

    def bound(score: np.ndarray) -> np.ndarray:
        """Greatest product of a pair whose score is at most ``score``."""
        return score + error if metric == "cosine" else np.where(score < 0, -np.inf, np.maximum(score, 0) ** 2 * (1 + 1e-12) - own + error)

    half = 0.6 * 10.0**-DIGITS  # scores are rounded
    limit = bound(worst + half)
    rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, width = 0, max(_FIRST_COLUMNS, 2 * k)
    while at < len(vectors):
        product = left @ right[at : at + width].T + square[at : at + width]
        if not np.isfinite(product).all():  # missing or infinite numbers: every pair in full
            full = _scores(queries, vectors, metric)
            picked = np.array(_best(full, k))
            every = np.repeat(np.arange(len(picked)), picked.shape[1])
            return every, picked.reshape(-1), full[every, picked.reshape(-1)]
        hits = product <= limit[:, None]
        if product.shape[1] > k and np.count_nonzero(hits) > 8 * k * len(queries):
            kth = np.partition(product, k - 1, axis=1)[:, k - 1]
            apart = kth if metric == "cosine" else np.sqrt(np.maximum(kth + own + error, 0))
            hits &= product <= np.maximum(bound(apart + 2 * half), kth + 2 * error)[:, None]
        r, c = np.nonzero(hits)
        step = max(1, _CHUNK_CELLS // max(1, vectors.shape[1]))
        found = [_paired_scores(queries[r[i : i + step]], vectors[at + c[i : i + step]], metric) for i in range(0, len(r), step)]
        if found:
            merged = np.r_[rows, r], np.r_[cols, at + c], np.r_[scores, np.concatenate(found)]
            rows, cols, scores, place = _first_of_rows(*merged, k)
            full_rows = place == k - 1
            # a later column must have a lower score
            limit[rows[full_rows]] = np.minimum(limit, bound(_spread_over(scores[full_rows], rows[full_rows], len(limit)) - half * 2 / 3))[rows[full_rows]]
        at += width
        width = max(_FIRST_COLUMNS, min(2 * width, _CHUNK_CELLS // len(queries)))
    return rows, cols, scores


def _spread_over(values: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.inf)
    out[places] = values
    return out


def _local_top(qids: np.ndarray, queries: np.ndarray, block: pd.DataFrame, k: int, metric: str,
               payload: Sequence[str], skip_self: bool, worst: np.ndarray | None = None) -> pd.DataFrame:
    """The best of a block for every query, by slices of queries: a task holds ``_CHUNK_CELLS`` products at a time.

    ``worst`` is the score that a query's neighbours need to reach.
    """
    block = block.sort_values("_id", kind="stable")
    ids = block["_id"].to_numpy()
    vectors = np.stack(block["_vec"].to_numpy()).astype(float)
    worst = np.full(len(qids), np.inf) if worst is None else worst
    found = []
    for start in range(0, len(qids), _QUERY_SLICE):
        some = slice(start, start + _QUERY_SLICE)
        # one spare for the query itself
        rows, cols, scores = _best_pairs(queries[some], vectors, k + 1 if skip_self else k, metric, worst[some])
        part = pd.DataFrame({"_qid": qids[some][rows], "_id": ids[cols], "_score": scores})
        for c in payload:
            part[c] = block[c].to_numpy()[cols]
        found.append(part[part["_qid"] != part["_id"]] if skip_self else part)
    return pd.concat(found, ignore_index=True)


def nearest(queries: DataFrame, index: DataFrame, query_id: str, query_vec: str, index_id: str, index_vec: str,
            k: int, metric: str = "l2", payload: Sequence[str] = (), skip_self: bool = False,
            broadcast_cells: int = BROADCAST_CELLS, stats: dict | None = None, cluster: Sequence[str] = (),
            ones: str | None = None, by: str | None = None) -> DataFrame:
    """``(query_id, index_id, score, payload..., rank)``, the exact ``k`` best per query, ties by id.

    ``score`` is the distance for ``l2`` and the similarity for ``cosine``. ``cluster`` names columns of the index whose
    equal values make rows alike; they place rows in cells and change no result. ``stats`` receives the numbers of
    ``pairs`` of a query and a cell, and of those that were ``searched``. ``ones`` names a column of both tables with the
    sorted positions of indicators that are one; they count as if each were a number 0 or 1 of the vectors (``l2`` only).
    With ``by``, whole numbers from 0, a query then meets the rows of its own number only.
    """
    if ones:
        return _with_indicators(queries, index, (query_id, query_vec, index_id, index_vec), k, metric, payload, skip_self, stats, cluster, ones, by)
    q = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qvec"))
    x = index.select(F.col(index_id).alias("_id"), F.col(index_vec).cast("array<double>").alias("_vec"), *payload,
                     (F.xxhash64(*cluster) if cluster else F.lit(0).cast("long")).alias("_c"))
    out_type = T.StructType(
        [T.StructField("_qid", q.schema["_qid"].dataType), T.StructField("_id", x.schema["_id"].dataType),
         T.StructField("_score", T.DoubleType()), *[x.schema[c] for c in payload]]
    )
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("_qvec")), F.lit(0)).alias("d")).first()
    if size["n"] <= BROADCAST_ROWS and size["n"] * max(1, size["d"]) <= broadcast_cells:
        local = _with_broadcast_queries(q, spread(x.drop("_c")), k, metric, payload, skip_self, out_type)
    else:
        local = _with_cells(q, x, k, metric, payload, skip_self, out_type, bool(cluster), stats)
    best = top_k(local, ["_qid"], [F.asc("_score"), F.asc("_id")], k)
    score = F.col("_score") if metric == "l2" else -F.col("_score")
    return best.select(
        F.col("_qid").alias("query_id"), F.col("_id").alias("index_id"), score.alias("score"), *payload, "rank"
    )


def _with_indicators(queries, index, names, k, metric, payload, skip_self, stats, cluster, ones, by) -> DataFrame:
    from venuekit.operators.indicator_neighbors import nearest_sets

    if metric != "l2":
        raise ValueError("indicators have Euclidean distances only")
    query_id, query_vec, index_id, index_vec = names
    part = (F.col(by) if by else F.lit(0)).cast("long").alias("_by")
    typed = lambda vec, v, o: (F.col(vec).cast("array<double>").alias(v), F.col(ones).cast("array<int>").alias(o), part)
    q = queries.select(F.col(query_id).alias("_qid"), *typed(query_vec, "_qvec", "_qones"))
    x = index.select(F.col(index_id).alias("_id"), *typed(index_vec, "_vec", "_ones"), *payload, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cluster)])
    out_type = T.StructType(
        [T.StructField("_qid", q.schema["_qid"].dataType), T.StructField("_id", x.schema["_id"].dataType),
         T.StructField("_score", T.DoubleType()), *[x.schema[c] for c in payload]]
    )
    found = nearest_sets(q, x, k, payload, skip_self, out_type, [f"_c{i}" for i in range(len(cluster))], stats)
    best = top_k(found, ["_qid"], [F.asc("_score"), F.asc("_id")], k)
    return best.select(F.col("_qid").alias("query_id"), F.col("_id").alias("index_id"), F.col("_score").alias("score"), *payload, "rank")


def _with_broadcast_queries(q, x, k, metric, payload, skip_self, out_type) -> DataFrame:
    held = q.toPandas()  # at most broadcast_cells values, checked by the caller
    if held.empty:
        return x.sparkSession.createDataFrame([], out_type)
    shared = x.sparkSession.sparkContext.broadcast(
        (held["_qid"].to_numpy(), np.stack(held["_qvec"].to_numpy()).astype(float))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, vectors = shared.value
        best = None
        for batch in batches:
            if batch.empty:
                continue
            worst = None
            if best is not None:
                held_scores = best.groupby("_qid")["_score"].agg(["size", "max"]).reindex(qids)
                worst = np.where(held_scores["size"] >= k, held_scores["max"], np.inf)
            found = _local_top(qids, vectors, batch, k, metric, payload, skip_self, worst)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["_qid", "_score", "_id"], kind="stable").groupby("_qid", sort=False).head(k)
        if best is not None:
            yield best

    return x.mapInPandas(scan, out_type)


def _placed(vectors: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Points whose distances order the scores. For the cosine they are unit vectors; a zero vector of either side gets a
    coordinate of its own, so that its similarity is 0 and ``distance^2 = 2 - 2 similarity`` holds throughout."""
    if metric != "cosine":
        return vectors
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    extra = np.zeros((len(vectors), 2))
    extra[:, side] = (length == 0)[:, 0]
    return np.column_stack([vectors / np.where(length > 0, length, 1.0), extra])


def _measures(vectors: np.ndarray, pivots: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Places and, behind them, distances to all pivots."""
    spots = _placed(vectors, metric, side)
    apart = np.sqrt(np.maximum(0, (spots**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * spots @ pivots.T))
    return np.column_stack([spots, apart])


def _cells(x: DataFrame, pivots: np.ndarray, metric: str, clustered: bool) -> DataFrame:
    """Index rows with a cell number ``_cell``, stored. Cells hold neighbours in the order of cluster, nearest pivot and
    distance to it; without clusters they end with their pivot."""
    fields = [*x.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_far", T.DoubleType())]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty:
                apart = _measures(np.stack(frame["_vec"].to_numpy()).astype(float), pivots, metric, 0)[:, -len(pivots) :]
                yield frame.assign(_p=0 if clustered else apart.argmin(1), _far=apart.min(1))

    measured = spread(x).mapInPandas(measure, T.StructType(fields))
    placed = materialize(ranked(measured, [F.col(c) for c in ("_c", "_p", "_far", "_id")], "_at"), "placed")
    # a row per pivot tells where its rows and its cells begin
    first, cells, start = placed.groupBy("_p").agg(F.min("_at").alias("at"), F.count("*").alias("n")).orderBy("_p").collect(), 0, {}
    size = max(INDEX_BLOCK, -(-sum(r["n"] for r in first) // MAX_CELLS))
    for row in first:
        start[row["_p"]] = (cells, row["at"])
        cells += -(-row["n"] // size)
    number = F.lit(None).cast("int")
    for p, (cell, at) in start.items():
        number = F.when(F.col("_p") == p, cell + F.floor((F.col("_at") - at) / size)).otherwise(number)
    return placed.withColumn("_cell", number.cast("int")).drop("_c", "_p", "_far", "_at")


def _boxes(xc: DataFrame, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, greatest and mean measures of each cell, at most about ``MAX_CELLS`` rows."""

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for frame in frames:
            if frame.empty:
                continue
            seen = _measures(np.stack(frame["_vec"].to_numpy()).astype(float), pivots, metric, 0)
            cells = frame["_cell"].to_numpy()
            for cell in np.unique(cells):
                part = seen[cells == cell]
                low, high, total, n = part.min(0), part.max(0), part.sum(0), len(part)
                if cell in held:
                    old = held[cell]
                    low, high, total, n = np.minimum(low, old[0]), np.maximum(high, old[1]), total + old[2], n + old[3]
                held[cell] = (low, high, total, n)
        if held:
            yield pd.DataFrame([(c, *v) for c, v in held.items()], columns=["cell", "low", "high", "total", "n"])

    partial = xc.select("_vec", "_cell").mapInPandas(bound, "cell int, low array<double>, high array<double>, total array<double>, n long").toPandas()
    low, high, mean = [], [], []
    for _, group in partial.sort_values("cell").groupby("cell"):
        low.append(np.min(np.stack(group["low"].to_numpy()), 0))
        high.append(np.max(np.stack(group["high"].to_numpy()), 0))
        mean.append(np.sum(np.stack(group["total"].to_numpy()), 0) / group["n"].sum())
    return np.array(low), np.array(high), np.array(mean)


def _with_cells(q, x, k, metric, payload, skip_self, out_type, clustered, stats=None) -> DataFrame:
    sample = x.select("_vec", row_hash("_id").alias("h")).orderBy("h").limit(PIVOTS).toPandas()["_vec"]
    if not len(sample):
        return x.sparkSession.createDataFrame([], out_type)
    spark = x.sparkSession
    pivots = _placed(np.stack(sample.to_numpy()).astype(float), metric, 0)
    xc = _cells(x, pivots, metric, clustered)
    boxes = spark.sparkContext.broadcast(_boxes(xc, pivots, metric))
    q = materialize(spread(q), "queries")
    id_type = q.schema["_qid"]
    pair_type = T.StructType([id_type, T.StructField("_worst", T.DoubleType()), T.StructField("_cell", T.IntegerType())])

    def homes(seen: np.ndarray) -> np.ndarray:
        d, mean = seen.shape[1] - len(pivots), boxes.value[2]
        return ((mean[:, :d] ** 2).sum(1)[None] - 2 * seen[:, :d] @ mean[:, :d].T).argmin(1)

    def go_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty:
                seen = _measures(np.stack(frame["_qvec"].to_numpy()).astype(float), pivots, metric, 1)
                yield pd.DataFrame({"_qid": frame["_qid"], "_worst": np.inf, "_cell": homes(seen)})

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other cells that can hold a neighbour closer than the ``k``-th of the first cell."""
        low, high, _ = boxes.value
        step = max(1, _CHUNK_CELLS // low.size)
        for frame in frames:
            for start in range(0, len(frame), step):
                part = frame.iloc[start : start + step]
                seen = _measures(np.stack(part["_qvec"].to_numpy()).astype(float), pivots, metric, 1)
                gap = np.maximum(np.maximum(low[None] - seen[:, None], seen[:, None] - high[None]), 0)
                d, home = seen.shape[1] - len(pivots), homes(seen)
                least = np.maximum((gap[:, :, :d] ** 2).sum(2), gap[:, :, d:].max(2) ** 2)
                worst = part["_worst"].to_numpy(dtype=float)
                reach = worst**2 if metric == "l2" else np.maximum(2 + 2 * worst, 0)
                open_ = ~(least > reach[:, None] + 1e-8 * (1 + least))  # scores are rounded
                open_[np.arange(len(part)), home] = False
                rows, cells = np.nonzero(open_)
                yield pd.DataFrame({"_qid": part["_qid"].to_numpy()[rows], "_worst": worst[rows], "_cell": cells})

    def search(pairs: DataFrame) -> DataFrame:
        return _meet(pairs, q, xc, k, metric, payload, skip_self, out_type)

    own = materialize(q.mapInPandas(go_home, pair_type), "home-cells")
    first = materialize(search(own), "first-cell")
    reached = first.groupBy("_qid").agg(F.count("*").alias("n"), F.max("_score").alias("w"))
    limit = F.when(F.col("n") >= k, F.col("w")).otherwise(F.lit(float("inf"))).alias("_worst")
    bounded = q.join(reached, "_qid", "left").select(*q.columns, limit)
    others = materialize(bounded.mapInPandas(go_on, pair_type), "open-cells")
    if stats is not None:
        n = own.count()
        stats.update(pairs=n * len(boxes.value[0]), searched=n + others.count())
    return first.unionByName(search(others))


def _meet(pairs, q, xc, k, metric, payload, skip_self, out_type) -> DataFrame:
    """The best of each query in each cell it is paired with. The queries of a cell are dealt over slices, which bounds a
    task; a cell is sent once to each of its slices."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in out_type.fields})
        vectors = np.stack(left["_qvec"].to_numpy()).astype(float)
        found = _local_top(left["_qid"].to_numpy(), vectors, right, k, metric, payload, skip_self, left["_worst"].to_numpy())
        found = found.sort_values(["_qid", "_score", "_id"], kind="stable")
        return found.groupby("_qid", sort=False).head(k)

    slices = pairs.groupBy("_cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_slices"))
    slices = F.broadcast(slices)  # a row per cell
    dealt = pairs.join(slices, "_cell").withColumn("_slice", F.pmod(F.xxhash64("_qid"), F.col("_slices")).cast("int")).drop("_slices")
    queries = dealt.join(q, "_qid").groupBy("_cell", "_slice")
    copies = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    index = xc.join(slices, "_cell").select(*xc.columns, copies).groupBy("_cell", "_slice")
    return queries.cogroup(index).applyInPandas(meet, out_type)


def vote(neighbors: DataFrame, label: str, weights: str = "uniform", by: Sequence[str] = ()) -> DataFrame:
    """Majority class of the neighbours; equal votes go to the smallest class.

    With ``distance`` weights a vote counts ``1/distance``, and neighbours at distance
    zero outvote all others.
    """
    zero = F.col("score") == 0
    if weights == "uniform":
        exact, weight = F.lit(0), F.count("*").cast("double")
    else:
        exact, weight = F.count_if(zero), F.sum(F.when(~zero, 1.0 / F.col("score")).otherwise(0.0))
    votes = neighbors.groupBy(*by, "query_id", label).agg(exact.alias("_exact"), weight.alias("_v"))
    best = F.min(F.struct((-F.col("_exact")).alias("e"), (-F.round("_v", DIGITS)).alias("v"), F.col(label).alias("y")))
    return votes.groupBy(*by, "query_id").agg(best["y"].alias("prediction"))


def vote_grid(neighbors: DataFrame, label: str, sizes: Sequence[int], weights: Sequence[str]) -> DataFrame:
    """``(query_id, votes)``: the :func:`vote` of each number of neighbours and kind of weights, as an array of ``k``,
    ``weights`` and ``prediction``. Neighbours are counted once for the whole grid."""
    zero, within = F.col("score") == 0, lambda k: F.col("rank") <= k
    counted = neighbors.groupBy("query_id", label).agg(
        *[F.count_if(within(k)).alias(f"_n{k}") for k in sizes],
        *[F.count_if(within(k) & zero).alias(f"_exact{k}") for k in sizes],
        *[F.sum(F.when(within(k) & ~zero, 1.0 / F.col("score")).otherwise(0.0)).alias(f"_near{k}") for k in sizes],
    )

    def best(k: int, kind: str) -> Column:
        exact, weight = (F.lit(0).cast("long"), F.col(f"_n{k}").cast("double")) if kind == "uniform" else (F.col(f"_exact{k}"), F.col(f"_near{k}"))
        order = F.struct((-exact).alias("e"), (-F.round(weight, DIGITS)).alias("v"), F.col(label).alias("y"))
        chosen = F.min(F.when(F.col(f"_n{k}") > 0, order))
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("weights"), chosen["y"].alias("prediction"))

    return counted.groupBy("query_id").agg(F.array(*[best(k, w) for k in sizes for w in weights]).alias("votes"))


def knn_classify(train: DataFrame, test: DataFrame, key: str, features: str, label: str, k: int,
                 weights: str = "uniform") -> DataFrame:
    """``(query_id, prediction)`` for every test row."""
    found = nearest(test, train, key, features, key, features, k, payload=[label])
    return vote(found, label, weights)
