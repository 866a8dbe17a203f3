"""Gradient boosting with second-order histograms, built from grouped sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from venuekit.operators.ranking import row_hash
from venuekit.operators.trees import LEAF, FittedTree
from venuekit.session import materialize

SEED = 42
STORE_EVERY = 10  # rounds after which the margins so far are stored with the rows
EDGE_ACCURACY = 10_000
_HISTOGRAM = "node int, feature int, bin int, g double, h double, n long"


@dataclass(frozen=True)
class BoostedTrees:
    """Sum of a base margin and shrunk trees; with the logistic loss the margin's sign is the class."""

    columns: tuple[str, ...]
    base: float
    trees: tuple[FittedTree, ...]
    loss: str

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def weighted_trees(self) -> list[tuple[float, FittedTree]]:
        """For attributions of the margin; the base is not part of them."""
        return [(1.0, t) for t in self.trees]

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        model = self

        @F.pandas_udf(DoubleType())
        def margin(points: pd.Series) -> pd.Series:
            return pd.Series(model.margin(np.stack(points.to_numpy())) if len(points) else np.zeros(0))

        scored = df.withColumn(prediction, margin(F.array(*[_number(c) for c in self.columns])))
        if self.loss == "squared":
            return scored
        chance = 1 / (1 + F.exp(-F.col(prediction)))
        return scored.withColumn(probability, chance).withColumn(prediction, (F.col(probability) > 0.5).cast("double"))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))


def bin_edges(df: DataFrame, columns: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each column: the distinct quantiles below its largest value."""
    probes = [i / max_bins for i in range(1, max_bins + 1)]
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), probes, EDGE_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(q or [], dtype=float))[:-1] for q in found]


def _derivatives(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def _drawn(h: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Rows that a tree is fitted on, by a hash of the row and the tree."""
    if share >= 1.0:
        return np.ones(len(h), dtype=bool)
    salt = np.array([tree + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # wraps around, as do the rest
    mixed = (h.astype(np.uint64) + salt) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))) < np.uint64(int(share * (2**64 - 1)))


class _Grower:
    """A tree under construction, over bins."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.feature, self.bin, self.left, self.right = [LEAF], [0], [-1], [-1]
        self.sums = [None]  # gradient, curvature, rows

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        for node, f in enumerate(self.feature):
            if f != LEAF:
                here = at == node
                at = np.where(here, np.where(bins[:, f] <= self.bin[node], self.left[node], self.right[node]), at)
        return at

    def split(self, node: int, feature: int, bin_: int, left: tuple, right: tuple) -> list[int]:
        self.feature[node], self.bin[node] = feature, bin_
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for sums in (left, right):
            for values, v in ((self.feature, LEAF), (self.bin, 0), (self.left, -1), (self.right, -1), (self.sums, sums)):
                values.append(v)
        return [self.left[node], self.right[node]]

    def finish(self, edges: list[np.ndarray], rate: float, l2: float) -> FittedTree:
        value = np.array([-rate * g / (h + l2) if h + l2 > 0 else 0.0 for g, h, _ in self.sums])
        threshold = np.array([edges[f][b] if f != LEAF else 0.0 for f, b in zip(self.feature, self.bin)])
        cover = np.array([float(n) for _, _, n in self.sums])
        return FittedTree(np.array(self.feature), threshold, np.array(self.left), np.array(self.right), value, cover)


def _binned(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(len(frame), -1)


def best_splits(partial: DataFrame, l2: float, min_rows: int) -> DataFrame:
    """Per node and column the split of the highest gain, ties to the lower bin; NULL gain where none is allowed.

    One exchange by (node, column) serves the sums, the running sums and the choice. Statements are plain SQL text: they
    are planned once for each level of each tree.
    """
    sums = partial.repartition("node", "feature").groupBy("node", "feature", "bin").agg({"g": "sum", "h": "sum", "n": "sum"})
    upto = "OVER (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = "OVER (PARTITION BY node, feature)"
    both = [f"sum(`sum({c})`) {over} AS {side}{c}" for c in "ghn" for side, over in (("left_", upto), ("", whole))]
    left = sums.selectExpr("node", "feature", "bin", *both, "lead(bin) OVER (PARTITION BY node, feature ORDER BY bin) IS NULL AS last")
    allowed = f"NOT last AND left_n >= {min_rows} AND n - left_n >= {min_rows} AND left_h + {l2} > 0 AND h - left_h + {l2} > 0"
    # gains that are equal up to rounding count as equal
    gain = f"round(left_g * left_g / (left_h + {l2}) + (g - left_g) * (g - left_g) / (h - left_h + {l2}) - g * g / (h + {l2}), 9)"
    scored = left.selectExpr("*", f"CASE WHEN {allowed} THEN {gain} END AS gain")
    best = F.expr("max_by(struct(gain, bin, left_g, left_h, left_n, g, h, n), struct(gain, -bin)) AS s")
    return scored.groupBy("node", "feature").agg(best).selectExpr("node", "feature", "s.*")


def fit_boosted_trees(df: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], rounds: int = 100, learning_rate: float = 0.1,
                      num_leaves: int = 31, max_depth: int = 5, min_rows: int = 20, l2: float = 0.0, row_share: float = 1.0,
                      column_share: float = 1.0, max_bins: int = 255, loss: str = "squared", seed: int = SEED) -> BoostedTrees:
    """Boosted trees for the squared or the logistic loss (labels 0 and 1).

    Values are binned once. For each level of a tree a task sums gradient and curvature per node, column and bin of its
    rows; the sums are added up by (node, column, bin), and a window over the bins finds the best split of each node and
    column. The rows never move, and the driver sees one split per open node and column. Levels grow while the tree has fewer than
    ``num_leaves``, the highest gains first. Rows without a label take no part; a missing value lies above all others.
    """
    columns = list(columns)
    labelled = df.filter(F.col(label).isNotNull())
    edges = bin_edges(labelled, columns, min(max_bins, 255))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, len(columns)))
            codes = np.column_stack([
                np.where(np.isnan(x[:, f]), len(edges[f]), np.searchsorted(edges[f], x[:, f], side="left")) for f in range(len(columns))
            ]).astype(np.uint8)
            yield pd.DataFrame({"bins": [row.tobytes() for row in codes], "y": frame["y"], "h": frame["h"], "margin": frame["margin"]})

    start = labelled.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if start is None:
        raise ValueError("no labelled rows to fit")
    if loss == "logistic":
        start = float(np.log(max(start, 1e-12) / max(1 - start, 1e-12)))
    plain = labelled.select(
        F.array(*[_number(c) for c in columns]).alias("x"), F.col(label).cast("double").alias("y"),
        F.conv(F.substring(row_hash(*key), 1, 15), 16, 10).cast("long").alias("h"), F.lit(float(start)).alias("margin"),
    )
    schema = "bins binary, y double, h long, margin double"
    rows = materialize(plain.mapInPandas(place, schema), "boosting-rows")
    trees, pending = [], []  # pending: grown since the margins were stored, over bins

    def pass_over(grower: _Grower | None, open_nodes: list[int], tree: int):
        done = list(pending)
        size = max((len(e) for e in edges), default=0) + 1

        def margins(frame: pd.DataFrame, bins: np.ndarray) -> np.ndarray:
            return frame["margin"].to_numpy() + sum((values[g.nodes(bins)] for g, values in done), np.zeros(len(frame)))

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame[_drawn(frame["h"].to_numpy(), tree, row_share)]
                if frame.empty:
                    continue
                bins = _binned(frame)
                g, h = _derivatives(loss, frame["y"].to_numpy(), margins(frame, bins))
                at = grower.nodes(bins)
                out = []
                for node in open_nodes:
                    here = at == node
                    if not here.any():
                        continue
                    for f in grower.features:
                        b = bins[here, f]
                        n = np.bincount(b, minlength=size)
                        seen = np.flatnonzero(n)
                        gs, hs = np.bincount(b, g[here], size)[seen], np.bincount(b, h[here], size)[seen]
                        out.append(pd.DataFrame({"node": node, "feature": int(f), "bin": seen, "g": gs, "h": hs, "n": n[seen]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

        def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield frame.assign(margin=margins(frame, _binned(frame)))

        return advance if grower is None else sums

    for tree in range(rounds):
        rng = np.random.default_rng([seed, tree])
        chosen = np.sort(rng.choice(len(columns), max(1, int(np.ceil(column_share * len(columns)))), replace=False))
        grower, open_nodes, leaves = _Grower(chosen), [0], 1
        for depth in range(max_depth):
            partial = rows.mapInPandas(pass_over(grower, open_nodes, tree), _HISTOGRAM)
            found = {}
            for s in best_splits(partial, l2, min_rows).collect():  # a row per open node and column
                rank = (s["gain"] if s["gain"] is not None else -1.0, -s["feature"])
                if s["node"] not in found or rank > found[s["node"]][0]:
                    found[s["node"]] = (rank, s)
            found = [s for _, s in found.values()]
            if depth == 0:
                if not found:
                    break
                grower.sums[0] = (found[0]["g"], found[0]["h"], found[0]["n"])
            open_nodes = []
            for s in sorted(found, key=lambda r: (-(r["gain"] if r["gain"] is not None else -1.0), r["node"])):
                if s["gain"] is None or s["gain"] <= 0 or leaves >= num_leaves:
                    continue
                left = (s["left_g"], s["left_h"], s["left_n"])
                right = (s["g"] - s["left_g"], s["h"] - s["left_h"], s["n"] - s["left_n"])
                open_nodes += grower.split(s["node"], s["feature"], s["bin"], left, right)
                leaves += 1
            if not open_nodes or leaves >= num_leaves:
                break
        if grower.sums[0] is None:
            continue  # no row was drawn
        fitted = grower.finish(edges, learning_rate, l2)
        trees.append(fitted)
        pending.append((grower, fitted.value))
        if len(pending) == STORE_EVERY and tree + 1 < rounds:
            rows = materialize(rows.mapInPandas(pass_over(None, [], tree), schema), "boosting-rows")
            pending = []
    return BoostedTrees(tuple(columns), float(start), tuple(trees), loss)
