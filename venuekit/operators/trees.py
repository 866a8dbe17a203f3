"""Fitted decision trees as flat arrays, and exact attributions of their predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from venuekit.session import scratch_path

LEAF = -1


@dataclass(frozen=True)
class FittedTree:
    """Node arrays, the root first. An inner node sends ``x <= threshold`` (or a left category) to ``left``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    categories: dict[int, frozenset[int]] = field(default_factory=dict)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        values = x[:, self.feature[node]]
        if node in self.categories:
            return np.isin(values, list(self.categories[node]))
        return values <= self.threshold[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for node in range(len(self.feature)):  # children stand after their parents
            here = np.flatnonzero(at == node) if self.feature[node] != LEAF else []
            if len(here):
                left = self.goes_left(node, x[here])
                at[here] = np.where(left, self.left[node], self.right[node])
        return self.value[at]

    def mean(self) -> float:
        """Mean prediction over the rows the tree was fitted on."""
        leaves = self.feature == LEAF
        return float((self.value[leaves] * self.cover[leaves]).sum() / self.cover[0])


# --- from Spark's models --------------------------------------------------------------------


def _tree(nodes: pd.DataFrame, output: int | None) -> FittedTree:
    nodes = nodes.sort_values("id")
    if not np.array_equal(nodes["id"], np.arange(len(nodes))):
        raise ValueError("node ids must count from 0")
    inner = (nodes["leftChild"] >= 0).to_numpy()
    stats = [np.asarray(s, dtype=float) for s in nodes["impurityStats"]]
    feature = np.array([s["featureIndex"] if i else LEAF for s, i in zip(nodes["split"], inner)])
    threshold, categories = np.zeros(len(nodes)), {}
    for n, (s, i) in enumerate(zip(nodes["split"], inner)):
        if i and s["numCategories"] >= 0:
            categories[n] = frozenset(int(c) for c in s["leftCategoriesOrThreshold"])
        elif i:
            threshold[n] = s["leftCategoriesOrThreshold"][0]
    # regression keeps count, sum and sum of squares; classification the weight of each class
    value = nodes["prediction"].to_numpy(float) if output is None else np.array([s[output] / s.sum() for s in stats])
    cover = np.array([s[0] if output is None else s.sum() for s in stats])
    return FittedTree(feature, threshold, nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy(), value, cover, categories)


def fitted_trees(df: DataFrame, model, output: int | None = None) -> list[tuple[float, FittedTree]]:
    """Weighted trees of a fitted Spark tree, forest or boosted model (or a pipeline that ends in one).

    Their weighted sum is the prediction of a regression and, for the class ``output``, the probability of a
    classification; for boosted classification it is the margin. The model is saved to the shared folder and its nodes
    are read back: it is as large as the model the driver holds.
    """
    fitted = model.stages[-1] if isinstance(model, PipelineModel) else model
    kind = type(fitted).__name__
    if "Classification" in kind and "GBT" not in kind and output is None:
        raise ValueError("name the class whose probability is wanted")
    path = scratch_path(df.sparkSession, "trees")
    fitted.write().save(path)
    data = df.sparkSession.read.parquet(f"{path}/data").toPandas()
    output = None if "GBT" in kind else output
    if "treeID" not in data:
        return [(1.0, _tree(data, output))]
    data = pd.DataFrame([{"treeID": t, **n.asDict(recursive=True)} for t, n in zip(data["treeID"], data["nodeData"])])
    trees = [_tree(nodes, output) for _, nodes in data.groupby("treeID")]
    weights = fitted.treeWeights if "GBT" in kind else [1.0 / len(trees)] * len(trees)
    return list(zip(weights, trees))


# --- attributions ---------------------------------------------------------------------------


def leaf_paths(tree: FittedTree) -> Iterator[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """Per leaf its value and, for each feature on its path, the share of rows that follow the path and its splits."""
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = tree.feature[node]
        if f == LEAF:
            yield float(tree.value[node]), [(k, share, splits) for k, (share, splits) in path.items()]
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            share, splits = path.get(f, (1.0, []))
            part = tree.cover[child] / tree.cover[node]
            stack.append((child, {**path, f: (share * part, [*splits, (node, left)])}))


def tree_shap(tree: FittedTree, x: np.ndarray) -> np.ndarray:
    """Shapley values of a tree for every row and feature, exact and polynomial in the depth.

    With ``z`` the share of the fitted rows that follow a leaf's path on a feature and ``o`` whether this row does, the
    coefficients of ``prod(z + o t)`` are the values of all coalitions by size; one feature is divided out at a time.
    """
    phi = np.zeros(x.shape)
    met = {}
    for value, path in leaf_paths(tree):
        m = len(path)
        if not m or value == 0.0:
            continue
        ones = np.empty((m, len(x)))
        for i, (_, _, splits) in enumerate(path):
            follows = np.ones(len(x), dtype=bool)
            for node, left in splits:
                if node not in met:
                    met[node] = tree.goes_left(node, x)
                follows &= met[node] == left
            ones[i] = follows
        shares = [share for _, share, _ in path]
        whole = np.zeros((m + 1, len(x)))
        whole[0] = 1.0
        for i in range(m):
            whole[1:] = shares[i] * whole[1:] + ones[i] * whole[:-1]
            whole[0] *= shares[i]
        weights = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        for j, (f, z, _) in enumerate(path):
            here = ones[j] > 0
            total, rest = np.zeros(len(x)), whole[m].copy()
            for k in range(m - 1, -1, -1):
                # here: divide by (z + t) from the top; elsewhere by z
                total += weights[k] * np.where(here, rest, whole[k] / z)
                rest = whole[k] - z * rest
            phi[:, f] += value * (ones[j] - z) * total
    return phi


def tree_attributions(df: DataFrame, key: str, trees: Sequence[tuple[float, FittedTree]], columns: Sequence[str]) -> DataFrame:
    """``key, feature, attribution``: what each column adds to a row's prediction beyond the mean of the fitted rows.

    The attributions of a row and :func:`base_value` add up to its prediction.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def explain(points: pd.Series) -> pd.Series:
        x = np.stack(points.to_numpy()) if len(points) else np.zeros((0, len(columns)))
        return pd.Series(list(sum(w * tree_shap(t, x) for w, t in trees)))

    point = F.array(*[F.col(c).cast("double") for c in columns])
    named = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("feature"), F.col("_a").alias("attribution"))
    return df.select(key, explain(point).alias("_a")).select(key, F.inline(named))


def base_value(trees: Sequence[tuple[float, FittedTree]]) -> float:
    return sum(w * t.mean() for w, t in trees)


def mean_attributions(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")
