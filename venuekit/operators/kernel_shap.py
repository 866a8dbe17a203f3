"""Attributions of any model from its predictions on mixed rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from venuekit.operators.ranking import row_hash

BACKGROUND_ROWS = 100
COALITIONS = 2_048
SEED = 42


def coalitions(m: int, limit: int = COALITIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Masks of present features and their weights, without the empty and the full one.

    Sizes 1 and ``m - 1`` come first, then 2 and ``m - 2`` and so on, each complete while ``limit`` allows. What remains
    is drawn with its complements by the kernel's weights, all draws together weighing what the open sizes weigh.
    """
    mass = {s: (m - 1) / (s * (m - s)) for s in range(1, m)}  # of all coalitions of a size
    masks, weights, open_sizes = [], [], set(mass)
    for s in range(1, m // 2 + 1):
        sizes = {s, m - s}
        count = sum(math.comb(m, k) for k in sizes)
        if len(masks) + count > limit:
            break
        for k in sorted(sizes):
            for chosen in itertools.combinations(range(m), k):
                masks.append([i in chosen for i in range(m)])
                weights.append(mass[k] / math.comb(m, k))
        open_sizes -= sizes
    left = (limit - len(masks)) // 2
    if open_sizes and left > 0:
        rng = np.random.default_rng(seed)
        sizes = sorted(open_sizes)
        share = np.array([mass[s] for s in sizes])
        for s in rng.choice(sizes, size=left, p=share / share.sum()):
            mask = np.zeros(m, dtype=bool)
            mask[rng.choice(m, size=s, replace=False)] = True
            masks += [mask.tolist(), (~mask).tolist()]
            weights += [share.sum() / (2 * left)] * 2
    return np.array(masks, dtype=bool).reshape(-1, m), np.array(weights)


def solution(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix from the values of ``[no feature, *masks, all features]`` to the attributions.

    Weighted least squares under the constraint that the attributions add up to the difference of the last and the first
    value; the same linear map serves every row.
    """
    k, m = masks.shape
    z = masks.astype(float)
    system = np.zeros((m + 1, m + 1))
    system[:m, :m] = z.T @ (weights[:, None] * z)
    system[:m, m] = system[m, :m] = 1.0
    right = np.zeros((m + 1, k + 2))
    right[:m, 1 : k + 1] = z.T * weights
    right[:m, 0] = -(z.T @ weights)  # the masks' values count from the empty one
    right[m, 0], right[m, k + 1] = -1.0, 1.0
    return np.linalg.lstsq(system, right, rcond=None)[0][:m]


def kernel_attributions(df: DataFrame, key: str, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame],
                        background: DataFrame, background_rows: int = BACKGROUND_ROWS, limit: int = COALITIONS) -> DataFrame:
    """``key, feature, attribution`` for any model; exact Shapley values while ``2^m - 2`` masks are within ``limit``.

    ``predict`` adds ``prediction`` to rows of ``columns``. A mask keeps a row's own values and takes the others from each
    of ``background_rows`` rows of ``background`` (those of the lowest hashes). Since the solution is linear, predictions
    are summed with its coefficients at once: a row's mixes combine on the map side and are never gathered.
    """
    names = list(columns)
    rows = background.select(*[F.col(c).cast("double").alias(c) for c in names])
    held = rows.orderBy(row_hash(*names), *names).limit(background_rows).collect()
    if not held:
        raise ValueError("the background has no rows")
    if len(names) == 1:
        masks, weights = np.zeros((0, 1), dtype=bool), np.zeros(0)
    else:
        masks, weights = coalitions(len(names), limit)
    every = np.vstack([np.zeros((1, len(names)), dtype=bool), masks, np.ones((1, len(names)), dtype=bool)])
    factors = solution(masks, weights) / len(held)
    other = F.array(*[F.struct(*[F.lit(float(r[c])).alias(c) for c in names]) for r in held])
    mixes = F.array(*[
        F.struct(F.array(*[F.lit(bool(b)) for b in mask]).alias("own"), F.array(*[F.lit(float(f)) for f in factors[:, i]]).alias("factor"))
        for i, mask in enumerate(every)
    ])
    spread = df.select(key, *[F.col(c).cast("double").alias(c) for c in names], F.explode(mixes).alias("_m"))
    spread = spread.select("*", F.explode(other).alias("_b"))
    mixed = spread.select(
        key, F.col("_m.factor").alias("_f"),
        *[F.when(F.col("_m.own")[i], F.col(c)).otherwise(F.col(f"_b.{c}")).alias(c) for i, c in enumerate(names)],
    )
    summed = predict(mixed).groupBy(key).agg(*[F.sum(F.col("_f")[i] * F.col("prediction")).alias(f"_a{i}") for i in range(len(names))])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"_a{i}").alias("attribution")) for i, c in enumerate(names)]
    return summed.select(key, F.inline(F.array(*cells)))
