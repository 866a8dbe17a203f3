"""Attributions, boosting and support vectors against enumeration, plain loops and a plain solver."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuekit.operators import boosting, kernel_shap, models, trees
from venuekit.operators.support_vectors import EpsilonInsensitiveRegression
from venuekit.plans.queries_models import FEATURES, split_first

NAMES = ["a", "b", "c", "d"]


def points(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.normal(size=n).round(2), rng.integers(0, 2, n), rng.integers(0, 40, n)]).astype(float)
    y = x[:, 0] * (x[:, 2] + 1) + np.sin(3 * x[:, 1]) * 2 + x[:, 3] / 20 + rng.normal(size=n) * 0.2
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = points()
    rows = [(i, *map(float, r), float(t), float(t > np.median(y))) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, z double").repartition(3).cache()


def value_of(tree, x, present, node=0):
    """Expectation of a tree where only the present features are known."""
    f = tree.feature[node]
    if f == trees.LEAF:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in present:
        return value_of(tree, x, present, left if tree.goes_left(node, x[None])[0] else right)
    share = tree.cover[left] / tree.cover[node]
    return share * value_of(tree, x, present, left) + (1 - share) * value_of(tree, x, present, right)


def enumerated(value, m):
    out = []
    for j in range(m):
        rest, total = [i for i in range(m) if i != j], 0.0
        for k in range(m):
            for s in itertools.combinations(rest, k):
                total += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value({*s, j}) - value(set(s)))
        out.append(total)
    return np.array(out)


def by_row(attributions, names):
    found = {}
    for r in attributions.collect():
        found.setdefault(r[0], {})[r["feature"]] = r["attribution"]
    return {k: np.array([v[n] for n in names]) for k, v in found.items()}


def fitted(kind):
    if kind == "tree":
        return models.decision_tree_regressor("y", maxDepth=6), None
    if kind == "forest":
        return models.random_forest_regressor("y", numTrees=5, maxDepth=5), None
    if kind == "boosted":
        return models.boosted_trees_regressor("y", maxIter=4, maxDepth=3), None
    return models.decision_tree_classifier("z", maxDepth=4), 1


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classes"])
def test_tree_attributions_equal_enumeration(frame, kind):
    estimator, output = fitted(kind)
    model = models.assembled(estimator, NAMES).fit(frame)
    weighted = trees.fitted_trees(frame, model, output)
    got = by_row(trees.tree_attributions(frame, "id", weighted, NAMES), NAMES)
    scored = {r["id"]: (np.array([r[n] for n in NAMES]), float(r["probability"][1]) if output else r["prediction"]) for r in model.transform(frame).collect()}
    base = trees.base_value(weighted)
    assert len(got) == 300
    for i, (x, prediction) in scored.items():
        assert got[i].sum() + base == pytest.approx(prediction, abs=1e-9)
    for i in list(scored)[::15]:
        want = sum(w * enumerated(lambda s: value_of(t, scored[i][0], s), 4) for w, t in weighted)
        assert np.allclose(got[i], want, atol=1e-9)
    summary = trees.mean_attributions(trees.tree_attributions(frame, "id", weighted, NAMES)).collect()
    assert [r["mean_abs"] for r in summary] == sorted((r["mean_abs"] for r in summary), reverse=True)


def test_categories_and_repeated_features():
    tree = trees.FittedTree(
        np.array([0, 1, 0, -1, -1, -1, -1]), np.array([0.0, 2.0, 0, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]),
        np.array([0, 0, 0, 1.0, -2.0, 4.0, 8.0]), np.array([20.0, 12, 8, 5, 7, 2, 6]), {0: frozenset({0, 2}), 2: frozenset({1})},
    )
    x = np.array([[a, b] for a in range(4) for b in (1.0, 3.0)])
    got = trees.tree_shap(tree, x)
    for row, phi in zip(x, got):
        assert np.allclose(phi, enumerated(lambda s: value_of(tree, row, s), 2))
        assert phi.sum() + tree.mean() == pytest.approx(tree.predict(row[None])[0])


def test_deep_paths_stay_exact():
    rng = np.random.default_rng(0)
    m = 14  # a chain that asks a new feature at each level
    feature, left, right, value, cover = [], [], [], [], []
    for i in range(m):
        feature += [i, -1]
        left += [2 * i + 1, -1]
        right += [2 * i + 2, -1]
        value += [0.0, float(rng.normal())]
        cover += [float(2 ** (m - i)), float(2 ** (m - i - 1))]
    feature.append(-1), left.append(-1), right.append(-1), value.append(3.0), cover.append(1.0)
    tree = trees.FittedTree(*map(np.array, (feature, np.zeros(2 * m + 1), left, right, value, cover)))
    x = rng.normal(size=(50, m))
    assert np.allclose(trees.tree_shap(tree, x).sum(1) + tree.mean(), tree.predict(x), atol=1e-9)


# --- any model -----------------------------------------------------------------------------


def test_kernel_attributions_equal_enumeration(spark):
    rng = np.random.default_rng(6)
    names, data = list("abcde"), rng.normal(size=(12, 5))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id long, a double, b double, c double, d double, e double")
    other = rng.normal(size=(7, 5))
    background = spark.createDataFrame([tuple(map(float, r)) for r in other], "a double, b double, c double, d double, e double")
    predict = lambda df: df.withColumn("prediction", F.expr("a * b + exp(c) * d - e * e * a + if(c > 0, d, 0)"))
    f = lambda r: r[0] * r[1] + np.exp(r[2]) * r[3] - r[4] ** 2 * r[0] + (r[3] if r[2] > 0 else 0)
    got = by_row(kernel_shap.kernel_attributions(rows, "id", names, predict, background), names)

    def value(x, present):
        return np.mean([f([x[i] if i in present else b[i] for i in range(5)]) for b in other])

    for i, x in enumerate(data):
        assert np.allclose(got[i], enumerated(lambda s: value(x, s), 5), atol=1e-8)


def test_sampled_coalitions_add_up_and_come_close(spark):
    masks, weights = kernel_shap.coalitions(9, limit=120)
    assert len(masks) == 120 and all(0 < s < 9 for s in masks.sum(1))
    assert weights.sum() == pytest.approx(sum(8 / (s * (9 - s)) for s in range(1, 9)))
    m = kernel_shap.solution(masks, weights)
    linear = np.arange(1.0, 10.0)
    values = np.concatenate([[0.0], masks @ linear, [linear.sum()]])
    assert np.allclose(m @ values, linear, atol=1e-6)
    alone = spark.createDataFrame([(1, 2.0)], "id long, a double")
    predict = lambda df: df.withColumn("prediction", F.col("a") * 3)
    got = kernel_shap.kernel_attributions(alone, "id", ["a"], predict, spark.createDataFrame([(1.0,)], "a double")).collect()
    assert [r["attribution"] for r in got] == [3.0]


# --- support vectors -----------------------------------------------------------------------


def test_support_vectors_reach_the_least_objective(spark, frame):
    scaled = frame.select("id", *[(F.col(c) / s).alias(c) for c, s in zip(NAMES, (3, 1, 1, 20))], "y")
    estimator = EpsilonInsensitiveRegression(NAMES, "y", c=2.0, epsilon=0.3, dims=20)
    model = estimator.fit(scaled)
    x = np.array([[r[c] for c in NAMES] for r in scaled.orderBy("id").collect()])
    y = np.array([r["y"] for r in scaled.orderBy("id").collect()])
    waves, shifts = models.fourier_waves(4, 0.25, 20)
    z = np.column_stack([np.sqrt(2 / 20) * np.cos(x @ waves.T + shifts), np.ones(len(x))])

    def objective(w):
        return w[:-1] @ w[:-1] / 2 + 2.0 * np.maximum(0, np.abs(y - z @ w) - 0.3).sum()

    # a plain solver: many subgradient steps
    w, best = np.zeros(21), np.inf
    for step in range(40_000):
        r = y - z @ w
        g = np.append(w[:-1], 0) - 2.0 * (z * (np.sign(r) * (np.abs(r) > 0.3))[:, None]).sum(0)
        w = w - 0.02 / np.sqrt(step + 1) / 10 * g
        best = min(best, objective(w))
    assert estimator.objective <= best * 1.001
    again = models.save_model(model, str(spark.conf.get("spark.checkpoint.dir")) + "/svr-model")
    both = [sorted(map(tuple, m.transform(scaled).select("id", "prediction").collect())) for m in (model, again)]
    assert both[0] == both[1]
    got = np.array([p for _, p in both[0]])
    assert objective_of_predictions(got, y) == pytest.approx(np.maximum(0, np.abs(y - got) - 0.3).sum())


def objective_of_predictions(p, y):
    return sum(max(0.0, abs(a - b) - 0.3) for a, b in zip(p, y))


# --- boosting ------------------------------------------------------------------------------


def plain_boosting(x, y, edges, rounds, rate, depth, min_rows, leaves, logistic):
    start = np.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    margin, out = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y, p * (1 - p)) if logistic else (margin - y, np.ones(len(y)))
        regions, splits = {0: np.arange(len(y))}, []
        ends, open_nodes, count, total = {}, [0], 1, 1
        for _level in range(depth):
            found = []
            for node in open_nodes:
                rows = regions[node]
                best = None
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = x[rows, f] <= e
                        if min(left.sum(), (~left).sum()) < max(min_rows, 1):
                            continue
                        a, b = rows[left], rows[~left]
                        gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                        if best is None or round(gain, 9) > best[0]:
                            best = (round(gain, 9), f, e, a, b)
                if best is not None:
                    found.append((node, *best))
            open_nodes = []
            for node, gain, f, e, a, b in sorted(found, key=lambda s: (-s[1], s[0])):
                if gain <= 0 or count >= leaves:
                    continue
                splits.append((node, f, e))
                regions[total], regions[total + 1] = a, b
                open_nodes += [total, total + 1]
                ends[node] = True
                total, count = total + 2, count + 1
            if not open_nodes or count >= leaves:
                break
        for node, rows in regions.items():
            if node not in ends:
                margin[rows] += -rate * g[rows].sum() / h[rows].sum()
        out.append(splits)
    return margin, out


@pytest.mark.parametrize("loss,label", [("squared", "y"), ("logistic", "z")])
def test_boosting_equals_plain_loops(frame, monkeypatch, loss, label):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    model = boosting.fit_boosted_trees(frame, NAMES, label, ["id"], rounds=5, num_leaves=6, max_depth=3, min_rows=10, max_bins=16, loss=loss)
    rows = frame.orderBy("id").collect()
    x, y = np.array([[r[c] for c in NAMES] for r in rows]), np.array([r[label] for r in rows])
    edges = boosting.bin_edges(frame, NAMES, 16)
    margin, splits = plain_boosting(x, y, edges, 5, 0.1, 3, 10, 6, loss == "logistic")
    got = [[(n, int(f), float(t)) for n, (f, t) in enumerate(zip(m.feature, m.threshold)) if f != trees.LEAF] for m in model.trees]
    assert [sorted(s) for s in got] == [sorted((n, f, float(e)) for n, f, e in s) for s in splits]
    assert np.allclose(model.margin(x), margin)
    scored = {r["id"]: r["prediction"] for r in model.transform(frame).collect()}
    want = margin if loss == "squared" else (margin > 0).astype(float)
    assert np.allclose([scored[i] for i in range(300)], want)
    for tree in model.trees:  # a node's rows are those of its children
        for n in np.flatnonzero(tree.feature != trees.LEAF):
            assert tree.cover[n] == tree.cover[tree.left[n]] + tree.cover[tree.right[n]]


def test_boosting_draws_rows_and_columns_and_takes_odd_values(spark, frame):
    h = np.arange(1, 20_001, dtype=np.int64) * 7919
    shares = [boosting._drawn(h, t, 0.3).mean() for t in range(4)]
    assert np.allclose(shares, 0.3, atol=0.02) and (boosting._drawn(h, 0, 0.3) != boosting._drawn(h, 1, 0.3)).any()
    odd = frame.withColumn("a", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("a"))).withColumn("y", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("y")))
    model = boosting.fit_boosted_trees(odd, NAMES, "y", ["id"], rounds=12, row_share=0.5, column_share=0.5, max_depth=3)
    scored = model.transform(odd).filter("y IS NOT NULL")
    r = scored.agg(F.corr("prediction", "y")).first()[0]
    assert len(model.trees) == 12 and r > 0.7
    got = by_row(trees.tree_attributions(odd.fillna(9.0, ["a"]), "id", model.weighted_trees(), NAMES), NAMES)
    assert len(got) == 300
    with pytest.raises(ValueError):
        boosting.fit_boosted_trees(odd.limit(0), NAMES, "y", ["id"])


# --- no leakage ----------------------------------------------------------------------------


def test_test_rows_do_not_reach_train_features(spark, sf_dir):
    from venuekit.plans.registry import clean

    rows = clean(spark, sf_dir).select("row_id", "location", "online_order", "book_table", "votes", "cost", "rate", "reviews_text").cache()
    first = split_first(rows)
    test_ids = [r[0] for r in first.filter("is_test").select("row_id").collect()]
    changed = rows.withColumns({
        "cost": F.when(F.col("row_id").isin(test_ids), F.lit(99999.0)).otherwise(F.col("cost")),
        "rate": F.when(F.col("row_id").isin(test_ids), F.lit(0.1)).otherwise(F.col("rate")),
        "location": F.when(F.col("row_id").isin(test_ids), F.lit("A new place")).otherwise(F.col("location")),
    })
    train = lambda df: sorted(map(str, df.filter("NOT is_test").select("row_id", *FEATURES, "rate").collect()))
    second = split_first(changed)
    assert train(first) == train(second)
    assert {r[0] for r in second.filter("is_test").select("location_code").collect()} == {-1}
    raw = {r["row_id"]: r["rate"] for r in rows.collect()}
    assert all(raw[i] is not None for i in test_ids)
