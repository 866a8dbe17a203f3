"""Neighbours of rows with indicators, and what the variant comparison learns for all folds at once, against plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuekit.operators import features, impute, indicator_neighbors as I, neighbors
from venuekit.plans import experiment


def sets(rng, n, n_codes, most):
    sizes = np.minimum(rng.integers(0, most, n), n_codes)
    codes = [np.sort(rng.choice(n_codes, s, replace=False)) for s in sizes]
    return I.Rows(np.round(rng.normal(size=(n, 2)), 1), np.concatenate(codes).astype(np.int64), sizes)


def dense(rows, n_codes):
    ones = np.zeros((len(rows), n_codes))
    ones[rows.owners, rows.codes] = 1
    return np.column_stack([rows.numbers, ones])


@pytest.mark.parametrize("n_codes, most, leaf, bits", [(20, 6, 128, 256), (900, 8, 16, 64), (900, 8, 128, 128), (3, 3, 8, 256), (1, 1, 8, 256)])
@pytest.mark.parametrize("skip", [False, True])
def test_best_rows_match_brute_force(monkeypatch, n_codes, most, leaf, bits, skip):
    """More codes than bits of a map, many ties, empty sets and codes that no row has."""
    monkeypatch.setattr(I, "LEAF_ROWS", leaf)
    monkeypatch.setattr(I, "MAP_BITS", bits)
    rng = np.random.default_rng(4)
    queries, index = sets(rng, 120, n_codes, most), sets(rng, 700, n_codes, most)
    ids = rng.permutation(700) * 3
    own = ids[:120] if skip else None
    who, rows, scores = I.best_rows(queries, index, ids, 7, np.full(120, np.inf), own)
    apart = np.round(np.linalg.norm(dense(queries, n_codes)[:, None] - dense(index, n_codes)[None], axis=2), 9)
    if skip:
        apart[own[:, None] == ids[None]] = np.inf
    for i in range(120):
        best = np.lexsort((ids, apart[i]))[:7]
        assert list(rows[who == i]) == list(best)
        assert scores[who == i] == pytest.approx(apart[i][best], abs=1e-9)


def test_missing_numbers_come_last():
    index = I.Rows(np.array([[0.0], [np.nan], [2.0], [np.inf]]), np.array([1, 1, 2]), np.array([1, 1, 0, 1]))
    query = I.Rows(np.array([[0.5], [np.nan]]), np.array([1]), np.array([1, 0]))
    who, rows, scores = I.best_rows(query, index, np.arange(4), 3, np.full(2, np.inf))
    assert list(rows[who == 0])[:2] == [0, 2]
    assert np.isnan(scores[who == 1]).all() and (who == 1).sum() == 3


def test_few_pairs_are_compared():
    """Rows of one group agree in their indicators: a query meets the leaves of its own group, not all rows."""
    rng = np.random.default_rng(6)
    group = rng.integers(0, 60, 20_000)
    rows = lambda g: I.Rows(rng.normal(size=(len(g), 2)), np.column_stack([g, 60 + g, 120 + g]).reshape(-1), np.full(len(g), 3))
    stats = {}
    I.best_rows(rows(group[:500]), rows(group), np.arange(20_000), 15, np.full(500, np.inf), stats=stats)
    assert stats["pairs"] < 0.05 * 500 * 20_000


@pytest.mark.parametrize("skip", [False, True])
def test_nearest_with_indicators_matches_vectors(spark, monkeypatch, skip):
    """Two parts, small cells: the same rows and ranks as a search over whole vectors in each part."""
    for name, value in (("CELL_ROWS", 40), ("QUERY_BLOCK", 16), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(I, name, value)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(500):
        g, extra = int(rng.integers(0, 12)), sorted({int(c) for c in rng.integers(24, 40, 2)})
        rows.append((i, i % 2, f"g{g}", [float(rng.integers(0, 4)), 0.5], [g, 12 + g, *extra, 40 + g, 52 + g]))
    df = spark.createDataFrame(rows, "id long, part int, name string, vec array<double>, ones array<int>").repartition(4)
    vector = F.concat("vec", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array_contains("ones", i.cast("int")).cast("double")))
    whole = df.withColumn("whole", vector)
    held, rest = (df.filter("id < 200"), df) if skip else (df.filter("id < 200"), df.filter("id >= 200"))
    stats = {}
    got = neighbors.nearest(held, rest, "id", "vec", "id", "vec", 6, payload=["name"], skip_self=skip, cluster=["name"], stats=stats, ones="ones", by="part")
    want = set()
    for p in (0, 1):
        q, x = (whole.filter(F.col("part") == p).join(t.select("id"), "id") for t in (held, rest))
        want |= set(map(tuple, neighbors.nearest(q, x, "id", "whole", "id", "whole", 6, payload=["name"], skip_self=skip).collect()))
    assert set(map(tuple, got.collect())) == want
    assert len(want) == 1200
    assert stats["searched"] < 0.8 * stats["pairs"]
    none = neighbors.nearest(held, rest.limit(0), "id", "vec", "id", "vec", 6, ones="ones", by="part")
    assert none.count() == 0
    other = neighbors.nearest(held, rest.filter("part = 1"), "id", "vec", "id", "vec", 6, ones="ones", by="part")
    assert {r["query_id"] % 2 for r in other.collect()} == {1}
    with pytest.raises(ValueError):
        neighbors.nearest(held, rest, "id", "vec", "id", "vec", 6, metric="cosine", ones="ones")


def venue_rows(spark):
    rng = np.random.default_rng(9)
    pick = lambda values: values[int(rng.integers(0, len(values)))]
    rows = [
        (i, f"n{i % 23}", pick([1, 2, 7, 30]), pick([None, 100.0, 250.0, 400.0]), pick([0, 1]), pick([0, 1, None]), pick([None, "a", "b", "c"]),
         f"l{i % 4}", [f"t{i % 9}", "t0", None], None if i % 11 == 0 else [f"k{i % 5}"], pick(["low", "mid", "high"]), i % 6 - 1)
        for i in range(300)
    ]
    return spark.createDataFrame(
        rows, "row_id long, name string, votes long, cost double, online_order int, book_table int, category string, listing string,"
        " tags array<string>, kinds array<string>, rate_tier string, fold int")


def test_parts_are_filled_as_if_alone(spark):
    df = venue_rows(spark)
    fits = [F.col("fold") != i for i in range(5)]
    got = impute.impute_fitted(df, fits, experiment.NUMERIC, experiment.CATEGORICAL)
    for i in range(5):
        alone = impute.impute_fitted(df, df.filter(fits[i]), experiment.NUMERIC, experiment.CATEGORICAL)
        assert sorted(map(str, got.filter(F.col("part") == i).drop("part").collect())) == sorted(map(str, alone.collect()))


def test_lists_are_the_same_by_map_and_by_join(spark, monkeypatch, tmp_path):
    copies = venue_rows(spark).withColumn("part", F.explode(F.array(F.lit(0), F.lit(2))))
    codes = features.label_table(copies.filter("row_id % 9 <> part"), "tags", str(tmp_path / "codes"), by="part")
    search = lambda: sorted(map(str, features.label_lists(copies, "row_id", "tags", codes, ["row_id", "part", "fold"], by="part").collect()))
    mapped = search()
    monkeypatch.setattr(features, "MAP_LABELS", 3)
    assert search() == mapped
    assert len(mapped) == 600


@pytest.mark.parametrize("imputed", [True, False])
def test_folds_learn_apart_in_one_pass(spark, imputed):
    """The squared distance of any two rows is that of the vectors learned on the other folds alone."""
    rows = venue_rows(spark)
    rows = rows if imputed else rows.filter("cost IS NOT NULL AND category IS NOT NULL AND book_table IS NOT NULL")
    together = experiment.fitted_features(rows, [F.col("fold") != i for i in range(5)], imputed).collect()
    assert all(len(r["features"]) == 2 for r in together)
    for i in (0, 3):
        alone = {r["row_id"]: r for r in experiment.fitted_features(rows, [F.col("fold") != i], imputed).collect()}
        mine = {r["row_id"]: r for r in together if r["part"] == i}
        assert mine.keys() == alone.keys()
        for key, r in mine.items():
            assert r["features"] == pytest.approx(alone[key]["features"])
            assert r["ones"] == alone[key]["ones"] == sorted(set(r["ones"]))


def test_grid_of_votes_is_each_vote(spark):
    rng = np.random.default_rng(11)
    rows = []
    for q in range(60):
        scores = np.sort(rng.integers(0, 4, 15)) / 2
        rows += [(q, float(s), f"c{rng.integers(0, 3)}", j + 1) for j, s in enumerate(scores[: 15 - q % 13])]
    near = spark.createDataFrame(rows, "query_id int, score double, y string, rank int")
    got = neighbors.vote_grid(near, "y", [1, 3, 15], ["uniform", "distance"]).select("query_id", F.explode("votes").alias("v")).select("query_id", "v.*")
    want = set()
    for k in (1, 3, 15):
        for w in ("uniform", "distance"):
            want |= {(r["query_id"], k, w, r["prediction"]) for r in neighbors.vote(near.filter(F.col("rank") <= k), "y", w).collect()}
    assert set(map(tuple, got.collect())) == want


def test_grid_of_classes_matches_plain_folds(spark, monkeypatch):
    """Macro-F1 of five classes from one search over all folds, against each fold, pair and vote by itself."""
    labels = [f"c{i}" for i in range(5)]
    rows = venue_rows(spark).withColumn("rate_class", F.concat(F.lit("c"), (F.col("row_id") * 7 % 11 % 5).cast("string")))
    rows = rows.select(*[c for c in rows.columns if c != "rate_tier"])
    calls, search = [], experiment.nearest
    monkeypatch.setattr(experiment, "nearest", lambda *a, **more: calls.append(1) or search(*a, **more))
    got = {(r["k"], r["weights"]): r["mean_f1"] for r in experiment.tune(rows, "rate_class", labels, True).collect()}
    assert len(calls) == 1
    scores = {}
    for fold in range(5):
        ready = experiment.fitted_features(rows, [F.col("fold") != fold], True).orderBy("row_id").collect()
        width = 1 + max(c for r in ready for c in r["ones"])
        whole = np.zeros((len(ready), 2 + width))
        for i, r in enumerate(ready):
            whole[i, :2] = r["features"]
            whole[i, 2 + np.array(r["ones"], int)] = 1
        held, rest = (np.array([i for i, r in enumerate(ready) if (r["fold"] == fold) == side]) for side in (True, False))
        classes = np.array([r["rate_class"] for r in ready])
        apart = np.round(np.linalg.norm(whole[held][:, None] - whole[rest][None], axis=2), 9)
        order = np.argsort(apart, axis=1, kind="stable")
        for k in experiment.NEIGHBOR_GRID:
            for kind in experiment.WEIGHT_GRID:
                voted = []
                for i in range(len(held)):
                    near = [(classes[rest[j]], apart[i, j]) for j in order[i, :k]]
                    if kind == "uniform":
                        votes = {c: (0, sum(y == c for y, _ in near)) for c in labels}
                    else:
                        votes = {c: (sum(y == c and d == 0 for y, d in near), round(sum(1 / d for y, d in near if y == c and d > 0), 9)) for c in labels}
                    voted.append(min(labels, key=lambda c: (-votes[c][0], -votes[c][1], c)))
                f1 = []
                for c in labels:
                    hits = sum(a == c == v for a, v in zip(classes[held], voted, strict=True))
                    f1.append(2 * hits / max(1, (classes[held] == c).sum() + voted.count(c)))
                scores.setdefault((k, kind), []).append(np.mean(f1))
    assert got.keys() == scores.keys()
    for setting, f1 in scores.items():
        assert got[setting] == pytest.approx(np.mean(f1), abs=1e-9)
