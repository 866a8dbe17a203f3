"""Operators against brute force, and invariants under different partitionings."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuekit.operators import (
    corpus, explain, features, impute, keywords, metrics, neighbors, profile, ranking, relational, reviews, sentiment, splits,
)


def md5(v):
    return hashlib.md5(str(v).encode()).hexdigest()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    values = np.where(rng.random(6000) < 0.4, 5.0, np.round(rng.lognormal(2, 1, 6000), 3))
    rows = [(i, float(v), f"g{i % 7 if i % 3 else 0}") for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "id long, v double, g string").repartition(5).cache()


QS = [0.0, 0.01, 0.25, 0.5, 0.751, 0.99, 1.0]


@pytest.mark.parametrize("buckets", [2, 4_096])
def test_quantiles_are_exact(numbers, monkeypatch, buckets):
    rows, df = numbers
    monkeypatch.setattr(ranking, "BUCKETS", buckets)
    got = list(ranking.exact_quantiles(df, "v", QS).first())
    assert got == pytest.approx(np.quantile([r[1] for r in rows], QS), abs=1e-12)


def test_quantiles_of_odd_values(spark):
    tiny = [5e-324, 1e-300, -1e-300, 0.0, -0.0, 1.7e308, -1.7e308, 3.0, 3.0, 3.0000000000000004]
    rows = [(v, None, float("inf") if i < 2 else 1.0) for i, v in enumerate(tiny)] + [(float("nan"), None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["column"]: list(r)[1:] for r in ranking.quantiles_by_column(df, ["a", "b", "c"], [0.0, 0.5, 1.0]).collect()}
    middle = sorted(tiny)[4:6]
    assert got == {"a": [-1.7e308, sum(middle) / 2, 1.7e308], "c": [1.0, 1.0, float("inf")]}
    assert ranking.exact_median(df, "b").first()[0] is None


def test_modes_of_typed_columns_in_one_pass(spark):
    df = spark.createDataFrame([(10, "b", None), (9, "a", None), (9, "b", None), (10, "a", None), (None, None, None)], "n int, s string, e int")
    row = ranking.modes_by_column(df, ["n", "s", "e"]).first()
    assert tuple(row) == (9, "a", None)


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    assert ranking.exact_median(df, "x").first()[0] == 2.5


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([("k", v) for v in "babac"] + [("n", None)], "g string, v string")
    assert ranking.modes(df, "v").first()[0] == "a"
    assert {tuple(r) for r in ranking.modes(df, "v", ["g"]).collect()} == {("k", "a")}


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_salted_top_k(numbers, salts):
    rows, df = numbers
    got = ranking.top_k(df, ["g"], [F.desc("v"), F.asc("id")], 11, salt=["id"], salts=salts)
    want = set()
    for g in {r[2] for r in rows}:
        want |= {r[0] for r in sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))[:11]}
    assert {r["id"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [0.2, 0.003, 0.0])
def test_split_has_the_exact_size_and_is_stable(numbers, size):
    rows, df = numbers
    order = sorted((md5(r[0]), r[0]) for r in rows)
    want = {i for _, i in order[: math.ceil(len(rows) * size)]}
    for parts in (1, 8):
        got = splits.random_split(df.repartition(parts), size, ["id"]).filter("is_test")
        assert {r["id"] for r in got.collect()} == want


def test_stratified_and_group_splits(numbers):
    rows, df = numbers
    per = splits.stratified_split(df, 0.2, "g", ["id"]).groupBy("g").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    assert all(r["t"] == math.ceil(r["n"] * 0.2) for r in per.collect())
    sides = splits.group_split(df, 0.3, "g").groupBy("g").agg(F.count_distinct("is_test").alias("s"), F.max("is_test").alias("t"))
    sides = sides.collect()
    assert all(r["s"] == 1 for r in sides) and sum(r["t"] for r in sides) == math.ceil(7 * 0.3)


def test_group_folds_deal_back_and_forth(numbers):
    rows, df = numbers
    sizes = collections.Counter(r[2] for r in rows)
    order = sorted(sizes, key=lambda g: (-sizes[g], md5(g)))
    want = {g: (i % 3 if (i // 3) % 2 == 0 else 2 - i % 3) for i, g in enumerate(order)}
    got = splits.group_folds(df, "g", 3).select("g", "fold").distinct().collect()
    assert {r["g"]: r["fold"] for r in got} == want


def test_group_folds_keep_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, g string")
    got = {r["id"]: r["fold"] for r in splits.group_folds(df, "g", 2).collect()}
    assert len(got) == 3 and got[3] == -1 and got[1] >= 0 and got[2] >= 0


def test_codes_follow_byte_order(spark):
    names = ["b", "a", "ab", "aa", "Z", "é", "abc", "ac", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["code"] for r in ranking.sorted_codes(df, "n").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: s.encode()))}


def test_downsample_and_sample(numbers):
    rows, df = numbers
    kept = relational.downsample_stratum(df, F.col("g") == "g0", 0.1, ["id"])
    n = sum(r[2] == "g0" for r in rows)
    assert kept.filter("g = 'g0'").count() == int(n * 0.1)
    assert kept.filter("g <> 'g0'").count() == len(rows) - n
    assert relational.sample_rows(df, 50, ["id"]).count() == 50


def test_chi_square_with_one_degree_of_freedom_is_corrected(spark):
    cells = {("a", "x"): 12, ("a", "y"): 5, ("b", "x"): 3, ("b", "y"): 9}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p string, q string")
    r, c, n = {"a": 17, "b": 12}, {"x": 15, "y": 14}, 29
    want = sum((abs(o - r[p] * c[q] / n) - 0.5) ** 2 / (r[p] * c[q] / n) for (p, q), o in cells.items())
    got = profile.chi_square(df, "p", "q").first()
    assert got["dof"] == 1 and got["chi2"] == pytest.approx(want)


def test_p_value_follows_the_corrected_statistic(spark):
    cells = {("a", "x"): 10, ("a", "y"): 5, ("b", "x"): 4, ("b", "y"): 11}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p string, q string")
    got = profile.independence_test(df, "p", "q").first()
    assert got["dof"] == 1 and not got["dependent"]
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(got["chi2"] / 2)))
    for x in (0.1, 3.0, 40.0, 900.0):  # an even number of degrees has a finite sum
        want = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(5))
        assert profile.chi_square_tail(x, 10) == pytest.approx(want)


def test_very_large_counts_do_not_overflow(spark, monkeypatch):
    big = spark.createDataFrame([(p, q, 4_000_000_000) for p in "ab" for q in "xyz"], "p string, q string, n long")
    monkeypatch.setattr(profile, "crosstab", lambda df, a, b: df)
    assert profile.chi_square(big, "p", "q").first()["chi2"] == pytest.approx(0)
    assert {r["expected"] for r in profile.expected_counts(big, "p", "q").collect()} == {4e9}


def test_group_mode_fill(spark):
    rows = [(1, "x", "p"), (2, "x", None), (3, "y", None), (4, None, None), (5, "x", "p"), (6, "x", "q")]
    df = spark.createDataFrame(rows, "id int, g string, v string")
    got = {r["id"]: r["v"] for r in impute.fill_group_mode(df, "v", "g").collect()}
    assert got == {1: "p", 2: "p", 3: "Unknown", 4: None, 5: "p", 6: "q"}


def brute_neighbors(q, x, k, metric, skip):
    out = set()
    for qi, qv in q:
        scored = []
        for xi, xv in x:
            if skip and xi == qi:
                continue
            if metric == "l2":
                s = math.dist(qv, xv)
            else:
                s = -float(np.dot(qv, xv)) / (np.linalg.norm(qv) * np.linalg.norm(xv))
            scored.append((round(s, 9), xi))
        out |= {(qi, xi, rank + 1) for rank, (_, xi) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("path", ["broadcast", "blocks"])
@pytest.mark.parametrize("skip", [True, False])
def test_neighbors_match_brute_force(spark, monkeypatch, metric, path, skip):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(neighbors, "INDEX_BLOCK", 40)
    rng = np.random.default_rng(3)
    vectors = rng.integers(1, 4, size=(150, 4)).astype(float)  # many exact ties
    x = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(x, "id long, vec array<double>").repartition(6)
    cells = 10**6 if path == "broadcast" else 0
    got = neighbors.nearest(df, df, "id", "vec", "id", "vec", 5, metric, skip_self=skip, broadcast_cells=cells)
    assert {(r["query_id"], r["index_id"], r["rank"]) for r in got.collect()} == brute_neighbors(x, x, 5, metric, skip)


def test_zero_distance_outvotes(spark):
    rows = [(1, 0.0, "b"), (1, 0.1, "a"), (1, 0.1, "a"), (2, 0.5, "b"), (2, 1.0, "a"), (2, 1.0, "a")]
    df = spark.createDataFrame(rows, "query_id int, score double, y string")
    assert {tuple(r) for r in neighbors.vote(df, "y", "distance").collect()} == {(1, "b"), (2, "a")}
    assert {tuple(r) for r in neighbors.vote(df, "y").collect()} == {(1, "a"), (2, "a")}


def loop_chunks(text, size, overlap):
    import re

    pieces = []
    for s in re.split(r"(?<=[.!?])\s+|\n+", text):
        w = s.split()
        pieces += [w[i : i + size] for i in range(0, len(w), size)]
    done, cur = [], []
    for w in pieces:
        n = sum(map(len, cur))
        if cur and n + len(w) > size:
            done.append(cur)
            kept, room = [], min(overlap, size - len(w))
            for p in reversed(cur):
                if sum(map(len, kept)) + len(p) > room:
                    break
                kept = [p, *kept]
            cur = kept
        cur = [*cur, w]
    return [" ".join(x for p in c for x in p) for c in [*done, cur] if c]


def test_sentence_chunks_match_a_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for size, overlap in ((600, 60), (50, 20)):
        got = collections.defaultdict(dict)
        for r in corpus.sentence_chunks(docs, "doc_id", "text", size, overlap).collect():
            got[r["doc_id"]][r["chunk_no"]] = r["chunk"]
            assert r["n_words"] <= size
        for r in rows:
            assert [c for _, c in sorted(got[r["doc_id"]].items())] == loop_chunks(r["text"], size, overlap)


def test_hashed_vectors(spark):
    from pyspark.ml.feature import HashingTF

    df = spark.createDataFrame([(1, "red hot red"), (2, "")], "id int, t string")
    got = {r["id"]: r["embedding"] for r in corpus.hashed_vectors(df, "id", "t", dims=32).collect()}
    want, tf = np.zeros(32), HashingTF(numFeatures=32)
    for term in ["red", "hot", "red", "red hot", "hot red"]:
        want[tf.indexOf(term)] += 1
    assert got[1] == pytest.approx(want / np.linalg.norm(want))
    assert got[2] == [0.0] * 32


def test_sentiment_rules(spark):
    data = ["good", "not good", "very good", "very bad", "good!!", "", "nothing here"]
    data += [  # capitals, contrast, question marks, idioms
        "GOOD place", "GOOD", "it was VERY good", "a SLIGHTLY bad one", "good food but bad service", "but good", "Good??", "good????? Why", "good?",
        "the kiss of death", "truly the bomb", "a broken heart is bad", "It isn't GOOD but to die for!", "NOT good",
    ]
    df = spark.createDataFrame(list(enumerate(data)), "id int, t string")
    got = {r["id"]: r["sentiment_compound"] for r in sentiment.score_reviews(df, "id", "t").collect()}
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    sums = [1.9, 1.9 * -0.74, 1.9 + 0.293, -2.5 - 0.293, 1.9 + 2 * 0.292, 0.0, 0.0]
    sums += [
        1.9 + 0.733, 1.9, 1.9 + 0.293 + 0.733, -2.5 + 0.293 + 0.733, 1.9 * 0.5 - 2.5 * 1.5, 1.9 * 1.5, 1.9 + 0.36, 1.9 + 0.96, 1.9,
        -1.5, 3.0, -2.9 - 2.5, (1.9 + 0.733) * -0.74 * 0.5 + 3.0 * 1.5 + 0.292, 1.9 * -0.74,
    ]
    assert [got[i] for i in range(len(data))] == pytest.approx([norm(s) for s in sums])


def test_budget_stops_at_the_first_overflow(spark):
    rows = [(f"r{i}", "k", " ".join(["w"] * n)) for i, n in enumerate([3, 4, 5, 1, 1, 0, 2])]
    df = spark.createDataFrame(rows, "id string, k string, t string")
    total, want = 0, []
    for i, _, t in sorted((r for r in rows if r[2]), key=lambda r: md5(r[0])):
        total += len(t.split())
        if total > 8:
            break
        want.append(t)
    assert reviews.budgeted_text(df, ["k"], "id", "t", 8).first()["clean_review"] == " ".join(want)


def test_budget_keeps_groups_where_nothing_fits(spark):
    df = spark.createDataFrame([("r1", "k", "a b c"), ("r2", "m", "a"), ("r3", "n", None)], "id string, k string, t string")
    got = {r["k"]: r["clean_review"] for r in reviews.budgeted_text(df, ["k"], "id", "t", 2).collect()}
    assert got == {"k": "", "m": "a", "n": ""}


def test_tfidf_against_a_loop(spark):
    docs = {1: "aa bb aa", 2: "bb cc", 3: "bb dd dd dd", 4: "aa"}
    df = spark.createDataFrame(list(docs.items()), "id int, t string")
    counts = {}
    for i, t in docs.items():
        w = t.split()
        counts[i] = collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    dfreq = collections.Counter(t for c in counts.values() for t in c)
    want = {}
    for i, c in counts.items():
        raw = {t: (1 + math.log(n)) * (math.log(5 / (1 + dfreq[t])) + 1) for t, n in c.items() if dfreq[t] <= 0.7 * 4}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, t): v / norm for t, v in raw.items()}
    got = {(r["id"], r["term"]): r["score"] for r in keywords.tfidf(df, ["id"], "t", max_df=0.7).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_class_report_on_a_fixed_label_set(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in metrics.class_report(df, "y", "p", list("abcd")).collect()}
    assert got == {"a": (0.5, 0.5, 2), "b": (0.5, 1.0, 1), "c": (0.0, 0.0, 1), "d": (0.0, 0.0, 0)}
    assert metrics.confusion_matrix(df, "y", "p", list("abcd")).agg(F.sum("n")).first()[0] == 4


def test_permuting_keeps_the_values(numbers):
    rows, df = numbers
    moved = explain.permute_column(df, "v", ["id"], 3)
    assert sorted(r["v"] for r in moved.collect()) == sorted(r[1] for r in rows)
    assert moved.count() == len(rows)


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 3.0, 0.0)], "id int, a double, b double")
    got = explain.linear_attributions(df, "id", {"a": 2.0, "b": -1.0}).groupBy("id").agg(F.sum("attribution").alias("s"))
    assert {r["id"]: r["s"] for r in got.collect()} == {1: -4.0, 2: 4.0}


def test_unseen_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = features.label_codes(train, "c")
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = {r["c"]: r["c_code"] for r in features.encode_labels(rows, codes, "c").collect()}
    assert got == {"a": 0, "z": -1, "nan": 2}


def test_lists_of_more_labels_than_a_driver_should_hold(spark):
    n = 320_000
    rows = spark.range(n).select("id", F.array(F.format_string("label %07d", n - 1 - F.col("id")), F.lit("hot"), F.lit(None)).alias("tags"))
    rows = rows.unionByName(spark.createDataFrame([(n, None), (n + 1, []), (n + 2, ["never seen"])], "id long, tags array<string>"))
    model = features.MultiLabelEncoder("tags", "v", "id").fit(rows.filter(F.col("id") < n))
    size, codes, ones = features.sparse_cells("v")
    found = model.transform(rows).select("id", size.alias("size"), codes.alias("codes"), ones.alias("ones"))
    wrong = found.filter((F.col("id") < n) & (F.col("codes") != F.array(F.lit(0), (n - F.col("id")).cast("int"))))
    assert wrong.count() == 0 and found.filter("id < 320000 AND ones != array(1.0D, 1.0D)").count() == 0
    odd = found.filter(F.col("id") >= n).collect()
    assert len(odd) == 3 and all((r["size"], r["codes"]) == (n + 1, []) for r in odd)


def test_encoder_survives_saving(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = spark.createDataFrame([(1, 2.0, "x", ["b", "a"]), (2, 0.0, None, ["c"]), (3, 1.0, "y", None)], "id long, n double, c string, tags array<string>")
    model = features.preprocessing(["n"], ["c"], ["tags"], key="id").fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    both = [{r["id"]: r["features"].toArray().tolist() for r in m.transform(rows).collect()} for m in (model, again)]
    assert both[0] == both[1] == {1: [2, 1, 0, 1, 1, 0], 2: [0, 0, 0, 0, 0, 1], 3: [1, 0, 1, 0, 0, 0]}


def test_scaling_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in features.standardize(df, df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_pivots_skip_blocks_and_lose_nothing(spark, monkeypatch, metric):
    from venuekit.operators import neighbors

    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 40)
    monkeypatch.setattr(neighbors, "INDEX_BLOCK", 50)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 8)) * 5
    points = [(i, [float(v) for v in centres[i % 20] + rng.normal(size=8) * 0.05], f"p{i}") for i in range(1000)]
    points += [(2000 + i, [0.0] * 8, "zero") for i in range(3)] + [(3000 + i, points[7][1], "copy") for i in range(60)]
    index = spark.createDataFrame(points, "id long, vec array<double>, name string")
    queries = index.filter("id % 3 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    stats = {}
    search = lambda **more: neighbors.nearest(queries, index, "qid", "qvec", "id", "vec", 5, metric, ["name"], skip_self=True, **more)
    got = sorted(map(tuple, search(broadcast_cells=0, stats=stats).collect()))
    assert got == sorted(map(tuple, search().collect()))
    assert stats["searched"] < 0.7 * stats["pairs"]
    none = neighbors.nearest(queries, index.limit(0), "qid", "qvec", "id", "vec", 5, metric, broadcast_cells=0)
    assert none.count() == 0


def test_index_vectorises_only_what_changed(spark, tmp_path):
    from venuekit.operators.index import read_index, update_index

    folder = str(tmp_path / "index")
    rows = [(f"d{i}", f"Sentence one of {i}. Sentence two. " * 90, "m") for i in range(20)] + [("e", "", None), ("n", None, None)]
    docs = lambda r: spark.createDataFrame(r, "doc_id string, text string, meta string").repartition(3)
    with pytest.raises(ValueError):
        read_index(spark, folder)
    assert update_index(docs(rows), folder) == {"build": 0, "indexed": 22, "reused": 0, "removed": 0}
    assert update_index(docs(rows + rows[:1]), folder) == {"build": 0, "indexed": 0, "reused": 22, "removed": 0}
    changed = [("d0", "quite new", "m"), ("d1", rows[1][1], "other"), *rows[3:], ("z", "added", "m")]
    assert update_index(docs(changed), folder) == {"build": 1, "indexed": 3, "reused": 19, "removed": 3}
    key = lambda r: (r["chunk_id"], r["chunk"], r["meta"], r["embedding"])
    got = sorted(map(key, read_index(spark, folder).collect()))
    update_index(docs(changed), str(tmp_path / "fresh"))
    assert got == sorted(map(key, read_index(spark, str(tmp_path / "fresh")).collect()))
    assert {r[0].split("#")[0] for r in got} == {"d0", "d1", "z", *[f"d{i}" for i in range(3, 20)]}


def test_lemmas_by_table_and_rule(spark):
    from venuekit.functions import text

    words = ["women", "knives", "movies", "berries", "dishes", "glasses", "menus", "boss", "always", "firemen", "species"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(text.singular(F.col("w"))).collect()]
    assert got == ["woman", "knife", "movie", "berry", "dish", "glass", "menus", "boss", "always", "fireman", "species"]


def test_clusters_lead_queries_to_few_cells(spark, monkeypatch):
    """Indicators of many groups: distances to pivots are alike, the boxes of the cells are not."""
    from venuekit.operators import neighbors

    monkeypatch.setattr(neighbors, "INDEX_BLOCK", 40)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        hot = np.zeros(90)
        hot[[i % 30, 30 + i % 30, 60 + i % 30]] = 1.0
        rows.append((i, f"g{i % 30}", [float(v) for v in [*rng.normal(size=2), *hot]]))
    df = spark.createDataFrame(rows, "id long, name string, vec array<double>")
    stats = {}
    search = lambda **more: neighbors.nearest(df.filter("id % 7 = 0"), df.filter("id % 7 <> 0"), "id", "vec", "id", "vec", 7, **more)
    got = sorted(map(tuple, search(broadcast_cells=0, cluster=["name"], stats=stats).collect()))
    assert got == sorted(map(tuple, search().collect()))
    assert stats["searched"] < 0.4 * stats["pairs"]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_best_pairs_score_few_pairs_exactly(monkeypatch, metric):
    """The product decides which pairs are scored; ties go to the first column, whatever the part it is in."""
    from venuekit.operators import neighbors

    monkeypatch.setattr(neighbors, "_FIRST_COLUMNS", 64)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, size=(900, 6)).astype(float)
    queries, scored, exact = vectors[:50] * 1.5, [], neighbors._paired_scores
    monkeypatch.setattr(neighbors, "_paired_scores", lambda a, b, m: scored.append(len(a)) or exact(a, b, m))
    rows, cols, scores = neighbors._best_pairs(queries, vectors, 9, metric, np.full(50, np.inf))
    full = neighbors._scores(queries, vectors, metric)
    want = np.argsort(full, axis=1, kind="stable")[:, :9]
    assert cols.reshape(50, 9).tolist() == want.tolist()
    assert np.allclose(scores.reshape(50, 9), np.take_along_axis(full, want, 1), atol=2e-9)
    assert sum(scored) < 0.3 * full.size


def test_tfidf_scores_stay_with_their_documents(spark, monkeypatch):
    """Rows of one key are one document, texts do not run together, and the scores need no exchange."""
    rows = [(1, "big red bus"), (1, "bus stop"), (2, None), (3, "red bus"), (None, "stop stop sign"), (4, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    near = keywords.tfidf(df, ["id"], "t", max_df=1.0)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["term"]): (r["tf"], r["df"], round(r["score"], 9)) for r in near.collect()}
    assert got[(1, "bus")][:2] == (2, 2) and (1, "bus bus") not in got and got[(None, "stop stop")][:2] == (1, 1)
    monkeypatch.setattr(keywords, "BROADCAST_TERMS", 0)
    joined = {(r["id"], r["term"]): (r["tf"], r["df"], round(r["score"], 9)) for r in keywords.tfidf(df, ["id"], "t", max_df=1.0).collect()}
    assert got == joined
