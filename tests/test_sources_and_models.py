"""Sinks, readers, enrichment invariants and fitted models."""

import pytest
from pyspark.sql import functions as F

from venuekit.operators import models, relational
from venuekit.plans.enrichment import enrich, source_counts
from venuekit.plans.queries_models import FEATURES, training_table
from venuekit.plans.registry import clean
from venuekit.session import scratch_path, shared_dir
from venuekit.sources import readers, writers


def test_csv_keeps_quotes_breaks_and_blanks(spark):
    rows = [(1, ' a "quoted", text\nover two lines '), (2, "n/a"), (3, None), (4, "back\\slash")]
    df = spark.createDataFrame(rows, "id int, t string")
    back = readers.read_csv(spark, writers.write_csv(df, scratch_path(spark, "csv")), "id int, t string")
    assert {r["id"]: r["t"] for r in back.collect()} == {1: rows[0][1], 2: None, 3: None, 4: "back\\slash"}
    assert writers.check_sink(readers.without_placeholders(df), back).first()["matches"]
    assert not writers.check_sink(df, back).first()["matches"]  # a placeholder became NULL


def test_jdbc_options():
    assert readers.jdbc_url("postgres://h:1/db?sslmode=require") == "jdbc:postgresql://h:1/db?sslmode=require"
    options = readers.jdbc_options("postgresql://h/db", "t", "id", 0, 100, 8)
    assert options["numPartitions"] == "8" and options["dbtable"] == "t"
    with pytest.raises(ValueError):
        readers.jdbc_options("postgresql://h/db", "t", "id")


def test_stored_table_is_reused_until_rebuilt(spark):
    path, built = scratch_path(spark, "stored"), []

    def build():
        built.append(1)
        return spark.range(5 * len(built))

    assert readers.reuse_or_build(spark, path, build).count() == 5
    assert readers.reuse_or_build(spark, path, build).count() == 5
    assert readers.reuse_or_build(spark, path, build, rebuild=True).count() == 10
    assert len(built) == 2


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="fax"):
        relational.require_columns(spark.range(1), ["id", "fax"])


def test_enrichment_classes_cover_all_rows(spark, sf_dir):
    counts = source_counts(enrich(clean(spark, sf_dir))).first()
    assert counts["n_direct"] + counts["n_inherited"] + counts["n_none"] == counts["n_total"]
    assert counts["n_total"] == clean(spark, sf_dir).count()


def test_enrichment_does_not_depend_on_partitions(spark, sf_dir):
    results = []
    for parts in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = enrich(clean(spark, sf_dir).repartition(int(parts))).drop("tags")
        results.append(sorted(map(str, rows.collect())))
    assert results[0] == results[1]


def test_saved_model_predicts_the_same(spark, sf_dir):
    data = training_table(spark, sf_dir)
    assert data.filter(F.col("cost").isNull() | F.col("rate").isNull()).count() == 0
    model = models.assembled(models.decision_tree_regressor("rate"), FEATURES).fit(data.filter("NOT is_test"))
    again = models.save_model(model, scratch_path(spark, "model"))
    both = [sorted(map(tuple, m.transform(data).select("row_id", "prediction").collect())) for m in (model, again)]
    assert both[0] == both[1]


def test_random_features_approximate_the_kernel(spark):
    import numpy as np
    from pyspark.ml import Pipeline

    rng = np.random.default_rng(1)
    points = rng.normal(size=(12, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    out = Pipeline(stages=models.rbf_features(["a", "b"], 0.5, dims=2000)).fit(df).transform(df).orderBy("id")
    z = np.array([r["rbf"].toArray() for r in out.select("rbf").collect()])
    want = np.exp(-0.5 * ((points[:, None] - points[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.12


def test_macro_f1_evaluator(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "y double, prediction double")
    got = models.evaluator("f1_macro", "y", [0, 1, 2]).evaluate(df)
    assert got == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_approximate_support_vectors_survive_saving(spark, sf_dir):
    data = training_table(spark, sf_dir).select("row_id", "high", *[(F.col(c) / 100.0).alias(c) for c in FEATURES])
    model = models.support_vector_classifier(FEATURES, "high", 200, dims=20).fit(data)
    again = models.save_model(model, scratch_path(spark, "svc"))
    both = [sorted(map(tuple, m.transform(data).select("row_id", "prediction").collect())) for m in (model, again)]
    assert both[0] == both[1]


def test_sink_check_finds_changed_values(spark):
    from venuekit.sources.writers import check_sink, sink_differences

    rows = [(i, f"name {i % 5}", [i, i + 1], None if i % 3 else 1.5) for i in range(200)]
    schema = "id long, name string, items array<int>, v double"
    frame = spark.createDataFrame(rows, schema)
    shuffled = spark.createDataFrame(rows[::-1], schema).repartition(7)
    assert check_sink(frame, shuffled).first()["matches"]

    def different(changed):
        other = spark.createDataFrame(changed, schema)
        assert not check_sink(frame, other).first()["matches"]
        return {r["column"] for r in sink_differences(frame, other).collect() if not r["same"]}

    assert different([(*rows[0][:3], 1.6), *rows[1:]]) == {"v", "*"}
    assert different([(*rows[0][:3], None), *rows[1:]]) == {"v", "*"}
    assert different([(0, "name 1", [0, 1], 1.5), (1, "name 0", [1, 2], None), *rows[2:]]) == {"*"}  # two names changed places
    assert different([rows[1], *rows[1:]]) >= {"id", "items", "*"}
    assert different([]) == {"id", "name", "items", "v", "*"}
    dropped = {r["column"]: r["same"] for r in sink_differences(frame, frame.drop("v")).collect()}
    assert dropped == {"id": True, "name": True, "items": True, "v": False, "*": False}
