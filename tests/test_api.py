import random

import pytest
from pyspark.sql import functions as F

from tessella import api
from tessella.operators import fairness


@pytest.fixture(scope="module")
def ds(spark):
    rng = random.Random(12)
    rows = []
    for i in range(240):
        x = rng.gauss(0, 1)
        rows.append((i, ("train", "train", "train", "val", "test")[i % 5], x, x * 2 + rng.gauss(0, 0.01), rng.choice("ab"), "yes" if x > 0 else "no", rng.choice(["u", "v", "w"])))
    rows[7] = (7, "train", 60.0, 120.0, "a", "yes", "u")
    rows[11] = (11, "train", *rows[8][2:])  # a copy of a val row
    df = spark.createDataFrame(rows, "row_id long, dataset string, x double, y double, g string, label string, kind string")
    return api.Dataset(df, "label", sensitive_features=("g", "kind"))


def test_summary(ds, spark, tmp_path):
    s = api.DataSummary(ds, {"g": "cat", "label": "cat", "kind": "cat"}, api.Settings(cv_folds=2, knn_neighbors=5))
    tables = s.create_summary()
    assert s.groups == [("x", "y")]
    quick = s.quick_summary()
    assert quick["outliers"]["train"] >= 1 and quick["near_duplicates"].get("train-val", 0) >= 1 and quick["data_leakage_split_based"]
    assert s.detailed_outliers().where("row_id = 7").count() == 1 and s.detailed_label_issues().count() == 240
    assert {r.row_id for r in s.detailed_near_duplicates().collect()} >= {8, 11}
    assert s.detailed_correlations(2).where("column = 'x'").first().other == "y"
    cleaned = s.solve_issues().df
    kept = {r.row_id for r in cleaned.collect()}
    assert not {7, 11} & kept and 8 in kept
    assert s.solve_issues(splits=["test"]).df.where("dataset = 'train'").count() == 144
    s.save(str(tmp_path / "s"))
    again = api.load_summary(ds, str(tmp_path / "s"))
    assert again.types == s.types and again.groups == s.groups and again.tables["outliers"].count() == tables["outliers"].count()


def test_modelling_and_assessment(ds, tmp_path):
    prepared = api.autoML_prep(ds)
    more, names = api.feature_generation(prepared, 2)
    assert len(names) == 2 and set(names) <= set(more.df.columns)
    model = api.AutoMLModel(prepared, "medium")
    scored = model.run_auto_ml()
    out = api.FairnessAssessor(prepared, scored).analyze("sens")
    assert {r.feature_set for r in out["by_group"].collect()} == {"g", "kind", "g+kind"} and out["fairness"].count() == 3
    binned = api.FairnessAssessor(prepared, scored).analyze("x", intersections=False)
    assert {r.feature_set for r in binned["gaps"].collect()} == {"x_bin"}
    model.save(str(tmp_path / "m"))
    again = api.AutoMLModel.retrieve_model(prepared, str(tmp_path / "m"))
    assert again.model.classes == model.model.classes and again.model.medians == model.model.medians
    test = prepared.part("test")
    assert sorted(map(str, again.predict(test).collect())) == sorted(map(str, model.predict(test).collect()))
    assert again.get_feature_importance().count() == model.get_feature_importance().count()


def test_overall_metrics_and_labels(ds, spark):
    prepared = api.autoML_prep(ds)
    assert prepared.pos_label in ("yes", "no")
    from dataclasses import replace

    assert api.autoML_prep(replace(ds, pos_label="never seen")).pos_label == prepared.pos_label  # not in the data
    scored = prepared.part("test").withColumn("prediction", F.col("label"))
    f = api.FairnessAssessor(prepared, scored)
    before = {r.metric: r.value for r in f.overall().collect()}
    assert before["accuracy"] == 1.0 and before["count"] == scored.count()
    worse = api.FairnessAssessor(prepared, scored.withColumn("prediction", F.lit("yes")))
    change = {r.metric: r.change for r in fairness.compare_runs(f.overall(), worse.overall()).collect()}
    assert change["accuracy"] < 0 and change["count"] == 0
    assert {r.feature_set for r in f.get_all_metrics()["by_group"].select("feature_set").distinct().collect()} == {"x_bin", "y_bin", "g", "kind"}
    assert set(f.analyze_all_categorical()) == {"overall", "by_group", "gaps", "fairness"} and f.analyze_feature("g")["gaps"].count() > 0


def test_several_classes_and_numeric_features(spark):
    """Numeric features are binned by the entropy of all classes."""
    rows = [(i, "train" if i % 4 else "test", float(i % 37), "abc"[(i % 37) // 13], "uv"[i % 2]) for i in range(370)]
    ds = api.autoML_prep(api.Dataset(spark.createDataFrame(rows, "row_id long, dataset string, x double, label string, g string"), "label"))
    assert ds.problem_type == "multiclass"
    scored = ds.part("test").withColumn("prediction", F.when(F.col("x") < 13, "a").otherwise("b"))
    out = api.FairnessAssessor(ds, scored).analyze(["x", "g"])
    by = {(r.feature_set, r.grp): r.value for r in out["by_group"].where("metric = 'accuracy'").collect()}
    bins = {g: v for (s, g), v in by.items() if s == "x_bin"}
    assert len(bins) == 3 and sorted(bins.values()) == [0.0, 1.0, 1.0]
    assert {r.feature_set for r in api.FairnessAssessor(ds, scored).get_all_metrics()["gaps"].collect()} == {"x_bin"}


def test_injected_classifier(ds):
    from pyspark.ml.classification import LogisticRegression

    s = api.DataSummary(ds, {"g": "cat", "label": "cat", "kind": "cat"}, api.Settings(cv_folds=2), classifier=LogisticRegression(featuresCol="_features", labelCol="_label"))
    found = s.quality_issue_detection(("label",))["label_issues"]
    assert found.count() == 240 and found.where("is_issue").count() < 30


def test_plots_and_export(ds):
    s = api.DataSummary(ds, {"g": "cat", "label": "cat", "kind": "cat"})
    s.static_profiling()
    s.detect_corr_data_leakage()
    assert {r.statistic for r in s.statistics_plot(["x"]).collect()} >= {"mean", "std", "skewness"}
    shares = {}
    for r in s.category_plot("g").collect():
        shares[r.split] = shares.get(r.split, 0) + r.share
    assert all(abs(v - 1) < 1e-9 for v in shares.values())
    assert s.correlation_plot().where("x = y and value = 1").count() == 5 and s.correlation_plot().where("x = 'x' and y = 'y'").count() == 1
    out = s.export()
    assert out["feature_types"].count() == len(s.types) and {r.column for r in out["correlated_groups"].collect()} == {"x", "y"}
