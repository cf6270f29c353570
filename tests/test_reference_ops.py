import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import types as ty
from tessella.operators import assoc, automl, balance, binning, fairness, features, issues, knn, prep, profile, semantic, slices, split

NAN, INF = float("nan"), float("inf")


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0]


# --- typing --------------------------------------------------------------------------------------------------------
def test_feature_types_at_the_boundary(spark):
    df = spark.range(100).selectExpr(
        "cast(id % 2 as int) as two", "cast(id as int) as all", "cast(0 as int) as none_", "date_add(date'2020-01-01', cast(id as int)) as d", "cast(id % 2 = 0 as boolean) as b", "cast(id as decimal(10,2)) as dec"
    )
    got = ty.feature_types(df)
    assert got == {"two": "num", "all": "num", "none_": "cat", "d": "txt", "b": "txt", "dec": "num"}  # 2/100 isn't below 0.02
    assert ty.feature_types(df, ["two"], 0.021) == {"two": "cat"}
    assert ty.feature_types(df, ["two", "d"], overrides={"two": "txt", "x": "num"})["two"] == "txt"
    assert ty.feature_types(df.limit(0), ["two", "b"]) == {"two": "num", "b": "txt"}
    with pytest.raises(ValueError):
        ty.feature_types(df.withColumn("a", F.array("two")))


def test_target_types(spark):
    df = spark.range(60).selectExpr("cast(id % 2 as string) a", "cast(id % 3 as string) b", "cast(id % 19 as string) c", "cast(id % 20 as string) d", "cast(id % 3 as int) e")
    assert [ty.target_type(df, c) for c in "abcde"] == ["binary", "multiclass", "multiclass", "regression", "regression"]


# --- profile -------------------------------------------------------------------------------------------------------
def test_numeric_edges(spark):
    df = spark.createDataFrame([("a", 1.0, None, 5.0), ("a", 2.0, None, 5.0), ("a", NAN, None, 5.0), ("b", None, None, 5.0)], "s string, x double, n double, k double")
    out = {(r.s, r.column): r for r in profile.num_profile(df, ["x", "n", "k"], "s").collect()}
    assert (out["a", "x"].mean, out["a", "x"].null_count, out["a", "x"].n_unique, out["a", "x"].max) == (1.5, 1, 3, 2.0)
    assert (out["a", "n"].mean, out["a", "n"].n_unique, out["b", "x"].std) == (None, 1, None)
    assert (out["a", "k"].std, out["a", "k"].n_unique) == (0.0, 1)
    assert profile.num_profile(df.limit(0), ["x"], "s").count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 501, 12_345])
def test_nearest_quantiles(spark, n):
    values = [random.Random(n).randint(0, n) / 2 for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", None), ("a", NAN)], "s string, x double")
    got = {r.prob: r.value for r in profile.nearest_quantiles(df, ["x"], "s", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    assert got == {p: sorted(values)[math.floor((n - 1) * p + 0.5)] for p in (0.0, 0.25, 0.5, 0.75, 1.0)}


def test_texts(spark):
    df = spark.createDataFrame([("a", "One two, two! 12"), ("a", ""), ("a", None), ("a", "5"), ("a", "été b.c")], "s string, t string")
    r = one(profile.txt_profile(df, ["t"], "s"))
    assert (r.min_char_length, r.max_char_length, r.n_unique, r.null_count, r.mean_word_count) == (1, 16, 4, 1, 5 / 4)
    words = [(w.word, w["count"]) for w in profile.top_words(df, ["t"], "s", 3).orderBy("rank").collect()]
    assert words == [("two", 2), ("b.c", 1), ("one", 1)]


def test_zero_columns(spark):
    df = spark.createDataFrame([(0, None, 0, 5, "0", 0.0), (0, None, None, 5, "0", -0.0)], "z int, n int, m int, k int, s string, d double")
    assert profile.zero_columns(df) == ["z", "n", "d"] and profile.zero_columns(df.limit(0)) == []


def test_histogram_of_constant_and_infinite_values(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (INF,), (NAN,), (None,)], "x double")
    r = one(profile.histogram(df, "x", 5))
    assert (r.bin, r["count"]) == (0, 2)


@pytest.mark.parametrize(("text", "value"), [("$1,234.50", 1234.5), ("1,5", 1.5), ("12%", 12.0), ("€3", 3.0), ("1.234,5", 1234.5), ("", None), ("abc", None), ("1.234.567", 1234567.0), ("1,234", 1234.0), ("-2e3", -2000.0), (None, None)])
def test_numbers_in_strings(spark, text, value):
    assert spark.createDataFrame([(text,)], "v string").select(tx.parse_number(F.col("v"))).first()[0] == value


# --- balance -------------------------------------------------------------------------------------------------------
def test_balance_and_drift(spark):
    rows = [("train", "a", float(i)) for i in range(8)] + [("train", "b", 8.0)] + [("test", "b", 100.0), ("test", None, 100.0), ("test", "c", None)]
    df = spark.createDataFrame(rows, "dataset string, c string, x double")
    counts, num = profile.value_counts(df, ["c"], "dataset"), profile.num_profile(df, ["x"], "dataset")
    assert {(r.dataset, r.value): r.flagged for r in balance.imbalance(counts, "dataset").collect()} == {("train", "a"): True, ("train", "b"): True, ("test", "b"): False, ("test", "c"): False}
    js = one(balance.js_divergence(counts, "dataset")).js
    p, q = {"b": 0.5, "c": 0.5}, {"a": 8 / 9, "b": 1 / 9}
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in "abc"}
    assert js == pytest.approx(sum(v * math.log(v / m[k]) for d in (p, q) for k, v in d.items()) / 2)
    assert one(balance.mean_drift(num, "dataset")).drift == pytest.approx((100 - 4) / (math.sqrt(7.5) + 1e-8))
    same = profile.value_counts(spark.createDataFrame([("train", "a"), ("test", "a")], "dataset string, c string"), ["c"], "dataset")
    assert one(balance.js_divergence(same, "dataset")).js == 0
    assert {r.check for r in balance.evaluate(num, counts, "dataset").where("flagged").collect()} >= {"mean_drift", "js_divergence", "imbalanced_categories"}


# --- associations --------------------------------------------------------------------------------------------------
def test_associations(spark):
    df = spark.createDataFrame([(str(i % 3), str(i % 3 * 2), "k", float(i % 3), i % 7 * 1.0) for i in range(42)], "a string, b string, k string, x double, y double")
    v = {(r.col_a, r.col_b): r.value for r in assoc.cramers_v(df, ["a", "b", "k"]).collect()}
    assert v["a", "b"] == pytest.approx(1.0) and v["a", "k"] is None
    e = {(r.col_a, r.col_b): r.value for r in assoc.correlation_ratio(df, ["a", "k"], ["x", "y"]).collect()}
    assert e["a", "x"] == pytest.approx(1.0) and e["a", "y"] == pytest.approx(0.0, abs=1e-7) and e["k", "x"] == pytest.approx(0.0, abs=1e-7)
    assert one(assoc.pearson(df.withColumn("c", F.lit(3)), ["c", "x"])).value is None
    assert assoc.association(df.limit(0), {"a": "cat", "b": "cat", "x": "num"}).where("value is not null").count() == 0


def test_groups_are_stars(spark):
    m = spark.createDataFrame([("a", "b", 0.99), ("b", "c", -0.99), ("a", "c", 0.1), ("c", "d", None)], "col_a string, col_b string, value double")
    assert assoc.correlated_groups(m, list("abcd")) == [("a", "b"), ("b", "c")]
    assert assoc.correlated_groups(m, list("bacd")) == [("a", "b", "c")]


# --- features ------------------------------------------------------------------------------------------------------
def test_simple_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "b", "t"), (2, 2.0, "b", None), (3, NAN, "a", "t"), (4, None, "a", "t"), (5, 9.0, None, "t")], "row_id int, x double, c string, t string")
    out = {r.row_id: r for r in features.impute_simple(df, ["x"], ["c"], ["t"]).collect()}
    assert (out[3].x, out[4].x, out[5].c, out[2].t) == (2.0, 2.0, "a", "Unknown text")
    assert [out[i].was_imputed for i in range(1, 6)] == [False, True, True, True, True]
    assert features.medians(df.where("x < 5 and not isnan(x)"), ["x"]) == {"x": 1.5} and features.medians(df.limit(0), ["x"]) == {"x": None}


def test_text_vectors_and_encoding(spark):
    df = spark.createDataFrame([(i, ["soil dry", "plot wet", None, ""][i % 4]) for i in range(20)], "row_id int, t string")
    out = features.text_vectors(df, "t", max_dim=3, buckets=32)
    assert out.count() == 20 and {"t_0"} <= set(out.columns)
    own = features.text_vectors(df, "t", max_dim=2, embed=lambda texts: [[len(t), 1.0, t.count("o")] for t in texts])
    assert 1 <= len(own.columns) - 2 <= 2
    assert {(r.t, r.code) for r in features.label_encode(df, "t", "code").collect()} == {(None, None), ("", 0), ("plot wet", 1), ("soil dry", 2)}


# --- neighbours and issues -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_against_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "BLOCK", 13)
    monkeypatch.setattr(knn, "CHUNK", 11)
    rng = random.Random(4)
    pts = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(60)}
    pts[60] = list(pts[5])
    df = spark.createDataFrame([*pts.items(), (900, None), (901, [NAN, 1.0, 1.0]), (902, [1.0])], "id long, v array<double>")

    def dist(a, b):
        if metric == "euclidean":
            return math.dist(a, b)
        return 1 - sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)

    got = {}
    for r in knn.knn_edges(df, df, "id", "v", 4, metric).collect():
        got.setdefault(r.src_id, {})[r.rank] = (r.dst_id, r.dist)
    assert set(got) == set(pts)
    for i in pts:
        want = sorted((round(dist(pts[i], pts[j]), 9), j) for j in pts if j != i)[:4]
        assert [got[i][k][0] for k in range(1, 5)] == [j for _, j in want]
    assert knn.knn_edges(df.limit(0), df.limit(0), "id", "v").count() == 0


def test_outliers_and_duplicates(spark):
    pts = [(i, [float(i % 10), float(i // 10)]) for i in range(100)] + [(100, [500.0, 500.0]), (101, [0.01, 0.0])]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    edges = knn.knn_edges(df, df, "id", "v", 5)
    assert [r.row_id for r in issues.outliers(edges).where("is_outlier").collect()] == [100]
    assert [(r.a, r.b) for r in issues.near_duplicate_pairs(edges).collect()] == [(0, 101)]


def test_duplicate_removal_equals_the_greedy_scan(spark):
    rng = random.Random(6)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)}
    keep, gone = set(), set()
    for a, b in sorted(pairs):
        if a in keep:
            gone.add(b)
        elif b in keep:
            gone.add(a)
        else:
            keep.add(a)
            gone.add(b)
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs], "a long, b long")
    assert {r.row_id for r in issues.removed_by_duplicates(df).collect()} == gone


def test_cleaning(spark):
    df = spark.createDataFrame([(i, "train" if i < 3 else "test", "x") for i in range(5)], "row_id long, dataset string, label string")
    fix = spark.createDataFrame([(0, True, "y"), (0, True, "y"), (1, False, "y"), (4, None, "y")], "row_id long, is_issue boolean, predicted_label string")
    pairs = spark.createDataFrame([(0, 2), (0, 3), (None, 1)], "a long, b long")
    out = issues.clean(df, "row_id", outlier_ids=df.where("row_id = 1").select("row_id"), pairs=pairs.where("a is not null"), relabel=fix, target="label")
    assert sorted((r.row_id, r.label) for r in out.collect()) == [(0, "y"), (4, "x")]
    only = issues.clean(df, "row_id", pairs=pairs.where("a is not null"), splits=("dataset", "", ["train"]))
    assert sorted(r.row_id for r in only.collect()) == [0, 1, 3, 4]


def test_confident_learning(spark):
    rows = [(1, "a", [0.9, 0.1]), (2, "a", [0.2, 0.8]), (3, "b", [0.1, 0.9]), (4, "b", [0.3, 0.7]), (5, None, [0.5, 0.5]), (6, "a", None), (7, "zz", [0.5, 0.5])]
    df = spark.createDataFrame(rows, "row_id long, label string, p array<double>")
    out = {r.row_id: r for r in issues.confident_learning(df, "row_id", "label", ["a", "b"], "p").collect()}
    assert set(out) == {1, 2, 3, 4} and [out[i].is_issue for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert (out[2].score, out[2].predicted_label) == (0.2, "b")


# --- splits and preparation ----------------------------------------------------------------------------------------
def test_stratified_split(spark):
    df = spark.range(1000).selectExpr("id as row_id", "if(id % 100 = 0, null, cast(id % 3 as string)) as label")
    out = split.stratified_split(df, "row_id", "label")
    sizes = {(r.label, r.dataset): r["count"] for r in out.groupBy("label", "dataset").count().collect()}
    for label in (None, "0", "1", "2"):
        n = sizes[label, "train"] + sizes[label, "test"]
        assert sizes[label, "train"] == math.ceil(0.8 * n)
    again = split.stratified_split(df.repartition(7), "row_id", "label")
    assert out.select("row_id", "dataset").exceptAll(again.select("row_id", "dataset")).count() == 0


def test_row_index_and_samples(spark):
    df = spark.range(50).selectExpr("id * 7 % 50 as row_id", "if(id % 2 = 0, 'a', 'b') as s", "cast(id as double) as x", "cast(id % 4 as string) as c")
    out = split.row_index(df, "row_id", "s")
    for s in "ab":
        rows = sorted((r.row_id, r.new_id) for r in out.where(F.col("s") == s).collect())
        assert [i for _, i in rows] == list(range(25))
    assert split.sample_values(df, "x", "num", 8, key="row_id").count() == 8 and split.sample_values(df, "x", "num", 500, key="row_id").count() == 55
    assert [r.value for r in split.sample_values(df, "c", "cat", 2, key="row_id").collect()] == ["0", "1"]


def test_alignment(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), spark.createDataFrame([(1, 2)], "y int, x int")
    assert prep.align({"train": a, "test": b})["train"].columns == ["x", "y"]
    with pytest.raises(ValueError):
        prep.align({"train": a, "test": b}, strict=True)
    with pytest.raises(ValueError):
        prep.merge_splits({})
    assert sorted(prep.merge_splits({"train": a, "test": b}).select("x", "z").collect()) [0].x in (1, 2)


def test_prepare_and_model(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        rows.append((i, "val" if i % 10 == 0 else "train", f"{x:.3f}".replace(".", ","), rng.choice(["u", "v", None]), "yes" if x > 0.8 else "no"))
    df = spark.createDataFrame([*rows, (1000, "train", "1,0", "u", None)], "row_id long, dataset string, x string, g string, label string")
    ds = prep.prepare(prep.Dataset(df, "label"))
    assert (ds.problem_type, ds.pos_label, dict(ds.df.dtypes)["x"], ds.df.count()) == ("binary", "yes", "double", 400)
    model = automl.TabularModel("label", "binary", "medium").fit(ds.part("train"), families=(0, 1))
    out = model.transform(ds.part("test"))
    assert out.where("prediction = label").count() / out.count() > 0.9 and len(out.first().probability) == 2
    assert model.importance(spark).first().feature == "x" and model.feature_space(ds.part("test")).count() == out.count()
    cv = automl.cross_validated(ds.part("train"), "row_id", "label", "binary", k=2)
    assert cv.count() == ds.part("train").count()
    with pytest.raises(ValueError):
        automl.TabularModel("label", "timeseries")


def test_synthesis(spark):
    df = spark.range(1, 60).selectExpr("cast(id as double) as a", "cast(id * id % 17 as double) as b").withColumn("t", F.col("a") * F.col("b"))
    _, best = automl.synthesise(df, "t", ["a", "b"], n=1)
    assert best == ["a*b"]


# --- assessment ----------------------------------------------------------------------------------------------------
def brute_binary(ys, ps):
    tp = sum(y and p for y, p in zip(ys, ps))
    fp = sum((not y) and p for y, p in zip(ys, ps))
    tn = sum((not y) and (not p) for y, p in zip(ys, ps))
    fn = sum(y and (not p) for y, p in zip(ys, ps))
    return tp, fp, tn, fn


def test_group_metrics(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 1), rng.choice(["a", "b", None]), i % 2) for i in range(200)] + [(1, 0, "only_positive", 0), (None, 1, "a", 0)]
    df = spark.createDataFrame(rows, "y int, p int, g string, h int")
    sets = fairness.feature_sets(["g", "h"])
    assert sets == [("g",), ("h",), ("g", "h")]
    out = {(r.feature_set, r.grp): r for r in fairness.binary_metrics(fairness.confusion(df, sets, "y", "p", 1)).collect()}
    mine = [(y, p) for y, p, g, _ in rows if g is None and y is not None]
    tp, fp, tn, fn = brute_binary(*zip(*mine))
    r = out["g", "missing"]
    assert r.tpr == pytest.approx(tp / (tp + fn)) and r.selection_rate == pytest.approx((tp + fp) / len(mine)) and r["count"] == len(mine)
    assert r.mcc == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    lone = out["g", "only_positive"]
    assert (lone.tpr, lone.tnr, lone.balanced_accuracy, lone.mcc) == (0.0, 0.0, None, 0.0)
    strict = fairness.binary_metrics(fairness.confusion(df, sets, "y", "p", 1), strict=True).where("grp = 'only_positive'").first()
    assert strict.tnr is None
    multi = {(x.feature_set, x.grp): x for x in fairness.multiclass_metrics(df, sets, "y", "p").collect()}
    for k in ("accuracy", "f1", "precision", "recall", "mcc", "balanced_accuracy"):
        assert multi["g", "missing"][k] == pytest.approx(r[k])
    assert fairness.valid_binary_labels(df, "y", "p") and not fairness.valid_binary_labels(df.withColumn("p", F.lit(2)), "y", "p")
    gap = fairness.gaps(fairness.tidy_metrics(fairness.binary_metrics(fairness.confusion(df, [("h",)], "y", "p", 1)))).where("metric = 'accuracy'").first()
    a = [out["h", str(i)].accuracy for i in (0, 1)]
    assert (gap.difference, gap.ratio) == (pytest.approx(max(a) - min(a)), pytest.approx(min(a) / max(a)))
    assert [len(fairness.feature_sets(list("abcdefghijklm")[:n])) for n in (5, 6, 8, 12, 13)] == [31, 56, 92, 78, 13]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a"), (2.0, 2.0, "a"), (4.0, 1.0, "a"), (5.0, 5.0, "b"), (None, 1.0, "b")], "y double, p double, g string")
    out = {r.grp: r for r in fairness.regression_metrics(df, [("g",)], "y", "p").collect()}
    a = out["a"]
    assert (a.mae, a.mse, a.mdae) == (pytest.approx(4 / 3), pytest.approx(10 / 3), 1.0) and a.r2 == pytest.approx(1 - 10 / 8) and a.mape > 1e14
    assert out["b"].r2 is None


def test_feature_choice_and_loss(spark):
    types = {"a": "num", "b": "cat", "c": "cat"}
    assert fairness.choose_features(types, "cat") == ["b", "c"] and fairness.choose_features(types, "sens", ["c"]) == ["c"]
    assert fairness.choose_features(types, "intrest", interest=["a"]) == ["a"] and fairness.choose_features(types, "what") == ["b"] and fairness.choose_features(types, ["a", "zz"]) == ["a"]
    got = spark.createDataFrame([(1, 1.0), (1, 0.0), (0, 0.25)], "y int, p double").select(fairness.log_loss(F.col("y"), F.col("p"))).collect()
    assert [r[0] for r in got] == [pytest.approx(1e-15, abs=1e-15), pytest.approx(34.538776, abs=1e-3), pytest.approx(-math.log(0.75))]


def test_slices_against_full_enumeration(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a, b, c = rng.choice("xyz"), rng.choice("pq"), rng.choice(["m", None])
        rows.append((a, b, c, 5.0 if (a, b) == ("x", "p") else rng.random()))
    df = spark.createDataFrame(rows, "a string, b string, c string, e double")
    best = one(slices.find_slices(df, ["a", "b", "c"], "e", max_level=3))
    assert best.slice == "a=x & b=p"
    assert slices.find_slices(df.limit(0), ["a"], "e").count() == 0


def test_binning(spark):
    df = spark.createDataFrame([(float(i), "abcd"[i % 4], 1 if 30 <= i < 60 else 0) for i in range(100)] + [(None, None, 1)], "x double, c string, y int")
    b = binning.fit_bins(df, "x", "y", 1)
    assert 2 <= len(b.cuts) <= 4 and abs(b.cuts[0] - 30) <= 2 and abs(b.cuts[-1] - 60) <= 2
    out = binning.bin_columns(df, [b, binning.fit_bins(df, "c", "y", 1)])
    assert out.where("x is null").first().x_bin is None and out.where("x is not null and x_bin is null").count() == 0
    assert binning.fit_bins(df.where("x = 1"), "x", "y", 1) is None and binning.fit_bins(df, "x", "y", None) is not None


# --- naming --------------------------------------------------------------------------------------------------------
def test_semantic_types(spark):
    df = spark.createDataFrame([(i, f"a{i}@b.org", f"2024-01-{i + 1:02d}", f"AB-{i:04d}") for i in range(12)], "row_id long, m string, d string, k string")
    out = {r["column"]: r.semantic_type for r in semantic.semantic_types(df, {"row_id": "num", "m": "txt", "d": "txt", "k": "txt"}, "row_id").collect()}
    assert out == {"row_id": "identifier", "m": "email", "d": "date", "k": "code"}
    assert semantic.parse_names("a: b: c\nnothing\n d :e") == {"a": "b: c", "d": "e"}


def test_slices_reach_all_features_by_default(spark):
    rows = [(i, f"a{i % 2}", f"b{i // 2 % 2}", f"c{i // 4 % 2}", 10.0 if i % 8 == 0 else 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string, e double")
    best = one(slices.find_slices(df, ["a", "b", "c"], "e"))
    assert (best.slice, best.level, best.n) == ("a=a0 & b=b0 & c=c0", 3, 10)


@pytest.mark.parametrize(("column", "kind", "samples", "name"), [
    ("x", "txt", ["10.0.0.1", "192.168.1.20"], "ip address"), ("x", "txt", ["2024-01-02 10:11:12", "2024-01-02T10:11:12Z"], "timestamp"), ("x", "cat", ["yes", "no", "No"], "boolean"),
    ("x", "txt", ["12 cm", "3.5 kg"], "measurement"), ("x", "txt", ["18-25", "26-40", "65+"], "range"), ("x", "txt", ["€ 3,50", "12 EUR"], "currency"), ("x", "txt", ["a sentence here"], "text"),
    ("birthYear", "num", ["1980.0", "1999.0"], "year"), ("p", "num", ["0.2", "0.9"], "proportion"), ("b", "num", ["0", "1"], "flag"), ("sale_price", "num", ["3", "9"], "price"), ("e", "txt", [], "text"),
    ("m", "txt", ["a@b.org"] * 19 + ["none"], "email"),
])
def test_names_by_rules(column, kind, samples, name):
    assert semantic.name_by_rules(column, kind, samples) == name


def test_grouped_medians(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, *[rng.gauss(0, 1) for _ in range(5)]])) for _ in range(3000)] + [("lone", 1, 4.0), ("empty", 1, None)]
    held = {}
    for g, h, v in rows:
        if v is not None:
            held.setdefault((g, h), []).append(v)
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r.g, r.h): r["median"] for r in features.grouped_medians(df, ["g", "h"], "v").collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in held.items()})


def test_ranks_over_ranges_and_folds(spark):
    df = spark.range(500).selectExpr("id as row_id", "if(id % 10 = 0, null, if(id % 3 = 0, 'hot', 'b')) as label", "1 as _p")
    ranks = split.ranked(df, [F.col("label")], [-F.col("row_id")]).collect()
    for label in (None, "hot", "b"):
        mine = sorted((r._rank, r.row_id) for r in ranks if r.label == label)
        assert [i for i, _ in mine] == list(range(1, len(mine) + 1)) and [k for _, k in mine] == sorted((k for _, k in mine), reverse=True)
        assert {r._size for r in ranks if r.label == label} == {len(mine)}
    sizes = {}
    for r in split.folds(df, "row_id", 5, target="label").collect():
        sizes.setdefault(r.label, {}).setdefault(r.fold, 0)
        sizes[r.label][r.fold] += 1
    assert all(max(v.values()) - min(v.values()) <= 1 and len(v) == 5 for v in sizes.values())
    assert split.ranked(df.limit(0), [F.col("label")], [F.col("row_id")]).count() == 0


def test_bins_mean_the_same_in_every_frame(spark):
    df = spark.range(300).selectExpr("id as row_id", "cast(id % 30 as double) as x", "if(id % 30 < 12, 1, 0) as y")
    train, (test,) = binning.auto_bin(df.where("row_id % 2 = 0"), [df.where("row_id % 2 = 1 and x > 20")], ["x"], "y", 1)
    assert {r.x_bin for r in train.select("x_bin").distinct().collect()} >= {r.x_bin for r in test.select("x_bin").distinct().collect()}


def test_group_means_are_offered_as_features(spark):
    df = spark.range(400).selectExpr("id % 20 as g", "cast(hash(id) % 100 as double) as a").selectExpr("cast(g as string) as g", "a")
    t = df.join(df.groupBy("g").agg(F.avg("a").alias("t")), "g")
    _, best = automl.synthesise(t, "t", ["a"], ["g"], n=1)
    assert best == ["mean(a|g)"]


def test_written_tables_can_be_discarded(spark):
    from tessella import session

    session.discard(spark)
    t = session.written(spark.range(5).toDF("x"), "trial")
    assert t.count() == 5 and session.discard(spark) == 1 and session.discard(spark) == 0


@pytest.mark.parametrize("n", [499, 500, 501, 9_999, 10_000])
def test_quantiles_at_the_sizes_where_the_bounds_change(spark, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, 3 * n)) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double")
    got = {r.prob: r.value for r in profile.nearest_quantiles(df, ["x"], "g").collect()}
    values.sort()
    assert got == {p: values[math.floor((n - 1) * p + 0.5)] for p in got} and len(got) > 2
