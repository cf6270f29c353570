"""Queries of the profiling, checking, repair and assessment operators, with the SQL that checks them.

Records of ``split_rows`` are delivered more than once; everywhere a ``row_id`` counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import types as ty
from tessella.operators import assoc, automl, balance, binning, fairness, features, issues, knn, prep, profile, semantic, slices, split
from tessella.operators.summary import DataSummary, load_summary
from tessella.session import cut, fresh_path, table
from tessella.sources import io
from tessella.streaming import incremental

NUM = ["battery_v", "yield_g", "moisture"]
CAT = ["age_band", "channel", "crop"]


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_rows").drop("ingested_at").dropDuplicates(["row_id"])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _tidy_rows(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- typing --------------------------------------------------------------------------------------------------------
TYPED = ["device_id", "site_code", *CAT, "battery_v", "yield_g", "soil_c", "moisture", "note", "label"]


def feature_types(spark, d):
    return _tidy_rows(spark, list(ty.feature_types(records(spark, d), TYPED).items()), "column string, dformat string")


def feature_types_lineitem(spark, d):
    return _tidy_rows(spark, list(ty.feature_types(table(spark, d, "lineitem")).items()), "column string, dformat string")


def target_types(spark, d):
    r = records(spark, d)
    return _tidy_rows(spark, [(c, ty.target_type(r, c)) for c in ("label", "dataset", "crop", "yield_g", "moisture")], "column string, problem_type string")


# --- profiles ------------------------------------------------------------------------------------------------------
def num_profile(spark, d):
    return rounded(profile.num_profile(records(spark, d), NUM, "dataset"), 4, "mean", "std", "kurtosis", "skewness")


def num_profile_orders(spark, d):
    return rounded(profile.num_profile(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderstatus"), 3, "mean", "std", "kurtosis", "skewness")


def num_moments(spark, d):
    out = profile.num_profile(table(spark, d, "events"), ["value"], "event_type")
    return rounded(out.select("event_type", "kurtosis", "skewness", "n_unique", "null_count"), 5, "kurtosis", "skewness")


def nearest_quantiles(spark, d):
    return profile.nearest_quantiles(records(spark, d), NUM, "dataset")


def nearest_quantiles_orders(spark, d):
    return profile.nearest_quantiles(table(spark, d, "orders"), ["o_totalprice"], "o_orderstatus", (0.25, 0.5, 0.75, 0.95))


def cat_profile(spark, d):
    return profile.cat_profile(records(spark, d), CAT, "dataset")


def value_counts(spark, d):
    return profile.value_counts(records(spark, d), [*CAT, "moisture"], "dataset")


def txt_profile(spark, d):
    return rounded(profile.txt_profile(records(spark, d), ["note", "site_code"], "dataset"), 4, "mean_char_length", "std_char_length", "mean_word_count")


def top_words(spark, d):
    return profile.top_words(records(spark, d), ["note"], "dataset")


def text_columns(spark, d):
    return records(spark, d).agg(*[ty.is_text(profile.q(c)).alias(c) for c in ("note", "site_code")])


def zero_columns(spark, d):
    r = records(spark, d).select("row_id", F.lit(0).alias("z"), F.lit(None).cast("double").alias("n"), F.when(F.col("row_id") % 2 == 0, 0).alias("m"), F.lit(5).alias("k"), "crop")
    return _tidy_rows(spark, [(c,) for c in profile.zero_columns(r)], "column string")


def histogram(spark, d):
    return rounded(profile.histogram(table(spark, d, "events"), "value", 20), 4, "low", "high")


def quantile_bins(spark, d):
    return binning.quantile_bins(table(spark, d, "events"), "value", 10)


# --- balance and drift ---------------------------------------------------------------------------------------------
def shape_flags(spark, d):
    return balance.shape_flags(profile.num_profile(records(spark, d), NUM, "dataset", exact_distinct=False), "dataset")


def imbalance(spark, d):
    out = balance.imbalance(profile.value_counts(records(spark, d), [*CAT, "label"], "dataset"), "dataset")
    return rounded(out, 4, "expected")


def _by_season(spark, d):
    """Splits by value, so that there is drift to find: early rows are train, warm late ones test."""
    r = records(spark, d)
    return r.withColumn("part", F.when(F.col("moisture") < 60, "train").when(F.col("moisture") >= 60, "test")).where("part is not null")


def mean_drift(spark, d):
    out = balance.mean_drift(profile.num_profile(_by_season(spark, d), ["moisture", "battery_v"], "part", exact_distinct=False), "part")
    return rounded(out, 5, "drift")


def js_divergence(spark, d):
    return rounded(balance.js_divergence(profile.value_counts(_by_season(spark, d), CAT, "part"), "part"), 6, "js")


def js_divergence_splits(spark, d):
    return rounded(balance.js_divergence(profile.value_counts(records(spark, d), CAT, "dataset"), "dataset"), 6, "js")


def quick_balance(spark, d):
    """Columns flagged by each balance check, a column counting once."""
    return balance_report(spark, d).where("flagged").groupBy("check").agg(F.count_distinct("column").alias("columns"))


def balance_report(spark, d):
    r = records(spark, d)
    num = cut(profile.num_profile(r, NUM, "dataset", exact_distinct=False))
    counts = cut(profile.value_counts(r, CAT, "dataset"))
    return rounded(balance.evaluate(num, counts, "dataset"), 4, "value").where("flagged")


# --- associations --------------------------------------------------------------------------------------------------
def pearson(spark, d):
    return rounded(assoc.pearson(records(spark, d), ["battery_v", "yield_g", "moisture"]), 6, "value")


def pearson_part(spark, d):
    p = table(spark, d, "part").withColumn("p_double", F.col("p_retailprice") * 2 + F.col("p_size") / 100)
    return rounded(assoc.pearson(p, ["p_partkey", "p_retailprice", "p_size", "p_double"]), 6, "value")


def correlation_ratio(spark, d):
    return rounded(assoc.correlation_ratio(records(spark, d), CAT, ["moisture", "yield_g"]), 6, "value")


def cramers_v(spark, d):
    return rounded(assoc.cramers_v(records(spark, d), ["age_band", "channel", "label", "dataset"]), 6, "value").drop("chi2")


def association(spark, d):
    r = records(spark, d)
    return rounded(assoc.association(r, {"age_band": "cat", "channel": "cat", "yield_g": "num", "moisture": "num", "note": "txt"}), 6, "value")


def correlated_groups(spark, d):
    p = table(spark, d, "part").withColumn("p_double", F.col("p_retailprice") * 2 + F.col("p_size") / 100)
    names = ["p_partkey", "p_retailprice", "p_size", "p_double"]
    groups = assoc.correlated_groups(assoc.pearson(p, names), names)
    return _tidy_rows(spark, [("+".join(g),) for g in groups], "members string")


def top_correlations(spark, d):
    m = assoc.association(records(spark, d), {"age_band": "cat", "channel": "cat", "crop": "cat", "moisture": "num", "yield_g": "num"})
    return rounded(assoc.top_correlations(m, "moisture", 3), 6, "value")


# --- imputation and encoding ---------------------------------------------------------------------------------------
def impute_simple(spark, d):
    out = features.impute_simple(records(spark, d), ["battery_v", "moisture"], ["channel"], ["note"])
    return out.select("row_id", "battery_v", "moisture", "channel", F.length("note").alias("note_chars"), "was_imputed")


def was_imputed(spark, d):
    return records(spark, d).select("row_id", features.was_imputed([profile.q(c) for c in (*CAT, "moisture", "label")]).alias("was_imputed"))


def standardise(spark, d):
    out = features.standardise(table(spark, d, "part").withColumn("constant", F.lit(3)), ["p_retailprice", "p_size", "constant"])
    return rounded(out.select("p_partkey", "p_retailprice", "p_size", "constant"), 6, "p_retailprice", "p_size", "constant")


def label_encode(spark, d):
    return features.label_encode(records(spark, d).select("row_id", "crop"), "crop", "code").select("row_id", "code")


def text_vectors(spark, d):
    """Text components of the notes: their number, and the squared length of each row's, which doesn't depend on the
    signs of the components."""
    out = features.text_vectors(records(spark, d).select("row_id", "note"), "note")
    names = [c for c in out.columns if c.startswith("note_")]
    length = sum((profile.q(c) * profile.q(c) for c in names[1:]), profile.q(names[0]) * profile.q(names[0])) if names else F.lit(0.0)
    return out.select("row_id", F.lit(len(names)).alias("dims"), F.round(length, 6).alias("squared_length"))


# --- quality issues ------------------------------------------------------------------------------------------------
def near_dup_exact(spark, d):
    docs = table(spark, d, "documents").where("text is not null and text <> ''")
    return docs.groupBy(F.xxhash64("text"), F.xxhash64("text", F.lit(3))).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("doc_id", "copies")


def _edges(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return cut(knn.knn_edges(e, e, "vec_id", "embedding", k))  # read twice: for the median, and against it


def knn_edges(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(knn.knn_edges(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10), 5, "dist")


def knn_edges_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(knn.knn_edges(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, "cosine"), 5, "dist")


def outliers(spark, d):
    """At a threshold at which some are found."""
    return rounded(issues.outliers(_edges(spark, d), 0.97), 4, "mean_dist", "score")


def near_duplicates(spark, d):
    """At a threshold at which some are found."""
    return issues.near_duplicate_pairs(_edges(spark, d), 1.0)


def outliers_default(spark, d):
    """At the default threshold."""
    return rounded(issues.outliers(_edges(spark, d)), 4, "mean_dist", "score")


def near_duplicates_default(spark, d):
    """At the default threshold."""
    return issues.near_duplicate_pairs(_edges(spark, d))


def detect_and_repair(spark, d):
    """From neighbours to the rows that are left: issues found at the default thresholds are taken out."""
    edges = _edges(spark, d)
    bad = issues.outliers(edges).where("is_outlier")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return issues.clean(rows, "row_id", outlier_ids=bad, pairs=issues.near_duplicate_pairs(edges))


def _reported_pairs(spark, d):
    p = table(spark, d, "near_duplicates_issues").where("row_id is not null and near_dup_id is not null and row_id <> near_dup_id")
    a, b = F.col("row_id") < F.col("near_dup_id"), F.lit(True)
    return p.select(
        F.least("row_id", "near_dup_id").alias("a"), F.greatest("row_id", "near_dup_id").alias("b"),
        F.when(a, F.col("dataset")).otherwise(F.col("near_dup_dataset")).alias("split_a"), F.when(a & b, F.col("near_dup_dataset")).otherwise(F.col("dataset")).alias("split_b"),
    ).distinct()


def dedup_removal(spark, d):
    return issues.removed_by_duplicates(_reported_pairs(spark, d))


def duplicate_counts(spark, d):
    return issues.duplicate_counts(_reported_pairs(spark, d).where("split_a is not null and split_b is not null"))


def duplicate_sets(spark, d):
    out = issues.duplicate_sets(_reported_pairs(spark, d))
    return out.select("row_id", F.array_join("near_duplicates", ",").alias("near_duplicates"))


def cleaned_rows(spark, d):
    qi = table(spark, d, "quality_issues")
    fix = qi.select("row_id", F.col("label_issue_mask").alias("is_issue"), "predicted_label")
    out = issues.clean(records(spark, d), "row_id", outlier_ids=qi.where("outlier_mask"), pairs=_reported_pairs(spark, d), relabel=fix, target="label")
    return out.select("row_id", "dataset", "label")


def issue_counts(spark, d):
    return table(spark, d, "quality_issues").groupBy("dataset").agg(F.count_if("outlier_mask").alias("outliers"), F.count_if("label_issue_mask").alias("label_issues"), F.count_if("was_imputed").alias("imputed"))


CLASSES = ["diseased", "healthy", "stressed"]


def _with_probs(spark, d):
    """Probabilities by a fixed formula of the row: the reported score on the given label, the rest shared out."""
    qi = table(spark, d, "quality_issues").where("original_label is not null and label_score is not null")
    given = F.array(*[F.when(F.col("original_label") == c, F.col("label_score")).otherwise((1 - F.col("label_score")) * (F.lit(0.7) if i == 1 else F.lit(0.3) if i == 0 else F.lit(0.5))) for i, c in enumerate(CLASSES)])
    return qi.select("row_id", "original_label", given.alias("p"))


def confident_learning(spark, d):
    return rounded(issues.confident_learning(_with_probs(spark, d), "row_id", "original_label", CLASSES, "p"), 6, "score")


def residual_issues(spark, d):
    x = records(spark, d).where("yield_g is not null and not isnan(yield_g) and moisture is not null").select("row_id", "yield_g", (F.col("moisture") * 4.0).alias("guess"))
    return rounded(issues.residual_issues(x, "row_id", "yield_g", "guess"), 5, "score").where("is_issue").select("row_id", "score")


def label_issues_cv(spark, d):
    """Confident learning on out-of-fold probabilities of a trained classifier."""
    x = records(spark, d).where("label is not null").select("row_id", "dataset", "label", *CAT, *NUM)
    names = sorted(r[0] for r in x.select("label").distinct().collect())
    p = automl.cross_validated(x, "row_id", "label", "multiclass")
    return rounded(issues.confident_learning(p, "row_id", "label", names, "probability"), 6, "score")


# --- the summary of a dataset, and what is saved of it -------------------------------------------------------------
def _summary(spark, d):
    r = records(spark, d).select("row_id", "dataset", "label", *CAT, *NUM, "note")
    return DataSummary(prep.Dataset(r, "label"), {c: "cat" for c in ("label", *CAT)} | {c: "num" for c in NUM} | {"note": "txt"})


def summary_statistics(spark, d):
    """The numeric part of a summary's statistics."""
    return rounded(_summary(spark, d).static_profiling()["profile_num"], 4, "mean", "std", "kurtosis", "skewness")


def summary_reloaded(spark, d):
    """Value counts of a summary that was saved and loaded again."""
    s = _summary(spark, d)
    s.tables = {"value_counts": s.static_profiling()["value_counts"]}
    path = fresh_path(spark, "summary")
    s.save(path)
    return load_summary(s.ds, path).tables["value_counts"].where(F.col("column") != "label")


def splits_reloaded(spark, d):
    """Splits saved as one partitioned table and loaded again by name."""
    r = records(spark, d).select("row_id", "dataset", "crop", "moisture")
    path = fresh_path(spark, "splits")
    io.save_splits({s: r.where(F.col("dataset") == s).drop("dataset") for s in ("train", "val", "test")}, path)
    held = io.load_splits(spark, path)
    return held["train"].select("row_id", F.lit("train").alias("dataset"), "crop", "moisture").unionByName(held["test"].select("row_id", F.lit("test").alias("dataset"), "crop", "moisture"))


def csv_files(spark, d):
    """Files by suffix as one frame, types inferred; notes with line breaks, commas and quotes stay whole."""
    r = records(spark, d).where("note is not null and note <> ''").select("row_id", "battery_v", F.concat("note", F.lit(' said "so",\nthen')).alias("note"))
    path = fresh_path(spark, "files")
    r.where("battery_v is not null and not isnan(battery_v)").write.option("header", True).options(escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/a.csv")
    return io.load_files(spark, [f"{path}/a.csv", f"{path}/other.docx"])


# --- splitting and preparation -------------------------------------------------------------------------------------
def split_80_20_stratified(spark, d):
    r = records(spark, d).select("row_id", "label")
    return split.stratified_split(r, "row_id", "label", order=F.col("row_id")).select("row_id", "dataset")


def split_hashed(spark, d):
    r = split.stratified_split(records(spark, d).select("row_id", "label"), "row_id", "label")
    return r.groupBy("label", "dataset").agg(F.count(F.lit(1)).alias("n"))


def fold_sizes(spark, d):
    """Rows by class and fold of the folds dealt within each class."""
    out = split.folds(records(spark, d).select("row_id", "label"), "row_id", target="label")
    return out.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def prepared_rows(spark, d):
    """Rows ready for modelling: validation folded into train, rows without a usable target dropped."""
    ds = prep.prepare(prep.Dataset(records(spark, d).select("row_id", "dataset", "label", "crop", "moisture"), "label"))
    return ds.df.select("row_id", "dataset", "label", "crop", "moisture")


def row_index(spark, d):
    return split.row_index(records(spark, d).select("row_id", "dataset"), "row_id", "dataset").select("row_id", "dataset", F.col("new_id").cast("bigint").alias("new_id"))


def union_splits(spark, d):
    r = records(spark, d)
    parts = {s: r.where(F.col("dataset") == s).select("row_id", "label", *([] if s == "test" else ["crop"])) for s in ("train", "val", "test")}
    merged = prep.merge_splits(prep.align(parts))
    return split.fold_validation(merged).groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


def numeric_coercion(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("€"), (k % 900 + 100).cast("string"), F.lit(",50")).alias("comma"), F.concat(F.lit("$1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".25")).alias("grouped"),
        F.when(k % 5 != 0, F.concat((k % 7).cast("string"), F.lit(" %"))).alias("sparse"), F.concat(F.lit("no "), k.cast("string")).alias("words"),
    )
    good = prep.numeric_strings(x, ["comma", "grouped", "sparse", "words"])
    return prep.coerce_numbers(x, good).select("o_orderkey", "comma", "grouped", "sparse", "words")


def usable_targets(spark, d):
    r = records(spark, d)
    return r.where(prep.usable_target(r, "soil_c")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def clean_texts(spark, d):
    return records(spark, d).select("row_id", tx.clean_text(F.col("note")).alias("note"))


# --- assessment ----------------------------------------------------------------------------------------------------
def _predictions(spark, d):
    qi = table(spark, d, "quality_issues").select("row_id", F.col("original_label").alias("y"), F.col("predicted_label").alias("pred"), F.col("label_score").alias("score"))
    return qi.join(records(spark, d).select("row_id", *CAT, "dataset", "yield_g", "moisture"), "row_id")


GROUPS = [("age_band",), ("channel",)]


def confusion_by_group(spark, d):
    return fairness.confusion(_predictions(spark, d), GROUPS, "y", "pred", "healthy")


METRICS = ("accuracy", "balanced_accuracy", "f1", "precision", "recall", "selection_rate", "tpr", "tnr", "fpr", "fnr", "mcc")


def metrics_by_group(spark, d):
    return rounded(fairness.binary_metrics(confusion_by_group(spark, d)), 6, *METRICS)


def metric_gaps(spark, d):
    return rounded(fairness.gaps(fairness.tidy_metrics(fairness.binary_metrics(confusion_by_group(spark, d)))), 6, "difference", "ratio").where("metric <> 'count'")


def fairness_gaps(spark, d):
    out = fairness.fairness(confusion_by_group(spark, d))
    return rounded(out, 6, *[c for c in out.columns if c != "feature_set"])


def intersectional(spark, d):
    sets = fairness.feature_sets(["age_band", "channel", "dataset"])
    out = fairness.binary_metrics(fairness.confusion(_predictions(spark, d), sets, "y", "pred", "healthy"))
    return rounded(out.select("feature_set", "grp", "count", "accuracy", "selection_rate", "tpr"), 6, "accuracy", "selection_rate", "tpr")


def multiclass_by_group(spark, d):
    out = fairness.multiclass_metrics(_predictions(spark, d), GROUPS, "y", "pred")
    return rounded(out, 6, "accuracy", "balanced_accuracy", "f1", "precision", "recall", "mcc")


def regression_metrics(spark, d):
    x = _predictions(spark, d).where("not isnan(yield_g)").withColumn("guess", F.col("moisture") * 4.0)
    out = fairness.regression_metrics(x, GROUPS, "yield_g", "guess")
    return rounded(out, 3, "mae", "mse", "rmse", "mdae", "mape", "r2")


def absolute_errors(spark, d):
    x = _predictions(spark, d).where("yield_g is not null and not isnan(yield_g) and moisture is not null")
    return x.select("row_id", F.round(fairness.absolute_error(F.col("yield_g"), F.col("moisture") * 4.0), 6).alias("error"))


def overall_metrics(spark, d):
    """The row of all groups together, for two classes."""
    return rounded(fairness.overall(_predictions(spark, d), "binary", "y", "pred", "healthy"), 6, "value")


def compared_runs(spark, d):
    """Overall metrics of the reported predictions beside those of the reported labels themselves."""
    x = _predictions(spark, d).where("pred is not null")
    before, after = (fairness.overall(x, "binary", "y", p, "healthy") for p in ("pred", "y"))
    return rounded(fairness.compare_runs(before, after), 6, "before", "after", "change").where("metric in ('accuracy', 'tpr', 'selection_rate')")


def log_loss(spark, d):
    loss = fairness.log_loss((F.col("y") == "healthy").cast("int"), F.col("score"))
    return rounded(_predictions(spark, d).where("y is not null and score is not null").select("row_id", loss.alias("loss")), 6, "loss")


def top_slices(spark, d):
    x = _predictions(spark, d).where("y is not null and score is not null").withColumn("loss", fairness.log_loss((F.col("y") == "healthy").cast("int"), F.col("score")))
    return rounded(slices.find_slices(x, ["age_band", "channel", "crop"], "loss", k=10, min_support=20), 5, "avg_error", "score")


def supervised_bins(spark, d):
    x = _predictions(spark, d)
    bins = [binning.fit_bins(x.where("dataset = 'train'"), c, "y", "healthy") for c in ("yield_g", "moisture", "crop")]
    made = [f"{b.column}_bin" for b in bins if b is not None]
    binned = binning.bin_columns(x, bins)
    return fairness.binary_metrics(fairness.confusion(binned, [(c,) for c in made], "y", "pred", "healthy")) if made else confusion_by_group(spark, d)


# --- modelling -----------------------------------------------------------------------------------------------------
def _dataset(spark, d):
    r = records(spark, d).select("row_id", "dataset", "label", "age_band", "channel", "crop", *NUM)
    r = r.withColumn("label", F.when(F.col("label") == "healthy", "healthy").when(F.col("label").isNotNull(), "other"))
    return prep.prepare(prep.Dataset(r, "label", sensitive_features=("age_band",)))


def model_assessment(spark, d):
    """Prepare, train, predict on test, and assess by group."""
    ds = _dataset(spark, d)
    model = automl.TabularModel(ds.target, ds.problem_type, "medium").fit(ds.part("train"), families=(0, 1))
    scored = model.transform(ds.part("test"))
    conf = fairness.confusion(scored, [("age_band",), ("channel",)], "label", "prediction", ds.pos_label)
    return rounded(fairness.binary_metrics(conf).select("feature_set", "grp", "count", "accuracy", "tpr", "fpr"), 6, "accuracy", "tpr", "fpr")


def feature_importance(spark, d):
    ds = _dataset(spark, d)
    return automl.TabularModel(ds.target, ds.problem_type, "medium").fit(ds.part("train"), families=(1,)).importance(spark)


def feature_synthesis(spark, d):
    x = table(spark, d, "part").withColumn("t", F.col("p_retailprice") * F.col("p_size"))
    out, best = automl.synthesise(x, "t", ["p_retailprice", "p_size", "p_partkey"], ["p_brand"], 3)
    return out.select("p_partkey", *[profile.q(b) for b in best])


def best_feature(spark, d):
    """The crossed feature that follows a product best is the product."""
    x = table(spark, d, "part").withColumn("t", F.col("p_retailprice") * F.col("p_size"))
    out, best = automl.synthesise(x, "t", ["p_retailprice", "p_size", "p_partkey"], ["p_brand"], 1)
    return out.select("p_partkey", F.lit(best[0]).alias("feature"), F.round(profile.q(best[0]), 4).alias("value"))


def semantic_types(spark, d):
    r = records(spark, d)
    return semantic.semantic_types(r, {c: t for c, t in ty.feature_types(r, TYPED).items()}, "row_id")


def windowed_events(spark, d):
    out = incremental.windowed_profile(table(spark, d, "events"), "ts", "event_type", "value", window="1 day")
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), 5, "mean", "std")


QUERIES = {f.__name__: f for f in (
    feature_types, feature_types_lineitem, target_types, num_profile, num_profile_orders, num_moments, nearest_quantiles, nearest_quantiles_orders, cat_profile,
    value_counts, txt_profile, top_words, text_columns, zero_columns, histogram, quantile_bins, shape_flags, imbalance, mean_drift, js_divergence, js_divergence_splits,
    balance_report, quick_balance, pearson, pearson_part, correlation_ratio, cramers_v, association, correlated_groups, top_correlations, impute_simple, was_imputed, standardise,
    label_encode, text_vectors, near_dup_exact, knn_edges, knn_edges_cosine, outliers, near_duplicates, dedup_removal, duplicate_counts, duplicate_sets, cleaned_rows,
    outliers_default, near_duplicates_default, detect_and_repair, issue_counts, confident_learning, residual_issues, label_issues_cv, summary_statistics, summary_reloaded, splits_reloaded, csv_files, split_80_20_stratified, split_hashed, fold_sizes, prepared_rows, row_index, union_splits, numeric_coercion, usable_targets,
    clean_texts, confusion_by_group, metrics_by_group, metric_gaps, fairness_gaps, intersectional, multiclass_by_group, regression_metrics, absolute_errors, overall_metrics, compared_runs, log_loss, top_slices,
    supervised_bins, model_assessment, feature_importance, feature_synthesis, best_feature, semantic_types, windowed_events,
)}
