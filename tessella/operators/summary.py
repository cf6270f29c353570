"""The whole profile of a dataset: statistics, leakage, issues, names, balance, repair and reports.

Steps are lazy; what several steps read (types, statistics, neighbours) is made once. Results are tidy tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.types import feature_types
from tessella.operators import assoc, automl, balance, features, issues, knn, profile, semantic
from tessella.operators.prep import Dataset, check_target
from tessella.session import cut
from tessella.sources import io


@dataclass(frozen=True)
class Settings:
    """Thresholds with their defaults."""

    cat_thres: float = 0.02
    cv_folds: int = 5
    max_txt_emb_dim_per_col: int = 50
    knn_metric: str = "euclidean"
    knn_neighbors: int = 10
    high_corr_thr: float = 0.95
    semantic_acc: str = "low"
    skewness: float = 1.0
    kurtosis: float = 3.0
    imbalance_absolute: float = 0.2
    imbalance_relative: float = 1.0
    mean_z: float = 1.0
    js: float = 0.2


Neighbours = Callable[[DataFrame, str, str, int, str], DataFrame]


def exact_neighbours(df: DataFrame, key: str, vec: str, k: int, metric: str) -> DataFrame:
    return knn.knn_edges(df, df, key, vec, k, metric)


@dataclass
class DataSummary:
    """``neighbours`` gives the graph (src_id, dst_id, rank, dist); the default is exact and quadratic, so large
    collections plug in an index. ``pred_probs`` (key, probability array) replaces the cross-validated classifier, ``classifier``
    its estimator (one of Spark ML, see ``TabularModel``).
    Column ``dataset`` of the frame names the splits; row identity is the dataset's key."""

    ds: Dataset
    types: dict[str, str] = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    neighbours: Neighbours = exact_neighbours
    namer: Callable[[str, str, list[str]], str] = semantic.name_by_rules
    embed: Callable | None = None
    pred_probs: DataFrame | None = None
    classifier: object | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    groups: list[tuple[str, ...]] = field(default_factory=list)

    def __post_init__(self):
        check_target(self.ds.df, self.ds.target)
        self.columns = [c for c in self.ds.df.columns if c not in (self.ds.key, self.ds.split)]
        self.types = feature_types(self.ds.df, self.columns, self.settings.cat_thres, self.types)

    def of(self, kind: str, target: bool = True) -> list[str]:
        return [c for c, t in self.types.items() if t == kind and (target or c != self.ds.target)]

    # --- steps -------------------------------------------------------------------------------------------------
    def static_profiling(self) -> dict[str, DataFrame]:
        """Numeric, categorical and text statistics, value counts and top words per split."""
        df, by, t = self.ds.df, self.ds.split, self.tables
        num, cat, txt = self.of("num"), self.of("cat"), self.of("txt")
        if num:
            t["profile_num"] = cut(profile.num_profile(df, num, by))
            t["quantiles"] = profile.nearest_quantiles(df, num, by)
        if cat:
            t["value_counts"] = cut(profile.value_counts(df, cat, by))
            t["profile_cat"] = profile.distinct_counts(t["value_counts"], by)
        if txt:
            t["profile_txt"] = profile.txt_profile(df, txt, by)
            t["top_words"] = profile.top_words(df, txt, by)
        return t

    def detect_corr_data_leakage(self) -> DataFrame:
        """Association matrix of the training split and its star groups of high correlation."""
        train = self.ds.part("train")
        self.tables["assoc"] = cut(assoc.association(train, self.types))
        self.groups = assoc.correlated_groups(self.tables["assoc"], self.of("num") + self.of("cat"), self.settings.high_corr_thr)
        return self.tables["assoc"]

    def feature_matrix(self) -> DataFrame:
        """(key, split, target, was_imputed, vec): imputed, scaled, encoded features without the target."""
        ds, num, cat, txt = self.ds, self.of("num", False), self.of("cat", False), self.of("txt", False)
        x = features.impute_simple(ds.df, num, cat, txt).withColumn("was_imputed", F.col("was_imputed") | profile.q(ds.target).isNull())
        if num:
            x = features.standardise(x, num)
        parts = list(num)
        for i, c in enumerate(cat):
            x = features.label_encode(x, c, f"_code{i}")
            parts.append(f"_code{i}")
        for c in txt:
            before = set(x.columns)
            x = features.text_vectors(x, c, self.settings.max_txt_emb_dim_per_col, embed=self.embed)
            parts += [n for n in x.columns if n not in before]
        vec = F.array(*[F.coalesce(profile.q(p).cast("double"), F.lit(0.0)) for p in parts])
        return x.select(profile.q(ds.key), profile.q(ds.split), profile.q(ds.target), "was_imputed", vec.alias("vec"))

    def quality_issue_detection(self, issue_types: tuple[str, ...] = ("label", "outlier", "near_duplicate")) -> dict[str, DataFrame]:
        """Tables outliers, label_issues and near_duplicates (pairs with their splits)."""
        ds, t, s = self.ds, self.tables, self.settings
        x = cut(self.feature_matrix())
        ids = x.select(profile.q(ds.key).alias("row_id"), profile.q(ds.split).alias("dataset"), "was_imputed")
        if {"outlier", "near_duplicate"} & set(issue_types):
            edges = cut(self.neighbours(x, ds.key, "vec", s.knn_neighbors, s.knn_metric))
            if "outlier" in issue_types:
                t["outliers"] = issues.outliers(edges).join(ids, "row_id")
            if "near_duplicate" in issue_types:
                split_of = ids.select("row_id", "dataset")
                pairs = issues.near_duplicate_pairs(edges)
                a, b = split_of.withColumnsRenamed({"row_id": "a", "dataset": "split_a"}), split_of.withColumnsRenamed({"row_id": "b", "dataset": "split_b"})
                t["near_duplicates"] = cut(pairs.join(a, "a").join(b, "b"))
        if "label" in issue_types:
            t["label_issues"] = self._label_issues().join(ids, "row_id")
        return t

    def _label_issues(self) -> DataFrame:
        ds, kind = self.ds, self.types[self.ds.target]
        if kind == "txt":
            raise ValueError("a text target has no label issues")
        skip = (ds.key, ds.split)
        df = ds.df.drop(*[c for c in self.of("txt") if c != ds.target])
        if kind == "num":
            return issues.residual_issues(automl.cross_validated(df, ds.key, ds.target, "regression", k=self.settings.cv_folds, seed=ds.seed, skip=skip), ds.key, ds.target, "prediction")
        classes = sorted(r[0] for r in df.where(profile.q(ds.target).isNotNull()).select(profile.q(ds.target).cast("string")).distinct().collect())  # few by type
        if self.pred_probs is not None:
            scored = df.join(self.pred_probs, ds.key)
        else:
            scored = automl.cross_validated(df, ds.key, ds.target, "multiclass", k=self.settings.cv_folds, seed=ds.seed, skip=skip, estimator=self.classifier)
        scored = scored.withColumn("_label", profile.q(ds.target).cast("string"))
        return issues.confident_learning(scored, ds.key, "_label", classes, "probability")

    def semantic_type_detection(self) -> DataFrame:
        self.tables["semantic_types"] = semantic.semantic_types(self.ds.df, self.types, self.ds.key, self.settings.semantic_acc, self.namer)
        return self.tables["semantic_types"]

    def data_balance_eval(self) -> DataFrame:
        s = self.settings
        if not {"profile_num", "value_counts"} & set(self.tables):
            self.static_profiling()
        empty = self.ds.df.limit(0)
        num = self.tables.get("profile_num", profile.num_profile(empty, [self.ds.key], self.ds.split) if "profile_num" not in self.tables else None)
        counts = self.tables.get("value_counts", profile.value_counts(empty, [self.ds.key], self.ds.split) if "value_counts" not in self.tables else None)
        self.tables["balance"] = cut(
            balance.evaluate(num, counts, self.ds.split, skew=s.skewness, kurtosis=s.kurtosis, absolute=s.imbalance_absolute, relative=s.imbalance_relative, mean_z=s.mean_z, js=s.js)
        )
        return self.tables["balance"]

    def create_summary(self) -> dict[str, DataFrame]:
        self.static_profiling()
        self.detect_corr_data_leakage()
        self.quality_issue_detection()
        self.semantic_type_detection()
        self.data_balance_eval()
        return self.tables

    # --- reports -----------------------------------------------------------------------------------------------
    def quick_summary(self) -> dict:
        """Counts: outliers and label issues per split, near-duplicates per kind, flagged columns per balance check (a
        column counts once), and the groups of high correlation."""
        t = self.tables
        out: dict = {"correlated_groups": self.groups}
        for name, flag in (("outliers", "is_outlier"), ("label_issues", "is_issue")):
            if name in t:
                out[name] = {r[0]: r[1] for r in t[name].groupBy("dataset").agg(F.count_if(flag)).collect()}
        if "near_duplicates" in t:
            out["near_duplicates"] = {r.kind: r["rows"] for r in issues.duplicate_counts(t["near_duplicates"]).collect()}
            out["data_leakage_split_based"] = any("-" in k for k in out["near_duplicates"])
        if "balance" in t:
            rows = t["balance"].where("flagged").groupBy("check").agg(F.count_distinct("column").alias("n")).collect()
            out["balance"] = {r.check: r.n for r in rows}
        return out

    def detailed_correlations(self, n: int = 5, advise: float = 0.8) -> DataFrame:
        """(column, other, measure, value, advice) of the ``n`` strongest associations of each column."""
        m = self.tables["assoc"].where("value is not null")
        both = m.select(F.col("col_a").alias("column"), F.col("col_b").alias("other"), "measure", "value").unionByName(m.select(F.col("col_b").alias("column"), F.col("col_a").alias("other"), "measure", "value"))
        rank = F.expr("row_number() over (partition by column order by abs(value) desc, other)")
        return both.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("advice", F.abs("value") > advise)

    def detailed_outliers(self) -> DataFrame:
        found = self.tables["outliers"].where("is_outlier").select(F.col("row_id").alias(self.ds.key), "score")
        return self.ds.df.join(found, self.ds.key)

    def detailed_label_issues(self) -> DataFrame:
        cols = self.tables["label_issues"].select(F.col("row_id").alias(self.ds.key), "is_issue", F.col("score").alias("label_score"), "predicted_label")
        return self.ds.df.join(cols, self.ds.key, "left")

    def detailed_near_duplicates(self) -> DataFrame:
        return issues.duplicate_sets(self.tables["near_duplicates"])

    def histogram(self, column: str, bins: int = 20) -> DataFrame:
        return profile.histogram(self.ds.df, column, bins)

    # --- repair and export -------------------------------------------------------------------------------------
    def solve_issues(self, consider_near_duplicates: bool = True, splits: list[str] | None = None) -> Dataset:
        """Relabelled and without outliers (and near-duplicates). By default all splits are repaired, test included."""
        t, ds = self.tables, self.ds
        df = issues.clean(
            ds.df, ds.key, outlier_ids=t["outliers"].where("is_outlier") if "outliers" in t else None,
            pairs=t["near_duplicates"] if consider_near_duplicates and "near_duplicates" in t else None,
            relabel=t.get("label_issues"), target=ds.target, splits=None if splits is None else (ds.split, "", splits),
        )
        return replace(ds, df=df)

    def export(self) -> dict[str, DataFrame]:
        """All result tables, and as tables the feature types and the groups of high correlation."""
        spark = self.ds.df.sparkSession
        types = spark.createDataFrame(sorted(self.types.items()), "column string, dformat string")
        groups = spark.createDataFrame([(i, c) for i, g in enumerate(self.groups) for c in g], "group int, column string")
        return self.tables | {"feature_types": types, "correlated_groups": groups}

    def statistics_plot(self, columns: list[str] | None = None) -> DataFrame:
        """(column, split, statistic, value): the numeric statistics as a plot would show them."""
        p = self.tables["profile_num"] if columns is None else self.tables["profile_num"].where(F.col("column").isin(columns))
        names = ("mean", "std", "min", "max", "skewness", "kurtosis", "null_count")
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")
        return p.select("column", F.col(self.ds.split).alias("split"), cells).select("column", "split", "s.*")

    def category_plot(self, column: str, top: int = 20) -> DataFrame:
        """(split, value, count, share) of the most frequent values of a category, by all splits together."""
        counts = self.tables["value_counts"].where(F.col("column") == column).withColumnRenamed(self.ds.split, "split")
        best = counts.groupBy(F.col("value").alias("_v")).agg(F.sum("count").alias("_n")).orderBy(F.col("_n").desc(), "_v").limit(top)
        share = F.col("count") / F.sum("count").over(Window.partitionBy("split"))
        return counts.withColumn("share", share).join(F.broadcast(best), F.col("value").eqNullSafe(F.col("_v"))).select("split", "value", "count", "share")

    def correlation_plot(self) -> DataFrame:
        """(x, y, value): the whole symmetric matrix of associations, its diagonal included."""
        m = self.tables["assoc"]
        one = m.select(F.col("col_a").alias("x"), F.col("col_b").alias("y"), "value")
        names = sorted(c for c, t in self.types.items() if t in ("num", "cat"))
        same = self.ds.df.sparkSession.createDataFrame([(c, c, 1.0) for c in names], "x string, y string, value double")
        return one.unionByName(m.select(F.col("col_b").alias("x"), F.col("col_a").alias("y"), "value")).unionByName(same)

    def save(self, path: str) -> None:
        io.save_results(self.tables, {"types": self.types, "groups": self.groups, "target": self.ds.target}, path)


def load_summary(ds: Dataset, path: str) -> DataSummary:
    """A saved summary over the dataset it was made of."""
    tables, scalars = io.load_results(ds.df.sparkSession, path)
    out = DataSummary(ds, scalars["types"])
    out.tables, out.groups = tables, [tuple(g) for g in scalars["groups"]]
    return out
