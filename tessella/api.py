"""The public names of a session: load, summarise and repair, prepare, train, assess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.types import feature_types, is_numeric, target_type
from tessella.operators import binning, fairness
from tessella.operators.automl import TabularModel, synthesise
from tessella.operators.prep import Dataset, positive_label
from tessella.operators.prep import prepare as autoML_prep
from tessella.operators.profile import q
from tessella.operators.summary import DataSummary, Settings, load_summary
from tessella.sources.io import load_dataset as get_dataset

__all__ = ["AutoMLModel", "DataSummary", "Dataset", "FairnessAssessor", "Settings", "autoML_prep", "feature_generation", "get_dataset", "load_summary"]


def feature_generation(ds: Dataset, n_features: int = 10) -> tuple[Dataset, list[str]]:
    """The dataset with its best crossed features; a nominal target is judged by its positive label."""
    from dataclasses import replace

    types = feature_types(ds.df, [c for c in ds.df.columns if c not in (ds.key, ds.split, ds.target)])
    num, cat = [c for c, t in types.items() if t == "num"], [c for c, t in types.items() if t == "cat"]
    df = ds.df.withColumn("_y", q(ds.target).cast("double") if ds.problem_type == "regression" else (q(ds.target) == F.lit(ds.pos_label)).cast("double"))
    out, names = synthesise(df, "_y", num, cat, n_features)
    return replace(ds, df=out.drop("_y")), names


class AutoMLModel:
    """Train on the training split, predict on any."""

    def __init__(self, ds: Dataset, quality: str = "good"):
        self.ds = ds
        kind = ds.problem_type or target_type(ds.df, ds.target)
        self.model = TabularModel(ds.target, kind, quality, (ds.key, ds.split), ds.seed)

    def run_auto_ml(self) -> DataFrame:
        """Scored test rows: prediction and, for classes, probability."""
        self.model.fit(self.ds.part("train"))
        return self.model.transform(self.ds.part("test"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def transform_features(self, df: DataFrame) -> DataFrame:
        return self.model.feature_space(df)

    def get_feature_importance(self, top: int = 20) -> DataFrame:
        return self.model.importance(self.ds.df.sparkSession, top)

    def save(self, path: str) -> None:
        self.model.save(path)

    @staticmethod
    def retrieve_model(ds: Dataset, path: str) -> AutoMLModel:
        """A saved model over a dataset, ready to predict."""
        out = AutoMLModel(ds)
        out.model = TabularModel.load(ds.df.sparkSession, path)
        return out


class FairnessAssessor:
    """Metrics of scored rows by group and intersection. Features with more than ``max_unique`` values are binned, with
    cut points fitted on the training split."""

    def __init__(self, ds: Dataset, scored: DataFrame, max_unique: int = 5, prediction: str = "prediction"):
        self.ds, self.scored, self.prediction, self.max_unique = ds, scored, prediction, max_unique
        self.kind = ds.problem_type or target_type(ds.df, ds.target)
        self.types = feature_types(ds.df, [c for c in ds.df.columns if c not in (ds.key, ds.split, ds.target)])
        self.pos_label = positive_label(ds, ds.df) if self.kind == "binary" else None

    def _binned(self, features: list[str]) -> tuple[DataFrame, dict[str, str]]:
        many = self.scored.agg(*[F.approx_count_distinct(q(f)).alias(f"n{i}") for i, f in enumerate(features)]).first() if features else None
        train, out, names = self.ds.part("train"), self.scored, {f: f for f in features}
        how: dict = {}
        if self.kind == "multiclass":  # few classes, by type
            how["classes"] = sorted(r[0] for r in train.where(q(self.ds.target).isNotNull()).select(q(self.ds.target).cast("string")).distinct().collect())
        elif self.kind == "binary":
            how["event"] = self.pos_label
        for i, f in enumerate(features):
            if many[f"n{i}"] > self.max_unique:
                bins = binning.fit_bins(train, f, self.ds.target, **how)
                if bins is not None:
                    out, names[f] = binning.bin_columns(out, [bins]), f"{f}_bin"
        return out, names

    def overall(self) -> DataFrame:
        """(metric, value) over all scored rows, to stand beside the groups and to compare runs by."""
        return fairness.overall(self.scored, self.kind, self.ds.target, self.prediction, self.pos_label)

    def analyze(self, selector="sens", intersections: bool = True) -> dict[str, DataFrame]:
        """Tables ``overall``, ``by_group`` (tidy), ``gaps`` and, for two classes, ``fairness``, for the chosen features.
        With several classes "all" means the numeric features."""
        chosen = fairness.choose_features(self.types, selector, self.ds.sensitive_features, self.ds.columns_of_interest)
        if self.kind == "multiclass" and selector == "all":
            chosen = [c for c in chosen if is_numeric(self.ds.df.schema[c].dataType)]
        df, names = self._binned(chosen)
        sets = fairness.feature_sets([names[c] for c in chosen], intersections)
        conf = None
        if self.kind == "regression":
            wide = fairness.regression_metrics(df, sets, self.ds.target, self.prediction)
        elif self.kind == "multiclass":
            wide = fairness.multiclass_metrics(df, sets, self.ds.target, self.prediction)
        else:
            conf = fairness.confusion(df, sets, self.ds.target, self.prediction, self.pos_label)
            wide = fairness.binary_metrics(conf)
        tidy = fairness.tidy_metrics(wide)
        out = {"overall": self.overall(), "by_group": tidy, "gaps": fairness.gaps(tidy)}
        return out if conf is None else out | {"fairness": fairness.fairness(conf)}

    def analyze_feature(self, feature: str) -> dict[str, DataFrame]:
        return self.analyze([feature], intersections=False)

    def analyze_all_categorical(self, intersections: bool = True) -> dict[str, DataFrame]:
        return self.analyze("cat", intersections)

    def analyze_all_sens(self, intersections: bool = True) -> dict[str, DataFrame]:
        return self.analyze("sens", intersections)

    def get_all_metrics(self) -> dict[str, DataFrame]:
        """Every feature on its own."""
        return self.analyze("all", intersections=False)
