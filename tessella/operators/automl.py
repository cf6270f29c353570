"""Model training, probabilities by cross-validation, feature synthesis and importance on Spark ML."""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.types import is_numeric
from tessella.operators.features import medians
from tessella.operators.profile import correlation, number, q
from tessella.operators.split import folds
from tessella.sources.io import read_text, write_text

#: The names of the presets. Trees and depth are our own, from fast to thorough.
PRESETS = {"medium": (10, 4), "good": (20, 5), "high": (40, 6), "best": (80, 8), "max": (120, 10)}


def _features(df: DataFrame, target: str, skip: tuple[str, ...]) -> tuple[list[str], list[str]]:
    names = [f for f in df.schema if f.name not in (target, *skip)]
    return [f.name for f in names if is_numeric(f.dataType)], [f.name for f in names if f.dataType.simpleString() in ("string", "boolean")]


class TabularModel:
    """Trains on a frame, predicts on frames with the same columns. Missing numbers take the median of the training
    data, missing or new categories a category of their own. ``estimator`` replaces the candidate families: one of Spark
    ML that reads ``_features`` and ``_label`` and, for classes, gives ``probability``."""

    def __init__(self, target: str, problem_type: str, preset: str = "good", skip: tuple[str, ...] = ("row_id", "dataset"), seed: int = 42, estimator=None):
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset}")
        if problem_type not in ("binary", "multiclass", "regression"):
            raise ValueError(f"problem type {problem_type} isn't supported")
        self.target, self.problem_type, self.preset, self.skip, self.seed = target, problem_type, preset, skip, seed
        self.estimator = estimator
        self.model: PipelineModel | None = None

    def _clean(self, df: DataFrame) -> DataFrame:
        new = {c: F.coalesce(number(q(c)), F.lit(self.medians.get(c) or 0.0)) for c in self.numeric}
        return df.withColumns(new | {c: F.coalesce(q(c).cast("string"), F.lit("missing")) for c in self.categorical})

    def _stages(self, estimator):
        idx = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in self.categorical]
        return [*idx, VectorAssembler(inputCols=[*self.numeric, *[f"_i_{c}" for c in self.categorical]], outputCol="_features"), estimator]

    def _candidates(self):
        trees, depth = PRESETS[self.preset]
        on = {"featuresCol": "_features", "labelCol": "_label"}
        bins = {"maxBins": 128, "seed": self.seed}
        if self.problem_type == "regression":
            return [LinearRegression(**on), RandomForestRegressor(numTrees=trees, maxDepth=depth, **bins, **on), GBTRegressor(maxIter=trees, maxDepth=min(depth, 5), **bins, **on)]
        out = [LogisticRegression(**on), RandomForestClassifier(numTrees=trees, maxDepth=depth, **bins, **on)]
        return [*out, GBTClassifier(maxIter=trees, maxDepth=min(depth, 5), **bins, **on)] if self.problem_type == "binary" else out

    def fit(self, df: DataFrame, families: tuple[int, ...] | None = None) -> TabularModel:
        """The best of the candidate families (0 linear, 1 forest, 2 boosted trees; by default all that serve the
        problem) on a held-out fifth, then refitted on all rows."""
        df = df.where(q(self.target).isNotNull())
        self.numeric, self.categorical = _features(df, self.target, self.skip)
        self.medians = medians(df, self.numeric) if self.numeric else {}
        x = self._clean(df)
        self.classes = None
        if self.problem_type == "regression":
            x = x.withColumn("_label", number(q(self.target)))
            judge = RegressionEvaluator(labelCol="_label", metricName="rmse")
        else:
            self.classes = sorted(r[0] for r in df.select(q(self.target).cast("string")).distinct().collect())  # the classes
            x = x.withColumn("_label", (F.array_position(F.array(*[F.lit(c) for c in self.classes]), q(self.target).cast("string")) - 1).cast("double"))
            judge = MulticlassClassificationEvaluator(labelCol="_label", metricName="f1")
        candidates = self._candidates() if self.estimator is None else [self.estimator]
        if families is not None and self.estimator is None:
            candidates = [candidates[i] for i in families if i < len(candidates)]
        if len(candidates) > 1:
            held = F.pmod(F.xxhash64(*[q(c) for c in (*self.numeric, *self.categorical)], F.lit(self.seed)), F.lit(5)) == 0
            x = x.persist()
            scores = [judge.evaluate(Pipeline(stages=self._stages(c)).fit(x.where(~held)).transform(x.where(held))) for c in candidates]
            best = min(scores) if self.problem_type == "regression" else max(scores)
            candidates = [candidates[scores.index(best)]]
        self.model = Pipeline(stages=self._stages(candidates[0])).fit(x)
        if not hasattr(self.model.stages[-1], "featureImportances"):
            made = x
            for stage in self.model.stages[:-1]:
                made = stage.transform(made)
            self.spread = made.select(Summarizer.std(F.col("_features")).alias("s")).first().s.toArray()
        x.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` in the target's terms and, for classes, ``probability`` in the order of ``classes``."""
        if self.model is None:
            raise ValueError("the model isn't trained")
        out = self.model.transform(self._clean(df))
        if self.classes is not None:
            names = F.array(*[F.lit(c) for c in self.classes])
            out = out.withColumn("prediction", F.get(names, F.col("prediction").cast("int"))).withColumn("probability", vector_to_array("probability"))
            return out.select(*df.columns, "prediction", "probability")
        return out.select(*df.columns, "prediction")

    def feature_space(self, df: DataFrame) -> DataFrame:
        """The model's own features as an array, with the target."""
        out = self._clean(df)
        for stage in self.model.stages[:-1]:
            out = stage.transform(out)
        return out.select(q(self.target), vector_to_array("_features").alias("features"))

    def importance(self, spark, top: int = 20) -> DataFrame:
        """(feature, importance), sorted; for linear models coefficients' absolute values per deviation of the feature."""
        names, last = [*self.numeric, *self.categorical], self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            values = last.featureImportances.toArray()
        else:
            m = last.coefficientMatrix.toArray() if hasattr(last, "coefficientMatrix") else last.coefficients.toArray()[None, :]
            values = abs(m).max(axis=0) * self.spread
        rows = sorted(((n, float(v)) for n, v in zip(names, values, strict=True)), key=lambda r: (-r[1], r[0]))[:top]
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        """The pipeline, and beside it what cleaning and naming classes need."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        held = {n: getattr(self, n, None) for n in ("target", "problem_type", "preset", "seed", "numeric", "categorical", "medians", "classes")}
        spread = [float(v) for v in self.spread] if hasattr(self, "spread") else None
        write_text(SparkSession.active(), f"{path}/model.json", json.dumps(held | {"skip": list(self.skip), "spread": spread}))

    @staticmethod
    def load(spark: SparkSession, path: str) -> TabularModel:
        text = read_text(spark, f"{path}/model.json")
        if text is None:
            raise ValueError(f"no model in {path}")
        held = json.loads(text)
        out = TabularModel(held["target"], held["problem_type"], held["preset"], tuple(held["skip"]), held["seed"])
        out.numeric, out.categorical, out.medians, out.classes = held["numeric"], held["categorical"], held["medians"], held["classes"]
        if held["spread"] is not None:
            out.spread = np.array(held["spread"])
        out.model = PipelineModel.load(f"{path}/pipeline")
        return out


def cross_validated(
    df: DataFrame, key: str, target: str, problem_type: str, *, k: int = 5, seed: int = 42, skip: tuple[str, ...] = ("row_id", "dataset"), estimator=None
) -> DataFrame:
    """Out-of-fold ``prediction`` (and ``probability``) for every labelled row, of a forest or of an own ``estimator`` of
    Spark ML that reads ``_features`` and ``_label``; for classes the folds are dealt within each class."""
    x, parts = folds(df.where(q(target).isNotNull()), key, k, seed, None if problem_type == "regression" else target).persist(), []
    for i in range(k):
        model = TabularModel(target, problem_type, "medium", (*skip, key, "fold"), seed, estimator).fit(x.where(F.col("fold") != i), families=(1,))
        parts.append(model.transform(x.where(F.col("fold") == i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def synthesise(df: DataFrame, target: str, numeric: list[str], categorical: list[str] = (), n: int = 10) -> tuple[DataFrame, list[str]]:
    """The ``n`` best crossed features by |correlation| with the (numeric) target, all judged in one aggregate: sums,
    differences, products and ratios of number pairs, the frequency of each category, and the means of the numbers
    within it."""
    made = {}
    for a, b in combinations(numeric, 2):
        x, y = number(q(a)), number(q(b))
        made |= {f"{a}+{b}": x + y, f"{a}-{b}": x - y, f"{a}*{b}": x * y, f"{a}/{b}": x / F.nullif(y, F.lit(0.0))}
    out = df
    for c in categorical:
        means = [F.avg(number(q(x))).alias(f"mean({x}|{c})") for x in numeric]
        freq = df.groupBy(q(c).alias("_v")).agg(F.count(F.lit(1)).cast("double").alias(f"freq({c})"), *means)
        out = out.join(freq, q(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    if not made and not categorical:
        return df, []
    names = [*made, *[n for c in categorical for n in (f"freq({c})", *[f"mean({x}|{c})" for x in numeric])]]
    wide = out.withColumns(made)
    r = wide.agg(*[F.abs(correlation(q(m), F.when(q(m).isNotNull(), number(q(target))))).alias(f"r{i}") for i, m in enumerate(names)]).first()
    good = [(m, r[i]) for i, m in enumerate(names) if r[i] is not None and r[i] == r[i]]
    best = [m for m, _ in sorted(good, key=lambda z: (-z[1], z[0]))[:n]]
    return wide.select(*df.columns, *[q(m) for m in best]), best
