"""Model metrics per group and per intersection of groups.

Groups of all features come from one scan: rows are unpivoted by feature and reduced to confusion counts, from which all
metrics and gaps follow on tables of the size of the groups.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import group_key
from tessella.operators.features import grouped_medians
from tessella.operators.profile import q

EPS = 2.0**-52


def feature_sets(features: list[str], intersections: bool = True) -> list[tuple[str, ...]]:
    """Single features, then intersections up to a size that falls with their number."""
    n = len(features)
    most = 1
    if intersections:  # fixed values: features up to which intersections of a size are made
        most = 5 if n <= 5 else 4 if n <= 7 else 3 if n <= 9 else 2 if n <= 12 else 1
    return [c for k in range(1, min(n, most) + 1) for c in combinations(features, k)]


def grouped(df: DataFrame, sets: list[tuple[str, ...]], *keep: Column) -> DataFrame:
    """(feature_set, grp, *keep): each row once per feature set; missing values are the group "missing"."""
    cells = F.array(*[F.struct(F.lit("+".join(s)).alias("feature_set"), group_key([q(c) for c in s]).alias("grp")) for s in sets])
    return df.select(*keep, F.explode(cells).alias("g")).select("g.feature_set", "g.grp", *[k for k in df.select(*keep).columns])


def ratio(a: Column, b: Column, strict: bool) -> Column:
    return F.when(b > 0, a / b) if strict else F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, sets: list[tuple[str, ...]], y: str, pred: str, pos) -> DataFrame:
    """(feature_set, grp, tp, fp, tn, fn); rows without label or prediction take no part."""
    base = df.where(q(y).isNotNull() & q(pred).isNotNull())
    rows = grouped(base, sets, (q(y) == F.lit(pos)).alias("y"), (q(pred) == F.lit(pos)).alias("p"))
    y_, p_ = F.col("y"), F.col("p")
    return rows.groupBy("feature_set", "grp").agg(
        F.count_if(y_ & p_).alias("tp"), F.count_if(~y_ & p_).alias("fp"), F.count_if(~y_ & ~p_).alias("tn"), F.count_if(y_ & ~p_).alias("fn")
    )


def binary_metrics(conf: DataFrame, strict: bool = False) -> DataFrame:
    """All binary metrics of confusion counts. Balanced accuracy is adjusted for chance; F1, precision and recall are
    macro means over the classes present; rates without denominator are 0, or null with ``strict``."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    z = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pos_seen, neg_seen = (tp + fn + fp > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    classes = pos_seen + neg_seen
    macro = lambda a, b: (a * pos_seen + b * neg_seen) / F.nullif(classes, F.lit(0))
    p1, p0, r1, r0 = z(tp, tp + fp), z(tn, tn + fn), z(tp, tp + fn), z(tn, tn + fp)
    f1, f0 = z(2 * tp, 2 * tp + fp + fn), z(2 * tn, 2 * tn + fp + fn)
    real = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    ba = (r1 * (tp + fn > 0).cast("int") + r0 * (tn + fp > 0).cast("int")) / F.nullif(real, F.lit(0))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return conf.select(
        "feature_set", "grp", n.cast("bigint").alias("count"), z(tp + tn, n).alias("accuracy"),
        F.when(real > 1, (ba - 1 / real) / (1 - 1 / real)).alias("balanced_accuracy"), macro(f1, f0).alias("f1"), macro(p1, p0).alias("precision"), macro(r1, r0).alias("recall"),
        ratio(tp + fp, n, strict).alias("selection_rate"), ratio(tp, tp + fn, strict).alias("tpr"), ratio(tn, tn + fp, strict).alias("tnr"), ratio(fp, tn + fp, strict).alias("fpr"),
        ratio(fn, tp + fn, strict).alias("fnr"), F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0).alias("mcc"),
    )


def multiclass_metrics(df: DataFrame, sets: list[tuple[str, ...]], y: str, pred: str) -> DataFrame:
    """Count, accuracy, adjusted balanced accuracy, macro F1 / precision / recall and MCC per group, for any number of
    classes, from the counts of (group, label, prediction)."""
    base = df.where(q(y).isNotNull() & q(pred).isNotNull())
    cells = grouped(base, sets, q(y).cast("string").alias("y"), q(pred).cast("string").alias("p")).groupBy("feature_set", "grp", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    side = cells.select("feature_set", "grp", F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("s"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("x")).select("feature_set", "grp", "x.*")
    per = side.groupBy("feature_set", "grp", "c").agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum("hit").alias("hit"))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t, s, hit = F.col("t"), F.col("s"), F.col("hit")
    out = per.groupBy("feature_set", "grp").agg(
        F.sum("t").alias("count"), F.sum("hit").alias("hits"), F.avg(z(2 * hit, t + s)).alias("f1"), F.avg(z(hit, s)).alias("precision"), F.avg(z(hit, t)).alias("recall"),
        F.avg(F.when(t > 0, hit / t)).alias("ba"), F.count_if(t > 0).alias("k"),
        F.sum(t * s).alias("ts"), F.sum(t * t).alias("tt"), F.sum(s * s).alias("ss"),
    )
    n, k = F.col("count").cast("double"), F.col("k")
    root = F.sqrt((n * n - F.col("ss")) * (n * n - F.col("tt")))
    return out.select(
        "feature_set", "grp", "count", (F.col("hits") / n).alias("accuracy"), F.when(k > 1, (F.col("ba") - 1 / k) / (1 - 1 / k)).alias("balanced_accuracy"),
        "f1", "precision", "recall", F.when(root > 0, (F.col("hits") * n - F.col("ts")) / root).otherwise(0.0).alias("mcc"),
    )


def regression_metrics(df: DataFrame, sets: list[tuple[str, ...]], y: str, pred: str) -> DataFrame:
    """Count, MAE, MSE, RMSE, median absolute error, MAPE and R2 per group; R2 of a constant label is null."""
    base = df.where(q(y).isNotNull() & q(pred).isNotNull())
    rows = grouped(base, sets, q(y).cast("double").alias("y"), q(pred).cast("double").alias("p"))
    e = F.col("y") - F.col("p")
    out = rows.groupBy("feature_set", "grp").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(EPS))).alias("mape"), (1 - F.avg(e * e) / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("r2"),
    )
    middle = grouped_medians(rows.select("feature_set", "grp", F.abs(e).alias("e")), ["feature_set", "grp"], "e").withColumnRenamed("median", "mdae")
    return out.join(middle, ["feature_set", "grp"], "left").select("feature_set", "grp", "count", "mae", "mse", "rmse", "mdae", "mape", "r2")


def absolute_error(y: Column, p: Column) -> Column:
    """Error of one row: |y - p|, which is the root of its square."""
    return F.abs(y - p)


def overall(df: DataFrame, kind: str, y: str, pred: str, pos=None) -> DataFrame:
    """(metric, value) over all rows together: the row that stands beside the groups."""
    one, sets = df.withColumn("_all", F.lit("all")), [("_all",)]
    if kind == "regression":
        wide = regression_metrics(one, sets, y, pred)
    elif kind == "multiclass":
        wide = multiclass_metrics(one, sets, y, pred)
    else:
        wide = binary_metrics(confusion(one, sets, y, pred, pos))
    return tidy_metrics(wide).select("metric", "value")


def tidy_metrics(wide: DataFrame) -> DataFrame:
    """(feature_set, grp, metric, value)."""
    names = [c for c in wide.columns if c not in ("feature_set", "grp")]
    return wide.select("feature_set", "grp", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("feature_set", "grp", "m.*")


def gaps(tidy: DataFrame) -> DataFrame:
    """(feature_set, metric, difference, ratio): max - min and min / max over the groups; ratio null if the max is 0."""
    g = tidy.groupBy("feature_set", "metric").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return g.select("feature_set", "metric", (F.col("hi") - F.col("lo")).alias("difference"), (F.col("lo") / F.nullif("hi", F.lit(0.0))).alias("ratio"))


def valid_binary_labels(df: DataFrame, y: str, pred: str) -> bool:
    """Labels and predictions together are exactly 0 and 1, or -1 and 1."""
    both = df.select(F.explode(F.array(q(y).cast("string"), q(pred).cast("string"))).alias("v")).where("v is not null").distinct().limit(3)
    values = {r.v for r in both.collect()}
    return values in ({"0", "1"}, {"-1", "1"})


def fairness(conf: DataFrame) -> DataFrame:
    """Demographic parity, equalised odds and equal opportunity per feature set, as difference and ratio."""
    g = gaps(tidy_metrics(binary_metrics(conf).select("feature_set", "grp", "selection_rate", "tpr", "fpr")))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return g.groupBy("feature_set").agg(
        pick("selection_rate", "difference").alias("demographic_parity_difference"), pick("selection_rate", "ratio").alias("demographic_parity_ratio"),
        F.greatest(pick("tpr", "difference"), pick("fpr", "difference")).alias("equalized_odds_difference"), F.least(pick("tpr", "ratio"), pick("fpr", "ratio")).alias("equalized_odds_ratio"),
        pick("tpr", "difference").alias("equal_opportunity_difference"), pick("tpr", "ratio").alias("equal_opportunity_ratio"),
    )


def choose_features(types: dict[str, str], selector, sensitive: list[str] = (), interest: list[str] = ()) -> list[str]:
    """Features by selector: sens, cat, all, intrest, a name or a list; otherwise the first categorical, else the first."""
    if isinstance(selector, (list, tuple)):
        return [c for c in selector if c in types]
    named = {"sens": list(sensitive), "intrest": list(interest), "all": list(types), "cat": [c for c, t in types.items() if t == "cat"]}
    if selector in named:
        return [c for c in named[selector] if c in types]
    if selector in types:
        return [selector]
    cats = named["cat"]
    return cats[:1] or list(types)[:1]


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    """Per-row loss, the probability clipped; y is 0 or 1."""
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(c) + (1 - y) * F.ln(1 - c))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) of two overall metric tables (metric, value)."""
    return before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full").withColumn("change", F.col("after") - F.col("before"))
