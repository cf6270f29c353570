"""Outliers, near-duplicates and label errors, and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.features import medians
from tessella.session import cut


def outliers(edges: DataFrame, threshold: float = 0.37) -> DataFrame:
    """(row_id, mean_dist, is_outlier, score) of a neighbour graph: flagged if the mean distance exceeds the median of
    the means / ``threshold``; score exp(-mean / median), low = isolated. All-zero distances: nobody is flagged."""
    means = cut(edges.groupBy(F.col("src_id").alias("row_id")).agg(F.avg("dist").alias("mean_dist")))
    middle = medians(means, ["mean_dist"])["mean_dist"]
    return means.withColumn("middle", F.lit(middle).cast("double")).select(
        "row_id", "mean_dist", F.coalesce(F.col("mean_dist") > F.col("middle") / threshold, F.lit(False)).alias("is_outlier"),
        F.when(F.col("middle") > 0, F.exp(-F.col("mean_dist") / F.col("middle"))).otherwise(F.lit(1.0)).alias("score"),
    )


def near_duplicate_pairs(edges: DataFrame, threshold: float = 0.13) -> DataFrame:
    """(a < b) of edges at most ``threshold`` x the median nearest distance; either direction suffices."""
    middle = medians(edges.where("rank = 1"), ["dist"])["dist"]
    close = edges.where(F.col("dist") <= F.lit(threshold * middle if middle is not None else None).cast("double"))
    return close.select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).distinct()


def confident_learning(df: DataFrame, row_id: str, label: str, classes: list, probs: str) -> DataFrame:
    """(row_id, is_issue, score, original_label, predicted_label) from out-of-fold class probabilities (array in the
    order of ``classes``). A row is assigned to its most probable class among those at or above the class threshold
    (mean probability of rows so labelled); it is an issue if that isn't its label. Rows without label or
    probabilities take no part; ties go to the earlier class."""
    names = F.array(*[F.lit(c) for c in classes])
    x = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("original_label"), F.col(probs).alias("p")).where("original_label is not null and p is not null")
    x = x.withColumn("at", F.array_position(names, F.col("original_label")).cast("int")).where("at > 0")
    sums = x.groupBy("at").agg(F.avg(F.element_at("p", F.col("at"))).alias("t"))
    wide = sums.agg(F.map_from_entries(F.collect_list(F.struct("at", "t"))).alias("thresholds"))  # one entry per class
    x = x.join(F.broadcast(wide))
    n = len(classes)
    over = F.array(*[F.when(F.col("p")[i] >= F.col("thresholds")[F.lit(i + 1)], F.col("p")[i]) for i in range(n)])
    best = F.array_position(over, F.array_max(over))
    return x.select(
        "row_id", (best.isNotNull() & (best > 0) & (best != F.col("at"))).alias("is_issue"), F.element_at("p", F.col("at")).alias("score"), "original_label",
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("predicted_label"),
    )


def residual_issues(df: DataFrame, row_id: str, target: str, predicted: str, sigmas: float = 3.0) -> DataFrame:
    """Label issues of a regression: residuals beyond ``sigmas`` population deviations; score exp(-|z|)."""
    r = F.col(target) - F.col(predicted)
    stats = df.agg(F.avg(r).alias("m"), F.stddev_pop(r).alias("s"))
    z = F.abs((r - F.col("m")) / F.nullif("s", F.lit(0.0)))
    return df.join(F.broadcast(stats)).select(  # one row
        F.col(row_id).alias("row_id"), F.coalesce(z > sigmas, F.lit(False)).alias("is_issue"), F.coalesce(F.exp(-z), F.lit(1.0)).alias("score"),
        F.col(target).alias("original_label"), F.col(predicted).alias("predicted_label"),
    )


def removed_by_duplicates(pairs: DataFrame) -> DataFrame:
    """Rows a greedy scan in id order removes: every larger end of a pair."""
    return pairs.select(F.greatest("a", "b").alias("row_id")).where("row_id is not null").distinct()


def clean(df: DataFrame, row_id: str, *, outlier_ids: DataFrame | None = None, pairs: DataFrame | None = None, relabel: DataFrame | None = None,
          target: str | None = None, splits: tuple[str, str, list[str]] | None = None) -> DataFrame:
    """Relabel flagged rows, then drop outliers and duplicate rows by anti-joins. ``relabel``: (row_id, is_issue,
    predicted_label). ``splits`` = (column, _, names) limits the repair to those splits; by default all are repaired."""
    scope = F.lit(True) if splits is None else F.col(splits[0]).isin(splits[2])
    out = df
    if relabel is not None and target is not None:
        fix = relabel.where("is_issue").select(F.col("row_id").alias("_id"), F.col("predicted_label").alias("_new")).dropDuplicates(["_id"])
        out = out.join(fix, F.col(row_id) == F.col("_id"), "left").withColumn(target, F.when(scope & F.col("_id").isNotNull(), F.col("_new")).otherwise(F.col(target))).drop("_id", "_new")
    for gone in (outlier_ids, None if pairs is None else removed_by_duplicates(pairs)):
        if gone is not None:
            out = out.join(gone.select(F.col("row_id").alias("_id")), (F.col(row_id) == F.col("_id")) & scope, "left_anti")
    return out


def duplicate_counts(pairs: DataFrame) -> DataFrame:
    """(kind, rows) of pairs with splits (a, b, split_a, split_b): within a split the distinct rows in either place,
    across splits the distinct rows of the later split."""
    within = pairs.where("split_a = split_b").select(F.col("split_a").alias("kind"), F.explode(F.array("a", "b")).alias("id"))
    order = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    up = F.array_position(order, F.col("split_a")) <= F.array_position(order, F.col("split_b"))
    first, second = F.when(up, F.col("split_a")).otherwise(F.col("split_b")), F.when(up, F.col("split_b")).otherwise(F.col("split_a"))
    across = pairs.where("split_a <> split_b").select(F.concat_ws("-", first, second).alias("kind"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("id"))
    return within.unionByName(across).groupBy("kind").agg(F.count_distinct("id").alias("rows"))


def duplicate_sets(pairs: DataFrame) -> DataFrame:
    """(row_id, near_duplicates): sorted partners of each row."""
    both = pairs.select(F.col("a").alias("row_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("row_id"), F.col("a").alias("other")))
    return both.groupBy("row_id").agg(F.array_sort(F.collect_set("other")).alias("near_duplicates"))
