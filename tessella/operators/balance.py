"""Imbalance, skew and drift between splits, read from the profile tables without further scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_flags(num: DataFrame, by: str, skew: float = 1.0, kurtosis: float = 3.0) -> DataFrame:
    """(by, column, high_skew, extreme_kurtosis) of a numeric profile; undefined moments aren't flagged."""
    return num.select(
        by, "column", F.coalesce(F.abs("skewness") > skew, F.lit(False)).alias("high_skew"), F.coalesce(F.abs("kurtosis") > kurtosis, F.lit(False)).alias("extreme_kurtosis")
    )


def imbalance(counts: DataFrame, by: str, absolute: float = 0.2, relative: float = 1.0) -> DataFrame:
    """Categories far from their equal share: |count - total / categories| beyond ``absolute`` of the total, or beyond
    ``relative`` of the expected count. Null is no category."""
    real = counts.where("value is not null")
    over = f"over (partition by `{by}`, column)"
    x = real.withColumn("total", F.expr(f"sum(count) {over}")).withColumn("expected", F.col("total") / F.expr(f"count(1) {over}"))
    gap = F.abs(F.col("count") - F.col("expected"))
    return x.withColumn("flagged", (gap > absolute * F.col("total")) | (gap / (F.col("expected") + 1e-8) > relative))


def mean_drift(num: DataFrame, by: str, reference: str = "train") -> DataFrame:
    """(by, column, drift): |mean - mean of the reference| / (its sample std + 1e-8); null where either lacks values.
    A reference of one value has no deviation and gives null."""
    ref = num.where(F.col(by) == reference).select("column", F.col("mean").alias("m0"), F.col("std").alias("s0"))
    return num.where(F.col(by) != reference).join(F.broadcast(ref), "column").select(  # one row per column
        by, "column", (F.abs(F.col("mean") - F.col("m0")) / (F.col("s0") + 1e-8)).alias("drift")
    )


def class_shares(counts: DataFrame, by: str, reference: str = "train") -> DataFrame:
    """(by, column, value, p, q): shares of a category in a split and in the reference, zero where it is missing."""
    real = counts.where("value is not null")
    totals = real.groupBy(by, "column").agg(F.sum("count").alias("total"))
    splits = totals.where(F.col(by) != reference).select(by, "column", "total")
    ref_total = totals.where(F.col(by) == reference).select("column", F.col("total").alias("total0"))
    mine = real.where(F.col(by) != reference).select(by, "column", "value", F.col("count").alias("c"), F.lit(0).cast("bigint").alias("c0"))
    ref = real.where(F.col(by) == reference).select("column", "value", F.col("count").alias("c0"))
    theirs = splits.select(by, "column").join(ref, "column").select(by, "column", "value", F.lit(0).cast("bigint").alias("c"), "c0")
    cells = mine.unionByName(theirs).groupBy(by, "column", "value").agg(F.sum("c").alias("c"), F.sum("c0").alias("c0"))
    return cells.join(splits, [by, "column"]).join(ref_total, "column").select(
        by, "column", "value", (F.col("c") / F.col("total")).alias("p"), (F.col("c0") / F.col("total0")).alias("q")
    )


def js_divergence(counts: DataFrame, by: str, reference: str = "train") -> DataFrame:
    """(by, column, js) in nats, at most ln 2."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda v: F.when(v > 0, v * F.ln(v / m)).otherwise(0.0)
    return class_shares(counts, by, reference).groupBy(by, "column").agg(F.sum((part(F.col("p")) + part(F.col("q"))) / 2).alias("js"))


def evaluate(num: DataFrame, counts: DataFrame, by: str, reference: str = "train", **thresholds: float) -> DataFrame:
    """All checks as (by, column, check, value, flagged)."""
    t = {"skew": 1.0, "kurtosis": 3.0, "absolute": 0.2, "relative": 1.0, "mean_z": 1.0, "js": 0.2} | thresholds
    row = lambda df, check, value, flag: df.select(by, "column", F.lit(check).alias("check"), value.cast("double").alias("value"), flag.alias("flagged"))
    worst = imbalance(counts, by, t["absolute"], t["relative"]).groupBy(by, "column").agg(F.count_if("flagged").alias("n"))
    no = F.lit(False)
    return (
        row(num, "skewness", F.col("skewness"), F.coalesce(F.abs("skewness") > t["skew"], no))
        .unionByName(row(num, "kurtosis", F.col("kurtosis"), F.coalesce(F.abs("kurtosis") > t["kurtosis"], no)))
        .unionByName(row(worst, "imbalanced_categories", F.col("n"), F.col("n") > 0))
        .unionByName(row(mean_drift(num, by, reference), "mean_drift", F.col("drift"), F.coalesce(F.col("drift") > t["mean_z"], no)))
        .unionByName(row(js_divergence(counts, by, reference), "js_divergence", F.col("js"), F.coalesce(F.col("js") > t["js"], no)))
    )
