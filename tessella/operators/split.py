"""Sampling and splitting, reproducible and independent of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.profile import number, q
from tessella.session import cut


def order_key(key: str, seed: int) -> Column:
    return F.xxhash64(q(key), F.lit(seed))


def ranked(df: DataFrame, groups: list[Column], order: list[Column]) -> DataFrame:
    """Adds ``_rank``, from 1, and ``_size`` within each group (null is one), in the given order. Rows are laid out in
    ranges of (group, order), so a group may span many tasks; the ranges' sizes give the offsets."""
    names = [f"_g{i}" for i in range(len(groups))]
    keyed = df.withColumns({n: g for n, g in zip(names, groups, strict=True)} | {f"_o{i}": o for i, o in enumerate(order)})
    along = [F.col(n).asc_nulls_first() for n in (*names, *[f"_o{i}" for i in range(len(order))])]
    keyed = cut(keyed.repartitionByRange(*along).withColumn("_part", F.spark_partition_id()))  # partition numbers are kept from here on
    sizes = keyed.groupBy(*names, "_part").agg(F.count(F.lit(1)).alias("_c"))
    per = Window.partitionBy(*names)
    first = F.coalesce(F.sum("_c").over(per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(n).alias(f"{n}_s") for n in names], F.col("_part").alias("_part_s"), first.alias("_first"), F.sum("_c").over(per).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(*names, "_part").orderBy(*along[len(names):]))
    same = F.col("_part") == F.col("_part_s")
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}_s"))
    joined = keyed.withColumn("_in", inside).join(sizes, same)
    return joined.select(*df.columns, (F.col("_first") + F.col("_in")).alias("_rank"), "_size")


def stratified_split(df: DataFrame, key: str, target: str, *, share: float = 0.8, order: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds ``dataset``: per class of ``target`` (null is one) the first ceil(share x n) rows in hashed order, or in an
    own ``order``, are train, the rest test."""
    out = ranked(df, [q(target)], [order_key(key, seed) if order is None else order, q(key)])
    return out.withColumn("dataset", F.when(F.col("_rank") <= F.ceil(F.col("_size") * share), "train").otherwise("test")).drop("_rank", "_size")


def fold_validation(df: DataFrame, split: str = "dataset") -> DataFrame:
    """Validation rows become training rows."""
    return df.withColumn(split, F.when(q(split) == "val", "train").otherwise(q(split)))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, target: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1 by hash of the key; with a ``target`` in turn within each class, so that the folds of a class
    differ by at most one row."""
    if target is None:
        return df.withColumn("fold", F.pmod(order_key(key, seed), F.lit(k)).cast("int"))
    return ranked(df, [q(target)], [order_key(key, seed), q(key)]).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_size")


def row_index(df: DataFrame, key: str, split: str) -> DataFrame:
    """0-based index within each split in key order."""
    return ranked(df, [q(split)], [q(key)]).withColumn("new_id", F.col("_rank") - 1).drop("_rank", "_size")


def sample_values(df: DataFrame, column: str, kind: str, n: int, *, key: str, seed: int = 42) -> DataFrame:
    """Example values of a column: for numbers the range and quartiles and random ones, sorted; for categories the most
    frequent; for texts random ones. Fewer values than asked for give all of them."""
    if kind == "cat":
        counts = df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return counts.orderBy(F.col("count").desc(), "value").limit(n).select("value")
    if kind == "txt":
        return df.where(q(column).isNotNull()).orderBy(order_key(key, seed), q(key)).limit(n).select(q(column).cast("string").alias("value"))
    x = df.select(number(q(column)).alias("value"), q(key).alias("k")).where("value is not null")
    fixed = x.agg(F.min("value").alias("a"), F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000).alias("b"), F.max("value").alias("c"))
    fixed = fixed.select(F.explode(F.concat(F.array("a"), "b", F.array("c"))).alias("value")).where("value is not null")
    more = x.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(max(n - 5, 0)).select("value")
    return fixed.unionByName(more).orderBy("value")
