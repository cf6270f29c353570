"""Mixed-type association matrix and leakage by correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.profile import correlation, number, q


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, value) of all pairs in one aggregate; missing values count as 0, constant columns give null."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, value double")
    x = df.select(*[F.coalesce(number(q(c)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
    at = {c: f"x{i}" for i, c in enumerate(columns)}
    wide = x.agg(*[correlation(F.col(at[a]), F.col(at[b])).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.col_a", "r.col_b", F.when(~F.isnan("r.value"), F.col("r.value")).alias("value"))


def correlation_ratio(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """(col_a categorical, col_b numeric, value): root of between-group over total sum of squares, null if constant.
    All pairs in one scan: rows are unpivoted by categorical column and summed per category, map-side first."""
    if not categorical or not numeric:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, value double")
    nums = [F.coalesce(number(q(c)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(numeric)]
    cats = F.array(*[F.struct(F.lit(c).alias("col_a"), F.coalesce(q(c).cast("string"), F.lit("0.0")).alias("g")) for c in categorical])
    long = df.select(*nums, F.explode(cats).alias("c")).select("c.*", *[f"x{i}" for i in range(len(numeric))])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(len(numeric)):
        aggs += [F.avg(f"x{i}").alias(f"m{i}"), F.var_pop(f"x{i}").alias(f"v{i}")]
    groups = long.groupBy("col_a", "g").agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("col_b"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, c in enumerate(numeric)])
    g = groups.select("col_a", "n", F.explode(cells).alias("c")).select("col_a", "n", "c.*")
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * mean * mean
    within = F.sum(F.col("n") * F.col("v"))
    ratio = F.greatest(between, F.lit(0.0)) / F.nullif(F.greatest(between, F.lit(0.0)) + within, F.lit(0.0))
    return g.groupBy("col_a", "col_b").agg(F.sqrt(ratio).alias("value"))


def cramers_v(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, chi2, value), bias-corrected; missing is a category. From the identity chi2 = n (sum of
    n_ij^2 / (r_i c_j) - 1) empty cells are never built. Null with one row or a constant column."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, chi2 double, value double")
    s = {c: F.coalesce(q(c).cast("string"), F.lit("0.0")) for c in columns}
    cells = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), s[a].alias("a"), s[b].alias("b")) for a, b in pairs])
    table = df.select(F.explode(cells).alias("c")).groupBy("c.col_a", "c.col_b", "c.a", "c.b").agg(F.count(F.lit(1)).alias("n"))
    x = table.withColumn("ra", F.expr("sum(n) over (partition by col_a, col_b, a)")).withColumn("rb", F.expr("sum(n) over (partition by col_a, col_b, b)"))
    stats = x.groupBy("col_a", "col_b").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("s"),
        F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"),
    )
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    chi2 = n * (F.col("s") - 1)
    phi = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / F.nullif(n - 1, F.lit(0)))
    k2, r2 = k - (k - 1) * (k - 1) / F.nullif(n - 1, F.lit(0)), r - (r - 1) * (r - 1) / F.nullif(n - 1, F.lit(0))
    least = F.least(k2 - 1, r2 - 1)
    return stats.select("col_a", "col_b", chi2.alias("chi2"), F.when((least > 0) & (k > 1) & (r > 1), F.sqrt(phi / least)).alias("value"))


def association(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(col_a, col_b, measure, value) over numeric and categorical columns; text columns take no part."""
    num, cat = [c for c, t in types.items() if t == "num"], [c for c, t in types.items() if t == "cat"]
    name = lambda d, m: d.select("col_a", "col_b", F.lit(m).alias("measure"), "value")
    return name(pearson(df, num), "pearson").unionByName(name(correlation_ratio(df, cat, num), "correlation_ratio")).unionByName(name(cramers_v(df, cat), "cramers_v"))


def correlated_groups(matrix: DataFrame, columns: list[str], threshold: float = 0.95) -> list[tuple[str, ...]]:
    """Stars of the (small) graph of strong pairs. Its centres are the first independent set in the order of
    ``columns``: a column is a centre unless it touches an earlier one. A column may belong to several stars, columns
    without a strong pair to none."""
    pairs = [tuple(r) for r in matrix.where(F.abs("value") >= threshold).select("col_a", "col_b").collect()]
    touching = {c: {d for pair in pairs if c in pair for d in pair if d in columns} for c in columns}
    centres: list[str] = []
    for c in columns:
        if len(touching[c]) > 1 and touching[c].isdisjoint(centres):
            centres.append(c)
    return [tuple(sorted(touching[c])) for c in centres]


def top_correlations(matrix: DataFrame, column: str, n: int = 5) -> DataFrame:
    """(other, measure, value) most strongly associated with the column, ties by name."""
    other = F.when(F.col("col_a") == column, F.col("col_b")).when(F.col("col_b") == column, F.col("col_a"))
    return matrix.select(other.alias("other"), "measure", "value").where("other is not null and value is not null").orderBy(F.abs("value").desc(), "other").limit(n)
