"""Imputation, scaling, encoding and text vectors for the feature matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import words
from tessella.operators.profile import BROADCAST, number, q, value_counts
from tessella.operators.split import ranked
from tessella.session import cut


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians in two scans (mean of the two middle values), whatever the number of distinct values."""
    from tessella.operators.profile import tidy

    x = df.select(F.lit("all").alias("_all"), *[number(q(c)).alias(c) for c in columns])
    sketch = tidy(x, columns, lambda c: [F.percentile_approx(q(c), [0.4998, 0.5002], 10_000).alias("e"), F.count(q(c)).alias("n"), F.min(q(c)).alias("lo"), F.max(q(c)).alias("hi")], "_all")
    out: dict[str, float | None] = dict.fromkeys(columns)
    bounds = {r["column"]: r for r in sketch.collect() if r.n}  # one row per column
    if not bounds:
        return out
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(q(c) < r.e[0], F.lit(None)).otherwise(q(c)).alias("v"), (q(c).isNotNull() & (q(c) <= r.e[1])).alias("take"))
        for c, r in bounds.items()
    ])
    near = x.select(F.explode(cells).alias("c")).select("c.*").where("take").groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("column").orderBy(F.col("v").asc_nulls_first())
    ranked = near.withColumn("upto", F.sum("k").over(w))
    sizes = F.create_map(*[F.lit(z) for c, r in bounds.items() for z in (c, r.n)])[F.col("column")]
    low, high = F.floor((sizes - 1) / 2), F.floor(sizes / 2)
    reach = lambda rank: F.min(F.when((F.col("upto") > rank) & F.col("v").isNotNull(), F.col("v")))
    for r in ranked.groupBy("column").agg(reach(low).alias("a"), reach(high).alias("b")).collect():
        out[r["column"]] = (r.a + r.b) / 2
    return out


def grouped_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, median): exact medians (mean of the two middle values) of any number of groups of any size, in two scans:
    bounds around the middle from a sketch, then counts below them and of the few values between. Null values don't
    count; keys may be null."""
    x = df.select(*[q(c) for c in by], q(value).cast("double").alias("_v")).where("_v is not null")
    bounds = cut(x.groupBy(*by).agg(F.percentile_approx("_v", [0.499, 0.501], 10_000).alias("_e"), F.count(F.lit(1)).alias("_n")))
    named = bounds.withColumnsRenamed({c: f"_b{i}" for i, c in enumerate(by)})
    if bounds.count() <= BROADCAST:  # few groups, on which rows would crowd
        named = F.broadcast(named)
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= q(c).eqNullSafe(F.col(f"_b{i}"))
    near = x.join(named, same).where(F.col("_v") <= F.col("_e")[1])
    near = near.groupBy(*by, "_n", F.when(F.col("_v") >= F.col("_e")[0], F.col("_v")).alias("_w")).agg(F.count(F.lit(1)).alias("_k"))
    upto = near.withColumn("_u", F.sum("_k").over(Window.partitionBy(*by).orderBy(F.col("_w").asc_nulls_first())))
    reach = lambda rank: F.min(F.when((F.col("_u") > rank) & F.col("_w").isNotNull(), F.col("_w")))
    n = F.col("_n")
    return upto.groupBy(*by).agg(((reach(F.floor((n - 1) / 2)) + reach(F.floor(n / 2))) / 2).alias("median"))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value as string, ties to the smallest."""
    counts = value_counts(df.withColumn("_all", F.lit("all")), columns, "_all").where("value is not null")
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("v"))
    return dict.fromkeys(columns) | {r["column"]: r.v for r in best.collect()}


def impute_simple(df: DataFrame, numeric: list[str] = (), categorical: list[str] = (), text: list[str] = ()) -> DataFrame:
    """Missing numbers to the median, categories to the mode, texts to "Unknown text"; adds ``was_imputed``, true where
    any of the columns was null or NaN. Columns without any value stay null."""
    med, mod = medians(df, list(numeric)) if numeric else {}, modes(df, list(categorical)) if categorical else {}
    missing = [number(q(c)).isNull() for c in numeric] + [q(c).isNull() for c in (*categorical, *text)]
    flag = missing[0] if missing else F.lit(False)
    for m in missing[1:]:
        flag = flag | m
    new = {c: F.coalesce(number(q(c)), F.lit(med[c])) for c in numeric}
    new |= {c: F.coalesce(q(c).cast("string"), F.lit(mod[c])) for c in categorical}
    new |= {c: F.coalesce(q(c), F.lit("Unknown text")) for c in text}
    return df.withColumn("was_imputed", flag).withColumns(new)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; constant columns are only centred."""
    stats = df.agg(*[a for i, c in enumerate(columns) for a in (F.avg(number(q(c))).alias(f"m{i}"), F.stddev_pop(number(q(c))).alias(f"s{i}"))]).first()
    return df.withColumns({c: (number(q(c)) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based rank among the sorted distinct values; null stays null. The dictionary is a join, not a driver map."""
    known = df.select(q(column).alias("_v")).where("_v is not null").distinct()
    codes = ranked(known, [F.lit(0)], [F.col("_v")]).select("_v", (F.col("_rank") - 1).cast("int").alias(out))
    return df.join(codes, q(column) == F.col("_v"), "left").drop("_v")


def text_vectors(df: DataFrame, column: str, max_dim: int = 50, share: float = 0.95, buckets: int = 1024, embed: Callable | None = None) -> DataFrame:
    """Adds ``<column>_0 ..``: principal components of hashed TF-IDF that keep ``share`` of the variance, at most
    ``max_dim``. ``embed`` may replace TF-IDF: a function from a list of texts to a matrix, run in Arrow batches."""
    from pyspark.ml.feature import IDF, PCA, HashingTF
    from pyspark.ml.functions import array_to_vector, vector_to_array

    text = F.coalesce(q(column), F.lit("Unknown text"))
    if embed is not None:

        @F.pandas_udf("array<double>")
        def run(texts):
            import pandas as pd

            return pd.Series([list(map(float, v)) for v in embed(list(texts))])

        base = df.withColumn("_f", array_to_vector(run(text)))
    else:
        hashed = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=buckets).transform(df.withColumn("_w", words(text)))
        base = IDF(inputCol="_tf", outputCol="_f").fit(hashed).transform(hashed)
    first = base.select("_f").first()
    if first is None:
        return df
    k = min(max_dim, len(first._f))
    pca = PCA(k=k, inputCol="_f", outputCol="_p").fit(base)
    total, keep = 0.0, 0
    for v in pca.explainedVariance.toArray():
        keep, total = keep + 1, total + v
        if total >= share:
            break
    arr = vector_to_array("_p")
    return pca.transform(base).withColumns({f"{column}_{i}": arr[i] for i in range(keep)}).select(*df.columns, *[f"{column}_{i}" for i in range(keep)])


def was_imputed(columns: list[Column]) -> Column:
    """Whether any of the columns is null."""
    return F.exists(F.array(*[c.isNull() for c in columns]), lambda x: x)
