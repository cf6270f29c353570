"""Column statistics per split as tidy tables.

All columns of a kind share one scan; distinct counts and category counts come from one unpivoted count. The exact
nearest-rank quantiles need two scans: sketched bounds first, then counts below the bounds and the few values between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import clean_text, words
from tessella.session import cut

PROBS = (0.25, 0.5, 0.75)
BROADCAST = 100_000  # bounds (40 bytes each) up to which they are broadcast


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def number(c: Column) -> Column:
    """As double, NaN taken for null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation, null if either side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def tidy(df: DataFrame, columns: list[str], aggs, by: str) -> DataFrame:
    """``aggs(column name) -> named aggregates``, all in one pass, one row per (by, column)."""
    wide = df.groupBy(q(by).alias(by)).agg(*[F.struct(*aggs(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("s")) for i, c in enumerate(columns)])
    return wide.select(by, F.explode(rows).alias("r")).select(by, "r.column", "r.s.*")


def value_counts(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, column, value, count) with values as strings, null among them; NaN counts as null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in columns])
    long = df.select(q(by).alias(by), F.explode(cells).alias("c")).select(by, "c.*")
    return long.groupBy(by, "column", "value").agg(F.count(F.lit(1)).alias("count"))


def _text(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    return (F.when(~F.isnan(q(c)), q(c)) if kind in ("double", "float") else q(c)).cast("string")


def distinct_counts(counts: DataFrame, by: str) -> DataFrame:
    """(by, column, n_unique of non-null values, null_count) of value counts."""
    return counts.groupBy(by, "column").agg(F.count("value").alias("n_unique"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("null_count"))


def num_profile(df: DataFrame, columns: list[str], by: str, exact_distinct: bool = True) -> DataFrame:
    """Mean, sample std, population excess kurtosis and skewness, range, distinct count (missing is one value) and
    missing count per (by, column). Null and NaN are missing. Columns without a value have null statistics, constant
    ones null kurtosis and skewness."""

    def aggs(c):
        x = number(q(c))
        more = [] if exact_distinct else [F.approx_count_distinct(x, 0.01).alias("n_unique")]
        return [
            F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), number(F.kurtosis(x)).alias("kurtosis"), number(F.skewness(x)).alias("skewness"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("null_count"), *more,
        ]

    out = tidy(df, columns, aggs, by)
    if exact_distinct:
        seen = distinct_counts(value_counts(df, columns, by), by).select(F.col(by).alias("_by"), F.col("column").alias("_c"), "n_unique")
        out = out.join(seen, out[by].eqNullSafe(F.col("_by")) & (F.col("column") == F.col("_c")), "left").drop("_by", "_c")
    return out.withColumn("n_unique", F.coalesce("n_unique", F.lit(0)) + F.when(F.col("null_count") > 0, 1).otherwise(0))


def nearest_quantiles(df: DataFrame, columns: list[str], by: str, probs: tuple[float, ...] = PROBS, accuracy: int = 10_000) -> DataFrame:
    """(by, column, prob, value): the value of rank round-half-up((n - 1) * prob) among the sorted non-missing values.

    Scan 1 sketches bounds around each rank (rank error at most n / accuracy), scan 2 counts what lies below them and
    collects the values between, so only about 4 n / accuracy values per quantile are ever ranked."""
    widths = ((10_000, 2.0 / accuracy), (500, 0.01), (0, 1.0))  # rows from which a slack covers two ranks and the error
    bound = lambda p, s: min(1.0, max(0.0, p + s))
    edges = sorted({bound(p, s) for p in probs for _, w in widths for s in (-w, w)})

    def first(c):
        x = number(q(c))
        return [F.percentile_approx(x, [float(e) for e in edges], accuracy).alias("edges"), F.count(x).alias("n")]

    at = {e: i for i, e in enumerate(edges)}

    def edge(p, sign):
        pick = [F.when(F.col("n") >= least, F.col("edges")[at[bound(p, sign * w)]]) for least, w in widths]
        return F.coalesce(*pick)

    spans = F.array(*[
        F.struct(F.lit(p).alias("prob"), edge(p, -1).alias("lo"), edge(p, 1).alias("hi"),
                 F.floor((F.col("n") - 1) * F.lit(p) + F.lit(0.5)).cast("bigint").alias("rank"))
        for p in probs
    ])
    bounds = tidy(df, columns, first, by).where("n > 0").select(F.col(by).alias("_by"), "column", F.explode(spans).alias("s")).select("_by", "column", "s.*")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(q(c)).alias("x")) for c in columns])
    long = df.select(q(by).alias(by), F.explode(cells).alias("c")).select(by, "c.*").where("x is not null")
    bounds = cut(bounds.withColumnRenamed("column", "_c"))
    if bounds.count() <= BROADCAST:  # a lookup, as there are few groups and rows would crowd on them
        bounds = F.broadcast(bounds)
    joined = long.join(bounds, q(by).eqNullSafe(F.col("_by")) & (F.col("column") == F.col("_c")) & (F.col("x") <= F.col("hi")))
    near = joined.groupBy(by, "column", "prob", "rank", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    # null (what lies below) sorts first; cumulative counts give ranks
    seen = F.expr(f"sum(k) over (partition by `{by}`, column, prob order by v nulls first)")
    found = near.withColumn("upto", seen).where((F.col("upto") > F.col("rank")) & F.col("v").isNotNull())
    return found.groupBy(by, "column", "prob").agg(F.min("v").alias("value"))


def cat_profile(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    return distinct_counts(value_counts(df, columns, by), by)


def txt_profile(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Lengths of non-empty texts, words per text (all texts, blank ones have none), distinct and missing count."""

    def aggs(c):
        t = q(c).cast("string")
        n = F.when(t != "", F.length(t))
        return [
            F.avg(n).alias("mean_char_length"), F.when(F.count(n) > 1, F.stddev_samp(n)).otherwise(F.lit(0.0)).alias("std_char_length"),
            F.min(n).alias("min_char_length"), F.max(n).alias("max_char_length"), F.avg(F.when(t.isNotNull(), F.size(words(t)))).alias("mean_word_count"),
        ]

    seen = cat_profile(df, columns, by).select(F.col(by).alias("_by"), F.col("column").alias("_c"), "n_unique", "null_count")
    out = tidy(df, columns, aggs, by)
    return out.join(seen, out[by].eqNullSafe(F.col("_by")) & (F.col("column") == F.col("_c")), "left").drop("_by", "_c")


def top_words(df: DataFrame, columns: list[str], by: str, k: int = 10) -> DataFrame:
    """(by, column, rank, word, count): the most frequent words of the cleaned texts, ties by word."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), clean_text(q(c).cast("string")).alias("t")) for c in columns])
    long = df.select(q(by).alias(by), F.explode(cells).alias("c")).select(by, "c.column", F.explode(F.split("c.t", " ")).alias("word"))
    counts = long.where("word <> ''").groupBy(by, "column", "word").agg(F.count(F.lit(1)).alias("count"))
    rank = F.expr(f"row_number() over (partition by `{by}`, column order by count desc, word)")
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def zero_columns(df: DataFrame) -> list[str]:
    """Columns whose only value is 0 or null, in one scan; the others stay, constant ones too."""
    kinds = {c: t for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant", "binary"))}
    if not kinds:
        return []
    aggs = []
    for i, c in enumerate(kinds):
        aggs += [F.min(q(c)).cast("string").alias(f"a{i}"), F.max(q(c)).cast("string").alias(f"b{i}"), F.count(q(c)).alias(f"n{i}")]
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    zero = lambda c, v: (kinds[c] in numeric or kinds[c].startswith("decimal")) and v is not None and float(v) == 0
    out = []
    for i, c in enumerate(kinds):
        constant = r[f"a{i}"] == r[f"b{i}"]
        if r.n and (r[f"n{i}"] == 0 or (r[f"n{i}"] == r.n and constant and zero(c, r[f"a{i}"]))):
            out.append(c)
    return out


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equi-width histogram (bin, low, high, count) of the non-missing finite values."""
    x = number(q(column))
    real = df.select(x.alias("x")).where("x is not null and abs(x) < double('infinity')")
    ends = real.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    binned = real.join(F.broadcast(ends)).select(  # one row of bounds
        "a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).cast("int").alias("bin")
    )
    step = (F.col("b") - F.col("a")) / bins
    return binned.groupBy("bin", "a", "b").agg(F.count(F.lit(1)).alias("count")).select(
        "bin", (F.col("a") + F.col("bin") * step).alias("low"), (F.col("a") + (F.col("bin") + 1) * step).alias("high"), "count"
    )
