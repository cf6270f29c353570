"""Worst slices: conjunctions of feature values where a model loses most."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.profile import q


def find_slices(df: DataFrame, features: list[str], error: str, *, alpha: float = 0.95, k: int = 1, min_support: int = 1, max_level: int | None = None) -> DataFrame:
    """(slice, level, n, avg_error, score): the ``k`` best slices by alpha (mean error / overall mean - 1) - (1 - alpha)
    (rows / slice rows - 1), ties by name. Levels are enumerated one by one, up to all features unless ``max_level`` is given; a level only extends slices of the level
    before that have the support and a score above 0 at its best, so pruning loses no top slice of positive score.
    Missing values are the value "missing"; rows without error take no part."""
    base = df.where(q(error).isNotNull()).select(q(error).cast("double").alias("e"), *[F.concat(F.lit(f"{c}="), F.coalesce(q(c).cast("string"), F.lit("missing"))).alias(c) for c in features])
    total = base.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("m")).first()
    schema = "slice string, level int, n bigint, avg_error double, score double"
    if not total.n or not total.m:
        return df.sparkSession.createDataFrame([], schema)

    def score(n, m):
        return F.lit(alpha) * (m / F.lit(total.m) - 1) - F.lit(1 - alpha) * (F.lit(total.n) / n - 1)

    out = None
    alive = None
    for level in range(1, min(max_level or len(features), len(features)) + 1):
        sets = list(combinations(features, level))
        cells = F.array(*[F.struct(F.lit(",".join(s)).alias("cols"), F.concat_ws(" & ", *[q(c) for c in s]).alias("slice"), F.array(*[F.concat_ws(" & ", *[q(c) for c in sub]) for sub in combinations(s, level - 1)]).alias("parents")) for s in sets])
        rows = base.select("e", F.explode(cells).alias("c")).select("e", "c.*")
        g = rows.groupBy("cols", "slice").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("avg_error"), F.max("e").alias("worst"), F.first("parents").alias("parents"))
        g = g.where(F.col("n") >= min_support)
        if alive is not None:
            up = g.select("cols", "slice", F.explode("parents").alias("p")).join(alive, F.col("p") == F.col("_p"))
            g = g.join(up.groupBy("cols", "slice").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == level), ["cols", "slice"], "left_semi")
        # the best any refinement can reach: all its rows as bad as the worst one, and as many rows as now
        alive = g.where(score(F.col("n"), F.col("worst")) > 0).select(F.col("slice").alias("_p")).distinct()
        found = g.select("slice", F.lit(level).alias("level"), "n", "avg_error", score(F.col("n"), F.col("avg_error")).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out.orderBy(F.col("score").desc(), "slice").limit(k)
