"""Incremental numeric profile of a stream: mergeable sums per window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.profile import number, q


def windowed_profile(stream: DataFrame, time: str, group: str, column: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, group, n, null_count, mean, std, min, max) per tumbling window; works on streams and tables. Rows
    later than the watermark are left out of a stream, rows without a time everywhere."""
    x = number(q(column))
    base = stream.where(q(time).isNotNull()).withColumn("_ts", q(time))
    if stream.isStreaming:  # watermarks need an instant; tables keep local times as they are
        base = base.withColumn("_ts", F.col("_ts").cast("timestamp")).withWatermark("_ts", late)
    return base.groupBy(F.window("_ts", window).alias("w"), q(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("null_count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    ).select(F.col("w.start").alias("window_start"), "group", "n", "null_count", "mean", "std", "min", "max")
