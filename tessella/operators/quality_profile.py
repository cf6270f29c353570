"""Column-level data quality profile with mergeable states and checks against earlier loads.

Checks are declared as data (``ColumnRule``); they are compiled into ONE shared aggregate over an unpivoted scan:

1. records are made unique by key (one narrow shuffle: key, load and the profiled columns only);
2. the columns are unpivoted and counted by (load, column, value), pre-aggregated map-side, so a load or value that
   holds a third of all rows spreads over tasks;
3. the value counts fold into one *state* per (load, column): counts, exact sums, range, violation counts and a
   distinct-count sketch. States merge (``merge_states``), so partitions of a load can be profiled apart and added.
   Sums are kept as integers per band of magnitude, so mean and deviation are those of the exact sums in any order,
   whatever the offset of the values is.

Null and NaN both count as null. Infinite values are values, and lie outside any range.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnRule:
    column: str
    dformat: str  # num, cat or txt
    min_value: float | None = None
    max_value: float | None = None
    value_pattern: str | None = None
    value_list: tuple[str, ...] | None = None


#: A number of band b is a whole multiple of 2 ** (BAND * b - 53), and that multiple (its limb) has 61 bits at most.
BAND = 8
#: What adds over disjoint sets of rows.
ADDS = ("row_count", "null_count", "number_count", "infinite", "out_of_range", "pattern_misses", "list_misses")
SUMS = ("limbs", "high2", "cross", "low2")


def rules_from(df: DataFrame) -> list[ColumnRule]:
    """Read rules from a configuration table with one row per profiled column."""
    rows = df.select("column_name", "dformat", "min_value", "max_value", "value_pattern", "value_list").collect()
    return sorted(
        (
            ColumnRule(r[0], r[1] or "txt", r[2], r[3], r[4], tuple(r[5]) if r[5] is not None else None)
            for r in rows
            if r[0] is not None
        ),
        key=lambda r: r.column,
    )


def _chosen(rules: list[ColumnRule], pick) -> Column:
    """CASE over the column name with one literal per rule."""
    out = F.lit(None)
    for r in rules:
        value = pick(r)
        if value is not None:
            out = F.when(F.col("column_name") == r.column, value).otherwise(out)
    return out


def value_counts(df: DataFrame, rules: list[ColumnRule], load: str, key: str | None) -> DataFrame:
    """Counts by (load_id, column_name, value): ``text`` holds cat and txt values, ``number`` num values; both null
    for null and NaN. Columns of a rule that the data lack are left out; without any column there are no counts."""
    have = {c: t for c, t in df.dtypes}
    rules = [r for r in rules if r.column in have]
    if not rules:
        load_type = df.schema[load].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"load_id {load_type}, column_name string, text string, number double, n bigint")
    cells = []
    for r in rules:
        c = F.col(f"`{r.column}`")
        if r.dformat == "num":
            d = c.cast("double")
            cells.append((F.lit(None).cast("string"), F.when(~F.isnan(d), d)))
        else:
            cells.append((F.when(~F.isnan(c), c).cast("string") if have[r.column] in ("double", "float") else c.cast("string"), F.lit(None).cast("double")))
    narrow = df.select(
        F.col(f"`{load}`").alias("load_id"),
        *([F.col(f"`{key}`").alias("_key")] if key else []),
        *[x.alias(f"{kind}{i}") for i, cell in enumerate(cells) for kind, x in zip("td", cell, strict=True)],
    )
    if key:
        narrow = narrow.dropDuplicates(["load_id", "_key"])
    names = ", ".join(f"'{r.column}', t{i}, d{i}" for i, r in enumerate(rules))
    long = narrow.select("load_id", F.expr(f"stack({len(rules)}, {names}) as (column_name, text, number)"))
    return long.groupBy("load_id", "column_name", "text", "number").agg(F.count(F.lit(1)).alias("n"))


def states(counts: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """One mergeable state per (load_id, column_name)."""
    x, n = F.col("number"), F.col("n")
    real = F.coalesce(F.col("text").isNotNull() | x.isNotNull(), F.lit(False))
    low = _chosen(rules, lambda r: F.lit(float(r.min_value)) if r.min_value is not None else None).cast("double")
    high = _chosen(rules, lambda r: F.lit(float(r.max_value)) if r.max_value is not None else None).cast("double")
    fits = _chosen(
        rules, lambda r: F.col("text").rlike(rf"\A(?:{r.value_pattern})\z") if r.value_pattern is not None else None
    ).cast("boolean")
    listed = _chosen(
        rules,
        lambda r: F.lower(F.trim("text")).isin([v.strip().lower() for v in r.value_list]) if r.value_list else None,
    ).cast("boolean")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    finite = F.abs(x) < float("inf")
    band = F.when(finite, F.when(x == 0, 0).otherwise(F.floor(F.log2(F.abs(x)) / BAND))).cast("int")
    half = F.pow(F.lit(2.0), F.col("band") * (-BAND // 2))  # twice, as the whole power may not be a double
    limb, high_part = F.col("limb"), F.shiftright("limb", 31)
    low_part = limb - high_part * 2**31
    times = lambda v: F.sum(v.cast("decimal(19,0)") * n.cast("decimal(19,0)"))
    banded = counts.withColumn("band", band).withColumn("limb", F.when(finite, x * half * half * 2.0**53).cast("bigint"))
    return _folded(
        banded.groupBy("load_id", "column_name", "band").agg(
            F.sum(n).alias("row_count"),
            total(~real).alias("null_count"),
            F.count(F.when(real, 1)).alias("n_unique"),  # a value is in one band
            F.hll_sketch_agg(F.when(real, F.coalesce("text", x.cast("string")))).alias("sketch"),
            F.sum(F.when(x.isNotNull(), n)).alias("number_count"),
            F.sum(F.when(~finite, x)).alias("infinite"),
            times(limb).alias("limbs"),
            times(high_part * high_part).alias("high2"),
            times(high_part * low_part).alias("cross"),
            times(low_part * low_part).alias("low2"),
            F.min(x).alias("min_value"),
            F.max(x).alias("max_value"),
            total((x < low) | (x > high)).alias("out_of_range"),
            total(~fits).alias("pattern_misses"),
            total(~listed).alias("list_misses"),
        ),
        ["load_id", "column_name"],
        F.sum("n_unique").alias("n_unique"),
    )


def _folded(bands: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Bands put together; ``moments`` lists the sums of each."""
    sums = F.when(F.col("band").isNotNull(), F.struct("band", *SUMS))
    return bands.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ADDS],
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.hll_union_agg("sketch").alias("sketch"),
        F.collect_list(sums).alias("moments"),
        *more,
    )


def merge_states(parts: DataFrame, by: list[str]) -> DataFrame:
    """Add states of partitions or of many loads. ``n_unique`` becomes the sketch's estimate, as exact distinct
    counts don't add; everything else stays exact."""
    bands = parts.select("*", F.posexplode_outer("moments").alias("place", "moment"))
    once = F.coalesce("place", F.lit(0)) == 0
    merged = bands.groupBy(*by, F.col("moment.band").alias("band")).agg(
        *[F.sum(F.when(once, F.col(c))).alias(c) for c in ADDS],
        *[F.sum(f"moment.{c}").cast("decimal(38,0)").alias(c) for c in SUMS],
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.hll_union_agg("sketch").alias("sketch"),
    )
    return _folded(merged, by).withColumn("n_unique", F.hll_sketch_estimate("sketch"))


def mean_and_deviation(n: int | None, infinite: float | None, moments) -> tuple[float | None, float | None]:
    """Mean and sample standard deviation of the exact sums of a state, each rounded once. An infinite value makes the
    mean infinite, or NaN beside one of the other sign, and the deviation NaN."""
    if not n:
        return None, None
    if infinite is not None:
        return infinite, float("nan") if n > 1 else None
    one = two = Fraction(0)
    for band, limbs, high2, cross, low2 in moments:
        unit = Fraction(2) ** (BAND * band - 53)
        one += int(limbs) * unit
        two += ((int(high2) << 62) + (int(cross) << 32) + int(low2)) * unit * unit
    mean = float(one / n)
    if n == 1:
        return mean, None
    var = (two - one * one / n) / (n - 1)
    shift = max(0, 66 - (var.numerator.bit_length() - var.denominator.bit_length()) // 2)  # for a root of 64 bits or more
    root = isqrt((var.numerator << 2 * shift) // var.denominator)
    return mean, float(Fraction(root, 1 << shift))


def metrics(state: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """Readable figures of a state: rates, mean and sample standard deviation."""
    figures = F.udf(lambda *state: mean_and_deviation(*state), "mean double, std double")
    return (
        state.withColumn("null_rate", F.col("null_count") / F.col("row_count"))
        .withColumn("_figures", figures("number_count", "infinite", "moments"))
        .withColumn("mean", F.col("_figures.mean"))
        .withColumn("std", F.col("_figures.std"))
        .drop("_figures", "number_count", "infinite", "moments", "sketch")
    )


def js_divergence(counts: DataFrame, prev: DataFrame, columns: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (nats) between the shares of non-null values of each load and of the load before.
    Loads without values on either side give no row."""
    c = counts.where(F.col("column_name").isin(columns) & F.col("text").isNotNull())
    here = c.select("load_id", "column_name", "text", F.col("n").alias("p"), F.lit(0).cast("bigint").alias("q"))
    before = (
        c.withColumnRenamed("load_id", "prev_load_id")
        .join(prev.where("prev_load_id is not null"), "prev_load_id")
        .select("load_id", "column_name", "text", F.lit(0).cast("bigint").alias("p"), F.col("n").alias("q"))
    )
    cells = here.unionByName(before).groupBy("load_id", "column_name", "text").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    # JS = 1/2 sum p ln(p/m) + 1/2 sum q ln(q/m); the totals are needed first, as one small aggregate
    totals = cells.groupBy("load_id", "column_name").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).where("tp > 0 and tq > 0")
    p, q = F.col("p") / F.col("tp"), F.col("q") / F.col("tq")
    m = (p + q) / 2
    part = lambda v: F.when(v > 0, v * F.ln(v / m)).otherwise(0.0)
    return (
        cells.join(totals, ["load_id", "column_name"])
        .groupBy("load_id", "column_name")
        .agg(F.sum((part(p) + part(q)) / 2).alias("js"))
    )


def findings(
    state: DataFrame,
    counts: DataFrame,
    loads: DataFrame,
    reported: DataFrame | None,
    rules: list[ColumnRule],
    *,
    null_shift: float = 0.15,
    distinct_ratio: float = 3.0,
    mean_z: float = 1.0,
    js_limit: float = 0.2,
    range_columns: list[str] | None = None,
    js_columns: list[str] | None = None,
    pattern_columns: list[str] | None = None,
) -> DataFrame:
    """Rows (load_id, column_name, check_name) of checks that fail. A load without predecessor, or whose predecessor
    has no rows, takes part only in the checks that need none. Two empty distinct counts are no change."""
    m = metrics(state, rules)
    prev = loads.select("load_id", "prev_load_id").dropDuplicates(["load_id"])
    before = m.select(
        F.col("load_id").alias("prev_load_id"),
        "column_name",
        F.col("null_rate").alias("b_null"),
        F.col("n_unique").alias("b_unique"),
        F.col("mean").alias("b_mean"),
        F.col("std").alias("b_std"),
    )
    joined = m.join(prev, "load_id", "left").join(before, ["prev_load_id", "column_name"], "left")
    num = range_columns if range_columns is not None else [r.column for r in rules if r.dformat == "num"]
    pat = pattern_columns if pattern_columns is not None else [r.column for r in rules if r.value_pattern]
    cat = js_columns if js_columns is not None else [r.column for r in rules if r.dformat == "cat"]
    most, least = F.greatest("n_unique", "b_unique"), F.least("n_unique", "b_unique")
    known = F.col("b_unique").isNotNull()
    flags = {
        "null_rate": F.abs(F.col("null_rate") - F.col("b_null")) > null_shift,
        "distinct_count": known & (most > 0) & (most >= distinct_ratio * least),
        "range": F.col("column_name").isin(num) & (F.col("out_of_range") > 0),
        "mean_drift": F.col("column_name").isin(num)
        & (F.abs(F.col("mean") - F.col("b_mean")) / (F.col("b_std") + 1e-8) > mean_z),
        "pattern": F.col("column_name").isin(pat) & (F.col("pattern_misses") > 0),
    }
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))
    out = joined.select("load_id", "column_name", F.explode(named).alias("check_name"))
    js = js_divergence(counts, prev, cat).where(F.col("js") > js_limit)
    out = out.unionByName(js.select("load_id", "column_name", F.lit("js_divergence").alias("check_name")))
    if reported is not None:
        said = reported.groupBy("load_id", "column_name").agg(
            F.array_compact(F.collect_set("null_count")).alias("r_null"),
            F.array_compact(F.collect_set("n_unique")).alias("r_unique"),
        )
        both = said.join(m.select("load_id", "column_name", "null_count", "n_unique"), ["load_id", "column_name"])
        wrong = F.array_compact(
            F.array(
                F.when(F.exists("r_null", lambda x: x != F.col("null_count")), F.lit("reported_null_count")),
                F.when(F.exists("r_unique", lambda x: x != F.col("n_unique")), F.lit("reported_n_unique")),
            )
        )
        out = out.unionByName(both.select("load_id", "column_name", F.explode(wrong).alias("check_name")))
    return out


def control_limits(
    metric_rows: DataFrame, series: str, order: list[str], sigmas: float = 3.0, least: int = 5, span: int = 30
) -> DataFrame:
    """Shewhart limits: each metric of a load against mean +- ``sigmas`` sample deviations of up to ``span`` earlier
    loads of its series. Needs columns ``column_name, metric, value``. Fewer than ``least`` earlier loads: no verdict.
    """
    w = Window.partitionBy(series, "column_name", "metric").orderBy(*order).rowsBetween(-span, -1)
    centre, spread = F.avg("value").over(w), F.stddev_samp("value").over(w)
    return (
        metric_rows.withColumn("history", F.count("value").over(w))
        .withColumn("lower", centre - sigmas * spread)
        .withColumn("upper", centre + sigmas * spread)
        .withColumn(
            "anomalous",
            F.when(F.col("history") >= least, (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))),
        )
    )
