"""Feature typing: numeric, categorical or text, inferred per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: The numeric set of group assessment and binning leaves decimals out.
ASSESSED_NUMERIC = tuple(t for t in NUMERIC if t is not T.DecimalType)
NOMINAL_TARGET = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
UNSUPPORTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
RSD = 0.02  # relative error of the distinct-count sketch


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_text(c: Column) -> Column:
    """Aggregate: a string column with some characters on average."""
    return F.coalesce(F.avg(F.length(c)) > 0, F.lit(False))


def check_supported(df: DataFrame, columns: list[str]) -> None:
    bad = [c for c in columns if isinstance(df.schema[c].dataType, UNSUPPORTED)]
    if bad:
        raise ValueError(f"columns of nested or binary type can't be profiled: {bad}")


def distinct_ratio_is_below(df: DataFrame, columns: list[str], threshold: float) -> dict[str, bool]:
    """Whether distinct values (null is one) / rows is below the threshold. One scan with sketches decides all columns
    that are clear of the threshold; only the doubtful ones are counted exactly. An empty table: never below."""
    q = lambda c: F.col(f"`{c}`")
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(q(c), RSD).alias(f"u{i}") for i, c in enumerate(columns)],
        *[F.max(q(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(columns)],
    ).first()
    if not first.n:
        return dict.fromkeys(columns, False)
    out, doubtful = {}, []
    for i, c in enumerate(columns):
        seen = first[f"u{i}"] + first[f"z{i}"]
        if abs(seen - threshold * first.n) <= max(3, 5 * RSD * seen):
            doubtful.append((i, c))
        out[c] = seen < threshold * first.n
    if doubtful:
        # by (column, value), combined before the shuffle; one aggregate of several distinct counts would copy each row per column
        cells = F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("v")) for i, c in doubtful])
        pairs = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").distinct()
        exact = {r.i: r["count"] for r in pairs.groupBy("i").count().collect()}
        for i, c in doubtful:
            out[c] = (exact.get(i, 0) + first[f"z{i}"]) / first.n < threshold
    return out


def feature_types(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.02, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """``cat`` if few distinct values, else ``num`` for numeric types, else ``txt``. Overrides win column by column."""
    columns = columns or df.columns
    check_supported(df, columns)
    known = {c: t for c, t in (overrides or {}).items() if c in columns}
    few = distinct_ratio_is_below(df, [c for c in columns if c not in known], threshold) if len(known) < len(columns) else {}
    return {c: known.get(c) or ("cat" if few[c] else "num" if is_numeric(df.schema[c].dataType) else "txt") for c in columns}


def target_type(df: DataFrame, target: str) -> str:
    """binary for two values, multiclass for nominal types with fewer than 20, else regression. Null is no value."""
    nominal = isinstance(df.schema[target].dataType, NOMINAL_TARGET)
    few = df.select(F.col(f"`{target}`").alias("t")).where("t is not null").distinct().limit(20).count()  # 20 decide
    return "binary" if few == 2 else "multiclass" if nominal and few < 20 else "regression"
