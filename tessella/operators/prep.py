"""Preparation for modelling: aligned columns, usable targets, numbers in strings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import parse_number
from tessella.functions.types import target_type
from tessella.operators.profile import q, zero_columns
from tessella.operators.split import fold_validation, stratified_split


@dataclass(frozen=True)
class Dataset:
    """One frame with a split column, and what is known about it."""

    df: DataFrame
    target: str
    split: str = "dataset"
    key: str = "row_id"
    sensitive_features: tuple[str, ...] = ()
    columns_of_interest: tuple[str, ...] = ()
    title: str | None = None
    description: str | None = None
    seed: int = 42
    path: str | None = None
    problem_type: str | None = None
    eval_metric: str | None = None
    pos_label: object = None
    extra: dict = field(default_factory=dict)

    def part(self, name: str) -> DataFrame:
        return self.df.where(q(self.split) == name)


def align(splits: dict[str, DataFrame], strict: bool = False) -> dict[str, DataFrame]:
    """Splits reduced to the columns they share, in the order of the first; ``strict``: differing sets are an error."""
    sets = [set(d.columns) for d in splits.values()]
    if not sets:
        raise ValueError("at least one split is needed")
    common = set.intersection(*sets)
    if strict and any(s != common for s in sets):
        raise ValueError("the splits have different columns")
    names = [c for c in next(iter(splits.values())).columns if c in common]
    return {n: d.select(*[q(c) for c in names]) for n, d in splits.items()}


def merge_splits(splits: dict[str, DataFrame], split: str = "dataset") -> DataFrame:
    parts = [d.withColumn(split, F.lit(n)) for n, d in splits.items() if d is not None]
    if not parts:
        raise ValueError("at least one split is needed")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def check_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target {target} is missing")


def drop_zero_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in zero_columns(df) if c not in keep])


def usable_target(df: DataFrame, target: str) -> Column:
    """Not null; for floating types finite as well."""
    t = q(target)
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        return t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    return t.isNotNull()


def numeric_strings(df: DataFrame, columns: list[str], least: float = 0.9) -> list[str]:
    """String columns of which at least ``least`` of all rows, nulls included, parse as numbers; one scan."""
    if not columns:
        return []
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(parse_number(q(c))).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r.n and r[f"p{i}"] >= least * r.n]


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_number(q(c)) for c in columns})


def rarest_class(df: DataFrame, target: str):
    """The class with the fewest rows, ties to the smallest; null without rows."""
    r = df.where(q(target).isNotNull()).groupBy(q(target).alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("t", F.struct("n", "t")).alias("t")).first()
    return r.t if r else None


def positive_label(ds: Dataset, df: DataFrame):
    """The positive label of two classes: the dataset's own if the data hold it, else the rarest class of train."""
    if ds.pos_label is not None and not df.where(q(ds.target) == F.lit(ds.pos_label)).isEmpty():
        return ds.pos_label
    return rarest_class(df.where(q(ds.split) == "train"), ds.target)


def prepare(ds: Dataset) -> Dataset:
    """Validation folded into train, a stratified test split if there is none, problem type, numeric strings decided on
    train and applied to all splits, unusable targets dropped, metric and positive label set."""
    check_target(ds.df, ds.target)
    df = fold_validation(ds.df, ds.split)
    if df.where(q(ds.split) == "test").isEmpty():
        df = stratified_split(df.drop(ds.split), ds.key, ds.target, seed=ds.seed).withColumnRenamed("dataset", ds.split)
    kind = target_type(df, ds.target)
    if kind == "regression" and isinstance(df.schema[ds.target].dataType, (T.StringType, T.DecimalType)):
        df = df.withColumn(ds.target, parse_number(q(ds.target)) if isinstance(df.schema[ds.target].dataType, T.StringType) else q(ds.target).cast("double"))
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (ds.target, ds.split, ds.key)]
    df = coerce_numbers(df, numeric_strings(df.where(q(ds.split) == "train"), strings))
    df = df.where(usable_target(df, ds.target))
    label = positive_label(ds, df) if kind == "binary" else ds.pos_label
    from dataclasses import replace

    return replace(ds, df=df, problem_type=kind, eval_metric="rmse" if kind == "regression" else "f1_weighted", pos_label=label)
