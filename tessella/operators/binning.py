"""Supervised binning: cut points fitted on train, applied to every split."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.types import ASSESSED_NUMERIC
from tessella.operators.profile import number, q


@dataclass(frozen=True)
class Bins:
    """Cut points of a numeric column, or groups of categories."""

    column: str
    cuts: tuple[float, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()

    def label(self) -> Column:
        c = q(self.column)
        if self.groups:
            out = F.lit(None).cast("string")
            for g in self.groups:
                out = F.when(c.cast("string").isin(list(g)), F.lit(", ".join(g))).otherwise(out)
            return F.when(c.isNotNull(), F.coalesce(out, F.lit("other")))
        x, edges = number(c), [-math.inf, *self.cuts, math.inf]
        out = F.lit(None).cast("string")
        for a, b in zip(edges, edges[1:]):
            out = F.when((x >= a) & (x < b) if b < math.inf else x >= a, F.lit(f"[{a:g}, {b:g})")).otherwise(out)
        return out


def _entropy(counts: list[float]) -> float:
    """Weighted entropy of a bin: its rows times the entropy of their classes."""
    n = sum(counts)
    return -sum(c * math.log(c / n) for c in counts if c > 0)


def _merge(cells: list[list[float]], most: int, least: int) -> list[int]:
    """Dynamic programme over ordered cells (rows by class): starts of the bins with the least weighted entropy, a bin
    more only if it gains at least 1 % of the entropy of the whole."""
    k = len(cells)
    upto = [[0.0] * len(cells[0])]
    for cell in cells:
        upto.append([a + b for a, b in zip(upto[-1], cell, strict=True)])
    cost = [[_entropy([b - a for a, b in zip(upto[i], upto[j], strict=True)]) if i < j else 0.0 for j in range(k + 1)] for i in range(k)]
    best = [[math.inf] * (k + 1) for _ in range(most + 1)]
    back = [[0] * (k + 1) for _ in range(most + 1)]
    best[0][0] = 0.0
    for m in range(1, most + 1):
        for j in range(m, k + 1):
            for i in range(m - 1, j):
                c = best[m - 1][i] + cost[i][j]
                if c < best[m][j] - 1e-12:
                    best[m][j], back[m][j] = c, i
    whole = cost[0][k]
    m = min(least, k)
    while m < min(most, k) and best[m][k] - best[m + 1][k] > 0.01 * whole > 0:
        m += 1
    starts, j = [], k
    while m:
        j = back[m][j]
        starts.append(j)
        m -= 1
    return sorted(starts)[1:]


def fit_bins(
    df: DataFrame, column: str, target: str, event=None, *, classes: list | None = None, max_bins: int = 20, min_bins: int = 2, prebins: int = 50
) -> Bins | None:
    """Bins that separate the target best: quantile pre-bins (numbers), or categories in order of event rate, merged by
    a dynamic programme over at most ``prebins`` cells on the driver. The target is an ``event`` against the rest, one
    of several ``classes``, or, without either, a number above its mean against the rest. Of more than ``prebins``
    categories the rarer ones are one cell, "other". None if there is nothing to separate."""
    y = q(target)
    if classes is not None:
        marks = [y.cast("string") == F.lit(str(c)) for c in classes]
    elif event is not None:
        marks = [y == F.lit(event), y != F.lit(event)]
    else:
        mean = df.agg(F.avg(number(y))).first()[0]
        marks = [number(y) > F.lit(mean), number(y) <= F.lit(mean)]
    base = df.where(y.isNotNull())
    sums = [F.count_if(m).alias(f"n{i}") for i, m in enumerate(marks)]
    held = lambda r: [r[f"n{i}"] for i in range(len(marks))]
    if isinstance(df.schema[column].dataType, ASSESSED_NUMERIC):
        x = number(q(column))
        edges = base.agg(F.percentile_approx(x, [i / prebins for i in range(1, prebins)], 10_000)).first()[0]
        if not edges:
            return None
        edges = sorted(set(edges))
        cell = F.size(F.filter(F.array(*[F.lit(float(v)) for v in edges]), lambda v: v <= x))
        rows = base.where(x.isNotNull()).groupBy(cell.alias("c")).agg(*sums).orderBy("c").collect()
        if len(rows) < 2:
            return None
        starts = _merge([held(r) for r in rows], max_bins, min_bins)
        return Bins(column, cuts=tuple(float(edges[rows[s].c - 1]) for s in starts))
    c = q(column).cast("string")
    rates = base.where(c.isNotNull()).groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = rates.orderBy(F.col("n").desc(), "c").limit(prebins).collect()  # rarer categories are "other"
    if len(rows) < 2:
        return None
    first = max(range(len(marks)), key=lambda i: (sum(r[f"n{i}"] for r in rows), -i)) if classes is not None else 0
    rows = sorted(rows, key=lambda r: (r[f"n{first}"] / r.n, r.c))
    starts = [0, *_merge([held(r) for r in rows], max_bins, min_bins), len(rows)]
    return Bins(column, groups=tuple(tuple(sorted(r.c for r in rows[a:b])) for a, b in zip(starts, starts[1:])))


def auto_bin(train: DataFrame, others: list[DataFrame], columns: list[str], target: str, event=None, *, classes: list | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``<column>_bin`` on the training data and on other frames, the cut points fitted on the training data alone, so
    that a bin means the same everywhere."""
    bins = [fit_bins(train, c, target, event, classes=classes) for c in columns]
    return bin_columns(train, bins), [bin_columns(d, bins) for d in others]


def bin_columns(df: DataFrame, bins: list[Bins | None]) -> DataFrame:
    """Adds ``<column>_bin``; missing values have no bin."""
    return df.withColumns({f"{b.column}_bin": b.label() for b in bins if b is not None})


def quantile_bins(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(bin, low, high, count) between exact nearest-rank quantiles; equal edges collapse."""
    from tessella.operators.profile import nearest_quantiles

    one = df.select(F.lit("all").alias("_all"), number(q(column)).alias("x")).where("x is not null")
    probs = tuple(i / k for i in range(1, k))
    edges = sorted({r.value for r in nearest_quantiles(one, ["x"], "_all", probs).collect()})  # k - 1 rows
    cell = F.size(F.filter(F.array(*[F.lit(float(v)) for v in edges]), lambda v: v <= F.col("x"))) if edges else F.lit(0)
    return one.groupBy(cell.alias("bin")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("count"))
