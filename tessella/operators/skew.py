"""Joins of a large fact side with a keyed side when single keys may hold much of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond total / HOT_PARTS facts, so there are fewer than HOT_PARTS hot keys, however large the data.
HOT_PARTS = 400
LEAST_HOT = 10_000  # facts below which no key is hot


def hot_keys(dims: DataFrame, key: str, weight: str) -> dict:
    """Hot keys -> number of parts to cut them into; ``weight`` estimates the facts of a row of ``dims``. The list is
    proven to be shorter than ``HOT_PARTS``, so it may go through the driver. ``dims`` is read twice."""
    total = dims.agg(F.sum(weight)).first()[0] or 0
    part = max(LEAST_HOT, -(-total // HOT_PARTS))
    hot: dict = {}
    for r in dims.where(F.col(weight) > part).select(key, weight).collect():
        hot[r[0]] = max(hot.get(r[0], 1), -(-r[1] // part))
    return hot


def join_parts(facts: DataFrame, dims: DataFrame, keys: list[str], hot: dict, spread: str, how: str = "inner") -> DataFrame:
    """Join on ``keys``, the first of which may be in ``hot``: ``dims`` is repeated once per part of a hot key, each
    fact goes to the part of the hash of its ``spread`` column."""
    if not hot:
        return facts.join(dims, keys, how)
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[F.col(keys[0])], F.lit(1))
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def salted_join(facts: DataFrame, dims: DataFrame, keys: list[str], weight: str, spread: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` with ``dims`` (unique ``keys``; ``weight`` estimates a key's number of facts). Hot keys are cut
    into salted parts. ``dims`` is read three times, so it should be cheap to read."""
    return join_parts(facts, dims, keys, hot_keys(dims, keys[0], weight), spread, how)
