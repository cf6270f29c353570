"""Filling containers of fixed capacity by minimum bin slack.

Items of equal length are interchangeable, so packing works on the histogram of lengths, which has at most
``capacity`` entries however many items there are. For each container the largest remaining length is taken and a
bitset subset-sum over the other available lengths finds the fullest combination with it; the combination is removed as
often as the histogram allows, as it stays the fullest until one of its lengths runs short. The items themselves are
ranked within their length without any global sort (counts per length and hash bucket, then ranks inside buckets) and
look up the container of their rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.session import written

RANKED = 50_000  # items of one length ranked in one task, about


@dataclass
class Pattern:
    """A combination of lengths, used for ``times`` containers."""

    lengths: dict[int, int]
    times: int

    @property
    def filled(self) -> int:
        return sum(n * k for n, k in self.lengths.items())


def fullest(counts: dict[int, int], target: int) -> dict[int, int]:
    """Combination of available lengths with the largest sum up to ``target``."""
    bits, layers = 1, []
    mask = (1 << (target + 1)) - 1
    for n in sorted(counts, reverse=True):
        most = min(counts[n], target // n)
        if most <= 0:
            continue
        layers.append((n, most, bits))
        left, k = most, 1
        while left > 0:  # bounded multiplicity by binary parts
            step = min(k, left)
            bits |= (bits << (n * step)) & mask
            left -= step
            k *= 2
        if bits >> target & 1:
            break
    value, chosen = bits.bit_length() - 1, {}
    for n, most, before in reversed(layers):
        for k in range(most + 1):
            rest = value - k * n
            if rest < 0:
                break
            if before >> rest & 1:
                if k:
                    chosen[n] = k
                value = rest
                break
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up the histogram. Lengths must lie in 1..capacity. After each pattern at least one of its
    lengths is too scarce for it, so there are at most sum(capacity / n) patterns over the lengths n."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        chosen = fullest(rest, capacity - top)
        chosen[top] = chosen.get(top, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        out.append(Pattern(chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each interval, its first container and its items per container."""
    at: dict[int, int] = {}
    parts: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for p in patterns:
        for n, k in p.lengths.items():
            start = at.get(n, 0)
            parts.setdefault(n, []).append((start, container, k))
            at[n] = start + k * p.times
        container += p.times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in parts.items()}


def fill_containers(
    df: DataFrame, key: str, text: str, capacity: int, *, folder: str = tokens.TOKENIZERS, vocabulary: str = tokens.VOCABULARY
) -> DataFrame:
    """(id, part_no, token_start, n_tokens, container_id), one row per item.

    A text beyond the capacity is cut into full parts and a rest; nothing else is split. Texts without tokens (null,
    empty) take no space: they come out with null container. A key in several rows is several items. The result doesn't
    depend on partitions; items with the same key, part and length are alike.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = tokens.sized(df, key, text, folder=folder, vocabulary=vocabulary)
    n_parts = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    items = sized.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part_no")).select(
        "id", "part_no", (F.col("part_no") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("part_no") * capacity).cast("int").alias("n_tokens"),
    )
    items = written(items, "items")  # lengths are read three times; texts are tokenised once
    real = items.where("n_tokens > 0")
    counts = {r.n_tokens: r["count"] for r in real.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    table = slots(minimum_bin_slack(counts, capacity))

    buckets = max(1, -(-max(counts.values(), default=0) // RANKED))
    placed = real.withColumn("bucket", F.pmod(F.xxhash64("id", "part_no"), F.lit(buckets)))
    before = placed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.selectExpr(
        "n_tokens", "bucket",
        "coalesce(sum(n) over (partition by n_tokens order by bucket rows between unbounded preceding and 1 preceding), 0) as first",
    )
    ranked = placed.withColumn("rn", F.expr("row_number() over (partition by n_tokens, bucket order by id, part_no)"))
    ranked = ranked.join(before, ["n_tokens", "bucket"]).withColumn("rank", F.col("first") + F.col("rn") - 1)

    @F.pandas_udf("bigint")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(length), dtype=np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for x in np.unique(n):
            mine = n == x
            start, first, per = table[int(x)]
            i = np.searchsorted(start, r[mine], side="right") - 1
            out[mine] = first[i] + (r[mine] - start[i]) // per[i]
        return pd.Series(out)

    done = ranked.select("id", "part_no", "token_start", "n_tokens", container("n_tokens", "rank").alias("container_id"))
    return done.unionByName(items.where("n_tokens = 0").withColumn("container_id", F.lit(None).cast("bigint")))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers by the tokens left free in them: (slack, containers)."""
    full = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return full.groupBy((F.lit(capacity) - F.col("used")).alias("slack")).agg(F.count(F.lit(1)).alias("containers"))
