"""Mixing sources to target weights.

Weights by temperature: shares are raised to an exponent and normalised, and the exponent is bisected until the weights
are as even as wanted (``like``: the entropy of given weights). Sources that would exceed their repetition limit are
frozen at it, and the exponent is bisected again over the rest, until none exceeds its limit. The shares raised are

- the target shares (the default): the exponent then stays at 1 and every source gets its target, but for those frozen;
- the sources' natural token shares (``base="natural"``): the plain temperature mixture, as even as the targets are.

Realisation: each source's token budget is laid out as whole permutations (blocks) of its texts and one partial block.
A block's order is a seeded hash, so its prefix is found from sums per hash bucket, without a global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.session import cut, written

PREFIX = 20_000  # texts of one hash bucket, about


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares to the exponent, normalised: 1 keeps them, 0 makes them equal. Empty sources stay empty."""
    raised = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(shares: dict[str, float], wanted: float, most: float = 64.0) -> float:
    """Exponent at which the tempered shares have the entropy ``wanted``, which falls as it grows; an end of
    0..``most`` where they can't."""
    low, high = 0.0, most
    if entropy(tempered(shares, low)) <= wanted:
        return low
    if entropy(tempered(shares, high)) >= wanted:
        return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) > wanted else (low, mid)
    return high


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {s: w / total if total else 0.0 for s, w in weights.items()}


def temperature(
    shares: dict[str, float], *, like: dict[str, float], most: dict[str, float]
) -> tuple[float, dict[str, float], set[str]]:
    """(exponent, weights, frozen): ``shares`` tempered to the entropy that ``like`` has over the same sources. ``most``
    is the largest weight of a source within its repetition limit; sources beyond it are frozen there and the rest is
    tempered anew to what is left. Weights add up to 1, or to less where all limits together don't reach it. Sources
    without a share get none."""
    frozen: dict[str, float] = {}
    rest = {s: p for s, p in shares.items() if p > 0}
    exponent = 1.0
    while rest:
        mass = max(0.0, 1 - sum(frozen.values()))
        exponent = bisect_exponent(rest, entropy(normalised({s: like.get(s, 0.0) for s in rest})))
        weights = {s: mass * w for s, w in tempered(rest, exponent).items()}
        over = [s for s, w in weights.items() if w > most.get(s, math.inf) + 1e-12]
        if not over:
            return exponent, {s: 0.0 for s in shares} | frozen | weights, set(frozen)
        for s in over:
            frozen[s] = most[s]
            del rest[s]
    return exponent, {s: 0.0 for s in shares} | frozen, set(frozen)


def plain_source(c: Column) -> Column:
    """Sources without differences of case, outer spaces and hyphens."""
    return F.nullif(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(""))


class Mixture:
    """Plan of a mixture of ``df`` (key, text, source) to ``targets`` (source, target_share, max_repeats).

    A text is a text however often it was delivered: copies count as one, under the source of the copy with the
    smallest key among those of listed sources. Null and empty texts, and texts of sources that aren't listed, are not
    used. ``total`` tokens are aimed at; by default as many as the corpus holds, copies and unlisted sources included.
    ``base`` names the shares that are tempered: "targets" or "natural". ``exponent``, ``weights`` and ``frozen`` (the
    sources at their repetition limit) are what the bisection came to.
    """

    def __init__(
        self, df: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
        total: int | None = None, seed: int = 17, base: str = "targets", folder: str = tokens.TOKENIZERS, vocabulary: str = tokens.VOCABULARY,
    ):
        self.seed = seed
        wanted = targets.select("source", "target_share", "max_repeats").collect()  # the configuration: one row per source
        self.targets = {r.source.strip().lower().replace("-", "_"): float(r.target_share or 0) for r in wanted if r.source}
        self.repeats = {r.source.strip().lower().replace("-", "_"): int(r.max_repeats or 0) for r in wanted if r.source}
        body = F.col(f"`{text}`")
        sized = tokens.sized(
            df, key, text, plain_source(F.col(f"`{source}`")).alias("source"), F.xxhash64(body).alias("d1"), F.xxhash64(body, F.lit(3)).alias("d2"),
            folder=folder, vocabulary=vocabulary,
        )
        sized = written(sized.where("n_tokens > 0"), "sized")
        corpus = sized.agg(F.sum("n_tokens")).first()[0] or 0
        self.total = corpus if total is None else total
        listed = sized.where(F.col("source").isin(list(self.targets))) if self.targets else sized.limit(0)
        first = F.min(F.struct("id", "source", "n_tokens")).alias("f")
        self.texts = cut(listed.groupBy("d1", "d2").agg(first).select("f.*"))
        rows = self.texts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # listed sources only
        self.held = {s: 0 for s in self.targets} | {r.source: r.t for r in rows}
        self.count = {s: 0 for s in self.targets} | {r.source: r.n for r in rows}
        if base not in ("targets", "natural"):
            raise ValueError(f"no such base: {base}")
        held = sum(self.held.values())
        self.natural = {s: t / held if held else 0.0 for s, t in self.held.items()}
        self.exponent, self.weights, self.frozen = temperature(self.targets if base == "targets" else self.natural, like=self.targets, most=self.limits())
        self.budget = {
            s: min(int(round(w * self.total)), self.held[s] * self.repeats[s]) for s, w in self.weights.items()
        }

    def limits(self) -> dict[str, float]:
        return {s: self.held[s] * self.repeats[s] / self.total if self.total else 0.0 for s in self.targets}

    def rows(self) -> DataFrame:
        """(source, id, block, n_tokens, place): one row per use of a text, in order of (block, place) within its
        source. Of the partial block those texts are used whose middle lies within the rest of the budget."""
        plan = {s: divmod(b, self.held[s]) if self.held[s] else (0, 0) for s, b in self.budget.items()}
        if not plan:
            return self.texts.select("source", "id", F.lit(0).alias("block"), "n_tokens", F.lit(0).cast("bigint").alias("place"))
        look = lambda i: F.create_map(*[F.lit(x) for s, p in plan.items() for x in (s, int(p[i]))])[F.col("source")]
        bits = max(0, min(32, math.ceil(math.log2(max(1, max(self.count.values()) / PREFIX)))))
        t = self.texts.withColumn("whole", look(0)).withColumn("rest", look(1)).withColumn("h", F.xxhash64("id", F.lit(self.seed)))
        bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
        t = t.withColumn("bucket", bucket)
        sums = t.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
        sums = sums.selectExpr(
            "source", "bucket",
            "coalesce(sum(s) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0) as before",
        )
        inside = "sum(n_tokens) over (partition by source, bucket order by h, id rows between unbounded preceding and current row)"
        t = t.withColumn("inside", F.expr(inside)).join(sums, ["source", "bucket"])
        partial = (F.col("before") + F.col("inside") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
        uses = F.col("whole") + F.when(partial, 1).otherwise(0)
        used = t.withColumn("uses", uses.cast("int")).where("uses > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
        # the partial block is the last one and keeps the order its prefix was found in
        place = F.when(F.col("block") == F.col("whole"), F.col("h")).otherwise(F.xxhash64("id", F.lit(self.seed), "block"))
        return used.select("source", "id", F.col("block").cast("int").alias("block"), "n_tokens", place.alias("place"))

    def report(self, rows: DataFrame) -> DataFrame:
        """Shares reached, per listed source, those without any text included."""
        spark = rows.sparkSession
        plan = [(s, t, self.repeats[s], self.count[s], self.held[s], self.budget[s]) for s, t in self.targets.items()]
        asked = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, n_texts long, held_tokens long, budget_tokens long")
        got = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), (F.max("block") + 1).alias("repeats"))
        out = asked.join(got, "source", "left").fillna(0, ["tokens", "uses", "repeats"])
        return out.withColumn("share", F.col("tokens") / F.expr("nullif(sum(tokens) over (), 0)"))
