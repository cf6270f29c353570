"""Missing values filled from records of the same group by a mixed Gaussian-categorical mixture.

Model: every group (a device) belongs to one latent component k. Its categorical fields are drawn from theta_k; the
group's mean of numeric field j is N(mu_kj, tau_kj^2) and its rows scatter around that mean with a within-group
covariance shared by all groups, time among the fields, so that a fill follows the record's own time and the fields
it does have. All of pi, mu, tau, theta and the variances within groups are re-estimated in each iteration.

Fitting is expectation-maximisation on *sufficient statistics per group* (counts, sums, cross sums, category counts).
They are aggregated once over all rows with map-side combination; an iteration then only reads the table of groups and
returns K rows of sums. Nothing is sampled, and only K x fields numbers come to the driver.

A numeric cell is filled with its conditional expectation, a categorical one with the mode of its posterior; marks
tell which cells were filled. A cell is filled only if its group has a real value in that column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import salted_join
from tessella.session import cut


@dataclass(frozen=True)
class NumericField:
    name: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class CategoryField:
    name: str
    values: tuple[str, ...]


def real_number(c: Column, spec: NumericField) -> Column:
    """The value as double if it is real: not null, not NaN, within the range."""
    d = c.cast("double")
    ok = d.isNotNull() & ~F.isnan(d)
    if spec.low is not None:
        ok = ok & (d >= float(spec.low))
    if spec.high is not None:
        ok = ok & (d <= float(spec.high))
    return F.when(ok, d)


def real_category(c: Column, spec: CategoryField) -> Column:
    """The listed spelling if the value is listed, ignoring case and outer spaces."""
    named = {v.strip().lower(): v for v in reversed(spec.values)}
    if not named:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.lower(F.trim(c))]


@dataclass
class MixtureModel:
    pi: np.ndarray  # K
    mu: np.ndarray  # K x J
    tau2: np.ndarray  # K x J
    sigma2: np.ndarray  # J
    theta: list[np.ndarray]  # per categorical field K x V
    within: np.ndarray  # (J+1) x (J+1) covariance within groups, time last
    loglik: list[float]

    def posterior(self, n: np.ndarray, s: np.ndarray, cats: list[np.ndarray]):
        """Responsibilities (G x K), conditional means and variances of the groups' means (G x K x J), log likelihood."""
        G, K = len(n), len(self.pi)
        log_r = np.tile(np.log(self.pi), (G, 1))
        for counts, th in zip(cats, self.theta, strict=True):
            log_r += counts @ np.log(th).T
        has = n > 0
        mean = np.where(has, s / np.maximum(n, 1), 0.0)[:, None, :]
        noise = np.where(has, self.sigma2 / np.maximum(n, 1), 1.0)[:, None, :]
        seen = has[:, None, :]
        total = self.tau2[None] + noise
        log_n = -0.5 * (np.log(2 * math.pi * total) + (mean - self.mu[None]) ** 2 / total)
        log_r += np.where(seen, log_n, 0.0).sum(axis=2)
        top = log_r.max(axis=1, keepdims=True)
        r = np.exp(log_r - top)
        norm = r.sum(axis=1, keepdims=True)
        gain = np.where(seen, self.tau2[None] / total, 0.0)
        m = self.mu[None] + gain * (mean - self.mu[None])
        v = self.tau2[None] * (1 - gain)
        return r / norm, m, v, float((np.log(norm) + top).sum()) if G else 0.0


class MixtureImputer:
    """``rows``: unique records with ``_key``, ``_group``, ``x0..`` (real numbers or null), ``c0..`` (listed values or
    null) and ``_time`` (double or null)."""

    def __init__(self, numeric: list[NumericField], categorical: list[CategoryField], iterations: int = 12, tolerance: float = 1e-5):
        self.numeric, self.categorical = numeric, categorical
        self.iterations, self.tolerance = iterations, tolerance
        self.J = len(numeric)
        self.dims = [f"x{j}" for j in range(self.J)] + ["_time"]

    # --- rows and group statistics -----------------------------------------------------------------------------
    def rows(self, df: DataFrame, key: str, group: str, time: str | None) -> DataFrame:
        """Narrow view of the records, each key once: of copies that differ the smallest counts, so that fitting and
        filling see the same."""
        when = F.lit(None).cast("double")
        if time is not None:
            when = F.col(f"`{time}`").cast("timestamp").cast("double") / 86400.0 - 19000.0  # days, near zero
        x = df.select(
            F.col(f"`{key}`").alias("_key"),
            F.col(f"`{group}`").alias("_group"),
            when.alias("_time"),
            *[real_number(F.col(f"`{s.name}`"), s).alias(f"x{j}") for j, s in enumerate(self.numeric)],
            *[real_category(F.col(f"`{s.name}`"), s).alias(f"c{j}") for j, s in enumerate(self.categorical)],
        )
        cells = [c for c in x.columns if c != "_key"]
        return x.groupBy("_key").agg(F.min(F.struct(*cells)).alias("_r")).select("_key", "_r.*")

    def group_stats(self, rows: DataFrame) -> DataFrame:
        """Sufficient statistics per group; groups without a name are left out."""
        aggs = [F.count(F.lit(1)).alias("weight")]
        for d in self.dims:
            aggs += [F.count(d).alias(f"n_{d}"), F.coalesce(F.sum(d), F.lit(0.0)).alias(f"s_{d}")]
        for a, b in self.pairs():
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            pick = lambda e, both=both: F.coalesce(F.sum(F.when(both, e)), F.lit(0.0))
            aggs += [
                F.count(F.when(both, 1)).alias(f"n_{a}_{b}"),
                pick(F.col(a)).alias(f"sa_{a}_{b}"),
                pick(F.col(b)).alias(f"sb_{a}_{b}"),
                pick(F.col(a) * F.col(b)).alias(f"sp_{a}_{b}"),
            ]
        for j, spec in enumerate(self.categorical):
            aggs.append(F.array(*[F.sum(F.when(F.col(f"c{j}") == v, 1).otherwise(0)) for v in spec.values]).alias(f"counts{j}"))
        return rows.where("_group is not null").groupBy("_group").agg(*aggs)

    def pairs(self):
        return [(a, b) for i, a in enumerate(self.dims) for b in self.dims[i:]]

    def within_cov(self, stats: DataFrame) -> np.ndarray:
        """Pooled covariance within groups from pairwise complete rows."""
        cells = []
        for a, b in self.pairs():
            n = F.col(f"n_{a}_{b}")
            cells += [
                F.sum(F.when(n > 1, F.col(f"sp_{a}_{b}") - F.col(f"sa_{a}_{b}") * F.col(f"sb_{a}_{b}") / n)),
                F.sum(F.when(n > 1, n - 1)),
            ]
        got = stats.agg(*[c.alias(f"v{i}") for i, c in enumerate(cells)]).first()
        cov = np.zeros((len(self.dims),) * 2)
        at = {d: i for i, d in enumerate(self.dims)}
        for i, (a, b) in enumerate(self.pairs()):
            value, free = got[2 * i], got[2 * i + 1]
            cov[at[a], at[b]] = cov[at[b], at[a]] = value / free if value is not None and free else 0.0
        floor = np.maximum(np.diag(cov), 1e-6)
        np.fill_diagonal(cov, floor)
        low, vecs = np.linalg.eigh(cov)  # pairwise covariances needn't be positive definite
        return (vecs * np.maximum(low, 1e-9 * max(low.max(), 1e-9))) @ vecs.T

    # --- fitting -----------------------------------------------------------------------------------------------
    def fit(self, stats: DataFrame) -> MixtureModel:
        J = self.J
        K = max([2, *(len(c.values) for c in self.categorical[:1])])
        cov = self.within_cov(stats)
        rng = np.random.default_rng(7)
        model = MixtureModel(
            np.full(K, 1 / K), np.zeros((K, J)), np.ones((K, J)), np.diag(cov)[:J].copy(),
            [np.full((K, len(c.values)), 1 / max(1, len(c.values))) for c in self.categorical], cov, [],
        )
        # the first pass starts from the groups' main category, so that components have a meaning and a fixed order
        start = rng.normal(size=(K, J))
        cols = ["weight", *[f"n_x{j}" for j in range(J)], *[f"s_x{j}" for j in range(J)], *[f"counts{j}" for j in range(len(self.categorical))]]
        table = stats.select(*cols, *[F.col(f"sp_x{j}_x{j}").alias(f"q_x{j}") for j in range(J)])
        width = 1 + 5 * J + sum(len(c.values) for c in self.categorical)
        for step in range(self.iterations + 1):
            sums, loglik, groups = self.expect(table, model, start if step == 0 else None, width, K)
            if groups == 0:
                break
            self.maximise(model, sums, groups)
            if step:
                model.loglik.append(loglik)
                if step > 1 and abs(loglik - model.loglik[-2]) <= self.tolerance * abs(loglik):
                    break
        # the variances as fitted, with the correlations of the pooled statistics
        scale = np.ones(len(cov))
        scale[:J] = np.sqrt(model.sigma2 / np.diag(cov)[:J])
        model.within = cov * np.outer(scale, scale)
        return model

    def read(self, pdf: pd.DataFrame):
        J = self.J
        n = pdf[[f"n_x{j}" for j in range(J)]].to_numpy(float).reshape(len(pdf), J)
        s = pdf[[f"s_x{j}" for j in range(J)]].to_numpy(float).reshape(len(pdf), J)
        cats = [np.array(pdf[f"counts{j}"].tolist(), float).reshape(len(pdf), len(c.values)) for j, c in enumerate(self.categorical)]
        return n, s, cats

    def expect(self, table: DataFrame, model: MixtureModel, start, width: int, K: int):
        read, sigma2 = self.read, model.sigma2

        def run(batches):
            total, loglik, groups = np.zeros((K, width)), 0.0, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                n, s, cats = read(pdf)
                squares = pdf[[f"q_x{j}" for j in range(n.shape[1])]].to_numpy(float).reshape(n.shape)
                own = s / np.maximum(n, 1)  # the group's own mean
                r, m, v, ll = model.posterior(n, s, cats)
                if start is not None:
                    m = np.where(n > 0, s / np.maximum(n, 1), np.nan)
                    if cats and cats[0].shape[1] == K:
                        r = (cats[0] + 0.1) / (cats[0] + 0.1).sum(axis=1, keepdims=True)
                    else:
                        z = np.nan_to_num(m / np.sqrt(sigma2)) @ start.T
                        r = np.exp(z - z.max(axis=1, keepdims=True))
                        r /= r.sum(axis=1, keepdims=True)
                    m, v = np.nan_to_num(m)[:, None, :].repeat(K, 1), np.zeros((len(pdf), K, m.shape[1]))
                # only groups that have the field speak on its component's mean
                held = (n > 0)[:, None, :] * r[:, :, None]
                # squares of the rows around the group's expected mean: those around its own, and how far the two are apart
                apart = n[:, None, :] * held * ((own[:, None, :] - m) ** 2 + v)
                around = held * np.maximum(squares - n * own**2, 0)[:, None, :]
                parts = [r.sum(0)[:, None], held.sum(0), (held * m).sum(0), (held * (m * m + v)).sum(0), (n[:, None, :] * held).sum(0), (around + apart).sum(0), *[r.T @ c for c in cats]]
                total += np.hstack(parts)
                loglik += ll
                groups += len(pdf)
            yield pd.DataFrame({"k": range(K), "sums": list(total), "loglik": loglik / K, "groups": groups})

        rows = (
            table.mapInPandas(run, "k int, sums array<double>, loglik double, groups long")
            .groupBy("k")
            .agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("loglik").alias("ll"), F.max("groups").alias("g"))
            .collect()
        )
        sums = np.zeros((K, width))
        for r in rows:
            sums[r.k] = r.sums
        return sums, sum(r.ll for r in rows), max((r.g for r in rows), default=0)

    def maximise(self, model: MixtureModel, sums: np.ndarray, groups: int) -> None:
        J, K = self.J, len(model.pi)
        weight, held = sums[:, 0], sums[:, 1 : 1 + J]
        mean = sums[:, 1 + J : 1 + 2 * J] / np.maximum(held, 1e-9)
        second = sums[:, 1 + 2 * J : 1 + 3 * J] / np.maximum(held, 1e-9)
        overall = sums[:, 1 + J : 1 + 2 * J].sum(0) / np.maximum(held.sum(0), 1e-9)
        empty = held < 1e-6
        rows, spread = sums[:, 1 + 3 * J : 1 + 4 * J].sum(0), sums[:, 1 + 4 * J : 1 + 5 * J].sum(0)
        model.sigma2 = np.maximum(np.where(rows > groups, spread / np.maximum(rows, 1), model.sigma2), 1e-6)
        model.pi = (weight + 1) / (weight.sum() + K)
        model.mu = np.where(empty, overall, mean)
        model.tau2 = np.maximum(np.where(empty, 1.0, second - mean**2), 1e-3 * model.sigma2 + 1e-9)
        at = 1 + 5 * J
        for j, c in enumerate(self.categorical):
            part = sums[:, at : at + len(c.values)] + 0.5
            model.theta[j] = part / part.sum(axis=1, keepdims=True)
            at += len(c.values)

    # --- filling -----------------------------------------------------------------------------------------------
    def group_fills(self, stats: DataFrame, model: MixtureModel) -> DataFrame:
        """Per group: expected means, modes and the mean of time; null where the group has no real value."""
        J, read, cats_of = self.J, self.read, self.categorical
        schema = ["_group " + stats.schema["_group"].dataType.simpleString(), "weight long", "mean__time double"]
        schema += [f"mean_x{j} double" for j in range(J)] + [f"mode{j} string" for j in range(len(cats_of))]

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                n, s, cats = read(pdf)
                r, m, _, _ = model.posterior(n, s, cats)
                means = (r[:, :, None] * m).sum(axis=1)
                out = pd.DataFrame({"_group": pdf["_group"], "weight": pdf["weight"]})
                nt = pdf["n__time"].to_numpy(float)
                out["mean__time"] = [None if a == 0 else b / a for a, b in zip(nt, pdf["s__time"], strict=True)]
                for j in range(J):
                    out[f"mean_x{j}"] = [x if a > 0 else None for x, a in zip(means[:, j], n[:, j], strict=True)]
                for j, c in enumerate(cats_of):
                    p = cats[j] + r @ model.theta[j]
                    # only values the group holds may fill it; ties go to the first of the list
                    p = np.where(cats[j] > 0, p, -1.0)
                    out[f"mode{j}"] = [c.values[i] if h else None for i, h in zip(p.argmax(1), cats[j].sum(1) > 0, strict=True)]
                yield out

        return stats.mapInPandas(run, ", ".join(schema))

    def expectation(self, j: int, model: MixtureModel) -> Column:
        """Group mean plus the regression on the deviations of the fields the record has, one linear form for each set
        of such fields."""
        others = [i for i in range(len(self.dims)) if i != j]
        out = F.col(f"mean_x{j}")
        have = {i: F.col(self.dims[i]).isNotNull() & F.col(f"mean_{self.dims[i]}").isNotNull() for i in others}
        subsets = sorted(chain.from_iterable(combinations(others, k) for k in range(1, len(others) + 1)), key=len)
        for sub in subsets:
            coef = np.linalg.solve(model.within[np.ix_(sub, sub)], model.within[list(sub), j])
            form, cond = F.col(f"mean_x{j}"), F.lit(True)
            for w, i in zip(coef, sub, strict=True):
                form = form + F.lit(float(w)) * (F.col(self.dims[i]) - F.col(f"mean_{self.dims[i]}"))
                cond = cond & have[i]
            out = F.when(cond, form).otherwise(out)  # larger sets come later and so go first
        spec = self.numeric[j]
        if spec.low is not None:
            out = F.greatest(out, F.lit(float(spec.low)))
        if spec.high is not None:
            out = F.least(out, F.lit(float(spec.high)))
        return F.when(F.col(f"mean_x{j}").isNotNull(), out)

    def fill(self, rows: DataFrame, fills: DataFrame, model: MixtureModel) -> DataFrame:
        """(_key, _group, one column per field, ``filled``: names of the filled cells)."""
        joined = salted_join(rows.where("_group is not null"), fills, ["_group"], "weight", "_key")
        cells, marks = [], []
        fields = [(s.name, f"x{j}", self.expectation(j, model)) for j, s in enumerate(self.numeric)]
        fields += [(s.name, f"c{j}", F.col(f"mode{j}")) for j, s in enumerate(self.categorical)]
        for name, col, guess in fields:
            cells.append(F.coalesce(F.col(col), guess).alias(name))
            marks.append(F.when(F.col(col).isNull() & guess.isNotNull(), F.lit(name)))
        return joined.select("_key", "_group", *cells, F.array_compact(F.array(*marks)).alias("filled"))


def impute(
    df: DataFrame, *, key: str, group: str, numeric: list[NumericField], categorical: list[CategoryField],
    time: str | None = None, only_missing: bool = False, iterations: int = 12,
) -> DataFrame:
    """Fill cells without a real value. Returns ``key, group``, the fields and ``filled`` (array of field names), one
    row per key. With ``only_missing`` only records that lack a value come out. Records without a group, and cells
    whose group has no real value, stay as they are (null if not real); an empty table gives an empty result."""
    imp = MixtureImputer(numeric, categorical, iterations)
    rows = imp.rows(df, key, group, time)
    stats = cut(imp.group_stats(rows))
    model = imp.fit(stats)
    fills = imp.group_fills(stats, model)
    fields = [f"x{j}" for j in range(len(numeric))] + [f"c{j}" for j in range(len(categorical))]
    lacking = " or ".join(f"{f} is null" for f in fields)
    names = [s.name for s in (*numeric, *categorical)]
    todo = rows.where(lacking) if only_missing else rows
    out = imp.fill(todo, fills, model)
    if not only_missing:
        alone = rows.where("_group is null").select(
            "_key", "_group", *[F.col(f).alias(n) for f, n in zip(fields, names, strict=True)], F.array().cast("array<string>").alias("filled")
        )
        out = out.unionByName(alone)
    return out.withColumnsRenamed({"_key": key, "_group": group})
