"""Attribution: Shapley values, changes between populations, anomalies, strengths of arrows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causelake.errors import Unsupported
from causelake.functions import special
from causelake.operators.estimate import _row
from causelake.operators.scm import Linear, Model

EXACT_PLAYERS = 12


def shapley(players: Sequence[str], payoff: Callable[[frozenset[str]], float], samples: int | None = None, seed: int = 0) -> dict[str, float]:
    """Exact values over all coalitions, or by sampled permutations; payoffs are cached by coalition."""
    n = len(players)
    if n > 64:
        raise Unsupported("at most 64 players")
    cache: dict[frozenset[str], float] = {}

    def v(s: frozenset[str]) -> float:
        if s not in cache:
            cache[s] = payoff(s)
        return cache[s]

    out = dict.fromkeys(players, 0.0)
    if samples is None:
        if n > EXACT_PLAYERS:
            raise Unsupported(f"exact values are limited to {EXACT_PLAYERS} players")
        for p in players:
            rest = [q for q in players if q != p]
            for k in range(n):
                w = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                out[p] += sum(w * (v(frozenset(s) | {p}) - v(frozenset(s))) for s in combinations(rest, k))
        return out
    rng = np.random.default_rng(seed)
    for _ in range(samples):
        held: frozenset[str] = frozenset()
        for i in rng.permutation(n):
            new = held | {players[i]}
            out[players[i]] += (v(new) - v(held)) / samples
            held = new
    return out


def sequential(order: Sequence[str], payoff: Callable[[frozenset[str]], float]) -> dict[str, float]:
    """Path-dependent allocation along one order."""
    held: frozenset[str] = frozenset()
    out = {}
    for p in order:
        out[p] = payoff(held | {p}) - payoff(held)
        held |= {p}
    return out


def distribution_change(before: Model, after: Model, target: str, kind: str = "mean") -> dict[str, float]:
    """Which mechanisms moved the target: each is swapped from one population's model to the other's."""
    players = [n for n in before.graph.order() if n in before.graph.ancestors([target])]

    def value(swapped: frozenset[str]) -> float:
        m = Model(before.graph, {n: (after if n in swapped else before).mechanisms[n] for n in before.graph.nodes})
        mean, cov = m.moments()
        return mean[target] if kind == "mean" else cov[target, target]

    base = value(frozenset())
    return shapley(players, lambda s: value(s) - base)


def arrow_strength(model: Model, target: str) -> dict[str, float]:
    """Variance the target would lose without each arrow: squared coefficient times the parent's variance."""
    m = model.mechanisms[target]
    if not isinstance(m, Linear):
        raise Unsupported("arrow strength needs a linear mechanism")
    _, cov = model.moments()
    return {p: b * b * cov[p, p] for p, b in m.coefficients.items()}


def anomaly_scores(df: DataFrame, value: str) -> DataFrame:
    """z = |y - median| / (1.4826 MAD) (mean absolute deviation, then 1, where the MAD is 0), joined as one row."""
    y = F.col(value).cast("double")
    mid = df.agg(F.percentile(y, F.lit(0.5)).alias("__m"))
    dev = df.join(F.broadcast(mid)).select(F.abs(y - F.col("__m")).alias("d"))
    spread = dev.agg(F.percentile("d", F.lit(0.5)).alias("mad"), F.avg("d").alias("mean"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    return df.join(F.broadcast(mid)).join(F.broadcast(spread.select(scale.alias("__s")))).withColumn("z", F.abs(y - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def tail_surprise(z: float) -> float:
    """-ln of the two-sided normal tail, also where it underflows."""
    return -(math.log(2) + special.log_norm_sf(abs(z)))


def root_causes(contributions: DataFrame, k: int, name: str = "component", value: str = "contribution") -> DataFrame:
    """The k components of largest absolute contribution."""
    return contributions.orderBy(F.abs(value).desc(), F.col(name)).limit(k)


def noise_attribution(model: Model, df: DataFrame, target: str) -> DataFrame:
    """Per row: how much each ancestor's noise moves the target in a linear model (an additive game, so exact)."""
    df = model.abduct(df)
    loads = {}
    for n in model.graph.order():
        loads[n] = {n: model.mechanisms[n].sd}
        for p, b in model.mechanisms[n].coefficients.items():
            for k, v in loads[p].items():
                loads[n][k] = loads[n].get(k, 0.0) + b * v
    return df.select("*", *[(F.lit(v) * F.col(f"eps_{k}")).alias(f"from_{k}") for k, v in loads[target].items()])


def unit_change(before: Model, after: Model, df: DataFrame, target: str) -> DataFrame:
    """Per row: the target under the new mechanisms less under the old, noise shared, split by mechanism in topological order."""
    own = before.abduct(df)
    order = [n for n in before.graph.order() if n in before.graph.ancestors([target])]

    def predicted(new: set[str]) -> Column:
        values: dict[str, Column] = {}
        for n in order:
            m = (after if n in new else before).mechanisms[n]
            values[n] = m.value({p: values[p] for p in before.graph.parents[n]}, F.col(f"eps_{n}"))
        return values[target]

    steps = [set(order[:i]) for i in range(len(order) + 1)]
    return own.select(*df.columns, *[(predicted(b) - predicted(a)).alias(f"change_{n}") for n, a, b in zip(order, steps, steps[1:])])


def mechanism_change(df: DataFrame, population: str, columns: Sequence[str]) -> DataFrame:
    """Per column: Welch statistic and Gaussian likelihood ratio between two populations (True and False), one pass."""
    on = F.col(population).cast("boolean")
    aggs = []
    for i, c in enumerate(columns):
        for k, s in (("1", on), ("0", ~on)):
            v = F.when(s, F.col(c).cast("double"))
            aggs += [F.avg(v).alias(f"m{k}_{i}"), F.var_samp(v).alias(f"v{k}_{i}"), F.count(v).alias(f"n{k}_{i}")]
    r = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(columns):
        m1, v1, n1, m0, v0, n0 = (r[f"{x}{k}_{i}"] for k in "10" for x in "mvn")
        z = abs(m1 - m0) / math.sqrt(v1 / n1 + v0 / n0)
        n = n1 + n0
        p1, p0 = v1 * (n1 - 1) / n1, v0 * (n0 - 1) / n0
        mean = (n1 * m1 + n0 * m0) / n
        whole = (n1 * (p1 + (m1 - mean) ** 2) + n0 * (p0 + (m0 - mean) ** 2)) / n
        lr = n * math.log(whole) - n1 * math.log(p1) - n0 * math.log(p0)
        rows.append((c, m1 - m0, z, 2 * special.norm_sf(z), lr, special.chi2_sf(lr, 2)))
    return df.sparkSession.createDataFrame(rows, "column string, difference double, welch double, welch_p double, lr double, lr_p double")


def path_contributions(model: Model, t: str, y: str, spark) -> DataFrame:
    rows = [(" -> ".join(p), v) for p, v in model.path_shares(t, y).items()]
    return spark.createDataFrame(rows, "path string, contribution double")


def population_contrast(model: Model, df: DataFrame, t: str, y: str, active: float, control: float) -> DataFrame:
    return _row(df, contrast=model.moments({t: active})[0][y] - model.moments({t: control})[0][y])
