"""Refuters and sensitivity: each returns report rows, and what does not apply says so."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causelake.functions import special
from causelake.functions.transforms import normal, uniform
from causelake.operators.estimate import e_value
from causelake.operators.reduce import gram, solve
from causelake.operators.reduce import replicates as expand

REPORT = "validator string, verdict string, statistic double, reference double, detail string"


def _report(df: DataFrame, name: str, verdict: bool | None, statistic: float, reference: float, detail: str = "") -> DataFrame:
    word = "not applicable" if verdict is None else "pass" if verdict else "fail"
    return df.sparkSession.createDataFrame([(name, word, float(statistic), float(reference), detail)], REPORT)


def _replicated(df: DataFrame, t: str, y: str, z: Sequence[str], count: int) -> np.ndarray:
    """Effects of all replicates from one grouped Gram."""
    return np.array([solve(g, y, ["1", t, *z], 1e-12)[t] for g in gram(df, [t, *z, y], by=["replicate"]).values()])


def placebo(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, count: int = 50, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """A treatment redrawn from its own share: the effect should be near zero."""
    share = df.agg(F.avg(F.col(t).cast("double"))).first()[0]
    rows = expand(df, count).withColumn(t, (uniform(seed, "placebo", key, "replicate") < share).cast("double"))
    e = _replicated(rows, t, y, z, count)
    zed = abs(e.mean()) / (e.std(ddof=1) or 1e-300)
    p = 2 * special.norm_sf(zed)
    return _report(df, "placebo", p >= alpha, float(e.mean()), p)


def dummy_outcome(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, count: int = 50, seed: int = 2, alpha: float = 0.05) -> DataFrame:
    rows = expand(df, count).withColumn(y, normal(seed, "dummy", key, "replicate"))
    e = _replicated(rows, t, y, z, count)
    p = 2 * special.norm_sf(abs(e.mean()) / (e.std(ddof=1) or 1e-300))
    return _report(df, "dummy outcome", p >= alpha, float(e.mean()), p)


def random_common_cause(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, count: int = 50, seed: int = 3, alpha: float = 0.05) -> DataFrame:
    base = solve(gram(df, [t, *z, y]), y, ["1", t, *z])
    rows = expand(df, count).withColumn("__u", normal(seed, "cause", key, "replicate"))
    e = _replicated(rows, t, y, [*z, "__u"], count)
    p = 2 * special.norm_sf(abs(e.mean() - base[t]) / max(base.se(t), 1e-300))
    return _report(df, "random common cause", p >= alpha, float(e.mean()), base[t])


def data_subset(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, fraction: float = 0.8, count: int = 50, seed: int = 4, alpha: float = 0.05) -> DataFrame:
    base = solve(gram(df, [t, *z, y]), y, ["1", t, *z])[t]
    rows = expand(df, count).where(uniform(seed, "subset", key, "replicate") < fraction)
    e = _replicated(rows, t, y, z, count)
    p = 2 * special.norm_sf(abs(e.mean() - base) / (e.std(ddof=1) or 1e-300))
    return _report(df, "data subset", p >= alpha, float(e.mean()), base)


def bootstrap_interval(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, count: int = 50, seed: int = 5, level: float = 0.95) -> DataFrame:
    from causelake.functions.transforms import exponential
    from causelake.schema import WEIGHT

    base = solve(gram(df, [t, *z, y]), y, ["1", t, *z])[t]
    e = _replicated(expand(df, count).withColumn(WEIGHT, exponential(seed, "boot", key, "replicate")), t, y, z, count)
    low, high = np.quantile(e, [(1 - level) / 2, (1 + level) / 2])
    return _report(df, "bootstrap", bool(low <= base <= high), base, float(high - low), f"[{low:.6g}, {high:.6g}]")


def leave_one_out(df: DataFrame, t: str, y: str, z: Sequence[str]) -> DataFrame:
    """Worst relative change when one adjustment variable is left out: sub-blocks of one Gram."""
    if not z:
        return _report(df, "leave one out", None, math.nan, math.nan, "no adjustment variable")
    g = gram(df, [t, *z, y])
    base = solve(g, y, ["1", t, *z])[t]
    worst = max(abs(solve(g, y, ["1", t, *[c for c in z if c != x]])[t] - base) / max(abs(base), 1e-12) for x in z)
    return _report(df, "leave one out", worst < 0.5, worst, base)


def unobserved_common_cause(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, strength_t: float = 0.1, strength_y: float = 0.1, seed: int = 6) -> DataFrame:
    """A simulated cause moves treatment and outcome: change of the effect in standard errors."""
    base = solve(gram(df, [t, *z, y]), y, ["1", t, *z])
    sd = df.agg(F.stddev_samp(t), F.stddev_samp(y)).first()
    u = normal(seed, "unobserved", key)
    moved = df.withColumn(t, F.col(t) + strength_t * sd[0] * u).withColumn(y, F.col(y) + strength_y * sd[1] * u)
    e = solve(gram(moved, [t, *z, y]), y, ["1", t, *z])[t]
    change = abs(e - base[t]) / max(base.se(t), 1e-300)
    return _report(df, "unobserved common cause", change < 1.0, e, base[t], f"{change:.4g} standard errors")


def e_value_report(df: DataFrame, effect: float, y: str, threshold: float = 1.5) -> DataFrame:
    v = e_value(effect, df.agg(F.stddev_samp(y)).first()[0])
    return _report(df, "e-value", v >= threshold, v, threshold)


def partial_r2_grid(df: DataFrame, t: str, y: str, z: Sequence[str], grid: Sequence[float] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """Bias bound of an omitted variable by its partial R2 with treatment and outcome."""
    fit = solve(gram(df, [t, *z, y]), y, ["1", t, *z])
    dof = fit.n - len(fit.names)
    rows = []
    for a in grid:
        for b in grid:
            bias = fit.se(t) * math.sqrt(dof * b * a / (1 - a))
            rows.append((a, b, fit[t] - math.copysign(bias, fit[t]), bias))
    f = abs(fit[t] / fit.se(t)) / math.sqrt(dof)
    robustness = 0.5 * (math.sqrt(f**4 + 4 * f * f) - f * f)
    return df.sparkSession.createDataFrame([(*r, robustness) for r in rows], "r2_treatment double, r2_outcome double, adjusted double, bias double, robustness_value double")


def riesz_sensitivity(df: DataFrame, t: str, e: str = "e") -> DataFrame:
    """Size of the representer T / e - (1 - T) / (1 - e)."""
    a = F.col(t).cast("double")
    alpha = a / F.col(e) - (1 - a) / (1 - F.col(e))
    return df.agg(F.avg(alpha).alias("mean"), F.avg(alpha * alpha).alias("second_moment"), F.max(F.abs(alpha)).alias("largest"))


def suite(df: DataFrame, t: str, y: str, z: Sequence[str], key: str, count: int = 30, custom: Sequence[Callable[..., DataFrame]] = ()) -> DataFrame:
    """All validators in order, as one table."""
    base = solve(gram(df, [t, *z, y]), y, ["1", t, *z])[t]
    parts = [f(df, t, y, z, key, count=count) for f in (placebo, dummy_outcome, random_common_cause, data_subset, bootstrap_interval)]
    parts += [leave_one_out(df, t, y, z), unobserved_common_cause(df, t, y, z, key), e_value_report(df, base, y)]
    parts += [f(df, t, y, z) for f in custom]
    return fold(DataFrame.unionByName, parts)


# --- design


def rank_designs(candidates: DataFrame, score: str, feasible: str | None = None) -> DataFrame:
    """Candidates by score, violations filtered first; ties by name."""
    c = candidates.where(F.col(feasible)) if feasible else candidates
    return c.orderBy(F.col(score).desc(), "design")


def decide(actions: DataFrame, draws: DataFrame, utility, constraint=None, chance: float = 0.95) -> DataFrame:
    """Expected utility, regret and chance constraint of each action over posterior draws.

    Actions are a list of choices made by hand, so they are the broadcast side.
    """
    x = draws.join(F.broadcast(actions)).withColumn("__u", utility)
    best = x.groupBy("draw").agg(F.max("__u").alias("__best"))
    ok = F.avg(constraint.cast("double")) if constraint is not None else F.lit(1.0)
    out = x.join(best, "draw").groupBy("action").agg(F.avg("__u").alias("utility"), F.avg(F.col("__best") - F.col("__u")).alias("regret"), ok.alias("satisfied"))
    return out.withColumn("allowed", F.col("satisfied") >= chance)


def graph_entropy(graphs: DataFrame, weight: str = "weight") -> DataFrame:
    return graphs.agg((-F.sum(F.when(F.col(weight) > 0, F.col(weight) * F.log(weight)).otherwise(0.0))).alias("entropy"))


def overlap_rule(df: DataFrame, t: str, e: str = "e", eps: float = 0.1, least: float = 0.5) -> DataFrame:
    """Whether enough rows keep a propensity inside [eps, 1 - eps] for the trimmed population to stand for the whole, in one aggregate."""
    eps = min(max(eps, 1e-6), 0.49)
    r = df.where(F.col(t).isNotNull() & F.col(e).isNotNull()).agg(F.avg(F.col(e).between(eps, 1 - eps).cast("double")).alias("kept"), F.min(e).alias("low"), F.max(e).alias("high")).first()
    if r["kept"] is None:
        return _report(df, "overlap.rule", None, math.nan, least, "no rows")
    return _report(df, "overlap.rule", r["kept"] >= least, r["kept"], least, f"scores in [{r['low']:.6f}, {r['high']:.6f}], band [{eps}, {1 - eps}]")
