"""Priors from other studies: catalogue, mapping, transport, sensitivity, predictive checks; exchangeable posterior engines."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.errors import DataError, EstimationError, Unsupported
from causelake.functions.transforms import normal
from causelake.operators import bayes
from causelake.operators.bayes import Posterior
from causelake.operators.reduce import Gram

#: Least variance a mapped prior may have.
LEAST_VARIANCE = 1e-12


@dataclass(frozen=True)
class Prior:
    """Independent Gaussian priors of named coefficients; ``notes`` say where they come from."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    variance: tuple[float, ...]
    notes: tuple[str, ...] = ()

    def __post_init__(self):
        if not len(self.names) == len(self.mean) == len(self.variance) or any(not v > 0 for v in self.variance):
            raise DataError("a prior has one mean and one positive variance for each name")

    @classmethod
    def weak(cls, names: Sequence[str], scale: float = 10.0) -> Prior:
        return cls(tuple(names), (0.0,) * len(names), (scale * scale,) * len(names))

    def with_moments(self, found: Mapping[str, tuple[float, float]], note: str) -> Prior:
        """The same prior with (mean, variance) of some names replaced."""
        if set(found) - set(self.names):
            raise DataError(f"no coefficient {sorted(set(found) - set(self.names))[0]!r}")
        moments = [found.get(n, (m, v)) for n, m, v in zip(self.names, self.mean, self.variance)]
        return replace(self, mean=tuple(m for m, _ in moments), variance=tuple(max(v, LEAST_VARIANCE) for _, v in moments), notes=(*self.notes, note))


def hydrate(source: Mapping[str, tuple[float, float]], baseline: Prior, mapping: str = "identical", treatment: str | None = None, quantity: str = "ate", pairs: Sequence[tuple[str, str]] = ()) -> Prior:
    """A posterior of another design, as ``{name: (mean, sd)}``, made a prior of this one.

    ``identical``: the coefficients are the same, name by name, and all are there.  ``effect``: the moments of one
    quantity become the treatment's coefficient.  ``named``: pairs (source, target).  What is not mapped keeps the baseline.
    """
    square = lambda s: (source[s][0], source[s][1] ** 2)
    if mapping == "identical":
        if set(source) != set(baseline.names):
            raise DataError("the coefficients differ; map an effect or named pairs instead")
        return baseline.with_moments({n: square(n) for n in source}, "posterior of the same coefficients")
    if mapping == "effect":
        if treatment is None or quantity not in source:
            raise DataError("an effect prior needs the treatment's name and a source quantity that exists")
        return baseline.with_moments({treatment: square(quantity)}, f"effect {quantity} of another study on {treatment}")
    if mapping == "named":
        if not pairs or any(a not in source for a, _ in pairs):
            raise DataError("named mapping needs pairs whose sources exist")
        return baseline.with_moments({b: square(a) for a, b in pairs}, "named: " + ", ".join(f"{a} to {b}" for a, b in pairs))
    raise DataError(f"no mapping {mapping!r}")


# --- transport

POLICIES = ("invariant_conditional_outcome", "invariant_effect_modifiers", "invariant_propensity")


@dataclass(frozen=True)
class Source:
    """A prior of another study, its population and its discount in [0, 1]."""

    name: str
    prior: Prior
    population: str | None = None
    alpha: float = 1.0


def transported_moments(units: DataFrame, effect: str, weight: str) -> tuple[float, float, float]:
    """(mean, variance, effective size) of unit effects under the target's weights, in one aggregate."""
    w, e = F.col(weight).cast("double"), F.col(effect).cast("double")
    r = units.where(w.isNotNull() & e.isNotNull()).agg(F.sum(w).alias("w"), F.sum(w * e).alias("we"), F.sum(w * e * e).alias("wee"), F.sum(w * w).alias("ww"), F.min(w).alias("least")).first()
    if not r["w"] or r["least"] < 0:
        raise DataError("target weights are non-negative and not all zero")
    mean = r["we"] / r["w"]
    return mean, max(r["wee"] / r["w"] - mean * mean, LEAST_VARIANCE), r["w"] ** 2 / r["ww"]


def transport(sources: Sequence[Source], target: str | None, policy: str | None = None, moments: tuple[float, float, float] | None = None, coefficient: str | None = None) -> list[tuple[Source, bool, str]]:
    """(source, whether it had to be carried over, why its discount fell to 0) of each source.

    Sources of the target's own population, or where either is not named, pass as they are.  Others need a declared
    policy.  Given reweighted ``moments`` (``transported_moments``) the coefficient takes them; an invariant propensity
    without them carries nothing over (discount 0); the other policies trust the declaration.
    """
    out = []
    for s in sources:
        if s.population is None or target is None or s.population == target:
            out.append((s, False, ""))
            continue
        if policy is None:
            raise Unsupported(f"a prior of {s.population} for {target} needs a transport policy")
        if policy not in POLICIES:
            raise DataError(f"no transport policy {policy!r}")
        note = f"{policy}: {s.population} to {target}"
        if moments is not None:
            mean, variance, ess = moments
            prior = s.prior.with_moments({coefficient or s.prior.names[-1]: (mean, variance)}, f"{note}, reweighted, effective size {ess:.3f}")
            out.append((replace(s, prior=prior), True, ""))
        elif policy == "invariant_propensity":
            out.append((replace(s, alpha=0.0, prior=replace(s.prior, notes=(*s.prior.notes, note))), True, "no target weights"))
        else:
            out.append((replace(s, prior=replace(s.prior, notes=(*s.prior.notes, note))), True, ""))
    return out


def compose(sources: Sequence[Source], baseline: Prior) -> Prior:
    """Power priors: precisions add, each source's discounted; sources with discount 0 add nothing."""
    precision = np.array([1 / v for v in baseline.variance])
    pull = precision * np.array(baseline.mean)
    for s in sources:
        if s.prior.names != baseline.names:
            raise DataError(f"{s.name} has other coefficients than the baseline")
        p = s.alpha / np.array(s.prior.variance)
        precision, pull = precision + p, pull + p * np.array(s.prior.mean)
    return Prior(baseline.names, tuple(map(float, pull / precision)), tuple(map(float, 1 / precision)), tuple(f"{s.name} at {s.alpha}" for s in sources))


# --- catalogue


def compatible(catalogue: DataFrame, treatment: str, outcome: str, estimand: str = "ate", units: str | None = None) -> DataFrame:
    """The catalogue (``artifact, treatment, outcome, estimand, units, ...``) with ``reason``: null where a source is usable."""
    reason = (
        F.when(~F.col("treatment").eqNullSafe(F.lit(treatment)), "treatment")
        .when(~F.col("outcome").eqNullSafe(F.lit(outcome)), "outcome")
        .when(~F.col("estimand").eqNullSafe(F.lit(estimand)), "estimand")
    )
    return catalogue.withColumn("reason", reason.when(~F.col("units").eqNullSafe(F.lit(units)), "units") if units is not None else reason)


def rank_sources(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """Usable sources, most similar first (``scores`` has ``artifact, similarity``); without a score last, ties by name."""
    usable = reports.where(F.col("reason").isNull())
    return usable.join(scores.select("artifact", "similarity"), "artifact", "left").orderBy(F.col("similarity").desc_nulls_last(), "artifact")


# --- sensitivity and checks


def _posterior(g: Gram, outcome: str, design: Sequence[str], prior: Prior, sigma2: float) -> Posterior:
    x, xy = g.sub(design, design) / sigma2, g.sub(design, [outcome])[:, 0] / sigma2
    p0 = np.diag([1 / v for v in prior.variance])
    cov = np.linalg.inv(p0 + x)
    return Posterior(tuple(design), cov @ (p0 @ np.array(prior.mean) + xy), cov)


def prior_sensitivity(spark: SparkSession, g: Gram, outcome: str, design: Sequence[str], t: str, sigma2: float, scales: Sequence[float] = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0), most: float = 0.5) -> DataFrame:
    """``scale, mean, sd, relative_range, stable``: the treatment's posterior under centred priors of growing scale, from one Gram.

    The relative range is that of the means over the largest of them in size; it is stable up to ``most``.
    """
    found = [(_posterior(g, outcome, design, Prior.weak(design, s), sigma2), s) for s in scales]
    return _sensitivity(spark, "scale", [(float(s), p) for p, s in found], t, most)


def alpha_sensitivity(spark: SparkSession, g: Gram, outcome: str, design: Sequence[str], t: str, sigma2: float, sources: Sequence[Source], baseline: Prior, alphas: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), most: float = 0.5) -> DataFrame:
    """The same over the discount of external sources, on the ``alpha`` grid."""
    found = [(float(a), _posterior(g, outcome, design, compose([replace(s, alpha=a * s.alpha) for s in sources], baseline), sigma2)) for a in alphas]
    return _sensitivity(spark, "alpha", found, t, most)


def _sensitivity(spark: SparkSession, axis: str, found: list[tuple[float, Posterior]], t: str, most: float) -> DataFrame:
    rows = [(s, float(p.mean[p.names.index(t)]), math.sqrt(p.cov[p.names.index(t), p.names.index(t)])) for s, p in found]
    means = [m for _, m, _ in rows]
    size = max(map(abs, means))
    spread = (max(means) - min(means)) / size if size > 0 else 0.0
    return spark.createDataFrame([(*r, spread, spread <= most) for r in rows], f"{axis} double, mean double, sd double, relative_range double, stable boolean")


def predictive_check(spark: SparkSession, g: Gram, outcome: str, design: Sequence[str], draws: np.ndarray, sigma2: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Prior or posterior predictive check of a linear model: does the outcome's mean and spread look like the draws'?

    ``draws`` has a row of coefficients a draw.  The mean and variance of what a draw predicts over all rows are quadratic
    forms in the Gram, so no prediction is made row by row.  p-values are two-sided shares of draws beyond the data.
    """
    draws = np.atleast_2d(np.asarray(draws, float))
    if not len(draws) or draws.shape[1] != len(design) or not g.n:
        raise EstimationError("a check needs rows, and draws of the design's coefficients")
    second = g.sub(design, design) / g.n
    first = np.array([1.0 if n == "1" else g.mean(n) for n in design])
    means = draws @ first
    spreads = np.sqrt(np.maximum(np.einsum("di,ij,dj->d", draws, second - np.outer(first, first), draws) + sigma2, 0.0))
    seen = (g.mean(outcome), math.sqrt(g.covariance([outcome])[0, 0]))
    p = [min(1.0, 2 * min(float(np.mean(v <= s)), float(np.mean(v >= s)))) for v, s in zip((means, spreads), seen)]
    row = (*seen, float(means.mean()), float(spreads.mean()), *p, min(p) >= alpha, len(draws))
    return spark.createDataFrame([row], "observed_mean double, observed_sd double, predictive_mean double, predictive_sd double, mean_p double, sd_p double, passed boolean, draws long")


def prior_draws(prior: Prior, count: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array(prior.mean) + rng.normal(size=(count, len(prior.names))) * np.sqrt(prior.variance)


def not_identified(spark: SparkSession, prior: Prior, effect: str, count: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(draws, summary) of an effect that the data say nothing about: the prior alone, with all mass unidentified."""
    if effect not in prior.names:
        raise DataError(f"no coefficient {effect!r}")
    at = prior.names.index(effect)
    m, v = prior.mean[at], prior.variance[at]
    d = spark.range(count).select(F.col("id").alias("draw"), (F.lit(m) + F.lit(math.sqrt(v)) * normal(seed, "unidentified", "id")).alias("effect"))
    summary = [(effect, m, math.sqrt(v), 0.0, 1.0, "; ".join(prior.notes) or "declared prior, untestable")]
    return d, spark.createDataFrame(summary, "quantity string, mean double, sd double, identified_mass double, unidentified_mass double, assumption string")


# --- engines


class Backend(Protocol):
    """What makes a posterior of linear coefficients from the shared Gram; any object with this method serves."""

    name: str

    def infer(self, g: Gram, outcome: str, design: Sequence[str], prior: Prior, sigma2: float) -> Posterior: ...


class Conjugate:
    """Exact Gaussian posterior under a known variance."""

    name = "conjugate"

    def infer(self, g: Gram, outcome: str, design: Sequence[str], prior: Prior, sigma2: float) -> Posterior:
        return _posterior(g, outcome, design, prior, sigma2)


class Hamiltonian:
    """Moments of Hamiltonian chains (weak priors only)."""

    name = "hmc"

    def __init__(self, spark: SparkSession, chains: int = 4, steps: int = 500, seed: int = 0):
        self.spark, self.chains, self.steps, self.seed = spark, chains, steps, seed

    def infer(self, g: Gram, outcome: str, design: Sequence[str], prior: Prior, sigma2: float) -> Posterior:
        if any(m for m in prior.mean) or min(prior.variance) < 100:
            raise Unsupported("this engine keeps its own weak prior")
        d = bayes.hmc_gaussian(self.spark, g, outcome, design, sigma2, self.chains, self.steps, seed=self.seed)
        r = d.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(design)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(design) for j, b in enumerate(design)]).first()
        k = range(len(design))
        return Posterior(tuple(design), np.array([r[f"m{i}"] for i in k]), np.array([[r[f"c{i}_{j}"] for j in k] for i in k]))


def infer(backend: Backend, g: Gram, outcome: str, design: Sequence[str], prior: Prior, sigma2: float) -> Posterior:
    """The backend's posterior, checked: names in order, finite means, a symmetric covariance."""
    p = backend.infer(g, outcome, design, prior, sigma2)
    if tuple(p.names) != tuple(design) or not np.isfinite(p.mean).all() or not np.allclose(p.cov, p.cov.T):
        raise EstimationError(f"backend {backend.name} returned no valid posterior")
    return p
