"""Bayesian estimation from shared reductions, and diagnostics of draws."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.errors import EstimationError
from causelake.functions import special
from causelake.functions.transforms import normal
from causelake.operators.reduce import Gram, irls


@dataclass
class Posterior:
    """Gaussian posterior of coefficients (given sigma2, or normal-inverse-gamma when shape is set)."""

    names: tuple[str, ...]
    mean: np.ndarray
    cov: np.ndarray
    shape: float | None = None
    rate: float | None = None

    def draws(self, spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
        """Draws as rows, each from hashed normals."""
        root = np.linalg.cholesky(self.cov + 1e-15 * np.eye(len(self.mean)))
        d = spark.range(count).withColumnRenamed("id", "draw")
        z = [normal(seed, f"z{i}", "draw") for i in range(len(self.mean))]
        return d.select("draw", *[
            (F.lit(float(m)) + sum((F.lit(float(root[i, j])) * z[j] for j in range(i + 1)), F.lit(0.0))).alias(n)
            for i, (n, m) in enumerate(zip(self.names, self.mean))
        ])


def conjugate(g: Gram, outcome: str, design: Sequence[str], prior_mean: Sequence[float] | None = None, prior_precision: float = 1e-6, sigma2: float | None = None, shape: float = 0.01, rate: float = 0.01) -> Posterior:
    """Normal prior with known variance, or normal-inverse-gamma."""
    k = len(design)
    m0, p0 = np.zeros(k) if prior_mean is None else np.asarray(prior_mean, float), prior_precision * np.eye(k)
    x, xy = g.sub(design, design), g.sub(design, [outcome])[:, 0]
    if sigma2 is not None:
        p = p0 + x / sigma2
        cov = np.linalg.inv(p)
        return Posterior(tuple(design), cov @ (p0 @ m0 + xy / sigma2), cov)
    p = p0 + x
    cov = np.linalg.inv(p)
    mean = cov @ (p0 @ m0 + xy)
    a = shape + g.n / 2
    b = rate + 0.5 * (float(g.sub([outcome], [outcome])[0, 0]) + m0 @ p0 @ m0 - mean @ p @ mean)
    return Posterior(tuple(design), mean, cov * b / (a - 1), a, b)


def laplace(df: DataFrame, outcome: str, design: Sequence[str], family: str = "logit", ridge: float = 1e-6) -> Posterior:
    """Mode and curvature of a GLM."""
    beta, cov = irls(df, outcome, design, family, ridge)
    return Posterior(tuple(design), beta, cov)


def hmc_gaussian(spark: SparkSession, g: Gram, outcome: str, design: Sequence[str], sigma2: float, chains: int = 4, steps: int = 500, warmup: int = 250, seed: int = 0) -> DataFrame:
    """Hamiltonian chains for a Gaussian likelihood, one task a chain; only the Gram travels."""
    x, xy = g.sub(design, design) / sigma2, g.sub(design, [outcome])[:, 0] / sigma2
    held = spark.sparkContext.broadcast((x + 1e-6 * np.eye(len(design)), xy))
    names = list(design)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = held.value
        scale = np.linalg.cholesky(np.linalg.inv(a))
        rng = np.random.default_rng([seed, int(group["chain"].iloc[0])])
        k, q, eps, rows = len(b), rng.normal(size=len(b)), 0.2, []
        # coordinates in which the posterior is close to standard
        h, c = scale.T @ a @ scale, scale.T @ b
        for s in range(steps + warmup):
            p = rng.normal(size=k)
            u, v = q.copy(), p - 0.5 * eps * (h @ q - c)
            for leap in range(10):
                u = u + eps * v
                v = v - (eps if leap < 9 else 0.5 * eps) * (h @ u - c)
            energy = lambda y, r: 0.5 * y @ h @ y - c @ y + 0.5 * r @ r
            accept = math.exp(min(0.0, energy(q, p) - energy(u, v)))
            if rng.random() < accept:
                q = u
            if s < warmup:
                eps *= math.exp(0.1 * (accept - 0.8))
            else:
                rows.append(scale @ q)
        out = pd.DataFrame(np.array(rows), columns=[f"b{i}" for i in range(k)])
        out.insert(0, "draw", range(steps))
        out.insert(0, "chain", int(group["chain"].iloc[0]))
        return out

    schema = "chain long, draw long, " + ", ".join(f"b{i} double" for i in range(len(names)))
    d = spark.range(chains).withColumnRenamed("id", "chain").groupBy("chain").applyInPandas(run, schema)
    return d.toDF("chain", "draw", *names)


def mcmc_diagnostics(draws: DataFrame, quantities: Sequence[str]) -> DataFrame:
    """Split R-hat and effective size per quantity; draws of one quantity are one group."""
    long = None
    for q in quantities:
        p = draws.select(F.lit(q).alias("quantity"), "chain", "draw", F.col(q).alias("v"))
        long = p if long is None else long.unionByName(p)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="draw", columns="chain", values="v").sort_index().to_numpy()
        half = len(wide) // 2
        x = np.concatenate([wide[:half], wide[half : 2 * half]], 1).T
        m, n = x.shape
        ranks = (np.argsort(np.argsort(x.ravel())) + 1 - 0.375) / (x.size + 0.25)
        z = np.array([special.norm_quantile(float(r)) for r in ranks]).reshape(m, n)
        w, b = z.var(1, ddof=1).mean(), n * z.mean(1).var(ddof=1)
        total = (n - 1) / n * w + b / n
        c = x - x.mean(1, keepdims=True)
        f = np.fft.rfft(c, 2 * n, axis=1)
        acov = np.fft.irfft(f * np.conj(f), 2 * n, axis=1)[:, :n] / n
        var = x.var(1, ddof=1).mean()
        plus = (n - 1) / n * var + x.mean(1).var(ddof=1)
        rho = 1 - (var - acov.mean(0)) / plus
        tau, t = -1.0, 0
        while t + 1 < n and rho[t] + rho[t + 1] > 0:
            tau += 2 * (rho[t] + rho[t + 1])
            t += 2
        return pd.DataFrame({"quantity": [g["quantity"].iloc[0]], "rhat": [math.sqrt(total / w)], "ess": [min(m * n / max(tau, 1e-9), m * n * math.log10(m * n))]})

    return long.groupBy("quantity").applyInPandas(run, "quantity string, rhat double, ess double")


def bayesian_gcomp(rows: DataFrame, draws: DataFrame, design: Sequence[str], t: str, active: float = 1.0, control: float = 0.0, family: str = "logit") -> DataFrame:
    """Mean contrast per posterior draw; identity link in closed form, else draws x rows aggregated by draw.

    Draws are a bounded table (their count is chosen), so they are the broadcast side.
    """
    if family == "gaussian":
        return draws.select("draw", (F.col(t) * (active - control)).alias("effect"))
    mean = (lambda e: 1 / (1 + F.exp(-e))) if family == "logit" else F.exp
    b = draws.select("draw", *[F.col(n).alias(f"__b{i}") for i, n in enumerate(design)])
    x = rows.join(F.broadcast(b))

    def at(level: float):
        return mean(sum((F.col(f"__b{i}") * (F.lit(1.0) if n == "1" else F.lit(level) if n == t else F.col(n)) for i, n in enumerate(design)), F.lit(0.0)))

    return x.groupBy("draw").agg(F.avg(at(active) - at(control)).alias("effect"))


def beta_moments(mean: float, var: float) -> tuple[float, float]:
    if not 0 < mean < 1 or var >= mean * (1 - mean):
        raise EstimationError("no beta distribution has these moments")
    k = mean * (1 - mean) / var - 1
    return mean * k, (1 - mean) * k


def gamma_moments(mean: float, var: float) -> tuple[float, float]:
    return mean * mean / var, mean / var


def power_prior(mean: float, var: float, alpha: float) -> tuple[float, float]:
    """A Gaussian prior from another study, discounted."""
    if not 0 < alpha <= 1:
        raise EstimationError("the discount lies in (0, 1]")
    return mean, var / alpha


def conflict_shrink(prior: tuple[float, float], estimate: tuple[float, float], alpha: float = 1.0) -> tuple[float, float]:
    """(discount reduced by the prior-predictive p of the estimate, that p)."""
    z = abs(prior[0] - estimate[0]) / math.sqrt(prior[1] + estimate[1])
    p = 2 * special.norm_sf(z)
    return alpha * min(1.0, p / 0.05), p


def mixture_prior(parts: Sequence[tuple[float, float, float]]) -> tuple[float, float]:
    """Mean and variance of a mixture of (weight, mean, variance)."""
    total = sum(w for w, _, _ in parts)
    mean = sum(w * m for w, m, _ in parts) / total
    return mean, sum(w * (v + (m - mean) ** 2) for w, m, v in parts) / total


def intersect_intervals(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``low, high`` that all identified intervals of a group share; null where they share none."""
    s = intervals.groupBy(*by).agg(F.max("low").alias("l"), F.min("high").alias("h"))
    held = F.col("l") <= F.col("h")
    return s.select(*by, F.when(held, F.col("l")).alias("low"), F.when(held, F.col("h")).alias("high"))


def effect_envelope(graphs: DataFrame) -> DataFrame:
    """Mixture over graphs of (weight, effect or null): unidentified mass is reported, never spread over the rest."""
    known = F.col("effect").isNotNull()
    mass = F.sum(F.when(known, F.col("weight")))
    return graphs.agg(
        (F.sum(F.when(known, F.col("weight") * F.col("effect"))) / mass).alias("identified_mean"), F.min("effect").alias("low"), F.max("effect").alias("high"),
        (mass / F.sum("weight")).alias("identified_mass"), (1 - mass / F.sum("weight")).alias("unidentified_mass"),
    )
