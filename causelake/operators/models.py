"""Choosing, checking, conditioning and comparing structural models.

All of it is closed form on one Gram (or one Gram a population) wherever the model is linear; rows are
read by at most one more aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.errors import EstimationError, GraphError, Unsupported
from causelake.functions import special
from causelake.functions.transforms import normal, normal_cdf
from causelake.graphs.dag import Dag
from causelake.operators.attribution import EXACT_PLAYERS, shapley
from causelake.operators.ci import Covariance
from causelake.operators.reduce import Gram, gram, irls, solve
from causelake.operators.scm import Discrete, Linear, Model

# --- further families


@dataclass
class Logistic:
    """P(1 | parents) by a logistic curve; drawn by one uniform, not invertible."""

    intercept: float
    coefficients: dict[str, float]

    def probability(self, values: dict[str, Column]) -> Column:
        eta = sum((F.lit(b) * values[p] for p, b in self.coefficients.items()), F.lit(self.intercept))
        return 1 / (1 + F.exp(-eta))

    def value(self, values: dict[str, Column], noise: Column) -> Column:
        """``noise`` is standard normal, as for the other smooth families; its distribution function makes a uniform of it."""
        return F.when(normal_cdf(noise) < self.probability(values), 1.0).otherwise(0.0)

    def log_density(self, values: dict[str, Column], own: Column) -> Column:
        p = self.probability(values)
        return F.when(own == 1, F.log(p)).otherwise(F.log1p(-p))


@dataclass
class Custom:
    """A mechanism given by its caller as column expressions: ``evaluate(parents, noise)`` and, optionally, its inverse and density."""

    evaluate: Callable[[dict[str, Column], Column], Column]
    infer_noise: Callable[[dict[str, Column], Column], Column] | None = None
    log_prob: Callable[[dict[str, Column], Column], Column] | None = None
    #: True where the callbacks cross into Python (a Pandas UDF); plans record it.
    python: bool = False

    def value(self, values: dict[str, Column], noise: Column) -> Column:
        return self.evaluate(values, noise)

    def noise(self, values: dict[str, Column], own: Column) -> Column:
        if self.infer_noise is None:
            raise Unsupported("this mechanism has no inverse, so its noise cannot be abducted")
        return self.infer_noise(values, own)

    def log_density(self, values: dict[str, Column], own: Column) -> Column:
        if self.log_prob is None:
            raise Unsupported("this mechanism has no density")
        return self.log_prob(values, own)


def fit_logistic(df: DataFrame, node: str, parents: Sequence[str]) -> Logistic:
    beta, _ = irls(df, node, ["1", *parents], "logit")
    return Logistic(float(beta[0]), {p: float(b) for p, b in zip(parents, beta[1:])})


def _gaussian_score(n: float, rss: float, parents: int) -> float:
    """Log-likelihood at the fit, less half a log n for each coefficient."""
    return -0.5 * n * (1 + math.log(2 * math.pi) + math.log(max(rss / n, 1e-300))) - 0.5 * (parents + 1) * math.log(n)


def assign(df: DataFrame, graph: Dag, discrete: Sequence[str] = (), most_cells: int = 10_000) -> tuple[Model, DataFrame]:
    """Scores the families of each node, takes the best and fits it; also returns ``node, family, score, selected``.

    Smooth nodes choose between ``constant`` and ``linear`` (scores from one Gram); discrete ones between a table of
    their own (``discrete_root``) and one by their parents' levels (``discrete``).  A score is the log-likelihood less
    half a log n for each parameter, so families of one node compare; ties take the simpler one.
    """
    smooth = [n for n in graph.nodes if n not in discrete]
    scores: list[tuple[str, str, float]] = []
    model = Model(graph)
    if smooth:
        g = gram(df, smooth)
        for n in smooth:
            parents = sorted(graph.parents[n])
            if set(parents) & set(discrete):
                raise Unsupported(f"{n} mixes discrete parents with a smooth mechanism")
            alone = solve(g, n, ["1"])
            options = [("constant", _gaussian_score(alone.n, alone.rss, 0), Linear(alone["1"], {}, math.sqrt(alone.rss / alone.n)))]
            if parents:
                fit = solve(g, n, ["1", *parents])
                options.append(("linear", _gaussian_score(fit.n, fit.rss, len(parents)), Linear(fit["1"], {p: fit[p] for p in parents}, math.sqrt(fit.rss / fit.n))))
            scores += [(n, name, s) for name, s, _ in options]
            model.mechanisms[n] = max(options, key=lambda o: o[1])[2]
    for n in discrete:
        parents = tuple(sorted(graph.parents[n]))
        options = [("discrete_root", *_table(df, n, (), most_cells))]
        if parents:
            options.append(("discrete", *_table(df, n, parents, most_cells)))
        scores += [(n, name, s) for name, s, _ in options]
        model.mechanisms[n] = max(options, key=lambda o: o[1])[2]
    best = {n: max(s for m, _, s in scores if m == n) for n in graph.nodes}
    rows = [(n, f, float(s), s == best[n]) for n, f, s in scores]
    return model, df.sparkSession.createDataFrame(rows, "node string, family string, score double, selected boolean")


def _table(df: DataFrame, n: str, parents: tuple[str, ...], most_cells: int) -> tuple[float, Discrete]:
    cells = df.groupBy(*parents, n).agg(F.count("*").alias("n")).limit(most_cells + 1).collect()
    if len(cells) > most_cells:
        raise EstimationError(f"{n} has more than {most_cells} cells")
    levels = sorted({r[n] for r in cells})
    counts: dict[tuple, list[float]] = {}
    for r in cells:
        counts.setdefault(tuple(r[p] for p in parents), [0.0] * len(levels))[levels.index(r[n])] = float(r["n"])
    total = sum(map(sum, counts.values()))
    loglik = sum(c * math.log(c / sum(row)) for row in counts.values() for c in row if c)
    table = {k: [c / sum(row) for c in row] for k, row in counts.items()}
    return loglik - 0.5 * len(counts) * (len(levels) - 1) * math.log(total), Discrete(levels, table, parents)


# --- checks


def _linear_only(model: Model) -> None:
    if not all(isinstance(m, Linear) for m in model.mechanisms.values()):
        raise Unsupported("this needs linear mechanisms")


def local_markov(graph: Dag, h: Covariance) -> list[tuple[str, str, tuple[str, ...], float, float]]:
    """(node, non-descendant, parents, partial correlation, p) of every independence the graph claims next to a node."""
    out = []
    for n in graph.nodes:
        parents = tuple(sorted(graph.parents[n]))
        for o in graph.nodes:
            if o == n or o in parents or o in graph.descendants([n]):
                continue
            out.append((n, o, parents, *h.test(n, o, parents)))
    return out


def evaluate(model: Model, df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row on how a linear model stands up to data.

    ``loglik`` and ``permutation_loglik`` are means per node value, the latter the expectation over all permutations of
    each node's values (closed form: a shuffled value is unrelated to what its row predicts); ``mean_abs_residual`` is over
    nodes and rows; ``least_markov_p`` and ``least_residual_p`` are the least p-values (null without tests) of the local
    Markov conditions and of residuals against non-descendants that are no parents; ``falsified`` is true where one of them
    is below ``alpha``.  Reads the rows twice: a Gram, and a mean of absolute residuals.
    """
    _linear_only(model)
    nodes = model.graph.nodes
    rows = df.select(*nodes).dropna()
    g = gram(rows, list(nodes))
    if not g.n:
        raise EstimationError("no complete rows")
    h = Covariance(g)
    cov = {(a, b): float(v) for a, line in zip(nodes, g.covariance(list(nodes))) for b, v in zip(nodes, line)}
    loglik = permuted = 0.0
    residual_p = []
    for n in nodes:
        m = model.mechanisms[n]
        b = m.coefficients
        gap = g.mean(n) - m.intercept - sum(c * g.mean(p) for p, c in b.items())
        explained = sum(b[p] * b[q] * cov[p, q] for p in b for q in b)
        shared = sum(c * cov[p, n] for p, c in b.items())
        spread = max(m.sd, 1e-300) ** 2
        base = -0.5 * math.log(2 * math.pi * spread)
        loglik += base - 0.5 * (cov[n, n] - 2 * shared + explained + gap * gap) / spread
        permuted += base - 0.5 * (cov[n, n] + explained + gap * gap) / spread
        residual_var = cov[n, n] - 2 * shared + explained
        for o in nodes:
            if o == n or o in b or o in model.graph.descendants([n]):
                continue
            c = cov[n, o] - sum(v * cov[p, o] for p, v in b.items())
            r = c / math.sqrt(residual_var * cov[o, o]) if residual_var > 0 and cov[o, o] > 0 else 0.0
            r = max(-1.0, min(1.0, r))
            residual_p.append(special.t_two_sided(r * math.sqrt((g.n - 2) / (1 - r * r)), g.n - 2) if abs(r) < 1 else 0.0)
    markov_p = [t[4] for t in local_markov(model.graph, h)]
    gaps = [F.abs(F.col(n) - model.mechanisms[n].mean({p: F.col(p) for p in model.graph.parents[n]})) for n in nodes]
    mean_abs = rows.agg(F.avg(sum(gaps[1:], gaps[0]) / len(nodes)).alias("a")).first()["a"]
    least = [min(v) if v else None for v in (markov_p, residual_p)]
    report = (loglik / len(nodes), permuted / len(nodes), float(mean_abs), *least, any(p is not None and p < alpha for p in least), alpha)
    return df.sparkSession.createDataFrame([report], "loglik double, permutation_loglik double, mean_abs_residual double, least_markov_p double, least_residual_p double, falsified boolean, alpha double")


# --- conditioning


def conditional_moments(model: Model, target: str, given: dict[str, float], do: dict[str, float] | None = None) -> tuple[float, float]:
    """Mean and variance of the target under interventions among units at the given values; exact for linear models."""
    _linear_only(model)
    if set(given) & set(do or {}):
        raise Unsupported("cannot condition on a node that is set")
    mean, cov = model.moments(do)
    c = list(given)
    if not c:
        return mean[target], cov[target, target]
    s = np.array([[cov[a, b] for b in c] for a in c])
    k = np.array([cov[target, b] for b in c])
    if np.linalg.matrix_rank(s) < len(c):
        raise EstimationError("the conditions do not vary under these interventions")
    w = np.linalg.solve(s, k)
    return float(mean[target] + w @ [given[b] - mean[b] for b in c]), float(max(0.0, cov[target, target] - w @ k))


def sample_conditional(model: Model, spark: SparkSession, count: int, given: dict[str, float], do: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Draws under interventions with the given nodes at their values, each with its likelihood ``weight``.

    Nodes are drawn in order; a given node takes its value and adds the log density of it under its parents.  Weights are
    relative to the largest, so that means of the draws by weight are conditional means; nothing is resampled.
    """
    do = do or {}
    if not given or set(given) & set(do):
        raise Unsupported("condition on at least one node, and on none that is set")
    out = spark.range(count).withColumnRenamed("id", "row").withColumn("__l", F.lit(0.0))
    for n in model.graph.order():
        values, m = {p: F.col(p) for p in model.graph.parents[n]}, model.mechanisms[n]
        if n in do:
            out = out.withColumn(n, F.lit(float(do[n])))
        elif n in given:
            out = out.withColumn(n, F.lit(float(given[n]))).withColumn("__l", F.col("__l") + m.log_density(values, F.lit(float(given[n]))))
        else:
            out = out.withColumn(n, m.value(values, model._noise(n, seed, "row")))
    top = out.agg(F.max("__l").alias("__top"))
    return out.join(F.broadcast(top)).withColumn("weight", F.exp(F.col("__l") - F.col("__top"))).drop("__l", "__top")


def predictive_draws(rows: DataFrame, draws: DataFrame, design: Sequence[str], key: str, sd: float | None = None, seed: int = 0) -> DataFrame:
    """``draw, key, predicted``: an outcome for each row from each draw of the coefficients, with noise where ``sd`` is given.

    The draws are as many as the caller chose, so they are the broadcast side; rows never shuffle.
    """
    b = draws.select("draw", *[F.col(n).alias(f"__b{i}") for i, n in enumerate(design)])
    eta = sum((F.col(f"__b{i}") * (F.lit(1.0) if n == "1" else F.col(n)) for i, n in enumerate(design)), F.lit(0.0))
    noise = F.lit(sd) * normal(seed, "predictive", "draw", key) if sd else F.lit(0.0)
    return rows.join(F.broadcast(b)).select("draw", key, (eta + noise).alias("predicted"))


# --- attribution between models


def structure_change(before: DataFrame, after: DataFrame, old: Dag, new: Dag, target: str, kind: str = "mean") -> dict[str, float]:
    """Shapley shares of the nodes whose parent sets differ in the change of the target's mean (or variance).

    A coalition takes the new parents; its mechanisms are fitted on the new population, all others on the old.  Only
    ancestors of the target in either graph are players.  One Gram a population serves every coalition; a hybrid that
    closes a cycle is refused.
    """
    if set(old.nodes) != set(new.nodes):
        raise GraphError("both graphs need the same nodes")
    reach = set(old.ancestors([target])) | set(new.ancestors([target])) | {target}
    players = [n for n in old.nodes if old.parents[n] != new.parents[n] and n in reach]
    if not players:
        raise EstimationError("the parent sets of the target's ancestors agree")
    if len(players) > EXACT_PLAYERS:
        raise Unsupported(f"at most {EXACT_PLAYERS} players")
    grams = {False: gram(before, list(old.nodes)), True: gram(after, list(old.nodes))}
    fitted = {(n, s): _linear(grams[s], n, (new if s else old).parents[n]) for n in old.nodes for s in (False, True)}

    def value(swapped: frozenset[str]) -> float:
        parents = {n: (new if n in swapped else old).parents[n] for n in old.nodes}
        hybrid = Dag(old.nodes, [(p, n) for n in old.nodes for p in parents[n]])
        mean, cov = Model(hybrid, {n: fitted[n, n in swapped] for n in old.nodes}).moments()
        return mean[target] if kind == "mean" else cov[target, target]

    return shapley(players, value)


def _linear(g: Gram, n: str, parents) -> Linear:
    names = sorted(parents)
    fit = solve(g, n, ["1", *names])
    return Linear(fit["1"], {p: fit[p] for p in names}, math.sqrt(fit.rss / fit.n))


def feature_relevance(model: Model, outcome: str, features: Sequence[str], delta: float = 1.0) -> dict[str, float]:
    """|Shapley value| of each feature in E[outcome | do(features of a coalition at their means + delta)].

    Linear models give the expectations in closed form; a fitted one has the data's means as its own.
    """
    _linear_only(model)
    means, _ = model.moments()
    values = shapley(list(features), lambda s: model.moments({f: means[f] + delta for f in s})[0][outcome])
    return {f: abs(v) for f, v in values.items()}


def posterior_ranks(draws: DataFrame, component: str = "component", value: str = "contribution", weight: str | None = None) -> DataFrame:
    """``component, score, spread`` over posterior draws (or weighted models): size of the mean and the spread around it, in one aggregate."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = draws.where(F.col(value).isNotNull()).groupBy(component).agg(F.sum(w).alias("w"), (F.sum(w * F.col(value)) / F.sum(w)).alias("m"), (F.sum(w * F.col(value) * F.col(value)) / F.sum(w)).alias("q"))
    return s.select(component, F.abs("m").alias("score"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("spread"))


def redundant_arrows(graph: Dag, h: Covariance, alpha: float = 0.05) -> list[tuple[str, str, float]]:
    """Arrows that the data do not need: parent and child unrelated given the child's other parents."""
    out = []
    for n in graph.nodes:
        for p in sorted(graph.parents[n]):
            _, q = h.test(p, n, sorted(graph.parents[n] - {p}))
            if q >= alpha:
                out.append((p, n, q))
    return out


__all__ = [
    "Custom", "Logistic", "assign", "conditional_moments", "evaluate", "feature_relevance", "fit_logistic", "local_markov", "posterior_ranks", "predictive_draws", "redundant_arrows", "sample_conditional", "structure_change",
]
