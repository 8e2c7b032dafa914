"""Conditional-independence tests over shared reductions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causelake.errors import EstimationError
from causelake.functions import special
from causelake.operators.estimate import _row
from causelake.operators.reduce import Gram, gram, running
from causelake.schema import complete_cases


def partial_r(cov: np.ndarray) -> float:
    """Partial correlation of the first two variables given the others, from their covariance."""
    sd = np.sqrt(np.diag(cov))
    if (sd <= 0).any():
        return 0.0
    precision = np.linalg.pinv(cov / np.outer(sd, sd))
    return float(np.clip(-precision[0, 1] / math.sqrt(precision[0, 0] * precision[1, 1]), -1, 1))


class Covariance:
    """A test handle: every partial-correlation query is answered from one covariance matrix."""

    def __init__(self, g: Gram):
        self.names = [n for n in g.names if n != "1"]
        self.n = g.n
        self._cov = g.covariance(self.names)

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> Covariance:
        return cls(gram(complete_cases(df, columns), list(columns)))

    def test(self, x: str, y: str, z: Sequence[str] = ()) -> tuple[float, float]:
        """(partial correlation, two-sided t p-value)."""
        at = [self.names.index(n) for n in (x, y, *z)]
        df = self.n - 2 - len(z)
        if df <= 0:
            raise EstimationError("no degrees of freedom left")
        r = partial_r(self._cov[np.ix_(at, at)])
        if abs(r) >= 1:
            return r, 0.0
        return r, special.t_two_sided(r * math.sqrt(df / (1 - r * r)), df)

    def bayes(self, x: str, y: str, z: Sequence[str] = ()) -> tuple[float, float]:
        """(log Bayes factor by BIC of dependence, posterior probability of dependence)."""
        r, _ = self.test(x, y, z)
        bf = -0.5 * self.n * math.log(max(1e-300, 1 - r * r)) - 0.5 * math.log(self.n)
        return bf, 1 / (1 + math.exp(-min(700.0, max(-700.0, bf))))


def partial_correlations(df: DataFrame, queries: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """``x, y, z, r, p, n`` of many queries from one aggregate."""
    columns = list(dict.fromkeys(c for x, y, z in queries for c in (x, y, *z)))
    h = Covariance.of(df, columns)
    rows = [(x, y, ",".join(z), *h.test(x, y, z), int(h.n)) for x, y, z in queries]
    return df.sparkSession.createDataFrame(rows, "x string, y string, z string, r double, p double, n long")


def robust_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Normal scores of average ranks (nonparanormal): ranks over distinct values, joined back.

    The quantile is a rational approximation in column arithmetic (absolute error below 5e-4).
    """
    n = df.agg(F.count("*").alias("__n"))
    out = df.join(F.broadcast(n))
    for c in columns:
        levels = df.groupBy(c).agg(F.count("*").alias("__k"))
        run = running(levels, c, {"__below": F.col("__k")}).withColumn("__a", F.col("__below") + (F.col("__k") + 1) / 2.0)
        u = F.col("__a") / (F.col("__n") + 1)
        t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
        q = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
        out = out.join(run.select(c, "__a"), c).withColumn(f"{c}__score", F.when(u < 0.5, -q).otherwise(q)).drop("__a")
    return out.drop("__n")


def g_squared(df: DataFrame, x: str, y: str, z: Sequence[str] = ()) -> DataFrame:
    """Likelihood-ratio test within strata of z; degrees of freedom from the levels present in each stratum."""
    cells = df.groupBy(*z, x, y).agg(F.count("*").cast("double").alias("n"))
    s = Window.partitionBy(*z)
    m = cells.withColumn("nx", F.sum("n").over(Window.partitionBy(*z, x))).withColumn("ny", F.sum("n").over(Window.partitionBy(*z, y))).withColumn("ns", F.sum("n").over(s))
    term = 2 * F.col("n") * F.log(F.col("n") * F.col("ns") / (F.col("nx") * F.col("ny")))
    by = m.where("ns >= 2").groupBy(*z).agg(F.sum(term).alias("g"), ((F.count_distinct(x) - 1) * (F.count_distinct(y) - 1)).alias("df"))
    r = by.agg(F.sum("g").alias("g"), F.sum("df").alias("df")).first()
    g, d = r["g"] or 0.0, max(1, r["df"] or 0)
    return _row(df, statistic=g, dof=int(d), p=special.chi2_sf(g, d))


def symbolic_cmi(df: DataFrame, x: str, y: str, z: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """Conditional mutual information of symbols (nats) with its G-squared test: columns as they are, or binned to equal widths."""
    from causelake.functions.transforms import equal_width_bin

    for c in (x, y, *z) if bins else ():
        df = equal_width_bin(df, c, bins, f"__s_{c}").drop(c).withColumnRenamed(f"__s_{c}", c)
    g = g_squared(df, x, y, z).first()
    n = complete_cases(df, [x, y, *z]).count()
    return _row(df, cmi=g["statistic"] / (2 * n) if n else 0.0, statistic=g["statistic"], dof=int(g["dof"]), p=g["p"])


def named_test(df: DataFrame, name: str, columns: Sequence[str] = (), graph=None) -> Callable[[str, str, Sequence[str]], tuple[float, float]]:
    """A test for the searches by name: ``parcorr`` (also ``regression``), ``robust_parcorr``, ``g_squared``, ``symbolic_cmi``, ``oracle``."""
    if name in ("parcorr", "regression"):
        return Covariance.of(df, list(columns)).test
    if name == "robust_parcorr":
        scored = robust_scores(df, columns).select(*[F.col(f"{c}__score").alias(c) for c in columns])
        return Covariance.of(scored, list(columns)).test
    if name == "g_squared":
        return discrete_test(df)
    if name == "symbolic_cmi":
        return lambda x, y, z=(): (lambda r: (r["cmi"], r["p"]))(symbolic_cmi(df, x, y, z).first())
    if name == "oracle":
        return oracle_test(graph)
    raise EstimationError(f"no independence test {name!r}")


def discrete_test(df: DataFrame) -> Callable[[str, str, Sequence[str]], tuple[float, float]]:
    """A test function over G-squared, for the searches."""

    def test(x: str, y: str, z: Sequence[str] = ()) -> tuple[float, float]:
        r = g_squared(df, x, y, z).first()
        return r["statistic"], r["p"]

    return test


def oracle_test(graph) -> Callable[[str, str, Sequence[str]], tuple[float, float]]:
    """A test that knows the graph."""

    def test(x: str, y: str, z: Sequence[str] = ()) -> tuple[float, float]:
        apart = graph.separated([x], [y], z)
        return (0.0, 1.0) if apart else (1.0, 0.0)

    return test


def knn_independence(df: DataFrame, queries: Sequence[tuple[str, str]], key: str, k: int = 5, permutations: int = 99, seed: int = 0) -> DataFrame:
    """Nearest-neighbour dependence with a permutation null, one group per query.

    The statistic needs only the order by x, so a query runs on all rows, in one task.
    """
    import pandas as pd

    rows = df.withColumn("__h", F.xxhash64(key))
    parts = None
    for i, (x, y) in enumerate(queries):
        p = rows.select(F.lit(i).alias("query"), "__h", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        parts = p if parts is None else parts.unionByName(p)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rng, g = np.random.default_rng([seed, int(g["query"].iloc[0])]), g.sort_values(["__h", "x", "y"])
        x, y = (((v - v.mean()) / (v.std() or 1)).to_numpy() for v in (g["x"], g["y"]))
        n = len(x)
        order = np.argsort(x, kind="stable")

        def stat(v: np.ndarray) -> float:
            s = v[order]
            d = [np.abs(s[j:] - s[:-j]).mean() for j in range(1, k + 1)]  # neighbours in x: are their y near?
            return -float(np.mean(d))

        real = stat(y)
        null = [stat(rng.permutation(y)) for _ in range(permutations)]
        return pd.DataFrame({"query": [g["query"].iloc[0]], "statistic": [real], "p": [(1 + sum(v >= real for v in null)) / (permutations + 1)], "n": [n]})

    return parts.groupBy("query").applyInPandas(run, "query int, statistic double, p double, n long")
