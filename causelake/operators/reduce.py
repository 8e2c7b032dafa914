"""The data reductions that nearly all estimators share; what leaves Spark is p x p.

Every reduction is one aggregate with map-side partial sums, so rows never shuffle: a task sends
one row per group.  Wide designs go through Arrow instead of thousands of sum expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causelake.errors import EstimationError
from causelake.schema import WEIGHT
from causelake.scratch import written

#: Columns beyond which a Gram is summed in Arrow batches.
WIDE = 12


def _column(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


@dataclass
class Gram:
    """Weighted cross products of named columns, the first being the constant.

    ``centred`` holds them about the means, which keeps its digits where means are large.
    """

    names: tuple[str, ...]
    matrix: np.ndarray
    centred: np.ndarray | None = None

    def __post_init__(self):
        if self.centred is None:
            m = self.matrix[0]
            self.centred = self.matrix - (np.outer(m, m) / m[0] if m[0] else 0.0)

    @classmethod
    def about(cls, names: Sequence[str], n: float, means: np.ndarray, centred: np.ndarray) -> Gram:
        """From the weight, the means (1 for the constant) and the cross products about them."""
        return cls(tuple(names), centred + n * np.outer(means, means), centred)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    @property
    def means(self) -> np.ndarray:
        return self.matrix[0] / self.n if self.n else np.zeros(len(self.names))

    def __add__(self, other: Gram) -> Gram:
        return self._joined(other, 1.0)

    def __sub__(self, other: Gram) -> Gram:
        return self._joined(other, -1.0)

    def _joined(self, other: Gram, sign: float) -> Gram:
        n = self.n + sign * other.n
        if not n or not other.n or not self.n:
            return self if not other.n else Gram(self.names, self.matrix + sign * other.matrix)
        means = (self.n * self.means + sign * other.n * other.means) / n
        gap = other.means - self.means
        return Gram.about(self.names, n, means, self.centred + sign * other.centred + sign * self.n * other.n / n * np.outer(gap, gap))

    def at(self, names: Sequence[str]) -> np.ndarray:
        return np.array([self.names.index(n) for n in names])

    def mean(self, name: str) -> float:
        return float(self.matrix[0, self.names.index(name)] / self.n)

    def covariance(self, names: Sequence[str]) -> np.ndarray:
        """Population covariance."""
        i = self.at(names)
        return self.centred[np.ix_(i, i)] / self.n

    def sub(self, rows: Sequence[str], columns: Sequence[str]) -> np.ndarray:
        return self.matrix[np.ix_(self.at(rows), self.at(columns))]


def gram(df: DataFrame, columns: dict[str, str | Column] | Sequence[str], by: Sequence[str] = (), batches: bool = False) -> Gram | dict[tuple, Gram]:
    """R1: X'WX of [1, columns] in one aggregate; keyed by group when ``by`` is given (few groups).

    Without weights Spark's covariances keep the products about the means in the same pass.  Weighted and
    wide Grams are summed about the columns' plain means, which a pass before gives; ``batches`` asks for the wide form, in Arrow batches.
    """
    columns = columns if isinstance(columns, dict) else {c: c for c in columns}
    names = ("1", *columns)
    values = list(map(_column, columns.values()))
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    wide, weighted = (batches or len(names) > WIDE) and not by, WEIGHT in df.columns
    if wide or weighted:
        guess = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], F.lit(0).alias("none")).first()
        shift = np.array([guess[f"m{i}"] or 0.0 for i in range(k)])
        moved = [v - F.lit(float(c)) for v, c in zip(values, shift)]
        w = (F.col(WEIGHT) if weighted else F.lit(1.0)).cast("double")
    if wide:
        return _about_shift(names, shift, _wide_sums(df, moved, w))
    if weighted:
        one = [F.lit(1.0), *moved]
        full = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        sums = [F.sum(w * one[i] * one[j]).alias(f"s{i}_{j}") for i, j in full]
    else:
        sums = [F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.covar_pop(values[i], values[j]).alias(f"c{i}_{j}") for i, j in pairs]]
    out = {}
    for r in df.groupBy(*by).agg(*sums).collect() if by else [df.agg(*sums).first()]:
        if weighted:
            m = np.zeros((k + 1, k + 1))
            for i, j in full:
                m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
            g = _about_shift(names, shift, m)
        else:
            c = np.zeros((k + 1, k + 1))
            for i, j in pairs:
                c[i + 1, j + 1] = c[j + 1, i + 1] = r["n"] * (r[f"c{i}_{j}"] or 0.0)
            g = Gram.about(names, float(r["n"]), np.array([1.0, *[r[f"m{i}"] or 0.0 for i in range(k)]]), c)
        out[tuple(r[b] for b in by)] = g
    return out if by else out[()]


def _about_shift(names: Sequence[str], shift: np.ndarray, m: np.ndarray) -> Gram:
    """A Gram from the sums of [1, columns - shift]."""
    n = float(m[0, 0])
    gap = m[0] / n if n else np.zeros(len(m))
    return Gram.about(names, n, np.array([1.0, *(shift + gap[1:])]), m - n * np.outer(gap, gap))


def _wide_sums(df: DataFrame, columns: list[Column], w: Column) -> np.ndarray:
    k = len(columns) + 1
    design = df.select(w.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(columns)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            x = np.stack([np.ones(b.num_rows), *cols[1:]])
            total += (x * cols[0]) @ x.T
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    m = np.zeros((k, k))
    for r in design.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return m


@dataclass
class Fit:
    """Least squares from a Gram: coefficients by name, residual sum of squares, (X'X)^-1."""

    names: tuple[str, ...]
    beta: np.ndarray
    rss: float
    inverse: np.ndarray
    n: float

    def __getitem__(self, name: str) -> float:
        return float(self.beta[self.names.index(name)])

    @property
    def sigma2(self) -> float:
        return self.rss / (self.n - len(self.names))

    def se(self, name: str) -> float:
        i = self.names.index(name)
        return math.sqrt(max(0.0, self.sigma2 * self.inverse[i, i]))

    def predict(self) -> Column:
        return linear(self.names, self.beta)


def linear(names: Sequence[str], beta: Sequence[float], values: dict[str, Column] | None = None) -> Column:
    """The linear predictor as a column expression."""
    terms = [F.lit(float(b)) * (F.lit(1.0) if n == "1" else (values or {}).get(n, F.col(n)).cast("double")) for n, b in zip(names, beta)]
    return fold(lambda a, b: a + b, terms)


def solve(g: Gram, outcome: str, design: Sequence[str], ridge: float = 0.0) -> Fit:
    """OLS of ``outcome`` on ``design`` (the constant is "1"), scaled first; a rank-deficient design is refused."""
    if "1" not in design:
        return _solve(design, g.sub(design, design), g.sub(design, [outcome])[:, 0], float(g.sub([outcome], [outcome])[0, 0]), g.n, ridge)
    rest = [d for d in design if d != "1"]
    i, o = g.at(rest) if rest else np.zeros(0, int), g.names.index(outcome)
    fit = _solve(rest, g.centred[np.ix_(i, i)], g.centred[i, o], float(g.centred[o, o]), g.n, ridge)
    # the constant comes back: about the means it is apart from the slopes
    m = g.means[i]
    beta, inverse = np.zeros(len(design)), np.zeros((len(design), len(design)))
    at, c = np.array([design.index(d) for d in rest], int), design.index("1")
    beta[at], beta[c] = fit.beta, g.means[o] - m @ fit.beta
    inverse[np.ix_(at, at)] = fit.inverse
    inverse[at, c] = inverse[c, at] = -fit.inverse @ m
    inverse[c, c] = 1 / g.n + m @ fit.inverse @ m
    return Fit(tuple(design), beta, fit.rss, inverse, g.n)


def _solve(names: Sequence[str], x: np.ndarray, xy: np.ndarray, yy: float, n: float, ridge: float) -> Fit:
    if not len(names):
        return Fit((), np.zeros(0), max(0.0, yy), np.zeros((0, 0)), n)
    scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
    unit = x / np.outer(scale, scale)
    if ridge:
        unit = unit + ridge * np.eye(len(names))
    elif np.linalg.matrix_rank(unit, tol=1e-10 * len(names)) < len(names):
        raise EstimationError("the design is rank deficient")
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    beta = inverse @ xy
    return Fit(tuple(names), beta, max(0.0, yy - 2 * float(beta @ xy) + float(beta @ x @ beta)), inverse, n)


def lasso(g: Gram, outcome: str, design: Sequence[str], penalty: float, rounds: int = 1000) -> dict[str, float]:
    """Coordinate descent on the Gram (constant unpenalised), columns standardised."""
    names = [d for d in design if d != "1"]
    c = g.covariance([*names, outcome])
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 1e-300))
    a, b = c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd
    beta = np.zeros(len(names))
    for _ in range(rounds):
        old = beta.copy()
        for j in range(len(names)):
            r = b[j] - a[j] @ beta + a[j, j] * beta[j]
            beta[j] = math.copysign(max(abs(r) - penalty, 0.0), r) / a[j, j]
        if np.abs(beta - old).max(initial=0) < 1e-12:
            break
    beta = beta / sd
    out = dict(zip(names, beta.tolist()))
    out["1"] = g.mean(outcome) - sum(v * g.mean(n) for n, v in out.items())
    return out


FAMILIES = {
    # mean, derivative of the mean, variance, as expressions of the linear predictor
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m), lambda m: m * (1 - m)),
    "poisson": (F.exp, lambda e, m: m, lambda m: m),
    "gaussian": (lambda e: e, lambda e, m: F.lit(1.0), lambda m: F.lit(1.0)),
}


def irls(df: DataFrame, outcome: str, design: Sequence[str], family: str = "logit", ridge: float = 0.0, max_iter: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """R2: Fisher scoring; each step is one aggregate over the cached design with beta as literals.

    Returns (beta, inverse information).  A step that diverges falls back to a small ridge once.
    """
    mean, slope, variance = FAMILIES[family]
    used = df.select(*{*[d for d in design if d != "1"], outcome}, *([WEIGHT] if WEIGHT in df.columns else [])).persist()
    w0 = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1.0)
    try:
        stats = used.agg(F.sum(w0).alias("n"), *[f(_column(d)).alias(f"{k}{i}") for i, d in enumerate(design) if d != "1" for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        # scaled columns keep the information matrix well conditioned
        centre = np.array([0.0 if d == "1" else stats[f"m{i}"] for i, d in enumerate(design)])
        scale = np.array([1.0 if d == "1" else (stats[f"s{i}"] or 1.0) for i, d in enumerate(design)])
        if "1" not in design:
            centre[:] = 0
        x = [F.lit(1.0) if d == "1" else (_column(d) - float(c)) / float(s) for d, c, s in zip(design, centre, scale)]
        beta, y, k = np.zeros(len(design)), _column(outcome), len(design)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        for _ in range(max_iter):
            eta = fold(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(beta, x)])
            eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)) if family != "gaussian" else eta
            m = mean(eta)
            d = slope(eta, m)
            w, r = w0 * d * d / variance(m), w0 * (y - m) * d / variance(m)
            row = used.agg(*[F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs], *[F.sum(r * x[i]).alias(f"g{i}") for i in range(k)]).first()
            h = np.zeros((k, k))
            for i, j in pairs:
                h[i, j] = h[j, i] = row[f"h{i}_{j}"]
            penal = ridge * np.diag([0.0 if n == "1" else stats["n"] for n in design])
            g = np.array([row[f"g{i}"] for i in range(k)]) - penal @ beta
            try:
                step = np.linalg.solve(h + penal, g)
            except np.linalg.LinAlgError as e:
                if ridge:
                    raise EstimationError("singular information") from e
                return irls(df, outcome, design, family, 1e-4, max_iter, tol)
            if np.abs(beta + step).max() > 25 and not ridge:  # separation
                return irls(df, outcome, design, family, 1e-4, max_iter, tol)
            beta = beta + step
            if np.abs(step).max() < tol:
                break
        t = np.diag(1 / scale)
        if "1" in design:
            t[design.index("1"), :] = -centre / scale
            t[design.index("1"), design.index("1")] = 1.0
        return t @ beta, t @ np.linalg.inv(h + penal) @ t.T
    finally:
        used.unpersist()


def cpt(df: DataFrame, target: Sequence[str], given: Sequence[str] = ()) -> DataFrame:
    """R4: P(target | given) as rows with ``p``."""
    joint = df.groupBy(*given, *target).agg(F.count("*").alias("__n"))
    if not given:
        total = joint.agg(F.sum("__n").alias("__d"))
        return joint.join(F.broadcast(total)).select(*target, (F.col("__n") / F.col("__d")).alias("p"))
    whole = Window.partitionBy(*given)
    return joint.withColumn("__d", F.sum("__n").over(whole)).select(*given, *target, (F.col("__n") / F.col("__d")).alias("p"))


def lag_frame(df: DataFrame, columns: Sequence[str], lags: Sequence[int], time: str, by: Sequence[str] = ()) -> DataFrame:
    """R5: columns ``v__lag{k}`` next to each row; a lag never crosses a unit or environment."""
    if any(k < 0 for k in lags):
        raise EstimationError("lags are steps back and cannot be negative")
    w = Window.partitionBy(*by).orderBy(time)
    return df.select("*", *[(F.col(c) if k == 0 else F.lag(c, k).over(w)).alias(f"{c}__lag{k}") for c in columns for k in lags])


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows written by ranges of an order, with the range's number ``__p``; rows of equal order share a range."""
    return written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """The rows with sums over all rows that come before in a total order; no task sees more than a range."""
    parts = ranged(df, order)
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    totals = parts.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = totals.select("__p", *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__l_{k}") for k, c in sums.items()])
    joined = local.join(F.broadcast(before), "__p")
    return joined.select(*df.columns, *[(F.col(f"__l_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums])


def replicates(df: DataFrame, count: int) -> DataFrame:
    """R7: each row once per replicate, so that all refits are groups of one job."""
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def sandwich(df: DataFrame, fit: Fit, outcome: str, kind: str = "HC1", clusters: Sequence[str] = (), time: str | None = None, max_lag: int = 0) -> np.ndarray:
    """Covariance of OLS coefficients: HC0-HC3, (multiway) cluster, Newey-West, panel HAC.

    Meat matrices are sums of score products; leverage is an expression of (X'X)^-1.
    """
    names = fit.names
    x = [F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names]
    k = len(names)
    residual = F.col(outcome).cast("double") - fit.predict()
    if kind == "homoskedastic":
        return fit.sigma2 * fit.inverse
    if kind in ("HC2", "HC3"):
        h = fold(lambda a, b: a + b, [F.lit(float(fit.inverse[i, j])) * x[i] * x[j] for i in range(k) for j in range(k)])
        residual = residual / (F.sqrt(1 - h) if kind == "HC2" else 1 - h)
    scored = df.select(*[(x[i] * residual).alias(f"s{i}") for i in range(k)], *clusters, *([time] if time else []))

    def meat(frame: DataFrame, right: str = "s") -> np.ndarray:
        row = frame.agg(*[F.sum(F.col(f"s{i}") * F.col(f"{right}{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        return np.array([[row[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])

    n = fit.n
    if kind in ("HC0", "HC1", "HC2", "HC3"):
        m = meat(scored) * (n / (n - k) if kind == "HC1" else 1.0)
    elif kind == "cluster":
        m = np.zeros((k, k))
        for mask in range(1, 1 << len(clusters)):  # inclusion and exclusion over the cluster subsets
            chosen = [c for b, c in enumerate(clusters) if mask >> b & 1]
            summed = scored.groupBy(*chosen).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
            groups = summed.count()
            sign = 1 if len(chosen) % 2 else -1
            m += sign * groups / (groups - 1) * (n - 1) / (n - k) * meat(summed)
    elif kind in ("newey_west", "panel_hac"):
        unit = list(clusters)
        if kind == "panel_hac" and not unit:
            raise EstimationError("a panel needs its unit")
        w = Window.partitionBy(*unit).orderBy(time)
        # in a panel a lag is one of the (whole-numbered) time label, so that a gap in a unit's series is no neighbour
        behind = (lambda c, lag: F.sum(c).over(w.rangeBetween(-lag, -lag))) if kind == "panel_hac" else (lambda c, lag: F.lag(c, lag).over(w))
        m = meat(scored)
        for lag in range(1, max_lag + 1):
            shifted = scored.select("*", *[behind(f"s{i}", lag).alias(f"l{i}") for i in range(k)]).where(F.col("l0").isNotNull())
            g = meat(shifted, "l")
            m += (1 - lag / (max_lag + 1)) * (g + g.T)
    else:
        raise EstimationError(f"no covariance {kind!r}")
    return fit.inverse @ m @ fit.inverse


def kish_ess(df: DataFrame, weight: str) -> DataFrame:
    w = F.col(weight).cast("double")
    return df.agg((F.sum(w) ** 2 / F.sum(w * w)).alias("ess"))


def normalise_log_weights(df: DataFrame, column: str, out: str = "weight") -> DataFrame:
    """exp(l - max) / sum; a maximum that is not finite is refused by ANSI arithmetic on the sum."""
    top = df.agg(F.max(column).alias("__top"))
    shifted = df.join(F.broadcast(top)).withColumn("__e", F.exp(F.col(column) - F.col("__top")))
    total = shifted.agg(F.sum("__e").alias("__z"))
    return shifted.join(F.broadcast(total)).withColumn(out, F.col("__e") / F.col("__z")).drop("__top", "__e", "__z")


def edge_marginals(graphs: DataFrame, bits: int, mask: str = "mask", weight: str = "weight") -> DataFrame:
    """Posterior probability of each edge bit over weighted graph masks."""
    edges = graphs.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    # the shift count is a column, so it goes through SQL
    hit = F.expr(f"shiftright({mask}, edge) & 1").cast("double")
    return edges.groupBy("edge").agg(F.sum(F.col(weight) * hit).alias("probability"))


def posterior_summary(draws: DataFrame, columns: Sequence[str], level: float = 0.95) -> DataFrame:
    """Mean, sd and equal-tailed interval of each quantity."""
    a = (1 - level) / 2
    parts = [
        draws.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.percentile(c, F.lit(a)).alias("low"), F.percentile(c, F.lit(1 - a)).alias("high")).select(F.lit(c).alias("quantity"), "*")
        for c in columns
    ]
    return fold(DataFrame.unionByName, parts)
