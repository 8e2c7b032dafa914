"""Response curves, further regression families, resampling and distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causelake.errors import EstimationError
from causelake.functions import special
from causelake.functions.transforms import bspline_columns, gaussian_density, intervened, uniform
from causelake.operators.estimate import _row, global_rank
from causelake.operators.reduce import Fit, gram, linear, solve
from causelake.schema import WEIGHT, complete_cases


def multinomial_logit(df: DataFrame, outcome: str, design: Sequence[str], levels: Sequence, max_iter: int = 50, tol: float = 1e-8) -> dict:
    """Fisher scoring against the first level; each step is one aggregate of the block information."""
    rest, k = list(levels)[1:], len(design)
    m = len(rest)
    x = [F.lit(1.0) if d == "1" else F.col(d).cast("double") for d in design]
    rows = df.select(*{d for d in design if d != "1"}, outcome).persist()
    beta = np.zeros((m, k))
    try:
        for _ in range(max_iter):
            eta = [sum((F.lit(float(beta[j, i])) * x[i] for i in range(k)), F.lit(0.0)) for j in range(m)]
            top = F.greatest(F.lit(0.0), *eta) if m > 0 else F.lit(0.0)
            z = F.exp(-top) + sum((F.exp(e - top) for e in eta), F.lit(0.0))
            p = [F.exp(e - top) / z for e in eta]
            aggs = [F.sum(((F.col(outcome) == F.lit(v)).cast("double") - p[j]) * x[i]).alias(f"g{j}_{i}") for j, v in enumerate(rest) for i in range(k)]
            for a in range(m):
                for b in range(a, m):
                    w = p[a] * ((1.0 if a == b else 0.0) - p[b])
                    aggs += [F.sum(w * x[i] * x[j]).alias(f"h{a}_{b}_{i}_{j}") for i in range(k) for j in range(k)]
            r = rows.agg(*aggs).first()
            g = np.array([[r[f"g{j}_{i}"] for i in range(k)] for j in range(m)]).ravel()
            h = np.zeros((m * k, m * k))
            for a in range(m):
                for b in range(a, m):
                    block = np.array([[r[f"h{a}_{b}_{i}_{j}"] for j in range(k)] for i in range(k)])
                    h[a * k : a * k + k, b * k : b * k + k] = block
                    h[b * k : b * k + k, a * k : a * k + k] = block.T
            step = np.linalg.solve(h, g)
            beta = beta + step.reshape(m, k)
            if np.abs(step).max() < tol:
                break
        return {v: dict(zip(design, beta[j].tolist())) for j, v in enumerate(rest)}
    finally:
        rows.unpersist()


def probit_expressions(eta: Column) -> tuple[Column, Column]:
    """Normal cdf and density as column arithmetic (absolute error of the cdf below 1.5e-7)."""
    a = F.abs(eta) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    upper = 0.5 * poly * F.exp(-a * a)
    return F.when(eta >= 0, 1 - upper).otherwise(upper), gaussian_density(eta, 0.0, 1.0)


def probit(df: DataFrame, outcome: str, design: Sequence[str], max_iter: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Probit by Fisher scoring: (beta, inverse information)."""
    x = [F.lit(1.0) if d == "1" else F.col(d).cast("double") for d in design]
    k, beta, y = len(design), np.zeros(len(design)), F.col(outcome).cast("double")
    for _ in range(max_iter):
        eta = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))))
        p, d = probit_expressions(eta)
        v = F.greatest(p * (1 - p), F.lit(1e-12))
        r = df.agg(*[F.sum(d * d / v * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(d * (y - p) / v * x[i]).alias(f"g{i}") for i in range(k)]).first()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta, np.linalg.inv(h)


def negative_binomial(df: DataFrame, outcome: str, design: Sequence[str], rounds: int = 25) -> tuple[np.ndarray, float]:
    """NB2: (beta, dispersion), alternating reweighted Grams and a moment step for the dispersion."""
    y, x = F.col(outcome).cast("double"), [F.lit(1.0) if d == "1" else F.col(d).cast("double") for d in design]
    k, alpha = len(design), 0.1
    beta = np.zeros(k)
    if "1" in design:
        beta[list(design).index("1")] = math.log(max(df.agg(F.avg(y)).first()[0], 1e-9))
    for _ in range(rounds):
        mu = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0)))))
        w = mu / (1 + alpha * mu)
        r = df.agg(
            *[F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum((y - mu) / (1 + alpha * mu) * x[i]).alias(f"g{i}") for i in range(k)],
            F.sum((y - mu) ** 2 - mu).alias("over"), F.sum(mu * mu).alias("square"),
        ).first()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]))
        beta, alpha = beta + step, max(1e-8, r["over"] / r["square"])
        if np.abs(step).max() < 1e-9:
            break
    return beta, alpha


def gam(df: DataFrame, y: str, smooth: dict[str, int], linear_terms: Sequence[str] = (), penalty: float = 1.0) -> tuple[Fit, dict[str, list[Column]]]:
    """Additive model: cubic B-splines on equal knots with a second-difference penalty, solved as one block on the Gram.

    Returns the fit and the basis columns of each smooth term, for prediction anywhere.
    """
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in smooth for k, f in (("lo", F.min), ("hi", F.max))]).first()
    columns: dict[str, Column] = {c: F.col(c) for c in linear_terms}
    bases, groups = {}, []
    for c, n in smooth.items():
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        inner = np.linspace(lo, hi, n - 2)
        knots = [lo] * 3 + inner.tolist() + [hi] * 3
        basis = bspline_columns(F.col(c).cast("double"), knots)
        bases[c] = basis
        groups.append((len(columns), len(basis)))
        columns |= {f"s({c}){i}": b for i, b in enumerate(basis)}
    # in Arrow batches: nested basis expressions would be repeated in every product of a sum
    g = gram(df, {**columns, y: y}, batches=True)
    design = ["1", *columns]
    x, xy = g.sub(design, design), g.sub(design, [y])[:, 0]
    p = 1e-9 * g.n * np.eye(len(design))
    p[0, 0] = 0
    for start, n in groups:
        d = np.diff(np.eye(n), 2, axis=0)
        p[start + 1 : start + 1 + n, start + 1 : start + 1 + n] += penalty * d.T @ d
    inverse = np.linalg.inv(x + p)
    beta = inverse @ xy
    yy = float(g.sub([y], [y])[0, 0])
    return Fit(tuple(design), beta, max(0.0, yy - 2 * float(beta @ xy) + float(beta @ x @ beta)), inverse, g.n), bases


def gam_derivative(df: DataFrame, t: str, y: str, z: Sequence[str], at: Sequence[float], basis: int = 8, step: float = 1e-3) -> DataFrame:
    """Plug-in derivative of the mean response in the treatment at chosen doses, by central differences."""
    fit, bases = gam(complete_cases(df, [t, y, *z]), y, {t: basis}, z)
    beta = dict(zip(fit.names, fit.beta))

    smooth = sum((F.lit(float(beta[f"s({t}){i}"])) * b for i, b in enumerate(bases[t])), F.lit(0.0))
    grid = df.sparkSession.createDataFrame([(float(a), float(a + s)) for a in at for s in (-step, step)], f"dose double, {t} double")
    v = grid.withColumn("f", smooth)
    w = v.groupBy("dose").agg(((F.max_by("f", t) - F.min_by("f", t)) / (2 * step)).alias("derivative"))
    return w.orderBy("dose")


def intervention_response(df: DataFrame, t: str, y: str, z: Sequence[str], policies: dict[str, tuple[str, object]], key: str, seed: int = 0) -> DataFrame:
    """Mean outcome under set, shift or stochastic policies, by a linear model with a squared treatment.

    A finite stochastic policy on a discrete set is the exact mixture of its levels.
    """
    rows = complete_cases(df, [t, y, *z], [key])
    square = F.col(t).cast("double") ** 2
    fit = solve(gram(rows, {t: t, "__t2": square, **{c: c for c in z}, y: y}), y, ["1", t, "__t2", *z])
    mean = lambda v: linear(fit.names, fit.beta, {t: v, "__t2": v * v})
    aggs = []
    for name, (kind, value) in policies.items():
        if kind == "stochastic":
            e = sum((F.lit(float(p)) * mean(F.lit(float(v))) for v, p in value), F.lit(0.0))
        else:
            e = mean(intervened(t, kind, value, seed, key))
        aggs.append(F.avg(e).alias(name))
    one = rows.agg(*aggs).first()
    return df.sparkSession.createDataFrame([(k, float(one[k])) for k in policies], "policy string, mean double")


def support_report(df: DataFrame, t: str, grid: Sequence[float], bandwidth: float, weak: float = 30.0) -> DataFrame:
    """Local effective size at each dose, whether it lies in the observed range, and a verdict."""
    rows = df.select(F.col(t).cast("double").alias("t")).where("t is not null").withColumn("dose", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    u = (F.col("t") - F.col("dose")) / bandwidth
    w = F.exp(-0.5 * u * u)
    s = rows.groupBy("dose").agg(F.when(F.sum(w * w) > 0, F.sum(w) ** 2 / F.sum(w * w)).otherwise(0.0).alias("ess"), (F.col("dose").between(F.min("t"), F.max("t"))).alias("inside"))
    return s.withColumn("support", F.when(~F.col("inside"), "out of range").when(F.col("ess") < weak, "weak").otherwise("strong"))


def simultaneous_band(df: DataFrame, t: str, pseudo: str, key: str, grid: Sequence[float], bandwidth: float, draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Local means with a uniform band: the critical value is a quantile of the largest studentised wild-bootstrap deviation.

    All draws and grid points are groups of one aggregate.
    """
    rows = df.select(F.col(t).cast("double").alias("t"), F.col(pseudo).cast("double").alias("v"), F.col(key).alias("k")).withColumn("dose", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    u = (F.col("t") - F.col("dose")) / bandwidth
    rows = rows.withColumn("w", F.exp(-0.5 * u * u)).where("w > 1e-9")
    centre = rows.groupBy("dose").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"), F.sum("w").alias("total"))
    r = rows.join(F.broadcast(centre), "dose").withColumn("s", F.col("w") * (F.col("v") - F.col("mean")) / F.col("total"))
    se = r.groupBy("dose").agg(F.sqrt(F.sum(F.col("s") ** 2)).alias("se"))
    sign = F.when(uniform(seed, "wild", "k", "draw") < 0.5, -1.0).otherwise(1.0)
    wild = r.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).groupBy("dose", "draw").agg(F.sum(F.col("s") * sign).alias("d"))
    top = wild.join(F.broadcast(se), "dose").groupBy("draw").agg(F.max(F.abs(F.col("d")) / F.col("se")).alias("m"))
    crit = top.agg(F.percentile("m", F.lit(level)).alias("c"))
    out = centre.join(se, "dose").join(F.broadcast(crit))
    return out.select("dose", "mean", "se", (F.col("mean") - F.col("c") * F.col("se")).alias("low"), (F.col("mean") + F.col("c") * F.col("se")).alias("high"))


def transported_response(df: DataFrame, t: str, y: str, z: Sequence[str], trial: str, grid: Sequence[float]) -> DataFrame:
    """Mean response over the target's covariates of a model fitted in the trial."""
    inside = F.col(trial).cast("boolean")
    fit = solve(gram(complete_cases(df.where(inside), [t, y, *z]), {t: t, "__t2": F.col(t).cast("double") ** 2, **{c: c for c in z}, y: y}), y, ["1", t, "__t2", *z])
    target = df.where(~inside).withColumn("dose", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return target.groupBy("dose").agg(F.avg(linear(fit.names, fit.beta, {t: F.col("dose"), "__t2": F.col("dose") ** 2})).alias("mean"))


def censored_gaussian(df: DataFrame, y: str, x: Sequence[str], limit: float, rounds: int = 60) -> tuple[dict[str, float], float]:
    """Regression with outcomes censored below a limit, by expectation-maximisation on Grams: (coefficients, sd)."""
    design = ["1", *x]
    rows = df.select(*x, y).persist()
    try:
        fit = solve(gram(rows, [*x, y]), y, design)
        sd = math.sqrt(fit.sigma2)
        for _ in range(rounds):
            m = linear(design, fit.beta)
            a = (F.lit(limit) - m) / sd
            cdf, pdf = probit_expressions(F.greatest(F.lit(-7.0), F.least(F.lit(7.0), a)))
            hazard = pdf / F.greatest(cdf, F.lit(1e-12))
            hidden = F.col(y) <= limit
            filled = F.when(hidden, m - sd * hazard).otherwise(F.col(y))
            spread = F.when(hidden, sd * sd * (1 - a * hazard - hazard * hazard)).otherwise(0.0)
            e = rows.withColumn("__y", filled).withColumn("__v", spread)
            g = gram(e, [*x, "__y", "__v"])
            new = solve(g, "__y", design)
            new_sd = math.sqrt((new.rss + g.matrix[0, g.names.index("__v")]) / g.n)
            done = np.abs(new.beta - fit.beta).max() < 1e-8 and abs(new_sd - sd) < 1e-8
            fit, sd = new, new_sd
            if done:
                break
        return dict(zip(design, fit.beta.tolist())), sd
    finally:
        rows.unpersist()


def do_weighting(df: DataFrame, t: str, y: str, z: Sequence[str], level: float) -> DataFrame:
    """Interventional mean by weighting rows of a discrete treatment at the level by their cell's inverse share."""
    cells = df.groupBy(*z).agg(F.avg((F.col(t) == F.lit(level)).cast("double")).alias("__p"))
    x = df.join(cells, list(z)).where(F.col(t) == F.lit(level))
    return x.agg((F.sum(F.col(y) / F.col("__p")) / F.sum(1 / F.col("__p"))).alias("mean"), F.count("*").alias("n"))


# --- resampling


def multinomial_bootstrap(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement, exactly n a replicate: positions are drawn and joined to numbered rows."""
    numbered = global_rank(df, [key], "__r").persist()
    n = numbered.count()
    draws = df.sparkSession.range(n * count).select((F.col("id") / n).cast("long").alias("replicate"), (F.floor(uniform(seed, "draw", "id") * n) + 1).alias("__r"))
    return draws.join(numbered, "__r").drop("__r")


def cluster_bootstrap(df: DataFrame, cluster: str, count: int, seed: int = 0) -> DataFrame:
    """Exponential weights drawn per cluster and joined to its rows."""
    from causelake.functions.transforms import exponential

    weights = df.select(cluster).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return df.join(weights.withColumn(WEIGHT, exponential(seed, "cluster", F.col(cluster).cast("string"), "replicate")), cluster)


def permute_columns(df: DataFrame, key: str, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """Each column shuffled on its own: its values in hash order meet the rows in key order."""
    out = global_rank(df.drop(*columns), [key], "__r")
    for c in columns:
        shuffled = global_rank(df.select(F.xxhash64(F.lit(seed), F.lit(c), F.col(key)).alias("__h"), c, F.col(key).alias("__k")), ["__h", "__k"], "__r").select("__r", c)
        out = out.join(shuffled, "__r")
    return out.drop("__r")


def permute_within(df: DataFrame, column: str, within: str, key: str, seed: int = 0) -> DataFrame:
    """A column shuffled inside its groups."""
    a = df.drop(column).withColumn("__r", F.row_number().over(Window.partitionBy(within).orderBy(key)))
    b = df.select(within, column, F.row_number().over(Window.partitionBy(within).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)).alias("__r"))
    return a.join(b, [within, "__r"]).drop("__r")


# --- distances


def _subsample(df: DataFrame, columns: Sequence[str], key: str, most: int) -> np.ndarray:
    """At most ``most`` rows of least key hash: a stated subsample for statistics over all pairs."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.xxhash64(F.col(key)).alias("__h")).orderBy("__h").limit(most).toPandas()
    return rows[list(columns)].to_numpy()


#: Rows of one block of labelled rows, of one block of pairs, and waves up to which one column needs no pairs.
BLOCK_ROWS, PAIR_ROWS, MOST_WAVES = 50_000, 3_000, 2_000


def mmd(df: DataFrame, columns: Sequence[str], group: str, key: str, permutations: int = 99, most: int = 2000, seed: int = 0) -> DataFrame:
    """Maximum mean discrepancy of two groups over all their complete rows, RBF width by the median, permutation p.

    Only the width looks at a subsample: the median of the squared distances of ``most`` rows of least key hash.
    The kernel of one column is summed as a Fourier series that is exact to rounding within the column's range, so
    the discrepancy is a weighted distance of the groups' characteristic functions and a row is read once; several
    columns, and a range too wide for the series, are summed over all pairs of blocks.  Blocks are key hashes, and
    each permutation deals the first group's size over them exactly.
    """
    rows = df.where(F.col(group).isNotNull())
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    rows = rows.select(F.xxhash64(F.col(key)).alias("h"), F.col(group).cast("int").alias("g"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    s = rows.agg(F.count("*").alias("n"), F.sum("g").alias("a"), *[f(F.col("x")[i]).alias(f"{w}{i}") for i in range(len(columns)) for w, f in (("low", F.min), ("high", F.max))]).first()
    n, na = s["n"], s["a"] or 0
    if not 0 < na < n:
        raise EstimationError("both groups need rows")
    some = np.array([r["x"] for r in rows.orderBy("h").limit(most).select("x").collect()])
    d = sum((v[:, None] - v[None, :]) ** 2 for v in some.T)
    width = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
    middle = np.array([(s[f"low{i}"] + s[f"high{i}"]) / 2 for i in range(len(columns))])
    reach = (s["high0"] - s["low0"]) / math.sqrt(width)
    # the kernel's copies lie at 2 pi / step, and both they and the waves left out are below 1e-17
    step = 2 * math.pi / (reach + 6.5)
    waves = np.arange(math.ceil(13 / step) + 1) * step
    series = len(columns) == 1 and len(waves) <= MOST_WAVES
    blocks = -(-n // (BLOCK_ROWS if series else PAIR_ROWS))
    if series:  # a block's arrays of rows by waves stay small
        blocks = max(blocks, -(-n * len(waves) // (100 * BLOCK_ROWS)))
    rows = rows.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    held = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    drawn = np.random.default_rng(seed).multivariate_hypergeometric(list(held.values()), na, permutations, method="marginals")
    quota = dict(zip(held, drawn.T))

    def labels(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Scaled values of a block, and who is in the first group: really, and in each permutation."""
        block = int(g["block"].iloc[0])
        g = g.assign(order=g["x"].map(tuple)).sort_values(["h", "order", "g"])
        x = (np.array(g["x"].tolist()) - middle) / math.sqrt(width)
        rng, first = np.random.default_rng([seed, block]), np.zeros((permutations + 1, len(g)), bool)
        first[0] = g["g"].to_numpy() > 0
        for i, q in enumerate(quota[block], 1):
            first[i, rng.permutation(len(g))[:q]] = True
        return x, first

    if series:

        def transform(g: pd.DataFrame) -> pd.DataFrame:
            x, first = labels(g)
            t = x @ waves[None, :]
            t = np.hstack((np.cos(t), np.sin(t)))
            sums = np.vstack((first.astype(float) @ t, t.sum(0)))
            return pd.DataFrame({"i": np.arange(sums.size), "v": sums.ravel()})

        sums = np.zeros((permutations + 2, 2 * len(waves)))
        for r in rows.groupBy("block").applyInPandas(transform, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums.flat[r["i"]] = r["v"]
        apart = sums[:-1] / na - (sums[-1] - sums[:-1]) / (n - na)
        weights = step / math.sqrt(math.pi) * np.exp(-waves * waves / 4)
        weights[0] /= 2
        stats = (apart * apart) @ np.tile(weights, 2)
    else:

        def pack(g: pd.DataFrame) -> pd.DataFrame:
            x, first = labels(g)
            return pd.DataFrame({"block": [g["block"].iloc[0]], "x": [x.tobytes()], "first": [np.packbits(first, axis=1).tobytes()], "m": [len(x)]})

        def pairs(batches):
            total, within, across = 0.0, np.zeros(permutations + 1), np.zeros(permutations + 1)
            for batch in batches:
                for r in batch.itertuples():
                    (x, a), (y, b) = (
                        (np.frombuffer(v, float).reshape(m, -1), np.unpackbits(np.frombuffer(f, np.uint8).reshape(permutations + 1, -1), axis=1, count=m).astype(float))
                        for v, f, m in ((r.x, r.first, r.m), (r.x2, r.first2, r.m2))
                    )
                    k = np.exp(-sum((x[:, c, None] - y[None, :, c]) ** 2 for c in range(x.shape[1])))
                    twice = 1.0 if r.block == r.block2 else 2.0
                    total += twice * k.sum()
                    within += twice * np.einsum("pi,pi->p", a @ k, b)
                    across += twice / 2 * (a @ k.sum(1) + b @ k.sum(0))
            yield pd.DataFrame({"i": np.arange(permutations + 1), "t": total, "w": within, "c": across})

        packed = rows.groupBy("block").applyInPandas(pack, "block int, x binary, first binary, m int").persist()
        try:
            packed.count()  # packed once, before it meets itself
            other = packed.select(*[F.col(c).alias(f"{c}2") for c in packed.columns])
            met = packed.join(other, F.col("block") <= F.col("block2")).repartition(max(8, min(blocks * blocks // 20, 2000)))
            got = met.mapInPandas(pairs, "i int, t double, w double, c double").groupBy("i").agg(F.sum("t").alias("t"), F.sum("w").alias("w"), F.sum("c").alias("c")).orderBy("i").toPandas()
        finally:
            packed.unpersist()
        t, aa, at = (got[c].to_numpy() for c in "twc")
        ab = at - aa
        stats = aa / na**2 + (t - 2 * at + aa) / (n - na) ** 2 - 2 * ab / (na * (n - na))
    return _row(df, statistic=float(stats[0]), p=(int((stats[1:] >= stats[0] * (1 - 1e-12)).sum()) + 1) / (permutations + 1), n=int(n))


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    def centred(v: np.ndarray) -> np.ndarray:
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    v = math.sqrt((a * a).mean() * (b * b).mean())
    return math.sqrt(max(0.0, (a * b).mean()) / v) if v > 0 else 0.0


def gp_distance_test(df: DataFrame, x: str, y: str, z: Sequence[str], key: str, most: int = 500, permutations: int = 99, seed: int = 0) -> DataFrame:
    """Residuals of Gaussian-process regressions on z, then distance correlation with a permutation null."""
    m = _subsample(df, [x, y, *z], key, most)
    m = (m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1)
    a, b = m[:, 0], m[:, 1]
    if z:
        d = ((m[:, None, 2:] - m[None, :, 2:]) ** 2).sum(2)
        k = np.exp(-0.5 * d)
        smooth = k @ np.linalg.inv(k + 0.1 * np.eye(len(k)))
        a, b = a - smooth @ a, b - smooth @ b
    rng = np.random.default_rng(seed)
    real = distance_correlation(a, b)
    more = sum(distance_correlation(a, rng.permutation(b)) >= real for _ in range(permutations))
    return _row(df, statistic=real, p=(more + 1) / (permutations + 1), n=len(m))


def block_shuffle_null(df: DataFrame, x: str, y: str, time: str, block: int, replicates: int, seed: int = 0) -> DataFrame:
    """Correlation of x with y in shuffled blocks: all replicates are groups of one join and aggregate."""
    rows = df.select(F.col(time).cast("long").alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    start = rows.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    blocks = (start["t1"] - start["t0"]) // block + 1
    spark = df.sparkSession
    plan = spark.range(replicates * blocks).select((F.col("id") / blocks).cast("long").alias("replicate"), (F.col("id") % blocks).alias("b"))
    order = Window.partitionBy("replicate").orderBy(uniform(seed, "block", "replicate", "b"), "b")
    plan = plan.withColumn("to", F.row_number().over(order) - 1)
    moved = rows.withColumn("b", F.floor((F.col("t") - start["t0"]) / block)).join(plan, "b").select("replicate", (F.col("t") + (F.col("to") - F.col("b")) * block).alias("t"), "y")
    return moved.join(rows.select("t", "x"), "t").groupBy("replicate").agg(F.corr("x", "y").alias("statistic"))


def multivariate_parcorr(df: DataFrame, xs: Sequence[str], ys: Sequence[str], z: Sequence[str] = ()) -> DataFrame:
    """First canonical correlation of two blocks given z, with Bartlett's chi-squared p, from one covariance."""
    g = gram(complete_cases(df, [*xs, *ys, *z]), [*xs, *ys, *z])
    c = g.covariance([*xs, *ys, *z])
    a = len(xs) + len(ys)
    s = c[:a, :a] - (c[:a, a:] @ np.linalg.solve(c[a:, a:], c[a:, :a]) if z else 0.0)
    k = len(xs)
    m = np.linalg.solve(s[:k, :k], s[:k, k:]) @ np.linalg.solve(s[k:, k:], s[k:, :k])
    r2 = np.clip(np.linalg.eigvals(m).real, 0, 1 - 1e-15)
    stat = -(g.n - 1 - len(z) - (k + len(ys) + 1) / 2) * float(np.log1p(-r2).sum())
    if stat < 0 and g.n < a + len(z) + 2:
        raise EstimationError("too few rows")
    return _row(df, correlation=math.sqrt(float(r2.max())), statistic=stat, p=special.chi2_sf(stat, k * len(ys)))


def regime_split(df: DataFrame, column: str) -> DataFrame:
    """Two regimes at the median of a column."""
    mid = df.agg(F.percentile(column, F.lit(0.5)).alias("__m"))
    return df.join(F.broadcast(mid)).withColumn("regime", (F.col(column) > F.col("__m")).cast("int")).drop("__m")


def custom_test(df: DataFrame, queries: Sequence[tuple[str, str, Sequence[str]]], test, key: str) -> DataFrame:
    """A caller's test (arrays x, y, z -> statistic, p) on all rows in the order of their key's hash, one group per query."""
    rows, parts = df.withColumn("__h", F.xxhash64(key)), None
    for i, (x, y, z) in enumerate(queries):
        p = rows.select(F.lit(i).alias("query"), "__h", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in z]).cast("array<double>").alias("z"))
        parts = p if parts is None else parts.unionByName(p)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["__h", "x", "y"])
        s, p = test(g["x"].to_numpy(), g["y"].to_numpy(), np.array(g["z"].tolist()))
        return pd.DataFrame({"query": [g["query"].iloc[0]], "statistic": [float(s)], "p": [float(p)]})

    return parts.groupBy("query").applyInPandas(run, "query int, statistic double, p double")


def dose_response(df: DataFrame, y: str, treatments: Sequence[str], z: Sequence[str], degree: int = 2) -> tuple[dict[str, list[float]], dict[str, float], float]:
    """(polynomial coefficients of each treatment, means of the treatments, mean outcome) of an additive polynomial model, from one Gram.

    The mean response at doses is the mean outcome plus each polynomial's value there less its mean over the rows.
    """
    rows = complete_cases(df, [y, *treatments, *z])
    powers = {f"__{t}^{k}": F.col(t).cast("double") ** k for t in treatments for k in range(1, degree + 1)}
    g = gram(rows, {**powers, **{c: c for c in z}, y: y})
    fit = solve(g, y, ["1", *powers, *z])
    return {t: [fit[f"__{t}^{k}"] for k in range(1, degree + 1)] for t in treatments}, {n: g.mean(n) for n in powers}, g.mean(y)


def derivatives(df: DataFrame, y: str, treatments: Sequence[str], z: Sequence[str], at: dict[str, float] | None = None, degree: int = 2) -> DataFrame:
    """``treatment, dose, response, derivative, elasticity, semi_elasticity``: slopes of the mean response at chosen doses (the means, where none is given).

    The response at one treatment's dose leaves the other treatments as they are.  An elasticity is d ln y / d ln t and a
    semi-elasticity d ln y / dt, both of the mean response; null where that is not positive.
    """
    poly, means, level = dose_response(df, y, treatments, z, degree)
    rows = []
    for t in treatments:
        a = float((at or {}).get(t, means[f"__{t}^1"]))
        response = level + sum(b * (a**k - means[f"__{t}^{k}"]) for k, b in enumerate(poly[t], 1))
        slope = sum(k * b * a ** (k - 1) for k, b in enumerate(poly[t], 1))
        rows.append((t, a, response, slope, slope * a / response if response > 0 else None, slope / response if response > 0 else None))
    return df.sparkSession.createDataFrame(rows, "treatment string, dose double, response double, derivative double, elasticity double, semi_elasticity double")
