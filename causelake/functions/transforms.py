"""Row-wise and windowed transforms as column expressions and small plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causelake.errors import DataError


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def require_finite(df: DataFrame, column: str) -> None:
    if df.where(F.col(column).isNotNull() & ~finite(F.col(column).cast("double"))).limit(1).count():
        raise DataError(f"{column} has values that are not finite")


def equal_width_bin(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Codes 0..bins-1 over [min, max]; the ends are one aggregate row that is joined in the plan."""
    if bins < 1:
        raise DataError("at least one bin")
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    code = F.floor((F.col(column) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-12)) * bins)
    return df.join(F.broadcast(ends)).withColumn(out, F.greatest(F.lit(0), F.least(F.lit(bins - 1), code)).cast("int")).drop("__lo", "__hi")


def moving_average(column: str, window: int, order: Sequence[str], by: Sequence[str] = ()) -> Column:
    """Centred odd window that shrinks at the edges."""
    if window < 1 or window % 2 == 0:
        raise DataError("the window must be odd and positive")
    return F.avg(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window // 2), window // 2))


def ordinal_pattern(column: str, m: int, tau: int, order: Sequence[str], by: Sequence[str] = ()) -> Column:
    """Lehmer code of the stable argsort of m values that lie tau apart; null where the series ends before."""
    if m < 2 or m > 7 or tau < 1:
        raise DataError("2 <= m <= 7 and tau >= 1")
    w = Window.partitionBy(*by).orderBy(*order)
    values = F.array(*[F.struct(F.lead(column, k * tau).over(w).alias("v"), F.lit(k).alias("i")) for k in range(m)])
    ordered = F.transform(F.array_sort(values), lambda s: s["i"])
    code = F.lit(0)
    for k in range(m):
        smaller = sum(((F.get(ordered, F.lit(j)) < F.get(ordered, F.lit(k))).cast("int") for j in range(k + 1, m)), F.lit(0))
        code = code + smaller * math.factorial(m - 1 - k)
    return F.when(F.lead(column, (m - 1) * tau).over(w).isNotNull(), code.cast("int"))


def standardise(df: DataFrame, columns: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """(x - mean) / max(population sd, eps), all columns from one aggregate."""
    stats = df.agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / F.greatest(F.col(f"__s_{c}"), F.lit(eps)))
    return out.drop(*stats.columns)


def contrast_columns(column: str, levels: Sequence, kind: str = "treatment", reference=None) -> dict[str, Column]:
    """Design columns of a categorical: treatment, sum, helmert or one-hot coding, in the order of the levels."""
    levels = list(levels)
    reference = levels[0] if reference is None else reference
    if reference not in levels:
        raise DataError(f"{reference!r} is no level of {column}")
    c, rest = F.col(column), [x for x in levels if x != reference]
    if kind == "onehot":
        return {f"{column}[{x}]": (c == F.lit(x)).cast("double") for x in levels}
    if kind == "treatment":
        return {f"{column}[{x}]": (c == F.lit(x)).cast("double") for x in rest}
    if kind == "sum":
        return {f"{column}[S.{x}]": F.when(c == F.lit(x), 1.0).when(c == F.lit(reference), -1.0).otherwise(0.0) for x in rest}
    if kind == "helmert":
        out = {}
        for k in range(1, len(levels)):
            e = F.when(c == F.lit(levels[k]), float(k))
            out[f"{column}[H.{levels[k]}]"] = e.when(c.isin(levels[:k]), -1.0).otherwise(0.0)
        return out
    raise DataError(f"no contrast {kind!r}")


def expand_vector(df: DataFrame, column: str, width: int) -> DataFrame:
    """An array column as ``width`` scalar columns."""
    return df.select("*", *[F.get(column, F.lit(i)).cast("double").alias(f"{column}_{i}") for i in range(width)])


def gaussian_density(x: Column, mean, sd) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def likelihood_terms(family: str, y: Column, eta: Column, weight=1.0) -> dict[str, Column]:
    """Log-likelihood, score and curvature in the linear predictor, per row."""
    w = F.lit(weight) if not isinstance(weight, Column) else weight
    if family == "gaussian":
        return {"value": -0.5 * w * (y - eta) ** 2, "score": w * (y - eta), "curvature": w}
    if family == "logit":
        p = 1 / (1 + F.exp(-eta))
        softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        return {"value": w * (y * eta - softplus), "score": w * (y - p), "curvature": w * p * (1 - p)}
    if family == "poisson":
        return {"value": w * (y * eta - F.exp(eta)), "score": w * (y - F.exp(eta)), "curvature": w * F.exp(eta)}
    if family == "probit":
        # the tail P(Z > |eta|) as an expression; a far tail is held off zero so that logs and ratios stay finite
        low = F.greatest(normal_cdf(F.when(y == 1, eta).otherwise(-eta)), F.lit(1e-300))
        sign = F.when(y == 1, 1.0).otherwise(-1.0)
        ratio = F.exp(-0.5 * eta * eta) / math.sqrt(2 * math.pi) / low
        return {"value": w * F.log(low), "score": w * sign * ratio, "curvature": w * ratio * (ratio + sign * eta)}
    raise DataError(f"no expression form for {family!r}")


def normal_cdf(z: Column) -> Column:
    """The normal distribution function in column arithmetic (absolute error below 1e-7): a rational form of the upper tail."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def erf(x: Column) -> Column:
    """The error function in column arithmetic (absolute error below 2e-7)."""
    return 2 * normal_cdf(x * math.sqrt(2)) - 1


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def bspline_columns(x: Column, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """Cox-de Boor basis on fixed knots, as nested expressions; the last interval is closed."""
    last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
    basis = [
        F.when((x >= a) & ((x < b) if i != last else (x <= b)), 1.0).otherwise(0.0) if a < b else F.lit(0.0)
        for i, (a, b) in enumerate(zip(knots, knots[1:]))
    ]
    for d in range(1, degree + 1):
        nxt = []
        for i in range(len(basis) - 1):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            e = F.lit(0.0)
            if left > 0:
                e = e + (x - knots[i]) / left * basis[i]
            if right > 0:
                e = e + (knots[i + d + 1] - x) / right * basis[i + 1]
            nxt.append(e)
        basis = nxt
    return basis


def intervened(column: str, kind: str, value: float | Sequence[tuple[float, float]], seed: int = 0, key: str | None = None) -> Column:
    """The treatment under Set, Shift or a finite stochastic policy [(value, probability), ...]."""
    if kind == "set":
        return F.lit(float(value))
    if kind == "shift":
        return F.col(column) + F.lit(float(value))
    if kind == "stochastic":
        u, total, e = uniform(seed, "policy", key or column), 0.0, None
        for v, p in value:
            total += p
            e = F.when(u < total, float(v)) if e is None else e.when(u < total, float(v))
        if abs(total - 1) > 1e-9:
            raise DataError("policy probabilities must sum to 1")
        return e.otherwise(float(value[-1][0]))
    raise DataError(f"no intervention {kind!r}")


def derivative_scale(kind: str, slope: Column, treatment: Column, outcome: Column) -> Column:
    """A derivative dy/dt on another scale: of log t, of log y, or of both (an elasticity)."""
    scales = {"identity": slope, "log_treatment": slope * treatment, "log_outcome": slope / outcome, "log_log": slope * treatment / outcome}
    if kind not in scales:
        raise DataError(f"no derivative scale {kind!r}")
    return scales[kind]


def uniform(seed: int, stream: str | int, *keys: str | Column) -> Column:
    """A uniform on (0, 1) that depends on the seed, the stream and the row's key only."""
    h = F.xxhash64(F.lit(seed), F.lit(str(stream)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, stream: str | int, *keys: str | Column) -> Column:
    """A standard normal by Box-Muller on two hashed uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, f"{stream}/r", *keys))) * F.cos(2 * math.pi * uniform(seed, f"{stream}/a", *keys))


def exponential(seed: int, stream: str | int, *keys: str | Column) -> Column:
    return -F.log(uniform(seed, stream, *keys))


def lcg_uniform(seed: int, replicate: Column, key: Column, modulus: int = 2_147_483_647) -> Column:
    """A uniform in integer arithmetic that any SQL engine can repeat (two multiplicative steps modulo a prime)."""
    a = ((key + 1) * 48271 + (replicate + 1 + seed) * 69621) % modulus
    b = (a * 39373 + 1) % modulus
    return ((b * 48271 % modulus).cast("double") + 0.5) / float(modulus)


def categorical(seed: int, stream: str | int, choices: Sequence[tuple[object, float]], *keys: str | Column) -> Column:
    """One of [(value, weight), ...] by hashed uniform; weights are non-negative, not all zero, and need not sum to 1."""
    total = sum(w for _, w in choices)
    if not choices or any(w < 0 for _, w in choices) or total <= 0:
        raise DataError("choices need non-negative weights that are not all zero")
    u, below, e = uniform(seed, stream, *keys), 0.0, None
    held = [(v, w) for v, w in choices if w > 0]
    for v, w in held[:-1]:
        below += w / total
        e = F.when(u < below, F.lit(v)) if e is None else e.when(u < below, F.lit(v))
    return F.lit(held[-1][0]) if e is None else e.otherwise(F.lit(held[-1][0]))


def index_below(seed: int, stream: str | int, n: int | Column, *keys: str | Column) -> Column:
    """An index in [0, n): the high part of a 53-bit hash times n, whose bias is below n / 2^53."""
    return F.floor(uniform(seed, stream, *keys) * (F.lit(n) if isinstance(n, int) else n)).cast("long")


def shuffle_key(seed: int, stream: str | int, *keys: str | Column) -> Column:
    """Sorting or ranking by this column shuffles rows; it is the same whatever the partitions."""
    return F.xxhash64(F.lit(seed), F.lit(f"shuffle/{stream}"), *[F.col(k) if isinstance(k, str) else k for k in keys])
