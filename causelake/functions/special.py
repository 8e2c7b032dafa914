"""Scalar special functions for statistics that are already reduced to a few numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()

erf, erfc = math.erf, math.erfc


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def log_norm_sf(x: float) -> float:
    """ln of the upper normal tail, also where the tail underflows."""
    if x < 30:
        return math.log(norm_sf(x))
    return -0.5 * x * x - math.log(x) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / (x * x) + 3 / x**4)


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued(a, b, x) / a
    return 1 - front * _continued(b, a, 1 - x) / b


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1 - gamma_sf(a, x)


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x < a + 1:
        return 1 - gamma_cdf(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return half if t >= 0 else 1 - half


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else gamma_sf(df / 2, x / 2)


def _invert(sf, p: float, low: float, high: float) -> float:
    while sf(high) > p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sf(mid) > p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return -t_quantile(1 - p, df) if p < 0.5 else _invert(lambda x: t_sf(x, df), 1 - p, 0.0, 1.0)


def chi2_quantile(p: float, df: float) -> float:
    return _invert(lambda x: chi2_sf(x, df), 1 - p, 0.0, 1.0)


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _invert(lambda x: f_sf(x, d1, d2), 1 - p, 0.0, 1.0)


def gaussian_kl(mean0: float, var0: float, mean1: float, var1: float) -> float:
    return 0.5 * (math.log(var1 / var0) + (var0 + (mean0 - mean1) ** 2) / var1 - 1)
