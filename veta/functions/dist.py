"""Tail probabilities for the few statistics of a summary table."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 2000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return value


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        for k in range(1, 10_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1.0 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return math.exp(log_front) * value


def t_two_sided(t: float, df: float) -> float:
    return beta_regularized(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_regularized(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """Value t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    tail = 2 * (1 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
