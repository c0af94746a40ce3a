"""Distribution functions on the driver, for a few numbers: incomplete beta by continued fraction, t and F tails, quantiles."""

from __future__ import annotations

import math
from statistics import NormalDist


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (Lentz's continued fraction)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """Quantile for p above one half, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
