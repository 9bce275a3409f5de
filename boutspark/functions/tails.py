"""Tail probabilities for result tables of a few rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_TINY = 1e-300
# far more steps than the square root of any degrees of freedom that a table can have
_MOST_STEPS = 50_000_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    f, c, d = 1.0, 1.0, 0.0
    for i in range(_MOST_STEPS):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + num / c
        c = c if abs(c) > _TINY else _TINY
        f *= c * d
        if i and abs(1.0 - c * d) < 1e-15:
            return f
    raise ArithmeticError(f"the incomplete beta function does not converge at {a}, {b}, {x}")


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_ratio(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return math.exp(log_front) / a * (_beta_fraction(a, b, x) - 1.0)


def f_tail(f: float | None, df1: float, df2: float) -> float | None:
    """P(F > f)."""
    if f is None or math.isnan(f) or df1 <= 0 or df2 <= 0:
        return None
    if math.isinf(f):
        return 0.0
    return beta_ratio(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _nodes(low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(count)
    half = (high - low) / 2.0
    return low + half * (x + 1.0), w * half


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2.0))


@lru_cache(maxsize=4096)
def range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) of the studentized range of k means with df degrees of freedom."""
    if q <= 0:
        return 1.0
    z, wz = _nodes(-8.0, 8.0, 96)
    dens = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    # spread of the scale s = sqrt(chi2 / df) around 1
    width = 10.0 / math.sqrt(2.0 * df)
    s, ws = _nodes(max(1e-9, 1.0 - width), 1.0 + width, 96)
    log_s = (
        math.log(2.0)
        + (df / 2.0) * math.log(df / 2.0)
        - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(s)
        - df * s * s / 2.0
    )
    inner = _phi(z)[None, :] - _phi(z[None, :] - q * s[:, None])
    below = k * (inner ** (k - 1) * dens * wz).sum(axis=1)
    return float(min(1.0, max(0.0, 1.0 - (np.exp(log_s) * ws * below).sum())))


@lru_cache(maxsize=256)
def range_quantile(tail: float, k: int, df: float) -> float:
    """q with P(Q > q) = tail, by bisection."""
    low, high = 0.0, 10.0
    while range_tail(high, k, df) > tail:
        high *= 2.0
    for _ in range(60):
        mid = (low + high) / 2.0
        low, high = (mid, high) if range_tail(mid, k, df) > tail else (low, mid)
    return (low + high) / 2.0
