"""Two-sided tail of Student's t for the few rows of a coefficient table."""

from __future__ import annotations

import math


def two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|), from the regularized incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    if t == 0.0:
        return 1.0
    if df > 1e7:
        # The normal tail and the first term in 1/df; the fraction below would lose digits.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2)) + density * (abs(t) ** 3 + abs(t)) / (2 * df)
    a, b = df / 2.0, 0.5
    x, y = df / (df + t * t), t * t / (df + t * t)
    log_front = (
        _log_gamma_step(a) - math.lgamma(b) - a * math.log1p(t * t / df) + b * math.log(y)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, y) / b


def _log_gamma_step(a: float) -> float:
    """log gamma(a + 1/2) - log gamma(a); a series where the two would cancel."""
    if a < 1e4:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result
