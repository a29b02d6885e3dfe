"""Tail probabilities without SciPy."""

import math
from statistics import NormalDist


def _fraction(terms, tiny: float = 1e-300, eps: float = 1e-16, limit: int = 500) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz scheme; terms: b0, then pairs (a, b)."""
    terms = iter(terms)
    f = next(terms) or tiny
    c, d = f, 0.0
    for _, (a, b) in zip(range(limit), terms, strict=False):
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1) < eps:
            break
    return f


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)

    def terms():
        yield 0.0
        yield 1.0, 1.0
        m = 0
        while True:
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a * _fraction(terms())


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    if math.isnan(t) or not df > 0:
        return math.nan
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def gammainc_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, accurate in the far tail."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(log_front)

    def terms():
        yield x + 1 - a
        i = 1
        while True:
            yield -i * (i - a), x + 2 * i + 1 - a
            i += 1

    return math.exp(log_front) / _fraction(terms())


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else gammainc_upper(df / 2, x / 2)


def normal_inv(p: float) -> float:
    """The quantile of the standard normal distribution."""
    return NormalDist().inv_cdf(p)
