"""Beta, binomial, Student and normal probabilities, as plain functions and as column expressions.

The incomplete beta function is the usual continued fraction where a parameter is
small, and Gauss-Legendre quadrature of the shorter tail where both are large, so
counts of any size cost the same.  Densities are formed from deviations of the
mean, with Stirling's remainder for the gamma functions: nothing cancels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters above this are integrated; below, so many steps of the fraction suffice.
LARGE, STEPS = 1000, 300
_SHIFT = 12
#: Coefficients of Stirling's remainder in 1 / z, 1 / z ** 3, ... (fixed values).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
_NODES, _WEIGHTS = ((v + 1) / 2 if i == 0 else v / 2 for i, v in enumerate(np.polynomial.legendre.leggauss(64)))  # on 0 to 1
_TINY = 1e-300


def _remainder(z, log1p):
    """ln gamma(z) less Stirling's formula."""
    out = sum((z + (i + 0.5)) * log1p(1 / (z + i)) - 1 for i in range(_SHIFT))
    return out + sum(c / (z + _SHIFT) ** (2 * i + 1) for i, c in enumerate(_STIRLING))


def _log_front(a, b, x, log1p):
    """Logarithm of x^a (1-x)^b / B(a, b), less that of sqrt(a b / (a + b) / 2 pi)."""
    off = x * (a + b) - a
    return a * log1p(off / a) + b * log1p(-off / b) + _remainder(a + b, log1p) - _remainder(a, log1p) - _remainder(b, log1p)


def _fraction_step(a, b, x, m, c, d, away):
    up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    d, c = 1 / away(1 + up * d), away(1 + up / c)
    up = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    d2, c2 = 1 / away(1 + up * d), away(1 + up / c)
    return c2, d2, d * c * d2 * c2


# --- plain ------------------------------------------------------------------------

def betainc(a: float, b: float, x: float) -> float:
    """I_x(a, b): the probability that a beta variable is at most x."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x * (a + b) > a:
        return 1 - _lower_tail(b, a, 1 - x)
    return _lower_tail(a, b, x)


def _lower_tail(a: float, b: float, x: float) -> float:
    scale = math.exp(_log_front(a, b, x, math.log1p)) * math.sqrt(a * b / (a + b) / (2 * math.pi))
    if min(a, b) > LARGE:
        mean, sd = a / (a + b), math.sqrt(a * b / (a + b) / (a + b) / (a + b))
        step = -min(12 * sd, 40 * sd * sd / max(mean - x, sd * 1e-9), x * (1 - 1e-12)) * _NODES
        part = np.exp((a - 1) * np.log1p(step / x) + (b - 1) * np.log1p(-step / (1 - x)))
        return float(scale / (x * (1 - x)) * -(step[-1] / _NODES[-1]) * (part @ _WEIGHTS))
    if x > (a + 1) / (a + b + 2):  # near the mean: the fraction converges on the other side
        return 1 - _lower_tail(b, a, 1 - x)

    def away(v):
        return v if abs(v) > _TINY else _TINY

    c, d = 1.0, 1 / away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, STEPS):
        c, d, grow = _fraction_step(a, b, x, m, c, d, away)
        h *= grow
    return scale * h / a


def betainc_inv(a: float, b: float, p: float) -> float:
    """x with I_x(a, b) = p, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if betainc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


# --- column expressions -------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _record(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _away(v: Column) -> Column:
    return F.when(F.abs(v) > _TINY, v).otherwise(_TINY)


def _quadrature(body: Callable[[Column], Column]) -> Column:
    """Integral of ``body`` from 0 to 1."""
    nodes = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in zip(_NODES, _WEIGHTS)])
    return F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["w"] * body(n["t"]))


def _integrated(v: Column) -> Column:
    a, b, x = v["a"], v["b"], v["x"]
    n = a + b
    sd = F.sqrt(a * b / n / n / n)
    reach = F.least(12 * sd, 40 * sd * sd / F.greatest(a / n - x, sd * 1e-9), x * (1 - 1e-12))
    return let(reach, lambda r: r / (x * (1 - x)) * _quadrature(
        lambda t: F.exp((a - 1) * F.log1p(-r * t / x) + (b - 1) * F.log1p(r * t / (1 - x)))))


def _fraction(v: Column) -> Column:
    a, b, x = v["a"], v["b"], v["x"]

    def step(s, m):
        c, d, grow = _fraction_step(a, b, x, m.cast("double"), s["c"], s["d"], _away)
        return _record(c=c, d=d, h=s["h"] * grow)

    first = 1 / _away(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), _record(c=F.lit(1.0), d=first, h=first), step)["h"] / a


def beta_cdf(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) of double columns: the probability that a beta variable is at most x."""
    large = F.least(a, b) > LARGE
    flip = F.when(large, x * (a + b) > a).otherwise(x > (a + 1) / (a + b + 2))
    v = _record(a=F.when(flip, b).otherwise(a), b=F.when(flip, a).otherwise(b), x=F.when(flip, 1 - x).otherwise(x), flip=flip, large=large)

    def tail(v):
        a, b, x = v["a"], v["b"], v["x"]
        scale = F.exp(_log_front(a, b, x, F.log1p)) * F.sqrt(a * b / (a + b) / (2 * math.pi))
        return let(scale * F.when(v["large"], _integrated(v)).otherwise(_fraction(v)), lambda r: F.when(v["flip"], 1 - r).otherwise(r))

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(let(v, tail))


def beta_quantile(a: Column, b: Column, p: Column) -> Column:
    """x with I_x(a, b) = p, by bisection."""
    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return let(_record(mid=mid, low=beta_cdf(a, b, mid) < p),
                   lambda m: _record(lo=F.when(m["low"], m["mid"]).otherwise(s["lo"]), hi=F.when(m["low"], s["hi"]).otherwise(m["mid"])))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(55)), _record(lo=F.lit(0.0), hi=F.lit(1.0)), halve)
    return (ends["lo"] + ends["hi"]) / 2


def binomial_interval(hits: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The exact interval of a share: the shares for which no more, or no fewer, hits have the outer probability."""
    out = F.lit((1 - level) / 2)
    low = F.when(hits <= 0, 0.0).otherwise(beta_quantile(hits, n - hits + 1, out))
    high = F.when(hits >= n, 1.0).otherwise(beta_quantile(hits + 1, n - hits, 1 - out))
    return low, high


def binomial_at_least(hits: Column, n: Column, p: Column) -> Column:
    """Probability of so many hits or more in n trials of probability p."""
    return F.when(hits <= 0, 1.0).otherwise(beta_cdf(hits, n - hits + 1, p))


def normal_beyond(z: Column) -> Column:
    """Probability that a standard normal variable lies further from 0 than |z|."""
    def tail(z):
        return let(F.least(F.lit(12.0), 40 / z), lambda r: r * math.sqrt(2 / math.pi) * F.exp(-z * z / 2) * _quadrature(lambda t: F.exp(-(z + r * t / 2) * r * t)))
    return let(F.abs(z), lambda z: F.when(z < 1e-12, 1.0).otherwise(tail(z)))


def student_quantile(p: Column, df: Column) -> Column:
    """t that a Student variable exceeds in absolute value with probability p."""
    return let(beta_quantile(df / 2, F.lit(0.5), p), lambda x: F.sqrt(df * (1 - x) / x))
