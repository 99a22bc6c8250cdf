"""The exact binomial upper tail as a column expression of constant size, whatever the number of draws."""

from __future__ import annotations

from math import log, pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the quadrature on [0, 1].  Where the integrand has fallen by exp(-DEPTH), the rest is under 1e-19 of it.
POINTS, DEPTH = 32, 45.0
_NODES = "array({})".format(", ".join(f"struct({(x + 1) / 2!r}D as x, {w / 2!r}D as w)" for x, w in zip(*(a.tolist() for a in np.polynomial.legendre.leggauss(POINTS)), strict=True)))


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series, eight places further on."""
    y = x + 8
    rise = x
    for k in range(1, 8):
        rise = rise * (x + k)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(rise)


def _stirling_error(x: Column) -> Column:
    """ln x! less Stirling's formula, without its cancellation: from the series from 16 on."""
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    return F.when(x >= 16, series).when(x > 0, ln_gamma(x + 1) - (x + 0.5) * F.log(x) + x - 0.5 * log(2 * pi)).otherwise(0.0)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, by a series where both are close."""

    def series(v: Column) -> Column:
        powers = F.lit(0.0)
        for j in range(8, 0, -1):
            powers = (powers + 1 / (2 * j + 1)) * v * v
        return (x - mean) * v + 2 * x * v * powers

    return F.when(F.abs(x - mean) < 0.1 * (x + mean), _let((x - mean) / (x + mean), series)).when(x > 0, x * F.log(x / mean) + mean - x).otherwise(mean)


def ln_binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """ln P(X >= k) of n draws with chance p; null for probability zero.

    The tail is the incomplete beta integral with a = k, b = n - k + 1 up to p.  From p, the integrand falls towards
    the end away from the mean, and its logarithm ever faster: Gauss-Legendre quadrature with POINTS points over where it falls by
    exp(-DEPTH) gives the tail, or one less the tail.  The value at p comes from the saddle-point form of the binomial
    probability, in which nothing cancels, so a billion draws are as exact as ten.
    """
    given = F.struct(*(c.cast("double").alias(name) for c, name in ((k, "k"), (n, "n"), (p, "p"))))

    def prepared(s: Column) -> Column:
        """Where to integrate, and the logarithm of the density at p."""
        k, n, p = s.k, s.n, s.p
        q, rest = 1 - p, n - k
        ln_pmf = F.when(rest > 0, _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - _deviance(k, n * p) - _deviance(rest, n * q) + 0.5 * F.log(n / (2 * pi * k * rest))).otherwise(n * F.log(p))
        # Down from p where the tail is the smaller part.  Just below the mean the integrand may rise a little before it falls.
        down = k >= n * p
        slope = F.when(down, (k - 1) / p - rest / q).otherwise(rest / q - (k - 1) / p)
        bend = F.when(down, (k - 1) / (p * p)).otherwise(rest / (q * q))
        return F.struct(p.alias("p"), q.alias("q"), (k - 1).alias("a"), rest.alias("b"), down.alias("down"), slope.alias("slope"), bend.alias("bend"), (ln_pmf + F.log(k / p)).alias("top"))

    def tail(s: Column) -> Column:
        side, room = F.when(s.down, -1.0).otherwise(1.0), F.when(s.down, s.p).otherwise(s.q)
        steep = F.greatest(s.slope, F.lit(0.0))
        reach = F.try_divide(F.lit(2 * DEPTH), steep + F.sqrt(steep * steep + 2 * DEPTH * s.bend)) + F.try_divide(steep - s.slope, s.bend)
        fall = lambda d: s.a * F.log1p(d / s.p) + s.b * F.log1p(-d / s.q)

        def nearer(u: Column, _: Column) -> Column:
            """A step of Newton's towards where the logarithm is -DEPTH: from beyond, and it stays beyond, as it is concave."""
            d = side * u
            over = fall(d) + DEPTH
            return F.when(over >= 0, u).otherwise(u - over / (side * (s.a / (s.p + d) - s.b / (s.q - d))))

        def area(step: Column) -> Column:
            term = lambda t: t.w * F.exp(fall(step * t.x))
            return s.top + F.log(F.abs(step) * F.aggregate(F.expr(_NODES), F.lit(0.0), lambda total, t: total + term(t)))

        widest = F.least(room * (1 - 1e-13), F.coalesce(reach, room))
        ln_area = _let(side * F.aggregate(F.sequence(F.lit(1), F.lit(8)), widest, nearer), area)
        return F.when(s.down, F.least(F.lit(0.0), ln_area)).otherwise(F.log1p(-F.least(F.lit(1.0), F.exp(ln_area))))

    found = _let(given, lambda s: _let(prepared(s), tail))
    return F.when(k <= 0, F.lit(0.0)).when((k > n) | (p <= 0), F.lit(None)).when(p >= 1, F.lit(0.0)).otherwise(found)
