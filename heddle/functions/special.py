"""Special functions as column expressions: log-gamma, digamma, incomplete beta and gamma, tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.workspace import bind

TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of gamma of x > 0: Stirling's series eight places on, less the factors skipped."""
    y = x + 8
    skipped = x
    for k in range(1, 8):
        skipped = skipped * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(skipped)


def digamma(n: Column) -> Column:
    """Digamma of whole numbers n >= 1: a harmonic sum, or its expansion from 64 on."""
    sum_to = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), n - 1).cast("long")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = n.cast("double")
    far = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    return F.when(n <= 1, -0.5772156649015329).when(n < 64, sum_to - 0.5772156649015329).otherwise(far)


def _fraction(start: Column, pairs, steps: Column) -> Column:
    """A continued fraction by Lentz's rule: ``pairs(i)`` are the i-th numerator and denominator."""
    held = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)

    def step(s: Column, i: Column) -> Column:
        a, b = pairs(i)
        made = F.struct((1 / held(b + a * s["d"])).alias("d"), held(b + a / s["c"]).alias("c"), s["f"].alias("f"))
        return bind(made, lambda m: F.struct(m["d"].alias("d"), m["c"].alias("c"), (m["f"] * m["c"] * m["d"]).alias("f")))

    first = F.struct(F.lit(0.0).alias("d"), held(start).alias("c"), held(start).alias("f"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), first, step)["f"]


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for x in [0, 1], a and b > 0."""

    def part(x: Column, a: Column, b: Column) -> Column:
        def pairs(i: Column):
            m = F.floor(i / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(i % 2 == 0, even).otherwise(odd), F.lit(1.0)

        front = a * F.log(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)
        return F.exp(front) / a / _fraction(F.lit(1.0), pairs, 60 + 6 * F.sqrt(F.greatest(a, b)))

    def either(v: Column) -> Column:
        inner = F.when(v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2), held(part, v["x"], v["a"], v["b"])).otherwise(1 - held(part, 1 - v["x"], v["b"], v["a"]))
        return F.when(v["x"] <= 0, 0.0).when(v["x"] >= 1, 1.0).otherwise(inner)

    # Arguments are evaluated once, not at each step of the fraction.
    held = lambda f, x, a, b: bind(F.struct(x.alias("x"), a.alias("a"), b.alias("b")), lambda v: f(v["x"], v["a"], v["b"]))
    return bind(F.struct(x.alias("x"), a.alias("a"), b.alias("b")), either)


def normal_two_sided(z: Column) -> Column:
    """The probability of a normal value as far from 0 as z: a series up to 1.7, beyond it a fraction."""

    def tail(z: Column) -> Column:
        x = z * z / 2
        terms = F.aggregate(
            F.sequence(F.lit(1), F.lit(40)),
            F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
            lambda s, n: F.struct((s["t"] * x / (n + 0.5)).alias("t"), (s["s"] + s["t"] * x / (n + 0.5)).alias("s")),
        )["s"]
        near = 1 - F.exp(-x) * F.sqrt(x) * 2 / math.sqrt(math.pi) * terms
        # The upper gamma function of 1/2, by its fraction in x.
        pairs = lambda i: (-i.cast("double") * (i - 0.5), x + 2 * i + 0.5)
        far = F.exp(-x) * F.sqrt(x) / math.sqrt(math.pi) / _fraction(x + 0.5, pairs, F.lit(120))
        return F.when(z < 1.7, near).otherwise(far)

    return F.when(F.isnan(z), None).otherwise(bind(F.abs(z), lambda v: F.when(v > 38, 0.0).otherwise(tail(v))))


def t_two_sided(t: Column, df: Column) -> Column:
    """The probability of a value of Student's t as far from 0 as t. Beyond a million degrees of freedom
    by the normal tail at a corrected place, which is nearer than 1e-11 there."""

    def tail(t: Column, df: Column) -> Column:
        z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
        exact = incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))
        return F.when(t.isNull() | df.isNull(), None).when(df > 1e6, normal_two_sided(z)).otherwise(exact)

    return bind(F.struct(t.alias("t"), df.alias("df")), lambda v: tail(v["t"], v["df"]))


def real_digamma(x: Column) -> Column:
    """Digamma of x > 0: its expansion eight places on, less the terms skipped."""
    y = x + 8
    skipped = 1 / x
    for k in range(1, 8):
        skipped = skipped + 1 / (x + k)
    z = y * y
    return F.log(y) - 1 / (2 * y) - (1 / 12.0 - (1 / 120.0 - (1 / 252.0 - (1 / 240.0 - 1 / 132.0 / z) / z) / z) / z) / z - skipped


def real_trigamma(x: Column) -> Column:
    """The derivative of digamma at x > 0, likewise."""
    y = x + 8
    skipped = 1 / (x * x)
    for k in range(1, 8):
        skipped = skipped + 1 / ((x + k) * (x + k))
    z = y * y
    return 1 / y + 1 / (2 * z) + (1 / 6.0 - (1 / 30.0 - (1 / 42.0 - 1 / 30.0 / z) / z) / z) / (z * y) + skipped


def hypergeometric_tail(hits: Column, drawn: Column, marked: Column, every: Column) -> Column:
    """The probability of ``hits`` marked rows or more among ``drawn`` of ``every``, of which ``marked`` are.
    A sum of as many terms as there are numbers of hits at or above."""
    choose = lambda n, k: log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)

    def tail(v: Column) -> Column:
        most, least = F.least(v["n"], v["m"]), F.greatest(v["k"], v["n"] + v["m"] - v["a"], F.lit(0.0))
        term = lambda i: F.exp(choose(v["m"], i) + choose(v["a"] - v["m"], v["n"] - i) - choose(v["a"], v["n"]))
        steps = F.sequence(least.cast("long"), F.greatest(least, most).cast("long"))
        total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + term(i.cast("double")))
        return F.when(v["k"] > most, 0.0).otherwise(F.least(F.lit(1.0), total))

    values = [c.cast("double").alias(n) for n, c in zip("knma", (hits, drawn, marked, every), strict=True)]
    return bind(F.struct(*values), tail)
