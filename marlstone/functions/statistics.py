"""Intervals and tail probabilities as columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import d
from .text import once

TERMS = 600


def ratio(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n).otherwise(d(0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of k of n; (0, 0) for n = 0."""
    p, size = ratio(k, n), F.greatest(n, F.lit(1)).cast("double")
    scale = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / scale
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / scale
    return F.when(n > 0, F.greatest(d(0), centre - half)).otherwise(d(0)), F.when(n > 0, F.least(d(1), centre + half)).otherwise(d(0))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Difference of two independent shares and its interval."""
    p1, p2 = ratio(k1, n1), ratio(k2, n2)
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    gap = p1 - p2
    return gap, gap - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2)), gap + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))


def counting(last: Column) -> Column:
    """1 to ``last``; empty if that is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def binomial_p(few: Column, n: Column) -> Column:
    """Two-sided exact p of a fair coin: at most ``few`` of n on one side."""
    start = F.struct((-n * math.log(2)).cast("double").alias("log"), F.exp(-n * math.log(2)).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        step = acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(step.alias("log"), (acc["sum"] + F.exp(step)).alias("sum"))

    return F.when(n == 0, d(1)).otherwise(F.least(d(1), 2 * F.aggregate(counting(few), start, add, lambda acc: acc["sum"])))


#: Up to here log factorials are tabled; beyond, the terms of Stirling's series that are used are exact to a double.
TABLED = 256


def log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(TABLED)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    table = F.array(*[d(math.lgamma(i + 1)) for i in range(TABLED + 1)])
    return F.when(n <= TABLED, F.get(table, n.cast("int"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_p(a: Column, b: Column, c: Column, e: Column) -> Column:
    """Two-sided exact p of the table [[a, b], [c, e]]: one pass over the tables with the same margins, each by itself."""
    r1, r2, c1, n = a + b, c + e, a + c, a + b + c + e
    lo, hi = F.greatest(F.lit(0), c1 - r2), F.least(r1, c1)

    def summed(margins: Column) -> Column:
        def log_p(x: Column) -> Column:
            cells = (x, margins["r1"] - x, margins["c1"] - x, margins["r2"] - margins["c1"] + x)
            return margins["whole"] - reduce(lambda s, cell: s + log_factorial(cell), cells[1:], log_factorial(cells[0]))

        def of(seen: Column) -> Column:
            def add(acc: Column, x: Column) -> Column:
                return acc + F.get(F.transform(F.array(log_p(x)), lambda p: F.when(p <= seen, F.exp(p)).otherwise(0.0)), 0)

            return F.aggregate(F.sequence(margins["lo"], margins["hi"]), d(0), add)

        # two tables of one probability differ by what sums of logs this large are rounded by
        slack = F.greatest(d(math.log1p(1e-9)), F.abs(margins["whole"]) * 1e-14)
        return once(log_p(margins["a"]) + slack, of)

    whole = log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(n - c1) - log_factorial(n)
    given = F.struct(a.alias("a"), r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), lo.alias("lo"), hi.alias("hi"), whole.alias("whole"))
    return F.least(d(1), once(given, summed))


def log_gamma_half(k: Column) -> Column:
    """Log of gamma(k / 2) for a whole k above 0."""
    odd = k % 2 == 1
    steps = counting(F.floor((k - 1) / 2))
    return F.when(odd, d(math.log(math.pi) / 2)).otherwise(d(0)) + F.aggregate(steps, d(0), lambda acc, j: acc + F.log(F.when(odd, j - 0.5).otherwise(j.cast("double"))))


def chi2_sf(x: Column, k: Column) -> Column:
    """Probability of a chi-square above x with k degrees of freedom.

    A power series near the origin, elsewhere a continued fraction, which keeps small tails exact.
    """
    a, y = k / 2.0, x / 2.0
    scale = F.exp(-y + a * F.log(y) - log_gamma_half(k))
    first = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, lambda acc, i: F.struct((acc["t"] * y / (a + i)).alias("t"), (acc["s"] + acc["t"] * y / (a + i)).alias("s")), lambda acc: acc["s"])

    def further(acc: Column, i: Column) -> Column:
        an = i * (a - i)
        b = y + 2 * i + 1 - a
        back = 1 / (an * acc["d"] + b)
        on = b + an / acc["c"]
        return F.struct(on.alias("c"), back.alias("d"), (acc["h"] * back * on).alias("h"))

    b0 = y + 1 - a
    begin = F.struct(d(1e300).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), begin, further, lambda acc: acc["h"])
    tail = F.when(y < a + 1, 1 - scale * series).otherwise(scale * fraction)
    return F.when((x <= 0) | (k <= 0), d(1)).otherwise(F.greatest(d(0), F.least(d(1), tail)))
