"""Tail probabilities as column arithmetic: normal, chi-squared, F and t, by quadrature or finite sums.

Each is exact to about 1e-9, so p-values stay inside the plan instead of on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def integral(f: Callable[[Column], Column], low: Column, high: Column, steps: int) -> Column:
    """Simpson's rule over an even number of steps."""
    h = (high - low) / F.lit(float(steps))
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    parts = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: weight(i) * f(low + h * i))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) * h / 3


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0; 0 from 6.5 on, where it is below 1e-19."""
    to = F.least(x.cast("double"), F.lit(6.5))
    inside = 1 - integral(lambda t: F.exp(-t * t), F.lit(0.0), to, 400) * (2 / math.sqrt(math.pi))
    return F.when(x >= 6.5, 0.0).otherwise(F.greatest(F.lit(0.0), inside))


def two_sided(z: Column) -> Column:
    """P(|standard normal| > |z|)."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi_squared(x: Column, dof: Column) -> Column:
    """P(chi-squared with dof > x); 1 for dof or x of 0. A finite sum for even dof, with erfc for odd dof."""
    half, odd = x.cast("double") / 2, dof % 2 == 1
    terms = F.floor(F.when(odd, dof - 1).otherwise(dof) / 2).cast("int")
    # each term is the one before it times x/2 over the next (half) integer, in logarithms
    shift = F.when(odd, 0.5).otherwise(0.0)
    first = F.when(odd, F.log(half) / 2 - half - math.lgamma(1.5)).otherwise(-half)
    state = F.struct(F.lit(0.0).alias("sum"), first.cast("double").alias("term"))
    step = lambda s, i: F.struct((s["sum"] + F.exp(s["term"])).alias("sum"), (s["term"] + F.log(half) - F.log(i + shift)).alias("term"))
    total = F.aggregate(F.slice(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), 1, terms), state, step, lambda s: s["sum"])
    tail = total + F.when(odd, erfc(F.sqrt(half))).otherwise(0.0)
    return F.when((x <= 0) | (dof <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def f_ratio(f: Column, between: Column, within: Column, steps: int = 2000) -> Column:
    """P(F with (between, within) degrees of freedom > f).

    The incomplete beta function as the share of the integral of sin^(within-1) cos^(between-1) up to
    atan(sqrt(within / (between f))), both taken over the range around the peak that holds all but a trace of it.
    """
    up, down = within.cast("double") - 1, between.cast("double") - 1
    peak = F.atan2(F.sqrt(up), F.sqrt(down))
    spread = 14 / F.sqrt(2 * (up + down) + 1)
    low, high = F.greatest(F.lit(0.0), peak - spread), F.least(F.lit(math.pi / 2), peak + spread)
    power = lambda n, x: F.when(n == 0, 0.0).otherwise(n * F.log(F.greatest(x, F.lit(1e-300))))
    height = power(up, F.sin(peak)) + power(down, F.cos(peak))
    curve = lambda t: F.exp(power(up, F.sin(t)) + power(down, F.cos(t)) - height)
    at = F.least(high, F.greatest(low, F.atan2(F.sqrt(within.cast("double")), F.sqrt(between * f))))
    share = integral(curve, low, at, steps) / integral(curve, low, high, steps)
    return F.when(f <= 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|t with dof| > |t|)."""
    return f_ratio(t * t, F.lit(1), dof)
