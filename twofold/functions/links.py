"""Link functions and hurdle-Poisson arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWTON_STEPS = 10


def logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def inv_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def prevalence(x: Column) -> Column:
    """Chance of a positive count. The hurdle part models the zeros."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(x))


def truncated_mean(log_rate: Column) -> Column:
    """Mean of a zero-truncated Poisson, stable for small rates."""
    rate = F.exp(log_rate)
    return rate / -F.expm1(-rate)


def truncated_rate(mean: Column) -> Column:
    """Rate whose zero-truncated mean is ``mean`` (> 1).

    Both starts lie right of the root of a convex function, so Newton descends
    to it and cannot overshoot.
    """
    start = F.least(mean, F.lit(2.0) * (mean - F.lit(1.0)))

    def step(rate, _):
        gap = rate + mean * F.expm1(-rate)
        return rate - gap / (F.lit(1.0) - mean * F.exp(-rate))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)


def positive_mean(n_pos: Column, sum_y: Column) -> Column:
    """Mean positive count, kept half a count above 1 where no finite rate exists."""
    floor = F.lit(1.0) + F.lit(0.5) / (n_pos + F.lit(1.0))
    seen = F.when(n_pos > 0, sum_y / n_pos).otherwise(F.lit(1.0))
    return F.greatest(seen, floor)


def ln_factorial(y: Column) -> Column:
    """ln(y!): exact product up to 20, Stirling's series above."""
    n = y.cast("double")
    stirling = (
        n * F.ln(n)
        - n
        + F.lit(0.5) * F.ln(F.lit(2.0 * math.pi) * n)
        + F.lit(1.0) / (F.lit(12.0) * n)
        - F.lit(1.0) / (F.lit(360.0) * F.pow(n, F.lit(3.0)))
        + F.lit(1.0) / (F.lit(1260.0) * F.pow(n, F.lit(5.0)))
    )
    small = F.ln(F.factorial(F.least(y, F.lit(20)).cast("int")).cast("double"))
    return F.when(y <= 20, small).otherwise(stirling)


def count_log_density(y: Column, log_rate: Column) -> Column:
    """Log density of a positive count under the zero-truncated Poisson."""
    rate = F.exp(log_rate)
    return y * log_rate - rate - ln_factorial(y) - F.ln(-F.expm1(-rate))


def hurdle_log_density(y: Column, zero_logit: Column, log_rate: Column) -> Column:
    """Log density of a count: ln p0, or ln(1 - p0) plus the truncated part."""
    ln_zero = -F.log1p(F.exp(-zero_logit))
    ln_positive = -F.log1p(F.exp(zero_logit))
    return F.when(y == 0, ln_zero).otherwise(ln_positive + count_log_density(y, log_rate))
