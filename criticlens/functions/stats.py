"""Significance of a rank correlation: the t test behind its conclusion."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significance level and the strength labels of a correlation.
ALPHA = 0.001
STRENGTH = [(0.35, "Highly correlated"), (0.20, "Correlated"), (0.16, "Slightly correlated")]
NOT_SIGNIFICANT = "No significant correlation"

# Simpson steps of the tail integral and the decay at which it ends: eight correct digits of p.
_STEPS = 2000
_DECAY = 40.0
# Steps by which the gamma ratio is moved to where its asymptotic series holds.
_SHIFT = 16


def _log_gamma_ratio(a: Column) -> Column:
    """log(gamma(a + 1/2) / gamma(a))."""
    z = a + _SHIFT
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, F.lit(3))) - 1 / (640 * F.pow(z, F.lit(5)))
    for k in range(_SHIFT):
        series = series + F.log((a + k) / (a + k + 0.5))
    return series


def p_value(t: Column, n: Column) -> Column:
    """P(|T| >= |t|) for Student's t with n - 2 degrees of freedom; NULL below one degree or without t.

    With s the integration variable of the density and y = sqrt(nu / 2 * log(1 + s^2 / nu)), the tail is the
    integral of exp(-y^2) times a smooth function for every nu, so one rule of fixed length serves all n.
    """
    nu = F.when(n >= 3, (n - 2).cast("double"))
    start = F.sqrt(nu / 2 * F.log1p(t * t / nu))
    step = (F.sqrt(start * start + _DECAY) - start) / _STEPS
    known = F.struct(nu.alias("nu"), start.alias("start"), step.alias("step"), F.lit(0.0).alias("sum"))

    def add(state: Column, k: Column) -> Column:
        nu, start, step = state["nu"], state["start"], state["step"]
        y = start + k * step
        smooth = F.when(y > 0, 2 * y / F.sqrt(-nu * F.expm1(-2 * y * y / nu))).otherwise(2**0.5)
        simpson = F.when((k == 0) | (k == _STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        value = simpson * smooth * F.exp(start * start - y * y)
        return F.struct(nu.alias("nu"), start.alias("start"), step.alias("step"), (state["sum"] + value).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS)), known, add, lambda s: s["sum"] * s["step"] / 3)
    density = F.exp(_log_gamma_ratio(nu / 2) - start * start) / F.sqrt(nu * math.pi)
    return F.when(nu.isNotNull() & t.isNotNull(), F.least(F.lit(1.0), 2 * density * tail))


def t_statistic(corr: Column, n: Column) -> Column:
    return corr * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - corr * corr))


def conclusion(corr: Column, p: Column) -> Column:
    """Label of a correlation with its p."""
    label = F.lit(NOT_SIGNIFICANT)
    for bound, text in reversed(STRENGTH):
        label = F.when(F.abs(corr) > bound, F.lit(text)).otherwise(label)
    return F.when(p <= ALPHA, label).otherwise(F.lit(NOT_SIGNIFICANT))
