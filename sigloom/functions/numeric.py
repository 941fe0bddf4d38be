"""Scalar and array arithmetic as Columns.

Arrays hold doubles without nulls. Null in, null out. ``argmax``/``argmin`` are zero-based and take the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From a median absolute deviation to a normal distribution's standard deviation; a fixed value.
MAD_SCALE = 1.4826


# ---- arrays -------------------------------------------------------------------------------------------------
def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's body computes what it names anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def quantile_of(a: Column, p: float) -> Column:
    """Linear interpolation between order statistics at p * (n - 1)."""

    def pick(s: Column) -> Column:
        at = F.lit(p) * (F.size(s) - 1)
        low = F.floor(at).cast("int")
        x, y = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(s)))
        return F.when(F.size(s) > 0, x + (at - low) * (y - x))

    return let(F.array_sort(a), pick)


def median_of(a: Column) -> Column:
    return quantile_of(a, 0.5)


def mad_of(a: Column) -> Column:
    """Scaled median absolute deviation; 0 for a single value."""
    return let(median_of(a), lambda m: median_of(F.transform(a, lambda x: F.abs(x - m)))) * MAD_SCALE


def medmad_of(a: Column) -> Column:
    """(x - median) / MAD; 0 for a single value, null where the MAD is 0."""
    both = F.struct(median_of(a).alias("m"), mad_of(a).alias("s"))
    scaled = let(both, lambda b: F.transform(a, lambda x: F.when(b["s"] > 0, (x - b["m"]) / b["s"])))
    return F.when(F.size(a) == 1, F.array(F.lit(0.0))).otherwise(scaled)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def studentise_of(a: Column) -> Column:
    """(x - mean) / population standard deviation, two passes; null where it is 0."""

    def scaled(d: Column) -> Column:
        return let(F.sqrt(total(F.transform(d, lambda x: x * x)) / F.size(d)), lambda s: F.transform(d, lambda x: F.when(s > 0, x / s)))

    return let(mean_of(a), lambda m: let(F.transform(a, lambda x: x - m), scaled))


def difference(a: Column) -> Column:
    """Next less this; 0 at the end."""
    return F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.coalesce(y - x, F.lit(0.0)))


def filter_large(a: Column, threshold: float, fill: float = 0.0) -> Column:
    return F.transform(a, lambda x: large_to(x, threshold, fill))


def clip_all(a: Column, threshold: float) -> Column:
    return F.transform(a, lambda x: clip(x, threshold))


def shift_scale(a: Column, shift: float, scale: float) -> Column:
    return F.transform(a, lambda x: (x - shift) / scale)


def equal_within(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Same length and every pair at most the tolerance apart; NaN equals NaN only."""
    close = F.zip_with(a, b, lambda x, y: (F.isnan(x) & F.isnan(y)) | (~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= tolerance)))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda x: F.coalesce(x, F.lit(False)))


# ---- scalars ------------------------------------------------------------------------------------------------
def large_to(x: Column, threshold: float, fill: float = 0.0) -> Column:
    return F.when(F.abs(x) > threshold, F.lit(fill)).otherwise(x)


def clip(x: Column, threshold: float) -> Column:
    return F.greatest(F.lit(-threshold), F.least(F.lit(threshold), x))


def adc_to_pa(x: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    return (x + offset) * range_ / digitisation


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def elu(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(F.expm1(x))


def log_laplace(x: Column, loc: Column, scale: Column) -> Column:
    return -F.abs(x - loc) / scale - F.log(scale) - math.log(2.0)


def laplace(x: Column, loc: Column, scale: Column) -> Column:
    return F.exp(log_laplace(x, loc, scale))


def log_laplace_by_loc(x: Column, loc: Column, scale: Column) -> Column:
    return F.signum(x - loc) / scale


def log_laplace_by_scale(x: Column, loc: Column, scale: Column) -> Column:
    return (F.abs(x - loc) / scale - 1) / scale


def log_laplace_by_logscale(x: Column, loc: Column, scale: Column) -> Column:
    return F.abs(x - loc) / scale - 1


def laplace_by_loc(x: Column, loc: Column, scale: Column) -> Column:
    return laplace(x, loc, scale) * log_laplace_by_loc(x, loc, scale)


def laplace_by_scale(x: Column, loc: Column, scale: Column) -> Column:
    return laplace(x, loc, scale) * log_laplace_by_scale(x, loc, scale)


def laplace_by_logscale(x: Column, loc: Column, scale: Column) -> Column:
    return laplace(x, loc, scale) * log_laplace_by_logscale(x, loc, scale)


def logistic_cdf(x: Column) -> Column:
    return (F.lit(1.0) + F.tanh(x / 2)) / 2


def log_logistic_cdf(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def logistic_quantile(p: Column) -> Column:
    return F.atanh(p * 2 - 1) * 2


def logistic_density(x: Column) -> Column:
    p = logistic_cdf(x)
    return p * (1 - p)


def log_sum_exp(x: Column, y: Column) -> Column:
    """Of two; -inf is the neutral element, also of itself."""
    most = F.greatest(x, y)
    return F.when(most == float("-inf"), most).otherwise(most + F.log1p(F.exp(-F.abs(x - y))))


def log_sum_exp_of(a: Column) -> Column:
    shifted = lambda most: F.when(most == float("-inf"), most).otherwise(most + F.log(total(F.transform(a, lambda x: F.exp(x - most)))))
    return let(F.array_max(a), shifted)


def sincos(x: Column) -> Column:
    return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))


def ceil_div(x: Column, y: Column) -> Column:
    """For whole numbers that aren't negative."""
    return F.floor((x + y - 1) / y).cast("long")


def floor_div(x: Column, y: Column) -> Column:
    """Truncates towards zero."""
    q = x / y
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


int_min, int_max = F.least, F.greatest
# Approximate forms are for machines whose exact ones are slow; here each is the exact function.
fast_exp, fast_log, fast_logistic, fast_tanh, fast_elu = F.exp, F.log, logistic, F.tanh, elu
