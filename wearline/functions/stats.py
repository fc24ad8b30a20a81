"""Statistics as expressions, over groups or windows.

Every function takes a column and a wrapper that puts an aggregate over its window (or nothing), so
that one definition serves groups, rolling and expanding windows. Zero denominators give NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.functions.quantiles import Quantile

Over = Callable[[Column], Column]


def _same(c: Column) -> Column:
    return c


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    """NULL for what is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def skewness(x: Column, over: Over = _same) -> Column:
    """Bias-corrected; NULL below 3 values or without spread."""
    n = over(F.count(x)).cast("double")
    g = over(F.skewness(x))
    return F.when(n >= 3, F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) / F.greatest(n - 2, F.lit(1.0)) * g)


def kurtosis(x: Column, over: Over = _same) -> Column:
    """Bias-corrected excess; NULL below 4 values or without spread."""
    n = over(F.count(x)).cast("double")
    g = over(F.kurtosis(x))
    return F.when(n >= 4, (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g + 6))


def peak(x: Column, over: Over = _same) -> Column:
    return over(F.max(x)) - over(F.min(x))


def rms(x: Column, over: Over = _same) -> Column:
    return F.sqrt(over(F.avg(x * x)))


def mean_abs(x: Column, over: Over = _same) -> Column:
    return over(F.avg(F.abs(x)))


def impulse(x: Column, over: Over = _same) -> Column:
    return ratio(peak(x, over), mean_abs(x, over))


def clearance(x: Column, over: Over = _same) -> Column:
    """Peak over the squared mean of square roots."""
    return ratio(peak(x, over), F.pow(over(F.avg(F.sqrt(F.abs(x)))), F.lit(2.0)))


def clearance_of_life(x: Column, over: Over = _same) -> Column:
    """The whole-cycle variant: the square of peak over the mean of square roots."""
    return F.pow(ratio(peak(x, over), over(F.avg(F.sqrt(F.abs(x))))), F.lit(2.0))


def shape(x: Column, over: Over = _same) -> Column:
    return ratio(rms(x, over), mean_abs(x, over))


def crest(x: Column, over: Over = _same) -> Column:
    return ratio(peak(x, over), rms(x, over))


def deviance(x: Column, over: Over = _same) -> Column:
    return ratio(x - over(F.avg(x)), over(F.stddev_samp(x)))


def _spread_of(function: Callable[[Column], Column]) -> Callable[..., Column]:
    def spread(x: Column, over: Over = _same) -> Column:
        return over(F.stddev_samp(finite(function(x))))

    return spread


def energy(x: Column, over: Over = _same) -> Column:
    return over(F.sum(x * x))


#: Statistics of windows.
WINDOWED: dict[str, Callable[..., Column]] = {
    "mean": lambda x, over=_same: over(F.avg(x)),
    "max": lambda x, over=_same: over(F.max(x)),
    "min": lambda x, over=_same: over(F.min(x)),
    "std": lambda x, over=_same: over(F.stddev_samp(x)),
    "kurtosis": kurtosis,
    "skewness": skewness,
    "peak": peak,
    "impulse": impulse,
    "clearance": clearance,
    "rms": rms,
    "shape": shape,
    "crest": crest,
    "deviance": deviance,
    "std_atan": _spread_of(F.atan),
    "std_acosh": _spread_of(F.acosh),
    "std_asinh": _spread_of(F.asinh),
    "energy": energy,
}

#: Statistics of whole cycles; these are 0 where a denominator is not positive.
OF_LIFE: dict[str, Callable[..., Column]] = {
    "kurtosis": kurtosis,
    "skewness": skewness,
    "max": lambda x: F.max(x),
    "min": lambda x: F.min(x),
    "std": lambda x: F.stddev_samp(x),
    "peak": peak,
    "impulse": lambda x: F.coalesce(impulse(x), F.lit(0.0)),
    "clearance": lambda x: F.coalesce(clearance_of_life(x), F.lit(0.0)),
    "rms": rms,
    "shape": lambda x: F.coalesce(shape(x), F.lit(0.0)),
    "crest": lambda x: F.coalesce(crest(x), F.lit(0.0)),
}


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, over rows that have both; NULL without spread (where Spark's own divides by zero)."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def quantile(x: Column, q: float) -> Quantile:
    """Exact, with linear interpolation, for ``Frame.agg``: at any size."""
    return Quantile(x, q)
