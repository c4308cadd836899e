"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0; a plain division raises there under ANSI mode."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column | str) -> Column:
    """NaN and infinities as null: Spark's aggregates would carry them on."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def chi2_sf(q: Column, df: int) -> Column:
    """P(X > q) for chi-squared with an even number of degrees of freedom: exp(-h) sum of h^i / i!, h = q / 2."""
    h, term, total = q / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


def clipped(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null, where greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
