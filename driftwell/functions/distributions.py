"""Distribution functions that Spark lacks, on numpy arrays; columns get them through pandas UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of the normal distribution function; p is kept inside (1e-15, 1 - 1e-15)."""
    return _NORMAL.inv_cdf(min(max(p, 1e-15), 1 - 1e-15))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(abs(1 + numerator * d), 1e-300) * (1 if 1 + numerator * d > 0 else -1)
        c = 1 + numerator / (c if c else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def _column(f):
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or np.isnan(v) else f(float(v)))

    return run


@F.pandas_udf(DoubleType())
def phi(z: pd.Series) -> pd.Series:
    """The normal distribution function."""
    return _column(normal_cdf)(z)


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|) for a standard normal Z."""
    return _column(lambda v: math.erfc(abs(v) / math.sqrt(2)))(z)


@F.pandas_udf(DoubleType())
def two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) for Student's t."""
    return pd.Series([None if np.isnan(a) or np.isnan(b) or b <= 0 else 2 * (1 - student_cdf(abs(a), b)) for a, b in zip(t.astype(float), df.astype(float))], dtype=float)
