"""Null-safe arithmetic and statistics as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def sdiv(num: Column | str, den: Column | str, growth: bool = False) -> Column:
    """num/den where den > 0 and the quotient is finite, else NULL; minus one for growth."""
    num, den = col(num).cast("double"), col(den).cast("double")
    q = F.when(den > 0, F.try_divide(num, den))
    return finite(q - F.lit(1.0)) if growth else finite(q)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Half-up rounding by plain double arithmetic, so that engines agree."""
    scale = float(10**digits)
    return F.floor(finite(col(c).cast("double")) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def is_close(a: Column | str, b: Column | str, rtol: float = 0.0, atol: float = 1e-12) -> Column:
    """Paired NULLs are equal; otherwise |a-b| <= atol + rtol*|b|."""
    a, b = col(a), col(b)
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def signed(c: Column | str, tol: float = 1e-15) -> Column:
    """Sign with a zero band of width tol."""
    c = col(c)
    return F.when(c.isNull(), None).when(F.abs(c) <= tol, 0).when(c > 0, 1).otherwise(-1)


def is_integral_count(c: Column | str) -> Column:
    """Finite, non-negative, without a fraction."""
    c = finite(col(c).cast("double"))
    return F.coalesce((c >= 0) & (c == F.floor(c)), F.lit(False))


def both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation over rows with both values; NULL when either side is constant."""
    x, y = col(x), col(y)
    ok = both(x, y)
    x, y = F.when(ok, x), F.when(ok, y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def calibration_slope(actual: Column | str, pred: Column | str) -> Column:
    """Aggregate: cov(pred, actual)/var(pred); NULL for a constant prediction."""
    actual, pred = col(actual), col(pred)
    return F.when(F.min(pred) < F.max(pred), F.try_divide(F.covar_pop(pred, actual), F.var_pop(pred)))


def sample_std(x: Column | str) -> Column:
    """Aggregate: ddof-1 deviation, exactly zero for repeated values."""
    x = col(x)
    return F.when((F.count(x) > 1) & (F.min(x) == F.max(x)), F.lit(0.0)).otherwise(F.stddev_samp(x))


def sample_skewness(x: Column | str) -> Column:
    """Aggregate: bias-corrected skewness (n >= 3); zero for a constant."""
    x = col(x)
    n = F.count(x).cast("double")
    g1 = F.when(F.min(x) < F.max(x), F.skewness(x))
    return F.when(n >= 3, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def sample_kurtosis(x: Column | str) -> Column:
    """Aggregate: bias-corrected excess kurtosis (n >= 4); zero for a constant."""
    x = col(x)
    n = F.count(x).cast("double")
    g2 = F.when(F.min(x) < F.max(x), F.kurtosis(x))
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(adj, F.lit(0.0)))
