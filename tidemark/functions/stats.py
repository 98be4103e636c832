"""Statistics with the exact definitions the domain uses; every one is a Column over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def compound(returns: Column) -> Column:
    """prod(1 + r) - 1."""
    return F.product(1 + returns) - 1


def annualised_volatility(returns: Column, periods: int = 252) -> Column:
    """Sample deviation times the root of the periods; null below two values."""
    return F.stddev_samp(returns) * F.sqrt(F.lit(float(periods)))


def sharpe(returns: Column, risk_free: float = 0.0, periods: int = 252) -> Column:
    """(mean - the period's share of the annual rate) / sample deviation, annualised; null at zero deviation."""
    base = (1 + risk_free) ** (1 / periods) - 1
    return (F.avg(returns) - F.lit(base)) / F.nullif(F.stddev_samp(returns), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def beta(y: Column, x: Column) -> Column:
    """Sample covariance over sample variance; null without variance."""
    return F.covar_samp(y, x) / F.nullif(F.var_samp(F.when(y.isNotNull(), x)), F.lit(0.0))


def percentile(x: Column, p: float | list[float]) -> Column:
    """Linear interpolation between the two nearest ranks."""
    return F.percentile(x, p)


def nearest_rank(x: Column, p: float) -> Column:
    """The value at rank ceil(p * n), without interpolation."""
    values = F.sort_array(F.collect_list(x))
    return F.when(F.size(values) > 0, F.element_at(values, F.greatest(F.ceil(F.size(values) * p), F.lit(1)).cast("int")))


def upper_median(x: Column) -> Column:
    """The value at place n // 2 of the sorted values, from 0: the upper one of two middles."""
    values = F.sort_array(F.collect_list(x))
    return F.when(F.size(values) > 0, F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int")))


def rolling(by: list[str], order: str, rows: int) -> WindowSpec:
    """The last `rows` rows of a key, the current one included."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over |b|; null if b is zero."""
    return F.abs(a - b) / F.nullif(F.abs(b), F.lit(0.0))
