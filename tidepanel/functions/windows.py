"""Column building blocks for panels: row windows, warm-up, ranks with average ties, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(time: str = "trade_date", key: str = "symbol") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def rows(n: int, over: WindowSpec) -> WindowSpec:
    """The last n rows of a series, this one included."""
    return over.rowsBetween(1 - n, 0)


def need(n: int, value: Column, agg, over: WindowSpec, least: int | None = None) -> Column:
    """agg(value) over the last n rows, null where fewer than `least` (n unless given) of them are known."""
    frame = rows(n, over)
    return F.when(F.count(value).over(frame) >= (least or n), agg(value).over(frame))


def change(value: Column, n: int, over: WindowSpec) -> Column:
    """Relative change over n rows."""
    return ratio(value, F.lag(value, n).over(over)) - 1


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    """x, null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def average_rank(value: Column, *keys: str, descending: bool = False) -> Column:
    """Rank within keys; rows of one value share the mean of their places. What is unknown (null, or not a finite number) has no rank and takes no place."""
    value = finite(value.cast("double"))
    order = Window.partitionBy(*keys).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())
    ties = Window.partitionBy(*keys, value)
    return F.when(value.isNotNull(), F.rank().over(order) + (F.count(value).over(ties) - 1) / 2)


def complete_mean(value: Column) -> Column:
    """Mean that is unknown unless every row's value is known."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def net_return(gross: Column, cost: Column | float) -> Column:
    """Return after a cost at either side."""
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    return (1 + gross) * (1 - cost) / (1 + cost) - 1


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


#: Coefficients of the rational approximation of the inverse normal distribution function, relative error below 1.15e-9.
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
PPF_TAIL = 0.02425


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function; null outside (0, 1)."""

    def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    low = F.least(p, 1 - p)
    q, z = F.sqrt(-2 * F.log(low)), p - 0.5
    tail = horner(q, PPF_C) / horner(q, PPF_D)
    middle = horner(z * z, PPF_A) * z / horner(z * z, PPF_B)
    return F.when((p > 0) & (p < 1), F.when(low >= PPF_TAIL, middle).otherwise(F.when(p < 0.5, tail).otherwise(-tail)))


def rnd(x: Column, digits: int) -> Column:
    """x to so many decimals by plain double arithmetic. Halves go up, also those that summing left a hair below a half, so two engines that
    add in different orders agree."""
    return F.floor(x * 10.0**digits + 0.500001) / 10.0**digits


def r6(x: Column) -> Column:
    return rnd(x, 6)


def r4(x: Column) -> Column:
    return rnd(x, 4)
