"""Aggregates of finite values. `zero` forms give 0 where the others give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def quantile(c: Column, p: float) -> Column:
    """Exact, linear between the neighbours."""
    return F.percentile(c, F.lit(p))


def at_quantile(ordered: Column, p: float) -> Column:
    """The same of an array in order; null of an empty one."""
    at = (F.size(ordered) - 1) * p
    low = F.floor(at).cast("int")
    a = F.get(ordered, low)
    return F.when(F.size(ordered) > 0, a + (F.coalesce(F.get(ordered, low + 1), a) - a) * (at - low))


def first_value(c: Column, order: Column) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), order))


def last_value(c: Column, order: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), order))


def change(c: Column, order: Column, least: int = 2) -> Column:
    """Last less first; null with fewer than `least` values."""
    return F.when(F.count(c) >= least, last_value(c, order) - first_value(c, order))


def when_least(c: Column, t: Column) -> Column:
    """Time of the minimum, the earliest of several."""
    return F.min(F.when(c.isNotNull(), F.struct(c.alias("v"), t.alias("t"))))["t"]


def when_most(c: Column, t: Column) -> Column:
    return when_least(-c, t)


def slope(c: Column, t: Column, least: int = 3) -> Column:
    """Least-squares slope; null with fewer than `least` pairs or a single time."""
    return F.when((F.count(c) >= least) & (F.max(F.when(c.isNotNull(), t)) > F.min(F.when(c.isNotNull(), t))), F.regr_slope(c, t.cast("double")))


def time_under(c: Column, limit: float, step: float) -> Column:
    return F.count_if(c < limit) * F.lit(step)


def severity(c: Column, limit: float, step: float) -> Column:
    """Sum of what is missing to the limit, times the step."""
    return zero(F.sum(F.when(c.isNotNull(), F.greatest(F.lit(limit) - c, F.lit(0.0))))) * F.lit(step)


def rate(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def ever(flag: Column) -> Column:
    return F.coalesce(F.max(flag.cast("int")), F.lit(0))
