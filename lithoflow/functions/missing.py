"""Missing values and division: NULL is the only missing value, infinity is a value.

Spark orders NaN above all numbers and raises on division by zero; these helpers
give the arithmetic that the uncertainty formulae need instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: Fixed value: variance of a cell about which nothing is known.
SENTINEL = 100000.0


def lit_double(x: float | None) -> Column:
    return F.lit(None).cast("double") if x is None else F.lit(float(x))


def no_nan(c: Column) -> Column:
    """NaN becomes NULL; for every source and after arithmetic that may yield NaN."""
    return F.when(~F.isnan(c), c)


def safe_recip(c: Column) -> Column:
    """1/c with 1/0 = infinity; NULL stays NULL."""
    return F.when(c == 0, F.lit(INF)).otherwise(F.lit(1.0) / c)


def safe_divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is signed infinity, 0/0 is missing."""
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return no_nan(F.when(b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(a / b).cast("double"))


def any_null(*cs: Column) -> Column:
    return reduce(lambda x, y: x | y, (c.isNull() for c in cs))


def greatest_prop(*cs: Column) -> Column:
    """Largest value; missing if any is missing (``F.greatest`` skips missing ones)."""
    return F.when(~any_null(*cs), F.greatest(*cs))


def least_prop(*cs: Column) -> Column:
    return F.when(~any_null(*cs), F.least(*cs))


def all_present(agg: Column, c: Column) -> Column:
    """``agg`` if no value of the group is missing, else missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


#: Reducers over exactly tied observations.
REDUCERS = {
    "mean": lambda c: all_present(F.avg(c), c),
    "min": lambda c: all_present(F.min(c), c),
    "max": lambda c: all_present(F.max(c), c),
}
