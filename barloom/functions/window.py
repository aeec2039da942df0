"""Functions along a series that SQL windows express; a value is NULL until its frame is full.

All take a window made by ``along()``: partitioned by series, ordered by bar, so Spark sorts a series once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import EPS, yes


def along() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("bar_idx")


def last(n: int) -> WindowSpec:
    return along().rowsBetween(-(n - 1), 0)


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def lag(c: Column, n: int = 1) -> Column:
    return F.lag(c, n).over(along())


def full(c: Column, n: int, value: Column) -> Column:
    """``value`` where the last n rows all have c."""
    return F.when(F.count(c).over(last(n)) == n, value)


def sma(c: Column, n: int) -> Column:
    return full(c, n, F.avg(c).over(last(n)))


def rolling_std(c: Column, n: int) -> Column:
    """Sample standard deviation; 0 for n = 1."""
    return full(c, n, F.lit(0.0) if n == 1 else F.stddev_samp(c).over(last(n)))


def rolling_min(c: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(last(n)) == n, F.min(c).over(last(n)))


def rolling_max(c: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(last(n)) == n, F.max(c).over(last(n)))


def rolling_cv(c: Column, n: int) -> Column:
    mean = sma(c, n)
    return F.when(F.abs(mean) < EPS, 0.0).otherwise(F.try_divide(rolling_std(c, n), mean))


def rolling_true(c: Column, n: int) -> Column:
    """How many of the last n are true."""
    return F.when(F.count(F.lit(1)).over(last(n)) == n, F.sum(c.cast("int")).over(last(n)).cast("double"))


def streak(c: Column, n: int) -> Column:
    """Whether all of the last n are true."""
    return yes(rolling_true(c, n) == n)


def shifted(c: Column, n: int = 1) -> Column:
    return F.lag(c, n, False).over(along())


def momentum(c: Column, n: int) -> Column:
    """x - x[n bars ago]; 0 before there is one."""
    return F.when(F.col("bar_idx") < n, 0.0).otherwise(c - lag(c, n))


def roc(c: Column, n: int) -> Column:
    old = lag(c, n)
    return F.when(F.abs(old) >= EPS, F.try_divide(c, old) - 1.0)


def extension(high: Column, low: Column, n: int) -> Column:
    return F.coalesce(high - rolling_min(low, n), F.lit(0.0))


def bollinger(c: Column, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column, Column]:
    """Middle, upper, lower band and deviation."""
    mid, std = sma(c, n), rolling_std(c, n)
    return mid, mid + k * std, mid - k * std, std


def squeeze(c: Column, n: int, m: float) -> Column:
    return yes(c < rolling_min(c, n) * m)


def crosses(a: Column, b: Column, up: bool = True) -> Column:
    """a was at or under b and now is above it, or the mirror of that."""
    p, q = lag(a), lag(b)
    return yes((p <= q) & (a > b)) if up else yes((p >= q) & (a < b))


def recovers(c: Column, level: float, up: bool = True) -> Column:
    """c strictly crosses a level."""
    return yes((lag(c) < level) & (c > level)) if up else yes((lag(c) > level) & (c < level))


def changes(c: Column, up: bool = True, n: int = 1) -> Column:
    """c against its value n bars ago."""
    return yes(c > lag(c, n)) if up else yes(c < lag(c, n))


def double_rising(c: Column) -> Column:
    return yes((c > lag(c)) & (lag(c) > lag(c, 2)))


def accelerates(slope: Column, up: bool = True) -> Column:
    """The slope keeps its sign and grows in it."""
    return yes((slope > 0) & (slope > lag(slope))) if up else yes((slope < 0) & (slope < lag(slope)))


def percentile_rank(c: Column) -> Column:
    """The rank of a value (ties share the mean of their ranks) over the number of values, in the whole series."""
    order = Window.partitionBy("series_id", c.isNull()).orderBy(c)
    ties = Window.partitionBy("series_id", c)
    n = F.count(c).over(whole())
    return F.when(c.isNotNull(), (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / n)


def true_range() -> Column:
    h, low, prev = F.col("high"), F.col("low"), lag(F.col("close"))
    return F.when(prev.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - prev), F.abs(low - prev)))
