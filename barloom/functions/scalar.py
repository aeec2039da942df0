"""Row-local functions on columns; comparisons with an undefined side are false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances that equal results depend on.
EPS = 2.220446049250313e-16
SMALL = 1e-9
TOLERANCE = 1e-10


def yes(c: Column) -> Column:
    """A condition that is false where it is undefined."""
    return F.coalesce(c, F.lit(False))


def rounded(x: Column | str, digits: int) -> Column:
    """x at so many decimals, halves of the scaled double away from zero, as SQL engines round doubles; Spark's own round takes the halves of the shortest decimal."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b, and 0 where b is next to 0."""
    return F.when(F.abs(b) < eps, 0.0).otherwise(F.try_divide(a, b))


def deviation(a: Column, b: Column) -> Column:
    """a / b - 1, and 0 where b is next to 0."""
    return F.when(F.abs(b) < EPS, 0.0).otherwise(F.try_divide(a, b) - 1.0)


def above(a: Column, b: Column | float) -> Column:
    return yes(a > b)


def below(a: Column, b: Column | float) -> Column:
    return yes(a < b)


def clearly_above(a: Column, b: Column) -> Column:
    """a > b by more than the tolerance."""
    return yes(a - b > TOLERANCE)


def clearly_below(a: Column, b: Column) -> Column:
    return yes(b - a > TOLERANCE)


def zscore_beyond(x: Column, mean: Column, std: Column, t: float) -> Column:
    return yes(F.when(std == 0, False).otherwise(F.abs(F.try_divide(x - mean, std)) > t))


def upper_wick(o: Column, h: Column, c: Column) -> Column:
    return h - F.greatest(o, c)


def lower_wick(o: Column, low: Column, c: Column) -> Column:
    return F.least(o, c) - low


def chain(*columns: Column, rising: bool = False) -> Column:
    """Whether the columns come in strictly falling (or rising) order."""
    out = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        out = out & ((a < b) if rising else (a > b))
    return yes(out)


def bollinger_position(c: Column, low: Column, high: Column) -> Column:
    return F.when(F.abs(high - low) < EPS, 0.5).otherwise(F.try_divide(c - low, high - low))


def tick_distance(d: Column, tick: float, mode: str = "ceil") -> Column:
    """A distance in whole ticks, one at least unless it is 0."""
    ticks = d / tick
    n = {"nearest": F.round(ticks), "floor": F.floor(ticks), "ceil": F.ceil(ticks)}[mode].cast("double")
    return F.when(F.abs(d) < EPS, 0.0).otherwise(F.greatest(n, F.lit(1.0)) * tick)


def tick_price(p: Column, tick: float, mode: str = "nearest") -> Column:
    """A price on the grid of ticks."""
    ticks = p / tick
    return {"nearest": F.round(ticks), "floor": F.floor(ticks), "ceil": F.ceil(ticks)}[mode].cast("double") * tick


def stop_level(entry: Column, extreme: Column, atr: Column, long: bool, mode: str) -> Column:
    """The stop of a trade. ``wide``: the farther of bar extreme and one ATR; ``bar``: the extreme; ``atr``: one ATR;
    ``tight``: the nearer one that stands on the right side of the entry."""
    by_atr = entry - atr if long else entry + atr
    if mode == "bar":
        return extreme
    if mode == "atr":
        return by_atr
    if mode == "wide":
        return F.least(extreme, by_atr) if long else F.greatest(extreme, by_atr)
    right = (lambda x: F.when(x < entry, x)) if long else (lambda x: F.when(x > entry, x))
    return F.greatest(right(extreme), right(by_atr)) if long else F.least(right(extreme), right(by_atr))
