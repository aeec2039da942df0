"""Ranks and quantiles of the values of each series, exact, without a task that holds a series.

Distinct values are counted first, so ties take no room. Approximate quantiles, a bounded sketch of each series, only deal the distinct values into bins; sums of the bins before and of the smaller values of a bin then give exact
places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import beside

#: bins of a series
BINS = 128


def placed(df: DataFrame, value: str) -> DataFrame:
    """series_id, value, n, before, total: how often each value occurs in its series, how many smaller ones there are, and how many in all. NULL does not count."""
    vals = df.where(F.col(f"`{value}`").isNotNull()).groupBy("series_id", F.col(f"`{value}`").cast("double").alias("value")).agg(F.count("*").alias("n"))
    cuts = vals.groupBy("series_id").agg(F.percentile_approx("value", [i / BINS for i in range(1, BINS)], 10_000).alias("_cuts"))
    both = beside(vals, cuts, {"series_id": "series_id"}).select("series_id", "value", "n", F.size(F.filter("_cuts", lambda x: x < F.col("value"))).alias("_bin"))
    sums = both.groupBy("series_id", "_bin").agg(F.sum("n").alias("_n"))
    series = Window.partitionBy("series_id")
    sums = sums.select("series_id", "_bin", (F.sum("_n").over(series.orderBy("_bin")) - F.col("_n")).alias("_off"), F.sum("_n").over(series).alias("total"))  # BINS rows a series
    inner = F.sum("n").over(Window.partitionBy("series_id", "_bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_in", F.coalesce(inner, F.lit(0)))
    return beside(both, sums, {"series_id": "series_id", "_bin": "_bin"}).select("series_id", "value", "n", (F.col("_off") + F.col("_in")).alias("before"), "total")


def ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """series_id, value and ``name``: the rank of each value (ties share the mean of their ranks) over the number of values of its series."""
    return placed(df, value).select("series_id", "value", ((F.col("before") + 1 + (F.col("n") - 1) / 2.0) / F.col("total")).alias(name))


def percentile_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the rank of a value (ties share the mean of their ranks) over the number of values of its series."""
    return beside(df, ranks(df, value, name), {"series_id": "series_id", f"CAST(`{value}` AS DOUBLE)": "value"}, "left")


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """series_id and a column for each of ``shares``: the quantile, between the two elements that it lies between."""
    p = placed(df, value)

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("value")))

    def of(share: float) -> Column:
        place = (F.col("total") - 1) * F.lit(share)
        low, high = F.floor(place), F.ceil(place)
        part = F.max(place - low)
        return F.when(at(low) == at(high), at(low)).otherwise((1.0 - part) * at(low) + part * at(high))

    return p.groupBy("series_id").agg(*[of(q).alias(name) for name, q in shares.items()])


#: how far a bracket reaches on both sides of a share; the sketch errs by a ten-thousandth of the rows
REACH = 0.0005


def column_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], truncated: bool = False) -> dict[str, tuple[int, list[float]]]:
    """Count and exact quantiles (linear, or the value at the place below) of each column over all rows, NULL aside, in three passes for all columns at once: sketches give a bracket of values around each quantile, counts of what is below say which place in the bracket
    is wanted (a bracket that the sketch put wrong is opened to both ends), and only the values inside brackets, a thousandth of the rows for each, are counted and put in order."""
    names = list(columns)
    x = [F.col(f"v{i}") for i in range(len(names))]
    v = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    ends = [min(max(q + d, 0.0), 1.0) for q in shares for d in (-REACH, REACH)]
    r = v.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(x)], *[F.percentile_approx(c, ends, 10_000).alias(f"p{i}") for i, c in enumerate(x)]).first()
    there = [i for i in range(len(names)) if r[f"n{i}"]]
    places = {(i, k): float(math.floor((r[f"n{i}"] - 1) * q)) if truncated else (r[f"n{i}"] - 1) * q for i in there for k, q in enumerate(shares)}
    bracket = {(i, k): (r[f"p{i}"][2 * k], r[f"p{i}"][2 * k + 1]) for i, k in places}
    if not places:
        return {}
    c = v.agg(*[e for (i, k), (a, b) in bracket.items() for e in (F.count_if(x[i] < a).alias(f"a{i}_{k}"), F.count_if(x[i] <= b).alias(f"b{i}_{k}"))]).first()
    below = {}
    for key, at in places.items():
        below[key] = c[f"a{key[0]}_{key[1]}"]
        if not (below[key] <= math.floor(at) and math.ceil(at) < c[f"b{key[0]}_{key[1]}"]):
            bracket[key], below[key] = (-math.inf, math.inf), 0
    inside = F.array_compact(F.array(*[F.when((x[i] >= a) & (x[i] <= b), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), x[i].alias("value"))) for (i, k), (a, b) in bracket.items()]))
    counts = v.select(F.inline(inside)).groupBy("i", "k", "value").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i", "k").orderBy("value")))
    want = F.create_map(*[F.lit(y) for (i, k), at in places.items() for y in (i * len(shares) + k, float(at - below[i, k]))])
    at = F.element_at(want, F.col("i") * len(shares) + F.col("k"))
    met = lambda p: (F.col("upto") - F.col("n") <= p) & (p < F.col("upto"))
    found = upto.groupBy("i", "k").agg(F.max(F.when(met(F.floor(at)), F.col("value"))).alias("low"), F.max(F.when(met(F.ceil(at)), F.col("value"))).alias("high")).collect()  # a row for each column and share
    out: dict[str, tuple[int, list[float]]] = {names[i]: (r[f"n{i}"], [math.nan] * len(shares)) for i in there}
    for f in found:
        part = places[f.i, f.k] - math.floor(places[f.i, f.k])
        out[names[f.i]][1][f.k] = f.low if f.low == f.high else (1.0 - part) * f.low + part * f.high
    return out
