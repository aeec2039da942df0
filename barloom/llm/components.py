"""Connected components of a table of links, without bringing links or components to the driver.

Alternates the two star steps: large-star links every larger neighbour of a node to the smallest node of its
neighbourhood, small-star does so for the smaller ones. Both keep the components and shorten paths, so the number of rounds
grows with the logarithm of the longest path. What a node with very many links meets is summed before the shuffle, and the rows that get the sum back
are dealt out in salts (``with_least``), so no task holds a node's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: keys with more rows than this, or than a 50,000th of all rows, are dealt out
HOT_ROWS, HOT_KEYS = 64, 50_000


def with_least(rows: DataFrame, key: str, value: str, least: str, tables: Tables, above: int = 0, of: int | None = None) -> DataFrame:
    """``rows`` and a column ``least``: the smallest ``value`` of the rows with the same ``key``; only keys of more than ``above`` rows stay.
    ``rows`` should be a table, for it is read twice; ``of``: how many rows it has, if that is known."""
    sums = tables.keep(rows.groupBy(key).agg(F.min(value).alias(least), F.count("*").alias("_n")).where(F.col("_n") > above))
    of = of if of is not None else sums.agg(F.sum("_n")).first()[0] or 0
    share = max(HOT_ROWS, of // HOT_KEYS)
    hot = F.broadcast(sums.where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))  # HOT_KEYS rows at most
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(value, F.lit(3)), parts).cast("int")).drop("_parts")
    own = F.when(F.col("_n") > share, F.ceil(F.col("_n") / share)).otherwise(1).cast("int")
    low = sums.select(key, least, F.explode(F.sequence(F.lit(0), own - 1)).alias("_salt"))
    return salted.join(low, [key, "_salt"]).drop("_salt")


def _large_star(e: DataFrame, n: int, tables: Tables) -> DataFrame:
    """Links (larger, smaller) of the larger neighbours of each node to the smallest of its neighbourhood."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = with_least(both, "u", "v", "m", tables, of=2 * n).withColumn("m", F.least("m", "u"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # the small step drops repeats


def _small_star(e: DataFrame, n: int, tables: Tables) -> DataFrame:
    """Links of the smaller neighbours of each node, and of the node, to the smallest of them; ``e``: (larger, smaller)."""
    near = with_least(e, "u", "v", "m", tables, of=n)
    return near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()


def _stars(e: DataFrame) -> tuple[bool, int]:
    """Whether every node has one link, and none that is linked to is linked on; and how many links there are."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    by = ends.groupBy("x").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    odd, n = by.agg(F.count_if(F.expr("n > 1 or (n = 1 and least = 0)")), F.sum("n")).first()
    return not odd, n or 0


def components(links: DataFrame, tables: Tables, most: int = 60) -> DataFrame:
    """(u, v): each linked node u above its component's smallest node v. ``links`` has the columns u, v of one orderable type. The result is one of ``tables``."""
    e = tables.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most):
        settled, n = _stars(e)
        if settled:
            return e
        e = tables.keep(_small_star(tables.keep(_large_star(e, n, tables)), n, tables))
    raise RuntimeError(f"components not settled after {most} rounds")


def joined(top: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """The components ``top`` (a table that ``components`` gave) after more ``links``, a table too; without any they are as they were."""
    return top if links.isEmpty() else components(top.unionAll(links), tables)
