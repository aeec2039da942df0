"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, with_fields


__all__ = ["Tables", "claim", "crc_mod", "cut", "delete", "marks", "own_prefix", "read", "shared_dir", "small_batches", "text_key", "with_fields"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none and runs on one machine (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def own_prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has, for columns of one's own."""
    p = "_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage: a lost executor costs a re-read, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Compressed tables in the shared folder that live as long as a with block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.home = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Tables:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again. Now and then what no plan refers to any more is collected, so that Spark deletes the shuffles behind it."""
        self.n += 1
        df.write.parquet(f"{self.home}/{self.n}")
        if self.n % 6 == 0:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{self.n}")

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.home)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def marks(ids: DataFrame, bits: int = 26) -> tuple[int, Broadcast]:
    """``bits``, and a broadcast bitmap of 2 ** bits places in which the highest ``bits`` of each ``id`` (a hash, unsigned) are marked: 8 MB for any number of rows."""
    place = (F.shiftrightunsigned("id", 64 - bits) + 1).alias("x")
    parts = ids.select(place).groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for part, got in zip(*parts.toArrow().columns):  # in one job; an iterator over its partitions would take one for each
        got = np.frombuffer(got.as_buffer(), np.uint8)
        out[(part.as_py() - 1) * len(got) : part.as_py() * len(got)] = got
    return bits, ids.sparkSession.sparkContext.broadcast(out)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Python workers get at most ``rows`` rows of a frame at a time: whole texts are large, and Spark and the worker each hold a batch or two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_held: tuple[str, Callable[[], None]] | None = None


def claim(owner: str, clear: Callable[[], None]) -> None:
    """A worker serves one operator after another; what an operator keeps between tasks (``clear`` empties it) goes when the next one begins."""
    global _held
    if _held and _held[0] != owner:
        _held[1]()
        gc.collect()
    _held = (owner, clear)


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def text_key(column: str = "text") -> list[Column]:
    """128 bits that stand for a whole text in joins and groups; null and the empty text differ."""
    t = F.col(column)
    return [F.xxhash64(t, F.lit(0)).alias("k1"), F.xxhash64(F.lit(1), t, F.length(t)).alias("k2")]
