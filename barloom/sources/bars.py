"""Bars: rows (series_id, bar_idx, ts, open, high, low, close, volume), one series after time.

``bar_idx`` counts from 0 in each series; every operator that looks along time does so within ``series_id`` by ``bar_idx``, so series are
dealt over the cluster and none needs another's rows. Undefined numbers are NULL inside the engine; NaN in an input becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

PRICES = ("open", "high", "low", "close")
#: Columns that older exports carry and the engine computes itself.
LEGACY = ("EMA 9", "SMA 200", "ADX", "ATR")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def finite(c: Column | str) -> Column:
    """A number, or NULL if it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows of each series in the order of time."""
    return df.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("series_id").orderBy(*order)) - 1).cast("long"))


def to_bars(rows: DataFrame, series: Column, bucket: Column, value: str, *order: str) -> DataFrame:
    """Bars of the values of event rows by time bucket; open and close are the values at the ends of ``order``."""
    at = F.struct(*order)
    out = rows.groupBy(series.alias("series_id"), bucket.alias("ts")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("volume"),
    )
    return with_index(out, "ts").select("series_id", "bar_idx", "ts", *PRICES, "volume")


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all events, one series."""
    return to_bars(read_table(spark, sf_dir, "events"), F.lit("events"), F.date_trunc("hour", "ts"), "value", "ts", "event_id")


def bars_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, a series for each type of event."""
    return to_bars(read_table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("day", "ts"), "value", "ts", "event_id")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one long series."""
    return to_bars(read_table(spark, sf_dir, "orders"), F.lit("orders"), F.date_trunc("day", "o_orderdate"), "o_totalprice", "o_orderkey")


RAW_SCHEMA = T.StructType([T.StructField("timestamp", T.StringType()), *[T.StructField(p, T.DoubleType()) for p in PRICES], T.StructField("volume", T.DoubleType())])


def read_raw_csv(spark: SparkSession, path: str, series_id: str = "raw", schema: T.StructType | None = RAW_SCHEMA) -> DataFrame:
    """Bars of a CSV export: a header, bad cells NULL, legacy columns dropped, rows with an empty timestamp dropped.

    With ``schema=None`` extra columns are read and kept (types inferred from the file)."""
    ship_package(spark)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(schema).option("enforceSchema", False).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = df.drop(*LEGACY)
    stamp = next(c for c in ("timestamp", "datetime", "time") if c in df.columns)
    df = df.select(F.lit(series_id).alias("series_id"), F.col(stamp).cast("timestamp").alias("ts"), *[finite(F.col(p).cast("double")).alias(p) for p in PRICES], *[c for c in df.columns if c not in (stamp, *PRICES)])
    return with_index(df.where("ts is not null"), "ts")


def check_prices(bars: DataFrame) -> DataFrame:
    """Bars whose four prices are all present; the feature frame is defined on them only."""
    return bars.dropna(subset=list(PRICES))


def date_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with start <= UTC date <= end. ``bar_idx`` keeps its meaning, so exit indices need no remapping; ``remap_exits`` gives the positions in the slice."""
    day = F.to_date("ts")
    out = bars.where("ts is not null")
    if start:
        out = out.where(day >= F.lit(start).cast("date"))
    return out.where(day <= F.lit(end).cast("date")) if end else out


def embargo(bars: DataFrame, n: int) -> DataFrame:
    """Bars without the first ``n`` of each series of the slice."""
    low = F.min("bar_idx").over(Window.partitionBy("series_id"))
    return bars.withColumn("_low", low).where(F.col("bar_idx") >= F.col("_low") + n).drop("_low")


def remap_exits(bars: DataFrame) -> DataFrame:
    """``bar_idx`` and all exit indices counted from the first bar of the slice; an exit before it is NULL."""
    low = F.min("bar_idx").over(Window.partitionBy("series_id"))
    df = bars.withColumn("_low", low)
    for c in [c for c in bars.columns if "_exit_i" in c]:
        df = df.withColumn(c, F.when(F.col(c) >= F.col("_low"), F.col(c) - F.col("_low")))
    return df.withColumn("bar_idx", F.col("bar_idx") - F.col("_low")).drop("_low")


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash of all values."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h")).first()
    return int(r["n"]), int(r["h"])


def write_prepared(df: DataFrame, path: str, replace: bool = False) -> bool:
    """Write a prepared data set; an equal one that stands there is reused (False), another one is an error unless ``replace``."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        if content_hash(old) == content_hash(df):
            return False
        if not replace:
            raise ValueError(f"{path} holds other data; pass replace=True to write over it")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(path)
