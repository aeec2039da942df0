"""Series whose parts lie in several tasks give what one pass gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import recurrence as R
from barloom.functions.chain import along_parts, rounds
from barloom.operators import order
from barloom.operators.features import features

BARS = "series_id string, bar_idx long, open double, high double, low double, close double"


def walk(name, n, seed, missing=0.0):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    o = np.concatenate(([100.0], c[:-1]))
    h, low = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    gone = lambda x: [None if rng.random() < missing else float(v) for v in x]
    return [(name, i, *p) for i, p in enumerate(zip(o.tolist(), gone(h), gone(low), gone(c)))]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([*walk("long", 600, 1), *walk(None, 150, 2), *walk("one", 1, 3), *walk("gaps", 300, 4, 0.1)], BARS).repartition(3)


def frame(df, *drop):
    return df.toPandas().sort_values(["series_id", "bar_idx"], na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("size", [7, 64])
def test_recurrences_in_parts(bars, size):
    want, got = frame(R.recurrences(bars)), frame(R.recurrences(bars, size))
    assert len(want) == len(got) == 1051 and len(rounds(R._all, 4)) == 5
    for name in R.FOLDS:
        assert np.allclose(want[name].astype(float), got[name].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_a_long_series_meets_in_no_task(spark, bars):
    """With parts of 64 bars no row of the packed series holds more, and the scan sees one row for each part."""
    from barloom.functions.chain import packed, part_of

    sizes = [len(r[0]) for r in packed(bars.withColumn("_part", part_of(64)), ("close",)).select("_bars").collect()]
    assert max(sizes) == 64 and len(sizes) == 10 + 3 + 1 + 5


def test_parts_follow_the_index_not_the_rows(spark):
    """Indices with holes: parts have fewer bars, some are empty."""
    rows = [("a", i * i, 1.0, 2.0, 0.5, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, BARS)

    def make(x):
        v = yield from R.ema_of(x, 3)
        return {"v": v}

    got = frame(along_parts(df, make, ("close",), 50, v="double"))
    assert np.allclose(got["v"], R.ema(np.arange(40) % 5.0, 3), equal_nan=True)


@pytest.mark.parametrize("trim", [True, False])
def test_features_in_segments(spark, trim):
    bars = spark.createDataFrame([*walk("x", 700, 5), *walk(None, 420, 6), *walk("short", 30, 7)], BARS)
    want, got = frame(features(bars, trim=trim)), frame(features(bars, trim=trim, part=150))
    assert list(want.columns) == [c for c in got.columns] and len(want) == len(got) > 500
    for name in want.columns:
        a, b = want[name], got[name]
        assert (np.allclose(a.astype(float), b.astype(float), rtol=1e-8, atol=1e-8, equal_nan=True) if a.dtype.kind == "f" else a.equals(b)), name


def test_places_and_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(s, float(v)) for s in ("a", None) for v in rng.integers(0, 40, 300)] + [("a", None), ("b", 1.5), ("c", None)] + [("d", float(v)) for v in rng.normal(0, 1, 999)]
    df = spark.createDataFrame(rows, "series_id string, v double")
    got = {r.series_id: (r.q, r.p) for r in order.quantiles(df, "v", {"q": 0.8, "p": 0.013}).collect()}
    want = {r.series_id: (r.q, r.p) for r in df.groupBy("series_id").agg(F.percentile("v", 0.8).alias("q"), F.percentile("v", 0.013).alias("p")).collect() if r.q is not None}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-14) for k in want)
    from barloom.functions.window import percentile_rank

    a = {(r.series_id, r.v): r.r for r in df.withColumn("r", percentile_rank(F.col("v"))).collect()}
    assert {(r.series_id, r.v): r.r for r in order.percentile_ranks(df, "v", "r").collect()} == a
