"""Barrier trades of series in parts end where one pass ends them."""

import numpy as np
import pytest

from barloom.operators import targets

BARS = "series_id string, bar_idx long, ts timestamp, open double, high double, low double, close double, atr double"


def walk(name, n, seed, drift=0.0, jumps=0.0):
    import datetime as dt

    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(drift, 1, n) + np.where(rng.random(n) < jumps, rng.normal(0, 12, n), 0))
    o = np.concatenate(([100.0], c[:-1])) + rng.normal(0, 0.3, n)
    h, low = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    atr = 1.5 + rng.random(n) * 4
    start, gone = dt.datetime(2024, 1, 1), rng.random(n) < 0.05
    return [(name, i, start + dt.timedelta(hours=i), *[float(x) for x in p[:1]], None if g else float(p[1]), float(p[2]), float(p[3]), float(p[4])) for i, (*p, g) in enumerate(zip(o, h, low, c, atr, gone))]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([*walk("a", 400, 1, jumps=0.05), *walk(None, 260, 2, drift=0.2), *walk("b", 3, 3), *walk("c", 120, 4, drift=-0.5)], BARS).repartition(3).cache()


@pytest.mark.parametrize("name,direction,date_end,size", [
    ("2x_atr_tp_atr_stop", "long", None, 7), ("3x_atr_tp_atr_stop", "short", "2024-01-06", 32), ("highlow_or_atr", "both", "2024-01-09", 16), ("highlow_1r", "both", None, 50), ("highlow_or_atr_tightest_stop", "both", "2023-01-01", 16), ("highlow_sl_2x_atr_tp_rr_gt_1", "both", "2024-01-03", 5),
])
def test_parts_equal_one_pass(bars, name, direction, date_end, size):
    """Gaps at the edges of parts, trades held over many parts, a cutoff within a part, a series of one part."""
    run = lambda part: targets.barrier_target(bars, name, direction, 0.25, date_end, part).toPandas().sort_values(["series_id", "bar_idx"], na_position="first").reset_index(drop=True)
    want, got = run(None), run(size)
    assert list(want.columns) == list(got.columns) and len(want) == len(got) == 783
    sides = ("long", "short") if direction == "both" else (direction,)
    held = []
    for c in want.columns:
        a, b = want[c], got[c]
        assert np.allclose(a.astype(float), b.astype(float), rtol=1e-12, equal_nan=True) if a.dtype.kind == "f" else a.equals(b), c
    for s in sides:
        exits = want[f"{name}_exit_i_{s}"]
        held.append(int(((exits // size) > want["bar_idx"] // size).sum()))
    assert sum(held) > 20


def test_a_trade_that_nothing_ends_stays_open(spark):
    rows = [("a", i, None, 100.0, 101.0, 99.9, 100.5 if i == 0 else 100.0, 50.0) for i in range(90)]
    df = spark.createDataFrame(rows, BARS)
    got = targets.barrier_target(df, "atr_tp_atr_stop", "long", None, None, 10)
    assert got.where("rr_atr_tp_atr_stop is not null").count() == 0 and got.count() == 90
