"""Trades and their metrics over parts equal those of one pass."""

import numpy as np
import pytest

from barloom.operators import trades
from barloom.operators.combine import choose_trades
from barloom.operators.metrics import Sizing, full_metrics

HITS = "formula_id int, series_id string, bar_idx long, _reward double, _exit long, _label boolean, _risk double"


def made(rng, formulas, series, n, hold):
    out = []
    for f in range(formulas):
        for s in series:
            bars = np.flatnonzero(rng.random(n) < 0.4 / (f + 1))
            exits = bars + rng.geometric(1 / hold, len(bars)) - 1
            rr = np.round(np.where(rng.random(len(bars)) < 0.1, 0.0, rng.normal(0.1, 1, len(bars))), 3)
            out += [(f, s, int(b), float(r), None if rng.random() < 0.03 else int(e), bool(r > 0), 1.0) for b, r, e in zip(bars, rr, exits)]
    return out


def plain(rows):
    out, free = [], -1
    for r in sorted(rows, key=lambda r: r[2]):
        if r[2] >= free:
            out.append(r)
            free = max(r[4] if r[4] is not None else -1, r[2] + 1)
    return out


@pytest.fixture(scope="module")
def hits(spark):
    rows = made(np.random.default_rng(1), 3, ["a", "b", None], 500, 9)
    return rows, spark.createDataFrame(rows, HITS).repartition(4)


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_trades_do_not_overlap(hits, size):
    rows, df = hits
    want = {r[:3] for f in range(3) for s in ("a", "b", None) for r in plain([x for x in rows if x[0] == f and x[1] == s])}
    assert {(r.formula_id, r.series_id, r.bar_idx) for r in trades.choose(df, ["formula_id"], size).collect()} == want


def test_a_million_hits_over_sixteen_parts(spark):
    rng = np.random.default_rng(2)
    n = 1_000_000
    exits = np.arange(n) + rng.integers(0, 30, n)
    df = spark.createDataFrame([(1,)], "formula_id int").crossJoin(spark.range(n).withColumnRenamed("id", "bar_idx"))
    df = df.selectExpr("formula_id", "'s' AS series_id", "bar_idx", "bar_idx + pmod(xxhash64(bar_idx), 30) AS _exit")
    got = np.array(sorted(r.bar_idx for r in trades.choose(df, ["formula_id"], n // 16 + 1).select("bar_idx").collect()))
    own = df.toPandas().sort_values("bar_idx")
    exits = own["_exit"].to_numpy()
    took = choose_trades(np.zeros(n, np.int64), np.arange(n), 1, n, exits)
    assert np.array_equal(got, np.flatnonzero(took))


def test_steps_follow_every_chain():
    rng = np.random.default_rng(3)
    for _ in range(200):
        bars = np.flatnonzero(rng.random(40) < 0.5) + 100
        if not len(bars):
            continue
        free = bars + rng.integers(0, 12, len(bars))
        then = np.maximum(np.searchsorted(bars, free), np.arange(1, len(bars) + 1))
        at, to = trades.steps(bars, free, then)
        for f in range(98, 142):
            i, end = int(np.searchsorted(bars, f)), f
            chain = []
            while i < len(bars):
                chain.append(i)
                end, i = max(free[i], bars[i] + 1), then[i]
            k = int(np.searchsorted(at, f))
            assert (int(to[k]) if k < len(at) else f) == end
            assert trades.reached(then, int(np.searchsorted(bars, f))).tolist() == chain


@pytest.mark.parametrize("size,sizing", [(7, Sizing()), (50, Sizing(risk_pct=2.5, years=3.0)), (10_000, Sizing(capital=0.0, dollars_per_r=5.0))])
def test_metrics_equal_one_pass(hits, size, sizing):
    rows, df = hits
    got = {r.formula_id: r.asDict() for r in trades.scored(df, ["formula_id"], sizing, size).collect()}
    assert len(got) == 3
    for f, g in got.items():
        own = sorted((r for r in rows if r[0] == f), key=lambda r: (r[1] is None, r[1] or "", r[2]))
        want = full_metrics(np.array([r[3] for r in own]), sizing)
        assert g["trades"] == len(own) and g["label_hits"] == sum(r[5] for r in own)
        for k, v in want.items():
            assert g[k] == v if isinstance(v, str) else np.isclose(g[k], v, rtol=1e-9, atol=1e-9), (k, g[k], v)


def test_runs_over_edges_and_ruin(spark):
    """A run that begins in one part and ends in a later one; capital that is lost; one trade; all zero."""
    cases = [[1.0] * 30, [1.0, -1.0] * 8 + [-1.0] * 9 + [1.0], [-100.0, 1.0, -100.0, 2.0], [0.5], [0.0] * 12, [-1.0] * 25]
    rows = [(f, "s", i, float(r), None, r > 0, 1.0) for f, rr in enumerate(cases) for i, r in enumerate(rr)]
    got = {r.formula_id: r.asDict() for r in trades.scored(spark.createDataFrame(rows, HITS), ["formula_id"], Sizing(risk_pct=1.5), 4).collect()}
    for f, rr in enumerate(cases):
        for k, v in full_metrics(np.array(rr), Sizing(risk_pct=1.5)).items():
            assert got[f][k] == v if isinstance(v, str) else np.isclose(got[f][k], v, rtol=1e-9, atol=1e-9), (f, k, got[f][k], v)
