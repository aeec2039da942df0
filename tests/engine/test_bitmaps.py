"""Masks in blocks give what masks in one piece give; lanes, early rejection, contracts."""

import math

import numpy as np
import pytest

from barloom.operators import bitmaps, catalog, combine
from barloom.operators.metrics import Sizing

BARS = "series_id string, bar_idx long, f0 boolean, f1 boolean, f2 boolean, f3 boolean, f4 boolean, x double, t boolean, rr_t double, t_eligible boolean, t_exit_i long, dollars double"
NAMES = ["f0", "f1", "f2", "f3", "f4"]


def rows(name, n, seed):
    rng = np.random.default_rng(seed)
    flags = rng.random((n, 5)) < np.array([0.5, 0.5, 0.4, 0.3, 0.02])
    rr = np.round(rng.normal(0.05, 1, n), 3)
    return [(name, i, *map(bool, flags[i]), float(rng.random()), bool(rr[i] > 0), float(rr[i]) if rng.random() < 0.95 else float("nan"), bool(rng.random() < 0.8), min(i + int(rng.integers(0, 9)), n - 1), float(100 + 900 * rng.random())) for i in range(n)]


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame(rows("a", 700, 1), BARS).repartition(3).cache()


def predicates():
    return [catalog.Predicate(x, x) for x in NAMES] + [catalog.Predicate(f"x>{v}", "x", ">", v) for v in (0.2, 0.6)] + [catalog.Predicate("x<0.8", "x", "<", 0.8)]


def table(df):
    return {r.combination: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("stacking,size,least,sizing", [(True, 64, 1, Sizing()), (False, 100, 1, Sizing(years=2.0)), (False, 50, 60, Sizing()), (False, 130, 5, Sizing(contracts=True, margin=9_000.0, most=7, risk_pct=2.0)), (True, 1_000, 1, Sizing(capital=0.0))])
def test_blocks_equal_one_piece(spark, one, stacking, size, least, sizing):
    cols = combine.trade_columns("t", cost=0.01)
    if sizing.contracts:
        from pyspark.sql import functions as F

        cols["_risk"] = F.col("dollars")
    want = table(combine.evaluate(spark, combine.prepare(one, predicates(), cols), 3, least, stacking=stacking, sizing=sizing))
    got = table(bitmaps.evaluate(one, predicates(), cols, 3, least, stacking=stacking, sizing=sizing, size=size, lane=20))
    assert want.keys() == got.keys() and len(got) > (20 if least < 60 else 3)
    for k, w in want.items():
        for c, v in w.items():
            assert (math.isclose(got[k][c], v, rel_tol=1e-9, abs_tol=1e-9) if isinstance(v, float) else got[k][c] == v), (k, c, v, got[k][c])


def test_ranges_of_numbers_and_required_features(spark, one):
    cols = combine.trade_columns("t")
    whole = table(bitmaps.evaluate(one, predicates(), cols, 2, size=64))
    n = combine.total(8, 2)
    parts = [table(bitmaps.evaluate(one, predicates(), cols, 2, start=a, stop=a + 7, size=64)) for a in range(0, n, 7)]
    assert sum(len(p) for p in parts) == len(whole) and {k: v for p in parts for k, v in p.items()} == whole
    only = table(bitmaps.evaluate(one, predicates(), cols, 2, required=["f2"], size=64))
    assert only == {k: v for k, v in whole.items() if "f2" in k.split(" && ")}
    with pytest.raises(ValueError, match="not in the catalog"):
        bitmaps.evaluate(one, predicates(), cols, 2, required=["nope"])
    assert bitmaps.evaluate(one.limit(0), predicates(), cols, 2).count() == 0 and bitmaps.evaluate(one, predicates(), cols, 2, start=5, stop=5).count() == 0


def test_series_do_not_block_each_other(spark):
    data = [*rows("a", 150, 2), *rows(None, 90, 3), *rows("b", 200, 4)]
    got = table(bitmaps.evaluate(spark.createDataFrame(data, BARS), [catalog.Predicate("f0", "f0")], combine.trade_columns("t"), 1, size=32))
    n, free, before = 0, -1, "first"
    for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if r[0] != before:
            before, free = r[0], -1
        if r[2] and r[10] and not math.isnan(r[9]) and r[1] >= free:
            n, free = n + 1, max(r[11], r[1] + 1)
    assert got["f0"]["trades"] == n


def test_blocks_hold_a_bounded_share(one):
    got = bitmaps.blocks(one, predicates(), combine.trade_columns("t"), 64).collect()
    assert len(got) == 11 and max(len(r.words) for r in got) == 8 * 8 and sum(r.support[0] for r in got) == one.where("f0").count()


def test_dead_beginnings_are_never_made():
    import itertools

    rng = np.random.default_rng(8)
    for n, k, share in ((7, 3, 0.3), (9, 4, 0.5), (6, 1, 0.5), (12, 2, 0.9), (8, 5, 0.0)):
        dead = np.triu(rng.random((n, n)) < share, 1)
        every = list(itertools.combinations(range(n), k))
        want = [(i, c) for i, c in enumerate(every) if not any(dead[a, b] for a, b in itertools.combinations(c, 2))]
        for low, high in ((0, len(every)), (3, len(every) - 2), (len(every) // 3, len(every) // 2), (5, 5)):
            number, combos, _ = combine.unrank_live(low, high, n, k, dead)
            assert list(zip(number.tolist(), map(tuple, combos.tolist()))) == [x for x in want if low <= x[0] < high]
    dead = np.triu(np.ones((60, 60), bool), 1)
    dead[:8, :8] = False
    number, _, seen = combine.unrank_live(0, math.comb(60, 4), 60, 4, dead)
    assert len(number) == math.comb(8, 4) and seen < math.comb(60, 4) / 20


def test_pruned_search_equals_the_whole(spark, one, tmp_path):
    cols, names = combine.trade_columns("t"), [p.name for p in predicates()]
    dead = combine.dead_matrix(names, combine.evaluate_pairs(one, predicates(), cols), 60)
    assert 0 < dead.sum() < 28
    got = table(bitmaps.evaluate(one, predicates(), cols, 3, 60, size=128, dead=dead))
    assert got == table(bitmaps.evaluate(one, predicates(), cols, 3, 60, size=128)) and got
    from barloom.operators.store import ResultStore

    s = ResultStore(spark, str(tmp_path / "s"))
    s.keep_dead("i", "h", names, dead)
    assert np.array_equal(s.dead("i", "h", names), dead) and s.dead("i", "other", names) is None and s.dead("i", "h", names[:3]) is None
