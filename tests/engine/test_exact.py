"""Equal masks are told by their rows, quantiles by places, at any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import catalog, combine, order


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, bool(rng.random() < 0.5), float(rng.normal()), float(rng.integers(0, 4)), float("nan") if rng.random() < 0.1 else float(rng.exponential()), None) for i in range(6_000)]
    return spark.createDataFrame(rows, "series_id string, bar_idx long, f boolean, a double, ties double, gaps double, none double").withColumns({"g": F.col("f"), "h": ~F.col("f"), "x": F.col("a") + 0.0}).cache()


def test_a_collision_keeps_both(wide, monkeypatch):
    """With one hash for all, only predicates that hold on the same rows are dropped, flags and comparisons apart."""
    found = catalog.supports
    monkeypatch.setattr(catalog, "supports", lambda *a: {k: (100, 100, 7) for k in found(*a)})
    preds = [catalog.Predicate(n, n) for n in "fgh"] + [catalog.Predicate("a>0", "a", ">", 0.0), catalog.Predicate("x>0", "x", ">", 0.0), catalog.Predicate("a>1", "a", ">", 1.0), catalog.Predicate("ties>1", "ties", ">", 1.0), catalog.Predicate("ties>1.5", "ties", ">", 1.5)]
    assert [p.name for p in catalog.prune(wide, preds)] == ["f", "h", "a>0", "a>1", "ties>1"]


def test_flags_and_comparisons_do_not_displace_each_other(spark):
    df = spark.createDataFrame([("s", i, i % 3 == 0, float(i % 3)) for i in range(30)], "series_id string, bar_idx long, f boolean, v double")
    assert [p.name for p in catalog.prune(df, [catalog.Predicate("f", "f"), catalog.Predicate("v<0.5", "v", "<", 0.5), catalog.Predicate("v<=0", "v", "<=", 0.0)])] == ["f", "v<0.5"]


@pytest.mark.parametrize("reach", [0.0005, -0.2])
def test_quantiles_by_brackets(wide, monkeypatch, reach):
    """Also where a bracket misses its place and has to be opened."""
    monkeypatch.setattr(order, "REACH", reach)
    names = ["a", "ties", "gaps", "none"]
    want = catalog.percentiles(wide, names)
    got = catalog.percentiles(wide, names, most=10)
    assert got.keys() == want.keys() == {"a", "ties", "gaps"}
    for k in want:
        assert got[k][0] == want[k][0] and all(math.isclose(x, y, rel_tol=1e-14) for x, y in zip(got[k][1:], want[k][1:]))


def test_totals_by_depth(spark):
    df = spark.createDataFrame([(1,), (5,), (60,)], "n long")
    got = {(r.n, r.depth): (int(r.combinations), int(r.total)) for r in combine.totals(df, 6).collect()}
    assert got == {(n, k): (math.comb(n, k), combine.total(n, k)) for n in (1, 5, 60) for k in range(1, 7)}
