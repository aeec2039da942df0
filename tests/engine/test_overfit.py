"""The matrix form of backtest overfitting against a plain count, with ties and missing blocks."""

import itertools

import numpy as np
import pytest

from barloom.operators import selection


def plain(rows, n):
    by = {}
    for f, b, m in rows:
        by.setdefault(f, [0.0] * n)[b] += m
    out = []
    for i, s in enumerate(itertools.combinations(range(n), n // 2)):
        inside = {f: sum(v[k] for k in range(n) if k in s) for f, v in by.items()}
        outside = {f: sum(v[k] for k in range(n) if k not in s) for f, v in by.items()}
        f = min(by, key=lambda x: (-inside[x], x))
        rank = 1 + sum(outside[g] > outside[f] or (outside[g] == outside[f] and g < f) for g in by)
        out.append((i, f, inside[f], outside[f], rank))
    return out


@pytest.mark.parametrize("tile,formulas", [(256, 40), (3, 40), (5, 1)])
def test_equals_a_plain_count(spark, monkeypatch, tile, formulas):
    monkeypatch.setattr(selection, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows = [(f"f{i % 31:02d}", b, float(rng.integers(-4, 5))) for i in range(formulas) for b in range(6) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "formula string, block int, metric double").repartition(4)
    got = sorted((r.split, r.formula, r.train_metric, r.test_metric, r.test_rank) for r in selection.backtest_overfitting(df, 6).collect())
    assert got == plain(rows, 6)


def test_no_split_and_no_formula(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "formula string, block int, metric double")
    assert selection.backtest_overfitting(df, 5).count() == 0 and selection.backtest_overfitting(df.limit(0), 4).count() == 0
