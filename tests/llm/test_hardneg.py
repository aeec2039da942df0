"""Hard negatives against brute force; zone maps read part of the blocks; large numbers; odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def brute(rows, every=50):
    """Of (vec_id, vector, label), all of one length."""
    rows = [(i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for i, q, label in rows:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, r)), j, label == other) for j, r, other in rows if j != i]
        for s, j, _ in sorted((x for x in scored if x[2]), key=lambda x: (-x[0], x[1]))[:5]:
            hard = sorted((x for x in scored if not x[2] and 50 * s <= 100 * x[0] <= 95 * s), key=lambda x: (-x[0], x[1]))[:3]
            out += [(i, j, k + 1, n, s, t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], SCHEMA)


def mined(df):
    return sorted(tuple(r) for r in hardneg.of_embeddings(df).collect())


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (5, 2), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij"), -1).reshape(-1, n)
        place = hardneg.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    points, anchors = rng.integers(-9, 9, (50, 7)), rng.integers(-9, 9, (20, 7))
    low, high = hardneg._bounds(anchors, points.min(0)[None], points.max(0)[None])
    s = anchors @ points.T
    assert (low[:, 0] <= s.min(1)).all() and (s.max(1) <= high[:, 0]).all()


@pytest.mark.parametrize("block", [2_048, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    """Clusters, many equal vectors, ties; several blocks, lots and pages."""
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "LOT", 3)
    monkeypatch.setattr(hardneg, "PAGE", 4)
    rng = np.random.default_rng(block)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2, 8)).tolist(), int(rng.integers(0, 10))) for i in range(360)]
    rows += [(400 + i, [0.5] * 8, i % 3) for i in range(160)]
    assert mined(frame(spark, rows).repartition(5)) == brute(rows)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 3, (40, 6))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.02, 6)).tolist(), i % 40 % 10) for i in range(2_000)]
    read, found = [], hardneg._found

    def counted(visits, *rest):
        read.append(visits.select(F.explode("wanted")).count())
        return found(visits, *rest)

    monkeypatch.setattr(hardneg, "_found", counted)
    got = hardneg.of_embeddings(frame(spark, rows)).count()
    # four calls: seeds and the rest, of positives and of windows; all blocks for all wishes would be 40 x 63 and 40 x 5 x 63
    assert got > 100 and sum(read[:2]) < 40 * 63 / 3 and sum(read[2:]) < 40 * 5 * 63 / 2


@pytest.mark.parametrize("scale", [1e3, 1e6])
def test_large_numbers_stay_exact(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, (scale * (1 + rng.random(4))).tolist(), i % 4) for i in range(120)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(9)
    rows = [(i, rng.random(4).tolist(), i % 2) for i in range(101)]
    odd = [(150, None, 1), (200, [1.0, None, 1.0, 1.0], 1), (250, [nan, 1.0, 1.0, 1.0], 1), (300, [inf, 1.0, 1.0, 1.0], 1), (350, [1.0] * 4, None), (None, [1.0] * 4, 1), (400, [1.0] * 3, 1), (450, [], 1)]
    assert mined(frame(spark, rows + odd)) == brute(rows)
    twice = [*rows, rows[3], rows[50]]
    assert mined(frame(spark, twice)) == brute(twice)
    assert mined(frame(spark, rows).limit(0)) == [] and mined(frame(spark, [(50, [1.0], 1)])) == []
    negative = [(0, [-1.0, 0.5], 1), (50, [1.0, -0.5], 2), (1, [1.0, -0.5], 2), (2, [1.0, -0.5], 1), (3, [0.5, 1.0], 2)]
    assert mined(frame(spark, negative)) == brute(negative)
