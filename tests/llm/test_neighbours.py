"""Nearest neighbours: recall against brute force with one shard and with many, ties, odd vectors."""

import collections

import numpy as np
import pytest

from barloom.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<double>"


def brute(data, every=N.EVERY, k=N.K):
    """query to its k nearest (vec_id, negative cosine), by dimension, ties to the smaller id."""
    out = {}
    for size in {len(v) for v in data.values()}:
        ids = np.array(sorted(i for i, v in data.items() if len(v) == size))
        v = np.stack([data[i] for i in ids])
        v = v / np.abs(v).max(axis=1)[:, None]
        v = v / np.sqrt((v * v).sum(axis=1))[:, None]
        for q in ids[ids % every == 0].tolist():
            cos = v @ v[np.searchsorted(ids, q)]
            out[q] = [(i, s) for s, i in sorted((-round(s, 12), i) for s, i in zip(cos.tolist(), ids.tolist()) if i != q)[:k]]
    return out


def found(spark, rows, schema=SCHEMA):
    got = collections.defaultdict(list)
    for r in N.nearest(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def recall(got, want):
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    for q in got:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    got = collections.defaultdict(list)
    for r in N.nearest(rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert recall(got, brute(data)) >= 0.9


@pytest.mark.parametrize("spread", [0.2, 10.0])
def test_recall_over_many_shards(spark, monkeypatch, spread):
    """Clustered and nearly isotropic vectors, dealt into some 30 cells, some of several shards."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    data = {i: centres[i % 20] * (3 if i % 3 else 1) + spread * rng.standard_normal(24) for i in range(4000)}
    monkeypatch.setattr(N, "SHARD", 128)
    monkeypatch.setattr(N, "SAMPLE", 1000)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "NEAR", 3)
    got = found(spark, [(i, v.tolist()) for i, v in data.items()])
    assert recall(got, brute(data)) >= (0.97 if spread < 1 else 0.9)


def test_clustered_vectors_verify_few_points():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 32))
    v = np.repeat(centres, 80, axis=0) + 0.05 * rng.standard_normal((16_000, 32))
    tree = N.Tree(np.arange(16_000), v)
    seen = [tree.search(i, v[i], 5)[1] for i in range(0, 16_000, 400)]
    assert np.mean(seen) < 0.25 * 16_000


def test_a_third_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 64)
    rng = np.random.default_rng(6)
    data = {i: rng.standard_normal(6) if i % 3 else np.array([1.0, 2, 3, 4, 5, 6]) for i in range(900)}
    got, want = found(spark, [(i, v.tolist()) for i, v in data.items()]), brute(data)
    assert all(got[q] == [(i, 1.0) for i in [x for x in (0, 3, 6, 9, 12, 15) if x != q][:5]] for q in want if q % 3 == 0)
    assert recall(got, want) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (100, [0.0, float("inf")]), (9, [1.0])]
    got = found(spark, rows, "vec_id long, embedding array<float>")
    assert got == {0: [(2, 1.0), (3, 1.0), (50, 1.0)], 50: [(0, 1.0), (2, 1.0), (3, 1.0)]}
    assert N.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert abs(N.chi_square(8.0) - 0.5665298796332909) < 1e-12


def test_huge_tiny_repeated_and_mixed_dimensions(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [5e-324, 0.0]), (50, [1e200, 2e200]), (7, [0.0, 3.0]), (7, [0.0, 3.0]), (7, [9.0, 3.0]), (100, [1.0, 0.0, 0.0]), (8, [1.0, 1.0, 0.0]), (150, [1.0])]
    rows = [(i, v, "n", 1, 2) for i, v in rows]
    got = found(spark, rows, SCHEMA + ", cell string, part int, rank int")
    data = {i: np.array(v) for i, v, *_ in rows if i != 7} | {7: np.array([0.0, 3.0])}
    want = {q: x for q, x in brute(data).items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(s + t) < 1e-9 for q in want for (_, s), (_, t) in zip(got[q], want[q]))
