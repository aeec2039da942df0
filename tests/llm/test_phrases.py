"""Phrases against a plain count of all n-grams; paths of the graph; texts in several parts; odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import phrases

ROWS = "doc_id long, text string, lang string, rank int, n string"


def plain(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for g, a in f.items():
        if len(g) < 3 or a < least:
            continue
        if len(g) == 3 and any(len(x) == 4 and x[0] == g[0] and b >= least and g[1:] in (x[1:3], x[2:]) and 100 * b >= 50 * a for x, b in f.items()):
            continue
        s, k, l, r = min((1_000_000 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1))
        out.setdefault(g[0], []).append((-s, -a, " ".join(g[1:]).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def mined(docs, **k):
    return {tuple(r) for r in phrases.mine(docs, **k).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["the", "The", "of", "Ä", "x", "new", "york", "city", "a.b", "c,d", "\t", "e\n", "f!", "é", "zz\x00"]
    texts = [" ".join(words[i] for i in rng.zipf(1.4, n) % len(words)) for n in rng.integers(0, 60, 120)]
    long = "big apple pie is good. " * 15 + "big apple tart " * 30
    return [*[(("en", "de", None)[i % 3], t) for i, t in enumerate(texts)], ("en", long), ("fr", None), ("fr", ""), ("fr", " . , "), ("und", "the the the the " * 6), ("en", "the of " * 12), ("en", "the of " * 12)]


@pytest.mark.parametrize("chunk", [3 << 20, 64])
def test_equals_a_plain_count(spark, rows, monkeypatch, chunk):
    """Also where a part ends within a piece."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], ROWS).repartition(3)
    got = mined(docs)
    assert got == plain(rows) and {r[0] for r in got} == {"en", "de", "und"}
    assert mined(docs, top=3) == plain(rows, top=3)


def test_parts_share_no_state_with_their_chunk_size(monkeypatch):
    text = b"a b c. d e, f " * 40
    whole = b" ".join(phrases._parts(iter([text, b"", b"q r"]))).split()
    monkeypatch.setattr(phrases, "CHUNK", 16)
    parts = list(phrases._parts(iter([text, b"", b"q r"])))
    assert len(parts) > 20 and b" ".join(parts).split() == whole


def test_paths_hold_every_edge_once():
    rng = np.random.default_rng(2)
    for words in (3, 6, 40, 500):
        ids = rng.integers(1, words, 400)
        e = Counter(zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist()))
        a, b, c = np.array(list(e)).T
        n = np.array(list(e.values()))
        order, begins = phrases.compacted(a, b, c, n)
        assert sorted(order.tolist()) == list(range(len(e)))
        for s, t in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
            for i, j in zip(order[s : t - 1].tolist(), order[s + 1 : t].tolist()):
                assert (b[i], c[i]) == (a[j], b[j]) and n[i] == n[j]
        if words == 500:
            assert len(begins) < len(e) / 3


def test_a_circle_is_cut_once():
    order, begins = phrases.compacted(np.array([1, 2, 3]), np.array([2, 3, 1]), np.array([3, 1, 2]), np.array([4, 4, 4]))
    assert order.tolist() == [0, 1, 2] and begins.tolist() == [0]
    order, begins = phrases.compacted(np.array([1]), np.array([1]), np.array([1]), np.array([9]))
    assert order.tolist() == [0] and begins.tolist() == [0]


def test_flow_gives_every_count(spark):
    """A full bitmap keeps all edges: sums over them are the counts of pairs and words."""
    text = "a b c a b d. a b a. c"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    from barloom.llm.common import Tables

    with Tables(spark) as t:
        e = Counter({r.phrase: r.n for r in phrases.edges(docs, t, least=1).collect()})
    flow = Counter()
    for p, n in e.items():
        flow[" ".join(p.split()[:2])] += n
    assert {p: n for p, n in flow.items() if " " in p} == {"a b": 3, "b c": 1, "c a": 1, "b d": 1, "b a": 1} and sum(e.values()) == 10


def test_large_counts_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mined(docs) == set()
    assert spark.sql("SELECT CAST(3000000000000 AS DECIMAL(19,0)) * CAST(3000000000000 AS DECIMAL(19,0)) * CAST(1000000 AS DECIMAL(7,0)) div (CAST(9000000000001 AS DECIMAL(19,0)) * CAST(3000000000007 AS DECIMAL(19,0))) AS x").first().x == 1_000_000 * 3_000_000_000_000**2 // (9_000_000_000_001 * 3_000_000_000_007)
