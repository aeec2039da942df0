"""Decontamination: names, edits, partial quotes, against brute force, odd rows."""

import random
import time
from collections import defaultdict

import numpy as np

from barloom.llm import decontam as D

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, uid string, h int"
ITEMS = "item_id long, text string"
ANNA = "Anna paid 3 dollars for 3 apples and then walked home to meet her brother Tom near the bridge."


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t, "u", 1) for i, t in enumerate(texts)], DOCS)


def items_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), ITEMS)


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in D.leaks(docs_of(spark, *docs), items_of(spark, *items)).collect()}


def plain_leak(doc, item):
    """Whether a text leaks an item, by comparing every window with every window and every stretch with the rule."""
    ids, slot, value = D.canonical(item)
    there, _, put = D.canonical(doc)
    if not len(ids):
        return False
    size, of = D.window_size(len(ids)), len(ids)
    hits = [(p, q) for p in range(len(there) - size + 1) for q in range(of - size + 1) if there[p : p + size].tolist() == ids[q : q + size].tolist()]

    def covers(hits):
        best, who = set(), []
        for a in range(len(hits)):
            for b in range(a + 1, len(hits) + 1):
                if hits[b - 1][0] + size - hits[a][0] <= 2 * of + D.SLACK:
                    some = {q + i for _, q in hits[a:b] for i in range(size)}
                    if len(some) > len(best):
                        best, who = some, hits[a:b]
        run = max((len(r) for r in "".join("x" if i in best else " " for i in range(of)).split()), default=0)
        return (len(best) >= D.COVER * of or run >= D.RUN), who

    said, who = covers(hits)
    pairs = {}
    ok = True
    for p, q in who:
        for i in range(size):
            if slot[q + i]:
                ok &= pairs.setdefault(int(value[q + i]), int(put[p + i])) == int(put[p + i])
    if not ok:
        said, _ = covers([(p, q) for p, q in hits if all(value[q + i] == put[p + i] for i in range(size) if slot[q + i])])
    return said


def test_leaks(spark):
    items = [ANNA, None, "", "short item only"]
    docs = [f"Intro text. {ANNA} End.", ANNA.replace("3", "7").replace("Tom", "Max"), "Anna paid 7 dollars for 8 apples.", "nothing here", "this is a short item only, yes", None]
    got = found(spark, docs, items)
    assert set(got) == {(0, 1), (1, 1), (4, 4)}
    assert got[0, 1].n_changed == 0 and got[0, 1].coverage == 1 and got[1, 1].n_changed == 3
    d, b = docs_of(spark, *docs), items_of(spark, *items)
    assert sorted(r.doc_id for r in D.keep_clean(d, b).collect()) == [2, 3, 5] and D.keep_clean(d, b).columns == d.columns


def test_names_that_open_sentences(spark):
    item = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have?"
    docs = [item.replace("Tom", "Anna"), item.replace("Tom", "Mary Jane"), item.replace("3", "8").replace("Tom", "NASA"), "Anna has 4 apples. Ben buys 6 more. How many apples does Carl have?", item.upper()]
    got = found(spark, docs, [item])
    assert {(i, 1) for i in range(3)} <= set(got) and (3, 1) not in got
    assert D.canonical(item.upper())[1].sum() == 2  # capitals mark no names in such a text
    assert D.canonical("The dog of Tom Brown barks. The cat sleeps.")[1].sum() == 1


def test_edits_partial_quotes_and_insertions(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    short, middle, long = words[:16], words[30:52], words
    changed = list(middle)
    changed[11] = "other"
    cut = [*words[:45], *["inserted"] * 12, *words[45:100]]
    docs = [" ".join([*short[:8], "edit", *short[9:]]), " ".join(changed), " ".join(words[20:160]), " ".join(cut), " ".join(words[20:50])]
    got = found(spark, docs, [" ".join(short), " ".join(middle), " ".join(long), " ".join(words[:100])])
    assert (0, 1) in got and (1, 2) in got and (2, 3) in got and (3, 4) in got
    assert (4, 3) not in got  # 30 of 300 tokens in a row


def test_inconsistent_slots_count_only_exact_windows(spark):
    item = "there are 5 cats and 5 dogs and 5 birds in the big old house"
    got = found(spark, [item.replace("5", "9"), "there are 1 cats and 2 dogs and 3 birds in the big old house"], [item])
    assert set(got) == {(0, 1)}


def test_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if r.text and plain_leak(r.text[:20_000], t)}
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs.selectExpr("doc_id", "substring(text, 1, 20000) AS text"), bench).collect()}
    assert got == want and len(got) > 0


def test_against_brute_force_on_mutated_items(spark):
    rng = random.Random(11)
    vocab = "Tom Anna 3 7 12 apples dogs miles runs takes and the of with red blue ten Paris lake".split()
    items = [" ".join(rng.choices(vocab, k=rng.randrange(3, 40))) for _ in range(30)]
    docs = []
    for _ in range(150):
        w = rng.choice(items).split()
        w = [x if rng.random() > 0.12 else rng.choice(vocab) for x in w]
        docs.append(" ".join(rng.choices(vocab, k=rng.randrange(10)) + w[rng.randrange(3) :] + rng.choices(vocab, k=rng.randrange(10))))
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items, 1) if plain_leak(t, x)}
    assert set(found(spark, docs, items)) == want and len(want) > 80


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, ANNA), (3, ANNA), (3, ANNA), (3, "other"), (4, "word " * 30_000), (5, "...")]
    d = spark.createDataFrame([(i, t, "u", 1) for i, t in rows], DOCS)
    items = spark.createDataFrame([(9, ANNA), (9, ANNA), (None, ANNA), (8, None)], ITEMS)
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in D.leaks(d, items).collect())
    assert got == [(0, 0), (0, 9), (3, 0), (3, 9)]
    assert sorted((r.doc_id, r.text) for r in D.keep_clean(d, items).where("doc_id = 3").collect()) == [(3, "other")]
    none = items.limit(0)
    assert D.leaks(d, none).count() == 0 and D.keep_clean(d, none).count() == 8 and D.leaks(d.limit(0), items).count() == 0


def test_joined_removal_agrees(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a = {r.doc_id for r in D.keep_clean(docs, bench).collect()}
    monkeypatch.setattr(D, "BROADCAST", -1)
    assert a == {r.doc_id for r in D.keep_clean(docs, bench).collect()} and len(a) < docs.count()


def test_slots():
    ids, slot, value = D.canonical("Take 12 kg of it to Tom Brown, then to Tom.")
    assert slot.tolist() == [False, True, True, False, False, False, True, False, False, True] or slot.sum() == 5
    assert np.unique(ids[slot]).size == 3 and len(value) == len(ids)


def test_judge_takes_time_in_proportion_and_keeps_the_best_stretch():
    began = time.time()
    hit = lambda p, q: (p, q, [1] * 8, [1] * 8, [False] * 8)
    assert D.judge([hit(q, q) for q in range(300_000 - 7)], 300_000) == (1.0, 0, 0)
    assert time.time() - began < 20
    rng = random.Random(5)
    for _ in range(200):
        of = rng.randrange(8, 40)
        hits = sorted(hit(rng.randrange(400), rng.randrange(of - 7)) for _ in range(rng.randrange(1, 30)))
        want = (0, 0)
        for lo in range(len(hits)):
            for hi in range(lo + 1, len(hits) + 1):
                if hits[hi - 1][0] + 8 - hits[lo][0] <= 2 * of + D.SLACK:
                    held = {q + i for _, q, *_ in hits[lo:hi] for i in range(8)}
                    want = max(want, (len(held), 0))
        covered, run, low, high = D._best(hits, of)
        held = {q + i for _, q, *_ in hits[low:high] for i in range(8)}
        assert covered == want[0] == len(held)
        assert run == max(b - a for a in range(of) for b in range(a, of + 1) if set(range(a, b)) <= held)
