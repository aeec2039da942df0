"""Near-duplicate classes against brute force: no candidate link is lost, recall by similarity, identity of texts, odd rows."""

import time
import uuid

import numpy as np
import pyarrow as pa

from barloom.llm import omh
from barloom.llm.common import Tables, marks
from barloom.llm.components import components, joined, with_least

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string"


def docs_of(spark, *rows):
    rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], DOCS)


def classes(docs):
    return {r.doc_id: r.class_id for r in omh.near_duplicates(docs).collect()}


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_classes(texts, candidate):
    """The smallest id of each id's component of similar candidate pairs; ``texts``: id to words."""
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if find(i) != find(j) and candidate(i, j) and omh.similar(texts[i], texts[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_edit_distance_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a = rng.integers(1, 6, rng.integers(0, 30)).astype(np.uint64)
        b = np.array([x for x in a if rng.random() > 0.15] + rng.integers(1, 6, rng.integers(0, 5)).tolist(), np.uint64)
        limit, d = int(rng.integers(0, 14)), brute_edit(a.tolist(), b.tolist())
        assert omh.edit_distance(a, b, limit) == min(d, limit + 1)
        if len(a) and len(b) and abs(len(a) - len(b)) <= limit:
            assert omh._edit_diagonals(a, b, limit) == min(d, limit + 1)
            assert omh.similar(a, b) == (d <= int(np.floor(0.2 * max(len(a), len(b)) + 1e-9)))


def test_texts_of_any_length_are_aligned():
    """Few different words, so that no alignment along unique words helps; edits of all kinds, the length stays near."""
    rng = np.random.default_rng(2)

    def edited(a, share):
        out = []
        for w, x in zip(a.tolist(), rng.random(len(a)).tolist()):
            if x >= share / 3:
                out.append(w if x >= 2 * share / 3 else 5000)
                if x >= 1 - share / 3:
                    out.append(5001)
        return np.array(out, np.uint64)

    a = rng.integers(0, 5000, 160_000).astype(np.uint64)
    began = time.time()
    assert omh.similar(a, edited(a, 0.04)) and not omh.similar(a, np.roll(a[::-1], 7))
    assert time.time() - began < 60
    a = np.tile(np.arange(50, dtype=np.uint64), 2000)  # long runs that agree on many diagonals
    assert omh.similar(a, edited(a, 0.1)) and omh.similar(a, a[:90_000]) and not omh.similar(a, np.sort(a))


def test_classes_join_what_brute_force_joins(spark):
    """Among 200 documents with planted copies and shared passages: exactly the components of similar pairs that share a sketch."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(60))
    extra = []
    for i in range(120):  # a shared passage and 12 % other words: buckets whose leaders are dissimilar to most members
        base = [f"b{i // 2}x{k}" for k in range(140)]
        for at in rng.choice(140, 16 if i % 2 else 0, replace=False):
            base[at] = f"e{i}y{at}"
        extra.append((10_000 + i, " ".join(base[:70]) + " " + passage + " " + " ".join(base[70:])))
    rows = rows.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = classes(rows)
    texts = {r.doc_id: omh.word_ids(r.text) for r in rows.collect()}
    assert sorted(got) == sorted(texts)
    said = {i: w for i, w in texts.items() if len(w)}
    sk = {i: set(omh.sketch(w).tolist()) for i, w in said.items()}
    want = brute_classes(said, lambda i, j: not sk[i].isdisjoint(sk[j]) or np.array_equal(said[i], said[j]))
    assert {i: got[i] for i in said} == want and all(got[i] == i for i in texts if i not in said)
    # five-word shingles: nothing of a similarity of 0.8 is missed
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, w.tolist()) for i, w in said.items())}
    for i in said:
        for j in said:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert got[i] == got[j]


def test_recall_by_similarity():
    """Pairs of texts whose words are replaced independently, up to the least similarity that is accepted."""
    rng = np.random.default_rng(8)
    for share, least in ((0.1, 0.995), (0.15, 0.98), (0.2, 0.9)):
        hit = of = 0
        for _ in range(400):
            n = int(rng.integers(5, 600))
            a = rng.integers(0, 1 << 60, n).astype(np.uint64)
            b = a.copy()
            at = rng.choice(n, int(n * share), replace=False)
            b[at] = rng.integers(0, 1 << 60, len(at)).astype(np.uint64)
            if omh.similar(a, b):
                of += 1
                hit += bool(set(omh.sketch(a).tolist()) & set(omh.sketch(b).tolist()))
        assert of > 350 and hit >= least * of, (share, hit, of)


def test_kinds_overlap_where_lengths_allow_it():
    for n in range(1, 300):
        for m in range(n, 300):
            if n >= omh.SIMILAR * m:
                assert set(omh.kinds_of(n)) & set(omh.kinds_of(m))
    assert omh.kinds_of(500) == [5]


def test_repeated_and_null_ids(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    near, close = base.replace("w30", "zz"), other.replace("v30", "zz")
    # document 1 has two texts; 2 is near the first, 3 near the second, whichever comes first
    for first, second in ((base, other), (other, base)):
        got = classes(docs_of(spark, (1, first), (1, second), (2, near), (3, close), (4, "something else")))
        assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    rows = omh.near_duplicates(docs_of(spark, (None, base), (None, near), (5, base), (5, base), (6, None), (7, ""), (8, "..."))).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_words) for r in rows) == [(0, 0, 60), (0, 0, 60), (5, 5, 60), (6, 6, 0), (7, 7, 0), (8, 8, 0)]
    kept = omh.keep_one(docs_of(spark, (None, base), (None, near), (5, base), (9, near), (6, None))).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 5, 6]


def test_odd_input(spark):
    empty = spark.createDataFrame([], DOCS)
    assert omh.near_duplicates(empty).count() == 0 and omh.keep_one(empty).count() == 0
    long = "word " * 30_000
    got = classes(docs_of(spark, (3, "a"), (3, "a"), (4, long), (5, long + "end"), (6, "b"), (7, "B!")))
    assert got == {3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
    base = " ".join(f"w{i}" for i in range(60))
    d = docs_of(spark, base, base.replace("w30", "zz"), base, "other text here", base.upper())
    assert omh.keep_one(d).columns == d.columns and sorted(r.doc_id for r in omh.keep_one(d).collect()) == [0, 3]


def test_order_matters():
    words = [f"w{i}" for i in range(80)]
    a, b = omh.word_ids(" ".join(words)), omh.word_ids(" ".join(words[40:] + words[:40]))
    assert not omh.similar(a, b)
    assert (omh.sketch(a) == omh.sketch(b)).mean() < 0.8


def test_a_repeated_kmer_leaves_the_others_alone():
    once, twice = (omh.labelled_kmers(omh.word_ids(t), 2) for t in ("a b c d e f", "a b c d e f a b"))
    assert set(once.tolist()) < set(twice.tolist())


def test_buckets_are_searched_until_no_pair_is_open(spark, monkeypatch):
    for tile in (1000, 2):
        monkeypatch.setattr(omh, "TILE", tile)
        met = spark.createDataFrame([(1, i, 1) for i in (1, 2, 3, 4, 5, 6)] + [(2, 8, 8), (2, 9, 8)], "bucket long, id long, lead long")
        top = spark.createDataFrame([(6, 1)], "id long, comp long")
        words = {i: omh.word_ids("a b c d e f g h i j") for i in (1, 2, 3, 5, 6, 8, 9)} | {4: omh.word_ids("p q r s t u v w x y")}
        reps = spark.createDataFrame([(i, len(w), bytearray(omh.bag(w))) for i, w in words.items()], "id long, n int, bag binary")
        done = spark.createDataFrame([(2, 5)], "lead long, id long")
        with Tables(spark) as tables:
            got = sorted((r.lead, r.id) for r in omh._across(met, top, reps, done, tables).collect())
        assert got == [(2, 3), (2, 6), (3, 5), (3, 6), (5, 6)]


def test_buckets_of_one_class_give_no_pairs(spark):
    met = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 4, 1), (3, 5, 5), (3, 6, 5)], "bucket long, id long, lead long")
    top = spark.createDataFrame([(2, 1), (3, 1), (6, 5)], "id long, comp long")
    with Tables(spark) as tables:
        assert sorted(map(tuple, omh._mixed(met, top, tables).collect())) == [(2, 1, 1), (2, 4, 1)]


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)] + [(500, 501 + i) for i in range(300)], "u long, v long")
    with Tables(spark) as tables:
        got = {r.u: r.v for r in components(links, tables).collect()}
        assert components(links.limit(0), tables).count() == 0
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100, **{501 + i: 500 for i in range(300)}}


def test_hot_keys_are_dealt_out(spark):
    rows = spark.createDataFrame([(1, i) for i in range(1000, 2000)] + [(2, 5), (3, 7), (3, 6)], "k long, v long")
    with Tables(spark) as tables:
        got = {(r.k, r.v): r.m for r in with_least(rows, "k", "v", "m", tables).collect()}
        few = with_least(rows, "k", "v", "m", tables, above=1).where("k = 2").count()
    assert few == 0 and len(got) == 1003 and got[1, 1500] == 1000 and got[2, 5] == 5 and got[3, 7] == 6


def test_a_pair_of_many_buckets_is_made_once():
    """Two tasks that hold the same texts in two buckets give each open pair once, whichever class is the largest."""
    names = ["bucket", "l", "r", "side", "id", "lead", "comp", "n", "bag", "earlier"]
    bag = omh.bag(omh.word_ids("a b c d e f g h i j"))
    got = []
    for bucket, earlier in ((5, [3]), (7, [3, 5])):
        # 1 leads; 2 and 3 are the largest class; 4 shares an earlier bucket with nobody
        rows = [(bucket, 0, 0, side, i, 1, comp, 10, bag, [x for x in earlier if x != 3 or i == 2]) for i, side, comp in ((1, 7, 1), (2, 1, 2), (3, 1, 2), (4, 7, 4), (6, 7, 6))]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 8 + [pa.binary(), pa.list_(pa.int64())])], names)
        got += [r for b in omh._open_pairs(iter([batch])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(got) == [(2, 4), (2, 6), (3, 4), (3, 6), (4, 6)]


def test_meetings_are_the_buckets_of_several(spark):
    rng = np.random.default_rng(9)
    sk = {i: [int(x) for x in rng.choice(rng.integers(-(1 << 63), 1 << 63, 5).tolist() + [7, 8, -9], 6)] for i in range(60)}
    sk = {i: sorted(set(x)) for i, x in sk.items()}
    by = {}
    for i, x in sk.items():
        for b in x:
            by.setdefault(b, []).append(i)
    with Tables(spark) as tables:
        got = sorted(map(tuple, omh._meetings(spark.createDataFrame(list(sk.items()), "id long, sk array<long>"), tables).collect()))
    assert got == sorted((b, i, min(x)) for b, x in by.items() if len(x) > 1 for i in x)


def jobs(spark, f):
    """What f() gives, and how many jobs it ran."""
    group = f"count-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = f()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_bitmap_takes_as_many_jobs_whatever_the_partitions(spark):
    ids = [int(x) for x in np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 500)]
    took = set()
    for n in ("3", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            (bits, shared), of = jobs(spark, lambda: marks(spark.createDataFrame([(i,) for i in ids], "id long")))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        took.add(of)
        at = np.array(ids, np.int64).view(np.uint64) >> np.uint64(64 - bits)
        assert set(np.flatnonzero(np.unpackbits(shared.value, bitorder="little")).tolist()) == set(at.tolist())
    assert len(took) == 1


def test_no_more_links_leave_the_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    with Tables(spark) as tables:
        top = components(links, tables)
        assert joined(top, links.limit(0), tables) is top and sorted(map(tuple, joined(top, spark.createDataFrame([(5, 3)], "u long, v long"), tables).collect())) == [(2, 1), (3, 1), (5, 1)]
        assert omh._verify(links.toDF("lead", "id").limit(0), None, tables).collect() == []
