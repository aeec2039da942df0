"""SimHash classes against brute force over all pairs, buckets that split, odd rows."""

import re

import numpy as np
import pytest
import xxhash

from barloom.llm import simhash
from barloom.llm.common import Tables

DOCS = "doc_id long, text string, fingerprint string, mask int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """The smallest place that each of ``fps`` is connected with."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_bit_by_bit():
    rng = np.random.default_rng(0)
    words = ["Über", "ÀB", "the", "THE", "a b", "x", "Y.", "\x1f", "z\x00"]
    for n in [0, 1, 2, 3, 4, 5, 50, 300]:
        text = "".join(words[i] + " \t\n\x0b\x0c\r"[j] * k for i, j, k in zip(rng.integers(0, 9, n), rng.integers(0, 6, n), rng.integers(1, 3, n)))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n ") == 0


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5_000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PART", 64)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_blocks_leave_no_close_pair_alone():
    for fixed in (0, *simhash.blocks_of(0), *simhash.blocks_of(simhash.blocks_of(0)[1])):
        own = [m & ~fixed for m in simhash.blocks_of(fixed)]
        assert not own[0] & own[1] and sum(m.bit_count() for m in own) == 64 - fixed.bit_count()
        assert fixed | own[0] | own[1] | own[2] | own[3] == (1 << 64) - 1


def test_spanning_links_connect_what_is_close():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = int(rng.integers(0, 2**63))
        x = list(dict.fromkeys(base ^ int(sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 8), replace=False))) for _ in range(60)))
        got, want = list(range(len(x))), plain_components(x)
        for root, m in simhash.spanning(np.array(x, np.uint64)):
            got[m] = got[root]
        assert got == want


@pytest.mark.parametrize("bucket", [1_024, 8])
def test_classes_equal_brute_force(spark, monkeypatch, bucket):
    """Chains of close fingerprints; with small buckets the blocks are split again and again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    x = [0]
    for _ in range(150):
        old = x[int(rng.integers(0, len(x)))]
        x.append(old ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    x = list(dict.fromkeys([*x, *(int(v) for v in rng.integers(0, 2**63, 50))]))
    fps = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in x], "fp long")
    with Tables(spark) as tables:
        got = {r.fp % 2**64: r.component % 2**64 for r in simhash.classes(fps, tables).collect()}
    root = plain_components(x)
    groups = {}
    for v, r in zip(x, root):
        groups.setdefault(r, []).append(v)
    signed = lambda v: v - 2**64 if v >> 63 else v
    assert got == {v: min(groups[r], key=signed) for v, r in zip(x, root)}


def test_rows_and_odd_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word77 ", "other ")
    rows = [(5, base), (3, base.upper()), (9, near), (7, None), (8, ""), (2, " \n"), (11, "one two"), (11, "one two"), (None, "quite another text of words"), (12, "one  two"), (13, "one three")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "mask", "fingerprint", "component_id"]
    by = [(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()]
    assert len(by) == len(rows)
    assert {i: c for i, _, c in by if i in (5, 3, 9)} == {5: 3, 3: 3, 9: 3 if (plain_fingerprint(base) ^ plain_fingerprint(near)).bit_count() <= 3 else 9}
    assert {(f, c) for i, f, c in by if i in (7, 8, 2)} == {("0" * 16, 2)}
    assert [c for i, _, c in by if i == 11] == [11, 11] and [c for i, _, c in by if i in (12, 13)] and {c for i, _, c in by if i is None} == {None}
    assert {f for i, f, _ in by if i == 11} == {f for i, f, _ in by if i == 12} == {f"{plain_fingerprint('one two'):016x}"}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[r][0]) for i, r in enumerate(plain_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect()} == want
