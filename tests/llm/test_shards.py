"""Training-order shards: the permutation, exact round trips, independence of the input's partitions, retried tasks."""

import shutil

import numpy as np
import pytest

from barloom.llm import shards as S
from barloom.llm.common import Tables

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, slot int, bucket string"


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = S.Permutation(n)
        s = p.slot(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and p.index(s).tolist() == list(range(n))
    assert S.Permutation(1000, 1).slot(np.arange(1000)).tolist() != S.Permutation(1000, 2).slot(np.arange(1000)).tolist()


def plain(rows, buckets, hashes):
    """All sequences by number: texts by bucket, doc_id and hash, packed in one loop."""
    t = S.Tokens(open(S.RANKS, "rb").read())
    out = []
    for b in range(max(buckets, 1)):
        own = sorted(((i, k, text) for (i, text), (k, bucket) in zip(rows, hashes) if bucket == b), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        stream = [x for _, _, text in own for x in [*np.frombuffer(t.encode(text), np.uint16).tolist(), S.END]]
        out += [stream[at : at + S.LENGTH] for at in range(0, len(stream), S.LENGTH)]
    return out


@pytest.mark.parametrize("bucket", [100_000, 10**9])
def test_slots_follow_from_the_rows_alone(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {}
    for n in (1, 5):
        out = str(tmp_path / f"o{n}")
        manifest = {r.slot: r for r in S.write_shards(rows.repartition(n), out, str(tmp_path / f"m{n}"), per_shard=16).collect()}
        got[n] = [x.tolist() for x in S.read_from(out, 0, 10**9)]
        assert sorted(manifest) == list(range(len(got[n]))) and [len(x) for x in got[n]] == [manifest[i].n_tokens for i in range(len(got[n]))]
        assert {i for r in manifest.values() for i in r.doc_ids} == {r.doc_id for r in rows.collect() if r.text is not None}
    assert got[1] == got[5]
    assert [x.tolist() for x in S.read_from(out, 13, 9)] == got[5][13:22]
    # the slot of a sequence is computed from its number
    said = [r for r in rows.collect() if r.text is not None]
    size = sum(len(r.text.encode()) + 1 for r in said)
    buckets = -(-size // bucket)
    kept = spark.createDataFrame([(r.doc_id, r.text) for r in said], "doc_id long, text string")
    hashes = [(r.k, r.b) for r in kept.selectExpr("xxhash64(text) AS k", f"pmod(xxhash64(doc_id, xxhash64(text)), {buckets}) AS b").collect()]
    want = plain([(r.doc_id, r.text) for r in said], buckets, hashes)
    order = S.Permutation(len(want)).slot(np.arange(len(want)))
    assert [got[5][s] for s in order.tolist()] == want
    t = S.Tokens(open(S.RANKS, "rb").read())
    stream = np.array([x for s in order.tolist() for x in got[5][s]], np.int64)
    texts = [t.decode(x[:-1]) for x in np.split(stream, np.flatnonzero(stream == S.END) + 1) if len(x)]
    assert sorted(texts) == sorted(r.text for r in said)


def test_read_back(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    out = str(tmp_path / "o")
    S.write_shards(rows, out, str(tmp_path / "m"), per_shard=16)
    back = sorted((r.slot, r.shard, r.n_tokens) for r in S.read_shards(spark, out).collect())
    assert [(s, s // 16) for s, _, _ in back] == [(i, i // 16) for i in range(len(back))] and [n for _, _, n in back] == [len(x) for x in S.read_from(out, 0, 10**9)]


def test_files_of_lost_tasks_go(spark, tmp_path):
    out = tmp_path / "o"
    out.mkdir()
    (out / "shard-00000000-feed.bin").write_bytes(b"left by a task that ran before")
    S.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), str(out), str(tmp_path / "m"), per_shard=1 << 20)
    assert len(list(out.glob("shard-*"))) == 1 and not (out / "shard-00000000-feed.bin").exists()


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b"), (None, "c d"), (4, "word " * 30_000), (5, "...!!")]
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS)
    S.write_shards(d, str(tmp_path / "o"), str(tmp_path / "m"))
    stream = np.concatenate([*S.read_from(str(tmp_path / "o"), 0, 10**9)])
    assert (stream == S.END).sum() == 7
    assert S.write_shards(d.limit(0), str(tmp_path / "e"), str(tmp_path / "em")).count() == 0 and list(S.read_from(str(tmp_path / "e"), 0, 5)) == []
    assert S.read_shards(spark, str(tmp_path / "e")).count() == 0


def test_tokens_are_counted_as_encoded():
    t = S.Tokens(open(S.RANKS, "rb").read())
    for text in ("", "one two\n\n three", "Straße 東京 \x00 <|endoftext|> 123", "a " * 70_000):
        ids = t.bpe.encode_ordinary(text)
        assert t.count(text) == len(ids) and t.encode(text) == np.array(ids, np.uint16).tobytes()


def test_texts_are_tokenised_once(spark, tmp_path):
    """The sequences come from the tokens of the first pass: the texts may be gone by then."""
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    with Tables(spark) as tables:
        got, total = S.sequences(spark.read.parquet(str(tmp_path / "docs")), tables)
        shutil.rmtree(tmp_path / "docs")
        assert sum(len(r.slots) for r in got.collect()) == total > 0
