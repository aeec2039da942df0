"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import collections
import re

import numpy as np
import pytest

from test_decontam import plain_leak

from barloom.llm import decontam, langid, licences, line_dedup, omh, pieces, shards

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string"


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in enumerate(texts)], DOCS)


def odd(spark):
    return spark.createDataFrame([(1, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (3, "a", "en", "s", 1, "y"), (3, "a", "en", "s", 1, "y"), (None, "b c", None, "s", 3, "z"), (4, "word " * 30_000, "en", None, 1, None), (5, "...!!", "fr", "s", 5, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_lines(docs):
    seen, out = set(), []
    for i, t in docs:
        if t is None:
            out.append((i, None))
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(x.strip(" ") for x in lines[k : k + 3])
            if "".join(w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_lines(sorted((r.doc_id, r.text) for r in rows.collect()))
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(rows).collect())
    assert got == want
    d = docs_of(spark, "a\nb\nc\nd", "x\na\nb\nc\nd\ny", "a\nb", "a\nb\nc\nb\nc\na\nb\nc", "\n\n\n\n\n\n")
    assert [r.text for r in line_dedup.dedup_lines(d).orderBy("doc_id").collect()] == ["a\nb\nc\nd", "x\ny", "a\nb", brute_lines([(i, r.text) for i, r in enumerate(d.orderBy("doc_id").collect())])[3][1], "\n\n\n\n\n\n"]
    assert {(r.doc_id, r.text) for r in line_dedup.dedup_lines(odd(spark)).collect()} == {(r.doc_id, r.text) for r in odd(spark).collect()}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    assert line_dedup.clean_documents(odd(spark)).count() == 7


def test_language_id(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_documents(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    o = sorted(((r.doc_id or -1, r.lang_pred) for r in langid.predict_documents(odd(spark)).collect()), key=str)
    assert (1, "und") in o and (2, "und") in o and (5, "und") in o and len(o) == 7
    assert langid.predict_documents(empty(spark)).count() == 0
    assert langid.keep_identified(odd(spark)).columns == odd(spark).columns
    counts = collections.Counter(langid.gram_codes("aab a").tolist())
    assert sum(counts.values()) == 4 + 6 + 4 and langid.gram_codes("!! 12").size == 0


TEXTS = [None, "", " ", "a", "hello world", "  two  spaces ", "new\nline\ttab", "日本語 テキスト", "▁ literal ▁▁", "emoji 👍🏽", "x" * 5000, "naïve ́ café", "tr  "]


def test_pieces_round_trip_and_reproduce(spark):
    s = pieces.Sampler(open(pieces.MODEL, "rb").read())
    got = s.encode(TEXTS, list(range(len(TEXTS))))
    assert [s.decode(x) if x is not None and len(x) else ("" if x is not None else None) for x in got] == TEXTS
    again = pieces.Sampler(open(pieces.MODEL, "rb").read()).encode(TEXTS[::-1], list(range(len(TEXTS)))[::-1])[::-1]
    assert all((a is None and b is None) or np.array_equal(a, b) for a, b in zip(got, again))
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    enc = pieces.encode(rows, check=True)
    assert enc.where("not lossless").count() == 0
    back = pieces.decode(enc.select("doc_id", "tokens")).join(rows.select("doc_id", rows.text.alias("t")), "doc_id")
    assert back.where("not text <=> t").count() == 0
    assert pieces.encode(odd(spark), check=True).where("not coalesce(lossless, true)").count() == 0 and pieces.encode(empty(spark)).count() == 0


def test_pieces_do_not_depend_on_the_batch():
    """The same rows in batches of other sizes and in another order draw the same; a null key is not the text None."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() if t]
    make = lambda: pieces.Sampler(open(pieces.MODEL, "rb").read())
    whole = make().encode(texts, list(range(len(texts))))
    for size in (1, 7, 64):
        s = make()
        some = [x for at in range(0, len(texts), size) for x in s.encode(texts[at : at + size], list(range(at, min(at + size, len(texts)))))]
        assert all(np.array_equal(a, b) for a, b in zip(whole, some))
    back = make().encode(texts[::-1], list(range(len(texts)))[::-1])[::-1]
    assert all(np.array_equal(a, b) for a, b in zip(whole, back))
    s = make()
    assert any(not np.array_equal(a, b) for a, b in zip(s.encode(texts[:20], [None] * 20), s.encode(texts[:20], ["None"] * 20)))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, no rows at all, and columns that bear inner names."""
    import corpus_pipeline as p

    bench = spark.createDataFrame([(1, "what is the name of the river that runs through the old town of Bern")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "words of one text that is short"), (3, "words of one text that is short"), (None, "a text without any id at all"), (4, "...")]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long, uid int").write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = p.run(spark, str(tmp_path / "some")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 3, 3] and all(r.n_tokens > 0 and r.uid == 5 for r in got)
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def brute_profile(texts, length):
    counts = collections.Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w = f"\0{w}\0"
            counts.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != "\0" and not (n == 3 and w[i + 1] == "\0"))
    return counts


def test_language_ranks_against_brute_force():
    """Out-of-place distances by dictionaries of n-grams; the order of equal counts is the model's own, so texts without ties at the cut are compared by their sums."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(40))
        grams, counts = np.unique(langid.gram_codes(text), return_counts=True)
        assert sorted(counts.tolist()) == sorted(brute_profile([text], 0).values())
    langs = {"x": langid.gram_ranking("aa ab abc abcd " * 5, 50).tolist(), "y": langid.gram_ranking("zz zy zyx zyxw " * 5, 50).tolist()}
    m = langid.RankModel(langs)
    for text in ("aa abc", "zyx zz zyxw", "ab zy"):
        doc = langid.gram_ranking(text).tolist()
        off = {k: sum(min(abs(p.index(g) - i), m.length) if g in p else m.length for i, g in enumerate(doc)) for k, p in langs.items()}
        assert m.predict(text)[0] == min(sorted(off), key=off.get)


def test_pieces_follow_the_lattice():
    """Drawn segmentations come as often as their share of all segmentations says."""
    s = pieces.Sampler(open(pieces.MODEL, "rb").read())
    word, table = "then", {p.decode(): (i, s.log_w[i]) for i, p in enumerate(s.bytes_of) if p and i > 258}
    text, paths = " " + word, collections.Counter()

    def walk(at, ids, w):
        if at == len(text):
            paths[tuple(ids)] = np.exp(w)
        for e in range(at + 1, len(text) + 1):
            if text[at:e] in table:
                i, x = table[text[at:e]]
                walk(e, [*ids, i], w + x)

    walk(0, [], 0.0)
    n = 20_000
    seen = collections.Counter(tuple(x.tolist()) for x in s.encode([word] * n, list(range(n))))
    assert set(seen) <= set(paths)
    for p, w in paths.items():
        share = w / sum(paths.values())
        assert abs(seen[p] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 1e-4


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = shards.Permutation(n)
        s = p.slot(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and p.index(s).tolist() == list(range(n))
    assert shards.Permutation(1000, 1).slot(np.arange(1000)).tolist() != shards.Permutation(1000, 2).slot(np.arange(1000)).tolist()


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in p.run(spark, SF).collect()}
    ids = {r.doc_id: r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    lines = {i: t for i, t in brute_lines(sorted(ids.items())) if t or not ids[i]}
    words = {i: omh.word_ids(t) for i, t in lines.items()}
    up = {i: i for i in words}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in words.items():
        for j, b in words.items():
            if i < j and len(a) and len(b) and omh.similar(a, b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i in words if find(i) == i and not any(plain_leak(lines[i], t) for t in items if lines[i] and t)}
    assert set(got) <= want | {i for i in words if find(i) != i} and len(want - set(got)) == 0 and len(set(got) - want) <= 2
    s = pieces.Sampler(open(pieces.MODEL, "rb").read())
    assert all(s.decode(r.tokens) == lines[i] for i, r in got.items() if r.n_tokens)


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op3_html_text", "op5_language_id", "op10_toxicity"])
def test_queries_cover_their_tables(spark, name):
    from barloom.llm.queries import QUERIES

    got = QUERIES[name](spark, SF)
    table = "pages" if "html" in name else "documents"
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_clashing_columns_survive(spark):
    """Columns that bear the names the operators use inside come through as they were."""
    rows = [(i, t, "en", "s", len(t), 7, 8, 9, "k", "p", "q") for i, t in enumerate(["one two three\nfour\nfive\nsix", "zero\none two three\nfour\nfive\nsix\nend", "something else entirely here"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, _gone int, k1 int, _key string, lang_pred string, tokens string")
    for f in (langid.keep_identified, line_dedup.clean_documents, omh.keep_one, lambda x: decontam.keep_clean(x, spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string"))):
        got = f(d)
        assert got.columns == d.columns and {(r.n_removed, r._gone, r.k1, r._key, r.lang_pred, r.tokens) for r in got.collect()} == {(7, 8, 9, "k", "p", "q")}
    assert [r.n_chars for r in line_dedup.clean_documents(d).orderBy("doc_id").collect()] == [27, 8, 28]
    assert pieces.encode(d).where("_key = 'k'").count() == 3
    assert line_dedup.dedup_lines(d).count() == 3
