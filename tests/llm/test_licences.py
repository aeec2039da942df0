"""Licence scan: alignment, variants, places against brute force, odd rows."""

import numpy as np

from barloom.llm import licences as L

DOCS = "doc_id long, text string, licence string, places int, first string"


def names(text):
    return {x[0] for x in L.Scanner().scan(text)}


def test_notices_find_themselves_and_no_sibling():
    s = L.Scanner()
    for name, text in L.NOTICES.items():
        got = {x[0]: x for x in s.scan(f"some words before. {text} And some after.")}
        assert got[name][2] == 1.0, name
        for other in got:  # only notices inside it, or that hold it
            a, b = L.words_of(L.NOTICES[other]), L.words_of(text)
            assert other == name or len(a) < len(b) or len(b) / len(a) >= 0.8, (name, other)


def test_variants_are_told_apart():
    assert names("Licensed under CC BY-SA 4.0") == {"CC-BY-SA-4.0"} and names("Licensed under CC BY 4.0") == {"CC-BY-4.0"} and names("Licensed under CC BY-NC 4.0") == {"CC-BY-NC-4.0"}
    assert names("This work is licensed under the GNU General Public License, version 2") == {"GPL-2.0"}
    assert names("This work is licensed under the GNU Lesser General Public License, version 3") == {"LGPL-3.0"}
    assert names("Licensed under the Apache License, Version 1.1") == set()
    assert names("SPDX-License-Identifier: MPL-2.0") == {"MPL-2.0-tag"}
    assert names(L.NOTICES["GPL-header"].replace("version 3", "version 2")) == {"GPL-2.0-header"}
    assert names("the license of the work") == set() == names(None) == names("")


def test_alignment():
    assert L.patience("a b x c d".split(), "a b c d".split()) == [(0, 0), (1, 1), (3, 2), (4, 3)]
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 12, rng.integers(1, 25))] for _ in range(2))
        p = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
        # on words that occur once in both it is a longest common subsequence
        a, b = ([str(x) for x in rng.permutation(30)[: rng.integers(1, 30)]] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = table[i - 1, j - 1] + 1 if x == y else max(table[i - 1, j], table[i, j - 1])
        assert len(L.patience(a, b)) == table[-1, -1]


def test_places_against_brute_force():
    """Every start of every text: a notice is found where an alignment from some start covers enough, and nowhere else."""
    rng = np.random.default_rng(7)
    notices = {"one": "grant rights freely to copy software and works 2", "two": "grant rights freely to sell software and works 3 apache", "three": "all rights stay here"}
    s = L.Scanner(notices)
    vocab = sorted({w for t in notices.values() for w in L.words_of(t)}) + ["x", "y", "z"]
    seen = 0
    for _ in range(600):
        words = rng.choice(vocab, rng.integers(0, 12)).tolist()
        for _ in range(rng.integers(0, 3)):
            t = L.words_of(notices[rng.choice(sorted(notices))])
            words += [w for w in t if rng.random() > 0.1] + rng.choice(vocab, rng.integers(0, 4)).tolist()
        want = set()
        for k, name in enumerate(s.names):
            template = s.words[k]
            for i in range(len(words)):
                p = L.patience(words[i : i + int(L.STRETCH * len(template)) + 3], template)
                if len(p) >= L.COVER * len(template) - 1e-9 and L.variants_of(words[i + p[0][0] : i + p[-1][0] + 1]) == L.variants_of(template):
                    want.add(name)
        got = {x[0] for x in s.scan(" ".join(words))}
        assert got <= want
        seen += len(got)
        assert len(want - got) == 0 or len(words) > 12, (words, want, got)
    assert seen > 300


def test_wide_and_repeated_notices():
    mit = L.words_of(L.NOTICES["MIT-text"])
    got = {x[0]: x for x in L.Scanner().scan(" ".join(mit) + " end. " + L.NOTICES["MIT-text"].upper())}
    assert got["MIT-text"][1] == 2 and got["MIT-text"][2] == 1.0
    assert "MIT-text" in names(" ".join(w if i % 3 else f"{w} marker{i}" for i, w in enumerate(mit)))  # a third more of foreign words
    words = (mit * 40)[:6000]
    assert max(x[1] for x in L.Scanner().scan(" ".join(words)) if x[0] == "MIT-text") >= 20
    assert names("license " * 200_000) == set()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "Released under the MIT License"), (4, "Released under the MIT License"), (None, "All rights reserved"), (5, "word " * 30_000), (6, "...")]
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    assert sorted((r.doc_id or 0, r.licence, r["first"]) for r in L.scan(d).collect()) == [(0, "all-rights-reserved", 0), (4, "MIT", 0), (4, "MIT", 0)]
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0
