"""Main text of pages: rules on single pages, recurrence against brute force, broken markup, odd rows."""

import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from barloom.llm import html_text as H

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def test_single_pages():
    page = """<html><head><title>T</title><script>var x = "</p>";</script></head><body class="has-sidebar"><nav><ul><li>m</li></ul></nav><div class="ad">buy</div>
    <main><article><h1>Head &amp; &lt;b&gt;</h1><p>One <b>two<br>x</p><p>Three\n  four<p>Five</article></main><div id="comments"><p>c</p></div><aside>s</aside><footer>f</footer></body></html>"""
    assert H.main_text(page) == "Head & <b>\nOne two x\nThree four\nFive"
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text("a < b > c") == "a < b > c"
    assert H.main_text("<div>" * 20_000 + "deep") == "deep"
    assert H.main_text('<a title="x > y">z</a> it<b title=it\'s>s</b>') == "z its"


def test_classes_never_decide_on_an_authors_blocks():
    inner = '<h1 class="entry-header">Title</h1><p class="related">first of all</p><p id="comments">second of all</p><p>where <math><mi>x</mi></math> stands</p>'
    want = "Title\nfirst of all\nsecond of all\nwhere x stands"
    assert H.main_text(f"<body><article>{inner}</article></body>") == want
    assert H.main_text(f"<body><div>{inner}</div></body>") == want
    assert H.main_text(f'<body><div class="content has-sidebar"><article>{inner}</article></div><div class="sidebar">links</div></body>') == want
    assert H.main_text(f"<body><article>{inner}<div class=related>stays where no other page has one</div></article></body>") == want + "\nstays where no other page has one"


def test_small_articles_hide_nothing():
    text = "<p>" + "the text of the page stands outside of any article " * 5 + "</p>"
    assert "outside" in H.main_text(f"<div>{text}</div><article>teaser</article>")
    assert H.main_text(f"<article>{text}</article><div id=comments><article class=comment>first!</article></div><aside><article>teaser</article></aside>") == H.main_text(text)


@pytest.mark.parametrize("piece", ["<script ", "<script >", '<a "', '<a href="', "<a href='x\">", "<!-- ", "<p><article><div>", "</p>", "<div></p>", "<b></i>", "<"])
def test_broken_markup_takes_time_in_proportion(piece):
    began = time.time()
    H.main_text(piece * (1_000_000 // len(piece)))
    H.main_text("<p><article>" + "<div>" * 50_000 + piece * (300_000 // len(piece)) + ">")
    assert time.time() - began < 15


def site(n, seed=1):
    """Pages without article or main, whose menus, notices and footers have no telling tag or class."""
    rng, rows, want = random.Random(seed), [], {}
    for i in range(n):
        host = "ab"[i % 2]
        own = [" ".join(rng.choice("red green blue old new big small far near".split()) + str(rng.randrange(999)) for _ in range(12)) for _ in range(3)]
        menu = "".join(f"<li>{host} entry {k}</li>" for k in range(5))
        note = f"<div class=q{i % 3}><p>{host} says: we use so called crumbs, kind {i % 3}</p></div>"
        rows.append((i, f"http://{host}.org/{i}", f"<body><div class=z1><ul>{menu}</ul></div>{note}<div class=t><h2>{own[0]}</h2><p>{own[1]}</p><ul><li>same in all lists</li><li>{own[2]}</li></ul></div><div class=z2>end of {host}</div></body>"))
        want[i] = "\n".join([own[0], own[1], "same in all lists", own[2]])
    return rows, want


class Flat(HTMLParser):
    """Every div, p, h2 and ul as the text between its tags, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.open = [x + f"<{tag} {attrs}>" for x in self.open] + [f"<{tag} {attrs}>"]

    def handle_data(self, data):
        self.open = [x + data for x in self.open]

    def handle_endtag(self, tag):
        self.found.append(self.open.pop())
        self.open = [x + f"</{tag}>" for x in self.open]


def test_recurrence_decides_as_brute_force_says(spark):
    rows, want = site(60)
    plain = {i: H.main_text(h) for i, _, h in rows}
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want and all(got[i] != plain[i] for i in got)
    # the templates themselves: count by the standard library's parser
    pages = defaultdict(set)
    for i, url, h in rows:
        f = Flat()
        f.feed(h)
        for x in f.found:
            if x.startswith(("<div", "<p", "<h2", "<ul")):
                pages[url[7], x].add(i)
    brute = sum(len(p) >= H.MIN_PAGES for p in pages.values())
    assert H.templates(spark.createDataFrame(rows, PAGES)).count() == brute > 0


def test_templates_need_the_same_number_of_pages_on_any_host(spark):
    rows, want = site(H.MIN_PAGES * 2 - 2)
    small = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("end of" in t for t in small.values())
    rows, want = site(400)
    many = rows + [(1000 + i, f"http://b.org/x{i}", f"<p>only here {i}</p><div class=rare>rare box</div>") for i in range(H.MIN_PAGES)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(many, PAGES)).collect()}
    assert all(got[i] == t for i, t in want.items()) and got[1000] == "only here 0"


def test_kinds_inside_an_article_go_where_they_recur(spark):
    page = "<article><h1>t{i}</h1><p>text number {i}</p><div class=related><p>{i} more {i}</p></div><div class=comments><p>{i} remarks {i}</p></div></article>"
    rows = [(i, "http://h.org/", page.format(i=i)) for i in range(H.MIN_PAGES)] + [(90, "http://other.org/", page.format(i=90))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[2] == "t2\ntext number 2" and got[90] == "t90\ntext number 90\n90 more 90"  # reader comments go on any host


def test_shapes_of_slots_decide_whatever_their_words(spark):
    """No name tells what the slots hold, and no two pages have the same text in them."""
    page = "<body><ul class=k1><li><a href=/{i}>go {i}</a></li><li><a href=/z{i}>up {i}</a></li></ul><div class=k2>buy {i} now</div><article><h1>t{i}</h1><p>text number {i}</p><div class=k3>table {i}</div></article><div class=k4><p>outside {i}</p></div></body>"
    rows = [(i, f"http://{'large' if i < 40 else 'small'}.org/{i}", page.format(i=i)) for i in range(40 + H.MIN_PAGES - 1)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"t{i}\ntext number {i}\ntable {i}\noutside {i}" for i in range(40))
    assert all(got[i].startswith(f"go {i}\nup {i}\nbuy {i} now\nt{i}\n") for i in range(40, len(rows)))


def test_shapes_leave_an_authors_blocks(spark):
    """Pages without article: titles and parts in containers of one shape stay, and so does what holds much of the text."""
    page = "<div class=title>title {i}</div><div class=part>part one of {i}</div><div class=part>part two of {i}</div><div class=sum><p>in short: {i}</p></div>"
    rows = [(i, "http://h.org/", page.format(i=i)) for i in range(20)]
    rows += [(100 + i, "http://list.org/", f"<ul class=all><li><a href=x>first {i}</a></li><li><a href=y>second {i}</a></li></ul>") for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[7] == "title 7\npart one of 7\npart two of 7\nin short: 7" and got[107] == "first 7\nsecond 7"


def test_forms_and_names():
    text = "<h1>Head</h1><p>one of the texts that a server wraps</p>"
    want = "Head\none of the texts that a server wraps"
    assert H.main_text(f"<form id=f>{text}<input><button>ok</button></form>") == want
    assert H.main_text(f"<body><form><nav>m</nav><article>{text}<form>mail</form></article></form></body>") == want
    assert H.main_text(f"{text}<form><p>sign up</p><input></form>") == want
    assert H.main_text(f'{text}<section class="ad-hoc"><p>it is real prose</p></section>') == want + "\nit is real prose"
    assert H.main_text(f'{text}<div class="notice"><p>it is a long text about what is to be noted by all</p></div>').endswith("noted by all")
    assert H.main_text(f'<article>{text}</article><div class="notice"><p>it is a long text about what is to be noted by all</p></div>') == want
    assert H.main_text(f'<article>{text}<div class="ad-box">buy</div><section id="comments-2"><p>{"first! " * 99}</p></section></article>') == want


def test_copies_and_licence_lines_stay(spark):
    rows = [(i, "http://h.org/", "<article><p>one and the same</p><div>of all</div></article>") for i in range(20)]
    rows += [(100 + i, "http://h.org/", f"<article><p>text {i}</p><p>All rights reserved</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "one and the same\nof all" and got[103] == "text 3\nAll rights reserved"


def test_odd_rows(spark):
    rows, want = site(48)
    rows += [(80, None, None), (81, "http://h.org/e", ""), (82, "bad url", "<p>x</p>"), (82, "bad url", "<p>x</p>"), (None, None, "<p>y</p>"), (83, None, "<div>" + "long text " * 100_000 + "</div>")]
    d = spark.createDataFrame([(*r, 1, "s", "n") for r in rows], PAGES + ", text int, sub string, n_chars string")
    got = H.extract(d).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[3].text == want[3] and by[3].n_chars == len(want[3])
    assert by[80].text == by[81].text == "" and by[82].text == "x" and by[80].n_chars == 0 and by[None].text == "y" and by[83].n_chars == 999_999
    assert sum(r.page_id == 82 for r in got) == 2
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_joined_path_agrees(spark, monkeypatch):
    rows, _ = site(40)
    d = spark.createDataFrame(rows + [(70, None, None), (3, "http://a.org/", "<p>x</p>"), (3, "http://a.org/", "<p>x</p>")], PAGES)
    for pages in (d, spark.read.parquet(f"{SF}/pages.parquet")):
        monkeypatch.setattr(H, "BROADCAST", 2_000_000)
        a = sorted((r.page_id, r.text) for r in H.extract(pages).collect())
        monkeypatch.setattr(H, "BROADCAST", -1)
        assert a == sorted((r.page_id, r.text) for r in H.extract(pages).collect())
