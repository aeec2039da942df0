"""Main text of web pages by site template removal.

A page is parsed into a tree that forgives missing and crossed tags. The subtrees of its block elements are hashed twice: with their text (tag, class, text and
children), and as shapes (tag, class and children, text masked, runs of like children as one). For each host, the pages with different text that hold a hash are counted in Spark. A subtree that
recurs on ``MIN_PAGES`` pages or more of its host, however large the host is, belongs to the site's template and is deleted; what remains is the main text. There is no choice of one article
element: text outside of it stays unless it is deleted.

A shape is a slot of the template, whose words may differ on each page (adverts, lists of links). It is counted and deleted only where an author's text would not stand: outside of articles, in a container
whose kind holds at most a quarter of the page's text and which is mostly links, or has a class or id and no paragraph or heading on a page that has an article.

Beside recurrence, elements that by their own tag or role hold no article text (navigation, footers, asides, scripts) go, and forms but for one that wraps prose and more than half of the page's text. Class and id
names are hints for what is too rare to recur. A name is a hint if all its parts are words of ``HINTS`` or of ``NEUTRAL`` ("ad-box", not "ad-hoc"). Outside of articles a hinted container goes, unless it holds prose and more than a quarter of the text of a page without an article
and its kind (tag and class) does not recur; within one it goes if its name says reader comments or adverts (``SURE``), or if its kind recurs on ``MIN_PAGES`` pages of the host. None
goes that holds more than half of the page's text, if it holds an article or the page has none. Headings, paragraphs, quotations and list items inside an article are the author's: they never go by a class, and
stay even if they recur, as licence lines and quotations do. An article, and what holds one, is deleted only if it is the smaller part of the text.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one newline in page order.

Defined results: null, empty or markup-free html gives its bare text, which is empty for the first two. A null url is a host of its own name. Pages that
are exact copies count once for a template. Repeated rows give repeated results. Extra columns are ignored. Parsing moves forward only, so broken markup of any
length takes time in proportion.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_PAGES = 5
#: template hashes (8 bytes each) that are at most broadcast; more are joined to the pages
BROADCAST = 2_000_000
# Element names, roles and words of class or id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noscript iframe".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend".split())
ROOT = frozenset(("article", "main"))
CONTAINER = frozenset("div section article main ul ol dl dir table details header hgroup address center figure fieldset".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROP = frozenset("""script style noscript template head title nav footer aside iframe button select textarea object embed canvas audio video dialog menu
map datalist input svg""".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo cookie cookies consent gdpr notice notices
sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer share sharing social related newsletter subscribe popup modal overlay comment comments commentlist respond
disqus widget widgets toolbar pagination pager login signup""".split())
SURE = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsored comment comments commentlist respond disqus".split())
NEUTRAL = frozenset("""area bar block body bottom box button buttons container content form google group header inner item items left link links list main middle outer page post right section
site slot text title top unit wrap wrapper""".split())
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""["'>]""")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select",)}
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "option": ("option",)}
_AROUND_P = ("table", "td", "th", "button", "object", "article", "main", "div", "section", "li", "blockquote", "body")


class Node:
    """An element. ``rooted``: it holds an article; ``prose``: a paragraph or heading; ``size``, ``links``: characters of text, and those in links; ``slot``: an author's text would not stand here."""

    __slots__ = ("tag", "attrs", "kids", "hash", "shape", "rooted", "prose", "size", "links", "slot")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.hash, self.shape = tag, attrs, [], 0, 0
        self.rooted, self.prose, self.size, self.links, self.slot = False, False, 0, 0, False


class _Open:
    """The open elements, innermost last, and the depths at which each tag is open."""

    def __init__(self, top: Node):
        self.stack, self.at = [top], defaultdict(list)
        self.at["block"] = []

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.at["block"].append(len(self.stack))
        self.stack.append(node)

    def _depth(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags, stop=()) -> None:
        """Close the innermost open element of ``tags``, and all in it, unless an element of ``stop`` stands between."""
        depth = self._depth(tags)
        if depth and depth > self._depth(t for t in stop if t not in tags):
            for node in self.stack[depth:]:
                self.at[node.tag].pop()
                if node.tag in BLOCK:
                    self.at["block"].pop()
            del self.stack[depth:]


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), a or b or c)
    return out


class _Tags:
    """Where tags end. Values quoted after = may hold a >; a quote that is never closed is plain, and nothing is searched for that is not ahead."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.quotes = True

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at ``at``; -1 if there is none."""
        if self.last[">"] < at:
            return -1
        i = at
        while self.quotes:
            m = _STOP.search(self.source, i)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            j = m.start() - 1
            while self.source[j].isspace():
                j -= 1
            if self.source[j] != "=" or self.last[m[0]] <= m.start():
                i = m.end()  # no value begins here, or none that ends
                continue
            i = self.source.index(m[0], m.end()) + 1
        self.quotes = False  # a quote swallowed the rest: from here on quotes are plain
        return self.source.find(">", at)


def parse(source: str) -> Node:
    """The element tree; texts are strings among ``kids``."""
    top = Node("#", {})
    opened, tags, at, n = _Open(top), _Tags(source), 0, len(source)
    stack = opened.stack
    text = 0  # where the text that isn't in the tree yet begins
    while True:
        i = source.find("<", at)
        if i < 0 or i + 1 >= n:
            break
        c = source[i + 1]
        if c == "!" and source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            end = n if end < 0 else end + 3
            name = None
        elif c in "!?" or (c == "/" and not source[i + 2 : i + 3].isalpha()):
            end = source.find(">", i) + 1
            name = None
            if not end:
                break
        else:
            m = _NAME.match(source, i + 1 + (c == "/"))
            if not m:
                at = i + 1
                continue
            e = tags.end(m.end())
            if e < 0:
                break
            end, name = e + 1, m
        if i > text:
            stack[-1].kids.append(source[text:i])
        at = text = end
        if name is None:
            continue
        tag = name[0].lower()
        if c == "/":
            if tag in ROOT or tag in ("body", "html"):
                opened.close((tag,))
            else:
                opened.close((tag,), ("article", "main", "body") if tag in BLOCK else ("block",))
            continue
        rest = source[name.end() : e]
        if tag in CLOSES_P:
            opened.close(("p",), _AROUND_P)
        if tag in _SAME:
            opened.close(_SAME[tag], _SCOPE[tag])
        node = Node(tag, _attributes(rest))
        stack[-1].kids.append(node)
        if tag in RAW:
            m = _END[tag].search(source, at)
            node.kids.append(source[at : m.start() if m else n])
            at = text = m.end() if m else n
        elif tag not in VOID and not rest.endswith("/"):
            opened.push(node)
    if text < n:
        stack[-1].kids.append(source[text:])
    return top


def _label(node: Node) -> str:
    """The class of an element, or else its id, without numbers."""
    return _DIGITS.sub("0", node.attrs.get("class", "") or node.attrs.get("id", ""))


def _seal(top: Node) -> list[Node]:
    """Hashes of all subtrees, children first, shapes where slots may be, and what they hold; returns the elements that may be templates."""
    out, outside, todo = [], [], [(top, False, False, False)]
    while todo:
        node, ready, inside, gone = todo.pop()
        if not ready:
            todo.append((node, True, inside, gone))
            below, gone = inside or node.tag in ROOT, gone or node.tag in DROP
            todo += [(k, False, below, gone) for k in node.kids if isinstance(k, Node)]
            continue
        h = xxhash.xxh64(f"{node.tag}\x00{node.attrs.get('class', '')}")
        shape = None if inside or gone else xxhash.xxh64(f"{node.tag}\x02{_label(node)}")
        last = None
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.hash.to_bytes(8, "little"))
                node.rooted |= k.rooted or k.tag in ROOT
                node.prose |= k.prose or k.tag in PROSE
                node.size += k.size
                node.links += k.links
                form = k.shape
            else:
                said = " ".join(k.split())
                h.update("\x01" + said)
                node.size += len(said)
                form = 1 if said else last
            if form != last:
                if shape:
                    shape.update(form.to_bytes(8, "little"))
                last = form
        node.hash, node.shape = h.intdigest(), shape.intdigest() if shape else 0
        if node.tag in DROP:
            node.size = node.links = 0
        elif node.tag == "a":
            node.links = node.size
        if node.size and not gone and node.tag not in DROP and (node.tag in CONTAINER or (node.tag in PROSE and not inside)):
            out.append(node)
            if node.tag in CONTAINER and not inside and not node.rooted and node.tag not in ROOT:
                outside.append(node)
    share: dict[int, int] = defaultdict(int)
    for x in outside:
        share[x.shape] += x.size
    for x in outside:
        x.slot = 4 * share[x.shape] <= top.size and (2 * x.links > x.size or (top.rooted and not x.prose and _label(x) != ""))
    return out


def _kind(node: Node) -> int:
    """The hash of an element's tag and class alone."""
    return xxhash.xxh64_intdigest(f"{node.tag}\x01{node.attrs.get('class', '')}\x01{'' if node.attrs.get('class') else node.attrs.get('id', '')}")


def _hint(node: Node) -> int:
    """What the names and attributes of a container say: 2 for reader comments or adverts, 1 for other text that is no article's, else 0."""
    a = node.attrs
    if not a or node.tag not in CONTAINER:
        return 0
    level = int("hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower())
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        words = set(_WORDS.findall(name))
        if not HINTS.isdisjoint(words) and words <= HINTS | NEUTRAL:
            level = max(level, 1 if SURE.isdisjoint(words) else 2)
    return level


def _marks(nodes: list[Node]) -> set[int]:
    """What is counted for each host: subtrees, shapes of slots, kinds of hinted containers."""
    return {x.hash for x in nodes} | {x.shape for x in nodes if x.slot} | {_kind(x) for x in nodes if _hint(x)}


def _deleted(x: Node, top: Node, inside: bool, templates) -> bool:
    """Whether an element goes; ``inside``: it stands in an article."""
    most, holds = 2 * x.size > top.size, x.rooted or x.tag in ROOT
    role = x.attrs.get("role", "").lower()
    if x.tag == "form" or role == "form":
        return not (most and (x.prose or holds))
    if x.tag in DROP or (role in DROP_ROLES and not (most and holds)) or (x.tag == "header" and not inside and not x.rooted):
        return True
    if (x.tag in CONTAINER or (x.tag in PROSE and not inside)) and not (most and holds) and x.hash in templates:
        return True
    if x.slot and x.shape in templates:
        return True
    hint = _hint(x)
    if not hint or (most and (holds or not top.rooted)):
        return False
    if inside:
        return hint == 2 or _kind(x) in templates
    return hint == 2 or not (x.prose and not top.rooted and 4 * x.size > top.size) or _kind(x) in templates


def blocks(top: Node, templates=frozenset()) -> list[str]:
    """The text of each block of the main text; ``templates`` holds the hashes of subtrees to delete."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [(top, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not _deleted(x, top, inside, templates):
            if x.tag == "br":
                run.append(" ")
                continue
            if x.tag in BLOCK:
                flush()
                todo.append((None, inside))
            within = inside or x.tag in ROOT
            todo += [(k, within) for k in reversed(x.kids)]
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    return (m[1] if m else url or "").lower()


def _key(host: str, h: int) -> int:
    """A host's subtree as one 64-bit number."""
    x = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), xxhash.xxh64_intdigest(host))
    return x - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sub, page: each subtree, shape of a slot and kind of hinted container that a page of this text holds; sub stands for host and subtree."""
    for b in batches:
        seen = set()
        for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not source:
                continue
            host, top = host_of(url), parse(source)
            nodes = _seal(top)
            page = xxhash.xxh64_intdigest("\n".join(blocks(top))) - (1 << 63)
            seen.update((_key(host, x), page) for x in _marks(nodes))
        cols = list(zip(*seen)) or [[]] * 2
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["sub", "page"])


def templates(pages: DataFrame) -> DataFrame:
    """sub, n: the subtrees that recur on many pages of their host, and how many."""
    seen = pages.select("url", "html").mapInArrow(_count, "sub long, page long").distinct()
    return seen.groupBy("sub").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)


class _Held:
    """Templates of one host, looked up in the sorted keys of all hosts."""

    def __init__(self, keys: np.ndarray, host: str):
        self.keys, self.host = keys, host

    def __contains__(self, h: int) -> bool:
        k = _key(self.host, h)
        i = int(np.searchsorted(self.keys, k))
        return i < len(self.keys) and int(self.keys[i]) == k


def main_text(source: str | None, held=frozenset()) -> str:
    if not source:
        return ""
    top = parse(source)
    _seal(top)
    return "\n".join(blocks(top, held))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each page."""
    found = cut(templates(pages).select("sub"))
    schema = "page_id long, url string, text string, n_chars long"
    out = ["page_id", "url", "text", "n_chars"]
    if found.count() <= BROADCAST:
        keys = np.sort(np.array([r["sub"] for r in found.toLocalIterator()], np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [main_text(h, _Held(shared.value, host_of(u))) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], out)

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    def subs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, url, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                if source:
                    host = host_of(url)
                    rows += [(k, _key(host, x)) for x in _marks(_seal(parse(source)))]
            cols = list(zip(*rows)) or [[]] * 2
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["key", "sub"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, _Held(np.sort(np.array(s or [], np.int64)), host_of(u))) for u, h, s in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], out)

    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key"))
    held = keyed.select("key", "url", "html").mapInArrow(subs, "key long, sub long").distinct().join(found, "sub").groupBy("key").agg(F.collect_set("sub").alias("subs"))
    return keyed.join(held, "key", "left").select("page_id", "url", "html", "subs").mapInArrow(run_joined, schema)
