"""Phrase collocations by a weighted de Bruijn graph.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words; everything is per lang. Nodes are pairs of words, edges triples (the longest grams) between overlapping
nodes. Only edges are counted, with corrections where a piece ends: a pair that ends its piece is an edge without third word, a last word one without second. The count of a pair is the flow out of its node, edges and correction
together; that of a word the flow out of all nodes that it begins; n that of all words.

Each task builds the graph of some megabytes of text as arrays, compacts its unary paths (nodes with one edge in and one out, of equal weight) and sends each path once; Spark takes paths apart into edges and sums these.
An edge can only be, or lie in, a phrase of ``LEAST`` occurrences if its nodes do, so a first pass counts hashes of pairs, and a bitmap of 8 MB says which may be frequent: an edge whose second node is not is sent as the
correction of its first node, one whose first node is not as that of its word. The bitmap only ever says yes too often, so no count of a frequent phrase changes.

Candidates are phrases of 2 to 3 words with a >= ``LEAST``; of the cuts of a triple the one of lowest score floor(1000000 a a / (l r)) counts, the first of equal ones. A pair goes if an edge into or out of its node has 100 f >= 50 a. Scores are
computed in DECIMAL(38, 0): exact for counts up to 5e15. The first ``TOP`` of each lang are returned.

Defined results: null and empty texts hold no words; a null lang is ``und``, together with rows whose lang is that word. Repeated rows count as often as they occur. Extra columns and doc_id are ignored. Texts of any length are read whole, some megabytes at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, marks

LEAST = 10
TOP = 2_000
SHARE = 50
SCALE = 1_000_000
#: bytes of text whose graph is built at once
CHUNK = 3 << 20

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
#: pieces end at a full stop, words at a space, letters are small
_PLAIN = bytes.maketrans(_BREAKS + b"\t" + _UPPER, b"." * len(_BREAKS) + b" " + _UPPER.lower())


def _parts(texts: Iterator[bytes]) -> Iterator[bytes]:
    """The texts of one lang with breaks between them, in parts of about CHUNK bytes that are cut at spaces."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        t = t.translate(_PLAIN).replace(b".", b" . ") + b" . "
        while size + len(t) > CHUNK:
            cut = t.find(b" ", max(1, CHUNK - size))
            cut = cut if cut > 0 else len(t)
            held.append(t[:cut])
            yield b"".join(held)
            held, size, t = [], 0, t[cut:]
        held.append(t)
        size += len(t)
    yield b"".join(held)


class Words:
    """The words of a part by their numbers; 0 stands for a break."""

    def __init__(self, lang: str):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b"."]
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def read(self, part: bytes) -> np.ndarray:
        got = part.split()
        return np.fromiter(map(self.number.__getitem__, got), np.int64, len(got))

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in self.number), np.uint64, len(self.number))

    def forget(self, carry: np.ndarray) -> np.ndarray:
        """Keep the words of ``carry`` alone; their new numbers."""
        names = list(self.number)
        self.number.clear()
        self.number[b"."]
        return np.array([self.number[names[i]] for i in carry.tolist()], np.int64)


def _graphs(batches: Iterator[pa.RecordBatch], of: Callable[[Words, np.ndarray], tuple[pa.Array, np.ndarray]], name: str) -> Iterator[pa.RecordBatch]:
    """lang, and ``name`` and n that ``of`` makes of the numbers of each part of each lang; the last two numbers are those that the next part begins with, no gram begins there in this one."""
    for b in batches:
        texts, by = b.column(1).cast(pa.binary()), defaultdict(list)
        for i, lang in enumerate(b.column(0).to_pylist()):
            by[lang].append(i)
        for lang, places in by.items():
            words, carry = Words(lang), np.zeros(0, np.int64)
            for part in (*_parts(t for i in places if (t := texts[i].as_py())), None):
                ids = np.concatenate((carry, words.read(part) if part is not None else [0, 0])).astype(np.int64)
                if len(ids) > 2:
                    found, n = of(words, ids)
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), found, pa.array(n.astype(np.int64))], ["lang", name, "n"])
                carry = words.forget(ids[-2:])


def _pair_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = h[a] * np.uint64(0x9E3779B97F4A7C15) ^ (h[b] + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _pairs(words: Words, ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Hashes of the pairs that begin before the last two words, and how often."""
    a, b = ids[:-2], ids[1:-1]
    there = (a > 0) & (b > 0)
    k, n = np.unique(_pair_hashes(words.hashes(), a[there], b[there]), return_counts=True)
    return pa.array(k.view(np.int64)), n


def compacted(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b, c), distinct, of weights ``n`` along unary paths: the order of the edges in which each path is in one piece, and where paths begin in it.
    Edges follow each other where the node between has no other edge, and their weights are equal. A circle is cut at one of its edges."""
    m = len(a)
    width = int(max(b.max(), c.max())) + 1
    nodes, ends = np.unique(np.concatenate((a * width + b, b * width + c)), return_inverse=True)
    start, end = ends[:m], ends[m:]
    single = (np.bincount(start, minlength=len(nodes)) == 1) & (np.bincount(end, minlength=len(nodes)) == 1)
    edge_out = np.zeros(len(nodes), np.int64)
    edge_out[start] = np.arange(m)
    nxt = edge_out[end]
    follows = single[end] & (n[nxt] == n) & (nxt != np.arange(m))
    back = np.arange(m)  # the edge before, or itself at a head
    back[nxt[follows]] = np.flatnonzero(follows)
    # circles have no head: their smallest edge becomes one
    head, least = back.copy(), np.minimum(np.arange(m), back)
    for _ in range(m.bit_length()):
        if (back[head] == head).all():
            break
        least, head = np.minimum(least, least[head]), head[head]
    circle = back[head] != head
    cut = circle & (least == np.arange(m))
    back[cut] = np.flatnonzero(cut)
    head, far = back.copy(), (back != np.arange(m)).astype(np.int64)
    while (back[head] != head).any():
        far, head = far + far[head], head[head]
    order = np.lexsort((far, head))
    return order, np.flatnonzero(far[order] == 0)


def _edges(mark: Broadcast, bits: int) -> Callable[[Words, np.ndarray], tuple[pa.Array, np.ndarray]]:
    """Compacted paths and corrections of a part, and their weights."""

    def frequent(h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - bits)
        return mark.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

    def of(words: Words, ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        names, width = list(words.number), np.int64(len(words.number))
        pairs, at = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)
        x, y = pairs // width, pairs % width
        node = (x > 0) & (y > 0)
        node[node] = frequent(_pair_hashes(words.hashes(), x[node], y[node]))
        first, second, begun = node[at[:-1]], node[at[1:]], ids[:-2] > 0
        k, n = np.unique(ids[:-2][begun & ~first], return_counts=True)
        said, counts = [names[i] for i in k.tolist()], [n]
        k, n = np.unique(at[:-1][first & ~second], return_counts=True)
        said += [names[i] + b" " + names[j] for i, j in zip(x[k].tolist(), y[k].tolist())]
        counts.append(n)
        both = first & second
        if both.any():
            k, n = np.unique(at[:-1][both] * width + ids[2:][both], return_counts=True)
            a, b, c = x[k // width], y[k // width], k % width
            order, begins = compacted(a, b, c, n)
            last, heads = [names[i] for i in c[order].tolist()], order[begins]
            said += [b" ".join((names[i], names[j], *last[s:t])) for i, j, s, t in zip(a[heads].tolist(), b[heads].tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)])]
            counts.append(n[heads])
        return pa.array(said, pa.binary()).view(pa.string()), np.concatenate(counts)

    return of


def _first(words: int) -> Column:
    return F.substring_index("phrase", " ", words)


def _last(words: int) -> Column:
    return F.substring_index("phrase", " ", -words)


def edges(docs: DataFrame, tables: Tables, least: int = LEAST) -> DataFrame:
    """lang, phrase, n: the edges of the graph, and corrections of one or two words; each word of the texts begins exactly one of the phrases counted."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text <> ''")
    pairs = texts.mapInArrow(lambda batches: _graphs(batches, _pairs, "id"), "lang string, id long, n long")
    often = pairs.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bits, mark = marks(often)
    paths = texts.mapInArrow(lambda batches: _graphs(batches, _edges(mark, bits), "phrase"), "lang string, phrase string, n long")
    w = F.split("phrase", " ")
    triples = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    single = paths.select("lang", "n", F.explode(F.when(F.size(w) > 3, triples).otherwise(F.array("phrase"))).alias("phrase"))
    return tables.keep(single.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each lang."""
    tables = Tables(docs.sparkSession)  # the result reads them
    with Tables(docs.sparkSession) as passing:
        e = edges(docs, passing, least)
        size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
        flow = passing.keep(e.groupBy("lang", _first(2).alias("phrase")).agg(F.sum("n").alias("f")))  # pairs, and words that no frequent pair begins with
        word = passing.keep(flow.groupBy("lang", _first(1).alias("phrase")).agg(F.sum("f").alias("f")))
        triple = e.where((size == 3) & (F.col("n") >= least)).select("lang", "phrase", F.col("n").alias("a"))
        pair = flow.where((size == 2) & (F.col("f") >= least))
        longer = triple.select("lang", "a", F.explode(F.array(_first(2), _last(2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
        held = pair.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest").cast("decimal(20,0)") < share * F.col("f").cast("decimal(20,0)"), F.lit(True)))
        cuts = held.select("lang", "phrase", F.col("f").alias("a"), F.lit(1).alias("k"), _first(1).alias("left"), _last(1).alias("right")).unionAll(
            triple.select("lang", "phrase", "a", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), _first(k).alias("left"), _last(3 - k).alias("right")) for k in (1, 2)])))
        )
        parts = pair.unionAll(word.where(F.col("f") >= least))
        scored = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
        score = F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), l * r)
        best = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
        total = word.groupBy("lang").agg(F.sum("f").alias("n"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        first = best.select("lang", "phrase", "a", "x.*").withColumn("rank", rank).where(F.col("rank") <= top)
        return tables.keep(first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, unnest([k FOR k IN [1, 2, 3] IF i + k - 1 <= len(w)]) AS m, w, i FROM t),
f AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
inside AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3),
longest AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longest x ON c.m = 2 AND c.lang = x.lang AND c.phrase = x.phrase WHERE x.a IS NULL OR 100 * x.a < 50 * c.a),
cuts AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, w FROM kept),
scored AS (SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r,
                  CAST((CAST(u.a AS HUGEINT) * u.a * 1000000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
           FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : u.k], ' ')
                       JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.k + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT x.lang, x.rank, x.phrase, x.a, x.l, x.r, t.n, x.score FROM ranked x JOIN total t ON t.lang = x.lang WHERE x.rank <= 2000
"""
