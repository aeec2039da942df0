"""Near-duplicate classes by Order MinHash.

A text is its sequence of words (runs of letters or digits, lower case). Its k-mers are the runs of five words, each labelled with
its occurrence number in the text; texts of at most 40 words have runs of three, those of at most 10 single words (``KINDS``), and one near such a length both, so that two
texts of allowed lengths always have a kind in common. For each of ``SKETCHES`` hash functions the ``PICK`` = 2 smallest labelled k-mers are
taken and written in the order they have in the text; equal sketches make candidates. Unlike a plain
MinHash, texts that hold the same k-mers in another order seldom agree, so agreement follows edit similarity.

Equal word sequences are one representative before any candidate is made, known by a hash of one of its texts (64 bits: three texts in ten billion might share one). Equal
sketches are a bucket, and a bucket is searched until no pair in it is open: first each representative meets the smallest leader of its buckets, so a group of near copies
costs a pair for each member; then the other leaders, unless they are in one class by now; then all pairs of a bucket's members outside of its largest class with its other members, in tiles
of ``TILE`` by ``TILE``, where lengths and counts of words in ``BINS`` bins show nearly all dissimilar pairs to be so (bounds that lose no similar pair); of the pairs of two classes a few are verified before the rest, for one link closes them all. Pairs are verified by banded alignment: the edit
distance of the two word sequences against what a similarity of 0.8 allows; bounds from the words alone decide most pairs before. Verified links are joined to classes.

Defined results: a text that is null or has no word is alone in its class (class_id is its own doc_id). Rows of the same doc_id are one document, and their texts one class. A row without
doc_id stands alone and has no class_id. Texts of any length are aligned exactly, in memory that grows with the texts alone. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, claim, cut, marks
from .components import components, joined, with_least

PICK = 2
SKETCHES = 80
SIMILAR = 0.8
#: (words of a text at most, words of a k-mer)
KINDS = ((10, 1), (40, 3), (1 << 62, 5))
#: bins that words are counted in, to bound the edit distance of a pair from below, and as many of which are summed up for a first look
BINS, FOLD = 1024, 8
#: members of a bucket on each side of a tile
TILE = 1000
#: pairs of two classes that are verified before the others
FIRST = 16
#: members that one task aligns with a leader's text
SALT_ROWS = 64
_WORD = re.compile(r"[^\W_]+")
_known: dict[str, int] = {}
_rng = np.random.default_rng(20240917)
_MUL = (_rng.integers(0, 2**31, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)


def word_ids(text: str | None) -> np.ndarray:
    """A 64-bit id for each word of a text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    if len(_known) > 150_000:
        _known.clear()
    out = []
    for w in _WORD.findall(text.lower()):
        x = _known.get(w)
        if x is None:
            x = _known[w] = xxhash.xxh64_intdigest(w)
        out.append(x)
    return np.array(out, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words and its occurrence number."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = _mix(h + words[i : n - k + 1 + i])
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
    if len(start) == len(s):
        return _mix(h)
    nth = np.empty(len(h), np.uint64)
    nth[order] = (np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))).astype(np.uint64)
    return _mix(h + nth * np.uint64(0xD6E8FEB86659FD93))


def kinds_of(n: int) -> list[int]:
    """The lengths of the k-mers of a text of n words: its own, and that of shorter texts that may be similar to it."""
    out = []
    for i, (most, k) in enumerate(KINDS):
        if n <= most:
            return [*out, k]
        if int(np.ceil(n * SIMILAR - 1e-9)) <= most:
            out.append(k)
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """The sketches: for each hash function the smallest labelled k-mers, in the order of the text, as one hash."""
    if not len(words):
        return np.empty(0, np.int64)
    return np.concatenate([_sketch(labelled_kmers(words, k), k) for k in kinds_of(len(words))])


def _sketch(h: np.ndarray, k: int) -> np.ndarray:
    pick = min(PICK, len(h))
    at = np.empty((SKETCHES, pick), np.int64)
    low = (h >> np.uint64(32)).astype(np.uint32)
    rows = max(1, 60_000 // len(h))  # so many hash functions at once
    for i in range(0, SKETCHES, rows):
        x = low * _MUL[i : i + rows, None]
        for j in range(pick):
            m = x.argmin(axis=1)
            at[i : i + rows, j] = m
            x[np.arange(len(m)), m] = 0xFFFFFFFF
    at.sort(axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(SKETCHES * k)
    for j in range(pick):
        out = _mix(out + h[at[:, j]])
    return out.astype(np.int64)


def bag(words: np.ndarray) -> bytes:
    """How many words fall in each bin, compressed."""
    n = np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=BINS)
    return zlib.compress(n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes(), 1)


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The edit distance of two sequences, or limit + 1 if it is larger."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    same = min(n, m)
    pre = int(np.argmax(np.append(a[:same] != b[:same], True)))
    a, b = a[pre:], b[pre:]
    same = min(len(a), len(b))
    suf = int(np.argmax(np.append(a[::-1][:same] != b[::-1][:same], True)))
    a, b = a[: len(a) - suf], b[: len(b) - suf]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= limit else limit + 1
    if limit > 400:
        return _edit_diagonals(a, b, limit)
    # Myers' bit vectors: a column of the table at a time, its differences as bits of one number
    equal: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        equal[w] = equal.get(w, 0) | 1 << i
    mask, last, cost = (1 << n) - 1, 1 << (n - 1), n
    up, down = mask, 0
    for left, w in zip(range(m - 1, -1, -1), b.tolist()):
        eq = equal.get(w, 0)
        x = eq | down
        y = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(y | up), up & y
        if more & last:
            cost += 1
        elif less & last:
            cost -= 1
        if cost - left > limit:
            return limit + 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(x | more)) & mask, more & x & mask
    return cost


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, k: np.ndarray) -> None:
    """Move each place i of ``a``, on diagonal k, over the words that agree from there; both texts end in words of their own."""
    act = np.flatnonzero(a[i] == b[i + k])
    for _ in range(16):
        if not len(act):
            return
        i[act] += 1
        at = i[act]
        act = act[a[at] == b[at + k[act]]]
    for x in act.tolist():
        p, q, size = int(i[x]), int(i[x] + k[x]), 64
        while True:
            size = min(size, len(a) - p, len(b) - q)
            off = a[p : p + size] != b[q : q + size]
            step = int(off.argmax())
            if off[step]:
                break
            p, q, size = p + size, q + size, size * 4
        i[x] = p + step


def _edit_diagonals(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """The same for long texts, by the furthest place that each diagonal reaches with one more error: time grows with the square of the distance, memory with the texts."""
    n, m = len(a), len(b)
    ids = np.unique(np.concatenate((a, b)), return_inverse=True)[1].astype(np.int64)
    a, b = np.append(ids[:n], -1), np.append(ids[n:], -2)
    goal, none = m - n, -(1 << 40)
    low, at = 0, np.zeros(1, np.int64)
    _slide(a, b, at, np.zeros(1, np.int64))
    if not goal and at[0] >= n:
        return 0
    for e in range(1, limit + 1):
        left = limit - e  # a diagonal farther than that from the goal cannot come back to it
        lo, hi = max(-e, -n, goal - left), min(e, m, goal + left)
        before = np.full(hi - lo + 3, none)  # diagonals lo - 1 to hi + 1
        first, last = max(low, lo - 1), min(low + len(at) - 1, hi + 1)
        before[first - lo + 1 : last - lo + 2] = at[first - low : last - low + 1]
        k = np.arange(lo, hi + 1)
        at = np.maximum(np.maximum(before[1:-1], before[2:]) + 1, before[:-2])
        np.minimum(at, np.minimum(n, m - k), out=at)
        _slide(a, b, at, k)
        low = lo
        if lo <= goal <= hi and at[goal - lo] >= n:
            return e
    return limit + 1


def _increasing(q: np.ndarray) -> np.ndarray:
    """The places of a longest increasing subsequence."""
    ends: list[int] = []
    who: list[int] = []
    before = np.empty(len(q), np.int64)
    for i, x in enumerate(q.tolist()):
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            who.append(i)
        else:
            ends[k], who[k] = x, i
        before[i] = who[k - 1] if k else -1
    out, i = [], who[-1]
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1])


def upper_bound(a: np.ndarray, b: np.ndarray, once_a: np.ndarray, once_b: np.ndarray) -> int:
    """An edit distance that is surely enough: align the words that occur once in both where they keep the order, and pay for what is between them."""
    order = np.argsort(once_a)
    p, q = once_a[order], once_b[order]
    keep = q == np.maximum.accumulate(q)
    if not keep.all():
        keep = _increasing(q)
    p = np.concatenate(([-1], p[keep], [len(a)]))
    q = np.concatenate(([-1], q[keep], [len(b)]))
    gap_a, gap_b = np.diff(p) - 1, np.diff(q) - 1
    even = (gap_a == gap_b) & (gap_a > 0)
    cost = int(np.maximum(gap_a, gap_b)[~even].sum())
    sizes = gap_a[even]
    if len(sizes):
        ends = np.cumsum(sizes)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        cost += int((a[np.repeat(p[:-1][even] + 1, sizes) + inner] != b[np.repeat(q[:-1][even] + 1, sizes) + inner]).sum())
    return cost


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether 1 - edit distance / longer length is at least ``least``. Words that the other text lacks bound the distance from below, an
    alignment of rare words from above; between the bounds the banded alignment decides."""
    n = max(len(a), len(b))
    limit = int(np.floor((1 - least) * n + 1e-9))
    if abs(len(a) - len(b)) > limit:
        return False
    if len(a) == len(b) and int((a != b).sum()) <= limit:
        return True
    ua, fa, ca = np.unique(a, return_index=True, return_counts=True)
    ub, fb, cb = np.unique(b, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    both = ub[at] == ua
    at = at[both]
    if n - int(np.minimum(ca[both], cb[at]).sum()) > limit:
        return False
    once = (ca[both] == 1) & (cb[at] == 1)
    if upper_bound(a, b, fa[both][once], fb[at][once]) <= limit:
        return True
    return edit_distance(a, b, limit) <= limit


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("omh", _known.clear)
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            b = whole.slice(start, 1000)
            k1, k2, n, sk, bags = [], [], [], [], []
            for text in b.column(2).to_pylist():
                w = word_ids(text)
                n.append(len(w))
                if len(w):
                    d = xxhash.xxh128_intdigest(w.tobytes())
                    k1.append((d >> 64) - (1 << 63))
                    k2.append((d & (1 << 64) - 1) - (1 << 63))
                else:
                    k1.append(None)
                    k2.append(None)
                sk.append(sketch(w))
                bags.append(bag(w) if len(w) else None)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sk]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *sk]))
            columns = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(bags, pa.binary())]
            yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "id", "k1", "k2", "n", "sk", "bag"])


def text_id(column: str = "text") -> Column:
    """What a text is known by."""
    return F.xxhash64(F.col(column), F.lit(11))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, id (of the text), k1, k2 (the word sequence), n words, sk, bag."""
    rows = docs.select("doc_id", text_id().alias("id"), "text")
    return rows.mapInArrow(_sketch_rows, "doc_id long, id long, k1 long, k2 long, n int, sk array<long>, bag binary")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by leader and salt, the leader's text first: lead, salt, kind (0: leader, 1: member), id, text."""
    claim("omh", _known.clear)
    at, own = None, None
    for b in batches:
        leads, members = [], []
        for lead, salt, kind, i, text in zip(*(b.column(k).to_pylist() for k in range(5))):
            if kind == 0:
                if at != (lead, salt):
                    at, own = (lead, salt), word_ids(text)
            elif at == (lead, salt) and similar(own, word_ids(text)):
                leads.append(lead)
                members.append(i)
        yield pa.record_batch([pa.array(members, pa.int64()), pa.array(leads, pa.int64())], ["u", "v"])


def _marked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text: the rows of ``texts`` whose id may be among ``ids`` (met by chance, a text costs only its shuffle), one for each id."""
    bits, shared = marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield b.filter(pa.array(shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0))

    return texts.mapInArrow(run, "id long, text string").groupBy("id").agg(F.first("text").alias("text"))


def _verify(pairs: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (lead, id), a table, whose texts are similar, as links u, v. A leader with many members is dealt out in salts of some ``SALT_ROWS``."""
    size = pairs.count()
    if not size:
        return pairs.select(F.col("id").alias("u"), F.col("lead").alias("v"))
    counts = pairs.groupBy("lead").agg(F.count("*").alias("of")).where(F.col("of") > SALT_ROWS)
    share = max(SALT_ROWS, size // 50_000)
    large = F.broadcast(counts.where(F.col("of") > share))  # 50,000 rows at most
    salts = F.ceil(F.coalesce("of", F.lit(1)) / SALT_ROWS).cast("long")
    salted = tables.keep(pairs.join(large, "lead", "left").select("lead", "id", F.pmod(F.xxhash64("id", F.lit(5)), salts).cast("int").alias("salt")))
    asked = salted.select("lead", "salt", F.lit(1).alias("kind"), "id").unionAll(salted.select("lead", "salt").distinct().select("lead", "salt", F.lit(0).alias("kind"), F.col("lead").alias("id")))
    rows = asked.join(_marked(texts, asked), "id").select("lead", "salt", "kind", "id", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "lead", "salt").sortWithinPartitions("lead", "salt", "kind", "id")
    return tables.keep(dealt.mapInArrow(_aligned, "u long, v long"))


def _bins(b: bytes) -> np.ndarray:
    b = zlib.decompress(b)
    return np.frombuffer(b, np.uint8 if len(b) == BINS else np.uint32)


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and tile: bucket, l, r, side (1: left, 2: right; 4: outside of the largest class, as all on the right are), id, lead, comp, n, bag, earlier (the smaller ones of
    the text's buckets). Pairs across the sides that may be similar, with their classes: each in one direction, and only in the first bucket that both are in."""
    seen: set[tuple[int, int, int, int]] = set()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*seen)) or [[]] * 4
        seen.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["lead", "id", "a", "b"])

    def pair(rows: list[tuple]) -> None:
        if len(rows) < 2:
            return
        side, ids, lead, comp, n = (np.array(c, np.int64) for c in list(zip(*rows))[:5])
        bags = np.stack([_bins(x[5]) for x in rows])
        coarse = bags.reshape(len(rows), -1, FOLD).sum(axis=2, dtype=np.uint32)
        coarse = coarse.astype(np.uint16) if coarse.max() < 65_536 else coarse
        at = np.flatnonzero(side & 2)
        ri, rc, rn, rb, rcoarse = ids[at], comp[at], n[at], bags[at], coarse[at]
        earlier = [set(x[6]) for x in rows]
        for i in np.flatnonzero(side & 1).tolist():
            fit = (rc != comp[i]) & (np.minimum(ri, ids[i]) != lead[i])
            k = np.flatnonzero(fit & (ri > ids[i]) if side[i] & 4 else fit)
            longer = np.maximum(rn[k], n[i])
            limit = np.floor((1 - SIMILAR) * longer + 1e-9)
            near = np.abs(rn[k] - n[i]) <= limit
            k, longer, limit = k[near], longer[near], limit[near]
            for mine, theirs in ((coarse[i], rcoarse), (bags[i], rb)):
                near = longer - np.minimum(theirs[k], mine).sum(axis=1, dtype=np.int64) <= limit
                k, longer, limit = k[near], longer[near], limit[near]
            k = k[[earlier[i].isdisjoint(earlier[j]) for j in at[k].tolist()]] if len(k) else k
            seen.update((min(x, ids[i]), max(x, ids[i]), min(y, comp[i]), max(y, comp[i])) for x, y in zip(ri[k].tolist(), rc[k].tolist()))

    own, rows = None, []
    for b in batches:
        ends = b.column(9).offsets.to_numpy()
        smaller = b.column(9).values.to_numpy()
        for row in zip(*(b.column(k).to_pylist() for k in range(9)), (smaller[x:y].tolist() for x, y in zip(ends, ends[1:]))):
            if row[:3] != own:
                pair(rows)
                own, rows = row[:3], []
                if len(seen) > 100_000:
                    yield flush()
            rows.append(row[3:])
    pair(rows)
    yield flush()


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lead, id, and each one's number of words and bag."""
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
        longer = np.maximum(n, m)
        limit = np.floor((1 - SIMILAR) * longer + 1e-9)
        keep = np.abs(n - m) <= limit
        x, y = b.column(3), b.column(5)
        for i in np.flatnonzero(keep).tolist():
            keep[i] = longer[i] - int(np.minimum(_bins(x[i].as_py()), _bins(y[i].as_py())).sum(dtype=np.int64)) <= limit[i]
        yield b.select(["lead", "id"]).filter(pa.array(keep))


def _worth(pairs: DataFrame, reps: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (lead, id) that lengths and bags do not show to be dissimilar."""
    other = reps.select(F.col("id").alias("lead"), F.col("n").alias("m"), F.col("bag").alias("bag_m"))
    rows = pairs.join(reps, "id").join(other, "lead").select("lead", "id", "n", "bag", "m", "bag_m")
    return tables.keep(rows.mapInArrow(_may_be_similar, "lead long, id long"))


def _across(met: DataFrame, top: DataFrame, reps: DataFrame, done: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (lead, id, and their classes a, b) of each bucket that are not in one class yet, may be similar and are not ``done``. ``met``: bucket, id, lead; ``top``: id, comp;
    ``reps``: id, n, bag. One side of the tiles is all members, the other those outside the bucket's largest class, which need no pair among themselves."""
    own = tables.keep(met.join(top, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    parts = own.groupBy("bucket", "comp").agg(F.count("*").alias("of"))
    sizes = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("of", "comp")).alias("main"), F.max("of").alias("most"), F.sum("of").alias("all"))
    groups = lambda n: F.ceil(F.expr(n) / TILE).cast("int")
    sizes = tables.keep(sizes.where("most < all and all > 2").select("bucket", "main", groups("all").alias("gl"), groups("all - most").alias("gr")))
    place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    rows = own.join(sizes, "bucket").select("bucket", "id", "lead", "comp", (F.col("comp") != F.col("main")).alias("out"), "gl", "gr", place(6, "gl").alias("pl"), place(7, "gr").alias("pr"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = F.transform(every("gr"), lambda r: F.struct(F.col("pl").alias("l"), r.alias("r"), F.when(F.col("out") & (r == F.col("pr")), 7).when(F.col("out"), 5).otherwise(1).alias("side")))
    right = F.filter(F.transform(every("gl"), lambda x: F.struct(x.alias("l"), F.col("pr").alias("r"), F.lit(6).alias("side"))), lambda t: F.col("out") & (t["l"] != F.col("pl")))
    place_of = rows.select("id", "comp", F.struct("bucket", "lead", F.concat(left, right).alias("tiles")).alias("at"))
    held = place_of.groupBy("id", "comp").agg(F.collect_list("at").alias("at")).join(reps, "id")  # a place for each sketch of a text at most
    placed = held.select("id", "comp", "n", "bag", F.col("at.bucket").alias("buckets"), F.explode("at").alias("at")).withColumn("earlier", F.filter("buckets", lambda x: x < F.col("at.bucket")))
    tiles = placed.select("*", F.explode("at.tiles").alias("t")).select("at.bucket", "t.l", "t.r", "t.side", "id", "at.lead", "comp", "n", "bag", "earlier")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "bucket", "l", "r").sortWithinPartitions("bucket", "l", "r")
    return tables.keep(dealt.mapInArrow(_open_pairs, "lead long, id long, a long, b long").join(done, ["lead", "id"], "left_anti"))


def _meetings(reps: DataFrame, tables: Tables) -> DataFrame:
    """bucket, id, lead: the members of each bucket of two or more, and the smallest of them. A bitmap keeps most sketches that no other text has from being sent again."""
    bits, shared = marks(reps.select(F.explode("sk").alias("id")).groupBy("id").count().where("count > 1").select("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk = b.column(1)
            bucket, id_ = sk.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), np.diff(sk.offsets.to_numpy()))
            at = bucket.view(np.uint64) >> np.uint64(64 - bits)
            keep = shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0
            yield pa.record_batch([pa.array(id_[keep]), pa.array(bucket[keep])], ["id", "bucket"])

    rows = tables.keep(reps.select("id", "sk").mapInArrow(run, "id long, bucket long"))
    return tables.keep(with_least(rows, "bucket", "id", "lead", tables, above=1).select("bucket", "id", "lead"))


def _mixed(met: DataFrame, top: DataFrame, tables: Tables) -> DataFrame:
    """The rows of ``met`` (bucket, id, lead) whose bucket holds members of several classes; ``top``: id, comp. In the other buckets no pair is open."""
    own = tables.keep(met.join(top, "id", "left").select("bucket", "id", "lead", F.coalesce("comp", "id").alias("comp")))
    several = own.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("bucket")
    return own.join(several, "bucket", "left_semi").select("bucket", "id", "lead")


def _apart(pairs: DataFrame, top: DataFrame) -> DataFrame:
    """The pairs (lead, id) that are not in one class."""
    both = pairs.join(top, "id", "left").join(top.withColumnsRenamed({"id": "lead", "comp": "other"}), "lead", "left")
    return both.where("coalesce(comp, id) <> coalesce(other, lead)").select("lead", "id")


def _some_of_each(pairs: DataFrame) -> DataFrame:
    """``FIRST`` pairs of each two classes a, b: one link joins them, and their other pairs need no verification then."""
    order = Window.partitionBy("a", "b").orderBy(F.xxhash64("lead", "id"))
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST).select("lead", "id")


def _still_apart(pairs: DataFrame, top: DataFrame) -> DataFrame:
    """The pairs (lead, id) whose classes a, b were not joined since; each two classes are looked up once."""
    two = pairs.select("a", "b").distinct().join(top.withColumnsRenamed({"id": "a", "comp": "x"}), "a", "left").join(top.withColumnsRenamed({"id": "b", "comp": "y"}), "b", "left")
    return pairs.join(two.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b"), ["a", "b"]).select("lead", "id")


def _links(reps: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """u, v: similar representatives u and the smallest v of their class; ``reps``: id, n, sk, bag."""
    texts, known = docs.select(text_id().alias("id"), "text"), reps.select("id", "n", "bag")
    met = _meetings(reps, tables)
    own = lambda top: top.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    first = tables.keep(met.where("id <> lead").groupBy("id").agg(F.min("lead").alias("lead")).select("lead", "id"))
    top = components(_verify(_worth(first, known, tables), texts, tables), tables)
    more = tables.keep(_mixed(met, own(top), tables).where("id <> lead").select("lead", "id").distinct().join(first, ["lead", "id"], "left_anti"))
    left = tables.keep(_apart(more, own(top)))
    top = joined(top, _verify(_worth(left, known, tables), texts, tables), tables)
    open_ = _across(met, own(top), known, first.unionAll(left), tables)
    few = tables.keep(_some_of_each(open_))
    top = joined(top, _verify(few, texts, tables), tables)
    left = tables.keep(_still_apart(open_, own(top)).join(few, ["lead", "id"], "left_anti"))
    return joined(top, _verify(left, texts, tables), tables)


def _of_one_document(of: DataFrame, tables: Tables) -> DataFrame:
    """Links u, v from the texts of a doc_id to the smallest of them; ``of``: doc_id, rep."""
    several = of.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1").select("doc_id", "v")
    several = tables.keep(several)
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("u"), "v")
    rows = with_least(of.where("rep is not null"), "doc_id", "rep", "least", tables, above=1).where("rep <> least")
    return tables.keep(rows.select(F.col("rep").alias("u"), F.col("least").alias("v")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_words: a row for each distinct doc_id, and one for each row without."""
    with Tables(docs.sparkSession) as tables:
        every = tables.keep(sketches(docs))
        sk = every.where("doc_id is not null")
        said = sk.where("k1 is not null").groupBy("k1", "k2")
        reps = tables.keep(said.agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.first("bag").alias("bag")))
        of = tables.keep(sk.select("doc_id", "k1", "k2", "n").join(reps.select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"], "left").groupBy("doc_id", "rep").agg(F.max("n").alias("n")))
        same = _of_one_document(of, tables)
        top = joined(_links(reps, docs, tables), same, tables).select(F.col("u").alias("id"), F.col("v").alias("comp"))
        own = tables.keep(reps.select("id", "doc_id").join(top, "id", "left").select("id", "doc_id", F.coalesce("comp", "id").alias("comp")))
        classes = with_least(own, "comp", "doc_id", "class_id", tables).select(F.col("id").alias("rep"), "class_id")
        out = of.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n").alias("n_words")).join(classes, "rep", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_words")
        alone = every.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.col("n").alias("n_words"))
        return cut(out.unionAll(alone))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class stays, that with the smallest doc_id, and rows without doc_id; the columns stay as they were."""
    kept = near_duplicates(docs).where("doc_id = class_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
