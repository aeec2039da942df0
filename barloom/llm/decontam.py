"""Benchmark decontamination by template canonicalisation.

A text is read as words and numbers; numbers, units after a number and names become typed placeholders, the rest lower case. A name is a capitalised word inside a sentence, or one that opens a sentence and
is not among the common ``OPENERS``; neighbouring names are one. In a text most of whose words are all capitals, capitals mark no names. Each run of ``WINDOW`` = 8 canonical tokens of a benchmark item is hashed (shorter
runs for items of fewer than 16), and joined by hash with the windows of all documents. A bitmap of the benchmark's hashes, of one size for any benchmark, goes to the tasks first, so of the documents only windows that may match
are shuffled.

What an item's windows cover of its tokens within a stretch of a document of at most twice the item's length and ``SLACK`` more is a passage, whatever is inserted in between. It is a leak if it covers
``COVER`` = 0.5 of the item, or ``RUN`` = 32 consecutive tokens of it, and its slots are consistent: where the item repeats a value, the
document repeats whatever it put in its place. If they aren't, only windows without changed slots count.

Defined results: null and empty texts match nothing, nor does a text shorter than its item's window. Items of fewer than 8 tokens have one window, the whole item;
null or empty items have none. Rows of equal item_id and text are one item, rows of equal doc_id and text one document, which reports once. Extra columns pass through ``keep_clean`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, claim, cut, marks, own_prefix

WINDOW = 8
COVER = 0.5
RUN = 32
SLACK = 64
#: leaking documents (8 bytes each) that are at most broadcast to be taken out; more are joined
BROADCAST = 2_000_000
# Unit names, number words, and common words that open sentences.
UNITS = frozenset("""mm cm m km mg g kg t ml l inch inches foot feet yard yards mile miles ounce ounces pound pounds gram grams kilogram kilograms litre litres
liter liters metre metres meter meters kilometre kilometres kilometer kilometers second seconds minute minutes hour hours day days week weeks month months year years
cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts byte bytes kb mb gb""".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
OPENERS = frozenset("""a about after all although an and another any are as at because before both but by can could did do does during each every find for from give had has have he her here his how however i if in
into is it its let many more most much my no not now of on only or other our out over she should since so some such than that the their them then there these they this those to under until up use was we were what when where which
while who whose why will with would you your""".split())
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
_PLAIN, _BREAK, _NUMBER, _TITLE, _OPENER, _UNIT, _CAPITALS = range(7)
_NUM_ID, _UNIT_ID, _NAME_ID = (np.uint64(x << 3) for x in (1, 2, 3))
_known: dict[str, int] = {}


def _code(w: str) -> int:
    """A token's hash with its kind in the lowest three bits."""
    if w in ".!?:\n":
        kind = _BREAK
    elif w[0].isdigit():
        kind = _NUMBER
    else:
        low = w.lower()
        if low in NUMBERS:
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        elif not w[0].isupper():
            kind = _PLAIN
        elif len(w) > 1 and w.isupper():
            kind = _CAPITALS
        else:
            kind = _OPENER if low in OPENERS else _TITLE
    x = _known[w] = xxhash.xxh64_intdigest(w.lower()) & ~7 | kind
    return x


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical token ids, which of them are slots, and what stands there (a hash; for neighbouring names, of all of them)."""
    raw = _TOKEN.findall(text) if text else []
    if len(_known) > 150_000:
        _known.clear()
    get = _known.get
    x = np.array([get(w) or _code(w) for w in raw], np.uint64)
    kind = (x & np.uint64(7)).astype(np.int8)
    value = x & ~np.uint64(7)
    before = np.concatenate(([_BREAK], kind[:-1])) if len(kind) else kind
    capitals = kind == _CAPITALS
    name = (kind == _TITLE) | capitals | ((kind == _OPENER) & (before != _BREAK))
    if 2 * int(capitals.sum()) > int((kind != _BREAK).sum()):
        name = np.zeros(len(x), bool)
    number = kind == _NUMBER
    unit = (kind == _UNIT) & (before == _NUMBER)
    ids = np.where(number, _NUM_ID, np.where(unit, _UNIT_ID, np.where(name, _NAME_ID, value)))
    slot = number | unit | name
    first = kind != _BREAK
    first[1:] &= ~(name[1:] & name[:-1])
    at = np.flatnonzero(first)
    if len(at) and name.any():
        value = np.add.reduceat(np.where(kind == _BREAK, np.uint64(0), value), at)
    else:
        value = value[at]
    return ids[at], slot[at], value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_size(n: int) -> int:
    """The tokens of a window of an item of n tokens."""
    return n if n < WINDOW else WINDOW if n >= 2 * WINDOW else max(WINDOW - 2, n // 2)


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mix(h + ids[i : i + n])
    return h


WINDOWS = "h long, iid long, item_id long, q int, of int, own array<long>, slot array<boolean>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of items: their hash, item, place, how many tokens the item has, what they hold and which are slots."""
    claim("decontam", _known.clear)
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    for b in batches:
        rows = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids, slot, value = canonical(text)
            if not len(ids):
                continue
            size, own = window_size(len(ids)), value.astype(np.int64)
            iid = xxhash.xxh64_intdigest(f"{item}\x00{text}") - (1 << 63)
            for q, h in enumerate(window_hashes(ids, size).astype(np.int64).tolist()):
                rows.append((h, iid, item, q, len(ids), own[q : q + size].tolist(), slot[q : q + size].tolist()))
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _scanner(shared, bits: int, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """uid, doc_id, h, p, put: the windows of documents that may be one of an item; rows: doc_id, uid, text."""
        claim("decontam", _known.clear)
        sieve = shared.value
        for b in batches:
            docs, uids, hashes, places, puts = [], [], [], [], []
            for doc, uid, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                if not text:
                    continue
                ids, _, value = canonical(text)
                for size in sizes:
                    h = window_hashes(ids, size)
                    place = h >> np.uint64(64 - bits)
                    at = np.flatnonzero(sieve[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        docs += [doc] * len(at)
                        uids += [uid] * len(at)
                        hashes += h[at].astype(np.int64).tolist()
                        places += at.tolist()
                        puts += value[at[:, None] + np.arange(size)].astype(np.int64).tolist()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip((uids, docs, hashes, places, puts), kinds)], ["uid", "doc_id", "h", "p", "put"])

    return run


Hit = tuple[int, int, list[int], list[int], list[bool]]


def _best(hits: list[Hit], of: int) -> tuple[int, int, int, int]:
    """The stretch of a document that covers most of an item: covered tokens, the longest run of them, and which hits (from, to). Hits are sorted by place."""
    count, best, low, covered = [0] * of, (0, 0, 0), 0, 0
    for high, (p, q, put, _, _) in enumerate(hits):
        for i in range(q, q + len(put)):
            covered += not count[i]
            count[i] += 1
        while p + len(put) - hits[low][0] > 2 * of + SLACK:
            _, start, x, _, _ = hits[low]
            for i in range(start, start + len(x)):
                count[i] -= 1
                covered -= not count[i]
            low += 1
        if covered > best[0]:
            best = covered, low, high + 1
    most, low, high = best
    held = np.zeros(of + 2, np.int8)
    for _, q, put, _, _ in hits[low:high]:
        held[q + 1 : q + 1 + len(put)] = 1
    return most, int(np.diff(np.flatnonzero(held == 0)).max()) - 1, low, high


def _consistent(hits: list[Hit]) -> tuple[bool, int, int]:
    """Whether each value of the item's slots has one value in the document, how many slots there are, and how many of them changed."""
    put: dict[int, int] = {}
    ok, places, changed = True, set(), set()
    for _, q, there, own, slot in hits:
        for i, is_slot in enumerate(slot):
            if is_slot and q + i not in places:
                places.add(q + i)
                ok &= put.setdefault(own[i], there[i]) == there[i]
                if own[i] != there[i]:
                    changed.add(q + i)
    return ok, len(places), len(changed)


def judge(hits: list[Hit], of: int) -> tuple[float, int, int] | None:
    """Coverage, slots and changed slots of a leak; None if it is none. Hits: place in the document, place in the item, what stands there, what the item has, which are slots; sorted."""
    covered, run, low, high = _best(hits, of)
    ok, slots, changed = _consistent(hits[low:high])
    if not ok:
        covered, run, low, high = _best([x for x in hits if all(a == b for a, b, s in zip(x[2], x[3], x[4]) if s)], of)
        changed = 0
    return (covered / of, slots, changed) if covered >= COVER * of or run >= RUN else None


LEAKS = "uid long, doc_id long, item_id long, coverage double, n_slots int, n_changed int"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by uid and iid: uid, iid, p, q, doc_id, item_id, of, put, own, slot."""
    names = [x.split()[0] for x in LEAKS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    own, hits, out = None, [], []

    def close() -> None:
        if own and (said := judge(hits, own[4])):
            out.append((own[0], own[2], own[3], *said))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * len(names)
        out.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for b in batches:
        for uid, iid, p, q, doc, item, of, *rest in zip(*(b.column(c).to_pylist() for c in range(10))):
            if own is None or own[:2] != (uid, iid):
                close()
                own, hits = (uid, iid, doc, item, of), []
            if not hits or hits[-1][:2] != (p, q):  # rows of one document meet again
                hits.append((p, q, *rest))
        yield flush()
    close()
    yield flush()


def _leaks(docs: DataFrame, benchmark: DataFrame, tables: Tables) -> DataFrame:
    """uid, doc_id, item_id, coverage, n_slots, n_changed."""
    windows = tables.keep(benchmark.where("text is not null").select("item_id", "text").distinct().mapInArrow(_windows, WINDOWS))
    sizes = sorted(r[0] for r in windows.select(F.size("own")).distinct().collect())  # at most WINDOW
    bits, shared = marks(windows.select(F.col("h").alias("id")))
    rows = docs.select("doc_id", uid().alias("uid"), "text")
    found = rows.mapInArrow(_scanner(shared, bits, sizes), "uid long, doc_id long, h long, p int, put array<long>")
    pairs = tables.keep(found).join(windows, "h").where(F.size("put") == F.size("own"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("uid", "iid", "p", "q", "doc_id", "item_id", "of", "put", "own", "slot").repartition(n, "uid", "iid").sortWithinPartitions("uid", "iid", "p", "q")
    return cut(dealt.mapInArrow(_judged, LEAKS))


def uid():
    """What a document is known by."""
    return F.xxhash64("doc_id", "text", F.lit(13))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_slots, n_changed: a row for each document and item that it leaks."""
    with Tables(docs.sparkSession) as tables:
        return _leaks(docs, benchmark, tables).drop("uid")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without leaks; the columns stay as they were."""
    with Tables(docs.sparkSession) as tables:
        own = f"{own_prefix(docs)}uid"
        bad = cut(_leaks(docs, benchmark, tables).select(F.col("uid").alias(own)).distinct())
    few = F.broadcast(bad) if bad.count() <= BROADCAST else bad
    return docs.withColumn(own, uid()).join(few, own, "left_anti").select(*docs.columns)
