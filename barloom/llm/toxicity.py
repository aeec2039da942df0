"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled texts, share their backoff. Their highest order is that of word pairs: how often a word follows another in the different texts of the class. What
absolute discounting takes from the pairs of a word falls to the words of the class. A word counts once for each different word before it there
(the continuation counts of Kneser-Ney), so copies of a text and phrases repeated in one add nothing. What discounting takes from the words of a class falls to their
stems (a word's first ``STEM`` letters, in ``CELLS`` hashed cells), which are counted alike for the class, and what it takes there to the stems of the whole corpus. Discounts for counts of 1, 2 and more are estimated
from the counts of counts of each class and order. Within a stem the words share by their counts in both classes, so a word seen in neither costs both nearly alike and a rare one is judged by its
relatives. Each class's probabilities sum to 1, those of a word alone and those of a word after any other.

Both log-likelihoods are divided by length; the difference is taken for the whole text and for its passages of ``SPAN`` words, of which the most toxic counts, so that one insult in a long text is not
averaged away; both with the order of pairs and from words on, for pairs of near copies that lie in both classes by chance say little. A logistic curve fitted on labelled texts apart from the counts turns the four differences into a score.

Fitted on about ``SAMPLE`` labelled documents of each class, chosen by a hash of doc_id; all their words and pairs count. The stems of the corpus are counted over all documents. A task holds the words and pairs of the sample and ``CELLS`` cells.

Defined results: a null or empty text, or one without words, has the score of equal likelihoods. Repeated rows score
alike. With only one class among the labels, or none, all scores are 0. Where a doc_id has several labels, the largest counts. Labels without a document
and null labels are ignored; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, claim, crc_mod, cut, small_batches, text_key

SAMPLE = 20_000
STEM = 4
CELLS = 1 << 21
SPAN = 2
#: share of the sampled labels that the counts don't see, for the curve
ASIDE = 0.25
PREDICT = 0.7
#: words whose difference a worker keeps
CACHE = 150_000
#: rows of a batch that a worker gets
ROWS = 1_000
#: characters of the texts that are looked up at once
LOT = 100_000
#: bits of a pair's key that a bitmap knows, so that most pairs the sample lacks are not searched for
BITS = 26
#: 2 ** PARTS tasks pack the pairs for the driver
PARTS = 5
PACKED = pa.schema([("part", pa.int32()), ("size", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w) - (1 << 63)


def cell_of(w: str) -> int:
    return xxhash.xxh64_intdigest(w[:STEM], 7) % CELLS


def _corpus_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _forget()
    by = np.zeros(CELLS, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            seen: Counter[str] = Counter()
            for text in b.column(0).slice(at, 2000).to_pylist():
                seen.update(words_of(text))
            np.add.at(by, np.fromiter(map(cell_of, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
    some = np.flatnonzero(by)
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(by[some])], ["cell", "n"])


def pair_key(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What a pair of word hashes is known by; 0 stands before the first word."""
    x = prev.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prev, word, cell, n0, n1: pairs of words as numbers and how often they stand in texts of each class, some 200,000 at a time summed; 0 before the first word."""
    _forget()
    ids: dict[str, tuple[int, int]] = {}
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        prev, word, cell = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        toxic = np.repeat([x[0] for x in held], [len(x[1]) for x in held])
        held.clear()
        order = np.lexsort((word, prev))
        prev, word, cell, toxic = prev[order], word[order], cell[order], toxic[order]
        start = np.flatnonzero(np.append(True, (prev[1:] != prev[:-1]) | (word[1:] != word[:-1])))
        n1 = np.add.reduceat(toxic, start)
        n0 = np.diff(np.append(start, len(prev))) - n1
        return pa.record_batch([pa.array(prev[start]), pa.array(word[start]), pa.array(cell[start].astype(np.int32)), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], ["prev", "word", "cell", "n0", "n1"])

    size = 0
    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            if not words:
                continue
            for w in set(words).difference(ids):
                ids[w] = word_hash(w), cell_of(w)
            word, cell = np.array([ids[w] for w in words], np.int64).T
            held.append((toxic, np.append(0, word[:-1]), word, cell))
            size += len(words)
            if size > 200_000:
                yield flush()
                size = 0
                if len(ids) > CACHE:
                    ids.clear()
    if held:
        yield flush()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = pair_key(b.column(0).to_numpy(), b.column(1).to_numpy())
        part = (key >> np.uint64(64 - PARTS)).astype(np.int32)
        yield pa.record_batch([pa.array(part), pa.array(key.view(np.int64)), b.column(2), b.column(3)], ["part", "key", "n0", "n1"])


def pack(part: int, key: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A part of all pairs: its number, how many they are, the steps between their sorted keys in as few bytes as the longest takes, and their counts [class, pair]."""
    order = np.argsort(key)
    step = np.diff(key[order], prepend=np.uint64(part << 64 - PARTS))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    n = n[:, order].astype(np.uint8 if n.max() < 256 else np.uint32)
    return part, len(key), step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), zlib.compress(n.tobytes(), 1)


def unpack(part: int, size: int, steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    step = np.zeros((size, 8), np.uint8)
    step[:, : len(steps) // size] = np.frombuffer(steps, np.uint8).reshape(size, -1)
    n = zlib.decompress(counts)
    return np.cumsum(step.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(part << 64 - PARTS), np.frombuffer(n, np.uint8 if len(n) == 2 * size else np.uint32).reshape(2, size)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    part, key, n0, n1 = (rows.column(c).to_numpy() for c in range(4)) if rows.num_rows else [np.empty(0, np.int64)] * 4
    for x in np.unique(part).tolist():
        at = np.flatnonzero(part == x)
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "size", "steps", "counts"), pack(x, key[at].view(np.uint64), np.stack((n0[at], n1[at])))))], PACKED)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more are reduced by, estimated from how many counts of 1, 2, 3 and 4 there are."""
    return _discounts([int((counts == k).sum()) for k in range(1, 5)])


def _discounts(n: list[int]) -> np.ndarray:
    """The same from how many counts of 1, 2, 3 and 4 there are."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = [0.0]
    for k in range(1, 4):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else y
        out.append(float(np.clip(d, 0.05, k - 0.05)))
    return np.array(out)


def discounted(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The shares of the counts less their discounts, and the share that falls to the backoff."""
    counts = counts.astype(np.float64)
    total = counts.sum()
    if not total:
        return counts, 1.0
    left = counts - discounts(counts)[np.minimum(counts, 3).astype(np.int64)]
    return left / total, float(1.0 - left.sum() / total)


@dataclass
class Pairs:
    """The order of pairs of both classes (first axis: ordinary, toxic)."""

    #: all pairs, in the order of their parts
    parts: list[tuple[int, int, bytes, bytes]]
    #: sorted hashes of the words that others follow; how many pairs begin with each, and the share of them that falls to the words. The last place stands for all other words
    before: np.ndarray
    of: np.ndarray
    rest: np.ndarray
    #: [class, count up to 3]
    less: np.ndarray
    #: sorted keys, their counts, and a bitmap of the keys' highest bits, once they are asked for
    opened: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "opened": None}

    def open(self, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``last``: the parts are not needed any more, each goes when it has been read."""
        if self.opened is None:
            size, at = sum(x[1] for x in self.parts), 0
            keys, n, marks = np.empty(size, np.uint64), np.empty((2, size), np.uint8), np.zeros(1 << BITS - 3, np.uint8)
            for k in range(len(self.parts)):  # a part at a time, for workers have little room
                key, counts = unpack(*self.parts[k])
                if last:
                    self.parts[k] = ()
                if counts.dtype.itemsize > n.dtype.itemsize:
                    n = n.astype(counts.dtype)
                keys[at : at + len(key)], n[:, at : at + len(key)] = key, counts
                at += len(key)
                top = key >> np.uint64(64 - BITS)
                byte = (top >> np.uint64(3)).astype(np.int64)
                start = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
                marks[byte[start]] = np.bitwise_or.reduceat(np.uint8(1) << (top & np.uint64(7)).astype(np.uint8), start)
            self.opened = keys, n, marks
        return self.opened

    def place(self, prev: np.ndarray) -> np.ndarray:
        """Where the words ``prev`` (hashes) stand in ``before``."""
        if not len(self.before):
            return np.zeros(len(prev), np.int64)
        at = np.minimum(np.searchsorted(self.before, prev), len(self.before) - 1)
        return np.where(self.before[at] == prev, at, len(self.before))

    def find(self, prev: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs the sample holds, and their counts [class, pair]."""
        key = pair_key(prev, word)
        keys, counts, marks = self.open()
        top = key >> np.uint64(64 - BITS)
        some = np.flatnonzero(marks[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1)
        if not len(some):
            return some, counts[:, :0]
        at = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
        hit = keys[at] == key[some]
        return some[hit], counts[:, at[hit]]

    def probabilities(self, place: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """[class, pair]: of words that have the probabilities ``p`` alone and stand ``n`` times after the words of these places."""
        less = np.stack([self.less[c][np.minimum(n[c], 3)] for c in (0, 1)])
        return self.rest[:, place] * p + (n - less) / np.maximum(self.of[:, place], 1)


def pairs_of(parts: list[tuple[int, int, bytes, bytes]], before: np.ndarray, sums: np.ndarray, of: np.ndarray) -> Pairs:
    """The order of pairs from its parts, the words that others follow with how many of their pairs have a count of 1, 2, and 3 or more and the sum of all
    counts [class, 4, word], and how many counts of 1 to 4 there are [class, 4]."""
    less = np.stack([_discounts(x.tolist()) for x in of])
    at = np.argsort(before)
    sums = sums[:, :, at].astype(np.float64)
    taken = (less[:, 1:, None] * sums[:, :3]).sum(axis=1)
    rest = np.where(sums[:, 3] > 0, taken / np.maximum(sums[:, 3], 1), 1.0)
    other = np.array([[0.0], [0.0]])
    return Pairs(sorted(parts), before[at], np.hstack((sums[:, 3], other)), np.hstack((rest, other + 1)), less)


@dataclass
class Model:
    """Probabilities of both classes (first axis: ordinary, toxic) for the words of the sample and the cells of stems, the order of pairs above them, and the curve."""

    #: sorted hashes of words
    words: np.ndarray
    #: [class, word]
    word_p: np.ndarray
    #: [class, cell]: what a word that the sample lacks has there
    cell_p: np.ndarray
    pairs: Pairs
    curve: tuple[float, ...] = (0.0,) * 5
    #: places of words in ``kept``: their hashes, places in ``pairs.before``, probabilities and differences
    known: dict[str, int] = field(default_factory=dict)
    kept: tuple[np.ndarray, ...] | None = None
    #: its name and broadcast, without the curve, once it has been sent to the workers
    sent: tuple[str, Broadcast] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cell_p": zlib.compress(self.cell_p.tobytes(), 1), "known": {}, "kept": None, "sent": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.cell_p = np.frombuffer(zlib.decompress(self.cell_p), np.float32).reshape(2, CELLS)

    def send(self, docs: DataFrame) -> tuple[str, Broadcast]:
        if self.sent is None:
            self.sent = uuid4().hex, docs.sparkSession.sparkContext.broadcast(self)
        return self.sent

    def probabilities(self, words: list[str]) -> np.ndarray:
        """[class, word]"""
        h = np.fromiter(map(word_hash, words), np.int64, len(words))
        out = self.cell_p[:, np.fromiter(map(cell_of, words), np.int64, len(words))].astype(np.float64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out[:, hit] = self.word_p[:, at[hit]]
        return out

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the words are in ``kept``."""
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if self.kept is None or len(known) + len(new) > len(self.kept[0]):
                known.clear()
                new = list(set(words))
                size = max(CACHE, len(new))
                if self.kept is None or len(self.kept[0]) < size:
                    self.kept = np.empty(size, np.int64), np.empty(size, np.int64), np.empty((2, size)), np.empty(size)
            h, place, p, d = self.kept
            at = slice(len(known), len(known) + len(new))
            h[at] = np.fromiter(map(word_hash, new), np.int64, len(new))
            place[at] = self.pairs.place(h[at])
            p[:, at] = self.probabilities(new)
            d[at] = np.log(p[1, at] / p[0, at])
            known.update(zip(new, range(at.start, at.stop)))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def differences(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihoods (toxic less ordinary) of the words of all texts, none of them empty: alone, and each after the one before it."""
        at = self._places(list(chain.from_iterable(texts)))
        h, place, p, d = self.kept
        first = np.cumsum([0, *map(len, texts[:-1])])
        word, prev, before = h[at], np.append(0, h[at[:-1]]), np.append(0, place[at[:-1]])
        prev[first], before[first] = 0, self.pairs.place(np.zeros(1, np.int64))
        alone = d[at]
        after = alone + np.log(self.pairs.rest[1] / self.pairs.rest[0])[before]
        some, n = self.pairs.find(prev, word)
        q = self.pairs.probabilities(before[some], n, p[:, at[some]])
        after[some] = np.log(q[1] / q[0])
        return alone, after

    def features(self, texts: list[str | None]) -> np.ndarray:
        """[text, 4]: the length-normalised difference over the most toxic passage and over the whole text, by words alone and with the order of pairs."""
        words = [words_of(t) for t in texts]
        out, said = np.zeros((len(texts), 4)), np.flatnonzero([len(w) > 0 for w in words])
        if not len(said):
            return out
        size = np.array([len(words[i]) for i in said])
        first = np.cumsum(size) - size
        end = np.repeat(first + size, size)
        for k, d in zip((0, 2), self.differences([words[i] for i in said])):
            whole = np.add.reduceat(d, first)
            passage = d.copy()
            for x in range(1, SPAN):
                passage[:-x] += d[x:]
            passage[np.arange(len(d)) + SPAN > end] = -np.inf
            out[said, k] = np.where(size > SPAN, np.maximum.reduceat(passage, first), whole) / SPAN
            out[said, k + 1] = whole / size
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.features(texts).T))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lots(texts: Iterable[pa.Scalar]) -> Iterator[list[str | None]]:
    """The texts in lots of some ``LOT`` characters; no more than one lot of a batch is held as Python's strings."""
    own, size = [], 0
    for x in texts:
        t = x.as_py()
        own.append(t)
        size += len(t or "")
        if size > LOT:
            yield own
            own, size = [], 0
    if own:
        yield own


def model_of(word: np.ndarray, cell: np.ndarray, n: np.ndarray, corpus: np.ndarray, pairs: Pairs) -> Model:
    """The model of words (hashes) with their cells and counts ``n`` [class, word], the counts of all cells in the corpus, and the order of pairs."""
    order = np.argsort(word)
    word, cell, n = word[order], cell[order], n[:, order]
    shared = (corpus + 0.5) / (corpus.sum() + 0.5 * CELLS)
    pooled = np.bincount(cell, n.sum(axis=0), CELLS) + 1.0
    within = n.sum(axis=0) / pooled[cell]  # and 1 / pooled for all words of the cell that the sample lacks
    word_p, cell_p = np.empty(n.shape), np.empty((2, CELLS), np.float32)
    for c in (0, 1):
        of_stem, rest = discounted(np.bincount(cell, n[c], CELLS))
        stem = of_stem + rest * shared
        own, rest = discounted(n[c])
        word_p[c] = own + rest * stem[cell] * within
        cell_p[c] = rest * stem / pooled
    return Model(word, word_p, cell_p, pairs)


def _fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    z = np.column_stack((np.ones(len(x)), x))
    mean, scale = z[:, 1:].mean(axis=0), z[:, 1:].std(axis=0) + 1e-9
    z[:, 1:] = (z[:, 1:] - mean) / scale
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[1.0] * x.shape[1]]) * 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge @ w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    b = w[1:] / scale
    return float(w[0] - (b * mean).sum()), *b.tolist()


_held: dict[str, Model | None] = {}


def _forget() -> None:
    """A worker that counts for a new model has no use for the last one."""
    claim("toxicity", _held.clear)
    _held.clear()


def _of_worker(name: str, shared) -> Model | None:
    """The broadcast model, with the differences that this worker keeps between tasks."""
    claim("toxicity", _held.clear)
    if name not in _held:
        _held.clear()
        model = _held[name] = shared.value
        if model:
            model.pairs.open(last=True)
            model.pairs.parts = []
    return _held[name]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of ``labels`` (doc_id, toxic) and the texts of ``docs``; None if one class is missing."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    with Tables(docs.sparkSession) as tables:
        return _fit(docs, own, sizes, sample, tables)


def _pairs(pairs: DataFrame) -> Pairs:
    """The order of pairs from a table of prev, word, n0, n1."""
    n = lambda c, k: F.count_if(F.col(f"n{c}") == k if k < 3 else F.col(f"n{c}") >= 3).alias(f"n{c}{k}")
    sums = pairs.groupBy("prev").agg(*[x for c in (0, 1) for x in (*[n(c, k) for k in (1, 2, 3)], F.sum(f"n{c}").cast("long").alias(f"s{c}"))]).toArrow()
    of = pairs.agg(*[F.count_if(F.col(f"n{c}") == k) for c in (0, 1) for k in range(1, 5)]).first()
    keyed = pairs.select("prev", "word", "n0", "n1").mapInArrow(_keyed, "part int, key long, n0 int, n1 int").repartitionById(1 << PARTS, "part")
    parts = [tuple(r) for r in keyed.mapInArrow(_packed, "part int, size long, steps binary, counts binary").collect()]
    numbers = lambda t, *names: np.stack([t.column(x).to_numpy() for x in names])
    by = np.stack([numbers(sums, *[f"n{c}{k}" for k in (1, 2, 3)], f"s{c}") for c in (0, 1)])
    return pairs_of([(p, n, bytes(x), bytes(y)) for p, n, x, y in parts], sums.column("prev").to_numpy(), by, np.array(of).reshape(2, 4))


def _fit(docs: DataFrame, own: DataFrame, sizes: dict[int, int], sample: int, tables: Tables) -> Model:
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    taken = own.where(draw < share).select("doc_id", "toxic")
    aside = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1_000_000)) < int(ASIDE * 1_000_000)  # copies of a text are on one side
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("toxic", aside.alias("aside"), "text")  # at most about 2 * sample rows of two numbers
    rows = tables.keep(rows)
    counted = rows.where("not aside").groupBy("toxic", *text_key()).agg(F.first("text").alias("text")).select("toxic", "text")
    found = counted.mapInArrow(_class_pairs, "prev long, word long, cell int, n0 long, n1 long").groupBy("prev", "word", "cell")
    pairs = tables.keep(found.agg(*[F.sum(f"n{c}").cast("int").alias(f"n{c}") for c in (0, 1)]))
    words = pairs.groupBy("word", "cell").agg(*[F.count_if(F.col(f"n{c}") > 0).alias(f"n{c}") for c in (0, 1)]).toArrow()
    above = _pairs(pairs)
    cells = docs.select("text").mapInArrow(_corpus_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    corpus = np.zeros(CELLS, np.int64)
    corpus[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = np.stack([words.column(f"n{c}").to_numpy() for c in (0, 1)])
    model = model_of(words.column("word").to_numpy(), words.column("cell").to_numpy().astype(np.int64), counts, corpus, above)
    name, held = model.send(docs)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _of_worker(name, held)
        for b in batches:
            f = np.concatenate([np.empty((0, 4)), *[m.features(x) for x in lots(b.column(1))]])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in f.T.copy()]], ["toxic", *names])

    names = ["x", "y", "pair_x", "pair_y"]
    got = rows.where("aside").select("toxic", "text").mapInArrow(differences, "toxic int, x double, y double, pair_x double, pair_y double").toPandas().sort_values(["toxic", *names])
    model.curve = _fit_curve(got[names].to_numpy(), got["toxic"].to_numpy(np.float64)) if got["toxic"].nunique() == 2 else (-4.0, 1.0, 0.0, 0.0, 0.0)
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = PREDICT) -> DataFrame:
    """doc_id, score, predicted of every row; only ``text`` is an input."""
    name, shared = model.send(docs) if model else ("", None)
    curve = model.curve if model else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _of_worker(name, shared) if shared else None
        if m:
            m.curve = curve
        for b in batches:
            s = np.concatenate([np.empty(0), *[m.scores(x) for x in lots(b.column(1))]]) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
            b = None  # its texts go before the next batch is read
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of documents whose crc32(doc_id) mod 3 is 1 are not learned from."""
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    with small_batches(docs.sparkSession, ROWS):
        return cut(score(docs, fit(docs, labels.where(~held))).select("doc_id", held.alias("held_out"), "score", "predicted"))
