"""Language identification by rank-order n-gram profiles (out-of-place distance).

A language's profile is the list of its most frequent letter n-grams (n = 1 to 3, words padded with a boundary mark),
most frequent first. A document is ranked the same way over its whole text, and the out-of-place distance to each profile
sums the differences of rank; an n-gram that the profile lacks costs the profile's length.

Defined results: a null text, an empty one or one without letters is predicted ``und`` with score 0. Equal distances go to the
alphabetically first language; equal n-gram counts rank by code point. Repeated rows are scored alike. An empty table gives
an empty result; with no labelled row at all every text is ``und``. Columns of the input other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, with_fields

#: n-grams of a profile, and of a document's ranking
PROFILE = 400
TOP = 300
#: labelled documents of a language that its profile is fitted on, in expectation
SAMPLE = 3000
_BITS = 21
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_codes(text: str | None) -> np.ndarray:
    """The codes of all n-grams of a text: three code points of 21 bits; 0 is the word boundary, a shorter n-gram starts with a mark."""
    if not text:
        return np.empty(0, np.int64)
    s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.concatenate(([0], np.where(letter_table()[s], s, 0), [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    if len(s) < 3:
        return np.empty(0, np.int64)
    one = s[s != 0] | (0x1FFFFE << 2 * _BITS)
    two = (0x1FFFFF << 2 * _BITS) | (s[:-1] << _BITS) | s[1:]
    mid = s[1:-1] != 0
    three = ((s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:])[mid]
    return np.concatenate((one, two, three))


def gram_ranking(text: str | None, top: int = TOP) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first."""
    grams, counts = np.unique(gram_codes(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:top]]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200))
    for b in parts:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(gram_codes(text))
        for lang, codes in by.items():
            g, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit_profiles(docs: DataFrame, profile: int = PROFILE, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles of the labelled languages, learned from ``text`` and ``lang``.

    Fitted on about ``sample`` rows of each language, chosen by a hash of doc_id and text (copies of one text are not chosen together); smaller languages are taken whole.
    What comes to the driver is ``profile`` codes for each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")
    counts = cut(taken.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = None
    for lang in sorted(sizes):
        top = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(profile)
        best = top if best is None else best.unionAll(top)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        out.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return {lang: [g for _, g in sorted(x)] for lang, x in sorted(out.items())}


class RankModel:
    """Profiles as a matrix of ranks over the n-grams that any of them holds."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.length = max((len(p) for p in profiles.values()), default=0)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        doc = gram_ranking(text)
        if not len(doc) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, doc), len(self.grams) - 1)
        known = self.grams[at] == doc
        rank = self.rank[:, at[known]]
        place = np.arange(len(doc))[known]
        off = np.where(rank < 0, self.length, np.minimum(np.abs(rank - place), self.length)).sum(axis=1) + self.length * int((~known).sum())
        like = 1.0 - off / (self.length * len(doc))
        best = int(np.argmin(off))
        total = float(like.sum())
        return self.langs[best], float(like[best] / total) if total > 0 else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``lang_score``; only ``text`` is an input."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(RankModel(profiles))
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    kept = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            said = [model.predict(t) for t in b.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [*names, "lang_pred", "lang_score"])

    return kept.mapInArrow(run, with_fields(kept.schema, lang_pred="string", lang_score="double"))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from documents whose crc32(doc_id) mod 5 is not 0."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    profiles = fit_profiles(docs.where(~held))
    said = identify(docs.select("doc_id", "text"), profiles)
    return said.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents without those that have no identifiable language; the columns stay as they were."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(RankModel(fit_profiles(docs.where(~held))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.predict(t)[0] != "und" for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
