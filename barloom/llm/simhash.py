"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words at spaces, tabs and line ends, and into overlapping shingles of ``SHINGLE`` words; bit i of its fingerprint
is set if bit i is set in more than half of the shingles' XXH64 hashes. Two fingerprints are linked if at most ``DISTANCE`` = 3 of 64 bits differ.

Candidates: the 64 bits are split into four blocks, so a close pair agrees on one block at least. Each distinct fingerprint goes to one bucket for each block;
a bucket of more than ``BUCKET`` fingerprints splits the bits it has not fixed yet into four blocks again, and its members go on to the buckets of these. No pair is lost on the way: three differing bits
leave one of four blocks alone at every level. Members are distinct, so a bucket with r free bits holds at most 2^r, and splitting ends. Within a bucket all Hamming distances are verified as arrays, and
links that span the bucket's components leave it, at most one for each member, never all pairs.

Defined results: a null text, an empty one and one of white space have the fingerprint zero, which is linked like any other; a text of fewer words than a shingle is one shingle. Equal texts share a class.
component_id is the smallest doc_id that is not null in the component, null if there is none. Every row is returned, repeated rows as often as they occur; extra columns pass through ``near_duplicates``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, own_prefix
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: fingerprints whose distances are verified together
BUCKET = 1_024
#: shingles that are hashed at a time, and rows of a distance matrix
PART, TILE = 65_536, 128

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: bytes | None) -> int:
    """64 bits, unsigned, of a whole text in UTF-8."""
    s = _SPACE.sub(b" ", text or b"").strip(b" ").lower()  # of bytes: A-Z only
    if not s:
        return 0
    gaps = np.flatnonzero(np.frombuffer(s, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(s)]))
    if len(starts) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - SHINGLE + 1], ends[SHINGLE - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), PART):
        h = np.array([digest(s[a:b], SEED) for a, b in zip(starts[i : i + PART].tolist(), ends[i : i + PART].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``column``: the fingerprint of each row's text, as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], [*keep, column])

    own = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    return own.mapInArrow(of, T.StructType([*own.schema.fields[:-1], T.StructField(column, T.LongType())]))


def blocks_of(fixed: int) -> list[int]:
    """``fixed``, a mask of bits, with each of four blocks of the bits that it leaves free."""
    free = [i for i in range(64) if not fixed >> i & 1]
    return [fixed | sum(1 << int(i) for i in part) for part in np.array_split(free, DISTANCE + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(x: np.ndarray) -> list[tuple[int, int]]:
    """Places (root, member) of links that connect what is within ``DISTANCE`` of each other in ``x``, unsigned fingerprints."""
    left, out = np.arange(len(x)), []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            met = np.zeros(len(left), bool)
            for i in range(0, len(front), TILE):
                met |= (np.bitwise_count(x[front[i : i + TILE], None] ^ x[left]) <= DISTANCE).any(0)
            front, left = left[met], left[~met]
            out += [(root, m) for m in front]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        members = b.column(0)
        flat, at = members.flatten().to_numpy(zero_copy_only=False).view(np.uint64), members.offsets.to_numpy()
        u, v = [], []
        for s, e in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()):
            x = flat[s:e]
            if e - s == 2:
                if (int(x[0]) ^ int(x[1])).bit_count() <= DISTANCE:
                    u.append(x[0]), v.append(x[1])
                continue
            if e - s <= TILE and int((np.bitwise_count(x[:, None] ^ x) <= DISTANCE).sum()) == e - s:
                continue  # each is close to itself alone
            for root, m in spanning(x):
                u.append(x[root]), v.append(x[m])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (u, v)], ["u", "v"])


def links(fps: DataFrame, tables: Tables) -> DataFrame:
    """u, v: links that connect all distinct ``fp`` within ``DISTANCE`` of each other. ``fps`` should be a table of distinct fingerprints."""
    spark = fps.sparkSession
    masks, out = blocks_of(0), None
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        # counts of each key meet before the shuffle; the join back is one that adaptive execution can split
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        held = tables.keep(keyed.join(sizes, ["mask", "key"]))
        few = held.where(F.col("n") <= BUCKET).groupBy("mask", "key").agg(F.collect_list("fp").alias("members")).select("members")
        got = tables.keep(few.mapInArrow(_links, "u long, v long"))
        out = got if out is None else out.unionAll(got)
        many = held.where(F.col("n") > BUCKET)
        if many.isEmpty():
            return out
        # four times as many masks at each level, 16,384 at most: at the sixth 8 bits are free, fewer than BUCKET asks for
        deeper = [(m, c) for m in masks for c in blocks_of(m)]
        masks = [c for _, c in deeper]
        step = spark.createDataFrame([(_signed(m), _signed(c)) for m, c in deeper], "mask long, child long")
        rows = many.join(F.broadcast(step), "mask").select("fp", F.col("child").alias("mask"))


def classes(fps: DataFrame, tables: Tables) -> DataFrame:
    """fp, component: the smallest fingerprint (signed) that each of the distinct ``fp`` is connected with."""
    linked = components(links(fps, tables), tables)
    return fps.join(linked.select(F.col("u").alias("fp"), F.col("v").alias("component")), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, and ``fingerprint`` (16 hexadecimal digits), ``component_id`` (which replace columns of these names)."""
    p = own_prefix(docs)
    own = [c for c in docs.columns if c not in ("text", "fingerprint", "component_id")]
    tables = Tables(docs.sparkSession)  # the result reads them, so they stay
    rows = tables.keep(fingerprints(docs, f"{p}fp", *own))
    with Tables(docs.sparkSession) as passing:
        firsts = passing.keep(rows.groupBy(F.col(f"{p}fp").alias("fp")).agg(F.min("doc_id").alias("least")))
        found = passing.keep(classes(firsts.select("fp"), passing))
        least = found.join(firsts, "fp").groupBy("component").agg(F.min("least").alias("least"))
        named = tables.keep(found.join(least, "component").select(F.col("fp").alias(f"{p}fp"), F.col("least").alias(f"{p}least")))
    hexed = F.lower(F.lpad(F.hex(f"{p}fp"), 16, "0"))
    return rows.join(named, f"{p}fp").select(*[F.col(f"`{c}`") for c in own], hexed.alias("fingerprint"), F.col(f"{p}least").alias("component_id"))
