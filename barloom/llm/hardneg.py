"""Hard negatives from candidate blocks along a Hilbert curve, with zone maps.

Vectors become whole numbers, floor(256 x). Rows are sorted by label and place on a Hilbert curve over the ``AXES`` dimensions of largest variance and packed into blocks of ``BLOCK`` rows, which are written as Parquet;
each block carries a zone map: the least and largest value of every dimension and of the label. Anchors are packed alike, into lots of ``LOT`` that lie near each other.

An anchor has wishes: the first k rows of its own label, or of other labels with a score in a window. Interval arithmetic over a zone map bounds the inner products of an anchor with all rows of a block from both sides, so a block is
read for a wish only if its bounds meet the wish's window. Each wish first reads the one block that promises most; the k-th score found there raises the window's lower end, and then all blocks that still meet it are read.
Positives are one wish an anchor, their windows one wish each. A block meets a lot in one task as two matrices; what leaves it is k rows a wish at most.

Scores are exact: floating point where no sum can pass 2^53, 64-bit integers where none can pass 2^63, else Python's integers, and an error if a score that is returned does not fit in a long.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor do vectors whose length is not the most frequent one (of equally frequent ones the longest). A row with the anchor's own vec_id is never its
positive or negative; other repeated rows count as often as they occur, and each row of a repeated anchor is an anchor. Equal scores go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

EVERY, RELABEL, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
#: rows of a block, anchors of a lot, zone maps that are tested at once
BLOCK, LOT, PAGE = 2_048, 256, 1_024
#: dimensions of the curve, and bits of each
AXES, BITS = 10, 6
_FIRST, _LAST = -(2**63), 2**63 - 1


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve through a grid of 2 ** bits cells a side; ``cells``: a row of whole numbers for each point.
    From the highest bit down, each axis either turns the lower bits of the first one or swaps them with its own; Gray code undone then gives the place bit by bit."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        one = 1 << level
        low = one - 1
        for i in range(n):
            high = x[i] & one != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level) != 0, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | axis >> level & 1
    return place


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (length.d if length else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, lo, hi, n, s, ss: of each dimension of a task's rows, floored."""
    held = None
    for b in batches:
        if b.num_rows:
            q = _matrix(b.column(0), b.column(0).value_lengths()[0].as_py())
            new = np.array([q.min(0), q.max(0), np.full(q.shape[1], len(q)), q.sum(0), (q * q).sum(0)])
            held = new if held is None else np.concatenate((np.minimum(held[:1], new[:1]), np.maximum(held[1:2], new[1:2]), held[2:] + new[2:]))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.shape[1], dtype=np.int32)), *[pa.array(x) for x in held]], ["pos", "lo", "hi", "n", "s", "ss"])


class Grid:
    """The range of each dimension, the axes of the curve and the kind of number that holds a component."""

    def __init__(self, rows: DataFrame):
        of = rows.select("embedding").mapInArrow(_spread, "pos int, lo double, hi double, n double, s double, ss double")
        got = of.groupBy("pos").agg(F.min("lo"), F.max("hi"), F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("pos").collect()  # a row for each dimension
        _, self.lo, self.hi, n, s, ss = np.array([tuple(r) for r in got], float).reshape(-1, 6).T
        self.d = len(got)
        varied = ss / np.maximum(n, 1) - (s / np.maximum(n, 1)) ** 2
        self.axes = np.sort(np.argsort(-varied, kind="stable")[:AXES])
        most = float(np.abs([self.lo, self.hi]).max(initial=0))
        self.kind = np.int16 if most < 2**15 else np.float64
        self.sums = "f" if self.d * most * most < 2**53 else "i" if self.d * most * most < 2**62 else "o"

    def place(self, q: np.ndarray) -> np.ndarray:
        lo, wide = self.lo[self.axes], np.maximum(self.hi - self.lo, 1)[self.axes]
        return hilbert(((q[:, self.axes] - lo) / wide * (2**BITS - 1)).astype(np.int64)) if len(self.axes) else np.zeros(len(q), np.int64)

    def numbers(self, q: np.ndarray) -> np.ndarray:
        """``q`` in the kind of number that products are exact in."""
        return q.astype(np.float64) if self.sums == "f" else q.astype(np.int64) if self.sums == "i" else np.array([[int(v) for v in r] for r in q.tolist()], object).reshape(q.shape)


_PACKED = "part int, no int, label_lo long, label_hi long, lo binary, hi binary, n int, ids binary, labels binary, vectors binary"


def _packed(rows: DataFrame, grid: Grid, of: int) -> DataFrame:
    """Rows in order of label, place on the curve and vec_id, ``of`` at a time: no (unique with part), range of the labels and of each dimension, and the ids, labels and vectors themselves."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column(2), grid.d)
                vectors = pa.array([r.tobytes() for r in q.astype(grid.kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grid.place(q)), vectors], ["vec_id", "label", "place", "vector"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal no
            ids, labels = (t.column(c).to_numpy() for c in ("vec_id", "label"))
            raw = b"".join(t.column("vector").to_pylist())
            q = np.frombuffer(raw, grid.kind).reshape(len(ids), grid.d)
            row = [part, no, labels.min(), labels.max(), q.min(0).tobytes(), q.max(0).tobytes(), len(ids), ids.tobytes(), labels.tobytes(), raw]
            no += 1
            names = [f.split()[0] for f in _PACKED.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[f.split()[1]]) for v, f in zip(row, _PACKED.split(", "))], names)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= of:
                t = pa.Table.from_batches(held)
                while t.num_rows >= of:
                    yield block(t.slice(0, of))
                    t = t.slice(of)
                held, size = t.to_batches(), t.num_rows
        if size:
            yield block(pa.Table.from_batches(held))

    order = ["label", "place", "vec_id"]
    spread = rows.mapInArrow(placed, "vec_id long, label long, place long, vector binary").repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(packed, _PACKED)


def _numbered(packed: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``packed`` as a table with ``name``: a number for each row."""
    return tables.keep(packed.withColumn(name, F.shiftleft(F.col("part").cast("long"), 32) + F.col("no")))


def _bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that a point of each box can have with each anchor."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids, in this order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _visits(lots: DataFrame, pages: DataFrame, n_pages: int, grid: Grid, promising: bool) -> DataFrame:
    """lot, block, wanted (places of wishes): blocks whose bounds meet a wish; ``promising``: for each wish only the one whose rows may score most within the window."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_struct_array():
                wishes = r["wishes"].as_py()
                if not wishes:
                    continue
                at, same, least, most = (np.array([w[c] for w in wishes]) for c in ("at", "same", "least", "most"))
                anchors = grid.numbers(np.frombuffer(r["vectors"].as_py(), grid.kind).reshape(-1, grid.d))
                labels = np.frombuffer(r["labels"].as_py(), np.int64)[at]
                boxes = r["boxes"].as_py()
                lo, hi = (grid.numbers(np.frombuffer(b"".join(x[c] for x in boxes), grid.kind).reshape(-1, grid.d)) for c in ("lo", "hi"))
                first, last = (np.array([x[c] for x in boxes]) for c in ("label_lo", "label_hi"))
                low, high = (x[at] for x in _bounds(anchors, lo, hi))
                mine = (first <= labels[:, None]) & (labels[:, None] <= last)
                other = (first != labels[:, None]) | (last != labels[:, None])
                fits = np.where(same[:, None], mine, other) & (high >= least[:, None]) & (low <= most[:, None])
                if promising:
                    hope = np.where(fits, np.minimum(high, most[:, None]).astype(np.float64), -np.inf)
                    best = hope.argmax(1)
                    w = np.flatnonzero(fits[np.arange(len(at)), best])
                    k, hope = best[w], hope[w, best[w]]
                else:
                    w, k = np.nonzero(fits)
                    hope = np.zeros(len(w))
                if len(w):
                    number = np.array([x["block"] for x in boxes])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), r["lot"].as_py())), pa.array(number[k]), pa.array(w.astype(np.int32)), pa.array(hope)], ["lot", "block", "wish", "hope"])

    each = lots.select("lot", "vectors", "labels", "wishes", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page")).join(pages, "page")
    out = each.select("lot", "vectors", "labels", "wishes", "boxes").mapInArrow(met, "lot long, block long, wish int, hope double")
    if promising:
        out = out.groupBy("lot", "wish").agg(F.max_by("block", F.struct("hope", -F.col("block"))).alias("block"))
    return out.groupBy("lot", "block").agg(F.array_sort(F.collect_set("wish")).alias("wanted"))  # of one lot: LOT x POSITIVES at most


def _found(visits: DataFrame, lots: DataFrame, blocks: DataFrame, grid: Grid, k: int, tables: Tables) -> DataFrame:
    """lot, wish, vec_id, score: the first k of each block for each wish."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_struct_array():
                anchors, rows = (grid.numbers(np.frombuffer(r[c].as_py(), grid.kind).reshape(-1, grid.d)) for c in ("lot_vectors", "vectors"))
                own_ids, own_labels, ids, labels = (np.frombuffer(r[c].as_py(), np.int64) for c in ("lot_ids", "lot_labels", "ids", "labels"))
                wishes, wanted, out = r["wishes"].as_py(), r["wanted"].as_py(), []
                asking = sorted({wishes[w]["at"] for w in wanted})
                scores = dict(zip(asking, anchors[asking] @ rows.T))
                for w in wanted:
                    x = wishes[w]
                    s, a = scores[x["at"]], x["at"]
                    fits = np.flatnonzero(((labels == own_labels[a]) == x["same"]) & (ids != own_ids[a]) & (s >= x["least"]) & (s <= x["most"]))
                    if len(fits):
                        fits = fits[_first(s[fits], ids[fits], k)]
                        out.append((np.full(len(fits), w, np.int32), ids[fits], s[fits]))
                if out:
                    w, i, s = (np.concatenate(c) for c in zip(*out))
                    score = pa.array([int(v) for v in s.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), r["lot"].as_py())), pa.array(w), pa.array(i), score], ["lot", "wish", "vec_id", "score"])

    own = lots.select("lot", F.col("vectors").alias("lot_vectors"), F.col("ids").alias("lot_ids"), F.col("labels").alias("lot_labels"), "wishes")
    both = visits.join(own, "lot").join(blocks.select("block", "ids", "labels", "vectors"), "block")
    columns = ["lot", "wanted", "lot_vectors", "lot_ids", "lot_labels", "wishes", "ids", "labels", "vectors"]
    return tables.keep(both.select(*columns).mapInArrow(hits, "lot long, wish int, vec_id long, score long"))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("lot", "wish").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _granted(lots: DataFrame, pages: DataFrame, n_pages: int, blocks: DataFrame, grid: Grid, k: int, tables: Tables) -> DataFrame:
    """lot, wish, rank, vec_id, score: the first k rows for each wish of each lot."""
    seen = tables.keep(_visits(lots, pages, n_pages, grid, promising=True))
    hits = _found(seen, lots, blocks, grid, k, tables)
    found = _ranked(hits, k).where(F.col("rank") == k).groupBy("lot").agg(F.map_from_arrays(F.collect_list("wish"), F.collect_list("score")).alias("found"))
    raised = F.transform("wishes", lambda w, i: w.withField("least", F.greatest(w["least"], F.coalesce(F.try_element_at("found", i.cast("int")), w["least"]))))
    tighter = tables.keep(lots.join(found, "lot", "left").select("lot", "ids", "labels", "vectors", raised.alias("wishes")))
    done = seen.select("lot", "block", F.col("wanted").alias("seen"))
    rest = _visits(tighter, pages, n_pages, grid, promising=False).join(done, ["lot", "block"], "left")
    rest = rest.select("lot", "block", F.coalesce(F.array_except("wanted", "seen"), "wanted").alias("wanted")).where(F.size("wanted") > 0)
    return tables.keep(_ranked(hits.unionAll(_found(tables.keep(rest), tighter, blocks, grid, k, tables)), k))


def mine(vectors: DataFrame, is_anchor: Column, relabelled: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor``: a condition on vec_id; ``relabelled``: the label to go by."""
    spark = vectors.sparkSession
    kept = Tables(spark)  # the result reads it
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors)
    if relabelled is not None:
        rows = rows.withColumn("label", relabelled.cast("long"))
    with Tables(spark) as tables:
        grid = Grid(rows)
        if not grid.d:
            return spark.createDataFrame([], schema)
        blocks = _numbered(_packed(rows, grid, BLOCK), tables, "block")
        lots = _numbered(_packed(rows.where(is_anchor), grid, LOT), tables, "lot")
        # zone maps alone are read here; a page holds PAGE of them, and goes by number, so that no task counts them all
        zones = blocks.select("block", "label_lo", "label_hi", "lo", "hi")
        n_pages = -(-zones.count() // PAGE)
        pages = tables.keep(zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page")).agg(F.collect_list(F.struct("block", "label_lo", "label_hi", "lo", "hi")).alias("boxes")))

        def wish(at: Column, same: bool, least: Column, most: Column) -> Column:
            return F.struct(at.cast("int").alias("at"), F.lit(same).alias("same"), least.alias("least"), most.alias("most"))

        everything = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: wish(i, True, F.lit(_FIRST).cast("long"), F.lit(_LAST).cast("long")))
        first = tables.keep(lots.select("lot", "ids", "labels", "vectors", everything.alias("wishes")))
        near = _granted(first, pages, n_pages, blocks, grid, positives, tables)
        # low <= 100 s <= high in whole numbers; a negative score has no window
        score = F.col("score").cast("decimal(20,0)")
        least, most = F.ceil(score * LOW / 100).cast("long"), F.floor(score * HIGH / 100).cast("long")
        windows = near.where("score >= 0").withColumn("wish", wish(F.col("wish"), False, least, most)).where(least <= most)
        wants = tables.keep(windows.groupBy("lot").agg(F.array_sort(F.collect_list(F.struct("wish", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("wants")))
        second = tables.keep(lots.join(wants, "lot").select("lot", "ids", "labels", "vectors", F.transform("wants", lambda x: x["wish"]).alias("wishes")))
        hard = _granted(second, pages, n_pages, blocks, grid, negatives, tables)
        named = wants.select("lot", F.posexplode("wants").alias("wish", "x")).select("lot", "wish", F.col("x.wish.at").alias("at"), "x.positive_id", "x.positive_score")
        anchors = lots.select("lot", "n", "ids").mapInArrow(_ids, "lot long, at int, anchor_id long")
        out = hard.join(named, ["lot", "wish"]).join(anchors, ["lot", "at"])
        return kept.keep(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_struct_array():
            ids = np.frombuffer(r["ids"].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["lot"].as_py())), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["lot", "at", "anchor_id"])


def of_embeddings(vectors: DataFrame) -> DataFrame:
    """``mine`` with every 50th vec_id as anchor, and the labels of every 7th moved on by one of ten."""
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % EVERY == 0, moved)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
h AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""
