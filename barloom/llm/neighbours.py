"""Approximate nearest neighbours by cosine, over stable random projections and kd-trees.

Vectors are scaled to length 1, so the nearest by Euclidean distance are those of largest cosine, and projected to ``DIMS`` = 8 Gaussian
(2-stable) directions. For a pair at distance d the squared projected distance divided by d squared follows a chi-square law of 8
degrees of freedom. A kd-tree of the projections, fitted on at most ``SAMPLE`` rows, deals all rows into cells; a cell of more than ``SHARD`` rows is dealt on into shards by a hash. Each shard
has a kd-tree of its own, built once a round. A query takes up leaves in the order of projected distance
and verifies their points on the original vectors, until the chi-square test holds: a point not yet seen that were closer than the
present k-th would with probability ``SURE`` have been projected nearer than the frontier.

Queries go to shards in three rounds: the query's own shard; the other shards of its cell and the ``NEAR`` nearest cells; the cells that are left. From the second on a query brings its present k-th cosine, and a cell
whose box fails the chi-square test against it is not visited. A shard's points and then its queries stream through one task, in blocks of at most some ``BLOCK`` queries.

Of rows with the same vector only the k + 1 of smallest vec_id are indexed: the others can be no one's neighbours, by the rule for ties. All rows of the query set are queries.

Defined results: vectors that are null, empty, zero or hold a null or a component that is not finite take no part, nor do rows without vec_id. Vectors of different dimensions are not compared:
a query's candidates are those of its own. Equal cosines go to the smaller vec_id. Rows of equal vec_id and vector count once; of rows that share a vec_id with different vectors the first in the
order of components counts. With fewer candidates than k all are returned. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut

DIMS = 8
SURE = 0.6
SHARD = 16_384
SAMPLE = 65_536
#: sampled rows that a cell holds at least
SAMPLE_LEAF = 8
NEAR = 8
BLOCK = 8_192
LEAF = 32
#: leaves taken up between two tests
STEP = 8
EVERY = 50
K = 5


@cache
def projection(size: int, dims: int = DIMS, seed: int = 20240917) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dims))


def chi_square(x: float, dims: int = DIMS) -> float:
    """The distribution function of the chi-square law for an even number of degrees of freedom."""
    if math.isinf(x):
        return 1.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: the same cosines, without over- or underflow."""
    top = np.abs(vectors).max(axis=1)
    return np.ldexp(vectors, -np.frexp(top)[1][:, None])


def projected(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ projection(v.shape[1])


def _split(proj: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float] | None:
    """The rows below and not below the median of the widest direction; None if all are alike."""
    p = proj[rows]
    spread = p.max(axis=0) - p.min(axis=0)
    axis = int(np.argmax(spread))
    if not spread[axis]:
        return None
    at = float(np.median(p[:, axis]))
    if not (p[:, axis] < at).any():
        at = float(p[p[:, axis] > at, axis].min())
    low = p[:, axis] < at
    return rows[low], rows[~low], axis, at


class Cells:
    """The top of the kd-tree: for each dimension of vectors the splits that deal rows into numbered cells."""

    def __init__(self, samples: dict[int, np.ndarray], share: float):
        self.nodes: dict[int, list[tuple[int, float, int, int]]] = {}
        n = 0
        for size, proj in sorted(samples.items()):
            nodes: list[tuple[int, float, int, int]] = []
            todo = [(np.arange(len(proj)), -1, 0)]
            while todo:
                rows, above, side = todo.pop()
                got = _split(proj, rows) if len(rows) > max(SHARD * share, 2 * SAMPLE_LEAF) else None
                here = len(nodes) if got else -1 - n  # a leaf is -1 - its number
                if got:
                    nodes.append((got[2], got[3], 0, 0))
                    todo += [(got[0], here, 2), (got[1], here, 3)]
                else:
                    n += 1
                if above >= 0:
                    node = list(nodes[above])
                    node[side] = here
                    nodes[above] = tuple(node)
                elif not got:
                    nodes.append((0, math.inf, here, here))
            self.nodes[size] = nodes

    def of(self, size: int, proj: np.ndarray) -> np.ndarray:
        """The cell of each row; vectors of a dimension that the sample lacks are one cell."""
        nodes = self.nodes.get(size)
        if nodes is None:
            return np.full(len(proj), -size, np.int64)
        at = np.zeros(len(proj), np.int64)
        live = np.arange(len(proj))
        table = np.array(nodes)
        while len(live):
            axis, value = table[at[live], 0].astype(np.int64), table[at[live], 1]
            at[live] = np.where(proj[live, axis] < value, table[at[live], 2], table[at[live], 3]).astype(np.int64)
            live = live[at[live] >= 0]
        return -1 - at


class Tree:
    """A kd-tree over the projections of a shard's vectors: leaves of at most LEAF points, with the box that each fills."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = scaled(vectors)
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        proj = (vectors / norm[:, None]) @ projection(vectors.shape[1])
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(ids))] if len(ids) else []
        while todo:
            rows = todo.pop()
            got = _split(proj, rows) if len(rows) > LEAF else None
            if got:
                todo += [got[0], got[1]]
            else:
                leaves.append(rows)
        order = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
        self.ids, self.raw, self.norm, self.proj = ids[order], vectors[order], norm[order], proj[order]
        self.ends = np.cumsum([len(x) for x in leaves], dtype=np.int64)
        self.low = np.array([proj[x].min(axis=0) for x in leaves])
        self.high = np.array([proj[x].max(axis=0) for x in leaves])

    def search(self, own: int, vector: np.ndarray, k: int, least: float = -2.0, sure: float = SURE) -> tuple[list[tuple[float, int]], int]:
        """(cosine, vec_id) of the k nearest found of those with a cosine of ``least`` or more, nearest first, and how many points were verified."""
        best: list[tuple[float, int]] = []
        if not len(self.ids):
            return best, 0
        vector = scaled(vector[None])[0]
        norm = math.sqrt(float((vector * vector).sum()))
        q = (vector / norm) @ projection(len(vector))
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        near = (gap * gap).sum(axis=1)
        order, done = np.argsort(near, kind="stable"), 0
        for i in range(0, len(order), STEP):
            if least > -2.0 and passes(float(near[order[i]]), least, sure):
                break
            leaves = order[i : i + STEP]
            rows = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in leaves.tolist()])
            done += len(rows)
            cos = (self.raw[rows] * vector).sum(axis=1) / (self.norm[rows] * norm)
            may = np.flatnonzero(cos >= least)
            if len(may) > 4 * k:  # ties with the k-th of them stay
                may = may[cos[may] >= np.partition(cos[may], -k - 1)[-k - 1]]
            best += [(float(cos[j]), int(self.ids[rows[j]])) for j in may if self.ids[rows[j]] != own]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
            if len(best) == k:
                least = max(least, best[-1][0])
        return best, done


def passes(frontier: float, cosine: float, sure: float = SURE) -> bool:
    """The chi-square test: whether a point as near as ``cosine`` would likely have been projected nearer than the frontier (a squared distance)."""
    far = max(2.0 - 2.0 * cosine, 0.0)
    return frontier > 0 and (far == 0 or chi_square(frontier / far) >= sure)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: a row for each vec_id whose vector takes part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _lists(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length among the lists: the length, which rows have it, and these rows as a matrix."""
    ends = column.offsets.to_numpy()
    sizes, flat = np.diff(ends), column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, flat[ends[at][:, None] + np.arange(size)]


def _located(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, proj = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, DIMS))
            for size, at, v in _lists(b.column(1)):
                proj[at] = projected(v)
                cell[at] = shared.value.of(size, proj[at])
            offsets = pa.array(np.arange(0, DIMS * b.num_rows + 1, DIMS, dtype=np.int32))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.ListArray.from_arrays(offsets, pa.array(proj.ravel()))], ["vec_id", "v", "indexed", "cell", "p"])

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and block, its points first: cell, part, block, kind (0: point, 1: query), id, v, least."""
        own, ids, vectors, tree = None, [], [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(4))))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            out: list[tuple[int, int, float]] = []
            for i, j in zip(starts, [*starts[1:], len(keys)]):
                part = b.slice(i, j - i)
                if keys[i][:3] != own:
                    own, ids, vectors, tree = keys[i][:3], [], [], None
                _, _, v = next(_lists(part.column(5)))
                if keys[i][3] == 0:
                    ids.append(part.column(4).to_numpy())
                    vectors.append(v)
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(vectors) if vectors else np.empty((0, v.shape[1])))
                    ids, vectors = [], []
                for q, x, least in zip(part.column(4).to_pylist(), v, part.column(6).to_pylist()):
                    out += [(q, i, s) for s, i in tree.search(q, x, k, least)[0]]
            yield pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


class _Boxes:
    """The cells of each dimension, with the box of their projections and their number of shards."""

    def __init__(self, rows: list):
        self.own = {r["cell"]: (r["size"], r["parts"]) for r in rows}
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {r["size"] for r in rows}:
            some = [r for r in rows if r["size"] == size]
            self.by_size[size] = tuple(np.array([r[c] for r in some]) for c in ("cell", "low", "high"))

    def order(self, size: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells by their squared distance to a projection, and these distances."""
        cell, low, high = self.by_size[size]
        gap = np.maximum(np.maximum(low - q, q - high), 0.0)
        near = (gap * gap).sum(axis=1)
        at = np.lexsort((cell, near))
        return cell[at], near[at]


def _routed(shared, rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query_id, cell, part of each shard to visit: those of the own cell and the nearest cells, or else the ``rest``. Rows: query_id, size, p, own cell, own part, least."""
        boxes: _Boxes = shared.value
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for q, size, p, cell, part, least in zip(*(b.column(c).to_pylist() for c in range(6))):
                cells, near = boxes.order(size, np.array(p))
                others = [(c, d) for c, d in zip(cells.tolist(), near.tolist()) if c != cell]
                some = others[NEAR:] if rest else [*([(cell, 0.0)] if cell in boxes.own else []), *others[:NEAR]]
                for c, d in some:
                    if least > -2.0 and passes(d, least):
                        continue
                    out += [(q, c, i) for i in range(boxes.own[c][1]) if (c, i) != (cell, part)]
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "cell", "part"])

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` its k nearest found."""
    with Tables(vectors.sparkSession) as tables:
        return _nearest(vectors, k, every, tables)


def _nearest(vectors: DataFrame, k: int, every: int, tables: Tables) -> DataFrame:
    sc = vectors.sparkSession.sparkContext
    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("vec_id")
    rows = usable(vectors)
    indexed = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v", F.lit(True).alias("indexed"))
    rows = tables.keep(indexed.unionAll(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.lit(False).alias("indexed"))))
    n = rows.where("indexed").count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = rows.where("indexed").where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").toArrow()
    samples = {size: projected(v) for size, _, v in _lists(some.column("v").combine_chunks())} if len(some) else {}
    cells = sc.broadcast(Cells(samples, share))
    rows = tables.keep(rows.mapInArrow(_located(cells), "vec_id long, v array<double>, indexed boolean, cell long, p array<double>"))
    ends = [F.array(*[f(F.col("p")[i]) for i in range(DIMS)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    stats = rows.where("indexed").groupBy("cell").agg(F.first(F.size("v")).alias("size"), F.count("*").alias("n"), *ends)
    stats = stats.withColumn("parts", F.ceil(F.col("n") / SHARD).cast("long")).drop("n")
    stats = tables.keep(stats)  # a row for each cell: at most SAMPLE / SAMPLE_LEAF, and one for each dimension that the sample lacks
    boxes = sc.broadcast(_Boxes(stats.collect()))
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = rows.join(F.broadcast(stats.select("cell", "parts")), "cell", "left").select("vec_id", "v", "indexed", "cell", part, "p")
    points = dealt.where("indexed").select("cell", "part", "vec_id", "v")
    asking = tables.keep(dealt.where("not indexed").select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("size"), "p", "cell", "part"))
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def visit(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score: what the shards hold that ``asked`` (query_id, v, cell, part, least) names."""
        sizes = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        left = points.join(sizes, ["cell", "part"]).select("cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(-2.0).alias("least"))
        right = asked.join(sizes, ["cell", "part"]).select("cell", "part", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v", "least")
        both = left.unionAll(right).repartition(partitions, "cell", "part", "block").sortWithinPartitions("cell", "part", "block", "kind")
        return tables.keep(both.mapInArrow(_search(k), "query_id long, vec_id long, score double"))

    found = visit(asking.withColumn("least", F.lit(-2.0)))
    several = stats.agg(F.count("*"), F.sum("parts")).first()
    for rest in (False, True):
        if (several[1] or 0) < 2 or (rest and several[0] <= NEAR + 1):
            continue
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        least = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        now = tables.keep(asking.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))))
        where = now.select("query_id", "size", "p", "cell", "part", "least").mapInArrow(_routed(boxes, rest), "query_id long, cell long, part long")
        found = tables.keep(found.unionAll(visit(tables.keep(where.join(now.select("query_id", "v", "least"), "query_id").select("query_id", "v", "cell", "part", "least")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
