"""Recurrences along a series whose parts lie in different tasks.

A kernel is a generator over the arrays of one part of a series. Where it needs what the bars before its part have led to, it yields requests, pairs of a link and a summary of its own part as a few numbers, and is sent the carried
state of each. Summaries compose, so the states that enter all parts of a series follow from a scan over a small table, one row for each part. Spark runs a kernel in rounds: each round replays it with the states
known so far as far as its next request; the last one runs it to its end. A part that holds a whole series is served by the same kernel in one pass (``alone``).

How many rounds a kernel has, and the links of each, must not depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import Any
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import beside, with_fields

#: bars of a part
PART = 65_536


class Link:
    """``carried`` turns the summaries of all parts in order, ``into`` numbers each, into the states that enter them, ``out`` numbers each."""

    into = out = 1

    def carried(self, parts: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Count(Link):
    """How many bars came before."""

    def carried(self, parts: np.ndarray) -> np.ndarray:
        return np.cumsum(parts, axis=0) - parts


class Tail(Link):
    """The last n values before the part, NaN where there are fewer; a summary is the last n of the part, filled up in front by ``MISSING``."""

    MISSING = np.inf

    def __init__(self, n: int):
        self.n = self.into = self.out = n

    def of(self, x: np.ndarray) -> np.ndarray:
        x = x[-self.n :]
        return np.concatenate((np.full(self.n - len(x), self.MISSING), np.where(np.isfinite(x), x, np.nan)))

    def carried(self, parts: np.ndarray) -> np.ndarray:
        held, out = np.full(self.n, np.nan), np.empty_like(parts)
        for k, p in enumerate(parts):
            out[k] = held
            held = np.concatenate((held, p[p != self.MISSING]))[-self.n :]
        return out


class Affine(Link):
    """y = A y + B, begun with 0."""

    into = 2

    def of(self, a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
        a = np.broadcast_to(a, len(b))
        return np.array([a.prod(), affine_scan(a, b, 0.0)[-1]])

    def carried(self, parts: np.ndarray) -> np.ndarray:
        y, out = 0.0, np.empty((len(parts), 1))
        for k, (a, b) in enumerate(parts.tolist()):
            out[k] = y
            y = a * y + b
        return out


class Started(Link):
    """The same, but undefined until a first value stands; a third number is the state that a part leaves if it begins there, NaN if it holds no value."""

    into = 3

    def carried(self, parts: np.ndarray) -> np.ndarray:
        y, out = np.nan, np.empty((len(parts), 1))
        for k, (a, b, s) in enumerate(parts.tolist()):
            out[k] = y
            y = s if np.isnan(y) else a * y + b
        return out


class Mobius(Link):
    """p = (a p + b) / (c p + d), begun with 1."""

    into = 4

    def of(self, each: np.ndarray) -> np.ndarray:
        """The product of the matrices of all bars, the last one leftmost, in log rounds; scaled, as only ratios count."""
        m = each
        while len(m) > 1:
            odd = m[-1:] if len(m) % 2 else m[:0]
            m = m[1 : len(m) - len(odd) : 2] @ m[0 : len(m) - len(odd) : 2]
            m = np.concatenate((m / m.max(axis=(1, 2), keepdims=True), odd))
        return m[0].reshape(-1)

    def carried(self, parts: np.ndarray) -> np.ndarray:
        p, out = 1.0, np.empty((len(parts), 1))
        for k, (a, b, c, d) in enumerate(parts.tolist()):
            out[k] = p
            p = (a * p + b) / (c * p + d)
        return out


class Level(Link):
    """y = A y + B, begun with the first value of the series (third number, NaN if the part has none); also that value, and whether it came before the part."""

    into, out = 3, 3

    def carried(self, parts: np.ndarray) -> np.ndarray:
        there = np.flatnonzero(np.isfinite(parts[:, 2]))
        first = parts[there[0], 2] if len(there) else 0.0
        y, out = first, np.empty((len(parts), 3))
        for k, (a, b, _) in enumerate(parts.tolist()):
            out[k] = y, first, len(there) > 0 and there[0] < k
            y = a * y + b
        return out


Kernel = Generator[list[tuple[Link, np.ndarray]], list[np.ndarray], Any]


def affine_scan(a: np.ndarray | float, b: np.ndarray, first: float) -> np.ndarray:
    """y[t] = a[t] * y[t-1] + b[t] with y[-1] = first, as blocks that advance together."""
    n = len(b)
    if n == 0:
        return np.empty(0)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    aa = np.concatenate((np.broadcast_to(a, n), np.ones(pad))).reshape(blocks, size)
    bb = np.concatenate((b, np.zeros(pad))).reshape(blocks, size)
    held, gain = np.empty((blocks, size)), np.empty((blocks, size))
    y, g = np.zeros(blocks), np.ones(blocks)
    for t in range(size):
        y = aa[:, t] * y + bb[:, t]
        g = g * aa[:, t]
        held[:, t], gain[:, t] = y, g
    carry = np.empty(blocks)
    x = first
    for k in range(blocks):
        carry[k] = x
        x = held[k, -1] + gain[k, -1] * x
    return (held + gain * carry[:, None]).reshape(-1)[:n]


def together(*kernels: Kernel) -> Kernel:
    """Kernels in step: the requests of one round are made at once. Gives the list of their results."""
    out: list[Any] = [None] * len(kernels)
    asked: dict[int, list[tuple[Link, np.ndarray]]] = {}

    def move(i: int, answer: list[np.ndarray] | None) -> None:
        try:
            asked[i] = kernels[i].send(answer)
        except StopIteration as e:
            asked.pop(i, None)
            out[i] = e.value

    for i in range(len(kernels)):
        move(i, None)
    while asked:
        now = list(asked)
        answers = iter((yield [r for i in now for r in asked[i]]))
        for i in now:
            move(i, [next(answers) for _ in asked[i]])
    return out


def alone(kernel: Kernel) -> Any:
    """The result of a kernel over a whole series."""
    answer = None
    while True:
        try:
            asked = kernel.send(answer)
        except StopIteration as e:
            return e.value
        answer = [link.carried(np.asarray(s, float).reshape(1, -1))[0] for link, s in asked]


def rounds(make: Callable[..., Kernel], inputs: int) -> list[list[Link]]:
    """The links of each round, found on two bars."""
    kernel, out, answer = make(*[np.ones(2)] * inputs), [], None
    while True:
        try:
            asked = kernel.send(answer)
        except StopIteration:
            return out
        out.append([link for link, _ in asked])
        answer = [link.carried(np.asarray(s, float).reshape(1, -1))[0] for link, s in asked]


def _replay(kernel: Kernel, links: list[list[Link]], state: np.ndarray) -> Any:
    """The requests that follow the rounds whose states are given, or the result."""
    answer, at = None, 0
    for own in [*links, None]:
        try:
            asked = kernel.send(answer)
        except StopIteration as e:
            return e.value
        if own is None:
            return asked
        answer = []
        for link in own:
            answer.append(state[at : at + link.out])
            at += link.out
    return None


_ARROW = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}


def columns(made: dict[str, np.ndarray], kinds: dict[str, str]) -> list[pa.Array]:
    return [pa.array(made[k].data, _ARROW[t], mask=np.ma.getmaskarray(made[k])) if isinstance(made[k], np.ma.MaskedArray) else pa.array(made[k], _ARROW[t], from_pandas=True) for k, t in kinds.items()]


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) if isinstance(column, pa.Array) else column.combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


#: bounds of frames that are known: one job for a frame, none for what is made of it row by row
_bounds: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def longest(df: DataFrame) -> int:
    """A bound of the bars of any series, from the largest index."""
    if df not in _bounds:
        _bounds[df] = (df.agg(F.max("bar_idx")).first()[0] or 0) + 1
    return _bounds[df]


def part_of(size: int) -> Column:
    return F.floor(F.col("bar_idx") / size).cast("long")


def packed(df: DataFrame, inputs: tuple[str, ...]) -> DataFrame:
    """series_id, _part and an array of each input in the order of bars (bar_idx too): a row for each part of a frame that has ``_part``."""
    rows = F.sort_array(F.collect_list(F.struct("bar_idx", *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(inputs)])))
    out = df.groupBy("series_id", "_part").agg(rows.alias("_rows"))
    return out.select("series_id", "_part", F.col("_rows.bar_idx").alias("_bars"), *[F.col(f"_rows._x{i}").alias(f"_x{i}") for i in range(len(inputs))])


def states(df: DataFrame, make: Callable[..., Kernel], inputs: tuple[str, ...]) -> DataFrame:
    """series_id, _part, _state: the states that enter each part, of all rounds in a row."""
    links = rounds(make, len(inputs))
    parts = packed(df, inputs)
    kind = parts.select("series_id").schema.fields[0].dataType.simpleString()
    schema = f"series_id {kind}, _part long, _state array<double>, _sum array<double>"
    for r, own in enumerate(links):
        work = parts if r == 0 else beside(parts, known, {"series_id": "series_id", "_part": "_part"})
        work = work.select("series_id", "_part", "_state" if r else F.array().cast("array<double>").alias("_state"), *[f"_x{i}" for i in range(len(inputs))])
        # a row for each part of a series meets in one task: a series of 10 ^ 9 bars has some 15,000
        known = work.mapInArrow(_summed(make, links[:r], len(inputs)), schema).groupBy("series_id").applyInArrow(_scanned(own), f"series_id {kind}, _part long, _state array<double>")
    return known


def _summed(make: Callable[..., Kernel], links: list[list[Link]], inputs: int) -> Callable:
    """The summaries that a kernel makes of packed parts after the rounds of ``links``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for i in range(b.num_rows):
                arrays = [numbers(b.column(3 + k)[i].values) for k in range(inputs)]
                asked = _replay(make(*arrays), links, b.column(2)[i].values.to_numpy(zero_copy_only=False))
                sums.append(np.concatenate([np.asarray(s, float).reshape(-1) for _, s in asked]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.list_(pa.float64()))], ["series_id", "_part", "_state", "_sum"])

    return run


def _scanned(links: list[Link]) -> Callable:
    """The states of one more round, behind those known, for the parts of a series."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("_part")
        sums, old = (np.array(t.column(c).to_pylist(), float).reshape(t.num_rows, -1) for c in ("_sum", "_state"))
        at, new = 0, [old]
        for link in links:
            new.append(link.carried(sums[:, at : at + link.into]))
            at += link.into
        return pa.table({"series_id": t.column("series_id"), "_part": t.column("_part"), "_state": pa.array(list(np.concatenate(new, axis=1)), pa.list_(pa.float64()))})

    return run


def along_parts(df: DataFrame, make: Callable[..., Kernel], inputs: tuple[str, ...], part: int | None = None, **outputs: str) -> DataFrame:
    """Append columns that ``make(*arrays)``, a kernel that ends with a dict of arrays, gives for each series in the order of its bars; inputs are float arrays with NaN for NULL.
    Series of at most ``part`` bars are one pass each. Longer ones are cut into parts of so many bars, and no task holds more than a part of the bars."""
    size = part or PART
    schema = with_fields(df.schema, **outputs)

    def whole(table: pa.Table) -> pa.Table:
        t = table.sort_by("bar_idx")
        return _with(t, alone(make(*[numbers(t.column(c)) for c in inputs])), outputs)

    if longest(df) <= size:
        out = df.groupBy("series_id").applyInArrow(whole, schema)
        _bounds[out] = longest(df)
        return out
    held = df.withColumn("_part", part_of(size))
    links = rounds(make, len(inputs))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("bar_idx").drop_columns("_part")
        if not t.num_rows:
            return _with(t, dict.fromkeys(outputs, np.empty(0)), outputs)
        return _with(t, _replay(make(*[numbers(t.column(c)) for c in inputs]), links, np.array(right.column("_state")[0].as_py(), float)), outputs)

    out = held.groupBy("series_id", "_part").cogroup(states(held, make, inputs).groupBy("series_id", "_part")).applyInArrow(finish, schema)
    _bounds[out] = longest(df)
    return out


def _with(t: pa.Table, made: dict[str, np.ndarray], outputs: dict[str, str]) -> pa.Table:
    for name, col in zip(outputs, columns(made, outputs)):
        t = t.append_column(name, col)
    return t
