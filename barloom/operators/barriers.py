"""Barrier trades of series whose parts lie in different tasks.

A part resolves the trades that open and end in it. Of each part Spark keeps the least and largest price of its bars; the first later part that an open trade can end in is where the running least price of the parts after its own falls to the
stop or the running largest rises to the take-profit, found by binary search. The trade goes to that part, there its bar is found in the same way, and the result goes back to the part where it opened. So a trade moves
twice, however long it is held, and no task holds a series; what the parts of a series have in common are two prices a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chain import columns, numbers, packed, part_of
from ..session import beside, settle, with_fields

if TYPE_CHECKING:
    from .targets import Barrier

INPUTS = ("open", "high", "low", "close", "atr", "_in")
_ENDED = "at array<long>, rr array<double>, hit array<boolean>, exit array<long>, risk array<double>"
_OPEN = "o_at array<long>, o_stop array<double>, o_take array<double>, o_entry array<double>, o_risk array<double>"


def _mirrored(long: bool, o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    return (o, h, low, c) if long else (-o, -low, -h, -c)


def _first_at(running: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first place where a falling sequence is at or under each level; its length where it never is."""
    return np.searchsorted(-running, -level, side="left")


def _extremes(o: np.ndarray, h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest price of each bar whose high and low are there; infinite at others."""
    seen = np.isfinite(h) & np.isfinite(low)
    return np.where(seen, np.fmin(o, low), np.inf), np.where(seen, np.fmax(o, h), -np.inf)


def _arrays(b: pa.RecordBatch, i: int, names: tuple[str, ...]) -> list[np.ndarray]:
    return [numbers(b.column(b.schema.get_field_index(x))[i].values) for x in names]


def _rows(rows: list[tuple], schema: str, series: pa.DataType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    types = [series if name == "series_id" else pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k] for name, k in fields]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [name for name, _ in fields])


def in_parts(held: DataFrame, name: str, spec: Barrier, sides: tuple[str, ...], tick: float | None, size: int, kinds: dict[str, str]) -> DataFrame:
    """``held`` (bars with ``atr`` and ``_in``, whether a bar is not after the cutoff) with the columns ``kinds`` of a barrier target."""
    from .targets import SIDES, outcome, resolve_part

    bars = held.withColumn("_part", part_of(size))
    kind = bars.schema["series_id"].dataType.simpleString()
    x = [f"_x{i}" for i in range(len(INPUTS))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                o, h, low, c, _, inside = _arrays(b, i, tuple(x))
                least, most = _extremes(o, h, low)
                at = np.flatnonzero(inside == 1)
                out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(o), float(least.min()), float(most.max()), int(at[-1]) if len(at) else -1))
            yield _rows(out, "series_id x, _part long, n long, least double, most double, last long", b.schema.field(0).type)

    parts = settle(packed(bars, INPUTS))
    sums = parts.mapInArrow(measured, f"series_id {kind}, _part long, n long, least double, most double, last long")
    order = Window.partitionBy("series_id").orderBy("_part")
    sums = sums.withColumn("off", F.sum("n").over(order) - F.col("n"))  # a row for each part
    common = sums.groupBy("series_id").agg(F.sum("n").alias("total"), F.max(F.when(F.col("last") >= 0, F.col("off") + F.col("last"))).alias("cutoff"), F.array_sort(F.collect_list(F.struct("_part", "off", "least", "most"))).alias("p"))
    common = common.select("series_id", "total", "cutoff", *[F.col(f"p.{k}").alias(f"p{k}") for k in ("_part", "off", "least", "most")])
    placed = settle(beside(beside(parts, sums.select("series_id", "_part", "off"), {"series_id": "series_id", "_part": "_part"}), common.select("series_id", "total", "cutoff"), {"series_id": "series_id"}))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                o, h, low, c, span, _ = _arrays(b, i, tuple(x))
                sid, part, off, total, cutoff = (b.column(b.schema.get_field_index(k))[i].as_py() for k in ("series_id", "_part", "off", "total", "cutoff"))
                for side in sides:
                    got, rest = resolve_part(o, h, low, c, span, spec, side == "long", tick, off, total, cutoff)
                    at = np.flatnonzero(np.isfinite(got["rr"]))
                    out.append((sid, part, SIDES.index(side), at, *[got[k][at] for k in ("rr", "hit", "exit", "risk")], *[rest[k] for k in ("at", "stop", "take", "entry", "risk")]))
            yield _rows(out, f"series_id x, _part long, side int, {_ENDED}, {_OPEN}", b.schema.field(b.schema.get_field_index("series_id")).type)

    first = settle(placed.mapInArrow(opened, f"series_id {kind}, _part long, side int, {_ENDED}, {_OPEN}"))
    waiting = first.where(F.size("o_at") > 0).select("series_id", "_part", "side", *[f.split()[0] for f in _OPEN.split(", ")])
    sent = beside(waiting, common, {"series_id": "series_id"}).mapInArrow(_sent, f"series_id {kind}, _part long, side int, target long, {_OPEN}")
    here = placed.select("series_id", F.col("_part").alias("target"), "off", "cutoff", *x[:4])
    met = beside(sent, here, {"series_id": "series_id", "target": "target"})

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                sid, part, side, off, cutoff = (b.column(b.schema.get_field_index(k))[i].as_py() for k in ("series_id", "_part", "side", "off", "cutoff"))
                o, h, low, c = _mirrored(side == 0, *_arrays(b, i, tuple(x[:4])))
                at, stop, take, entry, risk = _arrays(b, i, tuple(f.split()[0] for f in _OPEN.split(", ")))
                least, most = _extremes(o, h, low)
                j = np.minimum(_first_at(np.minimum.accumulate(least), stop), _first_at(-np.maximum.accumulate(most), -take))
                before = np.zeros(len(at), bool) if cutoff is None else at <= cutoff
                closed = before & (off + j > (cutoff if cutoff is not None else 0))
                over = ~closed & (j < len(o))
                k = np.minimum(j, len(o) - 1)
                with np.errstate(invalid="ignore"):
                    _, rr, win = outcome(o[k], h[k], low[k], stop, take, entry, risk)
                    if closed.any():
                        rr = np.where(closed, (c[cutoff - off] - entry) / risk, rr)
                keep = (over | closed) & np.isfinite(rr)
                exits = np.where(closed, cutoff if cutoff is not None else 0, off + k)
                out.append((sid, part, side, at[keep].astype(np.int64), rr[keep], (win & ~closed)[keep], exits[keep].astype(np.int64), risk[keep]))
            yield _rows(out, f"series_id x, _part long, side int, {_ENDED}", b.schema.field(b.schema.get_field_index("series_id")).type)

    # what opened in a part is known there by its place in the part, elsewhere by that in the series
    later = beside(met.mapInArrow(ended, f"series_id {kind}, _part long, side int, {_ENDED}"), sums.select("series_id", "_part", "off"), {"series_id": "series_id", "_part": "_part"})
    later = later.select("series_id", "_part", "side", F.transform("at", lambda i: i - F.col("off")).alias("at"), "rr", "hit", "exit", "risk")
    done = first.select(*later.columns).unionByName(later)
    return bars.groupBy("series_id", "_part").cogroup(done.groupBy("series_id", "_part")).applyInArrow(_attached(name, kinds), with_fields(held.schema, **kinds))


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open trades by the part that ends them; those opened before the cutoff that nothing ends until then go to its part."""
    for b in batches:
        out = []
        for i in range(b.num_rows):
            sid, part, side, cutoff = (b.column(b.schema.get_field_index(k))[i].as_py() for k in ("series_id", "_part", "side", "cutoff"))
            number, off, least, most = _arrays(b, i, ("p_part", "poff", "pleast", "pmost"))
            trades = _arrays(b, i, tuple(f.split()[0] for f in _OPEN.split(", ")))
            own = int(np.searchsorted(number, part))
            trades[0] = trades[0] + off[own]
            if side == 1:
                least, most = -most, -least
            rest = slice(own + 1, None)
            k = own + 1 + np.minimum(_first_at(np.minimum.accumulate(least[rest]), trades[1]), _first_at(-np.maximum.accumulate(most[rest]), -trades[2]))
            if cutoff is not None:
                k = np.where(trades[0] <= cutoff, np.minimum(k, int(np.searchsorted(off, cutoff, side="right")) - 1), k)
            for target in np.unique(k[k < len(number)]):
                who = k == target
                out.append((sid, part, side, int(number[target]), trades[0][who].astype(np.int64), *[t[who] for t in trades[1:]]))
        if out:
            yield _rows(out, f"series_id x, _part long, side int, target long, {_OPEN}", b.schema.field(b.schema.get_field_index("series_id")).type)


def _attached(name: str, kinds: dict[str, str]) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from .targets import SIDES

        t = left.sort_by("bar_idx").drop_columns("_part")
        n, made = t.num_rows, {}
        for side in SIDES:
            made |= {f"{name}_{side}": np.zeros(n, bool), f"rr_{name}_{side}": np.full(n, np.nan), f"{name}_exit_i_{side}": np.full(n, -1, np.int64), f"{name}_risk_{side}": np.full(n, np.nan)}
        for r in right.to_batches():
            for i in range(r.num_rows):
                side = SIDES[r.column("side")[i].as_py()]
                at = r.column("at")[i].values.to_numpy()
                for k, column in (("hit", f"{name}_{side}"), ("rr", f"rr_{name}_{side}"), ("exit", f"{name}_exit_i_{side}"), ("risk", f"{name}_risk_{side}")):
                    made[column][at] = r.column(k)[i].values.to_numpy(zero_copy_only=False)
        for side in SIDES:
            made[f"{name}_exit_i_{side}"] = np.ma.masked_equal(made[f"{name}_exit_i_{side}"], -1)
        for column, values in zip(kinds, columns(made, kinds)):
            t = t.append_column(column, values)
        return t

    return run
