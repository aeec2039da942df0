"""The search over masks that no task and no driver holds whole.

Masks are vertical bitmaps of blocks of bars: one row for each block, made where its bars are, with a word for 64 bars of a predicate. The combinations are dealt into lanes. A lane streams the blocks of all series in order through one
task and keeps only what its combinations carry from block to block: counts, equity and peaks, the bar that is free next. A combination whose hits so far and the smallest support that its predicates have left fall short is not scored
any further. What is held at once is a block and a lane's numbers; ``combine.evaluate``, which broadcasts all masks, serves what is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chain import PART, numbers, part_of
from ..session import settle
from .catalog import Predicate
from .combine import RESULT, Setup, allowed, choose_trades, ranges, total, unrank, unrank_live
from .metrics import Sizing

#: combinations that a lane keeps numbers of, at most; cells of a hit table at once
LANE, CELLS = 1_000_000, 8_000_000
#: bytes of the table of supports by block, beyond which combinations are not rejected early
MOST_SUPPORTS = 1 << 28


def blocks(df: DataFrame, predicates: list[Predicate], columns: dict[str, Column], size: int | None = None) -> DataFrame:
    """series_id, _part, bars, words, gate, reward, label, exit, risk (binary arrays of the block's bars, words by predicate) and support (bars of each predicate)."""
    m = [p.column().cast("boolean").alias(f"m{i}") for i, p in enumerate(predicates)]
    rows = df.select("series_id", "bar_idx", *[c.alias(k) for k, c in columns.items()], *m).withColumn("_part", part_of(size or PART))
    n = len(predicates)

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by("bar_idx").combine_chunks()
        pad = -(-t.num_rows // 64) * 64

        def word(name: str) -> np.ndarray:
            bits = np.zeros(pad, bool)
            bits[: t.num_rows] = t.column(name).fill_null(False).to_numpy()
            return np.packbits(bits, bitorder="little").view(np.uint64)

        words = np.array([word(f"m{i}") for i in range(n)], np.uint64).reshape(n, pad // 64)
        held = {"bars": t.column("bar_idx").to_numpy(), "words": words, "gate": word("_gate"), "reward": numbers(t.column("_reward")), "label": t.column("_label").to_numpy(), "exit": t.column("_exit").fill_null(-1).to_numpy(), "risk": numbers(t.column("_risk"))}
        out = {"series_id": t.column("series_id").slice(0, 1), "_part": t.column("_part").slice(0, 1), **{k: pa.array([v.tobytes()]) for k, v in held.items()}, "support": pa.array([np.bitwise_count(words).sum(axis=1, dtype=np.int64)], pa.list_(pa.int64()))}
        return pa.table(out)

    kind = df.schema["series_id"].dataType.simpleString()
    return rows.groupBy("series_id", "_part").applyInArrow(pack, f"series_id {kind}, _part long, bars binary, words binary, gate binary, reward binary, label binary, exit binary, risk binary, support array<long>")


class Lane:
    """What combinations (rows of predicate numbers) carry from block to block."""

    def __init__(self, combos: np.ndarray, sizing: Sizing):
        n = len(combos)
        self.combos, self.sizing, self.live = combos, sizing, np.ones(n, bool)
        self.hits, self.trades, self.wins, self.losses, self.labels = (np.zeros(n, np.int64) for _ in range(5))
        self.total, self.high, self.dd, self.fall = (np.zeros(n) for _ in range(4))
        self.capital, self.top = np.full(n, sizing.capital), np.full(n, sizing.capital)
        self.free = np.full(n, -1, np.int64)

    def take(self, b: dict[str, np.ndarray], stacking: bool) -> None:
        """One more block, of a series whose earlier blocks have been taken."""
        live, n = np.flatnonzero(self.live), len(b["bars"])
        for at in range(0, len(live), max(16, CELLS // max(n, 1))):
            who = live[at : at + max(16, CELLS // max(n, 1))]
            combos = self.combos[who]
            words = b["words"][combos[:, 0]]
            for i in range(1, combos.shape[1]):
                words &= b["words"][combos[:, i]]
            self.hits[who] += np.bitwise_count(words).sum(axis=1, dtype=np.int64)
            row, hit = np.nonzero(np.unpackbits((words & b["gate"]).view(np.uint8), axis=1, count=n, bitorder="little"))
            if not stacking and len(row):
                free = np.where(b["exit"] >= b["bars"], b["exit"], b["bars"] + 1)
                took = choose_trades(row, hit, len(who), n, np.searchsorted(b["bars"], free), np.searchsorted(b["bars"], self.free[who]))
                row, hit = row[took], hit[took]
                last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else row
                self.free[who[row[last]]] = free[hit[last]]
            if len(row):
                self._add(who, row, hit, b)

    def _add(self, who: np.ndarray, row: np.ndarray, hit: np.ndarray, b: dict[str, np.ndarray]) -> None:
        own, row = np.unique(row, return_inverse=True)
        who, count = who[own], np.bincount(row)
        at = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        rr = np.zeros((len(who), int(count.max())))
        rr[row, at] = b["reward"][hit]
        self.trades[who] += count
        self.wins[who] += (rr > 0).sum(axis=1)
        self.losses[who] += (rr < 0).sum(axis=1)
        self.labels[who] += np.bincount(row, b["label"][hit], len(who)).astype(np.int64)
        e = self.total[who, None] + np.cumsum(rr, axis=1)
        peak = np.maximum(np.maximum.accumulate(e, axis=1), self.high[who, None])
        self.dd[who] = np.maximum(self.dd[who], (peak - e).max(axis=1))
        self.total[who], self.high[who] = e[:, -1], peak[:, -1]
        s = self.sizing
        if s.capital <= 0 or s.risk_pct <= 0:
            return
        if s.contracts:
            risk = np.full(rr.shape, np.nan)
            risk[row, at] = b["risk"][hit]
            path = self._contracts(self.capital[who], rr, risk)
        else:
            path = self.capital[who, None] * np.cumprod(1.0 + rr * s.risk_pct / 100.0, axis=1)
        best = np.maximum(np.maximum.accumulate(path, axis=1), self.top[who, None])
        self.fall[who] = np.maximum(self.fall[who], ((best - path) / best * 100.0).max(axis=1))
        self.capital[who], self.top[who] = path[:, -1], best[:, -1]

    def _contracts(self, capital: np.ndarray, rr: np.ndarray, risk: np.ndarray) -> np.ndarray:
        """Capital after each trade when whole contracts are bought for a share of what there is then; all combinations take their next trade at once."""
        s, path = self.sizing, np.empty(rr.shape)
        for j in range(rr.shape[1]):
            d = risk[:, j]
            good = np.isfinite(d) & (d > 0)
            k = np.maximum(np.floor(np.where(np.isfinite(capital), capital, 0.0) * s.risk_pct / 100.0 / np.where(good, d, 1.0)), max(s.least, 1))
            k = np.minimum(k, s.most) if s.most is not None else k
            if s.margin and s.margin > 0:
                k = np.where(capital > 0, np.minimum(k, np.floor(capital / s.margin)), k)
            capital = np.where(good, capital + rr[:, j] * np.where(good, d, 0.0) * k, capital)
            path[:, j] = capital
        return path

    def result(self, least: int, max_drawdown: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        s = self.sizing
        who = np.flatnonzero(self.live & (self.hits >= least) & (self.trades >= max(least, 1)) & (self.dd <= max_drawdown))
        n = self.trades[who]
        out = {"mask_hits": self.hits[who], "trades": n, "wins": self.wins[who], "losses": self.losses[who], "label_hits": self.labels[who], "win_rate": self.wins[who] / np.maximum(n, 1) * 100.0, "total_return": self.total[who], "max_drawdown": self.dd[who]}
        if s.capital <= 0 or s.risk_pct <= 0:
            return who, out | dict.fromkeys(("final_capital", "total_return_pct", "cagr_pct", "max_drawdown_pct_equity", "calmar_ratio"), np.zeros(len(who)))
        growth = self.capital[who] / s.capital
        gain, years, fall = (growth - 1.0) * 100.0, max(s.years, 1e-9), self.fall[who]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            cagr = np.where(np.isfinite(growth) & (growth > 0), (np.maximum(growth, 0.0) ** (1.0 / years) - 1.0) * 100.0, gain)
            calmar = np.where(fall > 0, cagr / fall, np.where(cagr > 0, np.inf, 0.0))
        return who, out | {"final_capital": self.capital[who], "total_return_pct": gain, "cagr_pct": cagr, "max_drawdown_pct_equity": fall, "calmar_ratio": calmar}


def _lanes(n: int, depth: int, start: int, stop: int, most: int) -> list[tuple[int, tuple[int, ...], int, int, int]]:
    """(k, first elements, low, high, number of the first): the combinations numbered start .. stop - 1 in pieces of at most ``most``."""
    out, before = [], 0
    for k in range(1, depth + 1):
        size = math.comb(n, k)
        low, high = max(start - before, 0), min(stop - before, size)
        if low < high:
            for first, lo, hi, base in ranges(low, high, n, k):
                out += [(k, first, at, min(at + most, hi), before + base) for at in range(lo, hi, most)]
        before += size
    return out


def evaluate(df: DataFrame, predicates: list[Predicate], columns: dict[str, Column], depth: int, least: int = 1, max_drawdown: float = math.inf, stacking: bool = False, sizing: Sizing | None = None, start: int = 0, stop: int | None = None, required: list[str] | None = None, size: int | None = None, lane: int | None = None, dead: np.ndarray | None = None) -> DataFrame:
    """What ``combine.evaluate`` gives, for any number of bars and series (trades in the order of series and bars): the combinations numbered ``start`` to ``stop`` with ``least`` trades and a drawdown within the cap.
    ``dead`` (see ``combine.dead_matrix``) names pairs that no combination with so many trades can hold: runs of numbers that begin with one are not enumerated, and nothing else changes."""
    spark, sizing, names = df.sparkSession, sizing or Sizing(), [p.name for p in predicates]
    missing = set(required or ()) - set(names)
    if missing:
        raise ValueError(f"required features not in the catalog: {', '.join(sorted(missing))}")
    n, end = len(names), min(stop if stop is not None else total(len(names), depth), total(len(names), depth))
    work = max(2_000, -(-(end - start) // (2 * spark.sparkContext.defaultParallelism)))
    lanes = _lanes(n, depth, start, end, min(lane or LANE, work))
    if not lanes:
        return spark.createDataFrame([], RESULT)
    table = settle(blocks(df, predicates, columns, size))
    supports = table.select("series_id", "_part", "support").orderBy("series_id", "_part")
    kept = [r.support for r in supports.collect()] if table.count() * n * 8 <= MOST_SUPPORTS else None  # its size is checked
    left = spark.sparkContext.broadcast(np.cumsum(np.array([*kept, [0] * n], np.int64)[::-1], axis=0)[::-1] if kept is not None else None)
    ids: dict[tuple[str, str], int] = {}
    bounds = np.array([-1 if p.bound is None else ids.setdefault(p.bound, len(ids)) for p in predicates], np.int64)
    none = np.zeros(0)
    rules = Setup(names, none, none, none, none, none, none, bounds, [names.index(x) for x in required or ()])

    def begin(k: int) -> tuple[Lane, np.ndarray]:
        depth_k, first, lo, hi, _ = lanes[k]
        behind = first[-1] + 1 if first else 0
        if dead is None:
            local = np.arange(lo, hi)
            combos = unrank(local, n - behind, depth_k - len(first)) + behind
        else:
            local, combos, _ = unrank_live(lo, hi, n - behind, depth_k - len(first), dead[behind:, behind:])
            combos = combos + behind
        if first:
            combos = np.concatenate((np.tile(np.array(first, np.int64), (len(combos), 1)), combos), axis=1)
        ok = allowed(combos, rules)
        if dead is not None:
            for i in range(len(first)):
                ok &= ~dead[combos[:, i, None], combos[:, i + 1 :]].any(axis=1)
        if left.value is not None:
            ok &= (left.value[0][combos] >= least).all(axis=1)
        return Lane(combos[ok], sizing), local[ok]

    def done(k: int, held: Lane, local: np.ndarray) -> pa.RecordBatch:
        who, m = held.result(least, max_drawdown)
        m |= {"base": [str(lanes[k][4])] * len(who), "local": local[who], "depth": np.full(len(who), lanes[k][0], np.int32), "features": held.combos[who].tolist(), "combination": [" && ".join(names[x] for x in c) for c in held.combos[who].tolist()]}
        fields = [("base", pa.string()), ("local", pa.int64()), ("depth", pa.int32()), ("features", pa.list_(pa.int32())), ("combination", pa.string())]
        fields += [(x.split()[0], pa.int64() if x.endswith("long") else pa.float64()) for x in RESULT.split(", ")[4:]]
        return pa.RecordBatch.from_arrays([pa.array(m[c], t) for c, t in fields], [c for c, _ in fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, local, series, at = -1, None, none, None, 0
        for batch in batches:
            for r in batch.to_struct_array():
                k = r["lane"].as_py()
                if k != now:
                    if held is not None:
                        yield done(now, held, local)
                    now, series, at = k, (None,), 0
                    held, local = begin(k)
                if series != (r["series_id"].as_py(), True):
                    series = (r["series_id"].as_py(), True)
                    held.free[:] = -(2**62)
                own = lambda name, kind: np.frombuffer(r[name].as_buffer(), kind)  # noqa: B023, E731
                b = {"bars": own("bars", np.int64), "gate": own("gate", np.uint64), "reward": own("reward", float), "label": own("label", bool), "exit": own("exit", np.int64), "risk": own("risk", float)}
                b["words"] = own("words", np.uint64).reshape(n, -1)
                held.take(b, stacking)
                at += 1
                if left.value is not None:
                    held.live &= held.hits + left.value[at][held.combos].min(axis=1, initial=2**62) >= max(least, 1)
        if held is not None:
            yield done(now, held, local)

    spread = table.drop("support").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(len(lanes) - 1)))).repartitionByRange(len(lanes), "lane").sortWithinPartitions("lane", "series_id", "_part")
    kinds = "base string, local long, " + RESULT.split(", ", 1)[1]
    out = spread.mapInArrow(stream, kinds)
    return out.select((F.col("base").cast("decimal(38,0)") + F.col("local")).cast("decimal(38,0)").alias("combo_id"), *[x.split()[0] for x in RESULT.split(", ")[1:]])
