"""Sequences of trades whose hits and results lie in different tasks.

Hits of a formula are cut into parts of the bars of each series. Which of them become trades when they may not overlap depends only on the first bar that is free when a part begins. A part is therefore a step function from that bar
to the one that is free after it; a part sends one step for each exit beyond its end that some chain of its trades leads to, these are followed from part to part, and then all parts choose at once.

Metrics are a fold as well: a first pass gives each part's sums, highest prefixes and runs at both ends; a scan over the parts of a formula gives the equity, peaks and the run that enter each; a second pass gives what adds up or
what a maximum is taken of. Sizing in whole contracts rounds at every trade and does not compose: it takes the trades of a formula as one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chain import PART
from ..session import beside, settle
from .metrics import Sizing, quality_column
from .order import placed

_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}


def _parted(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("_part", F.floor(F.col("bar_idx") / size).cast("long"))


def following(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bars, the first bar that is free after each hit's trade, and the place of the hit that follows it: len(bars) beyond the part."""
    bars, exits = t.column("bar_idx").to_numpy(), t.column("_exit").fill_null(-1).to_numpy()
    free = np.where(exits >= bars, exits, bars + 1)
    return bars, free, np.maximum(np.searchsorted(bars, free), np.arange(1, len(bars) + 1))


def steps(bars: np.ndarray, free: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A part's function: from a free bar up to and with ``at[i]`` (and beyond at[i - 1]) chains leave the part with the bar ``to[i]`` free. The last trade of each chain is found by doubling."""
    n = len(bars)
    last = np.arange(n)
    jump = np.where(then < n, then, last)
    while (jump[jump] != jump).any():
        jump = jump[jump]
    to = np.maximum(free[jump], bars[jump] + 1)
    keep = np.append(to[1:] != to[:-1], True) & np.append(bars[1:] != bars[:-1], True)
    return bars[keep], to[keep]


def reached(then: np.ndarray, start: int) -> np.ndarray:
    """The places from ``start`` on along ``then``, in log rounds: those reached so far also jump as far as they have come together."""
    n = len(then)
    on = np.zeros(n + 1, bool)
    on[start] = True
    jump = np.append(np.minimum(then, n), n)
    far = 1
    while far <= n and start < n:
        on[jump[np.flatnonzero(on)]] = True
        jump, far = jump[jump], far * 2
    return np.flatnonzero(on[:n])


def choose(rows: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """Of the hits of each of ``keys`` and each series the first, then always the first at or after the last one's exit."""
    held, group = _parted(rows, size or PART), [*keys, "series_id"]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)

    def summed(table: pa.Table) -> pa.Table:
        t = table.sort_by("bar_idx")
        at, to = steps(*following(t))
        one = t.slice(0, 1).select([*group, "_part"])
        return one.append_column("at", pa.array([at], pa.list_(pa.int64()))).append_column("to", pa.array([to], pa.list_(pa.int64())))

    def entered(table: pa.Table) -> pa.Table:
        t = table.sort_by("_part").combine_chunks()
        free, out = -1, []
        for k in range(t.num_rows):
            out.append(free)
            at, to = (t.column(c)[k].values.to_numpy() for c in ("at", "to"))
            i = int(np.searchsorted(at, free))
            free = int(to[i]) if i < len(at) else free
        return t.select([*group, "_part"]).append_column("_free", pa.array(out, pa.int64()))

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("bar_idx")
        bars, _, then = following(t)
        return t.take(reached(then, int(np.searchsorted(bars, right.column("_free")[0].as_py())))).drop_columns("_part") if t.num_rows else t.drop_columns("_part")

    sums = held.groupBy(*group, "_part").applyInArrow(summed, f"{own}, _part long, at array<long>, to array<long>")
    free = sums.groupBy(*group).applyInArrow(entered, f"{own}, _part long, _free long")
    return held.groupBy(*group, "_part").cogroup(free.groupBy(*group, "_part")).applyInArrow(chosen, rows.schema)


# what a part tells the parts after it: sum, highest prefix of the sum; growth and its highest prefix; trades, sign and length of the first and of the last run, and trades that end no run
_SUMS = ("total", "high", "growth", "top", "first", "first_n", "last", "last_n", "n")
#: what enters a part: sum and its peak, growth and its peak, the open run's sign and length
_ENTER = ("total", "high", "growth", "top", "sign", "run")
_ADDED = ("n", "wins", "losses", "labels", "win_sum", "loss_sum", "dd_sum", "pct_sum", "ret_sum", "ret_square", "low_square", "low_n", "win_runs", "win_length", "loss_runs", "loss_length")
_MOST = ("win_most", "loss_most", "dd_most", "peaked", "fall_most", "dollar_fall", "win_run", "loss_run")
_LAST = ("total", "growth")


def part_sums(rr: np.ndarray, risk_pct: float) -> list[float]:
    e, g, s = np.cumsum(rr), np.cumprod(1.0 + rr * risk_pct / 100.0), np.sign(rr)
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    first, last = int(ends[0]) + 1, len(rr) - (int(ends[-2]) + 1 if len(ends) > 1 else 0)
    return [float(e[-1]), float(e.max()), float(g[-1]), float(g.max()), float(s[0]), first, float(s[-1]), last, len(rr)]


def enter(sums: np.ndarray) -> np.ndarray:
    """The states that enter all parts, from their sums in order."""
    total, high, growth, top, sign, run, out = 0.0, 0.0, 1.0, 1.0, 0.0, 0, []
    for t, h, g, u, first, first_n, last, last_n, n in sums.tolist():
        out.append((total, high, growth, top, sign, run))
        high, top = max(high, total + h), max(top, growth * u)
        total, growth = total + t, growth * g
        run = last_n + run if last_n == n and first == sign else last_n
        sign = last
    return np.array(out).reshape(-1, len(_ENTER))


def part_metrics(rr: np.ndarray, labels: int, state: np.ndarray, risk_pct: float, final: bool) -> list[float]:
    """_ADDED, _MOST and _LAST of a part that ``state`` enters; a run counts where it ends, at the latest in the ``final`` part."""
    total, high, growth, top, sign, run = state
    e, g = total + np.cumsum(rr), growth * np.cumprod(1.0 + rr * risk_pct / 100.0)
    peak, best = np.maximum(np.maximum.accumulate(e), high), np.maximum(np.maximum.accumulate(g), top)
    dd, eps = e - peak, np.finfo(float).eps
    pct = np.where(np.abs(peak) >= eps, dd / (peak + eps) * 100.0, 0.0)
    before = np.append(growth, g[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = np.where(before > 0, g / before - 1.0, 0.0)
    win, loss, low = rr[rr > 0], -rr[rr < 0], ret[ret < 0]
    s = np.sign(rr)
    cut = np.flatnonzero(s[1:] != s[:-1]) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(rr))
    signs, lengths = s[starts].tolist(), (ends - starts).tolist()
    if run and signs[0] == sign:
        lengths[0] += run
    elif run:
        signs.insert(0, sign), lengths.insert(0, run)
    if not final:
        signs.pop(), lengths.pop()
    runs = {k: [n for q, n in zip(signs, lengths) if q == k] for k in (1.0, -1.0)}
    added = [len(rr), len(win), len(loss), labels, win.sum(), loss.sum(), dd.sum(), (pct * pct).sum(), ret.sum(), (ret * ret).sum(), (low * low).sum(), len(low), len(runs[1.0]), sum(runs[1.0]), len(runs[-1.0]), sum(runs[-1.0])]
    most = [win.max(initial=0.0), loss.max(initial=0.0), -dd.min(), float((peak >= eps).any()), ((best - g) / best * 100.0).max(), (best - g).max(), max(runs[1.0], default=0), max(runs[-1.0], default=0)]
    return [*map(float, added), *map(float, most), e[-1], g[-1]]


def _metrics(s: Sizing) -> dict[str, Column]:
    """The columns of full metrics from the merged numbers of a formula, but for quantiles."""
    c, n = F.col, F.col("n")
    ratio = lambda a, b, other: F.when(b > 0, a / b).otherwise(other)
    endless = lambda x: F.when(x > 0, float("inf")).otherwise(0.0)
    win, loss = ratio(c("win_sum"), c("wins"), 0.0), ratio(c("loss_sum"), c("losses"), 0.0)
    out = {
        "wins": c("wins").cast("long"), "losses": c("losses").cast("long"), "win_rate": c("wins") / n * 100.0, "total_return": c("total"), "max_drawdown": c("dd_most"), "expectancy": c("total") / n,
        "profit_factor": ratio(c("win_sum"), c("loss_sum"), endless(c("wins"))), "avg_winning_rr": win, "avg_losing_rr": F.when(c("losses") > 0, -loss).otherwise(0.0), "win_loss_ratio": ratio(win, loss, endless(win)),
        "largest_win": c("win_most"), "largest_loss": c("loss_most"), "ulcer_index": F.when(c("peaked") > 0, F.sqrt(c("pct_sum") / n)).otherwise(0.0), "pain_ratio": F.when(c("dd_sum") < 0, c("total") / F.abs(c("dd_sum") / n)).otherwise(0.0),
        "max_consecutive_wins": c("win_run").cast("long"), "avg_win_streak": ratio(c("win_length"), c("win_runs"), 0.0), "max_consecutive_losses": c("loss_run").cast("long"), "avg_loss_streak": ratio(c("loss_length"), c("loss_runs"), 0.0),
        "sample_quality": quality_column(n),
    }
    if s.capital <= 0 or s.risk_pct <= 0:
        zero = ("final_capital", "total_return_pct", "cagr_pct", "max_drawdown_pct_equity", "calmar_ratio", "sharpe_equity", "sortino_equity")
        return out | {k: F.lit(0.0) for k in zero} | {"total_return_dollar": c("total") * s.dollars_per_r, "max_drawdown_dollar": c("dd_most") * s.dollars_per_r, "expectancy_dollar": c("total") / n * s.dollars_per_r}
    years = max(s.years, 1e-9)
    gain = (c("growth") - 1.0) * 100.0
    cagr = F.when((c("growth") > 0) & (c("growth") < float("inf")), (F.pow("growth", F.lit(1.0 / years)) - 1.0) * 100.0).otherwise(gain)
    mean = c("ret_sum") / n
    std = F.sqrt(F.greatest(c("ret_square") / n - mean * mean, F.lit(0.0)))
    down, scale = F.when(c("low_n") > 0, F.sqrt(c("low_square") / c("low_n"))).otherwise(0.0), F.sqrt(F.greatest(n / years, F.lit(1e-9)))
    return out | {
        "final_capital": c("growth") * s.capital, "total_return_pct": gain, "cagr_pct": cagr, "max_drawdown_pct_equity": c("fall_most"), "calmar_ratio": ratio(cagr, c("fall_most"), endless(cagr)),
        "total_return_dollar": (c("growth") - 1.0) * s.capital, "expectancy_dollar": (c("growth") - 1.0) * s.capital / n, "max_drawdown_dollar": c("dollar_fall") * s.capital,
        "sharpe_equity": F.when(std > 0, mean / std * scale).otherwise(0.0), "sortino_equity": F.when(down > 0, mean / down * scale).otherwise(endless(mean)),
    }


def spreads(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median_rr, p05_rr, p95_rr: exact, by places of the values and not by sorting a formula's trades in one task."""
    p = placed(trades.select(F.struct(*keys).alias("series_id"), "_reward"), "_reward")
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("value")))
    last = F.col("total") - 1
    half = lambda x: F.floor(x + 0.5)
    out = p.groupBy("series_id").agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2.0).alias("median_rr"), at(half(last * 0.05)).alias("p05_rr"), at(half(last * 0.95)).alias("p95_rr"))
    return out.select(*[F.col(f"series_id.{k}").alias(k) for k in keys], "median_rr", "p05_rr", "p95_rr")


def scored(trades: DataFrame, keys: list[str], sizing: Sizing | list[Sizing], size: int | None = None) -> DataFrame:
    """keys, trades, label_hits and full metrics; trades count in the order of their series and bars. A list of sizings goes by the key ``scenario``."""
    trades = settle(_parted(trades, size or PART))
    sizings = sizing if isinstance(sizing, list) else [sizing]
    at = keys.index("scenario") if isinstance(sizing, list) else None
    risk_of = lambda t: sizings[t.column("scenario")[0].as_py() if at is not None else 0].risk_pct
    chunk = [*keys, "series_id", "_part"]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.select(*chunk).schema)
    of_keys = {f.name: f.dataType.simpleString() for f in trades.select(*keys).schema}

    def numbers(t: pa.Table) -> np.ndarray:
        return t.column("_reward").fill_null(np.nan).to_numpy()

    def summed(table: pa.Table) -> pa.Table:
        t = table.sort_by("bar_idx")
        return t.slice(0, 1).select(chunk).append_column("_sums", pa.array([part_sums(numbers(t), risk_of(t))], pa.list_(pa.float64())))

    def entered(table: pa.Table) -> pa.Table:
        t = table.sort_by([("series_id", "ascending"), ("_part", "ascending")])
        states = enter(np.array(t.column("_sums").to_pylist(), float))
        states = np.concatenate((states, (np.arange(t.num_rows) == t.num_rows - 1).astype(float)[:, None]), axis=1)
        return t.select(chunk).append_column("_state", pa.array(list(states), pa.list_(pa.float64())))

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("bar_idx")
        state = right.column("_state")[0].values.to_numpy()
        got = part_metrics(numbers(t), int(np.count_nonzero(t.column("_label").to_numpy())), state[:-1], risk_of(t), bool(state[-1]))
        names = [*_ADDED, *_MOST, *_LAST, "final"]
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, **{k: pa.array([float(v)]) for k, v in zip(names, [*got, state[-1]])}}, schema=pa.schema([*[pa.field(k, _ARROW[of_keys[k]]) for k in keys], *[pa.field(k, pa.float64()) for k in names]]))

    sums = trades.groupBy(*chunk).applyInArrow(summed, f"{own}, _sums array<double>")
    states = sums.groupBy(*keys).applyInArrow(entered, f"{own}, _state array<double>")  # a row for each part of a formula
    parts = trades.groupBy(*chunk).cogroup(states.groupBy(*chunk)).applyInArrow(measured, ", ".join([*[f"`{k}` {t}" for k, t in of_keys.items()], *[f"{k} double" for k in (*_ADDED, *_MOST, *_LAST, "final")]]))
    merged = parts.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in _ADDED], *[F.max(k).alias(k) for k in _MOST], *[F.max_by(k, "final").alias(k) for k in _LAST])
    each = [_metrics(s) for s in sizings]
    pick = lambda k: each[0][k] if at is None else F.coalesce(*[F.when(F.col("scenario") == i, m[k]) for i, m in enumerate(each)])
    out = merged.select(*keys, F.col("n").cast("long").alias("trades"), F.col("labels").cast("long").alias("label_hits"), *[pick(k).alias(k) for k in each[0]])
    return beside(out, spreads(trades, keys), {f"`{k}`": k for k in keys})


def composes(sizing: Sizing | list[Sizing]) -> bool:
    return not any(s.contracts for s in (sizing if isinstance(sizing, list) else [sizing]))

