"""Period backtests: one open trade at a time, a cap for each period, closed by the period's last bar."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import window as W
from ..functions.recurrence import along_series
from ..functions.scalar import SMALL, TOLERANCE, stop_level, yes
from .targets import SIDES

_CLAUSE = re.compile(r"^\s*(.+?)\s*(<=|>=|==|!=|<|>)\s*([-+0-9.eE]+)\s*$")


def entry_condition(text: str) -> Column:
    """``flag`` or ``feature OP number``, joined by &&; == and != within the tolerance."""
    out = F.lit(True)
    for part in text.split("&&"):
        m = _CLAUSE.match(part)
        if not m:
            out = out & yes(F.col(f"`{part.strip()}`").cast("boolean"))
            continue
        x, v = F.col(f"`{m[1]}`"), float(m[3])
        out = out & yes({"<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v, "==": F.abs(x - v) <= TOLERANCE, "!=": F.abs(x - v) > TOLERANCE}[m[2]])
    return out


def trading_week(ts: str = "ts") -> Column:
    """The number of the week that begins on Sunday, 22:00 UTC."""
    return F.floor((F.unix_timestamp(ts) - 338_400) / 604_800).cast("long")


def month(ts: str = "ts") -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("long")


def simulate(h: np.ndarray, low: np.ndarray, c: np.ndarray, entry: np.ndarray, stop: np.ndarray, take: np.ndarray, period: np.ndarray, long: bool, cap: int, stop_after_win: bool) -> dict[str, np.ndarray]:
    """Trades of one side, at the bars that open them. Bars without prices are passed over."""
    if not long:
        h, low, c, stop, take = -low, -h, -c, -stop, -take
    n = len(c)
    rr, out, price = np.full(n, np.nan), np.full(n, -1, np.int64), np.full(n, np.nan)
    last = {p: i for i, p in enumerate(period.tolist())}
    used: dict[float, int] = {}
    won: set[float] = set()
    free = 0
    for i in np.flatnonzero(entry == 1).tolist():
        p = period[i]
        if i < free or used.get(p, 0) >= cap or (stop_after_win and p in won) or i >= last[p]:
            continue
        risk = c[i] - stop[i]
        if not (np.isfinite(risk + take[i]) and risk > SMALL):
            continue
        span = slice(i + 1, last[p] + 1)
        seen = np.isfinite(h[span]) & np.isfinite(low[span]) & np.isfinite(c[span])
        touch = np.flatnonzero(seen & ((low[span] <= stop[i]) | (h[span] >= take[i])))
        if len(touch):
            j = i + 1 + int(touch[0])
            x = stop[i] if low[j] <= stop[i] else take[i]
        elif seen.any():
            j = i + 1 + int(np.flatnonzero(seen)[-1])
            x = c[j]
        else:
            continue
        rr[i], out[i], price[i] = (x - c[i]) / risk, j, x if long else -x
        used[p] = used.get(p, 0) + 1
        if rr[i] > 0:
            won.add(p)
        free = j + 1
    return {"rr": rr, "exit": out, "price": price}


def period_backtest(df: DataFrame, entry: Column, period: Column, prefix: str, multiple: float = 2.0, stop: str = "wide", cap: int = 2, stop_after_win: bool = True) -> DataFrame:
    """Attach {prefix}_rr_long, _exit_i_long, _exit_price_long and the same of shorts to a feature frame with ``atr``. Entries are at close, longs above and shorts below the 200-bar mean where the frame has it."""
    c, span = F.col("close"), F.col("atr")
    trend = {"long": yes(c > F.col("200sma")), "short": yes(c < F.col("200sma"))} if "200sma" in df.columns else dict.fromkeys(SIDES, F.lit(True))
    held = df.withColumns({
        "_period": period.cast("double"), "_stop_long": stop_level(c, F.col("low"), span, True, stop), "_stop_short": stop_level(c, F.col("high"), span, False, stop),
        "_take_long": c + multiple * span, "_take_short": c - multiple * span, **{f"_in_{s}": (entry & trend[s] & (yes(c > F.col("open")) if s == "long" else yes(c < F.col("open")))).cast("double") for s in SIDES},
    })

    def kernel(h, low, c, period, *rest) -> dict[str, np.ndarray]:
        made = {}
        for k, side in enumerate(SIDES):
            e, s, t = rest[3 * k : 3 * k + 3]
            r = simulate(h, low, c, e, s, t, period, side == "long", cap, stop_after_win)
            made |= {f"{prefix}_rr_{side}": r["rr"], f"{prefix}_exit_i_{side}": np.ma.masked_equal(r["exit"], -1), f"{prefix}_exit_price_{side}": r["price"]}
        return made

    kinds = {k: t for s in SIDES for k, t in ((f"{prefix}_rr_{s}", "double"), (f"{prefix}_exit_i_{s}", "long"), (f"{prefix}_exit_price_{s}", "double"))}
    inputs = ("high", "low", "close", "_period", *[f"_{x}_{s}" for s in SIDES for x in ("in", "stop", "take")])
    return along_series(held, kernel, inputs, **kinds).drop(*[x for x in held.columns if x.startswith("_")])


def trades(df: DataFrame, prefix: str) -> DataFrame:
    """One row for each trade of both sides, by entry."""
    parts = [
        df.where(F.col(f"{prefix}_rr_{s}").isNotNull()).select("series_id", F.col("bar_idx").alias("entry_i"), "ts", F.lit(s).alias("direction"), F.col("close").alias("entry_price"), F.col(f"{prefix}_exit_i_{s}").alias("exit_i"), F.col(f"{prefix}_exit_price_{s}").alias("exit_price"), F.col(f"{prefix}_rr_{s}").alias("rr"))
        for s in SIDES
    ]
    return parts[0].unionByName(parts[1])


def period_ends(df: DataFrame, period: Column) -> DataFrame:
    """The last bar of each period, on every bar."""
    return df.withColumn("_p", period).withColumn("period_end", F.max("bar_idx").over(W.whole().partitionBy("series_id", "_p"))).withColumnRenamed("_p", "period")
