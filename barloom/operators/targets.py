"""Targets: what a trade opened at each bar would have earned.

A barrier target looks forward from its bar to the first bar that touches stop or take-profit. All bars of a series look one bar further at a time, as arrays, and those
that are resolved drop out, so the work is the sum of the holding times; of long series each part does so, and ``barriers`` finds the part that ends what it leaves open. Results are ``long``/``short`` labels, returns in multiples of risk, and exit bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import window as W
from ..functions.chain import PART, longest
from ..functions.recurrence import along_series, atr
from ..functions.scalar import EPS, SMALL, tick_distance, yes
from . import barriers


@dataclass(frozen=True)
class Barrier:
    """stop: wide, bar, atr or tight; the take-profit is ``reward`` ATRs or, by ``by_risk``, multiples of the risk."""

    stop: str
    reward: float
    by_risk: bool = False
    least_rr: float | None = None
    both: bool = True


BARRIERS = {
    "highlow_or_atr": Barrier("wide", 2.0),
    "highlow_1r": Barrier("bar", 1.0, by_risk=True),
    "2x_atr_tp_atr_stop": Barrier("atr", 2.0, both=False),
    "3x_atr_tp_atr_stop": Barrier("atr", 3.0, both=False),
    "atr_tp_atr_stop": Barrier("atr", 1.0, both=False),
    "highlow_sl_2x_atr_tp_rr_gt_1": Barrier("bar", 2.0, least_rr=1.0),
    "highlow_sl_1x_atr_tp_rr_gt_1": Barrier("bar", 1.0, least_rr=1.0),
    "highlow_or_atr_tightest_stop": Barrier("tight", 2.0),
}
NEXT_BAR = {"next_bar_color_and_wicks": "wicks_diff_sma14", "wicks_kf": "kf_wicks_smooth"}
SIDES = ("long", "short")


def _stops(entry: np.ndarray, extreme: np.ndarray, span: np.ndarray, mode: str) -> np.ndarray:
    """Stops in prices where a lower one is farther; shorts come mirrored."""
    by_atr = entry - span
    if mode == "bar":
        return extreme
    if mode == "atr":
        return by_atr
    if mode == "wide":
        return np.fmin(extreme, by_atr)
    return np.fmax(np.where(extreme < entry, extreme, np.nan), np.where(by_atr < entry, by_atr, np.nan))


def outcome(o: np.ndarray, h: np.ndarray, low: np.ndarray, s: np.ndarray, t: np.ndarray, e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a bar ends a trade with stop s, take-profit t, entry e and risk r; its return, and whether it won. A gap through a barrier fills at the open, then the stop counts before the take-profit."""
    gap_s, gap_t, got_s, got_t = o <= s, o >= t, low <= s, h >= t
    x = np.where(gap_s | gap_t, (o - e) / r, np.where(got_s, -1.0, (t - e) / r))
    return gap_s | gap_t | got_s | got_t, x, ~gap_s & (gap_t | (~got_s & got_t))


def resolve_part(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, span: np.ndarray, spec: Barrier, long: bool, tick: float | None, offset: int, total: int, cutoff: int | None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """hit, rr, exit and risk of the trades that open in a part of a series of ``total`` bars and end there, and what is known of those that don't: at, stop, take, entry, risk (in prices that are negated for shorts).

    With a cutoff bar, trades opened before it that neither barrier ends are closed at its close, and later ones see the whole series."""
    if not long:
        o, h, low, c = -o, -low, -h, -c
    n = len(o)
    hit, rr, out, risk_of = np.zeros(n, bool), np.full(n, np.nan), np.full(n, -1, np.int64), np.full(n, np.nan)
    needs = spec.stop != "bar" or not spec.by_risk
    at = offset + np.arange(n)
    last = total - 1 if cutoff is None else min(cutoff, total - 1)
    end = np.where(at <= last, last, total - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        ok = (at < end) & np.isfinite(o) & np.isfinite(c) & np.isfinite(h) & np.isfinite(low) & (np.isfinite(span) if needs else True) & (c - o > EPS)
        stop = _stops(c, low, span, spec.stop)
        if tick:
            stop = np.floor(stop / tick) * tick
        risk = c - stop
        ok &= np.isfinite(stop) & (stop < c) & (risk > SMALL)
        take = c + spec.reward * (risk if spec.by_risk else span)
        if tick:
            take = np.ceil(take / tick) * tick
        ok &= np.isfinite(take)
        if spec.least_rr is not None:
            ok &= (take - c) / risk > spec.least_rr
        seen = np.isfinite(h) & np.isfinite(low)
        live, step, left = np.flatnonzero(ok), 1, []
        while len(live):
            j = live + step
            inside = offset + j <= end[live]
            if cutoff is not None:
                late = live[~inside]
                late = late[at[late] <= cutoff]
                x = (c[end[late] - offset] - c[late]) / risk[late]
                done = late[np.isfinite(x)]
                rr[done], out[done] = x[np.isfinite(x)], end[done]
            left.append(live[inside & (j >= n)])
            live, j = live[inside & (j < n)], j[inside & (j < n)]
            over, x, win = outcome(o[j], h[j], low[j], stop[live], take[live], c[live], risk[live])
            over &= seen[j]
            who = live[over]
            rr[who], hit[who], out[who] = x[over], win[over], offset + j[over]
            live = live[~over]
            step += 1
    risk_of[np.isfinite(rr)] = risk[np.isfinite(rr)]
    i = np.sort(np.concatenate(left)).astype(np.int64) if left else np.zeros(0, np.int64)
    return {"hit": hit, "rr": rr, "exit": out, "risk": risk_of}, {"at": i, "stop": stop[i], "take": take[i], "entry": c[i], "risk": risk[i]}


def resolve(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, span: np.ndarray, spec: Barrier, long: bool, tick: float | None = None, cutoff: int | None = None) -> dict[str, np.ndarray]:
    """hit, rr, exit and risk of the trades of one side over a whole series."""
    return resolve_part(o, h, low, c, span, spec, long, tick, 0, len(o), cutoff)[0]


def barrier_target(bars: DataFrame, name: str, direction: str = "both", tick: float | None = None, date_end: str | None = None, part: int | None = None) -> DataFrame:
    """Attach a barrier target to bars with ``atr``: name_long / name_short labels, rr_*, exit_i_*, risk_*; NULL where no trade is resolved. Series of more than ``part`` bars are resolved in parts (see ``barriers``)."""
    spec = BARRIERS[name]
    if direction == "both" and not spec.both:
        raise ValueError(f"{name} takes one direction, long or short")

    def kernel(o, h, low, c, span, day) -> dict[str, np.ndarray]:
        cutoff = int(np.flatnonzero(day == 1)[-1]) if (day == 1).any() else None
        made = {}
        for side in SIDES:
            if direction in (side, "both"):
                r = resolve(o, h, low, c, span, spec, side == "long", tick, cutoff)
            else:
                r = {"hit": np.zeros(len(o), bool), "rr": np.full(len(o), np.nan), "exit": np.full(len(o), -1), "risk": np.full(len(o), np.nan)}
            made |= {f"{name}_{side}": r["hit"], f"rr_{name}_{side}": r["rr"], f"{name}_exit_i_{side}": np.ma.masked_equal(r["exit"], -1), f"{name}_risk_{side}": r["risk"]}
        return made

    kinds = {k: t for side in SIDES for k, t in ((f"{name}_{side}", "boolean"), (f"rr_{name}_{side}", "double"), (f"{name}_exit_i_{side}", "long"), (f"{name}_risk_{side}", "double"))}
    held = bars.withColumn("_in", F.lit(0.0) if date_end is None else (F.to_date("ts") <= F.lit(date_end).cast("date")).cast("double"))
    if longest(bars) <= (part or PART):
        out = along_series(held, kernel, ("open", "high", "low", "close", "atr", "_in"), **kinds).drop("_in")
    else:
        out = barriers.in_parts(held, name, spec, SIDES if direction == "both" else (direction,), tick, part or PART, kinds).drop("_in")
    return canonical(out, name, "short" if direction == "short" else "long")


def canonical(df: DataFrame, name: str, side: str) -> DataFrame:
    """The target's own columns: those of the side ("both" takes long), and eligibility by the color of the bar."""
    color = yes(F.col("close") > F.col("open")) if side == "long" else yes(F.col("close") < F.col("open"))
    out = df.withColumns({name: F.col(f"`{name}_{side}`"), f"rr_{name}": F.col(f"`rr_{name}_{side}`"), f"{name}_exit_i": F.col(f"`{name}_exit_i_{side}`"), f"{name}_eligible": color})
    return out.withColumn(f"{name}_risk", F.col(f"`{name}_risk_{side}`")) if f"{name}_risk_{side}" in df.columns else out


def next_bar_target(df: DataFrame, name: str, tick: float | None = None, direction: str = "both", multiple: float = 1.5) -> DataFrame:
    """Enter at the next open, leave at its close or at a stop some wicks away if the bar touches it. A window expression; no grouped pass."""
    wick = F.col(NEXT_BAR[name])
    o, h, low, c = (F.lead(x).over(W.along()) for x in ("open", "high", "low", "close"))
    raw = F.abs(wick * multiple)
    size = tick_distance(raw, tick) if tick else raw
    ok = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull() & (size > SMALL)
    df = df.withColumns({"_o": o, "_h": h, "_l": low, "_c": c, "_size": F.when(ok, size), "_next": F.lead("bar_idx").over(W.along())})
    o, h, low, c, size = (F.col(x) for x in ("_o", "_h", "_l", "_c", "_size"))
    made = {}
    for side in SIDES:
        if direction not in (side, "both"):
            made |= {f"{name}_{side}": F.lit(False), f"rr_{name}_{side}": F.lit(None).cast("double"), f"{name}_exit_i_{side}": F.lit(None).cast("long")}
            continue
        stopped = low <= o - size if side == "long" else h >= o + size
        gain = c - o if side == "long" else o - c
        made |= {f"{name}_{side}": yes((gain > 0) & ~stopped & size.isNotNull()), f"rr_{name}_{side}": F.when(stopped, F.lit(-1.0)).otherwise(gain / size), f"{name}_exit_i_{side}": F.when(size.isNotNull(), F.col("_next"))}
    return canonical(df.withColumns(made).drop("_o", "_h", "_l", "_c", "_size", "_next"), name, "short" if direction == "short" else "long")


def week_key(ts: str = "ts") -> "F.Column":
    """ISO year and week as one number."""
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)).cast("long")


def tribar_week_target(df: DataFrame, per_week: int = 2, multiple: float = 2.0, name: str = "tribar_4h_2atr") -> DataFrame:
    """Long only, for 4-hour bars with ``is_tribar`` and ``is_close_above_kf_ma``: trades that don't overlap, ``per_week`` of an ISO week at most, closed by the week's last bar; the scan begins at the entry bar and the stop counts first."""

    def kernel(h, low, c, signal, week) -> dict[str, np.ndarray]:
        n, span = len(c), atr(h, low, c, 14)
        rr, out, label = np.full(n, np.nan), np.full(n, -1, np.int64), np.zeros(n, bool)
        last = {w: i for i, w in enumerate(week.tolist())}
        used: dict[float, int] = {}
        free = 0
        for i in np.flatnonzero(signal == 1).tolist():
            w = week[i]
            if i < free or used.get(w, 0) >= per_week or not np.isfinite(c[i] + span[i] + low[i]):
                continue
            stop = min(low[i], c[i] - span[i])
            if not c[i] - stop > SMALL:
                continue
            take, end = c[i] + multiple * span[i], last[w]
            seen = np.isfinite(h[i : end + 1]) & np.isfinite(low[i : end + 1]) & np.isfinite(c[i : end + 1])
            touch = np.flatnonzero(seen & ((low[i : end + 1] <= stop) | (h[i : end + 1] >= take)))
            if len(touch):
                j = i + int(touch[0])
                price = stop if low[j] <= stop else take
            elif seen[-1]:
                j, price = end, c[end]
            else:
                j, price = i, c[i]
            rr[i], out[i] = (price - c[i]) / (c[i] - stop), j
            label[i] = rr[i] > 0
            used[w] = used.get(w, 0) + 1
            free = j + 1
        return {name: label, f"rr_{name}": rr, f"{name}_exit_i": np.ma.masked_equal(out, -1)}

    held = df.withColumns({"_signal": (F.col("is_tribar") & F.col("is_close_above_kf_ma")).cast("double"), "_week": week_key().cast("double")})
    return along_series(held, kernel, ("high", "low", "close", "_signal", "_week"), **{name: "boolean", f"rr_{name}": "double", f"{name}_exit_i": "long"}).drop("_signal", "_week")


TARGETS: dict[str, Callable[..., DataFrame]] = {
    **{n: (lambda df, n=n, **k: barrier_target(df, n, **k)) for n in BARRIERS},
    **{n: (lambda df, n=n, **k: next_bar_target(df, n, **k)) for n in NEXT_BAR},
    "tribar_4h_2atr": lambda df, **k: tribar_week_target(df, **k),
}


def target(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a target of one's own: a function of a feature frame that attaches ``name``, ``rr_name`` and ``name_exit_i``."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in TARGETS:
            raise ValueError(f"there is a target {name}")
        TARGETS[name] = f
        return f

    return put


def attach(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in TARGETS:
        raise ValueError(f"unknown target {name}; known are {', '.join(sorted(TARGETS))}")
    return TARGETS[name](df, **options)


def drop_targets(columns: list[str]) -> list[str]:
    """Columns that may be searched: no target, no return, none of a target's parts."""
    ends = ("_long", "_short", "_exit_i", "_exit_i_long", "_exit_i_short", "_eligible", "_eligible_long", "_eligible_short", "_risk", "_risk_long", "_risk_short")
    bad = {f"{t}{e}" for t in TARGETS for e in ("", *ends)}
    return [x for x in columns if x not in bad and not x.startswith("rr_")]
