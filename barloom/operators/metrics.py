"""Metrics of a sequence of trades, as numpy kernels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizing:
    """Capital and risk in percent of it for each trade; ``contracts`` sizes in whole contracts by dollar risk."""

    capital: float = 100_000.0
    risk_pct: float = 1.0
    years: float = 1.0
    contracts: bool = False
    least: int = 1
    most: int | None = None
    margin: float | None = None
    dollars_per_r: float = 0.0


#: Point value, tick value, tick, commission for a side, margin.
ASSETS = {"ES": (50.0, 12.5, 0.25, 2.25, 25_000.0), "MES": (5.0, 1.25, 0.25, 0.57, 2_500.0)}


def asset(name: str) -> tuple[float, float, float, float, float]:
    if name.upper() not in ASSETS:
        raise ValueError(f"unknown asset {name}; known are {', '.join(ASSETS)}")
    return ASSETS[name.upper()]


def risk_dollars(distance: Column, value: float) -> Column:
    """What a contract risks: the distance of the stop times the value of a point (or tick); NULL unless it is finite and above 0."""
    d = distance.cast("double") * F.lit(float(value))
    return F.when((d > 0) & (d < float("inf")), d)


def capital_path(rr: np.ndarray, s: Sizing, risk: np.ndarray | None = None) -> np.ndarray:
    """Capital before the first and after each trade."""
    if not s.contracts:
        return s.capital * np.concatenate(([1.0], np.cumprod(1.0 + rr * s.risk_pct / 100.0)))
    out = np.empty(len(rr) + 1)
    out[0] = x = s.capital
    for i, r in enumerate(rr.tolist()):
        d = float(risk[i]) if risk is not None else math.nan
        if math.isfinite(d) and d > 0:
            raw = math.floor(x * s.risk_pct / 100.0 / d) if math.isfinite(x) else 0
            k = max(max(raw, 0), max(s.least, 1))
            if s.most is not None:
                k = min(k, s.most)
            if s.margin and s.margin > 0 and x > 0:
                k = min(k, math.floor(x / s.margin))
            x += r * d * k
        out[i + 1] = x
    return out


def _equity(path: np.ndarray, s: Sizing) -> dict[str, float]:
    if s.capital <= 0 or s.risk_pct <= 0 or len(path) < 2:
        return {"final_capital": 0.0, "total_return_pct": 0.0, "cagr_pct": 0.0, "max_drawdown_pct_equity": 0.0, "calmar_ratio": 0.0}
    peak = np.maximum.accumulate(path)
    down = float(((peak - path) / peak * 100.0).max()) if (peak > 0).all() else 0.0
    gain = (path[-1] / s.capital - 1.0) * 100.0
    years, growth = max(s.years, 1e-9), path[-1] / s.capital
    cagr = (growth ** (1.0 / years) - 1.0) * 100.0 if math.isfinite(growth) and growth > 0 else gain
    return {"final_capital": float(path[-1]), "total_return_pct": float(gain), "cagr_pct": float(cagr), "max_drawdown_pct_equity": down, "calmar_ratio": float(cagr / down) if down > 0 else (math.inf if cagr > 0 else 0.0)}


def r_drawdown(rr: np.ndarray) -> np.ndarray:
    """How far the running sum is below its peak, which is 0 at least."""
    e = np.cumsum(rr)
    return e - np.maximum(np.maximum.accumulate(e), 0.0)


def core_metrics(rr: np.ndarray, s: Sizing, risk: np.ndarray | None = None) -> dict[str, float]:
    n = len(rr)
    wins = int((rr > 0).sum())
    return {"wins": wins, "losses": int((rr < 0).sum()), "win_rate": wins / n * 100.0 if n else 0.0, "total_return": float(np.cumsum(rr)[-1]) if n else 0.0, "max_drawdown": float(-r_drawdown(rr).min()) if n else 0.0, **_equity(capital_path(rr, s, risk), s)}


def core_rows(rr: np.ndarray, trades: np.ndarray, s: Sizing, path: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """core_metrics of many sequences at once: a row each, filled up with zeros; ``path`` is their capital where it isn't the fractional one."""
    n = len(rr)
    eq = np.cumsum(rr, axis=1)
    down = np.maximum(np.maximum.accumulate(eq, axis=1), 0.0) - eq
    wins = (rr > 0).sum(axis=1)
    out = {"wins": wins, "losses": (rr < 0).sum(axis=1), "win_rate": wins / np.maximum(trades, 1) * 100.0, "total_return": eq[:, -1] if n else np.zeros(0), "max_drawdown": down.max(axis=1, initial=0.0)}
    if s.capital <= 0 or s.risk_pct <= 0:
        return out | dict.fromkeys(("final_capital", "total_return_pct", "cagr_pct", "max_drawdown_pct_equity", "calmar_ratio"), np.zeros(n))
    if path is None:
        path = s.capital * np.cumprod(np.concatenate((np.ones((n, 1)), 1.0 + rr * s.risk_pct / 100.0), axis=1), axis=1)
    peak = np.maximum.accumulate(path, axis=1)
    worst = ((peak - path) / peak * 100.0).max(axis=1, initial=0.0)
    growth = path[:, -1] / s.capital
    gain, years = (growth - 1.0) * 100.0, max(s.years, 1e-9)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        cagr = np.where(np.isfinite(growth) & (growth > 0), (np.maximum(growth, 0.0) ** (1.0 / years) - 1.0) * 100.0, gain)
        calmar = np.where(worst > 0, cagr / worst, np.where(cagr > 0, np.inf, 0.0))
    return out | {"final_capital": path[:, -1], "total_return_pct": gain, "cagr_pct": cagr, "max_drawdown_pct_equity": worst, "calmar_ratio": calmar}


def streaks(signs: np.ndarray, sign: int) -> np.ndarray:
    """Lengths of the runs of a sign; a 0 ends runs of both."""
    on = np.concatenate(([0], (signs == sign).astype(np.int8), [0]))
    d = np.diff(on)
    return np.flatnonzero(d == -1) - np.flatnonzero(d == 1)


def spread(rr: np.ndarray) -> tuple[float, float, float]:
    """Median, and the elements next to the 5th and 95th percentile; no interpolation."""
    if not len(rr):
        return 0.0, 0.0, 0.0
    x, n = np.sort(rr), len(rr)
    half = lambda v: int(math.floor(v + 0.5))
    return float(np.median(x)), float(x[half((n - 1) * 0.05)]), float(x[half((n - 1) * 0.95)])


def quality(n: int) -> str:
    return "excellent" if n >= 100 else "good" if n >= 50 else "fair" if n >= 30 else "poor"


def quality_column(n: Column) -> Column:
    """The same of a column of counts."""
    return F.when(n >= 100, "excellent").when(n >= 50, "good").when(n >= 30, "fair").otherwise("poor")


def spread_of(df: DataFrame, value: str) -> DataFrame:
    """n, median_rr, p05_rr, p95_rr of a column, as ``spread`` gives them."""
    n = df.count()
    if not n:
        return df.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0)], "n long, median_rr double, p05_rr double, p95_rr double")
    element = lambda share: F.expr(f"percentile_disc({(math.floor((n - 1) * share + 0.5) + 0.5) / n!r}) WITHIN GROUP (ORDER BY `{value}`)")
    return df.agg(F.count("*").alias("n"), F.median(value).alias("median_rr"), element(0.05).alias("p05_rr"), element(0.95).alias("p95_rr"))


def full_metrics(rr: np.ndarray, s: Sizing, risk: np.ndarray | None = None) -> dict[str, float | str]:
    """Core metrics and everything that only reports show."""
    out: dict[str, float | str] = dict(core_metrics(rr, s, risk))
    n = len(rr)
    win, loss = rr[rr > 0], -rr[rr < 0]
    out["expectancy"] = float(out["total_return"]) / n if n else 0.0
    out["profit_factor"] = float(win.sum() / loss.sum()) if loss.sum() > 0 else math.inf if len(win) else 0.0
    a, b = (float(win.mean()) if len(win) else 0.0), (float(loss.mean()) if len(loss) else 0.0)
    out |= {"avg_winning_rr": a, "avg_losing_rr": -b if len(loss) else 0.0, "win_loss_ratio": a / b if b > 0 else math.inf if a > 0 else 0.0, "largest_win": float(win.max(initial=0.0)), "largest_loss": float(loss.max(initial=0.0))}
    dd = r_drawdown(rr)
    peak = np.maximum(np.maximum.accumulate(np.cumsum(rr)), 0.0) if n else rr
    eps = np.finfo(float).eps
    pct = np.where(np.abs(peak) >= eps, dd / (peak + eps) * 100.0, 0.0)
    out["ulcer_index"] = float(np.sqrt((pct * pct).sum() / n)) if n and (peak >= eps).any() else 0.0
    out["pain_ratio"] = float(out["total_return"]) / abs(float(dd.mean())) if n and dd.mean() < 0 else 0.0
    signs = np.sign(rr)
    for name, sign in (("win", 1), ("loss", -1)):
        runs = streaks(signs, sign)
        out |= {f"max_consecutive_{'wins' if sign > 0 else 'losses'}": int(runs.max(initial=0)), f"avg_{name}_streak": float(runs.mean()) if len(runs) else 0.0}
    out["median_rr"], out["p05_rr"], out["p95_rr"] = spread(rr)
    out["sample_quality"] = quality(n)
    out |= {"total_return_dollar": float(out["total_return"]) * s.dollars_per_r, "max_drawdown_dollar": float(out["max_drawdown"]) * s.dollars_per_r, "expectancy_dollar": float(out["expectancy"]) * s.dollars_per_r, "sharpe_equity": 0.0, "sortino_equity": 0.0}
    if s.capital > 0 and s.risk_pct > 0 and n:
        path = capital_path(rr, s, risk)
        pnl = np.diff(path)
        ret = np.where(path[:-1] > 0, path[1:] / path[:-1] - 1.0, 0.0)
        out |= {"total_return_dollar": float(pnl.sum()), "expectancy_dollar": float(pnl.sum()) / n, "max_drawdown_dollar": float((np.maximum.accumulate(path) - path).max())}
        mean, std = float(ret.mean()), math.sqrt(max(float((ret * ret).mean()) - float(ret.mean()) ** 2, 0.0))
        low = ret[ret < 0]
        down, scale = (math.sqrt(float((low * low).mean())) if len(low) else 0.0), math.sqrt(max(n / max(s.years, 1e-9), 1e-9))
        out["sharpe_equity"] = mean / std * scale if std > 0 else 0.0
        out["sortino_equity"] = mean / down * scale if down > 0 else math.inf if mean > 0 else 0.0
    return out
