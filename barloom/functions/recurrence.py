"""True recurrences along a series, as numpy kernels.

A linear recurrence y[t] = a[t] y[t-1] + b[t] composes, so a long series is cut into parts that need not meet in one task: see ``chain``. Each kernel is a generator over the arrays of a part (``*_of``); the functions of arrays
run it over a whole series. No kernel looks at a row in Python unless values are missing. NaN stands for undefined inside a kernel and leaves it as NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import with_fields
from .chain import Affine, Count, Kernel, Level, Mobius, Started, Tail, affine_scan, alone, along_parts, columns, together

COUNT, PREVIOUS, AFFINE, STARTED, MOBIUS, LEVEL = Count(), Tail(1), Affine(), Started(), Mobius(), Level()


def ema_of(x: np.ndarray, n: int, skip: int = 0) -> Kernel:
    """alpha = 2 / (n + 1), begun with the mean of the first n after ``skip`` bars; a missing value ends it."""
    (c,) = yield [(COUNT, [len(x)])]
    t = int(c[0]) + np.arange(len(x)) - skip
    alpha = 2.0 / (n + 1.0)
    a = np.where(t < n, 1.0, 1.0 - alpha)
    b = np.where(t < 0, 0.0, np.where(t < n, x / n, alpha * x))  # the mean gathers first
    (y,) = yield [(AFFINE, AFFINE.of(a, b))]
    return np.where(t < n - 1, np.nan, affine_scan(a, b, y[0]))


def rma_of(x: np.ndarray, n: int) -> Kernel:
    """alpha = 1 / n, begun with the first value; a missing value holds the last."""
    fine = np.isfinite(x)
    a, b = np.where(fine, 1.0 - 1.0 / n, 1.0), np.where(fine, 1.0 / n * np.where(fine, x, 0.0), 0.0)
    own, at = np.full(len(x), np.nan), int(np.argmax(fine))
    if fine.any():
        own[at] = x[at]
        own[at + 1 :] = affine_scan(a[at + 1 :], b[at + 1 :], x[at])
    (y,) = yield [(STARTED, [*AFFINE.of(a, b), own[-1]])]
    return own if np.isnan(y[0]) else affine_scan(a, b, y[0])


def kalman_of(x: np.ndarray, process: float, noise: float) -> Kernel:
    """Level and innovation of a local-level filter. The variance follows a fractional linear map that depends only on which values are missing; given the gains the level is a linear recurrence."""
    fine = np.isfinite(x)
    seen, unseen = np.array([[noise, noise * process], [1.0, process + noise]]), np.array([[1.0, process], [0.0, 1.0]])
    (c,) = yield [(MOBIUS, MOBIUS.of(np.where(fine[:, None, None], seen, unseen)))]
    gain, p = np.zeros(len(x)), float(c[0])
    for i in range(len(x)):
        q = p + process
        if fine[i]:
            k = gain[i] = q / (q + noise)
            new = (1.0 - k) * q
            if new == p and fine[i:].all():  # settled
                gain[i:] = k
                break
            p = new
        else:
            p = q
    v, some = np.where(fine, x, 0.0), bool(fine.any())
    (c,) = yield [(LEVEL, [*AFFINE.of(1.0 - gain, gain * v), x[np.argmax(fine)] if some else np.nan])]
    level = affine_scan(1.0 - gain, gain * v, c[0])
    if not c[2]:
        level[: int(np.argmax(fine)) + 1 if some else len(x)] = c[1]  # exactly, not to within rounding
    before = np.concatenate((c[:1], level[:-1]))
    return level, np.where(fine, v - before, 0.0)


def place_of(x: np.ndarray) -> Kernel:
    (c,) = yield [(COUNT, [len(x)])]
    return c[0] + np.arange(len(x), dtype=float)


def before_of(x: np.ndarray) -> Kernel:
    """The value of the bar before, NaN at the first."""
    (c,) = yield [(PREVIOUS, PREVIOUS.of(x))]
    return np.concatenate((c, x[:-1]))


def rsi_of(close: np.ndarray, n: int) -> Kernel:
    d = close - (yield from before_of(close))
    gain, loss = yield from together(rma_of(np.maximum(d, 0.0), n), rma_of(np.maximum(-d, 0.0), n))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0.0, 100.0, 100.0 - 100.0 / (1.0 + gain / loss))


def macd_of(close: np.ndarray) -> Kernel:
    """Line, signal and histogram of 12, 26 and 9 bars."""
    fast, slow = yield from together(ema_of(close, 12), ema_of(close, 26))
    line = fast - slow
    signal = yield from ema_of(line, 9, skip=25)
    return line, signal, line - signal


def _range(high: np.ndarray, low: np.ndarray, prev: np.ndarray, first: bool) -> np.ndarray:
    """True range; the first bar of a series has no bar before it, others may miss its close."""
    tr = np.maximum(high - low, np.maximum(np.abs(high - prev), np.abs(low - prev)))
    if first:
        tr[:1] = high[:1] - low[:1]
    return tr


def true_range_of(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> Kernel:
    n, c = yield [(COUNT, [len(close)]), (PREVIOUS, PREVIOUS.of(close))]
    return _range(high, low, np.concatenate((c, close[:-1])), n[0] == 0)


def atr_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> Kernel:
    return (yield from rma_of((yield from true_range_of(high, low, close)), n))


def atr_close_of(close: np.ndarray, n: int = 14) -> Kernel:
    """Mean absolute change of close: a growing mean over the first n bars, then exponential; a missing change falls back on the mean of the last n."""
    tail = Tail(n + 1)
    at, c = yield [(COUNT, [len(close)]), (tail, tail.of(close))]
    d = np.abs(np.diff(np.concatenate((c, close))))  # n changes of earlier parts, then one for each bar
    there = np.isfinite(d)
    s, k = np.concatenate(([0.0], np.cumsum(np.where(there, d, 0.0)))), np.concatenate(([0], np.cumsum(there)))
    count = k[n + 1 :] - k[1:-n]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(count > 0, (s[n + 1 :] - s[1:-n]) / count, np.nan)
    d, fine = d[n:], there[n:]
    alpha, gone = 2.0 / (n + 1.0), np.isnan(mean)
    anew = (int(at[0]) + np.arange(len(d)) < n) | ~fine
    anew[1:] |= (anew & gone)[:-1]
    a, b = np.where(anew, 0.0, 1.0 - alpha), np.where(anew, np.where(gone, 0.0, mean), alpha * np.where(fine, d, 0.0))
    a0, b0 = np.concatenate(([0.0], a[1:])), np.concatenate((np.where(gone, 0.0, mean)[:1], b[1:]))
    lost = bool(anew[-1] and gone[-1])
    ends = [0.0, np.nan, np.nan] if lost else [*AFFINE.of(a, b), affine_scan(a0, b0, 0.0)[-1]]
    (y,) = yield [(STARTED, ends)]
    out = affine_scan(a0, b0, 0.0) if np.isnan(y[0]) else affine_scan(a, b, y[0])
    return np.where(anew & gone, np.nan, out)


def adx_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> Kernel:
    at, h, w, c = yield [(COUNT, [len(close)]), *[(PREVIOUS, PREVIOUS.of(x)) for x in (high, low, close)]]
    up, down = high - np.concatenate((h, high[:-1])), np.concatenate((w, low[:-1])) - low
    tr = _range(high, low, np.concatenate((c, close[:-1])), at[0] == 0)
    if at[0] == 0:
        up[:1] = down[:1] = tr[:1] = 0.0
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    span, plus, minus = yield from together(rma_of(tr, n), rma_of(plus, n), rma_of(minus, n))
    eps = np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(np.abs(span) < eps, 0.0, plus / span * 100.0)
        m = np.where(np.abs(span) < eps, 0.0, minus / span * 100.0)
        dx = np.where(np.abs(p + m) < eps, 0.0, np.abs(p - m) / (p + m) * 100.0)
    return (yield from rma_of(np.where(np.isfinite(dx), dx, 0.0), n))


def _over_series(of):
    """The kernel over arrays of a whole series; an empty one has no bars."""

    def run(*arrays, **options):
        if not len(arrays[0]):
            return arrays[0].copy() if of not in (kalman_of, macd_of) else tuple(arrays[0].copy() for _ in range(2 if of is kalman_of else 3))
        return alone(of(*arrays, **options))

    run.__doc__ = of.__doc__
    return run


ema, rma, kalman, rsi, macd, true_range, atr, atr_close, adx = (_over_series(f) for f in (ema_of, rma_of, kalman_of, rsi_of, macd_of, true_range_of, atr_of, atr_close_of, adx_of))


def _filtered(kernel: Kernel, process: float, noise: float) -> Kernel:
    """What a kernel gives, and level and innovation of a filter over it."""
    x = yield from kernel
    return x, *(yield from kalman_of(x, process, noise))


def _all(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> Kernel:
    """The recurrent columns of the feature frame, and the place of each bar in its series."""
    got = yield from together(
        together(*[ema_of(c, n) for n in (9, 20, 50, 200)]), together(*[rsi_of(c, n) for n in (14, 7, 21)]), macd_of(c), kalman_of(c, 0.01, 0.1), kalman_of(c, 0.001, 0.5), kalman_of(np.where(c > o, o - low, h - o), 0.01, 0.1), place_of(c),
        _filtered(adx_of(h, low, c), 0.005, 0.2), _filtered(atr_of(h, low, c), 0.01, 0.15), _filtered(atr_close_of(c), 0.01, 0.15),
    )
    emas, rsis, lines, smooth, trend, wicks, place, *filtered = got
    out = dict(zip(("ema9", "ema20", "ema50", "ema200"), emas)) | dict(zip(("rsi_14", "rsi_7", "rsi_21"), rsis)) | dict(zip(("macd", "macd_signal", "macd_hist"), lines))
    out |= {"kf_smooth": smooth[0], "kf_innovation": smooth[1], "kf_trend": trend[0], "kf_wicks_smooth": wicks[0], "_pos": place}
    for name, (x, level, innovation) in zip(("adx", "atr", "atr_c2c"), filtered):
        out |= {name: x, f"kf_{name}": level, f"kf_{name}_innovation": innovation}
    return out


FOLDS = tuple(alone(_all(*[np.ones(2)] * 4)))


def along_series(df: DataFrame, kernel, inputs: tuple[str, ...], **outputs: str) -> DataFrame:
    """Append columns that ``kernel(*arrays) -> dict of arrays`` makes of each series in the order of its bars. Inputs are float arrays with NaN for NULL."""
    names = list(outputs)
    schema = with_fields(df.schema, **outputs)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_idx").combine_chunks()
        arrays = [table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) if c != "ts" else table.column(c).cast(pa.int64()).to_numpy() for c in inputs]
        for name, col in zip(names, columns(kernel(*arrays), outputs)):
            table = table.append_column(name, col)
        return table

    return df.groupBy("series_id").applyInArrow(run, schema)


def recurrences(bars: DataFrame, part: int | None = None) -> DataFrame:
    """Bars and all recurrent columns of the feature frame."""
    return along_parts(bars, _all, ("open", "high", "low", "close"), part, **dict.fromkeys(FOLDS, "double"))
