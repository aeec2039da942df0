"""Queries of single kernels over three kinds of bars, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recurrence as R
from ..functions import scalar as S
from ..functions import window as W
from ..sources.bars import bars_day_type, bars_hour, bars_orders

c = F.col

_SOURCES = (
    ("'events'", "date_trunc('hour', ts)", "value", "ts, event_id", "events"),
    ("event_type", "date_trunc('day', ts)", "value", "ts, event_id", "events"),
    ("'orders'", "date_trunc('day', o_orderdate)", "o_totalprice", "o_orderkey", "orders"),
)


def _bars_sql(series: str, bucket: str, value: str, order: str, table: str) -> str:
    return f"""SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx, ts, open, high, low, close, volume FROM (
  SELECT {series} AS series_id, {bucket} AS ts, arg_min({value}, row({order})) AS open, max({value}) AS high, min({value}) AS low, arg_max({value}, row({order})) AS close, count(*) AS volume FROM {table} GROUP BY 1, 2)"""


BARS = "b AS (" + " UNION ALL ".join(_bars_sql(*s) for s in _SOURCES) + ")"
HOUR = "b AS (" + _bars_sql(*_SOURCES[0]) + ")"


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_hour(spark, sf_dir).unionByName(bars_day_type(spark, sf_dir)).unionByName(bars_orders(spark, sf_dir))


def w(n: int) -> str:
    return f"OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ALONG = "OVER (PARTITION BY series_id ORDER BY bar_idx)"
LAG = lambda x, n=1: f"lag({x}, {n}) {ALONG}"
FLAG = lambda x: f"CAST(coalesce({x}, false) AS INTEGER)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def put(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _out(df: DataFrame, v: Column, flag: bool) -> DataFrame:
    return df.select("series_id", "bar_idx", v.cast("int").alias("v") if flag else S.rounded(v.cast("double"), 4).alias("v"))


def window_query(name: str, v: Callable[[], Column], sql: str, first: dict[str, tuple[Callable[[], Column], str]] | None = None, flag: bool = False) -> None:
    """A window expression, after columns of a first layer; a flag is 0 or 1. Columns come as functions: they need a session, the registry doesn't."""
    first = first or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = all_bars(spark, sf_dir)
        return _out(df.withColumns({k: x() for k, (x, _) in first.items()}) if first else df, v(), flag)

    inner = f"SELECT *, {', '.join(f'{s} AS {k}' for k, (_, s) in first.items())} FROM b" if first else "SELECT * FROM b"
    put(name, run, f"WITH {BARS}, x AS ({inner}) SELECT series_id, bar_idx, {FLAG(sql) if flag else f'round(CAST({sql} AS DOUBLE), 4)'} AS v FROM x")


#: bars of a part: few enough for the longest series of the test data to have several
FOLD_PART = 500


def fold_query(name: str, kernel, inputs: tuple[str, ...], sql: str, which: int | None = None, part: int | None = FOLD_PART) -> None:
    """A recurrence along series that span several parts (``which`` of its results); ``sql`` is a list of CTEs over b that ends with one named r (series_id, bar_idx, v)."""

    def make(*a):
        v = yield from kernel(*a)
        return {"v": v if which is None else v[which]}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = R.along_parts(all_bars(spark, sf_dir), make, inputs, part, v="double")
        return df.select("series_id", "bar_idx", S.rounded("v", 4).alias("v"))

    put(name, run, f"WITH RECURSIVE {BARS}, {sql} SELECT b.series_id, b.bar_idx, round(r.v, 4) AS v FROM b LEFT JOIN r ON r.series_id = b.series_id AND r.bar_idx = b.bar_idx")


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {w(n)} = {n} THEN {value} END"


def sma(x: str, n: int) -> str:
    return full(x, n, f"avg({x}) {w(n)}")


def std(x: str, n: int) -> str:
    return full(x, n, f"stddev_samp({x}) {w(n)}")


def low(x: str, n: int) -> str:
    return f"CASE WHEN count(*) {w(n)} = {n} THEN min({x}) {w(n)} END"


GREEN = (lambda: S.yes(c("close") > c("open")), "close > open")
RED = (lambda: S.yes(c("close") < c("open")), "close < open")
BODY = (lambda: F.abs(c("close") - c("open")), "abs(close - open)")
UPPER = (lambda: S.upper_wick(c("open"), c("high"), c("close")), "high - greatest(open, close)")
LOWER = (lambda: S.lower_wick(c("open"), c("low"), c("close")), "least(open, close) - low")
PREV = (lambda: W.lag(c("close")), LAG("close"))
SMA20, SMA50 = (lambda: W.sma(c("close"), 20), sma("close", 20)), (lambda: W.sma(c("close"), 50), sma("close", 50))
STD20 = (lambda: W.rolling_std(c("close"), 20), std("close", 20))

window_query("k01_sma", lambda: W.sma(c("close"), 20), sma("close", 20))
window_query("k06_rolling_std", lambda: W.rolling_std(c("close"), 20), std("close", 20))
window_query("k07_rolling_min", lambda: W.rolling_min(c("low"), 14), low("low", 14))
window_query("k08_rolling_cv", lambda: W.rolling_cv(c("close"), 20), f"CASE WHEN abs({sma('close', 20)}) < 2.3e-16 THEN 0 ELSE {std('close', 20)} / {sma('close', 20)} END")
window_query("k09_rolling_bool_sum", lambda: W.rolling_true(c("g"), 3), f"CASE WHEN count(*) {w(3)} = 3 THEN sum(CAST(g AS INTEGER)) {w(3)} END", {"g": GREEN})
window_query("k10_streak", lambda: W.streak(c("g"), 2), f"count(*) {w(2)} = 2 AND sum(CAST(g AS INTEGER)) {w(2)} = 2", {"g": GREEN}, True)
window_query("k11_shift_bool", lambda: W.shifted(c("g")), f"lag(g, 1, false) {ALONG}", {"g": GREEN}, True)
window_query("k12_momentum", lambda: W.momentum(c("close"), 14), f"CASE WHEN bar_idx < 14 THEN 0 ELSE close - {LAG('close', 14)} END")
window_query("k13_roc", lambda: W.roc(c("close"), 5), f"CASE WHEN abs({LAG('close', 5)}) >= 2.3e-16 THEN close / {LAG('close', 5)} - 1 END")
window_query("k14_derivative", lambda: W.momentum(c("close"), 1), f"CASE WHEN bar_idx < 1 THEN 0 ELSE close - {LAG('close')} END")
window_query("k18_bollinger", lambda: W.bollinger(c("close"))[1], f"{sma('close', 20)} + 2 * {std('close', 20)}")
window_query("k19_bollinger_position", lambda: S.bollinger_position(c("close"), c("m") - 2 * c("s"), c("m") + 2 * c("s")), "CASE WHEN abs(4 * s) < 2.3e-16 THEN 0.5 ELSE (close - (m - 2 * s)) / ((m + 2 * s) - (m - 2 * s)) END", {"m": SMA20, "s": STD20})
window_query("k20_extension", lambda: W.extension(c("high"), c("low"), 20), f"coalesce(high - {low('low', 20)}, 0)")
window_query("k22_percentile_rank", lambda: W.percentile_rank(c("close")), "(rank() OVER (PARTITION BY series_id ORDER BY close) + (count(*) OVER (PARTITION BY series_id, close) - 1) / 2.0) / count(*) OVER (PARTITION BY series_id)")
window_query("k24_true_range", lambda: W.true_range(), f"CASE WHEN {LAG('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {LAG('close')}), abs(low - {LAG('close')})) END")
window_query("k27_squeeze", lambda: W.squeeze(c("close"), 50, 1.1), f"close < {low('close', 50)} * 1.1", None, True)
window_query("k28_levels_long", lambda: S.stop_level(c("close"), c("low"), c("s"), True, "tight"), "CASE WHEN low < close AND close - s < close THEN greatest(low, close - s) WHEN low < close THEN low WHEN close - s < close THEN close - s END", {"s": STD20})
window_query("k28_levels_short", lambda: S.stop_level(c("close"), c("high"), c("s"), False, "tight"), "CASE WHEN high > close AND close + s > close THEN least(high, close + s) WHEN high > close THEN high WHEN close + s > close THEN close + s END", {"s": STD20})
window_query("f01_round", lambda: F.round(c("close") / 7, 3), "round(close / 7, 3)")
window_query("f02_arithmetic", lambda: F.greatest(F.abs(c("close") - c("open")), c("high") - c("low")) + 1, "greatest(abs(close - open), high - low) + 1")
window_query("f03_ratio", lambda: S.ratio(c("open"), c("close") - c("low")), "CASE WHEN abs(close - low) < 2.3e-16 THEN 0 ELSE open / (close - low) END")
window_query("f03_deviation", lambda: S.deviation(c("close"), c("m")), "CASE WHEN abs(m) < 2.3e-16 THEN 0 ELSE close / m - 1 END", {"m": SMA20})
window_query("f04_threshold", lambda: S.above(c("close"), 100.0), "close > 100", None, True)
window_query("f05_threshold_compare", lambda: S.above(c("close"), c("m") * 1.2), "close > m * 1.2", {"m": SMA20}, True)
window_query("f06_zscore", lambda: S.zscore_beyond(c("close"), c("m"), c("s"), 2.0), "CASE WHEN s = 0 THEN false ELSE abs((close - m) / s) > 2 END", {"m": SMA20, "s": STD20}, True)
window_query("f07_derivative_threshold", lambda: S.above(W.momentum(c("close"), 1), 5.0), f"CASE WHEN bar_idx < 1 THEN 0 ELSE close - {LAG('close')} END > 5", None, True)
window_query("f08_recovery", lambda: W.recovers(c("close"), 50.0), f"{LAG('close')} < 50 AND close > 50", None, True)
window_query("f09_comparison", lambda: W.changes(c("high"), True, 3), f"high > {LAG('high', 3)}", None, True)
window_query("f10_double_rising", lambda: W.double_rising(c("close")), f"close > {LAG('close')} AND {LAG('close')} > {LAG('close', 2)}", None, True)
window_query("f11_acceleration", lambda: W.accelerates(c("d")), f"d > 0 AND d > {LAG('d')}", {"d": (lambda: W.momentum(c("close"), 1), f"CASE WHEN bar_idx < 1 THEN 0 ELSE close - {LAG('close')} END")}, True)
window_query("f12_compare_series", lambda: S.clearly_above(c("close"), c("m")), "close - m > 1e-10", {"m": SMA20}, True)
window_query("f13_cross", lambda: W.crosses(c("a"), c("m")), f"{LAG('a')} <= {LAG('m')} AND a > m", {"a": SMA20, "m": SMA50}, True)
window_query("f14_dual_condition", lambda: c("g") & S.above(c("close"), 100.0), "g AND close > 100", {"g": GREEN}, True)
window_query("f15_upper_wick", UPPER[0], UPPER[1])
window_query("f15_lower_wick", LOWER[0], LOWER[1])
window_query("f16_alignment", lambda: S.chain(c("close"), c("a"), c("m")), "close > a AND a > m", {"a": SMA20, "m": SMA50}, True)
window_query("f17_hammer", lambda: S.yes((c("y") < c("l") * 0.5) & (c("l") > c("u") * 2.0)), "y < l * 0.5 AND l > u * 2", {"y": BODY, "u": UPPER, "l": LOWER}, True)
window_query("f17_shooting_star", lambda: S.yes((c("y") < c("u") * 0.5) & (c("u") > c("l") * 2.0)), "y < u * 0.5 AND u > l * 2", {"y": BODY, "u": UPPER, "l": LOWER}, True)
window_query("f17_engulfing", lambda: S.yes(c("g") & W.shifted(c("r")) & (c("y") > W.lag(c("y")))), f"g AND {LAG('r')} AND y > {LAG('y')}", {"g": GREEN, "r": RED, "y": BODY}, True)
window_query("f17_large_body", lambda: S.yes(c("g") & (c("y") > c("s") * 1.5)), "g AND y > s * 1.5", {"g": GREEN, "y": BODY, "s": STD20}, True)
window_query("f18_tick_price_floor", lambda: S.tick_price(c("close") / 7, 0.25, "floor"), "floor((close / 7) / 0.25) * 0.25")
window_query("f18_tick_distance_ceil", lambda: S.tick_distance(F.abs(c("close") - c("open")), 0.25), "CASE WHEN abs(close - open) < 2.3e-16 THEN 0 ELSE greatest(ceil(abs(close - open) / 0.25), 1) * 0.25 END")


def ema_sql(name: str, source: str, x: str, n: int) -> str:
    """CTE of an EMA of x, which is defined from its first row in each series on, in a source with places i from 0."""
    a = 2.0 / (n + 1)
    return f"""{name}(series_id, i, v) AS (
  SELECT series_id, CAST({n - 1} AS BIGINT), avg({x}) FROM {source} WHERE i < {n} GROUP BY series_id HAVING count(*) = {n}
  UNION ALL SELECT s.series_id, s.i, {a!r} * s.{x} + (1 - {a!r}) * p.v FROM {name} p JOIN {source} s ON s.series_id = p.series_id AND s.i = p.i + 1)"""


def rma_sql(name: str, source: str, columns: dict[str, str], n: int) -> str:
    """CTE of RMAs of columns that are defined in each row of a source, from its smallest place on."""
    first = ", ".join(f"{x} AS {k}" for k, x in columns.items())
    step = ", ".join(f"s.{x} / {n}.0 + (1 - 1 / {n}.0) * p.{k}" for k, x in columns.items())
    return f"""{name}(series_id, i, {', '.join(columns)}) AS (
  SELECT series_id, i, {first} FROM {source} s WHERE i = (SELECT min(i) FROM {source} t WHERE t.series_id = s.series_id)
  UNION ALL SELECT s.series_id, s.i, {step} FROM {name} p JOIN {source} s ON s.series_id = p.series_id AND s.i = p.i + 1)"""


def kalman_sql(name: str, source: str, x: str, q: float, r: float) -> str:
    return f"""{name}(series_id, i, v, p, innovation) AS (
  SELECT series_id, i, CAST({x} AS DOUBLE), (1 - (1 + {q}) / (1 + {q} + {r})) * (1 + {q}), CAST(0 AS DOUBLE) FROM {source} WHERE i = 0
  UNION ALL SELECT s.series_id, s.i, k.v + (k.p + {q}) / (k.p + {q} + {r}) * (s.{x} - k.v), (1 - (k.p + {q}) / (k.p + {q} + {r})) * (k.p + {q}), s.{x} - k.v
  FROM {name} k JOIN {source} s ON s.series_id = k.series_id AND s.i = k.i + 1)"""


SRC = f"""src AS (SELECT series_id, bar_idx AS i, open, high, low, close, CASE WHEN {LAG('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {LAG('close')}), abs(low - {LAG('close')})) END AS tr,
  close - {LAG('close')} AS d, high - {LAG('high')} AS up, {LAG('low')} - low AS down FROM b)"""
ATR14 = rma_sql("a14", "src", {"v": "tr"}, 14)
R_ = lambda x, v="v": f"r AS (SELECT series_id, i AS bar_idx, {v} AS v FROM {x})"
OHLC, HLC = ("open", "high", "low", "close"), ("high", "low", "close")

fold_query("k03_ema", lambda x: R.ema_of(x, 9), ("close",), f"{SRC}, {ema_sql('e', 'src', 'close', 9)}, {R_('e')}")
fold_query("k04_rma", lambda x: R.rma_of(x, 14), ("close",), f"{SRC}, {rma_sql('a', 'src', {'v': 'close'}, 14)}, {R_('a')}")
fold_query("k05_kalman", lambda x: R.kalman_of(x, 0.01, 0.1), ("close",), f"{SRC}, {kalman_sql('k', 'src', 'close', 0.01, 0.1)}, {R_('k')}", 0)
fold_query("k05_kalman_innovation", lambda x: R.kalman_of(x, 0.01, 0.1), ("close",), f"{SRC}, {kalman_sql('k', 'src', 'close', 0.01, 0.1)}, {R_('k', 'innovation')}", 1)
fold_query("k15_rsi", lambda x: R.rsi_of(x, 14), ("close",), f"""{SRC}, gl AS (SELECT series_id, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM src WHERE i > 0), {rma_sql('a', 'gl', {'g': 'g', 'l': 'l'}, 14)},
{R_('a', 'CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END')}""")
_MACD = f"""{SRC}, {ema_sql('e12', 'src', 'close', 12)}, {ema_sql('e26', 'src', 'close', 26)}, line AS (SELECT s.series_id, s.i, f.v - s.v AS m FROM e26 s JOIN e12 f ON f.series_id = s.series_id AND f.i = s.i)"""
fold_query("k16_macd", lambda x: R.macd_of(x), ("close",), f"{_MACD}, {R_('line', 'm')}", 0)
fold_query("k16_macd_signal", lambda x: R.macd_of(x), ("close",), f"{_MACD}, sl AS (SELECT series_id, i - 25 AS i, m FROM line), {ema_sql('sg', 'sl', 'm', 9)}, r AS (SELECT series_id, i + 25 AS bar_idx, v FROM sg)", 1)
fold_query("k24_atr", lambda h, l, x: R.atr_of(h, l, x), HLC, f"{SRC}, {ATR14}, {R_('a14')}")  # noqa: E741
fold_query("k25_atr_close", lambda x: R.atr_close_of(x), ("close",), f"""{SRC}, ch AS (SELECT series_id, i, abs(d) AS d FROM src),
seed AS (SELECT series_id, i, avg(d) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS v FROM ch),
c(series_id, i, v) AS (SELECT series_id, i, v FROM seed WHERE i = 13 UNION ALL SELECT s.series_id, s.i, 2 / 15.0 * s.d + 13 / 15.0 * p.v FROM c p JOIN ch s ON s.series_id = p.series_id AND s.i = p.i + 1),
r AS (SELECT series_id, i AS bar_idx, v FROM seed WHERE i < 13 UNION ALL SELECT series_id, i, v FROM c)""")
fold_query("k26_adx", lambda h, l, x: R.adx_of(h, l, x), HLC, f"""{SRC}, dm AS (SELECT series_id, i, CASE WHEN i = 0 THEN 0 ELSE tr END AS t, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m FROM src),
{rma_sql('a', 'dm', {'t': 't', 'p': 'p', 'm': 'm'}, 14)}, di AS (SELECT series_id, i, CASE WHEN abs(t) < 2.3e-16 THEN 0 ELSE p / t * 100 END AS p, CASE WHEN abs(t) < 2.3e-16 THEN 0 ELSE m / t * 100 END AS m FROM a),
dx AS (SELECT series_id, i, CASE WHEN abs(p + m) < 2.3e-16 THEN 0 ELSE abs(p - m) / (p + m) * 100 END AS x FROM di), {rma_sql('ax', 'dx', {'v': 'x'}, 14)}, {R_('ax')}""", part=None)  # noqa: E741


def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import features

    return features(all_bars(spark, sf_dir), trim=False).select("series_id", "bar_idx", F.round("stoch_k", 6).alias("k"), F.round("stoch_d", 6).alias("d"))


put("k17_stochastic", stochastic, f"""WITH {BARS}, x AS (SELECT series_id, bar_idx, close, CASE WHEN count(*) {w(14)} = 14 THEN max(high) {w(14)} END AS h, {low('low', 14)} AS l FROM b),
y AS (SELECT *, h - l + CASE WHEN max(CASE WHEN h - l = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id) = 1 THEN 2.220446049250313e-16 ELSE 0 END AS rng FROM x),
z AS (SELECT *, CASE WHEN rng IS NOT NULL THEN least(100, greatest(0, (close - l) / CASE WHEN abs(rng) < 2.220446049250313e-16 THEN rng + 2.220446049250313e-16 ELSE rng END * 100)) END AS raw FROM y),
k AS (SELECT series_id, bar_idx, {sma('raw', 3)} AS k FROM z) SELECT series_id, bar_idx, round(k, 6) AS k, round({sma('k', 3)}, 6) AS d FROM k""")

put("k21_momentum_score", lambda spark, sf_dir: _score(spark, sf_dir), f"""WITH RECURSIVE {BARS}, {SRC}, gl AS (SELECT series_id, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM src WHERE i > 0), {rma_sql('a', 'gl', {'g': 'g', 'l': 'l'}, 14)},
x AS (SELECT src.series_id, src.i, CASE WHEN a.i IS NOT NULL THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi, close / lag(close, 5) OVER (PARTITION BY src.series_id ORDER BY src.i) - 1 AS r5, close / lag(close, 10) OVER (PARTITION BY src.series_id ORDER BY src.i) - 1 AS r10
  FROM src LEFT JOIN a ON a.series_id = src.series_id AND a.i = src.i),
y AS (SELECT series_id, i, rsi, r5, r10, {', '.join(f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY series_id, {v} IS NULL ORDER BY round({v}, 9)) + (count(*) OVER (PARTITION BY series_id, round({v}, 9)) - 1) / 2.0) / count({v}) OVER (PARTITION BY series_id) END AS p{k}" for k, v in enumerate(('rsi', 'r5', 'r10')))} FROM x)
SELECT series_id, i AS bar_idx, round((p0 + p1 + p2) / 3, 4) AS v FROM y""")


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.along_series(all_bars(spark, sf_dir), lambda x: {"rsi": R.rsi(x, 14)}, ("close",), rsi="double")
    df = df.withColumns({"r5": W.roc(c("close"), 5), "r10": W.roc(c("close"), 10)})
    df = df.withColumns({f"p{i}": W.percentile_rank(F.round(c(x), 9)) for i, x in enumerate(("rsi", "r5", "r10"))})
    return df.select("series_id", "bar_idx", F.round((c("p0") + c("p1") + c("p2")) / 3.0, 4).alias("v"))


def _quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_bars(spark, sf_dir).groupBy("series_id").agg(F.round(F.percentile("close", 0.8), 6).alias("q80"), F.round(F.percentile("close", 0.01), 6).alias("q01"))


put("k23_quantile", _quantile, f"WITH {BARS} SELECT series_id, round(quantile_cont(close, 0.8), 6) AS q80, round(quantile_cont(close, 0.01), 6) AS q01 FROM b GROUP BY 1")
