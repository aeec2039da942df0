"""Queries of the feature frame, block by block, each with SQL that derives the same columns from the bars.

The SQL has one recursive CTE that carries all recurrences of a series from bar to bar, and layers of columns over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import ANCHORS, CONTINUOUS, PAIRED, features
from .kernels import BARS, LAG, SRC, all_bars, low, put, sma, std, w

_EMAS = (9, 12, 20, 26, 50, 200)
_RSI = (14, 7, 21)
#: name: input, process noise, measurement noise
_KALMAN = {"k1": ("close", 0.01, 0.1), "k2": ("close", 0.001, 0.5), "k3": ("ax", 0.005, 0.2), "k4": ("tv", 0.01, 0.15), "k5": ("cc", 0.01, 0.15)}


def _recursion() -> str:
    seeds = ", ".join(f"avg(close) {w(n)} AS s{n}".replace("ORDER BY bar_idx", "ORDER BY i") for n in _EMAS)
    along = "OVER (PARTITION BY series_id ORDER BY i)"
    source = f"""s0 AS (SELECT *, abs(d) AS ad, greatest(d, 0) AS g, greatest(-d, 0) AS l, CASE WHEN i = 0 THEN 0 ELSE tr END AS t, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m, {seeds} FROM src),
s1 AS (SELECT *, avg(ad) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS cseed, lead(ad) {along} AS cnext FROM s0)"""
    names = ["series_id", "i", *[f"e{n}" for n in _EMAS], *[f"{x}{n}" for n in _RSI for x in "gl"], "tv", "pt", "pp", "pm", "cc", "msum", "sig", "ax", *[f"{k}{x}" for k in _KALMAN for x in "vpn"]]
    gain = lambda p, q, r: f"({p} + {q}) / ({p} + {q} + {r})"
    first = {"series_id": "series_id", "i": "i", **{f"e{n}": "CAST(NULL AS DOUBLE)" for n in _EMAS}, **{f"{x}{n}": "CAST(NULL AS DOUBLE)" for n in _RSI for x in "gl"}, "tv": "CAST(tr AS DOUBLE)", "pt": "CAST(0 AS DOUBLE)", "pp": "CAST(0 AS DOUBLE)", "pm": "CAST(0 AS DOUBLE)",
             "cc": "CAST(NULL AS DOUBLE)", "msum": "CAST(NULL AS DOUBLE)", "sig": "CAST(NULL AS DOUBLE)", "ax": "CAST(0 AS DOUBLE)"}
    for k, (x, q, r) in _KALMAN.items():
        begin = {"close": "CAST(close AS DOUBLE)", "ax": "CAST(0 AS DOUBLE)", "tv": "CAST(tr AS DOUBLE)", "cc": "CAST(cnext AS DOUBLE)"}[x]
        first |= {f"{k}v": begin, f"{k}p": f"CAST({1 + q} AS DOUBLE)" if x == "cc" else f"(1 - {gain('1', q, r)}) * (1 + {q})", f"{k}n": "CAST(0 AS DOUBLE)"}
    one = {f"e{n}": f"CASE WHEN s.i < {n - 1} THEN NULL WHEN s.i = {n - 1} THEN s.s{n} ELSE {2 / (n + 1)!r} * s.close + {1 - 2 / (n + 1)!r} * f.e{n} END" for n in _EMAS}
    one |= {f"{x}{n}": f"CASE WHEN s.i = 1 THEN s.{x} ELSE s.{x} / {n}.0 + (1 - 1 / {n}.0) * f.{x}{n} END" for n in _RSI for x in "gl"}
    one |= {"tv": "s.tr / 14.0 + (1 - 1 / 14.0) * f.tv", **{f"p{x}": f"s.{x} / 14.0 + (1 - 1 / 14.0) * f.p{x}" for x in "tpm"}, "cc": "CASE WHEN s.i < 14 THEN s.cseed ELSE 2 / 15.0 * s.ad + 13 / 15.0 * f.cc END"}
    held = ["msum", "sig", "ax", *[f"{k}{x}" for k in _KALMAN for x in "vp"]]
    inner = f"SELECT s.series_id, s.i, s.close, {', '.join(f'{x} AS {k}' for k, x in one.items())}, {', '.join(f'f.{x} AS o_{x}' for x in held)} FROM f JOIN s1 s ON s.series_id = f.series_id AND s.i = f.i + 1"
    part = lambda x: f"CASE WHEN abs(pt) < 2.220446049250313e-16 THEN 0 ELSE {x} / pt * 100 END"
    two = f"SELECT *, e12 - e26 AS line, {part('pp')} AS di_p, {part('pm')} AS di_m FROM ({inner}) a"
    three = f"""SELECT *, CASE WHEN i = 25 THEN line WHEN i BETWEEN 26 AND 33 THEN o_msum + line END AS msum, CASE WHEN i = 33 THEN (o_msum + line) / 9 WHEN i > 33 THEN 0.2 * line + 0.8 * o_sig END AS sig,
  CASE WHEN abs(di_p + di_m) < 2.220446049250313e-16 THEN 0 ELSE abs(di_p - di_m) / (di_p + di_m) * 100 END / 14.0 + (1 - 1 / 14.0) * o_ax AS ax FROM ({two}) b"""
    last = {k: k for k in names if k[:2] not in _KALMAN}
    for k, (x, q, r) in _KALMAN.items():
        g = gain(f"o_{k}p", q, r)
        last |= {f"{k}v": f"o_{k}v + {g} * ({x} - o_{k}v)", f"{k}p": f"(1 - {g}) * (o_{k}p + {q})", f"{k}n": f"{x} - o_{k}v"}
    return f"{source}, f({', '.join(names)}) AS (SELECT {', '.join(first[k] for k in names)} FROM s1 WHERE i = 0 UNION ALL SELECT {', '.join(last[k] for k in names)} FROM ({three}) c)"


def _rsi(n: int) -> str:
    return f"CASE WHEN f.l{n} = 0 THEN 100 ELSE 100 - 100 / (1 + f.g{n} / f.l{n}) END"


def ratio(a: str, b: str, eps: str = "2.220446049250313e-16") -> str:
    return f"CASE WHEN abs({b}) < {eps} THEN 0 ELSE ({a}) / nullif({b}, 0) END"


def dev(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) < 2.220446049250313e-16 THEN 0 ELSE ({a}) / nullif({b}, 0) - 1 END"


def mom(x: str, n: int) -> str:
    return f"CASE WHEN bar_idx < {n} THEN 0 ELSE {x} - {LAG(x, n)} END"


def roc(x: str, n: int) -> str:
    return f"CASE WHEN abs({LAG(x, n)}) >= 2.220446049250313e-16 THEN {x} / {LAG(x, n)} - 1 END"


def high(x: str, n: int) -> str:
    return low(x, n).replace("min(", "max(")


def true3(x: str, n: int) -> str:
    return f"CASE WHEN count(*) {w(n)} = {n} THEN sum(CAST({x} AS INTEGER)) {w(n)} END"


_S = "1e-9"
_WHOLE = "OVER (PARTITION BY series_id)"
_FLAT = "2.220446049250313e-16"
_FIRST = {
    '"9ema"': "f.e9", '"20ema"': "f.e20", '"50ema"': "f.e50", "ema200": "f.e200", "macd": "f.e12 - f.e26", "macd_signal": "f.sig", "macd_hist": "f.e12 - f.e26 - f.sig", **{f"rsi_{n}": _rsi(n) for n in _RSI}, "adx": "f.ax", "atr": "f.tv", "atr_c2c": "f.cc",
    "kf_smooth": "f.k1v", "kf_innovation": "f.k1n", "kf_trend": "f.k2v", "kf_adx": "f.k3v", "kf_adx_innovation": "f.k3n", "kf_atr": "f.k4v", "kf_atr_innovation": "f.k4n", "kf_atr_c2c": "f.k5v", "kf_atr_c2c_innovation": "f.k5n",
}
_LAYERS: list[dict[str, str]] = [
    {
        "_abs": "abs(close - open)", "_uw": "high - greatest(open, close)", "_lw": "least(open, close) - low", "_range": "high - low", "_top": "greatest(open, close)", "_bottom": "least(open, close)", "is_green": "close > open", "is_red": "close < open",
        "wicks_diff": "CASE WHEN close > open THEN open - low ELSE high - open END", '"200sma"': sma("close", 200), "momentum_14": mom("close", 14), "roc_5": roc("close", 5), "roc_10": roc("close", 10),
        "volatility_20_cv": f"CASE WHEN abs({sma('close', 20)}) < {_FLAT} THEN 0 ELSE {std('close', 20)} / nullif({sma('close', 20)}, 0) END", "_mid": sma("close", 20), "bb_std": std("close", 20), "ext": f"coalesce(high - {low('low', 20)}, 0)", "_hi14": high("high", 14), "_lo14": low("low", 14),
    },
    {
        "_upper": "_mid + 2 * bb_std", "_lower": "_mid - 2 * bb_std", "_wick": "greatest(_uw, _lw)", "atr_pct": ratio("atr", "close"), "atr_c2c_pct": ratio("atr_c2c", "close"), "bar_range_pct": ratio("_range", "close"), "body_size_pct": ratio("_abs", "close"),
        "upper_shadow_ratio": ratio("_uw", "_range"), "lower_shadow_ratio": ratio("_lw", "_range"), "wicks_diff_sma14": sma("wicks_diff", 14), "body_to_total_wick": ratio("_abs", "_uw + _lw", _S), "body_atr_ratio": ratio("_abs", "atr", _S),
        "price_vs_200sma_dev": dev("close", '"200sma"'), "price_vs_9ema_dev": dev("close", '"9ema"'), '"9ema_to_200sma"': dev('"9ema"', "ema200"), "kf_price_deviation": ratio("close - kf_smooth", "close"), "kf_vs_9ema": ratio('kf_smooth - "9ema"', '"9ema"'),
        "kf_vs_200sma": ratio('kf_smooth - "200sma"', '"200sma"'), "kf_innovation_abs": "abs(kf_innovation)", "kf_adx_innovation_abs": "abs(kf_adx_innovation)", "kf_atr_pct": ratio("kf_atr", "close"), "kf_atr_c2c_pct": ratio("kf_atr_c2c", "close"),
        "kf_adx_deviation": ratio("adx - kf_adx", f"kf_adx + {_S}", _S), "kf_atr_vs_c2c": ratio("kf_atr", f"kf_atr_c2c + {_S}", _S), "kf_atr_deviation": ratio("atr - kf_atr", f"kf_atr + {_S}", _S), "atr_pct_mean50": sma("atr", 50), "atr_c2c_mean50": sma("atr_c2c", 50),
        "ext_sma14": sma("ext", 14), "adx_sma": sma("adx", 14), "_kf_momentum": mom("kf_smooth", 1), "_kf_slope5": f"({mom('kf_smooth', 5)}) / 5.0", "_adx_slope": mom("kf_adx", 1), "kf_adx_momentum_5": mom("kf_adx", 5), "kf_atr_momentum_5": mom("kf_atr", 5),
        "kf_atr_c2c_momentum_5": mom("kf_atr_c2c", 5), "kf_trend_momentum": mom("kf_trend", 5), "macd_hist_delta_1": mom("macd_hist", 1), "_flat": f"max(CASE WHEN _hi14 = _lo14 THEN 1 ELSE 0 END) {_WHOLE}",
        "trend_strength": f"""CASE WHEN abs("200sma") >= {_FLAT} THEN adx / 100.0 * 0.4 + abs(close / nullif("200sma", 0) - 1) * 10 * 0.6 END""",
    },
    {
        "bb_position": f"CASE WHEN abs(_upper - _lower) < {_FLAT} THEN 0.5 ELSE (close - _lower) / nullif(_upper - _lower, 0) END", "body_vs_max_wick_ratio": ratio("_abs", "_wick", _S), "_span": f"_hi14 - _lo14 + CASE WHEN _flat = 1 THEN {_FLAT} ELSE 0 END",
        "kf_trend_volatility_ratio": ratio("kf_adx", f"kf_atr_pct * 100.0 + {_S}", _S), "_q80": f"quantile_cont(trend_strength, 0.8) {_WHOLE}", "_body20": sma("body_size_pct", 20), "_atr20": sma("atr", 20), "_katr20": sma("kf_atr", 20), "_katr_sd": std("kf_atr", 20), "_kc2c20": sma("kf_atr_c2c", 20),
        "_kc2c_sd": std("kf_atr_c2c", 20), "_atr_inn_sd": std("kf_atr_innovation", 20), "_c2c_inn_sd": std("kf_atr_c2c_innovation", 20), "_inn20": sma("kf_innovation_abs", 20), "_inn_sd": std("kf_innovation", 20), "_adx_inn20": sma("kf_adx_innovation_abs", 20), "_bb20": sma("bb_std", 20),
    },
    {"_raw_k": f"CASE WHEN _span IS NOT NULL THEN least(100, greatest(0, (close - _lo14) / nullif(CASE WHEN abs(_span) < {_FLAT} THEN _span + {_FLAT} ELSE _span END, 0) * 100)) END"},
    {"stoch_k": sma("_raw_k", 3)},
    {"stoch_d": sma("stoch_k", 3)},
]


def yes(x: str) -> str:
    return f"coalesce({x}, false)"


def up(x: str, n: int = 1) -> str:
    return f"{x} > {LAG(x, n)}"


def down(x: str, n: int = 1) -> str:
    return f"{x} < {LAG(x, n)}"


def over(a: str, b: str) -> str:
    return f"({a}) - ({b}) > 1e-10"


def cross(a: str, b: str, rising: bool = True) -> str:
    return f"{LAG(a)} <= {LAG(b)} AND {a} > {b}" if rising else f"{LAG(a)} >= {LAG(b)} AND {a} < {b}"


def falling(*x: str) -> str:
    return " AND ".join(f"{a} > {b}" for a, b in zip(x, x[1:]))


def rising(*x: str) -> str:
    return " AND ".join(f"{a} < {b}" for a, b in zip(x, x[1:]))


_UP3 = f"is_green AND close > {LAG('_top')} AND close > {LAG('_top', 2)}"
_DOWN3 = f"is_red AND close < {LAG('_bottom')} AND close < {LAG('_bottom', 2)}"
_UP3H = f"is_green AND close > {LAG('high')} AND close > {LAG('high', 2)}"
_DOWN3H = f"is_red AND close < {LAG('low')} AND close < {LAG('low', 2)}"
CANDLE = {
    **{f"body_dominant_{str(m).replace('.', '_')}x": f"_abs > _wick * {m}" for m in (0.5, 1.0, 1.5, 2.0, 2.5)},
    "is_tribar": f"{yes(_UP3)} OR {yes(_DOWN3)}", "is_tribar_green": _UP3, "is_tribar_red": _DOWN3, "is_tribar_hl": f"{yes(_UP3H)} OR {yes(_DOWN3H)}", "is_tribar_hl_green": _UP3H, "is_tribar_hl_red": _DOWN3H, "prev_green": LAG("is_green"),
    **{f"consecutive_{c}_{n}": f"{true3(f'is_{c}', n)} = {n}" for c in ("green", "red") for n in (2, 3)}, "higher_high": up("high"), "higher_low": up("low"), "lower_high": down("high"), "lower_low": down("low"),
    "bullish_bar_sequence": f"{up('high')} AND {up('low')}", "bearish_bar_sequence": f"{down('high')} AND {down('low')}", "is_hammer": "_abs < _lw * 0.5 AND _lw > _uw * 2", "is_shooting_star": "_abs < _uw * 0.5 AND _uw > _lw * 2",
    "bullish_engulfing": f"is_green AND {LAG('is_red')} AND {up('_abs')}", "bearish_engulfing": f"is_red AND {LAG('is_green')} AND {up('_abs')}", "is_very_large_green": "is_green AND _abs > atr * 1.5", "is_very_large_red": "is_red AND _abs > atr * 1.5",
    "is_large_body": f"body_size_pct > {_S} AND body_size_pct > _body20 * 1.5", "is_very_large_body": f"body_size_pct > {_S} AND body_size_pct > _body20 * 2",
}
TREND = {
    "all_emas_aligned": falling("close", '"9ema"', '"20ema"', '"50ema"'), "all_emas_dealigned": rising("close", '"9ema"', '"20ema"', '"50ema"'), "ema_ribbon_aligned": falling('"9ema"', '"20ema"', '"50ema"', '"200sma"'), "ema_ribbon_dealigned": rising('"9ema"', '"20ema"', '"50ema"', '"200sma"'),
    **{f"is_close_{word}_{name}": over("close", col) if word == "above" else over(col, "close") for word in ("above", "below") for name, col in (("200sma", '"200sma"'), ("9ema", '"9ema"'), ("kf_ma", "kf_smooth"))},
}
STATE = {"is_very_strong_trend": "trend_strength > _q80", "adx_rising": up("adx"), "adx_accelerating": f"{up('adx')} AND {LAG('adx')} > {LAG('adx', 2)}"}
VOLATILITY = {
    "is_high_volatility": "atr > _atr20 * 1.2", "is_low_volatility": "atr < _atr20 * 0.8", "expanding_atr": up("atr"), "is_kf_atr_high_volatility": "kf_atr > _katr20 * 1.2", "is_kf_atr_low_volatility": "kf_atr < _katr20 * 0.8",
    "is_kf_atr_very_high_volatility": "kf_atr > _katr20 + 2 * _katr_sd", "is_kf_atr_squeeze": f"kf_atr < {low('kf_atr', 50)} * 1.1", "is_kf_atr_volatility_spike": over("kf_atr_innovation", "_atr_inn_sd * 2"), "is_kf_atr_volatility_drop": over("_atr_inn_sd * -2", "kf_atr_innovation"),
    "is_kf_atr_c2c_high_volatility": "kf_atr_c2c > _kc2c20 * 1.2", "is_kf_atr_c2c_low_volatility": "kf_atr_c2c < _kc2c20 * 0.8", "is_kf_atr_c2c_squeeze": f"kf_atr_c2c < {low('kf_atr_c2c', 50)} * 1.1",
    "is_kf_atr_c2c_very_high": "CASE WHEN _kc2c_sd = 0 THEN false ELSE abs((kf_atr_c2c - _kc2c20) / nullif(_kc2c_sd, 0)) > 2 END", "is_kf_atr_c2c_spike": over("kf_atr_c2c_innovation", "_c2c_inn_sd * 2"), "is_kf_atr_c2c_drop": over("_c2c_inn_sd * -2", "kf_atr_c2c_innovation"),
    "kf_atr_c2c_contracting": down("kf_atr_c2c"), "kf_atr_c2c_expanding": up("kf_atr_c2c"), "kf_atr_contracting": down("kf_atr"), "kf_atr_expanding": up("kf_atr"), "is_kf_gap_volatility": "kf_atr_vs_c2c > 1.5", "is_kf_continuous_volatility": "kf_atr_vs_c2c < 1.2",
}
OSCILLATORS = {
    "is_rsi_oversold_recovery": f"{LAG('rsi_14')} < 30 AND rsi_14 > 30", "is_rsi_overbought_recovery": f"{LAG('rsi_14')} > 70 AND rsi_14 < 70", "rsi_bullish": "rsi_14 > 50", "rsi_bearish": "rsi_14 < 50", "rsi_very_bullish": "rsi_14 > 60", "rsi_very_bearish": "rsi_14 < 40",
    "is_stoch_oversold": "round(stoch_k, 10) < 20", "is_stoch_overbought": "round(stoch_k, 10) > 80", "stoch_bullish_cross": cross("stoch_k", "stoch_d"), "stoch_bearish_cross": cross("stoch_k", "stoch_d", False), "macd_bullish": over("macd", "macd_signal"), "macd_bearish": over("macd_signal", "macd"),
    "macd_cross_up": cross("macd", "macd_signal"), "macd_cross_down": cross("macd", "macd_signal", False), "macd_histogram_increasing": up("macd_hist"), "macd_histogram_decreasing": down("macd_hist"), "is_bb_squeeze": "bb_std < _bb20 * 0.8", "above_bb_middle": over("close", "_mid"), "below_bb_middle": over("_mid", "close"),
}
KALMAN = {
    "kf_above_smooth": "kf_price_deviation > 0", "kf_below_smooth": "kf_price_deviation < 0", "kf_above_trend": over("close", "kf_trend"), "kf_below_trend": over("kf_trend", "close"), "kf_adx_above_25": "kf_adx > 25", "kf_adx_above_40": "kf_adx > 40", "kf_adx_below_20": "kf_adx < 20",
    "kf_adx_increasing": up("kf_adx"), "kf_adx_decreasing": down("kf_adx"), "kf_adx_accelerating": f"_adx_slope > 0 AND {up('_adx_slope')}", "kf_adx_decelerating": f"_adx_slope < 0 AND {down('_adx_slope')}", "is_kf_adx_surprise": over("kf_adx_innovation_abs", "_adx_inn20 * 1.5"),
    "kf_adx_trend_emerging": f"kf_adx > 20 AND {LAG('kf_adx', 5)} < 20", "kf_adx_trend_fading": f"kf_adx < 25 AND {LAG('kf_adx', 5)} > 30", "kf_c2c_dominance": over("kf_atr_c2c", "kf_atr * 0.7"), "kf_momentum_increasing": up("_kf_momentum"), "kf_momentum_decreasing": down("_kf_momentum"),
    "kf_slope_increasing": up("_kf_slope5"), "kf_slope_decreasing": down("_kf_slope5"), "is_kf_strong_trend_low_vol": "kf_adx > 35 AND kf_atr_pct < 0.012", "kf_ema_aligned": falling("kf_smooth", '"9ema"', '"200sma"'), "kf_ema_divergence": f"{over('kf_trend', 'kf_smooth')} AND {over('\"50ema\"', 'kf_trend')}",
    "is_kf_positive_surprise": over("kf_innovation", "_inn_sd"), "is_kf_negative_surprise": over("-_inn_sd", "kf_innovation"), "is_kf_innovation_large": over("kf_innovation_abs", "_inn20 * 1.5"),
}
FINAL = {
    "prev_tribar": LAG("is_tribar"), "kf_volatility_divergence": "(kf_atr_expanding AND kf_atr_c2c_contracting) OR (kf_atr_contracting AND kf_atr_c2c_expanding)", "kf_trending_volatile": "kf_adx_above_25 AND is_kf_atr_high_volatility",
    "kf_trending_quiet": "kf_adx_above_25 AND is_kf_atr_low_volatility", "kf_ranging_volatile": "kf_adx_below_20 AND is_kf_atr_high_volatility", "kf_ranging_quiet": "kf_adx_below_20 AND is_kf_atr_low_volatility", "is_kf_breakout_potential": "kf_adx_increasing AND kf_atr_expanding",
    "is_kf_consolidation": "kf_adx_decreasing AND kf_atr_contracting", "kf_trending_c2c_volatile": "kf_adx_above_25 AND is_kf_atr_c2c_high_volatility", "kf_trending_c2c_quiet": "kf_adx_above_25 AND is_kf_atr_c2c_low_volatility",
    "is_kf_gap_trading_opportunity": "is_kf_gap_volatility AND kf_adx < 25", "is_kf_smooth_trend": "is_kf_continuous_volatility AND kf_adx > 30",
}
NUMBERS = """9ema 20ema 50ema 200sma macd macd_signal macd_hist rsi_14 rsi_7 rsi_21 adx atr atr_c2c kf_smooth kf_innovation kf_trend kf_adx kf_atr kf_atr_innovation kf_atr_c2c kf_atr_c2c_innovation wicks_diff momentum_14 roc_5 roc_10 volatility_20_cv bb_std ext atr_pct atr_c2c_pct
bar_range_pct body_size_pct upper_shadow_ratio lower_shadow_ratio wicks_diff_sma14 body_to_total_wick body_atr_ratio price_vs_200sma_dev price_vs_9ema_dev 9ema_to_200sma kf_price_deviation kf_vs_9ema kf_vs_200sma kf_innovation_abs kf_adx_innovation_abs kf_atr_pct kf_atr_c2c_pct
kf_adx_deviation kf_atr_vs_c2c kf_atr_deviation atr_pct_mean50 atr_c2c_mean50 ext_sma14 adx_sma kf_adx_momentum_5 kf_atr_momentum_5 kf_atr_c2c_momentum_5 kf_trend_momentum macd_hist_delta_1 trend_strength bb_position body_vs_max_wick_ratio kf_trend_volatility_ratio stoch_k stoch_d""".split()


def frame_sql() -> str:
    """CTEs that end with n9: the bars with all numbers, and what the flags need."""
    out = f"{BARS}, {SRC}, {_recursion()}, n0 AS (SELECT b.*, {', '.join(f'{x} AS {k}' for k, x in _FIRST.items())} FROM b JOIN f ON f.series_id = b.series_id AND f.i = b.bar_idx)"
    for i, layer in enumerate(_LAYERS):
        out += f", n{i + 1} AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in layer.items())} FROM n{i})"
    return out + f", n9 AS (SELECT * FROM n{len(_LAYERS)})"


def _flags(names: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(all_bars(spark, sf_dir), trim=False).select("series_id", "bar_idx", *[F.col(k).cast("int").alias(k) for k in names])

    return run


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(all_bars(spark, sf_dir), trim=False).select("series_id", "bar_idx", *[F.round(f"`{k}`", 5).alias(k) for k in NUMBERS])


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that stay, numbered anew."""
    return features(all_bars(spark, sf_dir)).select("series_id", "bar_idx", F.col("ts").cast("string").alias("bar"), F.round("close", 4).alias("close"))


_INT = lambda d: ", ".join(f"CAST({yes(x)} AS INTEGER) AS {k}" for k, x in d.items())
put("e01_numbers", _numbers, f"WITH RECURSIVE {frame_sql()} SELECT series_id, bar_idx, " + ", ".join(f'round("{k}", 5) AS "{k}"' for k in NUMBERS) + " FROM n9")
for _name, _block in (("e02_candles", CANDLE), ("e03_trend", TREND), ("e04_trend_state", STATE), ("e05_kalman", KALMAN), ("e06_volatility", VOLATILITY), ("e07_oscillators", OSCILLATORS)):
    put(_name, _flags(_block), f"WITH RECURSIVE {frame_sql()} SELECT series_id, bar_idx, {_INT(_block)} FROM n9")
_NEEDED = {k: v for d in (CANDLE, KALMAN, VOLATILITY) for k, v in d.items()}
put("e10_final_pass", _flags(FINAL), f"WITH RECURSIVE {frame_sql()}, fl AS (SELECT series_id, bar_idx, kf_adx, {', '.join(f'{yes(x)} AS {k}' for k, x in _NEEDED.items())} FROM n9) SELECT series_id, bar_idx, {_INT(FINAL)} FROM fl")

#: core numbers that the SQL derives; the others are defined wherever these are
_CORE = [k for k in sorted({*CONTINUOUS, *ANCHORS, *PAIRED}) if k in NUMBERS]
put("e11_trim", _trimmed, f"""WITH RECURSIVE {frame_sql()}, k AS (SELECT series_id, ts, bar_idx, close, {' AND '.join(f'("{x}" IS NOT NULL OR count("{x}") {_WHOLE} = 0)' for x in _CORE)} AS fine FROM n9)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY bar_idx) - 1 AS bar_idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS bar, round(close, 4) AS close FROM k WHERE fine""")
