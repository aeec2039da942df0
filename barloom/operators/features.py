"""The feature frame: about 190 columns derived from bars.

Recurrences come first (see ``functions.chain``); all else is row-local expressions and windows over the same partitioning, in layers that depend on each
other. A series of more than ``PART`` bars is cut into segments, each with the ``HALO`` bars before it, and windows run along segments; the few values of a whole series (ranks, a quantile, what is never defined) are
aggregates that are joined back, so no task holds a series. Where two blocks define a flag the later one counts, as the order of blocks is candle, trend, volatility, oscillators, bands, trend state,
Kalman regime, final pass. Undefined numbers are NULL, undefined flags false.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import window as W
from ..functions.chain import PART, longest
from ..functions.recurrence import recurrences
from ..functions.scalar import EPS, SMALL, above, below, bollinger_position, chain, clearly_above, clearly_below, deviation, ratio, upper_wick, lower_wick, yes, zscore_beyond
from ..session import beside, settle
from ..sources.bars import check_prices
from . import order

# The searchable flags, the continuous features and the columns of pairwise predicates.
BOOLEANS = """is_tribar is_tribar_green is_tribar_red is_tribar_hl is_tribar_hl_green is_tribar_hl_red consecutive_green_2 consecutive_green_3 consecutive_red_2
consecutive_red_3 prev_tribar prev_green higher_high higher_low lower_high lower_low is_hammer is_shooting_star bullish_engulfing bearish_engulfing adx_rising adx_accelerating
kf_adx_increasing kf_adx_decreasing kf_adx_accelerating kf_adx_decelerating kf_adx_trend_emerging kf_adx_trend_fading is_kf_atr_squeeze is_kf_atr_c2c_squeeze
is_kf_atr_volatility_spike is_kf_atr_volatility_drop is_kf_atr_c2c_spike is_kf_atr_c2c_drop kf_atr_c2c_contracting kf_atr_c2c_expanding kf_atr_contracting kf_atr_expanding
kf_volatility_divergence kf_momentum_increasing kf_momentum_decreasing kf_slope_increasing kf_slope_decreasing kf_trending_volatile kf_trending_quiet kf_ranging_volatile
kf_ranging_quiet is_kf_strong_trend_low_vol is_kf_breakout_potential is_kf_consolidation kf_trending_c2c_volatile kf_trending_c2c_quiet is_kf_gap_trading_opportunity
is_kf_smooth_trend is_kf_positive_surprise is_kf_negative_surprise is_rsi_oversold_recovery is_rsi_overbought_recovery stoch_bullish_cross stoch_bearish_cross
macd_cross_up macd_cross_down is_bb_squeeze""".split()
CONTINUOUS = """rsi_14 rsi_7 rsi_21 momentum_14 momentum_score roc_5 roc_10 adx kf_adx trend_strength adx_sma kf_trend_momentum kf_trend_volatility_ratio macd macd_signal macd_hist
stoch_k stoch_d kf_price_deviation kf_vs_9ema kf_vs_200sma kf_innovation_abs kf_innovation kf_adx_deviation kf_adx_innovation_abs kf_adx_momentum_5 kf_atr_pct kf_atr_c2c_pct
kf_atr_vs_c2c kf_atr_deviation kf_atr_momentum_5 kf_atr_c2c_momentum_5 kf_atr_innovation kf_atr_c2c_innovation atr_pct atr_c2c_pct bar_range_pct volatility_20_cv body_size_pct
body_vs_max_wick_ratio body_to_total_wick body_atr_ratio consecutive_green bb_position wicks_diff wicks_diff_sma14 kf_wicks_smooth price_vs_200sma_dev price_vs_9ema_dev
9ema_to_200sma upper_shadow_ratio lower_shadow_ratio atr_pct_mean50 atr_c2c_mean50 kf_atr kf_atr_c2c bb_std ext ext_sma14 macd_hist_delta_1""".split()
ANCHORS = ["close", "open", "high", "low", "kf_smooth"]
PAIRED = """9ema 20ema 50ema 200sma atr_c2c atr_c2c_mean50 bb_std kf_atr kf_atr_c2c wicks_diff wicks_diff_sma14 lower_shadow_ratio upper_shadow_ratio price_vs_9ema_dev price_vs_200sma_dev
9ema_to_200sma kf_price_deviation kf_vs_9ema kf_vs_200sma kf_innovation_abs""".split()

c = F.col


def _whole(df: DataFrame) -> DataFrame:
    """What belongs to a whole series: whether a range was ever flat, ranks and a quantile."""
    return df.withColumns({
        "_flat": F.max(_FLAT()).over(W.whole()), "_q80": F.percentile("trend_strength", 0.8).over(W.whole()),
        **{name: W.percentile_rank(c(x)) for name, x in _RANKED.items()},
    })


_RANKED = {"_r14": "rsi_14", "_r5": "roc_5", "_r10": "roc_10"}
_FLAT = lambda: (c("_hi14") == c("_lo14")).cast("int")


def _base(df: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row-local measures, and windows over prices and recurrences; ``whole`` adds what belongs to a whole series."""
    o, h, low, cl = c("open"), c("high"), c("low"), c("close")
    mid, upper, lower, std = W.bollinger(cl)
    df = df.withColumnsRenamed({"ema9": "9ema", "ema20": "20ema", "ema50": "50ema"})
    df = df.withColumns({
        "_abs": F.abs(cl - o), "_uw": upper_wick(o, h, cl), "_lw": lower_wick(o, low, cl), "_range": h - low, "_top": F.greatest(o, cl), "_bottom": F.least(o, cl),
        "is_green": yes(cl > o), "is_red": yes(cl < o), "wicks_diff": F.when(cl > o, o - low).otherwise(h - o),
        "200sma": W.sma(cl, 200), "momentum_14": W.momentum(cl, 14), "roc_5": W.roc(cl, 5), "roc_10": W.roc(cl, 10), "volatility_20_cv": W.rolling_cv(cl, 20),
        "_mid": mid, "_upper": upper, "_lower": lower, "bb_std": std, "ext": W.extension(h, low, 20), "_hi14": W.rolling_max(h, 14), "_lo14": W.rolling_min(low, 14),
    })
    df = df.withColumns({
        "_wick": F.greatest("_uw", "_lw"), "atr_pct": ratio(c("atr"), cl), "atr_c2c_pct": ratio(c("atr_c2c"), cl), "bar_range_pct": ratio(c("_range"), cl), "body_size_pct": ratio(c("_abs"), cl),
        "upper_shadow_ratio": ratio(c("_uw"), c("_range")), "lower_shadow_ratio": ratio(c("_lw"), c("_range")), "wicks_diff_sma14": W.sma(c("wicks_diff"), 14),
        "body_to_total_wick": ratio(c("_abs"), c("_uw") + c("_lw"), SMALL), "body_atr_ratio": ratio(c("_abs"), c("atr"), SMALL),
        "price_vs_200sma_dev": deviation(cl, c("200sma")), "price_vs_9ema_dev": deviation(cl, c("9ema")), "9ema_to_200sma": deviation(c("9ema"), c("ema200")),
        "kf_price_deviation": ratio(cl - c("kf_smooth"), cl), "kf_vs_9ema": ratio(c("kf_smooth") - c("9ema"), c("9ema")), "kf_vs_200sma": ratio(c("kf_smooth") - c("200sma"), c("200sma")),
        "kf_innovation_abs": F.abs("kf_innovation"), "kf_adx_innovation_abs": F.abs("kf_adx_innovation"), "kf_atr_pct": ratio(c("kf_atr"), cl), "kf_atr_c2c_pct": ratio(c("kf_atr_c2c"), cl),
        "kf_adx_deviation": ratio(c("adx") - c("kf_adx"), c("kf_adx") + SMALL, SMALL), "kf_atr_vs_c2c": ratio(c("kf_atr"), c("kf_atr_c2c") + SMALL, SMALL), "kf_atr_deviation": ratio(c("atr") - c("kf_atr"), c("kf_atr") + SMALL, SMALL),
        "atr_pct_mean50": W.sma(c("atr"), 50), "atr_c2c_mean50": W.sma(c("atr_c2c"), 50), "ext_sma14": W.sma(c("ext"), 14), "adx_sma": W.sma(c("adx"), 14),
        "_kf_momentum": W.momentum(c("kf_smooth"), 1), "_kf_slope5": W.momentum(c("kf_smooth"), 5) / 5.0, "_adx_slope": W.momentum(c("kf_adx"), 1), "kf_adx_momentum_5": W.momentum(c("kf_adx"), 5),
        "kf_atr_momentum_5": W.momentum(c("kf_atr"), 5), "kf_atr_c2c_momentum_5": W.momentum(c("kf_atr_c2c"), 5), "kf_trend_momentum": W.momentum(c("kf_trend"), 5), "macd_hist_delta_1": W.momentum(c("macd_hist"), 1),
        "bb_position": bollinger_position(cl, c("_lower"), c("_upper")),
        "trend_strength": F.when(F.abs(c("200sma")) >= EPS, c("adx") / 100.0 * 0.4 + F.abs(F.try_divide(cl, c("200sma")) - 1.0) * 10.0 * 0.6),
    })
    df = whole(df)
    span = c("_hi14") - c("_lo14") + F.when(c("_flat") == 1, SMALL_RANGE).otherwise(0.0)
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(cl - c("_lo14"), F.when(F.abs(span) < SMALL_RANGE, span + SMALL_RANGE).otherwise(span)) * 100.0))
    df = df.withColumns({
        "body_vs_max_wick_ratio": ratio(c("_abs"), c("_wick"), SMALL), "momentum_score": (c("_r14") + c("_r5") + c("_r10")) / 3.0, "_raw_k": F.when(span.isNotNull(), raw),
        "kf_trend_volatility_ratio": ratio(c("kf_adx"), c("kf_atr_pct") * 100.0 + SMALL, SMALL),
        "_body20": W.sma(c("body_size_pct"), 20), "_atr20": W.sma(c("atr"), 20), "_katr20": W.sma(c("kf_atr"), 20), "_katr_sd": W.rolling_std(c("kf_atr"), 20), "_kc2c20": W.sma(c("kf_atr_c2c"), 20),
        "_kc2c_sd": W.rolling_std(c("kf_atr_c2c"), 20), "_atr_inn_sd": W.rolling_std(c("kf_atr_innovation"), 20), "_c2c_inn_sd": W.rolling_std(c("kf_atr_c2c_innovation"), 20),
        "_inn20": W.sma(c("kf_innovation_abs"), 20), "_inn_sd": W.rolling_std(c("kf_innovation"), 20), "_adx_inn20": W.sma(c("kf_adx_innovation_abs"), 20), "_bb20": W.sma(c("bb_std"), 20),
    })
    df = df.withColumn("stoch_k", W.sma(c("_raw_k"), 3))
    return df.withColumn("stoch_d", W.sma(c("stoch_k"), 3))


#: Fixed value: what a flat range grows by.
SMALL_RANGE = 2.220446049250313e-16


def _flags(df: DataFrame) -> DataFrame:
    o, h, low, cl, body = c("open"), c("high"), c("low"), c("close"), c("_abs")
    green, red = c("is_green"), c("is_red")
    up3 = yes(green & (cl > W.lag(c("_top"))) & (cl > W.lag(c("_top"), 2)))
    down3 = yes(red & (cl < W.lag(c("_bottom"))) & (cl < W.lag(c("_bottom"), 2)))
    up3h = yes(green & (cl > W.lag(h)) & (cl > W.lag(h, 2)))
    down3h = yes(red & (cl < W.lag(low)) & (cl < W.lag(low, 2)))
    prev_green, prev_red = W.shifted(green), W.shifted(red)
    candle = {
        **{f"body_dominant_{str(m).replace('.', '_')}x": yes(body > c("_wick") * m) for m in (0.5, 1.0, 1.5, 2.0, 2.5)},
        "is_tribar": up3 | down3, "is_tribar_green": up3, "is_tribar_red": down3, "is_tribar_hl": up3h | down3h, "is_tribar_hl_green": up3h, "is_tribar_hl_red": down3h,
        "prev_green": prev_green, **{f"consecutive_{name}_{n}": W.streak(flag, n) for name, flag in (("green", green), ("red", red)) for n in (2, 3)},
        "consecutive_green": W.rolling_true(green, 3), "higher_high": W.changes(h), "higher_low": W.changes(low), "lower_high": W.changes(h, False), "lower_low": W.changes(low, False),
        "bullish_bar_sequence": W.changes(h) & W.changes(low), "bearish_bar_sequence": W.changes(h, False) & W.changes(low, False),
        "is_hammer": yes((body < c("_lw") * 0.5) & (c("_lw") > c("_uw") * 2.0)), "is_shooting_star": yes((body < c("_uw") * 0.5) & (c("_uw") > c("_lw") * 2.0)),
        "bullish_engulfing": yes(green & prev_red & (body > W.lag(body))), "bearish_engulfing": yes(red & prev_green & (body > W.lag(body))),
        "is_very_large_green": yes(green & (body > c("atr") * 1.5)), "is_very_large_red": yes(red & (body > c("atr") * 1.5)),
        "is_large_body": yes((c("body_size_pct") > SMALL) & (c("body_size_pct") > c("_body20") * 1.5)), "is_very_large_body": yes((c("body_size_pct") > SMALL) & (c("body_size_pct") > c("_body20") * 2.0)),
    }
    trend = {
        "is_very_strong_trend": above(c("trend_strength"), c("_q80")), "all_emas_aligned": chain(cl, c("9ema"), c("20ema"), c("50ema")), "all_emas_dealigned": chain(cl, c("9ema"), c("20ema"), c("50ema"), rising=True),
        "ema_ribbon_aligned": chain(c("9ema"), c("20ema"), c("50ema"), c("200sma")), "ema_ribbon_dealigned": chain(c("9ema"), c("20ema"), c("50ema"), c("200sma"), rising=True),
        **{f"is_close_{word}_{name}": test(cl, c(col)) for word, test in (("above", clearly_above), ("below", clearly_below)) for name, col in (("200sma", "200sma"), ("9ema", "9ema"), ("kf_ma", "kf_smooth"))},
        "adx_rising": W.changes(c("adx")), "adx_accelerating": W.double_rising(c("adx")),
    }
    k, c2c, inn = c("kf_atr"), c("kf_atr_c2c"), c("kf_innovation")
    volatility = {
        "is_high_volatility": above(c("atr"), c("_atr20") * 1.2), "is_low_volatility": below(c("atr"), c("_atr20") * 0.8), "expanding_atr": W.changes(c("atr")),
        "is_kf_atr_high_volatility": above(k, c("_katr20") * 1.2), "is_kf_atr_low_volatility": below(k, c("_katr20") * 0.8), "is_kf_atr_very_high_volatility": above(k, c("_katr20") + 2.0 * c("_katr_sd")),
        "is_kf_atr_squeeze": W.squeeze(k, 50, 1.1), "is_kf_atr_volatility_spike": clearly_above(c("kf_atr_innovation"), c("_atr_inn_sd") * 2.0), "is_kf_atr_volatility_drop": clearly_below(c("kf_atr_innovation"), c("_atr_inn_sd") * -2.0),
        "is_kf_atr_c2c_high_volatility": above(c2c, c("_kc2c20") * 1.2), "is_kf_atr_c2c_low_volatility": below(c2c, c("_kc2c20") * 0.8), "is_kf_atr_c2c_squeeze": W.squeeze(c2c, 50, 1.1),
        "is_kf_atr_c2c_very_high": zscore_beyond(c2c, c("_kc2c20"), c("_kc2c_sd"), 2.0), "is_kf_atr_c2c_spike": clearly_above(c("kf_atr_c2c_innovation"), c("_c2c_inn_sd") * 2.0), "is_kf_atr_c2c_drop": clearly_below(c("kf_atr_c2c_innovation"), c("_c2c_inn_sd") * -2.0),
        "kf_atr_c2c_contracting": W.changes(c2c, False), "kf_atr_c2c_expanding": W.changes(c2c), "kf_atr_contracting": W.changes(k, False), "kf_atr_expanding": W.changes(k),
        "is_kf_gap_volatility": above(c("kf_atr_vs_c2c"), 1.5), "is_kf_continuous_volatility": below(c("kf_atr_vs_c2c"), 1.2),
    }
    sk, sd, rsi = c("stoch_k"), c("stoch_d"), c("rsi_14")
    oscillators = {
        "is_rsi_oversold_recovery": W.recovers(rsi, 30.0), "is_rsi_overbought_recovery": W.recovers(rsi, 70.0, False), "rsi_bullish": above(rsi, 50.0), "rsi_bearish": below(rsi, 50.0),
        "rsi_very_bullish": above(rsi, 60.0), "rsi_very_bearish": below(rsi, 40.0), "is_stoch_oversold": below(F.round(sk, 10), 20.0), "is_stoch_overbought": above(F.round(sk, 10), 80.0),
        "stoch_bullish_cross": W.crosses(sk, sd), "stoch_bearish_cross": W.crosses(sk, sd, False), "is_strong_momentum_score": above(c("momentum_score"), 0.75), "is_weak_momentum_score": below(c("momentum_score"), 0.25),
        "macd_bullish": clearly_above(c("macd"), c("macd_signal")), "macd_bearish": clearly_below(c("macd"), c("macd_signal")), "macd_cross_up": W.crosses(c("macd"), c("macd_signal")), "macd_cross_down": W.crosses(c("macd"), c("macd_signal"), False),
        "macd_histogram_increasing": W.changes(c("macd_hist")), "macd_histogram_decreasing": W.changes(c("macd_hist"), False), "is_bb_squeeze": below(c("bb_std"), c("_bb20") * 0.8),
        "above_bb_middle": clearly_above(cl, c("_mid")), "below_bb_middle": clearly_below(cl, c("_mid")),
    }
    a = c("kf_adx")
    kalman = {
        "kf_above_smooth": above(c("kf_price_deviation"), 0.0), "kf_below_smooth": below(c("kf_price_deviation"), 0.0), "kf_above_trend": clearly_above(cl, c("kf_trend")), "kf_below_trend": clearly_below(cl, c("kf_trend")),
        "kf_adx_above_25": above(a, 25.0), "kf_adx_above_40": above(a, 40.0), "kf_adx_below_20": below(a, 20.0), "kf_adx_increasing": W.changes(a), "kf_adx_decreasing": W.changes(a, False),
        "kf_adx_accelerating": W.accelerates(c("_adx_slope")), "kf_adx_decelerating": W.accelerates(c("_adx_slope"), False), "is_kf_adx_surprise": clearly_above(c("kf_adx_innovation_abs"), c("_adx_inn20") * 1.5),
        "kf_adx_trend_emerging": yes((a > 20.0) & (W.lag(a, 5) < 20.0)), "kf_adx_trend_fading": yes((a < 25.0) & (W.lag(a, 5) > 30.0)), "kf_c2c_dominance": clearly_above(c2c, k * 0.7),
        "kf_momentum_increasing": W.changes(c("_kf_momentum")), "kf_momentum_decreasing": W.changes(c("_kf_momentum"), False), "kf_slope_increasing": W.changes(c("_kf_slope5")), "kf_slope_decreasing": W.changes(c("_kf_slope5"), False),
        "is_kf_strong_trend_low_vol": yes((a > 35.0) & (c("kf_atr_pct") < 0.012)), "kf_ema_aligned": chain(c("kf_smooth"), c("9ema"), c("200sma")),
        "kf_ema_divergence": clearly_below(c("kf_smooth"), c("kf_trend")) & clearly_below(c("kf_trend"), c("50ema")), "is_kf_positive_surprise": clearly_above(inn, c("_inn_sd")), "is_kf_negative_surprise": clearly_below(inn, -c("_inn_sd")),
        "is_kf_innovation_large": clearly_above(c("kf_innovation_abs"), c("_inn20") * 1.5),
    }
    df = df.withColumns(candle | trend | volatility | oscillators | kalman)
    return df.withColumns({
        "prev_tribar": W.shifted(c("is_tribar")),
        "kf_volatility_divergence": (c("kf_atr_expanding") & c("kf_atr_c2c_contracting")) | (c("kf_atr_contracting") & c("kf_atr_c2c_expanding")),
        "kf_trending_volatile": c("kf_adx_above_25") & c("is_kf_atr_high_volatility"), "kf_trending_quiet": c("kf_adx_above_25") & c("is_kf_atr_low_volatility"),
        "kf_ranging_volatile": c("kf_adx_below_20") & c("is_kf_atr_high_volatility"), "kf_ranging_quiet": c("kf_adx_below_20") & c("is_kf_atr_low_volatility"),
        "is_kf_breakout_potential": c("kf_adx_increasing") & c("kf_atr_expanding"), "is_kf_consolidation": c("kf_adx_decreasing") & c("kf_atr_contracting"),
        "kf_trending_c2c_volatile": c("kf_adx_above_25") & c("is_kf_atr_c2c_high_volatility"), "kf_trending_c2c_quiet": c("kf_adx_above_25") & c("is_kf_atr_c2c_low_volatility"),
        "is_kf_gap_trading_opportunity": c("is_kf_gap_volatility") & below(a, 25.0), "is_kf_smooth_trend": c("is_kf_continuous_volatility") & above(a, 30.0),
        "stoch_k": F.round("stoch_k", 15), "stoch_d": F.round("stoch_d", 15),
    })


#: bars before a segment that its windows look back on: the longest reach is 200
HALO = 256


def _segments(df: DataFrame, size: int) -> DataFrame:
    """Rows with ``_pos`` by segment: ``series_id`` becomes a struct of series and segment, and a row also goes to the segments that it stands at most HALO bars before."""
    at = F.floor(c("_pos") / size).cast("long")
    out = df.withColumn("_seg", F.explode(F.sequence(at, F.floor((c("_pos") + HALO) / size).cast("long")))).withColumn("_own", at == c("_seg"))
    return out.withColumn("series_id", F.struct("series_id", "_seg"))


def _by_series(size: int) -> Callable[[DataFrame], DataFrame]:
    """``_whole`` of rows by segment, through aggregates of the rows that a segment owns."""

    def whole(df: DataFrame) -> DataFrame:
        df = settle(df)
        own = df.where("_own").withColumn("series_id", c("series_id.series_id"))
        one = own.groupBy("series_id").agg(F.max(_FLAT()).alias("_flat"))
        few = order.quantiles(own, "trend_strength", {"_q80": 0.8})
        for table in (one, few):
            df = beside(df, table, {"series_id.series_id": "series_id"}, "left")
        for name, x in _RANKED.items():
            df = beside(df, order.ranks(own, x, name), {"series_id.series_id": "series_id", x: "value"}, "left")
        return df

    return whole


def features(bars: DataFrame, trim: bool = True, part: int | None = None) -> DataFrame:
    """The feature frame of bars whose prices are all present; ``trim`` drops warm-up rows and numbers the rest anew. Series of more than ``part`` bars are cut into segments."""
    size, bars = part or PART, check_prices(bars)
    long = longest(bars) > size
    df = recurrences(bars, size)
    df = _flags(_base(_segments(df, size), _by_series(size)) if long else _base(df, _whole))
    if long:
        df = df.where("_own").withColumn("series_id", c("series_id.series_id"))
    seg = ["_seg"] if long and trim else []
    df = df.drop(*[x for x in df.columns if x.startswith("_") and x not in seg], "ema200", "kf_adx_innovation")
    return _trimmed_segments(settle(df)) if seg else trimmed(df) if trim else df


def _core(df: DataFrame) -> list[str]:
    return [x for x in sorted({*CONTINUOUS, *ANCHORS, *PAIRED}) if x in df.columns]


def trimmed(df: DataFrame) -> DataFrame:
    """Rows on which every core number is defined; a column that its series never defines does not count."""
    core = _core(df)
    dead = df.withColumns({f"_n{i}": F.count(c(x)).over(W.whole()) for i, x in enumerate(core)})
    keep = reduce(lambda a, b: a & b, [c(x).isNotNull() | (c(f"_n{i}") == 0) for i, x in enumerate(core)])
    kept = dead.where(keep).drop(*[f"_n{i}" for i in range(len(core))])
    return kept.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("bar_idx")) - 1).cast("long"))


def _trimmed_segments(df: DataFrame) -> DataFrame:
    """The same of rows by segment (``_seg``): counts of a series are joined back, and a row's number is that of its segment's first row and its place there."""
    core = _core(df)
    counts = df.groupBy("series_id").agg(*[F.count(c(x)).alias(f"_n{i}") for i, x in enumerate(core)])
    keep = reduce(lambda a, b: a & b, [c(x).isNotNull() | (c(f"_n{i}") == 0) for i, x in enumerate(core)])
    kept = beside(df, counts, {"series_id": "series_id"}).where(keep).drop(*[f"_n{i}" for i in range(len(core))])
    sums = kept.groupBy("series_id", "_seg").agg(F.count("*").alias("_k"))
    sums = sums.select("series_id", "_seg", (F.sum("_k").over(Window.partitionBy("series_id").orderBy("_seg")) - c("_k")).alias("_off"))  # a row for each segment
    place = F.row_number().over(Window.partitionBy("series_id", "_seg").orderBy("bar_idx")) - 1
    out = beside(kept, sums, {"series_id": "series_id", "_seg": "_seg"}).withColumn("bar_idx", (c("_off") + place).cast("long"))
    return out.drop("_off", "_seg")
