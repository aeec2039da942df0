"""Queries of the larger operators: sources, feature frame, targets, catalog, combinations, formulas, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recurrence as R
from ..functions import window as W
from ..functions.scalar import rounded, yes
from ..operators import backtest, bitmaps, catalog, combine, formula, metrics, selection, store, targets
from ..operators.features import features
from ..operators.metrics import Sizing
from ..sources import bars as B
from .kernels import ALONG, ATR14, BARS, FLAG, FOLD_PART, HOUR, SRC, all_bars, put, w

c = F.col
T = "2x_atr_tp_atr_stop"


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[rounded(c(f"`{n}`"), digits).alias(n) if t == "double" else c(f"`{n}`") for n, t in df.dtypes])


# sources
put("s01_bars", lambda s, d: _round(all_bars(s, d).drop("ts")), f"WITH {BARS} SELECT series_id, bar_idx, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM b")
put("s04_date_range", lambda s, d: B.remap_exits(B.date_range(all_bars(s, d).withColumn("t_exit_i", c("bar_idx") + 3), "2024-01-05", "2024-01-20")).select("series_id", "bar_idx", "t_exit_i"),
    f"WITH {BARS}, x AS (SELECT series_id, bar_idx FROM b WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') SELECT series_id, bar_idx - min(bar_idx) OVER (PARTITION BY series_id) AS bar_idx, bar_idx + 3 - min(bar_idx) OVER (PARTITION BY series_id) AS t_exit_i FROM x")
put("s05_embargo", lambda s, d: B.embargo(all_bars(s, d), 10).select("series_id", "bar_idx"), f"WITH {BARS} SELECT series_id, bar_idx FROM b WHERE bar_idx >= 10")


def atr_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(h, low, x):
        return {"atr": (yield from R.atr_of(h, low, x))}

    return R.along_parts(all_bars(spark, sf_dir), make, ("high", "low", "close"), atr="double")


def hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(B.bars_hour(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature frame of the hourly bars with a long target."""
    return targets.attach(hour_features(spark, sf_dir), T, direction="long", tick=0.25)


put("e01_features", lambda s, d: _round(features(all_bars(s, d)).drop("ts"), 6), None)


# targets
def _barrier_sql(name: str) -> str:
    b = targets.BARRIERS[name]
    stop = {"bar": "low", "atr": "close - atr", "wide": "least(low, close - atr)", "tight": "CASE WHEN low < close AND close - atr < close THEN greatest(low, close - atr) WHEN low < close THEN low WHEN close - atr < close THEN close - atr END"}[b.stop]
    stop_s = {"bar": "high", "atr": "close + atr", "wide": "greatest(high, close + atr)", "tight": "CASE WHEN high > close AND close + atr > close THEN least(high, close + atr) WHEN high > close THEN high WHEN close + atr > close THEN close + atr END"}[b.stop]
    size = "risk" if b.by_risk else "atr"
    least = f"AND (take - close) / risk > {b.least_rr}" if b.least_rr is not None else ""
    mirror = "SELECT series_id, bar_idx, 'short' AS side, -open AS open, -low AS high, -high AS low, -close AS close, atr FROM a"
    return f"""WITH RECURSIVE {BARS}, {SRC}, {ATR14}, a AS (SELECT b.series_id, b.bar_idx, b.open, b.high, b.low, b.close, a14.v AS atr FROM b JOIN a14 ON a14.series_id = b.series_id AND a14.i = b.bar_idx),
m AS (SELECT series_id, bar_idx, 'long' AS side, open, high, low, close, atr FROM a UNION ALL {mirror}),
s0 AS (SELECT a.*, 'long' AS side, {stop} AS stop FROM a WHERE close > open UNION ALL SELECT series_id, bar_idx, -open, -low, -high, -close, atr, 'short', -({stop_s}) FROM a WHERE close < open),
s1 AS (SELECT *, close - floor(stop / 0.25) * 0.25 AS risk, floor(stop / 0.25) * 0.25 AS q FROM s0),
s2 AS (SELECT series_id, bar_idx, side, close, q AS stop, risk, ceil((close + {b.reward} * {size}) / 0.25) * 0.25 AS take FROM s1 WHERE q < close AND risk > 1e-9),
s3 AS (SELECT * FROM s2 WHERE true {least}),
f AS (SELECT s3.series_id, s3.bar_idx, s3.side, min(m.bar_idx) AS exit_i FROM s3 JOIN m ON m.series_id = s3.series_id AND m.side = s3.side AND m.bar_idx > s3.bar_idx AND (m.low <= s3.stop OR m.high >= s3.take OR m.open <= s3.stop OR m.open >= s3.take) GROUP BY 1, 2, 3)
SELECT s3.series_id, s3.bar_idx, s3.side, f.exit_i, CAST(NOT m.open <= stop AND (m.open >= take OR (m.low > stop AND m.high >= take)) AS INTEGER) AS hit,
round(CASE WHEN m.open <= stop OR m.open >= take THEN (m.open - s3.close) / risk WHEN m.low <= stop THEN -1 ELSE (take - s3.close) / risk END, 4) AS rr, round(risk, 4) AS risk
FROM s3 JOIN f ON f.series_id = s3.series_id AND f.bar_idx = s3.bar_idx AND f.side = s3.side JOIN m ON m.series_id = f.series_id AND m.side = f.side AND m.bar_idx = f.exit_i"""


def _barrier(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, out = atr_bars(spark, sf_dir), None
        for side in targets.SIDES:
            # those with bar stops run in parts that the longest series has several of, those with ATR stops in parts of the usual size
            t = targets.barrier_target(df, name, side, tick=0.25, part=FOLD_PART if name.startswith("highlow") else None)
            t = t.where(c(f"`rr_{name}_{side}`").isNotNull()).select("series_id", "bar_idx", F.lit(side).alias("side"), c(f"`{name}_exit_i_{side}`").alias("exit_i"), c(f"`{name}_{side}`").cast("int").alias("hit"), rounded(f"`rr_{name}_{side}`", 4).alias("rr"), rounded(f"`{name}_risk_{side}`", 4).alias("risk"))
            out = t if out is None else out.unionByName(t)
        return out

    return run


for _n in targets.BARRIERS:
    put(f"t_{_n}", _barrier(_n), _barrier_sql(_n))


def _next_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = all_bars(spark, sf_dir).withColumn("wicks_diff", F.when(c("close") > c("open"), c("open") - c("low")).otherwise(c("high") - c("open")))
    n = "next_bar_color_and_wicks"
    t = targets.next_bar_target(df.withColumn("wicks_diff_sma14", W.sma(c("wicks_diff"), 14)), n, tick=0.25)
    return t.where(c(f"{n}_exit_i_long").isNotNull()).select("series_id", "bar_idx", *[x for s in targets.SIDES for x in (c(f"{n}_{s}").cast("int").alias(f"hit_{s}"), rounded(f"rr_{n}_{s}", 4).alias(f"rr_{s}"), c(f"{n}_exit_i_{s}").alias(f"exit_{s}"))])


_D = f"lead({{}}) {ALONG}"
_NEXT = f"""x AS (SELECT *, CASE WHEN close > open THEN open - low ELSE high - open END AS wd FROM b), y AS (SELECT *, CASE WHEN count(wd) {w(14)} = 14 THEN avg(wd) {w(14)} END AS m FROM x),
z AS (SELECT series_id, bar_idx, {_D.format('open')} AS o, {_D.format('high')} AS h, {_D.format('low')} AS l, {_D.format('close')} AS cl, {_D.format('bar_idx')} AS j, CASE WHEN abs(m * 1.5) < 2.3e-16 THEN 0 ELSE greatest(ceil(abs(m * 1.5) / 0.25), 1) * 0.25 END AS raw FROM y),
q AS (SELECT *, CASE WHEN o IS NOT NULL AND raw > 1e-9 THEN raw END AS d FROM z)"""
put("t_next_bar_color_and_wicks", _next_bar, f"""WITH {BARS}, {_NEXT} SELECT series_id, bar_idx, {FLAG('cl > o AND l > o - d')} AS hit_long, round(CASE WHEN l <= o - d THEN -1 ELSE (cl - o) / d END, 4) AS rr_long, CASE WHEN d IS NOT NULL THEN j END AS exit_long,
{FLAG('cl < o AND h < o + d')} AS hit_short, round(CASE WHEN h >= o + d THEN -1 ELSE (o - cl) / d END, 4) AS rr_short, CASE WHEN d IS NOT NULL THEN j END AS exit_short FROM q WHERE d IS NOT NULL""")


def _tribar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "tribar_4h_2atr"
    return targets.attach(hour_features(spark, sf_dir), n).where(c(f"rr_{n}").isNotNull()).select("bar_idx", F.round(f"rr_{n}", 6).alias("rr"), c(f"{n}_exit_i").alias("exit_i"), c(n).alias("label"))


put("t_tribar_4h_2atr", _tribar, None)
put("p01_period_backtest", lambda s, d: _round(backtest.trades(backtest.period_backtest(hour_features(s, d), backtest.entry_condition("is_tribar"), backtest.trading_week(), "week"), "week").drop("ts"), 6), None)
put("p04_week_key", lambda s, d: all_bars(s, d).select("series_id", "bar_idx", backtest.trading_week().alias("week"), targets.week_key().alias("iso_week"), backtest.month().alias("month")),
    f"WITH {BARS} SELECT series_id, bar_idx, CAST(floor((epoch(ts) - 338400) / 604800) AS BIGINT) AS week, CAST(isoyear(ts) * 100 + weekofyear(ts) AS BIGINT) AS iso_week, CAST(year(ts) * 12 + month(ts) AS BIGINT) AS month FROM b")
put("p05_period_end", lambda s, d: backtest.period_ends(all_bars(s, d), backtest.month()).select("series_id", "bar_idx", "period_end"), f"WITH {BARS} SELECT series_id, bar_idx, max(bar_idx) OVER (PARTITION BY series_id, year(ts) * 12 + month(ts)) AS period_end FROM b")


# catalog
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = all_bars(spark, sf_dir).where("series_id = 'events'")
    got = catalog.percentiles(df, ["open", "high", "low", "close"])
    return spark.createDataFrame([(k, n, round(a, 6), round(b, 6)) for k, (n, a, b) in sorted(got.items())], "feature string, n long, p1 double, p99 double")


put("c04_percentiles", _bounds, f"WITH {HOUR} " + " UNION ALL ".join(f"SELECT '{x}' AS feature, count({x}) AS n, round(quantile_cont({x}, 0.01), 6) AS p1, round(quantile_cont({x}, 0.99), 6) AS p99 FROM b" for x in ("open", "high", "low", "close")))
put("c01_catalog", lambda s, d: catalog.as_table(s, catalog.build(hour_features(s, d))), None)
def _pairs_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars of each series meet each pair of prices."""
    preds = catalog.pair_predicates(list(B.PRICES))
    met = all_bars(spark, sf_dir).select("series_id", F.inline(F.array_compact(F.array(*[F.when(p.column(), F.struct(F.lit(p.name).alias("name"), F.lit(p.base).alias("base"), F.lit(p.op).alias("op"), F.lit(p.rhs).alias("rhs"))) for p in preds]))))
    return met.groupBy("series_id", "name", "base", "op", "rhs").agg(F.count("*").alias("bars"))


put("c10_pairs", _pairs_held, f"WITH {BARS}, x AS (" + " UNION ALL ".join(f"SELECT series_id, '{a}{o}{z}' AS name, '{a}' AS base, '{o}' AS op, '{z}' AS rhs FROM b WHERE {a} {o} {z}" for i, a in enumerate(sorted(B.PRICES)) for z in sorted(B.PRICES)[i + 1 :] for o in "><") + ") SELECT *, count(*) AS bars FROM x GROUP BY ALL")

FLAGS = {"is_green": "close > open", "prev_green": "lag(close > open, 1, false) " + ALONG, "higher_high": f"coalesce(high > lag(high) {ALONG}, false)", "higher_low": f"coalesce(low > lag(low) {ALONG}, false)", "above_sma": f"coalesce(close > CASE WHEN count(close) {w(20)} = 20 THEN avg(close) {w(20)} END, false)"}


def slice_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: hourly bars, five flags, a label of the next bar."""
    df = B.bars_hour(spark, sf_dir)
    green = yes(c("close") > c("open"))
    nxt = F.lead(c("close") - c("open")).over(W.along())
    span = W.sma(c("high") - c("low"), 14)
    df = df.withColumns({"is_green": green, "higher_high": W.changes(c("high")), "higher_low": W.changes(c("low")), "above_sma": yes(c("close") > W.sma(c("close"), 20)), "_r": F.when(span > 0, nxt / span), "t_exit_i": c("bar_idx") + 1})
    return df.withColumns({"prev_green": W.shifted(c("is_green")), "rr_t": F.when(c("_r").isNull(), F.lit(float("nan"))).otherwise(rounded("_r", 6)), "t": yes(c("_r") > 0), "t_eligible": c("_r").isNotNull()}).drop("_r")


def held_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all kinds of bars, with trades that last three bars, so that they overlap; a series each."""
    df = all_bars(spark, sf_dir)
    green = yes(c("close") > c("open"))
    nxt, span = F.lead(c("close") - c("open")).over(W.along()), W.sma(c("high") - c("low"), 14)
    df = df.withColumns({"is_green": green, "higher_high": W.changes(c("high")), "higher_low": W.changes(c("low")), "above_sma": yes(c("close") > W.sma(c("close"), 20)), "_r": F.when(span > 0, nxt / span), "t_exit_i": c("bar_idx") + 3})
    return df.withColumns({"prev_green": W.shifted(c("is_green")), "rr_t": F.when(c("_r").isNull(), F.lit(float("nan"))).otherwise(rounded("_r", 6)), "t": yes(c("_r") > 0), "t_eligible": c("_r").isNotNull()}).drop("_r")


def held_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_frame(spark, sf_dir).where("series_id = 'events'")


_SLICE = f"""{HOUR}, x AS (SELECT *, {', '.join(f'{s} AS {k}' for k, s in FLAGS.items())}, lead(close - open) {ALONG} AS nxt, CASE WHEN count(*) {w(14)} = 14 THEN avg(high - low) {w(14)} END AS span FROM b),
y AS (SELECT *, round(CASE WHEN span > 0 THEN nxt / span END, 6) AS rr FROM x)"""
PREDICATES = [catalog.Predicate(k, k) for k in sorted(FLAGS)]


def depth_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, total return and win rate of each flag, best first."""
    df = slice_frame(spark, sf_dir)
    cols = combine.trade_columns("t")
    d = df.select(*[v.alias(k) for k, v in cols.items()], F.explode(F.array_compact(F.array(*[F.when(p.column(), F.lit(p.name)) for p in PREDICATES]))).alias("combination"))
    g = d.groupBy("combination").agg(F.count("*").alias("mask_hits"), F.count_if("_gate").alias("trades"), F.round(F.sum(F.when(c("_gate"), c("_reward"))), 4).alias("total_return"), F.round(F.avg(F.when(c("_gate"), (c("_reward") > 0).cast("double"))) * 100, 4).alias("win_rate"))
    return g.orderBy(F.desc("total_return"), "combination").limit(20)


#: the same, over all bars or the hourly ones, for trades that may not overlap
_HELD = _SLICE.replace(HOUR, BARS)
_HELD_ONE = _SLICE


def took_sql(frame: str, hits: list[tuple[str, str]], stacking: bool = False, days: bool = False) -> str:
    """CTEs that end with tk (combination, series_id, bar_idx, rr): the trades of named conditions over a frame y; not overlapping, for three bars each."""
    p = " UNION ALL ".join(f"SELECT '{n}' AS combination, series_id, bar_idx, rr{', ts' if days else ''} FROM y WHERE {x}" for n, x in hits)
    more = "year(ts)" if days else "0"
    head = f"{frame}, p AS ({p}), pt AS (SELECT combination, series_id, bar_idx, rr, {more} AS grp FROM p WHERE rr IS NOT NULL)"
    if stacking:
        return f"{head}, tk AS (SELECT * FROM pt)"
    return f"""{head}, ch(combination, series_id, grp, bar_idx) AS (SELECT combination, series_id, grp, min(bar_idx) FROM pt GROUP BY 1, 2, 3
  UNION ALL SELECT ch.combination, ch.series_id, ch.grp, min(pt.bar_idx) FROM ch JOIN pt ON pt.combination = ch.combination AND pt.series_id = ch.series_id AND pt.grp = ch.grp AND pt.bar_idx >= ch.bar_idx + 3 GROUP BY 1, 2, 3),
tk AS (SELECT pt.* FROM ch JOIN pt ON pt.combination = ch.combination AND pt.series_id = ch.series_id AND pt.grp = ch.grp AND pt.bar_idx = ch.bar_idx)"""


def metrics_sql(source: str = "tk", keys: str = "combination", years: str = "1.0") -> str:
    """CTEs over trades (keys, series_id, bar_idx, rr) that end with mt: keys and all metrics of a capital of 100,000 at 1 % risk."""
    part, order = f"PARTITION BY {keys}", "ORDER BY series_id, bar_idx"
    k = [x.strip() for x in keys.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    return f"""m1 AS (SELECT *, row_number() OVER ({part} {order}) AS i, sum(rr) OVER ({part} {order}) AS eq, 100000 * exp(sum(ln(1 + rr / 100)) OVER ({part} {order})) AS cap, sign(rr) AS sg FROM {source}),
m2 AS (SELECT *, greatest(max(eq) OVER ({part} ORDER BY i), 0) AS peak, greatest(max(cap) OVER ({part} ORDER BY i), 100000) AS top, coalesce(lag(cap) OVER ({part} ORDER BY i), 100000) AS was, i - row_number() OVER ({part}, sg ORDER BY i) AS run FROM m1),
st AS (SELECT {keys}, sg, run, count(*) AS n FROM m2 WHERE sg <> 0 GROUP BY {keys}, sg, run),
ss AS (SELECT {keys}, coalesce(max(n) FILTER (sg > 0), 0) AS max_consecutive_wins, coalesce(avg(n) FILTER (sg > 0), 0) AS avg_win_streak, coalesce(max(n) FILTER (sg < 0), 0) AS max_consecutive_losses, coalesce(avg(n) FILTER (sg < 0), 0) AS avg_loss_streak FROM st GROUP BY {keys}),
m3 AS (SELECT {keys}, count(*) AS trades, count(*) FILTER (rr > 0) AS wins, count(*) FILTER (rr < 0) AS losses, sum(rr) AS total_return, max(peak - eq) AS max_drawdown, arg_max(cap, i) AS final_capital, max((top - cap) / top * 100) AS max_drawdown_pct_equity,
  sum(rr) FILTER (rr > 0) AS won, -sum(rr) FILTER (rr < 0) AS lost, avg(rr) FILTER (rr > 0) AS aw, -avg(rr) FILTER (rr < 0) AS al, greatest(max(rr), 0) AS largest_win, greatest(-min(rr), 0) AS largest_loss,
  sqrt(sum(CASE WHEN peak >= 2.220446049250313e-16 THEN power((eq - peak) / (peak + 2.220446049250313e-16) * 100, 2) ELSE 0 END) / count(*)) AS ulcer_index, avg(eq - peak) AS pain, list_sort(list(rr)) AS r, max(top - cap) AS max_drawdown_dollar,
  avg(cap / was - 1) AS mean_ret, avg(power(cap / was - 1, 2)) AS sq_ret, sqrt(avg(power(cap / was - 1, 2)) FILTER (cap < was)) AS down FROM m2 GROUP BY {keys}),
m4 AS (SELECT *, (final_capital / 100000 - 1) * 100 AS total_return_pct, (power(final_capital / 100000, 1 / {years}) - 1) * 100 AS cagr_pct, sqrt(greatest(sq_ret - mean_ret * mean_ret, 0)) AS sd, sqrt(trades / {years}) AS scale FROM m3),
mt AS (SELECT {', '.join(f'm4.{x}' for x in k)}, trades, wins, losses, wins * 100.0 / trades AS win_rate, total_return, max_drawdown, final_capital, total_return_pct, cagr_pct, max_drawdown_pct_equity, CASE WHEN max_drawdown_pct_equity > 0 THEN cagr_pct / max_drawdown_pct_equity WHEN cagr_pct > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS calmar_ratio,
  total_return / trades AS expectancy, CASE WHEN lost > 0 THEN coalesce(won, 0) / lost WHEN won > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS profit_factor, coalesce(aw, 0) AS avg_winning_rr, coalesce(-al, 0) AS avg_losing_rr, CASE WHEN al > 0 THEN coalesce(aw, 0) / al WHEN aw > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS win_loss_ratio,
  largest_win, largest_loss, ulcer_index, CASE WHEN pain < 0 THEN total_return / abs(pain) ELSE 0 END AS pain_ratio, ss.* EXCLUDE ({keys}), list_median(r) AS median_rr, r[CAST(floor((trades - 1) * 0.05 + 0.5) AS INTEGER) + 1] AS p05_rr, r[CAST(floor((trades - 1) * 0.95 + 0.5) AS INTEGER) + 1] AS p95_rr,
  CASE WHEN trades >= 100 THEN 'excellent' WHEN trades >= 50 THEN 'good' WHEN trades >= 30 THEN 'fair' ELSE 'poor' END AS sample_quality, final_capital - 100000 AS total_return_dollar, max_drawdown_dollar, (final_capital - 100000) / trades AS expectancy_dollar,
  CASE WHEN sd > 0 THEN mean_ret / sd * scale ELSE 0 END AS sharpe_equity, CASE WHEN down > 0 THEN mean_ret / down * scale WHEN mean_ret > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS sortino_equity FROM m4 LEFT JOIN ss ON {same('ss', 'm4')})"""


METRIC_KINDS = dict(x.split() for x in formula.METRICS.split(", "))


def rounded_sql(digits: int = 4) -> str:
    return ", ".join(f"CAST({k} AS BIGINT) AS {k}" if t == "long" else f"round({k}, {digits}) AS {k}" if t == "double" else k for k, t in METRIC_KINDS.items())


_ONE = " UNION ALL ".join(f"SELECT '{k}' AS combination, CAST(count(*) AS BIGINT) AS mask_hits, CAST(count(rr) AS BIGINT) AS trades, round(sum(rr), 4) AS total_return, round(avg(CASE WHEN rr > 0 THEN 1.0 WHEN rr IS NOT NULL THEN 0.0 END) * 100, 4) AS win_rate FROM y WHERE {k}" for k in FLAGS)
put("flagship_depth1", depth_one, f"WITH {_SLICE} SELECT * FROM ({_ONE}) ORDER BY total_return DESC, combination LIMIT 20")
put("c13_support", lambda s, d: s.createDataFrame([(k, a, g) for k, (a, g, _) in catalog.supports(slice_frame(s, d), PREDICATES, c("t_eligible")).items()], "name string, hits long, gated long"),
    f"WITH {_SLICE} " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS hits, count(rr) AS gated FROM y WHERE {k}" for k in FLAGS))

_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS name_a, '{b}' AS name_b, count(*) AS mask_hits, count(rr) AS gated, round(coalesce(sum(rr), 0), 4) AS total_return FROM y WHERE {a} AND {b}" for i, a in enumerate(sorted(FLAGS)) for b in sorted(FLAGS)[i + 1 :])
put("a04_pairs", lambda s, d: _round(combine.evaluate_pairs(slice_frame(s, d), PREDICATES, combine.trade_columns("t"))), f"WITH {_SLICE} SELECT * FROM ({_PAIRS}) WHERE mask_hits > 0")


def _evaluated(spark: SparkSession, sf_dir: str, depth: int, stacking: bool) -> DataFrame:
    df = slice_frame(spark, sf_dir)
    return combine.evaluate(spark, combine.prepare(df, PREDICATES, combine.trade_columns("t")), depth, 1, stacking=stacking)


def _combos_sql(depth: int) -> list[tuple[str, str]]:
    import itertools

    return [(" && ".join(x), " AND ".join(x)) for k in range(1, depth + 1) for x in itertools.combinations(sorted(FLAGS), k)]


put("a11_evaluate_stacking", lambda s, d: _round(_evaluated(s, d, 3, True).select("combination", "mask_hits", "trades", "wins", "losses", "total_return", "max_drawdown")), f"WITH {_SLICE}, " + """p AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS combination, bar_idx, rr FROM y WHERE {x}" for n, x in _combos_sql(3)) + """),
e AS (SELECT combination, bar_idx, rr, sum(rr) OVER (PARTITION BY combination ORDER BY bar_idx) AS eq FROM p WHERE rr IS NOT NULL),
f AS (SELECT *, eq - greatest(max(eq) OVER (PARTITION BY combination ORDER BY bar_idx), 0) AS dd FROM e),
h AS (SELECT combination, count(*) AS mask_hits FROM p GROUP BY 1)
SELECT h.combination, mask_hits, count(*) AS trades, CAST(count(*) FILTER (rr > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (rr < 0) AS BIGINT) AS losses, round(sum(rr), 4) AS total_return, round(abs(min(dd)), 4) AS max_drawdown FROM f JOIN h ON h.combination = f.combination GROUP BY h.combination, mask_hits""")


CORE = ["wins", "losses", "win_rate", "total_return", "max_drawdown", "final_capital", "total_return_pct", "cagr_pct", "max_drawdown_pct_equity", "calmar_ratio"]


def _core_sql(depth: int, stacking: bool, frame: str = _HELD_ONE) -> str:
    core = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in ("wins", "losses") else f"round({k}, 4) AS {k}" for k in CORE)
    return f"WITH RECURSIVE {took_sql(frame, _combos_sql(depth), stacking)}, {metrics_sql()}, h AS (SELECT combination, count(*) AS mask_hits FROM p GROUP BY 1) SELECT mt.combination, CAST(mask_hits AS BIGINT) AS mask_hits, CAST(trades AS BIGINT) AS trades, {core} FROM mt JOIN h ON h.combination = mt.combination"


def _by_blocks(spark: SparkSession, sf_dir: str, stacking: bool) -> DataFrame:
    """All series, their masks in blocks that the longest has several of."""
    out = bitmaps.evaluate(held_frame(spark, sf_dir), PREDICATES, combine.trade_columns("t"), 3, 1, stacking=stacking, size=FOLD_PART, lane=10)
    return _round(out.select("combination", "mask_hits", "trades", *CORE))


put("a02_masks_in_blocks", lambda s, d: _by_blocks(s, d, False), _core_sql(3, False, _HELD))
put("a06_masks_in_blocks_stacking", lambda s, d: _by_blocks(s, d, True), _core_sql(3, True, _HELD))


def _core(spark: SparkSession, sf_dir: str, stacking: bool) -> DataFrame:
    setup = combine.prepare(held_one(spark, sf_dir), PREDICATES, combine.trade_columns("t"))
    return _round(combine.evaluate(spark, setup, 3, 1, stacking=stacking).select("combination", "mask_hits", "trades", *CORE))


put("a09_evaluate_no_stacking", lambda s, d: _core(s, d, False), _core_sql(3, False))
put("a12_equity_metrics", lambda s, d: _core(s, d, True), _core_sql(3, True))
def _unranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of four nations, by their numbers."""
    names = [r.n_name for r in B.read_table(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").collect()]  # a dimension of 25 rows
    of = F.transform(F.split("combination", " "), lambda i: F.element_at(F.array(*[F.lit(x) for x in names]), i.cast("int") + 1))
    return combine.combinations(spark, len(names), 4, 100, 12_000).select(c("number").cast("long").alias("number"), F.array_join(of, " && ").alias("combination"))


put("n03_unrank", _unranked, """WITH i AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) AS x FROM nation), q AS (SELECT a.name || ' && ' || b.name || ' && ' || c.name || ' && ' || d.name AS combination, row_number() OVER (ORDER BY a.x, b.x, c.x, d.x) - 1 AS number FROM i a JOIN i b ON b.x > a.x JOIN i c ON c.x > b.x JOIN i d ON d.x > c.x)
SELECT CAST(number AS BIGINT) AS number, combination FROM q WHERE number >= 100 AND number < 12000""")
put("n01_count", lambda s, d: combine.totals(B.read_table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")), 5).select(c("s_nationkey").cast("long").alias("s_nationkey"), "depth", c("combinations").cast("long").alias("combinations"), c("total").cast("long").alias("total")),
    "WITH RECURSIVE g AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), f(s_nationkey, n, k, b) AS (SELECT s_nationkey, n, 1, CAST(n AS HUGEINT) FROM g UNION ALL SELECT s_nationkey, n, k + 1, b * greatest(n - k, 0) // (k + 1) FROM f WHERE k < 5) SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, k AS depth, CAST(b AS BIGINT) AS combinations, CAST(sum(b) OVER (PARTITION BY s_nationkey ORDER BY k) AS BIGINT) AS total FROM f")
put("q01_top_results", lambda s, d: _round(store.top_results(_evaluated(s, d, 2, True), 5, 10, rank_by="total_return").select("combination", "trades", "total_return")),
    f"WITH {_SLICE}, p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS combination, count(rr) AS trades, sum(rr) AS t FROM y WHERE {x}" for n, x in _combos_sql(2)) + ") SELECT combination, trades, round(t, 4) AS total_return FROM p WHERE trades >= 10 ORDER BY t DESC, combination LIMIT 5")

# formulas
FORMULAS = formula.parse_lines("Rank 1: is_green && higher_high\nRank 2: higher_low && close>open\nclose>100.5 && open<=90\n# none\nRank 9: above_sma")
put("x02_hits", lambda s, d: formula.hits(slice_frame(s, d), FORMULAS, "t").groupBy("formula_id").agg(F.count("*").alias("hits"), F.count_if("_gate").alias("gated")),
    f"WITH {_SLICE} " + " UNION ALL ".join(f"SELECT {i} AS formula_id, count(*) AS hits, count(rr) AS gated FROM y WHERE {x}" for i, x in enumerate(("is_green AND higher_high", "higher_low AND close > open", "close > 100.5 AND open <= 90", "above_sma"))))
_CONDITIONS = [("is_green && higher_high", "is_green AND higher_high"), ("higher_low && close>open", "higher_low AND close > open"), ("close>100.5 && open<=90", "close > 100.5 AND open <= 90"), ("above_sma", "above_sma")]


def _full_sql(frame: str, stacking: bool = False) -> str:
    zero = ", ".join("CAST(0 AS BIGINT)" if t == "long" else "0.0" if t == "double" else "'poor'" for t in METRIC_KINDS.values())
    names = "(VALUES " + ", ".join(f"('{n}')" for n, _ in _CONDITIONS) + ") AS v(formula)"
    filled = ", ".join(f"coalesce(q.{k}, {z}) AS {k}" for k, z in zip(METRIC_KINDS, zero.split(", ")))
    return f"""WITH RECURSIVE {took_sql(frame, _CONDITIONS, stacking)}, {metrics_sql()}, h AS (SELECT combination, count(*) AS n FROM p GROUP BY 1), q AS (SELECT combination, CAST(trades AS BIGINT) AS trades, {rounded_sql()} FROM mt)
SELECT v.formula, CAST(coalesce(h.n, 0) AS BIGINT) AS mask_hits, coalesce(q.trades, 0) AS trades, {filled} FROM {names} LEFT JOIN q ON q.combination = v.formula LEFT JOIN h ON h.combination = v.formula"""


put("x07_evaluate_window", lambda s, d: _round(formula.evaluate_window(held_one(s, d), FORMULAS, "t").select("formula", "mask_hits", "trades", *METRIC_KINDS)), _full_sql(_HELD_ONE))
put("x07_many_series", lambda s, d: _round(formula.evaluate_window(held_frame(s, d), FORMULAS, "t", part=FOLD_PART).select("formula", "mask_hits", "trades", *METRIC_KINDS)), _full_sql(_HELD))


def _top_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best combinations by what the search stores, with full metrics computed again."""
    df, cols = held_one(spark, sf_dir), combine.trade_columns("t")
    found = combine.evaluate(spark, combine.prepare(df, PREDICATES, cols), 2, 20)
    full = store.full_results(df, store.top_results(found, 5, rank_by="total_return"), cols, PREDICATES, False, Sizing())
    return _round(full.select("combination", "stored_trades", "stored_total_return", "mask_hits", "trades", *METRIC_KINDS))


put("a23_top_full", _top_full, f"""WITH RECURSIVE {took_sql(_HELD_ONE, _combos_sql(2))}, {metrics_sql()}, h AS (SELECT combination, count(*) AS n FROM p GROUP BY 1), q AS (SELECT combination, total_return AS stored, CAST(trades AS BIGINT) AS trades, {rounded_sql()} FROM mt WHERE trades >= 20 ORDER BY total_return DESC, combination LIMIT 5)
SELECT q.combination, q.trades AS stored_trades, round(stored, 4) AS stored_total_return, h.n AS mask_hits, q.* EXCLUDE (combination, stored) FROM q JOIN h ON h.combination = q.combination""")


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contracts of 0.01 dollars a point, bought for 2 % of what there is by the distance of the stop, at most 40 and within a margin of 3,000; a trade costs 0.05 dollars."""
    df = slice_frame(spark, sf_dir).withColumn("stop", W.sma(c("high") - c("low"), 14))
    cols = combine.trade_columns("t", cost_dollar=F.lit(0.05), risk_dollar=metrics.risk_dollars(c("stop"), 0.01))
    sizing = Sizing(risk_pct=2.0, contracts=True, most=40, margin=3_000.0)
    out = bitmaps.evaluate(df, PREDICATES, cols, 1, 1, stacking=True, sizing=sizing, size=FOLD_PART)
    return _round(out.select("combination", "trades", "total_return", "final_capital", "total_return_pct", "max_drawdown_pct_equity"))


put("a13_contracts", _contracts, f"""WITH RECURSIVE {_SLICE}, z AS (SELECT *, span * 0.01 AS d, rr - 0.05 / (span * 0.01) AS net FROM y WHERE rr IS NOT NULL AND span > 0),
p AS ({' UNION ALL '.join(f"SELECT '{k}' AS combination, bar_idx, net, d FROM z WHERE {k}" for k in FLAGS)}), q AS (SELECT *, row_number() OVER (PARTITION BY combination ORDER BY bar_idx) AS i FROM p),
cap(combination, i, x) AS (SELECT DISTINCT combination, CAST(0 AS BIGINT), CAST(100000 AS DOUBLE) FROM q
  UNION ALL SELECT q.combination, q.i, cap.x + q.net * q.d * least(greatest(floor(cap.x * 0.02 / q.d), 1), 40, CASE WHEN cap.x > 0 THEN floor(cap.x / 3000) ELSE 40 END) FROM cap JOIN q ON q.combination = cap.combination AND q.i = cap.i + 1),
e AS (SELECT *, max(x) OVER (PARTITION BY combination ORDER BY i) AS top FROM cap),
m AS (SELECT combination, arg_max(x, i) AS x, max((top - x) / top * 100) AS fall FROM e GROUP BY 1), r AS (SELECT combination, count(*) AS trades, sum(net) AS total FROM q GROUP BY 1)
SELECT m.combination, r.trades, round(total, 4) AS total_return, round(x, 4) AS final_capital, round((x / 100000 - 1) * 100, 4) AS total_return_pct, round(fall, 4) AS max_drawdown_pct_equity FROM m JOIN r ON r.combination = m.combination""")


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_frame(spark, sf_dir).where("series_id = 'orders'")


_YEARS = _HELD.replace("FROM b), y AS", "FROM b WHERE series_id = 'orders'), y AS").replace("FROM b),\ny AS", "FROM b WHERE series_id = 'orders'),\ny AS")
_YEARLY = f"""{took_sql(_YEARS, [c_ for c_ in _CONDITIONS if c_[0] != 'close>100.5 && open<=90'], days=True)}, {metrics_sql(keys='combination, grp')}"""
SOME = [f for f in FORMULAS if "100.5" not in f.expression]
put("x09_by_year", lambda s, d: _round(formula.by_year(_years(s, d), SOME, "t").where("trades > 0").select("formula", "year", "trades", *METRIC_KINDS), 6), f"WITH RECURSIVE {_YEARLY} SELECT combination AS formula, CAST(grp AS INTEGER) AS year, CAST(trades AS BIGINT) AS trades, {rounded_sql(6)} FROM mt")
put("x09_by_year_frs", lambda s, d: _round(formula.frs(formula.by_year(_years(s, d), SOME, "t")).select("formula", "k", "p", "c", "dd_max", "r_median", "n_med", "tail_penalty", "stability", "trade_score", "frs")), f"""WITH RECURSIVE {_YEARLY}, all_years AS (SELECT DISTINCT year(ts) AS grp FROM y),
w AS (SELECT n.formula AS combination, a.grp, coalesce(mt.total_return, 0) AS r, coalesce(mt.max_drawdown, 0) AS dd, coalesce(mt.trades, 0) AS n FROM (SELECT unnest([{', '.join(f"'{x}'" for x, _ in _CONDITIONS if x != 'close>100.5 && open<=90')}]) AS formula) n CROSS JOIN all_years a LEFT JOIN mt ON mt.combination = n.formula AND mt.grp = a.grp),
g AS (SELECT combination, count(*) AS k, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS p, median(r / (dd + 1e-9)) AS c, max(dd) AS dd_max, median(dd) AS dd_median, median(r) AS r_median, median(n) AS n_med FROM w GROUP BY 1),
d AS (SELECT w.combination, median(abs(w.r - g.r_median)) AS mad FROM w JOIN g ON g.combination = w.combination GROUP BY 1),
f AS (SELECT g.*, 1 / (1 + dd_max / (dd_median + 1e-9)) AS tail_penalty, 1 / (1 + mad / (abs(r_median) + 1e-9)) AS stability, least(n_med / 30, 1) AS trade_score FROM g JOIN d ON d.combination = g.combination)
SELECT combination AS formula, CAST(k AS BIGINT) AS k, round(p, 4) AS p, round(c, 4) AS c, round(dd_max, 4) AS dd_max, round(r_median, 4) AS r_median, round(n_med, 4) AS n_med, round(tail_penalty, 4) AS tail_penalty, round(stability, 4) AS stability, round(trade_score, 4) AS trade_score,
round(power(p, 2) * greatest(c, 0) * power(tail_penalty, 2) * stability * trade_score, 4) AS frs FROM f""")
put("x12_buy_and_hold", lambda s, d: _round(formula.buy_and_hold(all_bars(s, d)).select("series_id", "total_return_pct", "max_drawdown_pct")), f"""WITH {BARS}, p AS (SELECT *, max(close) {ALONG} AS peak FROM b)
SELECT series_id, round((arg_max(close, bar_idx) / arg_min(close, bar_idx) - 1) * 100, 4) AS total_return_pct, round(max((peak - close) / peak * 100), 4) AS max_drawdown_pct FROM p GROUP BY 1""")
put("x13_equity_curve", lambda s, d: _round(formula.equity_curve(slice_frame(s, d), FORMULAS[:1], "t", stacking=True).select("trade_no", "bar_idx", "rr", "equity_r"), 3), f"""WITH {_SLICE}, p AS (SELECT bar_idx, rr FROM y WHERE is_green AND higher_high AND rr IS NOT NULL)
SELECT row_number() OVER (ORDER BY bar_idx) - 1 AS trade_no, bar_idx, round(rr, 3) AS rr, round(sum(rr) OVER (ORDER BY bar_idx), 3) AS equity_r FROM p""")


# selection
def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = slice_frame(spark, sf_dir)
    out = []
    for half in (c("bar_idx") < 360, c("bar_idx") >= 360):
        r = formula.evaluate_window(df.where(half), FORMULAS, "t", stacking=True)
        out.append(formula.rank_window(r, "calmar_ratio", "source_rank").withColumnRenamed("window_rank", "rank"))
    return out[0], out[1]


put("v01_decisions", lambda s, d: _round(selection.decide(*_windows(s, d), selection.Policy(pre_min_trades=20, post_min_trades=10, min_pre_frs=None)).select("formula", "status", "reasons", "pre_total_return", "post_total_return")), None)
put("v04_blocks", lambda s, d: selection.blocks(all_bars(s, d).where("series_id = 'orders'"), 8).groupBy("block").agg(F.count("*").alias("n")),
    f"""WITH {BARS}, o AS (SELECT CAST(ts AS DATE) AS d FROM b WHERE series_id = 'orders'), m AS (SELECT min(d) AS a, date_diff('day', min(d), max(d)) + 1 AS days FROM o),
x AS (SELECT CAST((SELECT count(*) FROM range(1, 8) t(i) WHERE date_diff('day', a, d) >= i * days // 8) AS INTEGER) AS block FROM o, m) SELECT block, count(*) AS n FROM x GROUP BY 1""")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = slice_frame(spark, sf_dir).withColumn("block", F.floor(c("bar_idx") * 6 / F.count("*").over(W.whole())).cast("int"))
    cols = combine.trade_columns("t")
    d = df.select("block", *[v.alias(k) for k, v in cols.items()], F.explode(F.array_compact(F.array(*[F.when(p.column(), F.lit(p.name)) for p in PREDICATES]))).alias("formula"))
    return d.groupBy("formula", "block").agg(F.sum(F.when(c("_gate"), c("_reward")).otherwise(0.0)).alias("metric"))


put("v06_overfitting", lambda s, d: _round(selection.backtest_overfitting(_blocks(s, d), 6).select("split", "formula", "train_metric", "test_metric", "test_rank", "overfit")), f"""WITH {_SLICE}, g AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS formula, CAST(floor(bar_idx * 6 / bars) AS BIGINT) AS block, sum(coalesce(rr, 0)) AS metric FROM (SELECT *, count(*) OVER () AS bars FROM y) WHERE {k} GROUP BY 2" for k in FLAGS) + """),
i(x) AS (SELECT unnest(range(6))), c3 AS (SELECT a.x AS a, b.x AS b, d.x AS d, row_number() OVER (ORDER BY a.x, b.x, d.x) - 1 AS split FROM i a JOIN i b ON a.x < b.x JOIN i d ON b.x < d.x),
s AS (SELECT split, formula, sum(CASE WHEN block IN (a, b, d) THEN metric ELSE 0 END) AS tr, sum(CASE WHEN block NOT IN (a, b, d) THEN metric ELSE 0 END) AS te FROM g, c3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY tr DESC, formula) AS a, row_number() OVER (PARTITION BY split ORDER BY te DESC, formula) AS t, count(*) OVER (PARTITION BY split) AS n FROM s)
SELECT CAST(split AS INTEGER) AS split, formula, round(tr, 4) AS train_metric, round(te, 4) AS test_metric, CAST(t AS INTEGER) AS test_rank, ln(greatest(1e-9, least(1 - 1e-9, (n - t + 1) / n)) / (1 - greatest(1e-9, least(1 - 1e-9, (n - t + 1) / n)))) <= 0 AS overfit FROM r WHERE a = 1""")
_SCENARIOS = [("baseline", 0.01), ("cost_1_5x", 0.015), ("cost_2x", 0.02), ("one_tick_worse", 0.03), ("two_ticks_worse", 0.05)]
put("v10_stress", lambda s, d: _round(selection.stress(held_one(s, d), SOME, "t", 0.01, False, Sizing(), 0.02), 6), f"""WITH RECURSIVE {took_sql(_HELD_ONE, [x for x in _CONDITIONS if x[0] != 'close>100.5 && open<=90'])}, sc(scenario, cost) AS (VALUES {', '.join(f"('{n}', {v})" for n, v in _SCENARIOS)}),
tc AS (SELECT combination, scenario, series_id, bar_idx, rr - cost AS rr FROM tk CROSS JOIN sc), {metrics_sql('tc', 'combination, scenario')}
SELECT scenario, combination AS formula, CAST(trades AS BIGINT) AS trades, round(total_return, 6) AS total_return, round(expectancy, 6) AS expectancy, round(max_drawdown, 6) AS max_drawdown, total_return > 0 AND expectancy > 0 AS passed FROM mt""")


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-3 combinations without a pair of fewer than 100 gated rows."""
    import itertools

    pairs = combine.evaluate_pairs(slice_frame(spark, sf_dir), PREDICATES, combine.trade_columns("t"))
    combos = spark.createDataFrame([(i, list(x)) for i, x in enumerate(itertools.combinations(sorted(FLAGS), 3))], "combo_id long, names array<string>")
    return combine.without_dead(combos, combine.dead_pairs(pairs, 100)).select(F.array_join("names", " && ").alias("combination"))


_FLAG_TABLE = "(VALUES " + ", ".join(f"('{k}')" for k in sorted(FLAGS)) + ") AS t(n)"
put("n09_subset_prune", _dead, f"""WITH {_SLICE}, pr AS (SELECT * FROM ({_PAIRS}) WHERE gated < 100 AND mask_hits > 0), f AS (SELECT n FROM {_FLAG_TABLE}),
c AS (SELECT a.n AS a, b.n AS b, d.n AS d FROM f a JOIN f b ON a.n < b.n JOIN f d ON b.n < d.n)
SELECT a || ' && ' || b || ' && ' || d AS combination FROM c WHERE NOT EXISTS (SELECT 1 FROM pr WHERE (name_a, name_b) IN ((a, b), (a, d), (b, d)))""")
put("a18_sample_quality", lambda s, d: depth_one(s, d).select("combination", metrics.quality_column(c("trades")).alias("quality")),
    f"WITH {_SLICE} SELECT combination, CASE WHEN trades >= 100 THEN 'excellent' WHEN trades >= 50 THEN 'good' WHEN trades >= 30 THEN 'fair' ELSE 'poor' END AS quality FROM ({_ONE})")
put("a15_percentiles", lambda s, d: _spread(s, d), f"""WITH {_SLICE}, s AS (SELECT array_agg(rr ORDER BY rr) AS r FROM y WHERE rr IS NOT NULL)
SELECT CAST(len(r) AS BIGINT) AS n, round(list_median(r), 4) AS median_rr, round(r[CAST(floor((len(r) - 1) * 0.05 + 0.5) AS INTEGER) + 1], 4) AS p05_rr, round(r[CAST(floor((len(r) - 1) * 0.95 + 0.5) AS INTEGER) + 1], 4) AS p95_rr FROM s""")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median and next-element percentiles of all returns."""
    return _round(metrics.spread_of(slice_frame(spark, sf_dir).where("not isnan(rr_t)"), "rr_t"))
