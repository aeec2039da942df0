"""Queries of the rules around the search: sources and sinks, ranges, audits, structural rules, labels without returns, windows, decisions, and the store."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recurrence as R
from ..functions.scalar import rounded, yes
from ..functions.window import whole
from ..operators import audit, bitmaps, catalog, combine, formula, selection, store, targets
from ..operators.catalog import Predicate, Range
from ..sources import bars as B
from .kernels import BARS, FLAG, FOLD_PART, HOUR, all_bars, kalman_sql, put
from .research import _CONDITIONS, _HELD, _HELD_ONE, _NEXT, _SLICE, CORE, FLAGS, FORMULAS, PREDICATES, _core_sql, _round, held_frame, held_one, metrics_sql, slice_frame, took_sql

c = F.col


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; on one machine without a shared folder, a temporary one."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp()
    return f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"


# sources and sinks
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars written as CSV and read as a raw export."""
    path = scratch(spark)
    B.bars_hour(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), *B.PRICES, c("volume").cast("double").alias("volume")).write.option("header", True).csv(path)
    return _round(B.read_raw_csv(spark, path).select("bar_idx", *B.PRICES, c("volume").cast("long").alias("volume")))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared bars: written, found equal and used again, refused with other content."""
    path, df = scratch(spark), all_bars(spark, sf_dir)
    steps = [B.write_prepared(df, path), B.write_prepared(df, path)]
    try:
        B.write_prepared(df.where("bar_idx > 0"), path)
    except ValueError:
        steps.append(True)
    return _round(B.read_prepared(spark, path).select("series_id", "bar_idx", *B.PRICES, "volume", F.lit(steps == [True, False, True]).cast("int").alias("guarded")))


_PRICES = ", ".join(f"round({x}, 4) AS {x}" for x in B.PRICES)
put("s01_raw_csv", _csv, f"WITH {HOUR} SELECT bar_idx, {_PRICES}, volume FROM b")
put("s06_prepared", _prepared, f"WITH {BARS} SELECT series_id, bar_idx, {_PRICES}, volume, 1 AS guarded FROM b")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations stored in two batches, one of them twice, then asked for the best; what the ledger says of the whole stands beside each."""
    setup = combine.prepare(held_one(spark, sf_dir), PREDICATES, combine.trade_columns("t"))
    s, n = store.ResultStore(spark, scratch(spark)), combine.total(len(PREDICATES), 2)
    for low, high in ((0, 7), (7, n), (7, n)):
        s.append(combine.evaluate(spark, setup, 2, 1, start=low, stop=high), "search", "data", "long", "t", high - low, low, "2024-01-31")
    processed, rows = s.summary()
    best = s.query(8, least=20, min_win_rate=40.0, direction="long", target="t", rank_by="total_return")
    return _round(best.select("combination", "trades", "total_return", "win_rate", *[F.lit(v).cast("long").alias(k) for k, v in (("processed", processed), ("stored", rows), ("next", s.offset("search", "data")), ("labels", s.combinations().count()))]))


put("s07_store", _stored, f"""WITH RECURSIVE {took_sql(_HELD_ONE, [(' && '.join(x), ' AND '.join(x)) for k in (1, 2) for x in itertools.combinations(sorted(FLAGS), k)])}, {metrics_sql()}
SELECT combination, CAST(trades AS BIGINT) AS trades, round(total_return, 4) AS total_return, round(win_rate, 4) AS win_rate, CAST(15 AS BIGINT) AS processed, (SELECT count(*) FROM mt) AS stored, CAST(15 AS BIGINT) AS next, (SELECT count(*) FROM mt) AS labels
FROM (SELECT * FROM mt WHERE trades >= 20 AND win_rate >= 40 ORDER BY mt.total_return DESC, combination LIMIT 8)""")


# targets
def _wicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next bar's color, with stops by the filtered wicks."""
    df = all_bars(spark, sf_dir).withColumn("wicks_diff", F.when(c("close") > c("open"), c("open") - c("low")).otherwise(c("high") - c("open")))

    def make(x):
        return {"kf_wicks_smooth": (yield from R.kalman_of(x, 0.01, 0.1))[0]}

    n = "wicks_kf"
    t = targets.next_bar_target(R.along_parts(df, make, ("wicks_diff",), FOLD_PART, kf_wicks_smooth="double"), n, tick=0.25)
    return t.where(c(f"{n}_exit_i_long").isNotNull()).select("series_id", "bar_idx", *[x for s in targets.SIDES for x in (c(f"{n}_{s}").cast("int").alias(f"hit_{s}"), rounded(f"rr_{n}_{s}", 4).alias(f"rr_{s}"), c(f"{n}_exit_i_{s}").alias(f"exit_{s}"))])


_WICKS = _NEXT.replace(_NEXT[_NEXT.index("y AS") : _NEXT.index("z AS")], f"ws AS (SELECT series_id, bar_idx AS i, wd FROM x), {kalman_sql('kw', 'ws', 'wd', 0.01, 0.1)}, y AS (SELECT x.*, kw.v AS m FROM x JOIN kw ON kw.series_id = x.series_id AND kw.i = x.bar_idx),\n").replace("2.3e-16", "2.220446049250313e-16")  # the filter falls through the bound where wicks are zero for long
put("t_wicks_kf", _wicks, f"""WITH RECURSIVE {BARS}, {_WICKS} SELECT series_id, bar_idx, {FLAG('cl > o AND l > o - d')} AS hit_long, round(CASE WHEN l <= o - d THEN -1 ELSE (cl - o) / d END, 4) AS rr_long, CASE WHEN d IS NOT NULL THEN j END AS exit_long,
{FLAG('cl < o AND h < o + d')} AS hit_short, round(CASE WHEN h >= o + d THEN -1 ELSE (o - cl) / d END, 4) AS rr_short, CASE WHEN d IS NOT NULL THEN j END AS exit_short FROM q WHERE d IS NOT NULL""")


# catalog
def _met(df: DataFrame, predicates: list[Predicate], *more: str) -> DataFrame:
    """How many bars of each series meet each predicate: one pass over the bars for all of them."""
    on = [F.when(p.column(), F.struct(F.lit(p.name).alias("name"), F.lit(p.base).alias("base"), F.lit(p.op).alias("op"), F.round(F.lit(p.threshold), 6).alias("threshold"), F.lit(p.rhs).alias("rhs"))) for p in predicates]
    return df.select("series_id", F.inline(F.array_compact(F.array(*on)))).groupBy("series_id", *more).agg(F.count("*").alias("bars"))


RANGES = {"close": Range((">", "<="), 20.0, 120.0, 20.0), "high": Range((">",)), "low": Range(("<", ">=")), "open": Range(("<",), None, 60.0, 15.0), "span": Range((">",), on=False), "rr_t": Range((">",), 0.0, 1.0, 0.5)}


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of ranges that are given, found in the data, or mixed, and the bars of each series that meet them."""
    df = all_bars(spark, sf_dir).withColumns({"span": c("high") - c("low"), "rr_t": c("close") / c("open")})
    return _met(df, catalog.threshold_predicates(df.where("series_id <> 'orders'"), RANGES, every=True), "base", "op", "threshold")


_STEPS = "(SELECT row_number() OVER () - 1 AS k, round(m * power(10, e), 5) AS s FROM (SELECT unnest(range(-5, 4)) AS e) CROSS JOIN (SELECT unnest([1, 2, 5]) AS m) ORDER BY e, m)"
_UNIT = lambda x: f"power(10, floor(log10(abs({x}))))"
put("s16_ranges", _ranged, f"""WITH {BARS}, r(base, ops, low, high, step) AS (VALUES ('close', ['>', '<='], 20.0, 120.0, 20.0), ('high', ['>'], NULL, NULL, NULL), ('low', ['<', '>='], NULL, NULL, NULL), ('open', ['<'], NULL, 60.0, 15.0)),
v AS (UNPIVOT (SELECT series_id, bar_idx, open, high, low, close FROM b) ON open, high, low, close INTO NAME base VALUE x),
p AS (SELECT base, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99 FROM v WHERE series_id <> 'orders' GROUP BY 1),
e AS (SELECT r.base, ops, step, coalesce(r.low, CASE WHEN p1 >= 5 * u1 THEN 5 * u1 WHEN p1 >= 2 * u1 THEN 2 * u1 ELSE u1 END) AS low, coalesce(r.high, CASE WHEN p99 <= u99 THEN u99 WHEN p99 <= 2 * u99 THEN 2 * u99 WHEN p99 <= 5 * u99 THEN 5 * u99 ELSE 10 * u99 END) AS high
  FROM r JOIN (SELECT *, {_UNIT('p1')} AS u1, {_UNIT('p99')} AS u99 FROM p) p ON p.base = r.base),
n AS (SELECT e.base, s, k, (floor((high - low) / s) + 1) * len(ops) - len(ops) AS n FROM e CROSS JOIN {_STEPS}),
st AS (SELECT e.base, ops, low, high, coalesce(step, (SELECT arg_min(s, (abs(n - 10), k)) FROM n WHERE n.base = e.base AND n BETWEEN 5 AND 15)) AS step FROM e),
th AS (SELECT base, unnest(ops) AS op, low, high, step FROM st), t AS (SELECT base, op, low, high, low + step * i AS threshold FROM th CROSS JOIN (SELECT unnest(range(0, 100)) AS i) WHERE low + step * i <= high + 2.220446049250313e-16)
SELECT series_id, t.base, op, round(threshold, 6) AS threshold, count(*) AS bars FROM t JOIN v ON v.base = t.base
WHERE CASE op WHEN '>' THEN x > threshold AND threshold < high WHEN '<' THEN x < threshold AND threshold > low WHEN '>=' THEN x >= threshold ELSE x <= threshold END GROUP BY ALL""")

put("c11_ordered_pairs", lambda s, d: _met(all_bars(s, d), catalog.ordered_pairs(list(B.PRICES)), "name", "base", "op", "rhs"),
    f"WITH {BARS}, x AS (" + " UNION ALL ".join(f"SELECT series_id, '{a}{o}{z}' AS name, '{a}' AS base, '{o}' AS op, '{z}' AS rhs FROM b WHERE {a} {o} {z}" for a, z in itertools.permutations(B.PRICES, 2) for o in "><") + ") SELECT *, count(*) AS bars FROM x GROUP BY ALL")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, thresholds and pairs with at least 200 eligible bars."""
    preds = [*PREDICATES, *[Predicate(f"close>{v}", "close", ">", float(v)) for v in range(0, 500, 50)], *catalog.pair_predicates(list(B.PRICES))]
    return spark.createDataFrame(catalog.sampling(preds, catalog.supports(slice_frame(spark, sf_dir), preds, c("t_eligible")), 200), "kind string, total long, dropped long, eligible long")


_SAMPLED = [("flag", k) for k in FLAGS] + [("threshold", f"close > {v}") for v in range(0, 500, 50)] + [("pair", f"{a} {o} {z}") for a, z in itertools.combinations(sorted(B.PRICES), 2) for o in "><"]
put("a25_sampling", _sampled, f"WITH {_SLICE}, h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({x} AND rr IS NOT NULL) AS n FROM y" for k, x in _SAMPLED) + ") SELECT kind, count(*) AS total, count(*) FILTER (n < 200) AS dropped, count(*) FILTER (n >= 200) AS eligible FROM h GROUP BY 1")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the columns of all bars part from short lists of flags, numbers and ranges."""
    green = yes(c("close") > c("open"))
    df = all_bars(spark, sf_dir).drop("ts").withColumns({"is_green": green, "green01": green.cast("int"), "busy": yes(c("volume") > 5), "flat01": green.cast("double"), "rr_any": c("close"), "body": F.when(c("close") != c("open"), c("close") - c("open")).otherwise(float("nan"))})
    ranges = {"close": Range((">",)), "open": Range((">",), on=False), "range": Range(("<",)), "rr_any": Range(("<",))}
    return _round(audit.audit(df, ["is_green", "volume", "gone", "close"], ["close", "open", "flat01", "green01", "lost"], ranges))


_LOOSE = {"body": "CASE WHEN close <> open THEN close - open END", "high": "high", "low": "low"}
_FOUND = [("flag not listed", "busy", "boolean"), ("flag not listed", "green01", "int"), ("flag missing", "gone", None), ("flag unfit", "close", "double"), ("number missing", "lost", None), ("number unfit", "flat01", "double"), ("number unfit", "green01", "int"), ("range off", "open", None), ("range of a target", "rr_any", None), ("range without number", "range", None), *[("number without range", x, None) for x in ("flat01", "green01", "lost")]]
_QUOTED = lambda x: "NULL" if x is None else f"'{x}'"
put("c14_audit", _audited, f"WITH {BARS}, x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, list({x} ORDER BY {x}) FILTER ({x} IS NOT NULL) AS v FROM b" for k, x in _LOOSE.items()) + """)
SELECT 'number not listed' AS finding, name, 'double' AS kind, round(v[CAST(floor(0.01 * (len(v) - 1)) AS INTEGER) + 1], 4) AS p1, round(v[CAST(floor(0.99 * (len(v) - 1)) AS INTEGER) + 1], 4) AS p99, round(v[1], 4) AS low, round(v[-1], 4) AS high FROM x
UNION ALL SELECT 'flag unfit', 'volume', 'bigint', NULL, NULL, NULL, NULL FROM b HAVING max(volume) > 1 """ + "".join(f" UNION ALL SELECT {', '.join(map(_QUOTED, f))}, NULL, NULL, NULL, NULL" for f in _FOUND))

# search
_BOUNDED = [Predicate("close>100", "close", ">", 100.0), Predicate("close>200", "close", ">", 200.0), Predicate("close<300", "close", "<", 300.0), Predicate("open>100", "open", ">", 100.0), *[Predicate(k, k) for k in ("is_green", "higher_high")]]


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one lower and one upper bound of a column, and always one of the flags."""
    setup = combine.prepare(held_one(spark, sf_dir), _BOUNDED, combine.trade_columns("t"), ["is_green"])
    return _round(combine.evaluate(spark, setup, 3, 1).select("combination", "mask_hits", "trades", *CORE))


def _bounded_sql() -> str:
    text = {p.name: f"{p.base} {p.op} {p.threshold}" if p.op else p.name for p in _BOUNDED}
    some = [x for k in (1, 2, 3) for x in itertools.combinations(text, k) if "is_green" in x and not {"close>100", "close>200"} <= set(x)]
    core = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in ("wins", "losses") else f"round({k}, 4) AS {k}" for k in CORE)
    return f"WITH RECURSIVE {took_sql(_HELD_ONE, [(' && '.join(x), ' AND '.join(text[i] for i in x)) for x in some])}, {metrics_sql()}, h AS (SELECT combination, count(*) AS mask_hits FROM p GROUP BY 1) SELECT mt.combination, CAST(mask_hits AS BIGINT) AS mask_hits, CAST(trades AS BIGINT) AS trades, {core} FROM mt JOIN h ON h.combination = mt.combination"


put("n07_bounds_and_required", _bounded, _bounded_sql())


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search where the frame has labels but no returns."""
    df = held_frame(spark, sf_dir).drop("rr_t")
    cols, _ = combine.found_columns(df, "t")
    out = combine.by_labels(bitmaps.evaluate(df, PREDICATES, cols, 2, 1, size=FOLD_PART))
    return _round(out.select("combination", "mask_hits", "trades", "label_hits", "wins", "losses", "win_rate", "total_return", "final_capital", "calmar_ratio"))


_LABELS = _HELD.replace("round(CASE WHEN span > 0 THEN nxt / span END, 6)", "CASE WHEN span > 0 THEN CAST(nxt > 0 AS INTEGER) END")
_TWO = [(" && ".join(x), " AND ".join(x)) for k in (1, 2) for x in itertools.combinations(sorted(FLAGS), k)]
put("a16_labels_only", _labelled, f"""WITH RECURSIVE {took_sql(_LABELS, _TWO)}, h AS (SELECT combination, count(*) AS mask_hits FROM p GROUP BY 1), g AS (SELECT combination, count(*) AS trades, CAST(sum(rr) AS BIGINT) AS hits FROM tk GROUP BY 1)
SELECT combination, mask_hits, trades, hits AS label_hits, hits AS wins, trades - hits AS losses, round(hits * 100.0 / trades, 4) AS win_rate, CAST(0 AS DOUBLE) AS total_return, CAST(0 AS DOUBLE) AS final_capital, CAST(0 AS DOUBLE) AS calmar_ratio FROM g JOIN h USING (combination)""")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations, those of under 150 trades as rows without metrics."""
    setup = combine.prepare(held_one(spark, sf_dir), PREDICATES, combine.trade_columns("t"))
    return _round(combine.evaluate(spark, setup, 3, 150, short=True).select("combination", "mask_hits", "trades", "wins", "losses", "win_rate", "total_return", "max_drawdown", "final_capital"))


_THREE = [(" && ".join(x), " AND ".join(x)) for k in (1, 2, 3) for x in itertools.combinations(sorted(FLAGS), k)]
put("a19_short_samples", _short, f"""WITH RECURSIVE {took_sql(_HELD_ONE, _THREE)}, {metrics_sql()}, h AS (SELECT combination, count(*) AS n FROM p GROUP BY 1), a(combination) AS (VALUES {', '.join(f"('{n}')" for n, _ in _THREE)})
SELECT a.combination, CAST(coalesce(n, 0) AS BIGINT) AS mask_hits, CAST(coalesce(trades, 0) AS BIGINT) AS trades, CAST(CASE WHEN trades >= 150 THEN wins ELSE 0 END AS BIGINT) AS wins, CAST(CASE WHEN trades >= 150 THEN losses ELSE coalesce(trades, 0) END AS BIGINT) AS losses,
""" + ", ".join(f"CASE WHEN trades >= 150 THEN round({x}, 4) ELSE 0 END AS {x}" for x in ("win_rate", "total_return", "max_drawdown", "final_capital")) + " FROM a LEFT JOIN mt ON mt.combination = a.combination LEFT JOIN h ON h.combination = a.combination")

# windows and selection
CUTOFF = "2024-01-15"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = all_bars(spark, sf_dir)
    pre, post = (formula.split_window(df, CUTOFF, side).select("series_id", "bar_idx", F.lit(side).alias("side")) for side in ("pre", "post"))
    return pre.unionByName(post)


def _purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars before the cutoff; trades that end after it or at no bar are out."""
    df = formula.purge(formula.split_window(held_frame(spark, sf_dir), CUTOFF, "pre"), "t")
    return df.select("series_id", "bar_idx", c("t").cast("int").alias("label"), c("t_eligible").cast("int").alias("eligible"), F.when(~F.isnan("rr_t"), rounded("rr_t", 4)).alias("rr"))


put("x04_split", _sides, f"WITH {BARS} SELECT series_id, bar_idx, CASE WHEN CAST(ts AS DATE) <= DATE '{CUTOFF}' THEN 'pre' ELSE 'post' END AS side FROM b")
put("x06_purge", _purged, f"""WITH {_HELD}, z AS (SELECT *, bar_idx + 3 <= max(bar_idx) OVER (PARTITION BY series_id) AS stays FROM y WHERE CAST(ts AS DATE) <= DATE '{CUTOFF}')
SELECT series_id, bar_idx, CAST(stays AND coalesce(span > 0 AND nxt > 0, false) AS INTEGER) AS label, CAST(stays AND rr IS NOT NULL AS INTEGER) AS eligible, CASE WHEN stays THEN round(rr, 4) END AS rr FROM z""")


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over the first half of each series, decided by the second."""
    df = held_frame(spark, sf_dir).withColumn("_first", c("bar_idx") * 2 < F.count("*").over(whole()))
    pre, post = (formula.rank_window(formula.evaluate_window(df.where(half), FORMULAS, "t", stacking=True), "calmar_ratio", "source_rank").withColumnRenamed("window_rank", "rank") for half in (c("_first"), ~c("_first")))
    out = selection.decide(pre, post, selection.Policy(pre_min_trades=200, post_min_trades=100, post_warn_below_trades=1_000, min_pre_frs=None))
    return _round(out.select("formula", "status", F.array_join("reasons", " ").alias("reasons"), F.array_join("warnings", " ").alias("warnings"), "pre_trades", "post_trades", "pre_total_return", "post_total_return"))


_SIDES = " UNION ALL ".join(f"SELECT '{n}' AS formula, {f.rank} AS source_rank, '{s}' AS side" for f, (n, _) in zip(FORMULAS, _CONDITIONS) for s in ("pre", "post"))
_REASONS = [("a.trades < 200", "pre_trades_below_floor"), ("a.r <= 0", "pre_total_r_below_floor"), ("a.e <= 0", "pre_expectancy_below_floor"), ("z.trades < 100", "post_trades_below_floor"), ("z.r <= 0", "post_total_r_below_floor"), ("z.e <= 0", "post_expectancy_below_floor"), ("a.r > 0 AND z.r / a.r < 0.25", "return_degradation_above_limit")]
put("v01_status", _halves, f"""WITH {_HELD}, f AS (SELECT *, CASE WHEN bar_idx * 2 < count(*) OVER (PARTITION BY series_id) THEN 'pre' ELSE 'post' END AS side FROM y),
tk AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{n}' AS combination, side, series_id, bar_idx, rr FROM f WHERE {x}" for n, x in _CONDITIONS)}) WHERE rr IS NOT NULL), {metrics_sql('tk', 'combination, side')},
g AS (SELECT s.*, coalesce(trades, 0) AS trades, coalesce(total_return, 0) AS r, coalesce(expectancy, 0) AS e, row_number() OVER (PARTITION BY s.side ORDER BY coalesce(calmar_ratio, 0) DESC, source_rank) AS rank FROM ({_SIDES}) s LEFT JOIN mt ON mt.combination = s.formula AND mt.side = s.side),
d AS (SELECT a.formula, a.rank, concat_ws(' ', {', '.join(f"CASE WHEN {x} THEN '{n}' END" for x, n in _REASONS)}) AS reasons, CASE WHEN z.trades >= 100 AND z.trades < 1000 THEN 'post_trades_below_warning' ELSE '' END AS warnings, a.trades AS pre_trades, z.trades AS post_trades, a.r AS pre, z.r AS post FROM g a JOIN g z ON z.formula = a.formula WHERE a.side = 'pre' AND z.side = 'post')
SELECT formula, CASE WHEN reasons <> '' THEN 'rejected' WHEN row_number() OVER (ORDER BY reasons <> '', rank, formula) = 1 THEN 'selected' ELSE 'passed' END AS status, reasons, warnings, CAST(pre_trades AS BIGINT) AS pre_trades, CAST(post_trades AS BIGINT) AS post_trades, round(pre, 4) AS pre_total_return, round(post, 4) AS post_total_return FROM d""")


def _sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios of the trades of each flag and series, 50 trials."""
    met = F.explode(F.array_compact(F.array(*[F.when(p.column(), F.lit(p.name)) for p in PREDICATES])))
    return _round(selection.sharpe_table(held_frame(spark, sf_dir).where(~F.isnan("rr_t")).select("series_id", "rr_t", met.alias("formula")), ["series_id", "formula"], "rr_t", 50))


def _phi(z: str) -> str:
    """The normal distribution by its power series; beyond 6 deviations 0 or 1."""
    term = f"CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(abs({z})) - n * ln(2) - lgamma(n + 1)) / (2 * n + 1)"
    return f"CASE WHEN {z} > 6 THEN 1 WHEN {z} < -6 THEN 0 WHEN {z} = 0 THEN 0.5 ELSE 0.5 + sign({z}) / sqrt(2 * pi()) * (SELECT sum({term}) FROM (SELECT unnest(range(0, 140)) AS n)) END"


_G, _Q = 0.5772156649015329, selection.normal_quantile
_BEYOND = (1 - _G) * _Q(1 - 1 / 50) + _G * _Q(1 - 1 / (50 * 2.718281828459045))
put("v07_sharpe", _sharpe, f"""WITH {_HELD}, p AS ({' UNION ALL '.join(f"SELECT series_id, '{k}' AS formula, rr FROM y WHERE {k} AND rr IS NOT NULL" for k in FLAGS)}), a AS (SELECT series_id, formula, count(*) AS n, avg(rr) AS m, stddev_samp(rr) AS s FROM p GROUP BY 1, 2),
g AS (SELECT a.series_id, a.formula, n, m / s AS sharpe, s, avg(power((rr - m) / s, 3)) AS skew, avg(power((rr - m) / s, 4)) AS kurtosis FROM a JOIN p ON p.series_id = a.series_id AND p.formula = a.formula WHERE n >= 4 AND s > 0 GROUP BY a.series_id, a.formula, n, m, s),
i AS (SELECT *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe AS inner_ FROM g), z AS (SELECT *, sharpe * sqrt(n - 1) / sqrt(inner_) AS z1, (sharpe - s / sqrt(n) * {_BEYOND!r}) * sqrt(n - 1) / sqrt(inner_) AS z2 FROM i)
SELECT a.series_id, a.formula, a.n, round(z.sharpe, 4) AS sharpe, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round({_phi('z1')}, 4) AS psr, round({_phi('z2')}, 4) AS dsr FROM a LEFT JOIN z ON z.series_id = a.series_id AND z.formula = a.formula""")
