"""Formulas: conjunctions of clauses as text, and their evaluation over windows of a prepared frame."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import yes
from ..functions.window import whole
from .combine import trade_columns
from .metrics import Sizing, capital_path, full_metrics
from .trades import choose, composes, following, reached, scored

#: The order in which operators are looked for.
OPERATORS = ("<=", ">=", "==", "!=", "<", ">", "=")


@dataclass(frozen=True)
class Clause:
    left: str
    op: str = ""
    right: str = ""


@dataclass(frozen=True)
class Formula:
    rank: int
    expression: str
    clauses: tuple[Clause, ...]


def parse(text: str, rank: int = 1) -> Formula:
    """Clauses joined by &&; without an operator a clause is a flag, and an empty clause is passed over. There is no OR and no parenthesis."""
    if "||" in text or "(" in text or ")" in text:
        raise ValueError(f"only && joins clauses: {text}")
    out = []
    for part in text.split("&&"):
        part = part.strip()
        if not part:
            continue
        op = next((o for o in OPERATORS if o in part), "")
        if not op:
            out.append(Clause(part))
            continue
        left, right = (x.strip() for x in part.split(op, 1))
        if not left or not right:
            raise ValueError(f"incomplete clause: {part}")
        out.append(Clause(left, "==" if op == "=" else op, right))
    if not out:
        raise ValueError(f"no clause in: {text}")
    return Formula(rank, " && ".join(f"{c.left}{c.op}{c.right}" for c in out), tuple(out))


def parse_lines(text: str) -> list[Formula]:
    """Lines ``Rank N: formula`` or formulas alone, which take their ordinal; blank lines and # comments are passed over."""
    out: list[Formula] = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.match(r"(?i)rank\s+(\d+)\s*:\s*(.*)$", line)
        out.append(parse(m[2], int(m[1])) if m else parse(line, len(out) + 1))
    if not out:
        raise ValueError("no formula")
    return out


def condition(formula: Formula, columns: list[str]) -> Column:
    """The formula as a column; clauses with a missing or non-finite side are false."""
    out = F.lit(True)
    for c in formula.clauses:
        if c.left not in columns:
            raise ValueError(f"unknown column {c.left}")
        a = F.col(f"`{c.left}`")
        if not c.op:
            out = out & yes(a.cast("double") > 0.5)
            continue
        if c.right in columns:
            b = F.col(f"`{c.right}`").cast("double")
        else:
            b = F.lit(float(c.right))
        a = a.cast("double")
        fine = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
        out = out & yes(fine & {"<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b, "<": a < b, ">": a > b}[c.op])
    return out


def split_window(df: DataFrame, cutoff: str, side: str) -> DataFrame:
    """``pre``: dates up to the cutoff; ``post``: later ones."""
    day = F.to_date("ts")
    return df.where(day <= F.lit(cutoff).cast("date")) if side == "pre" else df.where(day > F.lit(cutoff).cast("date"))


def purge(df: DataFrame, target: str) -> DataFrame:
    """Take trades that end outside the window, or whose end is unknown, out of it: label false, reward NaN, not eligible."""
    last = F.max("bar_idx").over(whole())
    exit_ = F.col(f"`{target}_exit_i`")
    out = yes((exit_ >= F.min("bar_idx").over(whole())) & (exit_ <= last))
    return df.withColumn("_in", out).withColumns({
        target: F.col(f"`{target}`") & F.col("_in"), f"rr_{target}": F.when(F.col("_in"), F.col(f"`rr_{target}`")).otherwise(F.lit(float("nan"))), f"{target}_eligible": F.col(f"`{target}_eligible`") & F.col("_in"),
    }).drop("_in")


METRICS = """wins long, losses long, win_rate double, total_return double, max_drawdown double, final_capital double, total_return_pct double, cagr_pct double, max_drawdown_pct_equity double, calmar_ratio double, expectancy double,
profit_factor double, avg_winning_rr double, avg_losing_rr double, win_loss_ratio double, largest_win double, largest_loss double, ulcer_index double, pain_ratio double, max_consecutive_wins long, avg_win_streak double,
max_consecutive_losses long, avg_loss_streak double, median_rr double, p05_rr double, p95_rr double, sample_quality string, total_return_dollar double, max_drawdown_dollar double, expectancy_dollar double, sharpe_equity double, sortino_equity double""".replace("\n", " ")


def hits(df: DataFrame, formulas: list[Formula], target: str, cost: float = 0.0, keep: list[str] | None = None, **options) -> DataFrame:
    """A row for each bar and formula that it meets, with the trade columns and those of ``keep``: one pass over the bars for all formulas."""
    cols = trade_columns(target, cost, **options)
    met = F.array_compact(F.array(*[F.when(condition(f, df.columns), F.lit(i)) for i, f in enumerate(formulas)]))
    return df.select("series_id", "bar_idx", "ts", *(keep or []), *[c.alias(k) for k, c in cols.items()], F.explode(met).alias("formula_id"))


#: bars of all series up to which the trades of a formula are one group, for there can be no more of them
MOST_BARS = 1_000_000


def large(df: DataFrame, part: int | None = None) -> bool:
    """Whether the trades of a formula are dealt out by parts of the bars; ``part`` sets the size from which on they are."""
    return df.count() > (part or MOST_BARS)


def trades_of(met: DataFrame, keys: list[str], stacking: bool, part: int | None = None, parted: bool = False) -> DataFrame:
    """The hits that become trades: all that pass the gate if they may overlap, else for each of ``keys`` and each series the first, then always the first at or after the last one's exit. ``parted``: over parts of ``part`` bars."""
    rows = met.where("_gate").drop("_gate")
    if stacking:
        return rows
    if parted:
        return choose(rows, keys, part)

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by("bar_idx")
        return t.take(reached(following(t)[2], 0))

    return rows.groupBy(*keys, "series_id").applyInArrow(one, rows.schema)


def score_trades(rows: DataFrame, keys: list[str], sizing: Sizing | list[Sizing], part: int | None = None, parted: bool = False) -> DataFrame:
    """keys, trades, label_hits and METRICS; trades count in the order of their series and bars. A list of sizings goes by the key ``scenario``. ``parted``: merged from parts of ``part`` bars; sizing in contracts does not merge."""
    if parted and composes(sizing):
        return scored(rows, keys, sizing, part)
    kinds = dict(x.split() for x in METRICS.split(", "))
    own = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}
    types = {**{k: arrow[t] for k, t in own.items()}, "trades": pa.int64(), "label_hits": pa.int64(), **{k: arrow[t] for k, t in kinds.items()}}

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("series_id", "ascending"), ("bar_idx", "ascending")])
        number = lambda c: t.column(c).fill_null(np.nan).to_numpy()
        row = {k: t.column(k)[0].as_py() for k in keys}
        m = full_metrics(number("_reward"), sizing if isinstance(sizing, Sizing) else sizing[row["scenario"]], number("_risk"))
        row |= {"trades": t.num_rows, "label_hits": int(np.count_nonzero(t.column("_label").to_numpy())), **m}
        return pa.table({k: pa.array([row[k]], kind) for k, kind in types.items()})

    schema = ", ".join([*[f"{k} {t}" for k, t in own.items()], "trades long", "label_hits long"]) + ", " + METRICS
    return rows.groupBy(*keys).applyInArrow(run, schema)


def evaluate_groups(df: DataFrame, formulas: list[Formula], target: str, cost: float = 0.0, stacking: bool = False, sizing: Sizing | None = None, by: dict[str, Column] | None = None, part: int | None = None, **options) -> DataFrame:
    """Full metrics of each formula in each group of bars that ``by`` makes (all bars are one without it), in one pass: source_rank, formula, the columns of ``by``, mask_hits, trades, label_hits, METRICS, bars, density_per_1000, recall_pct.
    A formula without a hit in a group has zeros there."""
    by = by or {}
    df = df.withColumns(by)
    met = hits(df, formulas, target, cost, keep=[*by], **options).drop("ts")
    keys, parted = ["formula_id", *by], large(df, part)
    scores = score_trades(trades_of(met, keys, stacking, part, parted), keys, sizing or Sizing(), part, parted).join(met.groupBy(*keys).agg(F.count("*").alias("mask_hits")), keys, "full")
    named = F.array(*[F.struct(F.lit(i).alias("formula_id"), F.lit(f.rank).alias("source_rank"), F.lit(f.expression).alias("formula")) for i, f in enumerate(formulas)])
    bars = df.groupBy(*by).agg(F.count("*").alias("bars"))
    base = bars.select(*by, "bars", F.explode(named).alias("f")).select(*by, "bars", "f.*")
    kinds = dict(x.split() for x in METRICS.split(", "))
    fill = {k: "poor" if t == "string" else 0 for k, t in kinds.items()}
    out = base.join(scores, keys, "left").na.fill({**fill, "mask_hits": 0, "trades": 0, "label_hits": 0})
    n = F.col("bars")
    out = out.withColumns({"density_per_1000": F.when(n > 0, F.col("trades") * 1000.0 / n).otherwise(0.0), "recall_pct": F.when(n > 0, F.col("mask_hits") * 100.0 / n).otherwise(0.0)})
    return out.select("source_rank", "formula", *by, "mask_hits", "trades", "label_hits", *kinds, "bars", "density_per_1000", "recall_pct")


def evaluate_window(df: DataFrame, formulas: list[Formula], target: str, cost: float = 0.0, stacking: bool = False, sizing: Sizing | None = None, **options) -> DataFrame:
    """Full metrics of each formula over all bars of a window."""
    return evaluate_groups(df, formulas, target, cost, stacking, sizing, **options)


def evaluate_scenarios(df: DataFrame, formulas: list[Formula], target: str, scenarios: list[tuple[str, float, Sizing]], stacking: bool = False) -> DataFrame:
    """The same under several costs and sizings (name, cost, sizing), over trades that are chosen once: scenario, formula, trades and METRICS."""
    met = hits(df, formulas, target).drop("ts")
    costs = F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(float(c)).alias("cost")) for i, (_, c, _) in enumerate(scenarios)])
    parted = large(df)
    spread = trades_of(met, ["formula_id"], stacking, parted=parted).withColumn("_s", F.explode(costs)).withColumns({"scenario": F.col("_s.scenario"), "_reward": F.col("_reward") - F.col("_s.cost")}).drop("_s")
    scores = score_trades(spread, ["scenario", "formula_id"], [z for _, _, z in scenarios], parted=parted)
    named = [(k, name, i, f.rank, f.expression) for k, (name, _, _) in enumerate(scenarios) for i, f in enumerate(formulas)]
    base = df.sparkSession.createDataFrame(named, "id int, scenario_name string, formula_id int, source_rank int, formula string").withColumnRenamed("id", "scenario")
    kinds = dict(x.split() for x in METRICS.split(", "))
    fill = {k: "poor" if t == "string" else 0 for k, t in kinds.items()}
    out = base.join(scores, ["scenario", "formula_id"], "left").na.fill({**fill, "trades": 0, "label_hits": 0})
    return out.drop("scenario", "formula_id").withColumnRenamed("scenario_name", "scenario")


def rank_window(results: DataFrame, by: str, ties: str) -> DataFrame:
    """Number the formulas from the best; a window over the formulas given, which are few."""
    return results.withColumn("window_rank", F.row_number().over(Window.orderBy(F.desc(by), ties, "formula")))


def by_year(df: DataFrame, formulas: list[Formula], target: str, **options) -> DataFrame:
    """Full metrics for each formula and calendar year."""
    return evaluate_groups(df, formulas, target, by={"year": F.year("ts")}, **options)


def frs(yearly: DataFrame, least: int = 30, alpha: float = 2.0, beta: float = 2.0, gamma: float = 1.0, delta: float = 1.0) -> DataFrame:
    """Forward robustness score of each formula over its windows (columns total_return, max_drawdown, trades)."""
    eps = 1e-9
    y = yearly.withColumn("_dd", F.greatest("max_drawdown", F.lit(0.0))).withColumn("_calmar", F.col("total_return") / (F.col("_dd") + eps))
    g = y.groupBy("formula").agg(
        F.count("*").alias("k"), F.avg((F.col("total_return") > 0).cast("double")).alias("p"), F.median("_calmar").alias("c"), F.min("_dd").alias("dd_min"), F.median("_dd").alias("dd_median"), F.avg("_dd").alias("dd_mean"),
        F.max("_dd").alias("dd_max"), F.min("total_return").alias("r_min"), F.median("total_return").alias("r_median"), F.max("total_return").alias("r_max"), F.avg("total_return").alias("mu_r"), F.stddev_pop("total_return").alias("sigma_r"),
        F.median(F.col("trades").cast("double")).alias("n_med"),
    )
    mad = y.join(g.select("formula", "r_median"), "formula").groupBy("formula").agg(F.median(F.abs(F.col("total_return") - F.col("r_median"))).alias("mad"))
    g = g.join(mad, "formula").withColumns({
        "c_plus": F.greatest("c", F.lit(0.0)), "tail_penalty": 1.0 / (1.0 + F.col("dd_max") / (F.col("dd_median") + eps)), "stability": 1.0 / (1.0 + F.col("mad") / (F.abs("r_median") + eps)),
        "trade_score": F.lit(1.0) if least == 0 else F.least(F.col("n_med") / least, F.lit(1.0)),
    })
    return g.withColumn("frs", F.pow("p", F.lit(alpha)) * F.col("c_plus") * F.pow("tail_penalty", F.lit(beta)) * F.pow("stability", F.lit(gamma)) * F.pow("trade_score", F.lit(delta))).drop("mad")


def buy_and_hold(df: DataFrame) -> DataFrame:
    """series_id, total_return_pct, cagr_pct, max_drawdown_pct, calmar of holding from the first to the last close."""
    run = Window.partitionBy("series_id").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col("close").isNotNull()).withColumn("_peak", F.max("close").over(run))
    g = d.groupBy("series_id").agg(F.min_by("close", "bar_idx").alias("a"), F.max_by("close", "bar_idx").alias("b"), F.max((F.col("_peak") - F.col("close")) / F.col("_peak") * 100.0).alias("max_drawdown_pct"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / (365.25 * 86400)).alias("years"))
    g = g.withColumns({"total_return_pct": (F.col("b") / F.col("a") - 1.0) * 100.0, "cagr_pct": (F.pow(F.col("b") / F.col("a"), 1.0 / F.greatest("years", F.lit(1e-9))) - 1.0) * 100.0})
    return g.select("series_id", "total_return_pct", "cagr_pct", "max_drawdown_pct", F.when(F.col("max_drawdown_pct") > 0, F.col("cagr_pct") / F.col("max_drawdown_pct")).otherwise(0.0).alias("calmar"))


def equity_curve(df: DataFrame, formulas: list[Formula], target: str, cost: float = 0.0, stacking: bool = False, sizing: Sizing | None = None) -> DataFrame:
    """formula_id, trade_no, series_id, bar_idx, rr, equity_r, capital: a row for each trade of each formula, in the order of series and bars."""
    sizing = sizing or Sizing()

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("series_id", "ascending"), ("bar_idx", "ascending")])
        number = lambda c: t.column(c).fill_null(np.nan).to_numpy()
        rr = number("_reward")
        no = pa.array(np.arange(t.num_rows), pa.int64())
        return pa.table({"formula_id": t.column("formula_id"), "trade_no": no, "series_id": t.column("series_id"), "bar_idx": t.column("bar_idx"), "rr": pa.array(rr), "equity_r": pa.array(np.cumsum(rr)), "capital": pa.array(capital_path(rr, sizing, number("_risk"))[1:])})

    met = hits(df, formulas, target, cost).drop("ts")
    return trades_of(met, ["formula_id"], stacking, parted=large(df)).groupBy("formula_id").applyInArrow(run, "formula_id int, trade_no long, series_id string, bar_idx long, rr double, equity_r double, capital double")
