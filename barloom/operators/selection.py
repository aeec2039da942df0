"""Selection of formulas by their results before and after a cutoff, overfit diagnostics, and stress scenarios."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .formula import Formula, evaluate_scenarios
from .metrics import Sizing


@dataclass(frozen=True)
class Policy:
    candidate_top_k: int = 1_000
    pre_min_trades: int = 100
    post_min_trades: int = 30
    post_warn_below_trades: int = 50
    pre_min_total_r: float = 0.0
    post_min_total_r: float = 0.0
    pre_min_expectancy: float = 0.0
    post_min_expectancy: float = 0.0
    max_drawdown_r: float | None = None
    min_pre_frs: float | None = 0.0
    max_return_degradation: float | None = 0.25
    max_single_trade_contribution: float | None = None
    max_formula_depth: int | None = None
    min_density_per_1000_bars: float | None = None


PRESETS = {"institutional": Policy(), "exploratory": Policy(pre_min_trades=30, post_min_trades=10, post_warn_below_trades=30, min_pre_frs=None, max_return_degradation=None)}


def _gate(when: Column, reason: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(reason))


def decide(pre: DataFrame, post: DataFrame, policy: Policy = Policy(), mode: str = "holdout-confirm") -> DataFrame:
    """The first candidates by ``pre_rank`` with their results after, the reasons against each, and its status.

    ``pre`` and ``post`` have formula, rank, trades, total_return, expectancy, max_drawdown, largest_win, density_per_1000, and depth and frs if wanted.
    ``holdout-confirm`` selects the first candidate without a reason, ``validation-rank`` the one of best rank after; ``off`` gives none."""
    p = pre.orderBy("rank", "formula").limit(policy.candidate_top_k).select([F.col(c).alias(f"pre_{c}") for c in pre.columns if c != "formula"] + ["formula"])
    d = p.join(post.select([F.col(c).alias(f"post_{c}") for c in post.columns if c != "formula"] + ["formula"]), "formula", "left")
    c, there, v = F.col, F.col("post_rank").isNotNull(), policy
    share = lambda s: F.when((c(f"{s}_total_return") > 0) & (c(f"{s}_largest_win") > 0), c(f"{s}_largest_win") / c(f"{s}_total_return"))
    ratio = F.when(c("pre_total_return") > 0, c("post_total_return") / c("pre_total_return"))
    gates = [
        _gate(c("pre_trades") < v.pre_min_trades, "pre_trades_below_floor"), _gate(c("pre_total_return") <= v.pre_min_total_r, "pre_total_r_below_floor"), _gate(c("pre_expectancy") <= v.pre_min_expectancy, "pre_expectancy_below_floor"),
        _gate(c("post_rank").isNull(), "missing_post_result"), _gate(there & (c("post_trades") < v.post_min_trades), "post_trades_below_floor"), _gate(there & (c("post_total_return") <= v.post_min_total_r), "post_total_r_below_floor"),
        _gate(there & (c("post_expectancy") <= v.post_min_expectancy), "post_expectancy_below_floor"),
    ]
    if v.max_drawdown_r is not None:
        gates += [_gate(c("pre_max_drawdown") > v.max_drawdown_r, "pre_drawdown_above_limit"), _gate(c("post_max_drawdown") > v.max_drawdown_r, "post_drawdown_above_limit")]
    if v.min_pre_frs is not None:  # a missing score counts as 0
        gates.append(_gate((F.coalesce("pre_frs", F.lit(0.0)) if "frs" in pre.columns else F.lit(0.0)) <= v.min_pre_frs, "pre_frs_below_floor"))
    if v.max_return_degradation is not None:
        gates.append(_gate(there & F.coalesce(ratio < v.max_return_degradation, c("pre_total_return") > 0), "return_degradation_above_limit"))
    if v.max_single_trade_contribution is not None:
        gates.append(_gate((F.coalesce(share("pre"), F.lit(0.0)) > v.max_single_trade_contribution) | (F.coalesce(share("post"), F.lit(0.0)) > v.max_single_trade_contribution), "single_trade_contribution_above_limit"))
    if v.max_formula_depth is not None and "depth" in pre.columns:
        gates.append(_gate(c("pre_depth") > v.max_formula_depth, "formula_depth_above_limit"))
    if v.min_density_per_1000_bars is not None:
        gates.append(_gate((c("pre_density_per_1000") < v.min_density_per_1000_bars) | (there & (c("post_density_per_1000") < v.min_density_per_1000_bars)), "density_below_floor"))
    d = d.withColumns({"reasons": F.array_compact(F.array(*gates)), "warnings": F.array_compact(F.array(_gate((c("post_trades") >= v.post_min_trades) & (c("post_trades") < v.post_warn_below_trades), "post_trades_below_warning"))), "post_to_pre_ratio": ratio})
    if mode == "off":
        return d.limit(0).withColumn("status", F.lit(None).cast("string"))
    order = F.col("pre_rank") if mode == "holdout-confirm" else F.col("post_rank")
    best = F.row_number().over(Window.orderBy(F.size("reasons") > 0, order, "formula"))  # over the candidates, which the policy bounds
    status = F.when(c("post_rank").isNull(), "missing_post_result").when(F.size("reasons") > 0, "rejected").when(c("_best") == 1, "selected").otherwise("passed")
    return d.withColumn("_best", best).withColumn("status", status).drop("_best")


def blocks(df: DataFrame, n: int) -> DataFrame:
    """``block`` from 0: n runs of days next to equal in length."""
    r = df.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    days = max((r["b"] - r["a"]).days, 1) + 1
    n = max(2, min(max(n, 2), days))
    day = F.datediff(F.to_date("ts"), F.lit(r["a"]))
    at = F.lit(0)
    for i in range(1, n):
        at = at + (day >= i * days // n).cast("int")
    return df.withColumn("block", at)


def splits(n: int, most: int = 10_000) -> list[tuple[int, ...]]:
    """The halves of n blocks to train on, in lexicographic order."""
    return [] if n < 4 or n % 2 else list(itertools.islice(itertools.combinations(range(n), n // 2), most))


#: formulas whose metrics of all splits are held at once
TILE = 256


def _tiles(batches: Iterator[pa.RecordBatch], train: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Formulas, and their metrics in training and in test by split: the product of block metrics with the indicator of the splits (blocks x splits), block after block, so that equal rows give equal sums."""
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            part = b.slice(at, TILE)
            m = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
            inside, outside = np.zeros((part.num_rows, train.shape[1])), np.zeros((part.num_rows, train.shape[1]))
            for k in range(len(train)):
                inside += np.where(train[k], m[:, k, None], 0.0)
                outside += np.where(train[k], 0.0, m[:, k, None])
            yield part.column(0).to_pylist(), inside, outside


def backtest_overfitting(metrics: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """A row for each split of ``metrics`` (formula, block, metric): the formula best in training (ties: the smaller text), its rank in the test blocks, and whether its logit is 0 or less. The mean of ``overfit`` is the probability of overfitting.

    Formulas meet the splits in tiles, twice: once for the best of each split, once to count those that beat it in test. What leaves a task is a row for each split, ``most`` at most."""
    spark, plan = metrics.sparkSession, splits(n, most)
    schema = "split int, formula string, train_metric double, test_metric double, test_rank int, test_percentile double, logit double, overfit boolean"
    train = np.array([[k in s for s in plan] for k in range(n)], bool).reshape(n, len(plan))
    block = F.create_map(*[x for k in range(n) for x in (F.lit(k), F.lit(0.0))])
    held = F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), F.col("metric"))))
    sums = metrics.groupBy("formula", "block").agg(F.coalesce(F.sum(F.col("metric").cast("double")), F.lit(0.0)).alias("metric"))
    rows = settle(sums.groupBy("formula").agg(held.alias("held")).select("formula", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.element_at(block, k))).alias("m")))  # a row for each formula, read by both passes

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[float, str, float] | None] = [None] * len(plan)
        for names, inside, outside in _tiles(batches, train):
            order = np.argsort(np.array(names, object), kind="stable")
            first = order[np.argmax(inside[order], axis=0)]  # of equal ones the smallest text
            for j, i in enumerate(first.tolist()):
                new = (inside[i, j], names[i], outside[i, j])
                old = found[j]
                if old is None or new[0] > old[0] or (new[0] == old[0] and new[1] < old[1]):
                    found[j] = new
        got = [(j, f[1], float(f[0]), float(f[2])) for j, f in enumerate(found) if f is not None]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), (pa.int32(), pa.string(), pa.float64(), pa.float64()))], ["split", "formula", "train_metric", "test_metric"])

    tops = rows.mapInArrow(best, "split int, formula string, train_metric double, test_metric double")
    chosen = tops.groupBy("split").agg(F.max("train_metric").alias("train_metric")).join(tops, ["split", "train_metric"]).groupBy("split", "train_metric").agg(F.min(F.struct("formula", "test_metric")).alias("x")).orderBy("split").collect()  # a row for each split
    if not chosen:
        return spark.createDataFrame([], schema)
    names, level = [r.x.formula for r in chosen], np.array([r.x.test_metric for r in chosen])

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(len(names), np.int64), 0
        for own, _, outside in _tiles(batches, train):
            count += (outside > level).sum(axis=0)
            for i, j in zip(*np.nonzero(outside == level)):
                count[j] += own[i] < names[j]
            seen += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(count), pa.array(np.full(len(names), seen))], ["split", "above", "seen"])

    ranks = rows.mapInArrow(beaten, "split int, above long, seen long").groupBy("split").agg((F.sum("above") + 1).cast("int").alias("test_rank"), F.sum("seen").alias("candidates"))
    tops = spark.createDataFrame([(r.split, r.x.formula, r.train_metric, r.x.test_metric) for r in chosen], "split int, formula string, train_metric double, test_metric double")
    pct = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), (F.col("candidates") - F.col("test_rank") + 1) / F.col("candidates")))
    r = tops.join(ranks, "split").withColumn("test_percentile", pct).withColumn("logit", F.log(F.col("test_percentile") / (1 - F.col("test_percentile"))))
    return r.select("split", "formula", "train_metric", "test_metric", "test_rank", "test_percentile", "logit", (F.col("logit") <= 0).alias("overfit"))


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_quantile(p: float) -> float | None:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else None


def _moments(x: list[float]) -> tuple[float, float, float, float] | None:
    """Mean, sample deviation, and third and fourth moments standardised by it."""
    x = [v for v in x if math.isfinite(v)]
    n = len(x)
    if n < 4:
        return None
    mean = sum(x) / n
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1))
    if std <= 0:
        return None
    return mean, std, sum(((v - mean) / std) ** 3 for v in x) / n, sum(((v - mean) / std) ** 4 for v in x) / n


def probabilistic_sharpe(x: list[float], benchmark: float = 0.0) -> float | None:
    """The probability that the true Sharpe ratio exceeds a benchmark."""
    m = _moments(x)
    if m is None:
        return None
    sharpe = m[0] / m[1]
    inner = 1.0 - m[2] * sharpe + (m[3] - 1.0) / 4.0 * sharpe * sharpe
    return normal_cdf((sharpe - benchmark) * math.sqrt(len(x) - 1) / math.sqrt(inner)) if inner > 0 else None


def deflated_sharpe(x: list[float], trials: int) -> float | None:
    """The same against the largest Sharpe ratio that so many trials of nothing would give."""
    m = _moments(x)
    if m is None:
        return None
    gamma, n = 0.5772156649015329, max(trials, 1)
    first, second = normal_quantile(1 - 1 / n) or 0.0, normal_quantile(1 - 1 / (n * math.e)) or 0.0
    return probabilistic_sharpe(x, m[1] / math.sqrt(len(x)) * ((1 - gamma) * first + gamma * second))


def sharpe_table(df: DataFrame, keys: list[str], value: str, trials: int = 1) -> DataFrame:
    """keys, n, sharpe, skew, kurtosis, psr and dsr of the finite values of each group, as ``probabilistic_sharpe`` and ``deflated_sharpe`` give for one: one aggregate with partial sums, whatever the size of a group.
    Fewer than 4 values, or equal ones, have n only."""
    gamma, tried = 0.5772156649015329, max(trials, 1)
    beyond = (1 - gamma) * (normal_quantile(1 - 1 / tried) or 0.0) + gamma * (normal_quantile(1 - 1 / (tried * math.e)) or 0.0)
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"), F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"))
    ok, of = (F.col("n") >= 4) & (F.col("_std") > 0), (F.col("n") - 1) / F.col("n")  # moments by the sample's deviation, not the population's
    g = g.withColumns({"sharpe": F.when(ok, F.col("_mean") / F.col("_std")), "skew": F.when(ok, F.col("_skew") * F.pow(of, 1.5)), "kurtosis": F.when(ok, (F.col("_kurt") + 3.0) * of * of)})
    inner = 1.0 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1.0) / 4.0 * F.col("sharpe") * F.col("sharpe")
    z = lambda benchmark: F.when(inner > 0, (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(inner))

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda a: normal_cdf(a) if a == a else None)

    g = g.withColumns({"_z": z(F.lit(0.0)), "_d": z(F.col("_std") / F.sqrt("n") * beyond)})
    return g.select(*keys, "n", "sharpe", "skew", "kurtosis", cdf("_z").alias("psr"), cdf("_d").alias("dsr"))


def gate_status(pbo: float | None, psr: float | None, dsr: float | None, warnings: list[str], max_pbo: float = 0.2, min_psr: float = 0.95, min_dsr: float = 0.95) -> str:
    if (pbo is not None and pbo > max_pbo) or (psr is not None and psr < min_psr) or (dsr is not None and dsr < min_dsr):
        return "fail"
    if pbo is None and psr is None and dsr is None:
        return "unavailable"
    return "warning" if warnings else "pass"


def effective_trials(explicit: int | None = None, processed: int | None = None, stored: int | None = None, exported: int | None = None, formulas: int = 0) -> tuple[int, str, str | None]:
    """The number of trials, where it comes from, and a warning if it is not the full count."""
    if explicit:
        return explicit, "explicit", None
    if processed:
        return processed, "processed_combinations", None
    for n, name in ((stored, "stored_results"), (exported, "exported_formulas"), (formulas, "evaluated_formula_count")):
        if n:
            return n, name, f"effective trials from {name} may understate the search"
    return 1, "none", "no count of trials is known"


def stress(post: DataFrame, formulas: list[Formula], target: str, cost: float, stacking: bool = False, sizing: Sizing | None = None, tick_cost_r: float | None = None, min_total_r: float = 0.0, min_expectancy: float = 0.0) -> DataFrame:
    """Each formula under worse conditions: 1.5 and 2 times the cost, one and two ticks worse if their cost is known, half the contracts."""
    sizing = sizing or Sizing()
    scenarios = [("baseline", cost, sizing), ("cost_1_5x", cost * 1.5, sizing), ("cost_2x", cost * 2.0, sizing)]
    if tick_cost_r is not None:
        scenarios += [("one_tick_worse", cost + tick_cost_r, sizing), ("two_ticks_worse", cost + 2 * tick_cost_r, sizing)]
    if sizing.contracts and sizing.most:
        scenarios.append(("half_contracts", cost, replace(sizing, most=max(1, sizing.most // 2))))
    out = evaluate_scenarios(post, formulas, target, scenarios, stacking).select("scenario", "formula", "trades", "total_return", "expectancy", "max_drawdown")
    return out.withColumn("passed", (F.col("total_return") > min_total_r) & (F.col("expectancy") > min_expectancy))
