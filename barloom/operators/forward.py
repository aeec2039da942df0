"""Forward evaluation of formulas: windows around a cutoff, scores over years, selection, overfit and stress diagnostics, and their reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import formula, protocol, selection
from .metrics import Sizing

SCOPES = ("window", "pre", "post", "all")
RANKS = ("frs", "calmar_ratio", "total_return")


@dataclass
class Plan:
    """What a forward evaluation does with its formulas."""

    target: str
    cutoff: str
    mode: str = "holdout-confirm"
    policy: selection.Policy = field(default_factory=selection.Policy)
    rank_by: str = "frs"
    frs: bool = True
    frs_scope: str = "window"
    frs_least: int = 30
    cost: float = 0.0
    stacking: bool = False
    embargo: int = 0
    purge: bool = False
    pbo_blocks: int = 8
    trials: int | None = None
    tick_cost_r: float | None = None
    #: trades that ``evaluate`` took out because they end in another window
    purged: int = 0
    #: columns of dollar costs and dollar risk of each trade, for sizing in contracts
    options: dict[str, Column] = field(default_factory=dict)


def windows(df: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame, int]:
    """The bars before and after the cutoff, and how many trades were taken out because they end elsewhere."""
    from ..sources.bars import embargo

    pre, post = formula.split_window(df, plan.cutoff, "pre"), formula.split_window(df, plan.cutoff, "post")
    post = embargo(post, plan.embargo) if plan.embargo else post
    if not plan.purge:
        return pre, post, 0
    eligible = F.count_if(F.col(f"`{plan.target}_eligible`"))
    before = sum(w.agg(eligible).first()[0] for w in (pre, post))
    pre, post = formula.purge(pre, plan.target), formula.purge(post, plan.target)
    return pre, post, before - sum(w.agg(eligible).first()[0] for w in (pre, post))


def evaluate(df: DataFrame, formulas: list[formula.Formula], plan: Plan, sizing: tuple[Sizing, Sizing]) -> dict[str, DataFrame]:
    """Tables pre, post, frs, years, selection, overfit and stress. ``sizing``: before and after the cutoff."""
    if plan.rank_by not in RANKS or plan.frs_scope not in SCOPES:
        raise ValueError(f"rank by one of {', '.join(RANKS)}, with scores over one of {', '.join(SCOPES)}")
    if plan.rank_by == "frs" and not plan.frs:
        raise ValueError("ranking by frs needs its scores")
    missing = [c for c in (plan.target, f"rr_{plan.target}", f"{plan.target}_eligible", f"{plan.target}_exit_i", "ts", "bar_idx", "series_id") if c not in df.columns]
    if missing:
        raise ValueError(f"the data lack columns: {', '.join(missing)}")
    pre, post, plan.purged = windows(df, plan)
    common = {"cost": plan.cost, "stacking": plan.stacking, **plan.options}
    scopes = {"window": {"pre": pre, "post": post}, "pre": {"pre": pre}, "post": {"post": post}, "all": {"all": df}}[plan.frs_scope] if plan.frs else {}
    # what follows is small (rows for formulas, years or splits) and read several times
    years = {name: formula.by_year(w, formulas, plan.target, sizing=sizing[name == "post"], **common).cache() for name, w in scopes.items()}
    scores = {name: formula.frs(y, plan.frs_least).cache() for name, y in years.items()}
    out: dict[str, DataFrame] = {}
    for k, (name, w) in enumerate((("pre", pre), ("post", post))):
        r = formula.evaluate_window(w, formulas, plan.target, sizing=sizing[k], **common).withColumn("depth", F.size(F.split("formula", " && ")))
        own = scores.get(name, scores.get("all"))
        r = r.join(own.select("formula", "frs"), "formula", "left").na.fill({"frs": 0.0}) if own is not None else r
        by = plan.rank_by if plan.rank_by in r.columns else "calmar_ratio"
        if name == "post":  # ties go to the better rank before
            r = r.join(out["pre"].select("formula", F.col("rank").alias("_before")), "formula", "left")
        out[name] = formula.rank_window(r, by, "_before" if name == "post" else "source_rank").withColumnRenamed("window_rank", "rank").drop("_before").cache()
    for name, t in (("years", years), ("frs", scores)):
        parts = [x.withColumn("window", F.lit(w)) for w, x in t.items()]
        if parts:
            out[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out["selection"] = selection.decide(out["pre"], out["post"], plan.policy, plan.mode).cache()
    n = plan.pbo_blocks
    blocks = formula.evaluate_groups(selection.blocks(pre, n), formulas, plan.target, sizing=sizing[0], by={"block": F.col("block")}, **common)
    out["overfit"] = selection.backtest_overfitting(blocks.select("formula", "block", F.col("total_return").alias("metric")), n).cache()
    out["stress"] = selection.stress(post, formulas, plan.target, plan.cost, plan.stacking, sizing[1], plan.tick_cost_r).cache()
    out["equity"] = formula.equity_curve(post, formulas, plan.target, plan.cost, plan.stacking, sizing[1]).cache()
    return out


def verdict(tables: dict[str, DataFrame], formulas: list[formula.Formula], plan: Plan) -> dict:
    """What was selected and why not, the probabilities of overfitting and of a true Sharpe ratio, and their gate: a small record."""
    rows = tables["selection"].select("formula", "status", "reasons", "warnings").collect()  # candidates, which the policy bounds
    chosen = next((r.formula for r in rows if r.status == "selected"), formulas[0].expression if len(formulas) == 1 and plan.mode == "off" else None)
    o = tables["overfit"].agg(F.avg(F.col("overfit").cast("double")), F.count("*")).first()
    pbo = float(o[0]) if o[1] else None
    psr = dsr = None
    trials, source, warning = selection.effective_trials(plan.trials, formulas=len(formulas))
    if chosen is not None:
        i = next(k for k, f in enumerate(formulas) if f.expression == chosen)
        rr = [r.rr for r in tables["equity"].where(F.col("formula_id") == i).select("rr").collect()]  # trades of one formula
        psr, dsr = selection.probabilistic_sharpe(rr), selection.deflated_sharpe(rr, trials)
    stressed = [r.scenario for r in tables["stress"].where((F.col("formula") == chosen) & ~F.col("passed")).select("scenario").collect()] if chosen else []
    return {
        "selected": chosen, "status": "selected" if chosen else "no_selection", "pbo": pbo, "psr": psr, "dsr": dsr, "trials": trials, "trials_source": source, "embargo": plan.embargo, "purged": plan.purged, "failed_scenarios": sorted(stressed),
        "gate": selection.gate_status(pbo, psr, dsr, [warning] if warning else []), "candidates": [{"formula": r.formula, "status": r.status, "reasons": list(r.reasons), "warnings": list(r.warnings)} for r in rows],
    }


def refuse_finished(folder: str) -> None:
    if files.exists(f"{folder}/closeout.json"):
        raise ValueError(f"{folder} holds a finished run")


def write_run(folder: str, tables: dict[str, DataFrame], record: dict, registry: str | None = None) -> dict:
    """Reports as JSON and CSV, ``closeout.json``, and ``checksums.json`` over them; the record goes to the registry. The folder, of any file system, must hold no finished run."""
    refuse_finished(folder)
    for name, t in tables.items():
        if name != "equity":  # trades stay in as many files as there are tasks; the rest are reports of a row for each formula, year or split
            t = t.coalesce(1)
        t.write.mode("overwrite").json(f"{folder}/{name}")
        flat = t.select(*[F.concat_ws(";", c).alias(c) if k.startswith("array") else F.col(f"`{c}`") for c, k in t.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")
    files.write(f"{folder}/closeout.json", json.dumps(record, indent=2, sort_keys=True))
    spark = next(iter(tables.values())).sparkSession
    files.write(f"{folder}/checksums.json", json.dumps(files.digests(spark, folder), indent=2, sort_keys=True))
    if registry:
        protocol.Registry(registry).add({"folder": folder, **{k: record.get(k) for k in ("run", "protocol_sha256", "formula", "selected", "status", "gate")}})
    return record


def explain(folder: str, spark: SparkSession | None = None) -> str:
    """A finished run in words; its files must be what they were when it ended."""
    sums = json.loads(files.read(f"{folder}/checksums.json"))
    try:
        now = {k: v for k, v in files.digests(spark or SparkSession.getActiveSession(), folder).items() if k != "checksums.json"}
    except Exception as e:
        if "ChecksumException" not in str(e):
            raise
        raise ValueError(f"files of {folder} have changed: one does not match what its file system wrote") from e
    if now != sums:
        raise ValueError(f"files of {folder} have changed: {', '.join(sorted(k for k in now.keys() | sums.keys() if now.get(k) != sums.get(k)))}")
    r = json.loads(files.read(f"{folder}/closeout.json"))
    lines = [f"status {r['status']}, gate {r['gate']}", f"selected: {r['selected'] or 'none'}", f"pbo {r['pbo']}, psr {r['psr']}, dsr {r['dsr']} of {r['trials']} trials ({r['trials_source']})"]
    return "\n".join([*lines, *[f"{c['status']}: {c['formula']}" + (f" ({', '.join(c['reasons'])})" if c["reasons"] else "") for c in r["candidates"]]])
