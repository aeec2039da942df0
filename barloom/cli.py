"""Command line: prepare, comb, eval-formulas, select, results, protocol."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, bitmaps, catalog, combine, formula, forward, metrics, protocol, selection, store, targets
from .operators.features import features
from .operators.metrics import Sizing, asset
from .sources import bars as B
from .sources import files


def session(name: str = "barloom") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom")
    sub = p.add_subparsers(dest="command", required=True)

    def trade(q: argparse.ArgumentParser) -> None:
        q.add_argument("--target", default="2x_atr_tp_atr_stop")
        q.add_argument("--direction", choices=("long", "short", "both"), default="long")
        q.add_argument("--cost-r", type=float, default=0.0)
        q.add_argument("--stacking", action="store_true")
        q.add_argument("--capital", type=float, default=100_000.0)
        q.add_argument("--risk-pct", type=float, default=1.0)
        q.add_argument("--years", type=float)
        q.add_argument("--asset")
        q.add_argument("--position-sizing", choices=("fractional", "contracts"), default="fractional")
        q.add_argument("--cost-dollar", type=float, default=0.0, help="of a trade, when sizing in contracts")
        q.add_argument("--stop-distance-column", help="by default the risk of a barrier target")
        q.add_argument("--stop-distance-unit", choices=("points", "ticks"), default="points")
        q.add_argument("--min-contracts", type=int, default=1)
        q.add_argument("--max-contracts", type=int)

    q = sub.add_parser("prepare", help="features and target of a CSV of bars, as Parquet")
    q.add_argument("csv")
    q.add_argument("out")
    q.add_argument("--ack-new", action="store_true")
    q.add_argument("--date-end")
    trade(q)
    q = sub.add_parser("comb", help="search combinations of a prepared data set")
    q.add_argument("data")
    q.add_argument("out")
    q.add_argument("--max-depth", type=int, default=2)
    q.add_argument("--min-samples", type=int, default=30)
    q.add_argument("--max-drawdown", type=float, default=30.0)
    q.add_argument("--start")
    q.add_argument("--end")
    q.add_argument("--require", action="append", default=[])
    q.add_argument("--no-pairs", action="store_true")
    q.add_argument("--feature-ranges", help="JSON of operators, min, max, increment and enabled for each feature, in place of the standard ranges")
    q.add_argument("--reward-column", help="by default the target's own, the side's or a usual name; without any only labels count")
    q.add_argument("--audit", action="store_true", help="say where columns and the lists of features part")
    q.add_argument("--batch", type=int, default=1_000_000)
    q.add_argument("--max-combos", type=int)
    q.add_argument("--top-k", type=int, default=20)
    q.add_argument("--force", action="store_true")
    q.add_argument("--dry-run", action="store_true")
    q.add_argument("--subset-prune", action="store_true", help="leave out what holds a pair with too few trades; the pairs are kept with the store")
    trade(q)

    def ahead(q: argparse.ArgumentParser) -> None:
        q.add_argument("--embargo", type=int, default=0)
        q.add_argument("--purge", action="store_true")
        q.add_argument("--preset", choices=sorted(selection.PRESETS), default="institutional")
        q.add_argument("--rank-by", choices=forward.RANKS, default="frs")
        q.add_argument("--frs-scope", choices=forward.SCOPES, default="window")
        q.add_argument("--pbo-blocks", type=int, default=8)
        q.add_argument("--trials", type=int, help="combinations that were tried before these were chosen")
        q.add_argument("--tick-cost-r", type=float)
        q.add_argument("--registry")
        trade(q)

    q = sub.add_parser("eval-formulas", help="evaluate formulas before and after a cutoff")
    q.add_argument("data")
    q.add_argument("formulas")
    q.add_argument("--cutoff", required=True)
    q.add_argument("--out")
    q.add_argument("--run-folder", help="write all reports, a closing record and checksums")
    q.add_argument("--mode", choices=("off", "holdout-confirm", "validation-rank"), default="holdout-confirm")
    q.add_argument("--protocol")
    q.add_argument("--stage", choices=protocol.STAGES, default="validation")
    ahead(q)
    q = sub.add_parser("select", help="choose a formula on the validation window, try it once on the lockbox, explain a run")
    step = q.add_subparsers(dest="step", required=True)
    for name in ("validate", "lockbox"):
        q = step.add_parser(name)
        q.add_argument("data")
        q.add_argument("formulas")
        q.add_argument("folder")
        q.add_argument("--protocol", required=True)
        if name == "validate":
            q.add_argument("--mode", choices=("holdout-confirm", "validation-rank"), default="holdout-confirm")
        else:
            q.add_argument("--acknowledge-rerun", action="store_true")
        ahead(q)
    step.add_parser("explain").add_argument("folder")
    q = sub.add_parser("results", help="query a result store")
    q.add_argument("store")
    q.add_argument("--k", type=int, default=20)
    q.add_argument("--min-trades", type=int, default=0)
    q.add_argument("--max-drawdown", type=float)
    q.add_argument("--min-calmar", type=float)
    q.add_argument("--min-win-rate", type=float)
    q.add_argument("--direction")
    q.add_argument("--target")
    q.add_argument("--rank-by", choices=store.RANKS, default="calmar_ratio")
    q.add_argument("--export")
    q.add_argument("--protocol")
    q = sub.add_parser("protocol", help="init, validate or explain a protocol")
    q.add_argument("action", choices=("init", "validate", "explain"))
    q.add_argument("path")
    q.add_argument("--dataset-id", default="data")
    q.add_argument("--target", default="2x_atr_tp_atr_stop")
    q.add_argument("--direction", default="long")
    q.add_argument("--discovery-end")
    q.add_argument("--validation-end")
    return p


def _sizing(a: argparse.Namespace, df: DataFrame) -> Sizing:
    years = a.years
    if years is None:
        r = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        years = max((r["b"] - r["a"]).total_seconds() / (365.25 * 86400), 1e-9) if r["a"] else 1.0
    return Sizing(capital=a.capital, risk_pct=a.risk_pct, years=years, margin=asset(a.asset)[4] if a.asset else None, contracts=a.position_sizing == "contracts", least=a.min_contracts, most=a.max_contracts)


def _dollars(a: argparse.Namespace, df: DataFrame) -> dict[str, Column]:
    """Options of ``trade_columns`` for sizing in contracts: dollars that a contract risks in each trade, the stop distance times the value of a point or tick, and those that a trade costs."""
    if a.position_sizing != "contracts":
        return {}
    column = a.stop_distance_column or f"{a.target}_risk"
    if column not in df.columns:
        raise ValueError(f"sizing in contracts needs the column {column}, the distance of the stop")
    if not a.asset:
        raise ValueError("sizing in contracts needs an asset, for the value of a point")
    risk = metrics.risk_dollars(F.col(f"`{column}`"), asset(a.asset)[a.stop_distance_unit == "ticks"])
    return {"cost_dollar": F.lit(a.cost_dollar), "risk_dollar": risk}


def identity(a: argparse.Namespace, catalog_sha: str) -> str:
    """What a stored search depends on, but for depth, batch and limits: deeper searches extend it."""
    keys = ("target", "direction", "cost_r", "stacking", "capital", "risk_pct", "years", "asset", "position_sizing", "cost_dollar", "stop_distance_column", "stop_distance_unit", "min_contracts", "max_contracts", "min_samples", "max_drawdown", "start", "end", "require", "no_pairs")
    return hashlib.sha256(json.dumps([catalog_sha, *[getattr(a, k) for k in keys], *([a.reward_column] if a.reward_column else [])]).encode()).hexdigest()


def prepare(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.target == "tribar_4h_2atr" and "_4h" not in os.path.basename(a.csv):
        raise ValueError("this target takes 4-hour bars: the file name must contain _4h")
    more = {} if a.target == "tribar_4h_2atr" else {"direction": a.direction, **({"tick": asset(a.asset)[2]} if a.asset else {}), **({"date_end": a.date_end} if a.date_end and a.target in targets.BARRIERS else {})}
    df = targets.attach(features(B.read_raw_csv(spark, a.csv)), a.target, **more)
    written = B.write_prepared(df, a.out, a.ack_new)
    if B.read_prepared(spark, a.out).isEmpty():
        files.delete(a.out)
        raise ValueError("no bar has all features: the file is too short or lacks prices")
    print("written" if written else "reused", a.out)


def comb(a: argparse.Namespace, spark: SparkSession) -> None:
    df = B.date_range(B.read_prepared(spark, a.data), a.start, a.end)
    cols, returns = combine.found_columns(df, a.target, a.direction, a.reward_column, a.stacking, cost=a.cost_r, **_dollars(a, df))
    if a.audit:
        for r in audit.audit(df).collect():  # a row for each column at most
            print(*[x for x in r if x is not None])
    preds = catalog.build(df, not a.no_pairs, catalog.ranges_of(files.read(a.feature_ranges)) if a.feature_ranges else catalog.RANGES)
    held = catalog.supports(df, preds, cols["_gate"])
    for kind, every, dropped, eligible in catalog.sampling(preds, held, a.min_samples):
        print(f"{kind}s: {every}, {dropped} below {a.min_samples} samples, {eligible} eligible")
    preds = catalog.prune(df, preds, a.min_samples, cols["_gate"], held)
    n = combine.total(len(preds), a.max_depth)
    print(f"{len(preds)} predicates, {n} combinations" + ("" if returns else "; no returns: only labels count"))
    if a.dry_run:
        return
    sizing, sha, s = _sizing(a, df), str(B.content_hash(df)), store.ResultStore(spark, a.out)
    own = identity(a, catalog.catalog_hash(preds))
    s.check(own, sha, a.force)
    # masks of one series that fit are broadcast, others stream through the tasks in blocks
    setup = combine.prepare(df, preds, cols, a.require) if not a.subset_prune and combine.fits(df, preds) else None
    dead, names = None, [p.name for p in preds]
    if a.subset_prune:
        dead = s.dead(own, sha, names)
        if dead is None:
            dead = combine.dead_matrix(names, combine.evaluate_pairs(df, preds, cols), a.min_samples)
            s.keep_dead(own, sha, names, dead)
    at, stop = s.offset(own, sha), min(n, a.max_combos or n)
    last = df.agg(F.max(F.to_date("ts")).cast("string")).first()[0]
    while at < stop:
        end = min(at + a.batch, stop)
        if setup:
            found = combine.evaluate(spark, setup, a.max_depth, a.min_samples, a.max_drawdown, a.stacking, sizing, at, end)
        else:
            found = bitmaps.evaluate(df, preds, cols, a.max_depth, a.min_samples, a.max_drawdown, a.stacking, sizing, at, end, a.require, dead=dead)
        s.append(found if returns else combine.by_labels(found), own, sha, a.direction, a.target, end - at, at, last)
        at = end
    if s.results() is not None and not returns:
        s.query(a.top_k, rank_by="total_return", target=a.target, direction=a.direction).show(a.top_k, truncate=False)
    elif s.results() is not None:
        s.recompute(df, cols, preds, a.top_k, a.stacking, sizing, target=a.target, direction=a.direction).orderBy(F.desc("calmar_ratio"), "combination").show(a.top_k, truncate=False)


def _protocol(path: str | None) -> protocol.Protocol | None:
    return protocol.Protocol.from_json(files.read(path)) if path else None


def _ahead(a: argparse.Namespace, df: DataFrame, formulas: list[formula.Formula], cutoff: str, mode: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a forward evaluation and its record."""
    plan = forward.Plan(a.target, cutoff, mode, selection.PRESETS[a.preset], a.rank_by, frs_scope=a.frs_scope, cost=a.cost_r, stacking=a.stacking, embargo=a.embargo, purge=a.purge, pbo_blocks=a.pbo_blocks, trials=a.trials, tick_cost_r=a.tick_cost_r, options=_dollars(a, df))
    halves = [formula.split_window(df, cutoff, side) for side in ("pre", "post")]
    tables = forward.evaluate(df, formulas, plan, (_sizing(a, halves[0]), _sizing(a, halves[1])))
    return tables, forward.verdict(tables, formulas, plan)


def eval_formulas(a: argparse.Namespace, spark: SparkSession) -> None:
    p = _protocol(a.protocol)
    formulas = formula.parse_lines(protocol.bound_formulas(a.formulas, p, a.target, a.direction))
    df = B.read_prepared(spark, a.data)
    if p:
        protocol.check_stage(a.stage, formulas, a.mode)
        df = protocol.visible(df, p, a.stage)
    if a.run_folder:
        forward.refuse_finished(a.run_folder)
    tables, record = _ahead(a, df, formulas, a.cutoff, a.mode)
    if a.run_folder:
        forward.write_run(a.run_folder, tables, record | {"run": "eval-formulas", "cutoff": a.cutoff, "protocol_sha256": p.digest() if p else None}, a.registry)
    for name in ("pre", "post", "selection"):
        if a.out:
            tables[name].coalesce(1).write.mode("overwrite").json(f"{a.out}/{name}")  # reports: a row for each formula
        elif not a.run_folder:
            print(name)
            tables[name].show(20, truncate=40)
    print(f"status {record['status']}, gate {record['gate']}, embargo {record['embargo']}, purged {record['purged']}")


def select(a: argparse.Namespace, spark: SparkSession) -> None:
    """validate: candidates of the discovery window meet the validation window; lockbox: one formula meets the last window, once; explain: a finished run in words."""
    if a.step == "explain":
        return print(forward.explain(a.folder, spark))
    p, lock = _protocol(a.protocol), a.step == "lockbox"
    mode = "off" if lock else a.mode
    formulas = formula.parse_lines(protocol.bound_formulas(a.formulas, p, a.target, a.direction))
    stage = "lockbox" if lock else "validation"
    protocol.check_stage(stage, formulas, mode)
    forward.refuse_finished(a.folder)
    cutoff = (p.validation if lock else p.discovery).end
    if not cutoff:
        raise ValueError("the protocol has no end of the window before")
    if lock and not a.registry:
        raise ValueError("the lockbox needs a registry, which counts its attempts")
    df = protocol.visible(B.read_prepared(spark, a.data), p, stage)
    attempt = protocol.Registry(a.registry).lockbox_attempt(p.digest(), formulas[0].expression, a.acknowledge_rerun) if lock else None
    tables, record = _ahead(a, df, formulas, cutoff, mode)
    forward.write_run(a.folder, tables, record | {"run": f"select {a.step}", "cutoff": cutoff, "protocol_sha256": p.digest(), "formula": formulas[0].expression if lock else None, "attempt": attempt}, a.registry)
    print(f"status {record['status']}, gate {record['gate']}, selected {record['selected'] or 'none'}")
    return None


def results(a: argparse.Namespace, spark: SparkSession) -> None:
    df = store.ResultStore(spark, a.store).query(a.k, a.min_trades, a.max_drawdown, a.min_calmar, a.min_win_rate, a.direction, a.target, a.rank_by)
    if not a.export:
        return df.show(a.k, truncate=False)
    end = store.ResultStore(spark, a.store).source_end(a.target, a.direction)
    protocol.export_formulas(a.export, [r.combination for r in df.collect()], _protocol(a.protocol), {"target": a.target, "direction": a.direction, "rank_by": a.rank_by, "exported_at": datetime.now(timezone.utc).isoformat(), "source_end": end})
    return None


def protocol_command(a: argparse.Namespace) -> None:
    if a.action == "init":
        day = lambda d: (datetime.fromisoformat(d).date().toordinal() + 1)
        after = lambda d: datetime.fromordinal(day(d)).date().isoformat()
        p = protocol.Protocol(a.dataset_id, a.target, a.direction, protocol.Span(None, a.discovery_end), protocol.Span(after(a.discovery_end), a.validation_end), protocol.Span(after(a.validation_end), None))
        p.validate()
        files.write(a.path, p.to_json())
        return
    p = _protocol(a.path)
    p.validate()
    print("valid" if a.action == "validate" else f"{p.to_json()}\nsha256 {p.digest()}")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "protocol":
        session()
        protocol_command(a)
        return 0
    {"prepare": prepare, "comb": comb, "eval-formulas": eval_formulas, "select": select, "results": results}[a.command](a, session())
    return 0


if __name__ == "__main__":
    sys.exit(main())
