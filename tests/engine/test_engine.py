"""The engine against plain re-implementations, hand-made fixtures and exhaustive enumeration."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.functions import recurrence as R
from barloom.operators import backtest, catalog, combine, formula, metrics, protocol, selection, store, targets
from barloom.operators.features import BOOLEANS, CONTINUOUS, PAIRED, features
from barloom.sources import bars as B

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(7)


def random_bars(n, holes=False):
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    o = np.concatenate(([100.0], c[:-1])) + rng.normal(0, 0.3, n)
    h, low = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    if holes:
        for x in (o, h, low, c):
            x[rng.integers(0, n, n // 40)] = np.nan
    return o, h, low, c


def frame(spark, o, h, low, c, **more):
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(hours=i), *[None if math.isnan(v) else float(v) for v in (o[i], h[i], low[i], c[i])], 1, *[x[i] for x in more.values()]) for i in range(len(o))]
    kinds = "".join(f", {k} {'boolean' if isinstance(x[0], bool) else 'double'}" for k, x in more.items())
    return spark.createDataFrame(rows, "series_id string, bar_idx long, ts timestamp, open double, high double, low double, close double, volume long" + kinds)


def test_recurrences_equal_their_loops():
    x = rng.normal(50, 5, 777)
    y = np.full(777, np.nan)
    y[8] = x[:9].mean()
    for i in range(9, 777):
        y[i] = 0.2 * x[i] + 0.8 * y[i - 1]
    np.testing.assert_allclose(R.ema(x, 9), y, rtol=1e-12)
    holes = x.copy()
    holes[[0, 5, 100, 101]] = np.nan
    y, prev = np.full(777, np.nan), None
    for i, v in enumerate(holes):
        if np.isfinite(v):
            prev = v if prev is None else v / 14 + prev * 13 / 14
        y[i] = np.nan if prev is None else prev
    np.testing.assert_allclose(R.rma(holes, 14), y, rtol=1e-12)
    level, p, f, inn = holes[1], 1.0, [], []
    for v in holes:
        q = p + 0.01
        if np.isfinite(v):
            k = q / (q + 0.1)
            inn.append(v - level)
            level, p = level + k * (v - level), (1 - k) * q
        else:
            inn.append(0.0)
            p = q
        f.append(level)
    got = R.kalman(holes, 0.01, 0.1)
    np.testing.assert_allclose(got[0], f, rtol=1e-10)
    np.testing.assert_allclose(got[1], inn, rtol=1e-8, atol=1e-9)
    assert len(R.ema(x[:5], 9)) == 5 and np.isnan(R.ema(x[:5], 9)).all() and len(R.rma(x[:0], 3)) == 0 and len(R.kalman(x[:0], 1, 1)[0]) == 0


def slow_barrier(o, h, low, c, span, spec, long, tick, cutoff):
    """The rules of a barrier target, bar by bar."""
    n, out = len(o), {}
    sign = 1 if long else -1
    for i in range(n - 1):
        end = min(cutoff, n - 1) if cutoff is not None and i <= min(cutoff, n - 1) else n - 1
        if i >= end or not all(map(math.isfinite, (o[i], h[i], low[i], c[i]))) or ((spec.stop != "bar" or not spec.by_risk) and not math.isfinite(span[i])):
            continue
        if sign * (c[i] - o[i]) <= 2.220446049250313e-16:
            continue
        far, by_atr = (low[i] if long else h[i]), c[i] - sign * span[i]
        if spec.stop == "bar":
            stop = far
        elif spec.stop == "atr":
            stop = by_atr
        elif spec.stop == "wide":
            stop = min(far, by_atr) if long else max(far, by_atr)
        else:
            ok = [x for x in (far, by_atr) if sign * (c[i] - x) > 0]
            if not ok:
                continue
            stop = max(ok) if long else min(ok)
        if tick:
            stop = (math.floor if long else math.ceil)(stop / tick) * tick
        risk = sign * (c[i] - stop)
        if risk <= 1e-9:
            continue
        take = c[i] + sign * spec.reward * (risk if spec.by_risk else span[i])
        if tick:
            take = (math.ceil if long else math.floor)(take / tick) * tick
        if spec.least_rr is not None and sign * (take - c[i]) / risk <= spec.least_rr:
            continue
        for j in range(i + 1, end + 1):
            if not (math.isfinite(h[j]) and math.isfinite(low[j])):
                continue
            if math.isfinite(o[j]) and sign * (o[j] - stop) <= 0:
                out[i] = (False, sign * (o[j] - c[i]) / risk, j)
            elif math.isfinite(o[j]) and sign * (o[j] - take) >= 0:
                out[i] = (True, sign * (o[j] - c[i]) / risk, j)
            elif (low[j] <= stop) if long else (h[j] >= stop):
                out[i] = (False, -1.0, j)
            elif (h[j] >= take) if long else (low[j] <= take):
                out[i] = (True, sign * (take - c[i]) / risk, j)
            else:
                continue
            break
        if i not in out and cutoff is not None and i <= cutoff and math.isfinite(c[end]):
            out[i] = (False, sign * (c[end] - c[i]) / risk, end)
    return out


@pytest.mark.parametrize("name", sorted(targets.BARRIERS))
def test_barriers_equal_the_plain_rules(name):
    o, h, low, c = random_bars(400, holes=True)
    span = np.abs(rng.normal(1.5, 0.3, 400))
    span[::37] = np.nan
    for long, tick, cutoff in itertools.product((True, False), (None, 0.25), (None, 150, 10_000)):
        want = slow_barrier(o, h, low, c, span, targets.BARRIERS[name], long, tick, cutoff)
        got = targets.resolve(o, h, low, c, span, targets.BARRIERS[name], long, tick, cutoff)
        assert {i for i in range(400) if np.isfinite(got["rr"][i])} == set(want)
        for i, (hit, rr, j) in want.items():
            assert got["hit"][i] == hit and abs(got["rr"][i] - rr) < 1e-9 and got["exit"][i] == j


def test_gap_and_double_touch():
    o, h, low, c = (np.array(x, float) for x in ([10, 8, 11], [11, 9, 12], [9, 7, 10], [11, 8.5, 11]))
    spec = targets.BARRIERS["highlow_1r"]
    r = targets.resolve(o, h, low, c, np.ones(3), spec, True)
    assert r["rr"][0] == (8 - 11) / 2 and not r["hit"][0] and r["exit"][0] == 1
    o[1], h[1], low[1] = 11, 14, 8
    r = targets.resolve(o, h, low, c, np.ones(3), spec, True)
    assert r["rr"][0] == -1.0 and not r["hit"][0]


def test_feature_frame(spark):
    df = B.bars_hour(spark, "/root/testdata/sf0.01")
    whole, cut = features(df, trim=False), features(df)
    assert set(BOOLEANS + CONTINUOUS + PAIRED) <= set(cut.columns)
    assert whole.count() == df.count() and 0 < cut.count() < df.count()
    rows = cut.orderBy("bar_idx").collect()
    assert [r.bar_idx for r in rows] == list(range(len(rows))) and all(r[x] is not None for r in rows for x in CONTINUOUS)
    got = whole.orderBy("bar_idx").toPandas()
    c = got["close"].to_numpy()
    np.testing.assert_allclose(got["9ema"].to_numpy()[8:], R.ema(c, 9)[8:])
    assert (got["is_tribar"] == (got["is_tribar_green"] | got["is_tribar_red"])).all()
    assert (got["bullish_bar_sequence"] == (got["higher_high"] & got["higher_low"])).all()
    aligned = (got["kf_smooth"] > got["9ema"]) & (got["9ema"] > got["200sma"])
    assert (got["kf_ema_aligned"] == aligned).all()


def test_short_series_skip_dead_columns(spark):
    o, h, low, c = random_bars(120)
    assert features(frame(spark, o, h, low, c)).count() > 0  # the 200-bar mean is never defined and does not count


def test_unrank_is_a_bijection():
    for n in range(1, 9):
        for k in range(1, n + 1):
            want = list(itertools.combinations(range(n), k))
            assert [tuple(x) for x in combine.unrank(np.arange(len(want)), n, k).tolist()] == want
            assert [combine.rank(list(x), n) for x in want] == list(range(len(want)))
    assert combine.total(10, 3) == 10 + 45 + 120
    assert combine.locate(0, 10, 3) == (1, 0) and combine.locate(10, 10, 3) == (2, 0) and combine.locate(174, 10, 3) == (3, 119)
    with pytest.raises(IndexError):
        combine.locate(175, 10, 3)
    assert combine.unrank(np.array([math.comb(500, 4) - 1]), 500, 4).tolist() == [[496, 497, 498, 499]]


def test_evaluation_equals_enumeration(spark):
    o, h, low, c = random_bars(150)
    flags = {f"f{i}": (rng.random(150) < 0.5).tolist() for i in range(6)}
    rr = rng.normal(0.1, 1, 150).tolist()
    df = frame(spark, o, h, low, c, **flags, t=(rng.random(150) < 0.5).tolist(), rr_t=rr, t_eligible=(rng.random(150) < 0.8).tolist()).withColumn("t_exit_i", B.F.col("bar_idx") + B.F.col("bar_idx") % 5)
    rows = df.orderBy("bar_idx").collect()
    preds = [catalog.Predicate(f, f) for f in flags]
    setup = combine.prepare(df, preds, combine.trade_columns("t"))
    for stacking in (True, False):
        got = {r.combination: r for r in combine.evaluate(spark, setup, 3, 1, stacking=stacking).collect()}
        number = 0
        for k in (1, 2, 3):
            for names in itertools.combinations(flags, k):
                hits = [r for r in rows if all(r[x] for x in names)]
                took, free = [], -1
                for r in hits:
                    if r.t_eligible and (stacking or r.bar_idx >= free):
                        took.append(r)
                        free = r.t_exit_i if r.t_exit_i >= r.bar_idx else r.bar_idx + 1
                g = got.get(" && ".join(names))
                if took:
                    assert (g.mask_hits, g.trades, g.label_hits, int(g.combo_id)) == (len(hits), len(took), sum(r.t for r in took), number)
                    assert abs(g.total_return - sum(r.rr_t for r in took)) < 1e-9
                number += 1
    whole = combine.evaluate(spark, setup, 3, 1, stacking=True)
    parts = combine.evaluate(spark, setup, 3, 1, stacking=True, stop=17).unionAll(combine.evaluate(spark, setup, 3, 1, stacking=True, start=17))
    assert sorted(r.combo_id for r in whole.collect()) == sorted(r.combo_id for r in parts.collect())


def test_structural_rules(spark):
    o, h, low, c = random_bars(40)
    df = frame(spark, o, h, low, c, t=[True] * 40, rr_t=[1.0] * 40, t_eligible=[True] * 40).withColumn("t_exit_i", B.F.col("bar_idx"))
    p = [catalog.Predicate("close>1", "close", ">", 1.0), catalog.Predicate("close>2", "close", ">", 2.0), catalog.Predicate("close<900", "close", "<", 900.0), catalog.Predicate("close>open", "close", ">", None, "open")]
    got = {r.combination for r in combine.evaluate(spark, combine.prepare(df, p, combine.trade_columns("t")), 2, 0).collect()}
    assert "close>1 && close>2" not in got and "close>1 && close<900" in got
    got = {r.combination for r in combine.evaluate(spark, combine.prepare(df, p, combine.trade_columns("t"), ["close<900"]), 2, 0).collect()}
    assert got == {"close<900", "close>1 && close<900", "close>2 && close<900", "close<900 && close>open"}
    with pytest.raises(ValueError):
        combine.prepare(df, p, combine.trade_columns("t"), ["nope"])


def test_metrics_by_hand():
    rr = np.array([1.0, -0.5, 2.0, 0.0, -1.0, -1.0, 0.5])
    m = metrics.full_metrics(rr, metrics.Sizing(capital=1000, risk_pct=10))
    assert m["wins"] == 3 and m["losses"] == 3 and abs(m["total_return"] - 1.0) < 1e-12 and m["max_drawdown"] == 2.0
    assert m["max_consecutive_losses"] == 2 and m["max_consecutive_wins"] == 1 and m["profit_factor"] == 3.5 / 2.5
    assert m["median_rr"] == 0.0 and m["p05_rr"] == -1.0 and m["p95_rr"] == 2.0 and m["sample_quality"] == "poor"
    capital = 1000.0
    for r in rr:
        capital += r * capital * 0.1
    assert abs(m["final_capital"] - capital) < 1e-9
    s = metrics.Sizing(capital=10_000, risk_pct=1, contracts=True, most=3, margin=4_000)
    assert metrics.capital_path(np.array([1.0, -1.0, 1.0]), s, np.array([20.0, np.nan, 50.0])).tolist() == [10_000, 10_040, 10_040, 10_140]
    assert metrics.core_metrics(np.empty(0), metrics.Sizing())["total_return"] == 0.0
    rows = np.zeros((2, 7))
    rows[0], rows[1, :3] = rr, [-1.0, 2.0, 0.5]
    many = metrics.core_rows(rows, np.array([7, 3]), metrics.Sizing(years=2.0))
    for i, x in enumerate((rr, rows[1, :3])):
        for k, v in metrics.core_metrics(x, metrics.Sizing(years=2.0)).items():
            assert abs(many[k][i] - v) < 1e-9, k


def test_catalog_rules():
    assert catalog.nice(37.0, True) == 20.0 and catalog.nice(37.0, False) == 50.0 and catalog.nice(-37.0, True) == -10.0 and catalog.nice(-37.0, False) == -100.0 and catalog.nice(0.0, True) == 0.0
    assert catalog.label(20.0) == "20.0" and catalog.label(0.125) in ("0.12", "0.13") and catalog.label(1.50) == "1.5"
    assert catalog.thresholds(0, 4, 1, ">") == [0, 1, 2, 3] and catalog.thresholds(0, 4, 1, "<=") == [0, 1, 2, 3, 4]
    assert 5 <= len(catalog.thresholds(20, 80, catalog.increment(20, 80, 1), ">")) <= 15
    names = [p.name for p in catalog.pair_predicates(["close", "open", "9ema", "20ema"])]
    assert "20ema>9ema" not in names and "9ema>close" in names and len(names) == 2 * 5


def test_catalog_drops_constant_and_equal_masks(spark):
    o, h, low, c = random_bars(60)
    a = (np.arange(60) % 3 == 0).tolist()
    df = frame(spark, o, h, low, c, a=a, b=a, yes=[True] * 60, d=(np.arange(60) % 2 == 0).tolist())
    kept = catalog.prune(df, [catalog.Predicate(x, x) for x in ("a", "b", "yes", "d", "a")])
    assert [p.name for p in kept] == ["a", "d"]


FIX = [(0, "2024-12-29", True, False, 2.0, 1.0, 1.0, 2), (1, "2024-12-30", True, True, 3.0, 2.0, -0.5, 3), (2, "2024-12-31", False, True, 1.0, 2.0, 0.5, 3), (3, "2025-01-01", True, False, 5.0, 1.0, 2.0, 5), (4, "2025-01-02", True, True, 1.0, 4.0, -1.0, 5), (5, "2025-01-03", False, True, 3.0, 3.0, 0.25, 6)]


@pytest.mark.parametrize("side,stacking,purged,want", [
    ("pre", True, False, [(2, 0.5), (2, 0.0), (2, 1.5)]), ("pre", False, False, [(1, 1.0), (1, -0.5), (2, 1.5)]), ("pre", True, True, [(1, 1.0), (0, 0.0), (1, 1.0)]), ("pre", False, True, [(1, 1.0), (0, 0.0), (1, 1.0)]),
    ("post", True, False, [(1, 2.0), (2, -0.75), (1, -1.0)]), ("post", False, False, [(1, 2.0), (2, -0.75), (1, -1.0)]), ("post", True, True, [(1, 2.0), (1, -1.0), (1, -1.0)]), ("post", False, True, [(1, 2.0), (1, -1.0), (1, -1.0)]),
])
def test_formula_fixture(spark, side, stacking, purged, want):
    rows = [("s", i, datetime.fromisoformat(d), a, b, x, y, True, rr, True, e) for i, d, a, b, x, y, rr, e in FIX]
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, ts timestamp, flag_a boolean, flag_b boolean, x double, y double, t boolean, rr_t double, t_eligible boolean, t_exit_i long")
    df = formula.split_window(df, "2024-12-31", side)
    df = formula.purge(df, "t") if purged else df
    got = {r.source_rank: r for r in formula.evaluate_window(df, formula.parse_lines("flag_a && x>y\nflag_b\nx<=2.0"), "t", stacking=stacking).collect()}
    assert [(got[i].trades, round(got[i].total_return, 9)) for i in (1, 2, 3)] == want


def test_formula_grammar():
    f = formula.parse_lines("# c\n\nRank 7: a>=1 && flag\nb != 2\n")
    assert [(x.rank, x.expression) for x in f] == [(7, "a>=1 && flag"), (2, "b!=2")] and formula.parse("a && ").expression == "a"
    for bad in ("", " && ", "a > ", "(a)", "a || b"):
        with pytest.raises(ValueError):
            formula.parse_lines(bad) if not bad else formula.parse(bad)


def test_frs(spark):
    y = spark.createDataFrame([("f", 10.0, 2.0, 40), ("f", 4.0, 1.0, 20), ("f", -2.0, 4.0, 30)], "formula string, total_return double, max_drawdown double, trades long")
    r = formula.frs(y).first()
    assert abs(r.p - 2 / 3) < 1e-9 and abs(r.c - 4.0) < 1e-6 and abs(r.trade_score - 1.0) < 1e-9
    want = (2 / 3) ** 2 * 4 * (1 / (1 + 4 / 2)) ** 2 * (1 / (1 + 6 / 4)) * 1
    assert abs(r.frs - want) < 1e-6


def test_selection(spark):
    cols = "formula string, rank int, trades long, total_return double, expectancy double, max_drawdown double, largest_win double, density_per_1000 double"
    pre = spark.createDataFrame([("a", 1, 50, 5.0, 0.1, 2.0, 1.0, 9.0), ("b", 2, 200, 9.0, 0.2, 2.0, 1.0, 9.0), ("c", 3, 200, 8.0, 0.2, 2.0, 1.0, 9.0), ("d", 4, 200, 8.0, 0.2, 2.0, 1.0, 9.0)], cols)
    post = spark.createDataFrame([("a", 1, 40, 5.0, 0.1, 2.0, 1.0, 9.0), ("b", 3, 40, 4.0, 0.1, 2.0, 1.0, 9.0), ("c", 2, 60, 4.0, 0.1, 2.0, 1.0, 9.0)], cols)
    assert {r.status for r in selection.decide(pre, post).collect()} == {"rejected", "missing_post_result"}  # a missing score counts as 0
    pre = pre.selectExpr("*", "0.5 AS frs")
    got = {r.formula: r for r in selection.decide(pre, post).collect()}
    assert got["a"].status == "rejected" and got["a"].reasons == ["pre_trades_below_floor"] and got["b"].status == "selected" and got["b"].warnings and got["c"].status == "passed" and got["d"].status == "missing_post_result"
    got = {r.formula: r.status for r in selection.decide(pre, post, mode="validation-rank").collect()}
    assert got["c"] == "selected" and got["b"] == "passed"
    assert selection.splits(4) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)] and selection.splits(5) == []
    x = [0.5, 1.0, -0.2, 0.7, 0.4]
    assert 0.5 < selection.probabilistic_sharpe(x) < 1 and selection.deflated_sharpe(x, 100) < selection.probabilistic_sharpe(x)
    assert selection.gate_status(0.5, None, None, []) == "fail" and selection.gate_status(None, None, None, []) == "unavailable" and selection.gate_status(0.1, 0.99, 0.99, ["w"]) == "warning"


def test_store(spark, tmp_path):
    o, h, low, c = random_bars(60)
    df = frame(spark, o, h, low, c, a=(np.arange(60) % 3 == 0).tolist(), b=(np.arange(60) % 2 == 0).tolist(), t=[True] * 60, rr_t=[0.5] * 60, t_eligible=[True] * 60).withColumn("t_exit_i", B.F.col("bar_idx"))
    got = combine.evaluate(spark, combine.prepare(df, [catalog.Predicate(x, x) for x in "ab"], combine.trade_columns("t")), 2)
    s = store.ResultStore(spark, str(tmp_path / "s"))
    assert s.offset("i", "h") == 0 and s.summary() == (0, 0)
    s.append(got, "i", "h", "long", "t", 3)
    s.append(got.limit(1), "i", "h", "long", "t", 2)
    assert s.offset("i", "h") == 5 and s.summary() == (5, 4)
    s.check("i", "h")
    with pytest.raises(ValueError):
        s.check("i", "other")
    # a batch that was cut off before its record does not count, and counts once when it comes again
    got.withColumn("identity", B.F.lit("i")).write.parquet(str(tmp_path / "s/results/batch=cut"))
    assert s.summary() == (5, 4)
    assert s.append(got, "i", "h", "long", "t", 3, start=5) and not s.append(got, "i", "h", "long", "t", 3, start=5)
    assert s.offset("i", "h") == 8 and s.summary() == (8, 7)
    full = s.recompute(df, combine.trade_columns("t"), [catalog.Predicate(x, x) for x in "ab"], 2, True, metrics.Sizing(), rank_by="total_return").collect()
    assert full and all(r.trades == r.stored_trades and abs(r.total_return - r.stored_total_return) < 1e-9 and r.profit_factor > 0 for r in full)
    assert [r.combination for r in s.query(2, rank_by="total_return", target="t").collect()][0] == "b"
    assert B.write_prepared(df, str(tmp_path / "p")) and not B.write_prepared(df, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        B.write_prepared(df.limit(3), str(tmp_path / "p"))


def test_csv_source(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("timestamp,open,high,low,close,volume\n2024-01-01T00:30:00Z,1,2,0.5,1.5,10\n2024-01-01T00:00:00Z,1,2,0.5,bad,10\n,1,1,1,1,1\n")
    rows = B.read_raw_csv(spark, str(p)).orderBy("bar_idx").collect()
    assert [(r.bar_idx, r.close) for r in rows] == [(0, None), (1, 1.5)]
    assert B.check_prices(B.read_raw_csv(spark, str(p))).count() == 1


def test_protocol(tmp_path):
    S = protocol.Span
    p = protocol.Protocol("d", "t", "long", S(None, "2023-12-31"), S("2024-01-01", "2024-06-30"), S("2024-07-01", None))
    p.validate()
    assert protocol.Protocol.from_json(p.to_json()) == p
    with pytest.raises(ValueError):
        protocol.Protocol("d", "t", "long", S(None, "2024-01-01"), S("2024-01-01", None), S("2025-01-01", None)).validate()
    m = protocol.export_formulas(str(tmp_path / "f.txt"), ["a && b"], p, {"target": "t", "direction": "long", "source_end": "2023-06-01"})
    protocol.check_manifest(m, p)
    with pytest.raises(ValueError):
        protocol.check_manifest({**m, "source_end": "2024-02-01"}, p)
    assert formula.parse_lines((tmp_path / "f.txt").read_text())[0].expression == "a && b"
    reg = protocol.Registry(str(tmp_path / "r"))
    reg.add({"stage": "lockbox", "protocol_sha256": p.digest(), "formula": "a"})
    assert reg.lockbox_attempt(p.digest(), "b") == 0
    with pytest.raises(ValueError):
        reg.lockbox_attempt(p.digest(), "a")
    assert protocol.compare_benchmarks({"q": [1.0, 1.0], "r": [1.0]}, {"q": [1.2, 1.2]}, hard=frozenset(["r"])) == {"q": "regression", "r": "missing"}


def test_backtest_trades_do_not_overlap(spark):
    f = features(B.bars_hour(spark, "/root/testdata/sf0.01"))
    t = backtest.trades(backtest.period_backtest(f, backtest.entry_condition("close > 0"), backtest.trading_week(), "w", cap=3, stop_after_win=False), "w").orderBy("direction", "entry_i").collect()
    assert t
    for a, b in zip(t, t[1:]):
        if a.direction == b.direction:
            assert b.entry_i > a.exit_i > a.entry_i


def test_queries_and_oracles_agree(spark):
    """Every query with SQL gives DuckDB's rows on the smallest tables."""
    import duckdb
    import pandas as pd

    from barloom.plans import research  # noqa: F401
    from barloom.plans.kernels import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def norm(df):
        cols = sorted(df.columns)
        return sorted(tuple("-" if pd.isna(v) else f"{float(v):.3f}" if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))

    for name in ("flagship_depth1", "k03_ema", "k05_kalman", "k16_macd_signal", "k17_stochastic", "k22_percentile_rank", "k26_adx", "t_highlow_1r", "t_2x_atr_tp_atr_stop", "a04_pairs", "a11_evaluate_stacking", "v06_overfitting"):
        assert norm(QUERIES[name](spark, SF).toPandas()) == norm(con.execute(ORACLES[name]).df()), name
