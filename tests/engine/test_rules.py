"""Ranges, audits, sampling, returns that are found or missing, short samples, Sharpe ratios of groups; and the queries of these against SQL."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from barloom import cli
from barloom.operators import audit, bitmaps, catalog, combine, selection
from barloom.operators.catalog import Predicate, Range

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    rows = [("s", i, bool(rng.random() < 0.5), bool(rng.random() < 0.2), bool(rng.random() < 0.6), i % 7 != 0, i + 1 + int(rng.integers(0, 4)), float(rng.normal())) for i in range(400)]
    return spark.createDataFrame(rows, "series_id string, bar_idx long, f boolean, g boolean, t boolean, t_eligible boolean, t_exit_i long, rr_t double").cache()


def test_standard_ranges():
    assert len(catalog.RANGES) == 55 and [x for x, r in catalog.RANGES.items() if not r.on] == ["kf_wicks_smooth"]
    assert catalog.RANGES["rsi_14"] == Range((">=", "<=")) and catalog.RANGES["consecutive_green"].operators == (">=",)


def test_ranges_from_json(spark):
    df = spark.createDataFrame([("s", i, float(i), float(i), str(i)) for i in range(101)], "series_id string, bar_idx long, a double, b double, word string")
    text = json.dumps({"a": {"min": 10, "max": "auto", "increment": 30, "operators": [">"]}, "b": {"enabled": False, "min": 0, "max": 1, "increment": 1, "operators": [">"]}, "word": {"min": 0, "max": 9, "increment": 1, "operators": ["<"]}, "none": {"min": 0, "max": 9, "increment": 1, "operators": ["<"]}})
    assert [(p.name, p.threshold) for p in catalog.threshold_predicates(df, catalog.ranges_of(text))] == [("a>10.0", 10.0), ("a>40.0", 40.0), ("a>70.0", 70.0)]
    assert catalog.threshold_predicates(df, {"a": Range((">",), 5.0, 4.0), "b": Range((">",), 0.0, 1.0, 0.0)})[0].name.startswith("a>")  # neither gives one: the fallback
    with pytest.raises(ValueError, match="unknown operator"):
        catalog.ranges_of(json.dumps({"a": {"min": 0, "max": 1, "increment": 1, "operators": ["=>"]}}))


def test_audit_of_an_empty_and_a_strange_frame(spark):
    kinds = "series_id string, bar_idx long, f boolean, n int, x double, `odd name` double, word string"
    empty = {(r.finding, r.name) for r in audit.audit(spark.createDataFrame([], kinds), ["f", "n", "q"], ["x", "word"], {}).collect()}
    assert empty == {("flag missing", "q"), ("flag unfit", "n"), ("number unfit", "word"), ("number without range", "x"), ("number without range", "word")}
    rows = [("s", 0, None, 1, 1.0, math.nan, "a"), ("s", 1, True, None, 0.0, 2.0, None), ("s", 2, True, 0, None, 3.0, "c"), ("s", 3, True, 0, None, math.inf, "c")]
    got = {(r.finding, r.name): r for r in audit.audit(spark.createDataFrame(rows, kinds), ["f"], ["x"], {"x": Range((">",))}).collect()}
    assert got.keys() == {("flag not listed", "n"), ("number unfit", "x"), ("number not listed", "odd name")}
    assert tuple(got["number not listed", "odd name"])[3:] == (2.0, 2.0, 2.0, 3.0)


def test_where_returns_are_found():
    cols = ["rr_t", "rr_long", "rr_short", "reward", "rr"]
    assert combine.reward_column(cols, "t", "short") == "rr_t"
    assert combine.reward_column(cols[1:], "t", "short") == "rr_short" and combine.reward_column(cols[1:], "t") == "rr_long"
    assert combine.reward_column(cols[3:], "t", "long") == "rr" and combine.reward_column(["returns"], "t") == "returns" and combine.reward_column(["x"], "t") is None
    assert combine.reward_column(cols, "t", named=" reward ") == "reward" and combine.reward_column(cols, "t", named=" ") == "rr_t"
    with pytest.raises(ValueError, match="missing"):
        combine.reward_column(cols, "t", named="gone")


def test_columns_that_a_frame_lacks(frame):
    with pytest.raises(ValueError, match="target"):
        combine.found_columns(frame, "u")
    with pytest.raises(ValueError, match="t_exit_i"):
        combine.found_columns(frame.drop("t_exit_i"), "t")
    cols, returns = combine.found_columns(frame.drop("t_exit_i", "t_eligible", "rr_t"), "t", stacking=True, cost=0.5)
    got = frame.drop("t_exit_i", "t_eligible", "rr_t").select(*[v.alias(k) for k, v in cols.items()]).distinct().collect()
    assert not returns and {(r._reward, r._gate, r._exit) for r in got} == {(0.0, True, None)}


@pytest.mark.parametrize("blocks", [False, True])
def test_labels_alone(spark, frame, blocks):
    preds = [Predicate("f", "f"), Predicate("g", "g")]
    df = frame.drop("rr_t")
    cols, _ = combine.found_columns(df, "t", stacking=True)
    out = bitmaps.evaluate(df, preds, cols, 2, 1, stacking=True, size=64) if blocks else combine.evaluate(spark, combine.prepare(df, preds, cols), 2, 1, stacking=True)
    got = {r.combination: r for r in combine.by_labels(out).collect()}
    pdf = frame.toPandas()
    for name, on in (("f", pdf.f), ("g", pdf.g), ("f && g", pdf.f & pdf.g)):
        on = on & pdf.t_eligible
        r, hits = got[name], int((on & pdf.t).sum())
        assert (r.trades, r.wins, r.losses, r.label_hits) == (on.sum(), hits, on.sum() - hits, hits) and math.isclose(r.win_rate, 100 * hits / on.sum())
        assert (r.total_return, r.final_capital, r.calmar_ratio, r.max_drawdown) == (0, 0, 0, 0)


def test_metrics_of_labels(spark):
    df = spark.createDataFrame([("a", 4, 3, 9.0, 9.0, 9.0, "poor"), ("b", 2, 2, 9.0, 9.0, 9.0, "poor"), ("c", 0, 0, 9.0, 9.0, 9.0, "poor")], "formula string, trades long, label_hits long, expectancy double, profit_factor double, ulcer_index double, sample_quality string")
    assert [tuple(r)[1:] for r in combine.by_labels(df).orderBy("formula").collect()] == [(4, 3, 0.5, 3.0, 0.0, "poor"), (2, 2, 1.0, math.inf, 0.0, "poor"), (0, 0, 0.0, 0.0, 0.0, "poor")]


@pytest.mark.parametrize("stacking", [False, True])
def test_short_samples_leave_the_others_alone(spark, frame, stacking):
    preds = [Predicate("f", "f"), Predicate("g", "g"), Predicate("none", "rr_t", ">", 99.0)]
    setup = combine.prepare(frame, preds, combine.trade_columns("t"))
    some = {r.combination: r for r in combine.evaluate(spark, setup, 3, 40, stacking=stacking).collect()}
    every = {r.combination: r for r in combine.evaluate(spark, setup, 3, 40, stacking=stacking, short=True).collect()}
    assert len(every) == 7 and 0 < len(some) < 7
    for k, r in every.items():
        if k in some:
            assert r == some[k]
        else:
            assert r.trades < 40 and (r.wins, r.losses, r.label_hits, r.win_rate, r.total_return, r.final_capital) == (0, r.trades, 0, 0, 0, 0)
    assert every["none"].mask_hits == every["none"].trades == 0


def test_sampling_by_kind():
    preds = [Predicate("f", "f"), Predicate("g", "g"), Predicate("a>1", "a", ">", 1.0), Predicate("a>b", "a", ">", None, "b")]
    assert catalog.sampling(preds, {"f": (9, 5, 0), "g": (9, 4, 0), "a>1": (9, 0, 0), "a>b": (9, 9, 0)}, 5) == [("flag", 2, 1, 1), ("threshold", 1, 1, 0), ("pair", 1, 0, 1)]


def test_sharpe_of_groups(spark):
    rng = np.random.default_rng(5)
    held = {"normal": rng.normal(0.1, 1, 300), "skewed": rng.exponential(1, 50) - 0.8, "few": np.array([1.0, 2.0, 3.0]), "equal": np.full(9, 2.0)}
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, x in held.items() for v in x] + [("normal", math.nan), ("few", math.inf)], columns=["k", "v"]))
    got = {r.k: r for r in selection.sharpe_table(df, ["k"], "v", 20).collect()}
    for k, x in held.items():
        want = (selection.probabilistic_sharpe(x.tolist()), selection.deflated_sharpe(x.tolist(), 20))
        assert got[k].n == len(x) and all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)) for a, b in zip((got[k].psr, got[k].dsr), want)), k
    assert selection.sharpe_table(df.where("k = 'x'"), ["k"], "v").count() == 0


def test_search_with_own_ranges_and_without_returns(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 10, 300)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "bar_idx": np.arange(300), "ts": pd.date_range("2024-01-01", periods=300, freq="h"), "rsi_14": x, "is_hammer": rng.random(300) < 0.4, "t": x > 0}))
    df.write.parquet(str(tmp_path / "p"))
    (tmp_path / "ranges.json").write_text(json.dumps({"rsi_14": {"min": -10, "max": 10, "increment": 10, "operators": [">"]}}))
    args = ["comb", str(tmp_path / "p"), str(tmp_path / "s"), "--target", "t", "--stacking", "--no-pairs", "--max-depth", "2", "--min-samples", "10", "--feature-ranges", str(tmp_path / "ranges.json"), "--audit"]
    cli.main(args)
    said = capsys.readouterr().out
    assert "3 predicates, 6 combinations; no returns: only labels count" in said and "thresholds: 2, 0 below 10 samples, 2 eligible" in said and "number missing adx" in said
    rows = {r.combination: r for r in spark.read.parquet(str(tmp_path / "s" / "results")).collect()}
    assert rows["rsi_14>0.0"].win_rate == 100.0 and rows["rsi_14>0.0"].trades == int((x > 0).sum()) and "rsi_14>-10.0 && rsi_14>0.0" not in rows
    with pytest.raises(ValueError, match="missing"):
        cli.main([*args, "--reward-column", "gone"])


def test_queries_equal_their_sql(spark):
    import duckdb

    from barloom.plans import rules  # noqa: F401
    from barloom.plans.kernels import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def norm(df):
        cols = sorted(df.columns)
        return sorted(tuple("-" if pd.isna(v) else f"{float(v):.3f}" if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))

    for name in ("s01_raw_csv", "s06_prepared", "s07_store", "t_wicks_kf", "s16_ranges", "c11_ordered_pairs", "a25_sampling", "c14_audit", "n07_bounds_and_required", "a16_labels_only", "a19_short_samples", "x04_split", "x06_purge", "v01_status", "v07_sharpe"):
        assert norm(QUERIES[name](spark, SF).toPandas()) == norm(con.execute(ORACLES[name]).df()), name
