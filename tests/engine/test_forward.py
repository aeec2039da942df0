"""Forward evaluation: tables, the record of a run, and refusals."""

import pytest

from barloom.operators import forward, formula, selection
from barloom.operators.metrics import Sizing
from barloom.plans.research import slice_frame


def test_run_is_written_once_and_explained(spark, tmp_path):
    df = slice_frame(spark, "/root/testdata/sf0.001").cache()
    formulas = formula.parse_lines("is_green\nhigher_high && prev_green")
    cut = df.selectExpr("date_format(percentile_approx(ts, 0.5), 'yyyy-MM-dd')").first()[0]
    plan = forward.Plan("t", cut, policy=selection.PRESETS["exploratory"], pbo_blocks=4)
    tables = forward.evaluate(df, formulas, plan, (Sizing(), Sizing()))
    assert {r.formula for r in tables["pre"].collect()} == {f.expression for f in formulas} and {"frs", "depth", "rank"} <= set(tables["post"].columns)
    record = forward.verdict(tables, formulas, plan)
    assert record["status"] in ("selected", "no_selection") and len(record["candidates"]) == 2
    folder = str(tmp_path / "run")
    few = {k: tables[k] for k in ("pre", "selection")}
    forward.write_run(folder, few, record, str(tmp_path / "registry"))
    assert "status" in forward.explain(folder)
    with pytest.raises(ValueError, match="finished run"):
        forward.write_run(folder, few, record)
    (tmp_path / "run/closeout.json").write_text("{}")
    with pytest.raises(ValueError, match="have changed"):
        forward.explain(folder)
    with pytest.raises(ValueError, match="lack columns"):
        forward.evaluate(df.drop("t"), formulas, plan, (Sizing(), Sizing()))
