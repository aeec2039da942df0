"""The command line end to end, and the streaming extension."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom import cli
from barloom.streaming.bars import stream_bars


def test_prepare_search_export_evaluate(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    c = 100 + np.cumsum(rng.normal(0, 1, 420))
    o = np.concatenate(([100.0], c[:-1]))
    lines = ["timestamp,open,high,low,close,volume"]
    lines += [f"{(datetime(2024, 1, 1) + timedelta(hours=4 * i)).isoformat()}Z,{o[i]},{max(o[i], c[i]) + 0.5},{min(o[i], c[i]) - 0.5},{c[i]},1" for i in range(420)]
    (tmp_path / "bars.csv").write_text("\n".join(lines))
    data, out = str(tmp_path / "p"), str(tmp_path / "store")
    assert cli.main(["prepare", str(tmp_path / "bars.csv"), data, "--asset", "ES"]) == 0
    assert cli.main(["prepare", str(tmp_path / "bars.csv"), data, "--asset", "ES"]) == 0
    assert "reused" in capsys.readouterr().out
    args = ["comb", data, out, "--max-depth", "1", "--min-samples", "5", "--max-drawdown", "1000", "--no-pairs", "--batch", "150", "--end", "2024-02-15", "--top-k", "3"]
    cli.main(args)
    cli.main(args)  # all done: adds nothing
    from barloom.operators.store import ResultStore

    processed, stored = ResultStore(spark, out).summary()
    assert processed > 0 and stored > 0 and ResultStore(spark, out).combinations().count() == stored
    cli.main(["protocol", "init", str(tmp_path / "proto.json"), "--discovery-end", "2024-02-15", "--validation-end", "2024-03-01"])
    cli.main(["protocol", "validate", str(tmp_path / "proto.json")])
    cli.main(["results", out, "--k", "3", "--target", "2x_atr_tp_atr_stop", "--direction", "long", "--rank-by", "total_return", "--export", str(tmp_path / "f.txt"), "--protocol", str(tmp_path / "proto.json")])
    assert json.loads((tmp_path / "f.txt.manifest.json").read_text())["count"] == 3
    cli.main(["eval-formulas", data, str(tmp_path / "f.txt"), "--cutoff", "2024-02-15", "--out", str(tmp_path / "r"), "--purge", "--embargo", "2", "--preset", "exploratory", "--protocol", str(tmp_path / "proto.json")])
    assert spark.read.json(str(tmp_path / "r/pre")).count() == 3
    with pytest.raises(ValueError):
        cli.main(["eval-formulas", data, str(tmp_path / "f.txt"), "--cutoff", "2024-02-15", "--protocol", str(tmp_path / "proto.json"), "--stage", "lockbox"])
    with pytest.raises(ValueError):
        cli.main(["prepare", str(tmp_path / "bars.csv"), data, "--target", "tribar_4h_2atr"])


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """A prepared data set, a store of its discovery window, a protocol and three exported formulas."""
    home = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(6)
    c = 100 + np.cumsum(rng.normal(0.02, 1, 600))
    o = np.concatenate(([100.0], c[:-1]))
    lines = ["timestamp,open,high,low,close,volume"]
    lines += [f"{(datetime(2024, 1, 1) + timedelta(hours=4 * i)).isoformat()}Z,{o[i]},{max(o[i], c[i]) + 0.5},{min(o[i], c[i]) - 0.5},{c[i]},1" for i in range(600)]
    (home / "bars.csv").write_text("\n".join(lines))
    at = lambda x: str(home / x)
    cli.main(["prepare", at("bars.csv"), at("data"), "--asset", "ES"])
    cli.main(["comb", at("data"), at("store"), "--max-depth", "1", "--min-samples", "5", "--max-drawdown", "1000", "--no-pairs", "--max-combos", "60", "--end", "2024-03-01", "--top-k", "3"])
    cli.main(["protocol", "init", at("proto.json"), "--discovery-end", "2024-03-01", "--validation-end", "2024-03-25"])
    cli.main(["results", at("store"), "--k", "3", "--min-trades", "5", "--target", "2x_atr_tp_atr_stop", "--direction", "long", "--export", at("f.txt"), "--protocol", at("proto.json")])
    return at


def test_provenance_is_refused_unless_it_is_whole(searched, spark, tmp_path):
    manifest = json.loads(open(searched("f.txt.manifest.json")).read())
    assert manifest["source_end"] == "2024-03-01" and manifest["protocol_sha256"]
    run = ["eval-formulas", searched("data"), "--cutoff", "2024-03-01", "--preset", "exploratory", "--pbo-blocks", "4", "--protocol", searched("proto.json")]

    def refused(match, change=None, text=None, more=()):
        path = str(tmp_path / "g.txt")
        open(path, "w").write(text or open(searched("f.txt")).read())
        (tmp_path / "g.txt.manifest.json").unlink(missing_ok=True)
        if change is not None:
            (tmp_path / "g.txt.manifest.json").write_text(json.dumps({**manifest, **change}))
        with pytest.raises(ValueError, match=match):
            cli.main([*run[:2], path, *run[2:], *more])

    refused("no manifest")
    refused("bound to no protocol", {"protocol_sha256": None})
    refused("another protocol", {"protocol_sha256": "0" * 64})
    refused("does not say", {"source_end": None})
    refused("beyond the discovery", {"source_end": "2024-03-20"})
    refused("not the file", {}, "Rank 1: is_green\n")
    refused("direction", {}, None, ["--direction", "short"])
    # a store whose batches don't say where their data end, or say a later day, exports no earlier one
    from barloom.operators.store import ResultStore

    s = ResultStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", 1.0)], "combination string, total_return double")
    s.append(rows, "i", "h", "long", "t", 1, 0, "2024-01-05")
    s.append(rows, "i", "h", "long", "t", 1, 1, "2024-02-05")
    assert s.source_end("t", "long") == "2024-02-05" and s.source_end("t", "short") is None
    s.append(rows, "i", "h", "long", "t", 1, 2)
    assert s.source_end("t", "long") is None


def test_validate_lockbox_explain(searched, capsys):
    common = ["--protocol", searched("proto.json"), "--preset", "exploratory", "--pbo-blocks", "4", "--registry", searched("registry")]
    cli.main(["select", "validate", searched("data"), searched("f.txt"), searched("run1"), *common])
    capsys.readouterr()
    cli.main(["select", "explain", searched("run1")])
    said = capsys.readouterr().out
    assert "status" in said and "trials" in said
    record = json.loads(open(searched("run1/closeout.json")).read())
    assert record["run"] == "select validate" and record["cutoff"] == "2024-03-01" and {"pre", "post", "years", "frs", "selection", "overfit", "stress", "equity"} <= {k.split("/")[0] for k in json.loads(open(searched("run1/checksums.json")).read())}
    with pytest.raises(ValueError, match="finished run"):
        cli.main(["select", "validate", searched("data"), searched("f.txt"), searched("run1"), *common])
    with pytest.raises(ValueError, match="exactly one"):
        cli.main(["select", "lockbox", searched("data"), searched("f.txt"), searched("run2"), *common])
    from barloom.operators import protocol

    p = protocol.Protocol.from_json(open(searched("proto.json")).read())
    manifest = json.loads(open(searched("f.txt.manifest.json")).read())
    protocol.export_formulas(searched("one.txt"), ["is_close_above_9ema"], p, {k: manifest[k] for k in ("target", "direction", "source_end")})
    lock = ["select", "lockbox", searched("data"), searched("one.txt")]
    cli.main([*lock, searched("run3"), *common])
    with pytest.raises(ValueError, match="1 times"):
        cli.main([*lock, searched("run4"), *common])
    cli.main([*lock, searched("run5"), *common, "--acknowledge-rerun"])
    assert json.loads(open(searched("run5/closeout.json")).read())["attempt"] == 1


def test_contracts_from_the_command_line(searched, spark):
    from barloom.operators.store import ResultStore

    args = ["comb", searched("data"), "--max-depth", "1", "--min-samples", "5", "--max-drawdown", "1000", "--no-pairs", "--max-combos", "10", "--top-k", "2", "--position-sizing", "contracts"]
    with pytest.raises(ValueError, match="asset"):
        cli.main([*args[:2], searched("s2"), *args[2:]])
    cli.main([*args[:2], searched("s2"), *args[2:], "--asset", "MES", "--cost-dollar", "2.5", "--max-contracts", "3"])
    rows = ResultStore(spark, searched("s2")).results().collect()
    assert rows and all(r.final_capital != 100_000.0 for r in rows)


def test_a_frame_without_rows_is_an_error(tmp_path):
    (tmp_path / "b.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01T00:00:00Z,1,2,0.5,1.5,1\n2024-01-01T01:00:00Z,1,2,0.5,1.5,1\n")
    with pytest.raises(ValueError, match="no bar has all features"):
        cli.main(["prepare", str(tmp_path / "b.csv"), str(tmp_path / "out")])


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    q = stream_bars(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), width="1 day").writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = src.groupBy("event_type", "ts").count().selectExpr("event_type", "date_trunc('day', ts) AS d").distinct().count()
    assert spark.table("bars").count() == want
