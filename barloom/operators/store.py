"""The result store: Parquet batches of scored combinations, and a ledger of what has been processed."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

RANKS = ("calmar_ratio", "total_return")
_LEDGER = "batch string, identity string, data_hash string, direction string, target string, start decimal(38,0), processed decimal(38,0), source_end string, at string"


class ResultStore:
    """A folder with ``results`` and ``ledger``. A batch is a folder of results named by what it holds (identity, data and range), and one file of the ledger that makes it count.

    The file comes last and is created by one writer only. So a batch that was cut off before it does not count and is written over when its range is processed again, and one that is processed twice is stored once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ledger(self) -> list[dict]:
        """The records of the batches that count: one for each batch."""
        return [json.loads(files.read(f"{self.path}/ledger/{n}")) for n in files.names(f"{self.path}/ledger", ".json")]

    def _table(self) -> DataFrame:
        rows = [tuple(r.get(c.split()[0]) if c.split()[0] not in ("start", "processed") else str(r[c.split()[0]]) for c in _LEDGER.split(", ")) for r in self.ledger()]
        return self.spark.createDataFrame(rows, _LEDGER.replace("decimal(38,0)", "string")).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("start", "processed")})

    def check(self, identity: str, data_hash: str, force: bool = False) -> None:
        """Refuse to go on with other data than the store was begun with."""
        if not force and any(r["identity"] == identity and r["data_hash"] != data_hash for r in self.ledger()):
            raise ValueError("the store holds results of other data for this configuration; use force to go on")

    def offset(self, identity: str, data_hash: str) -> int:
        """How many combinations have been processed."""
        return sum(int(r["processed"]) for r in self.ledger() if r["identity"] == identity and r["data_hash"] == data_hash)

    def source_end(self, target: str | None = None, direction: str | None = None) -> str | None:
        """The last day of the data that the stored results of a target and direction come from; None if a batch does not say."""
        ends = [r.get("source_end") for r in self.ledger() if target in (None, r["target"]) and direction in (None, r["direction"])]
        return max(ends) if ends and all(ends) else None

    def append(self, results: DataFrame, identity: str, data_hash: str, direction: str, target: str, processed: int, start: int | None = None, source_end: str | None = None) -> bool:
        """Store a batch of ``processed`` combinations from number ``start`` on (by default from the offset); False if it is stored already."""
        start = self.offset(identity, data_hash) if start is None else start
        batch = hashlib.sha256(json.dumps([identity, data_hash, start, processed]).encode()).hexdigest()[:32]
        record = f"{self.path}/ledger/{batch}.json"
        if files.exists(record):
            return False
        own = {"identity": identity, "data_hash": data_hash, "direction": direction, "target": target}
        results.withColumns({k: F.lit(v) for k, v in own.items()}).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/results/batch={batch}")
        row = {"batch": batch, **own, "start": start, "processed": processed, "source_end": source_end, "at": datetime.now(timezone.utc).isoformat()}
        return files.create(record, json.dumps(row, sort_keys=True))

    def keep_dead(self, identity: str, data_hash: str, names: list[str], dead) -> None:
        """Keep the pairs that a search leaves out, for the runs that go on with it."""
        a, b = dead.nonzero()
        files.create(f"{self.path}/dead/{hashlib.sha256(json.dumps([identity, data_hash]).encode()).hexdigest()[:32]}.json", json.dumps({"names": names, "pairs": [a.tolist(), b.tolist()]}))

    def dead(self, identity: str, data_hash: str, names: list[str]):
        """The pairs kept for a search over these predicates, as a matrix, or None."""
        import numpy as np

        path = f"{self.path}/dead/{hashlib.sha256(json.dumps([identity, data_hash]).encode()).hexdigest()[:32]}.json"
        if not files.exists(path):
            return None
        got = json.loads(files.read(path))
        if got["names"] != names:
            return None
        out = np.zeros((len(names), len(names)), bool)
        out[tuple(got["pairs"])] = True
        return out

    def results(self) -> DataFrame | None:
        """The rows of all batches that count, or None."""
        done = [r["batch"] for r in self.ledger()]
        if not done:
            return None
        df = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/results").parquet(*[f"{self.path}/results/batch={b}" for b in done])
        return df.drop("batch")

    def query(self, k: int = 20, least: int = 0, max_drawdown: float | None = None, min_calmar: float | None = None, min_win_rate: float | None = None, direction: str | None = None, target: str | None = None, rank_by: str = "calmar_ratio") -> DataFrame:
        df = self.results()
        if df is None:
            raise ValueError(f"no results in {self.path}")
        return top_results(df, k, least, max_drawdown, min_calmar, min_win_rate, direction, target, rank_by)

    def summary(self) -> tuple[int, int]:
        """Combinations processed, rows stored."""
        rows = self.results()
        return sum(int(r["processed"]) for r in self.ledger()), rows.count() if rows is not None else 0

    def recompute(self, df: DataFrame, columns: dict, predicates: list, k: int, stacking: bool, sizing, rank_by: str = "calmar_ratio", **filters) -> DataFrame:
        """The k best stored results with full metrics, computed again from the bars of ``df``: only the predicates of these are evaluated. Stored rows stay as they are."""
        return full_results(df, self.query(k, rank_by=rank_by, **filters), columns, predicates, stacking, sizing)

    def combinations(self) -> DataFrame:
        return self.results().select("combination").distinct()


def top_results(df: DataFrame, k: int = 20, least: int = 0, max_drawdown: float | None = None, min_calmar: float | None = None, min_win_rate: float | None = None, direction: str | None = None, target: str | None = None, rank_by: str = "calmar_ratio") -> DataFrame:
    """The k best stored results that pass the filters; ties by label. Columns that an older part lacks count as empty."""
    if rank_by not in RANKS:
        raise ValueError(f"rank by one of {', '.join(RANKS)}")
    for c, kind in (("direction", "string"), ("target", "string"), ("win_rate", "double")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    df = df.where(F.col("trades") >= least)
    for c, v, op in (("max_drawdown", max_drawdown, "<="), ("calmar_ratio", min_calmar, ">="), ("win_rate", min_win_rate, ">=")):
        if v is not None:
            df = df.where(F.col(c) <= v if op == "<=" else F.col(c) >= v)
    for c, v in (("direction", direction), ("target", target)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(F.desc(rank_by), "combination").limit(k)


def full_results(df: DataFrame, chosen: DataFrame, columns: dict, predicates: list, stacking: bool, sizing) -> DataFrame:
    """combination, stored_trades, stored_total_return, mask_hits, trades, label_hits and full metrics of the combinations of ``chosen``, a top-k report: its labels come to the driver, bars and trades do not."""
    from .formula import large, score_trades, trades_of

    rows = chosen.select("combination", "trades", "total_return").collect()
    by = {p.name: p for p in predicates}
    lost = sorted({x for r in rows for x in r.combination.split(" && ")} - by.keys())
    if lost:
        raise ValueError(f"predicates not in the catalog: {', '.join(lost)}")
    named = df.sparkSession.createDataFrame([(i, r.combination, r.trades, r.total_return) for i, r in enumerate(rows)], "formula_id int, combination string, stored_trades long, stored_total_return double")

    def all_of(label: str):
        out = F.lit(True)
        for x in label.split(" && "):
            out = out & by[x].column()
        return out

    on = F.array_compact(F.array(*[F.when(all_of(r.combination), F.lit(i)) for i, r in enumerate(rows)])) if rows else F.array().cast("array<int>")
    hits = df.select("series_id", "bar_idx", *[c.alias(n) for n, c in columns.items()], F.explode(on).alias("formula_id"))
    parted = large(df)
    full = score_trades(trades_of(hits, ["formula_id"], stacking, parted=parted), ["formula_id"], sizing, parted=parted)
    return named.join(hits.groupBy("formula_id").agg(F.count("*").alias("mask_hits")), "formula_id").join(full, "formula_id").drop("formula_id")
