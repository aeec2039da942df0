"""Enumeration and evaluation of predicate combinations.

Combinations are numbered depth by depth in lexicographic order; a window of numbers is a ``range`` whose rows are unranked and scored where they
are. What a task needs of the data is one bit for each bar and predicate, and the trade columns: built distributed, brought together once
as packed words, and broadcast after a check of its size. Combinations, which grow without bound, never move.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import yes
from ..session import ship_package
from .catalog import Predicate
from .metrics import Sizing, capital_path, core_rows

#: bytes of masks and trade columns that are broadcast at most; beyond, evaluate series apart
MOST_BYTES = 1 << 30


def total(n: int, depth: int) -> int:
    """Combinations of 1 to ``depth`` of n."""
    return sum(math.comb(n, k) for k in range(1, depth + 1))


def locate(offset: int, n: int, depth: int) -> tuple[int, int]:
    """The depth of a global number, and its number in that depth."""
    for k in range(1, depth + 1):
        if offset < math.comb(n, k):
            return k, offset
        offset -= math.comb(n, k)
    raise IndexError("beyond the last combination")


#: a range whose numbers stay below this is unranked with 64-bit integers
EXACT = 1 << 62


def _below(n: int, k: int) -> list[int]:
    """For each x of 0 .. n, how many combinations of k of n begin below x."""
    return [math.comb(n, k) - math.comb(n - x, k) for x in range(n + 1)]


def unrank(numbers: np.ndarray | list[int], n: int, k: int) -> np.ndarray:
    """The combinations of k of n with these lexicographic numbers, a row each; all at once, by binary search in the counts of what begins with each element.
    Where the counts exceed 64 bits, one at a time with integers of any size."""
    if math.comb(n, k) > EXACT:
        return np.array([_unrank_one(int(x), n, k) for x in numbers], np.int64).reshape(-1, k)
    rest = np.asarray(numbers, np.int64).copy()
    out = np.empty((len(rest), k), np.int64)
    low = np.zeros(len(rest), np.int64)
    for i in range(k):
        table = np.array(_below(n, k - i), np.int64)
        want = rest + table[low]
        x = np.searchsorted(table, want, side="right") - 1
        out[:, i] = x
        rest = want - table[x]
        low = x + 1
    return out


def unrank_live(low: int, high: int, n: int, k: int, dead: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The numbers among low .. high - 1 whose combinations of k of n hold no pair that ``dead`` (n x n, true above the diagonal) rules out, those combinations, and how many beginnings were looked at.

    Combinations with the same beginning are a run of numbers. Beginnings grow element by element, and one that holds a dead pair is left out with its whole run, so what lies in it is never made."""
    held, start, seen = np.zeros((1, 0), np.int64), np.zeros(1, np.int64), 0
    for i in range(k):
        table = np.array(_below(n, k - i), np.int64)
        at = held[:, -1] + 1 if i else np.zeros(len(held), np.int64)
        # the children of a beginning are runs next to each other: take those that meet the range
        shift = start - table[at]
        first = np.maximum(np.searchsorted(table, low - shift, side="right") - 1, at)
        last = np.minimum(np.searchsorted(table, high - shift, side="left"), n - (k - i) + 1)
        many = np.maximum(last - first, 0)
        of = np.repeat(np.arange(len(held)), many)
        x = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]
        seen += len(of)
        live = ~dead[held[of], x[:, None]].any(axis=1) if i else np.ones(len(of), bool)
        of, x = of[live], x[live]
        held, start = np.column_stack((held[of], x)), shift[of] + table[x]
    return start, held, seen


def _unrank_one(number: int, n: int, k: int) -> list[int]:
    out, low = [], 0
    for i in range(k):
        table = _below(n, k - i)
        want = number + table[low]
        x = bisect_right(table, want) - 1
        out.append(x)
        number, low = want - table[x], x + 1
    return out


def ranges(low: int, high: int, n: int, k: int, before: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
    """The numbers low .. high - 1 of the combinations of k of n as ranges whose counts stay within 64 bits: (first elements, low and high among the combinations that go on, the first number of all).
    What goes on after first elements p is chosen of the n - p[-1] - 1 elements behind the last."""
    m = n - before[-1] - 1 if before else n
    left = k - len(before)
    size = math.comb(m, left)
    if size <= EXACT or left <= 1:
        if low < high:
            yield before, low, high, 0
        return
    first, table = n - m, _below(m, left)
    x = max(0, bisect_right(table, low) - 1)
    while x < m and table[x] < high:
        a, b = max(low - table[x], 0), min(high, table[x + 1]) - table[x]
        if a < b:
            for p, lo, hi, base in ranges(a, b, n, k, (*before, first + x)):
                yield p, lo, hi, base + table[x]
        x += 1


def combinations(spark: SparkSession, n: int, k: int, low: int, high: int) -> DataFrame:
    """number, combination (its elements, joined by spaces) of the combinations of k of n numbered low .. high - 1, unranked where they are."""
    ship_package(spark)
    out = None
    for first, lo, hi, base in ranges(low, high, n, k):
        behind = first[-1] + 1 if first else 0

        def run(batches: Iterator[pa.RecordBatch], first=first, lo=lo, base=base, behind=behind) -> Iterator[pa.RecordBatch]:
            import decimal

            for b in batches:
                local = b.column(0).to_numpy() + lo
                rest = unrank(local, n - behind, k - len(first)) + behind
                yield pa.record_batch([pa.array([decimal.Decimal(base + i) for i in local.tolist()], pa.decimal128(38, 0)), pa.array([" ".join(map(str, [*first, *r])) for r in rest.tolist()])], ["number", "combination"])

        part = spark.range(0, hi - lo).mapInArrow(run, "number decimal(38,0), combination string")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "number decimal(38,0), combination string")


def totals(counts: DataFrame, depth: int) -> DataFrame:
    """The columns of ``counts`` with its column ``n``, a number of features, and for each depth up to ``depth``: depth, combinations (of this size) and total (up to it), within 64 bits (larger numbers: ``total``)."""
    whole = "decimal(38,0)"
    step = lambda acc, i: F.call_function("div", acc * (F.col("n").cast("long") - i), (i + 1).cast("long"))
    each = counts.select("*", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("depth"))
    size = F.aggregate(F.sequence(F.lit(0), F.col("depth") - 1), F.lit(1).cast("long"), step)
    upto = Window.partitionBy(*counts.columns).orderBy("depth")
    return each.withColumn("combinations", size.cast(whole)).withColumn("total", F.sum("combinations").over(upto).cast(whole))


def rank(combination: list[int], n: int) -> int:
    """The lexicographic number of a combination."""
    k, out, before = len(combination), 0, -1
    for i, x in enumerate(combination):
        out += sum(math.comb(n - y - 1, k - i - 1) for y in range(before + 1, x))
        before = x
    return out


@dataclass
class Setup:
    """Masks and trades of one evaluation, as arrays."""

    names: list[str]
    words: np.ndarray
    gate: np.ndarray
    reward: np.ndarray
    label: np.ndarray
    exits: np.ndarray
    risk: np.ndarray
    #: base and side of scalar bounds, as numbers; -1 for none
    bounds: np.ndarray
    required: list[int] = field(default_factory=list)

    @property
    def bars(self) -> int:
        return len(self.reward)


def trade_columns(target: str, cost: float = 0.0, reward: str | None = None, cost_dollar: Column | None = None, risk_dollar: Column | None = None, lacks: dict[str, Column] | None = None) -> dict[str, Column]:
    """gate, reward net of cost, label, exit bar and dollar risk of each bar; a null reward counts as 0, a NaN one as no trade. ``lacks`` stands in for columns that are missing."""
    lacks = lacks or {}
    of = lambda x: lacks.get(x, F.col(f"`{x}`"))
    rr = F.coalesce(of(reward or f"rr_{target}"), F.lit(0.0))
    if cost_dollar is not None and risk_dollar is not None:
        net = rr - F.when(risk_dollar > 0, F.try_divide(cost_dollar, risk_dollar))
    else:
        net = rr - cost
    net = F.when(~F.isnan(net) & (F.abs(net) != float("inf")), net)
    return {"_reward": net, "_gate": yes(of(f"{target}_eligible")) & net.isNotNull(), "_label": yes(F.col(f"`{target}`")), "_exit": of(f"{target}_exit_i").cast("long"), "_risk": risk_dollar if risk_dollar is not None else F.lit(None).cast("double")}


#: Where returns are looked for when no column is named after target or side.
REWARDS = ("rr", "reward", "r_multiple", "returns")


def reward_column(columns: list[str], target: str, direction: str = "both", named: str | None = None) -> str | None:
    """The column of returns: the one that is named (an error if it is missing), else the first there is of the target's own, the side's (long before short) and the usual names; None if there is none."""
    named = (named or "").strip()
    if named:
        if named not in columns:
            raise ValueError(f"the column of returns {named} is missing")
        return named
    sides = ("long", "short") if direction == "both" else (direction,)
    return next((x for x in (f"rr_{target}", *(f"rr_{s}" for s in sides), *REWARDS) if x in columns), None)


def found_columns(df: DataFrame, target: str, direction: str = "both", named: str | None = None, stacking: bool = False, **options) -> tuple[dict[str, Column], bool]:
    """``trade_columns`` of what the frame has, and whether it has returns. Without any each trade returns 0, and only labels count (see ``by_labels``); without a column of eligibility every bar is eligible; without exit bars trades may only stack."""
    reward = reward_column(df.columns, target, direction, named)
    if target not in df.columns:
        raise ValueError(f"the target {target} is missing")
    if not stacking and f"{target}_exit_i" not in df.columns:
        raise ValueError(f"trades that may not overlap need the column {target}_exit_i")
    lacks = {f"{target}_eligible": F.lit(True), f"{target}_exit_i": F.lit(None).cast("long"), **({} if reward else {f"rr_{target}": F.lit(0.0)})}
    cols = trade_columns(target, reward=reward, lacks={k: v for k, v in lacks.items() if k not in df.columns}, **(options if reward else {}))
    return cols, reward is not None


def by_labels(results: DataFrame) -> DataFrame:
    """Results of trades without returns: wins are label hits, losses the others; an expectancy of twice the share of wins less 1 and odds as profit factor, where the results have these columns; all other metrics are 0."""
    share = F.when(F.col("trades") > 0, F.col("label_hits") / F.col("trades")).otherwise(0.0)
    own = {"wins": F.col("label_hits"), "losses": F.col("trades") - F.col("label_hits"), "win_rate": share * 100.0, "expectancy": F.when(F.col("trades") > 0, 2.0 * share - 1.0).otherwise(0.0), "profit_factor": F.when(share >= 1.0, float("inf")).otherwise(share / (1.0 - share))}
    kept = ("combo_id", "depth", "mask_hits", "trades", "label_hits", "formula_id", "source_rank")
    kinds = {k: t for k, t in results.dtypes if t in ("double", "bigint") and k not in (*own, *kept)}
    return results.withColumns({**{k: v for k, v in own.items() if k in results.columns}, **{k: F.lit(0).cast(t) for k, t in kinds.items()}})


def fits(df: DataFrame, predicates: list[Predicate]) -> bool:
    """Whether ``prepare`` takes these bars: one series, within its bound."""
    return df.select("series_id").distinct().limit(2).count() <= 1 and df.count() * (len(predicates) / 8 + 40) <= MOST_BYTES


def prepare(df: DataFrame, predicates: list[Predicate], columns: dict[str, Column], required: list[str] | None = None) -> Setup:
    """Bring masks and trade columns of one series together. Masks are packed on the executors, 64 bars to a word; the size is checked first."""
    if df.select("series_id").distinct().limit(2).count() > 1:
        raise ValueError("one series at a time; filter by series_id")
    n = df.count()
    if n * (len(predicates) / 8 + 40) > MOST_BYTES:
        raise ValueError(f"{n} bars by {len(predicates)} predicates exceed {MOST_BYTES} bytes; narrow the window or the catalog")
    names = [p.name for p in predicates]
    missing = set(required or ()) - set(names)
    if missing:
        raise ValueError(f"required features not in the catalog: {', '.join(sorted(missing))}")
    flags = [p.column().cast("boolean").alias(f"m{i}") for i, p in enumerate(predicates)]
    rows = df.select("bar_idx", *[c.alias(k) for k, c in columns.items()], *flags)
    kinds = "bar_idx long, reward double, gate boolean, label boolean, exit long, risk double, mask binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.zeros((b.num_rows, len(names)), bool)
            for i in range(len(names)):
                m[:, i] = b.column(6 + i).to_numpy(zero_copy_only=False)
            bits = np.packbits(m, axis=1, bitorder="little")
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), b.column(5), pa.array([x.tobytes() for x in bits], pa.binary())], ["bar_idx", "reward", "gate", "label", "exit", "risk", "mask"])

    got = rows.select("bar_idx", "_reward", "_gate", "_label", "_exit", "_risk", *[f"m{i}" for i in range(len(names))]).mapInArrow(pack, kinds).toArrow().sort_by("bar_idx")
    bits = np.frombuffer(b"".join(got.column("mask").to_pylist()), np.uint8).reshape(n, -1)
    masks = np.unpackbits(bits, axis=1, count=len(names), bitorder="little").T
    pad = np.zeros((len(names), -(-n // 64) * 64 - n), np.uint8)
    words = np.packbits(np.concatenate((masks, pad), axis=1), axis=1, bitorder="little").view(np.uint64)
    at = {i: k for k, i in enumerate(got.column("bar_idx").to_pylist())}
    exits = np.array([at.get(x, n if x is not None else -1) for x in got.column("exit").to_pylist()], np.int64)
    ids: dict[tuple[str, str], int] = {}
    bounds = np.array([-1 if p.bound is None else ids.setdefault(p.bound, len(ids)) for p in predicates], np.int64)
    num = lambda c: np.array([np.nan if x is None else x for x in got.column(c).to_pylist()], np.float64)
    flag = lambda c: np.array(got.column(c).to_pylist(), bool)
    return Setup(names, words, flag("gate"), num("reward"), flag("label"), exits, num("risk"), bounds, [names.index(x) for x in required or ()])


def allowed(combos: np.ndarray, setup: Setup) -> np.ndarray:
    """At most one lower and one upper bound of each base, and a required feature if any is named."""
    ok = np.ones(len(combos), bool)
    for i in range(combos.shape[1]):
        for j in range(i + 1, combos.shape[1]):
            a, b = setup.bounds[combos[:, i]], setup.bounds[combos[:, j]]
            ok &= (a < 0) | (a != b)
    if setup.required:
        ok &= np.isin(combos, setup.required).any(axis=1)
    return ok


def choose_trades(row: np.ndarray, hit: np.ndarray, rows: int, bars: int, exits: np.ndarray, begin: np.ndarray | int = 0) -> np.ndarray:
    """Which hits become trades when they may not overlap: in each row the first (from the bar ``begin`` on), then always the first at or after the last one's exit bar. All rows take their next trade at once."""
    key = row * (bars + 1) + hit
    at = np.searchsorted(key, np.arange(rows) * (bars + 1) + begin)
    end = np.searchsorted(key, (np.arange(rows) + 1) * (bars + 1))
    free = row * (bars + 1) + np.minimum(np.where(exits[hit] >= hit, exits[hit], hit + 1), bars)
    chosen = np.zeros(len(key), bool)
    live = np.flatnonzero(at < end)
    cur, end = at[live], end[live]
    while len(cur):
        chosen[cur] = True
        cur = np.maximum(cur + 1, np.searchsorted(key, free[cur]))
        on = cur < end
        cur, end = cur[on], end[on]
    return chosen


def score(setup: Setup, combos: np.ndarray, least: int, stacking: bool, sizing: Sizing, short: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which of the combinations have ``least`` trades, and their metrics: mask hits before the gate, and those of the trades. With ``short`` those with fewer stay too, as rows whose trades all count as losses and whose other metrics are 0."""
    words = setup.words[combos[:, 0]]
    for i in range(1, combos.shape[1]):
        words &= setup.words[combos[:, i]]
    mask_hits = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    words &= np.packbits(np.append(setup.gate, np.zeros(words.shape[1] * 64 - setup.bars, bool)), bitorder="little").view(np.uint64)
    live = np.arange(len(combos)) if short else np.flatnonzero((mask_hits >= least) & (np.bitwise_count(words).sum(axis=1) >= max(least, 1)))
    row, hit = np.nonzero(np.unpackbits(words[live].view(np.uint8), axis=1, count=setup.bars, bitorder="little"))
    if not stacking and len(row):
        took = choose_trades(row, hit, len(live), setup.bars, setup.exits)
        row, hit = row[took], hit[took]
    trades = np.bincount(row, minlength=len(live))
    enough = trades >= (0 if short else max(least, 1))
    keep = enough[row]
    place = np.cumsum(enough) - 1
    row, hit, live, trades = place[row[keep]], hit[keep], live[enough], trades[enough]
    n = len(live)
    first = np.cumsum(trades) - trades
    rr = np.zeros((n, int(trades.max(initial=1))))
    rr[row, np.arange(len(row)) - first[row]] = setup.reward[hit]
    path = None
    if sizing.contracts:
        path = np.full((n, rr.shape[1] + 1), sizing.capital)
        for i in range(n):
            own = capital_path(rr[i, : trades[i]], sizing, setup.risk[hit[first[i] : first[i] + trades[i]]])
            path[i, : len(own)], path[i, len(own) :] = own, own[-1]
    out = {"mask_hits": mask_hits[live], "trades": trades, "label_hits": np.bincount(row, setup.label[hit], n).astype(np.int64), **core_rows(rr, trades, sizing, path)}
    if short:
        few = trades < least
        out = {k: v if k in ("mask_hits", "trades") else np.where(few, trades if k == "losses" else 0, v) for k, v in out.items()}
    return live, out


RESULT = "combo_id decimal(38,0), depth int, features array<int>, combination string, mask_hits long, trades long, wins long, losses long, label_hits long, win_rate double, total_return double, max_drawdown double, final_capital double, total_return_pct double, cagr_pct double, max_drawdown_pct_equity double, calmar_ratio double"


def _range(spark: SparkSession, shared, names: list[str], first: tuple[int, ...], k: int, low: int, high: int, base: int, least: int, max_drawdown: float, stacking: bool, sizing: Sizing, partitions: int | None, short: bool = False) -> DataFrame:
    """Score the combinations of depth k that begin with ``first`` and go on with those numbered low .. high - 1, whose global numbers are ``base`` and these."""
    import decimal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        live = np.bitwise_count(s.words).sum(axis=1) >= least
        rows = max(16, 8_000_000 // max(s.bars, 1))
        behind = first[-1] + 1 if first else 0
        for b in batches:
            for at in range(0, b.num_rows, rows):
                local = b.column(0).slice(at, rows).to_numpy() + low
                combos = unrank(local, len(s.names) - behind, k - len(first)) + behind
                if first:
                    combos = np.concatenate((np.tile(np.array(first, np.int64), (len(combos), 1)), combos), axis=1)
                ok = allowed(combos, s) & (short | live[combos].all(axis=1))
                local, combos = local[ok], combos[ok]
                if not len(local):
                    continue
                who, m = score(s, combos, least, stacking, sizing, short)
                good = m["max_drawdown"] <= max_drawdown
                who, m = who[good], {x: v[good] for x, v in m.items()}
                m["combo_id"] = [decimal.Decimal(base + i) for i in local[who].tolist()]
                m["depth"] = np.full(len(who), k)
                m["features"] = combos[who].tolist()
                m["combination"] = [" && ".join(s.names[x] for x in c) for c in m["features"]]
                kinds = [pa.decimal128(38, 0), pa.int32(), pa.list_(pa.int32()), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 8]
                yield pa.record_batch([pa.array(m[c], t) for c, t in zip(names, kinds)], names)

    return spark.range(0, high - low, 1, partitions or max(1, min(2 * spark.sparkContext.defaultParallelism, -(-(high - low) // 2_000)))).mapInArrow(run, RESULT)


def evaluate(spark: SparkSession, setup: Setup, depth: int, least: int = 1, max_drawdown: float = math.inf, stacking: bool = False, sizing: Sizing | None = None, start: int = 0, stop: int | None = None, partitions: int | None = None, short: bool = False) -> DataFrame:
    """Score the combinations numbered ``start`` to ``stop``: those with ``least`` trades and a drawdown within the cap, under their true global numbers; with ``short`` also those with fewer trades (see ``score``).

    A depth is one range, or where its numbers exceed 64 bits a range for each of some first elements; a range counts from 0."""
    ship_package(spark)
    n, sizing = len(setup.names), sizing or Sizing()
    shared = spark.sparkContext.broadcast(setup)
    stop = min(stop if stop is not None else total(n, depth), total(n, depth))
    out, before = None, 0
    names = [x.split()[0] for x in RESULT.split(", ")]
    for k in range(1, depth + 1):
        size = math.comb(n, k)
        low, high, base = max(start - before, 0), min(stop - before, size), before
        before += size
        if low >= high:
            continue

        for first, lo, hi, offset in ranges(low, high, n, k):
            part = _range(spark, shared, names, first, k, lo, hi, base + offset, least, max_drawdown, stacking, sizing, partitions, short)
            out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def evaluate_pairs(df: DataFrame, predicates: list[Predicate], columns: dict[str, Column]) -> DataFrame:
    """Support of all pairs without arrays: hits (predicate, bar) joined on the bar, as baskets are; for series of any number and length. name_a, name_b, mask_hits, gated, total_return (stacking)."""
    hits = df.select("series_id", "bar_idx", *[c.alias(k) for k, c in columns.items()], F.array_compact(F.array(*[F.when(p.column(), F.lit(i)) for i, p in enumerate(predicates)])).alias("on"))
    pairs = hits.select("_gate", "_reward", F.explode(F.flatten(F.transform("on", lambda a: F.transform(F.filter("on", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    names = F.array(*[F.lit(p.name) for p in predicates])
    g = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("mask_hits"), F.count_if("_gate").alias("gated"), F.sum(F.when(F.col("_gate"), F.col("_reward")).otherwise(0.0)).alias("total_return"))
    return g.select(F.element_at(names, F.col("a") + 1).alias("name_a"), F.element_at(names, F.col("b") + 1).alias("name_b"), "mask_hits", "gated", "total_return")


def dead_matrix(names: list[str], pairs: DataFrame, least: int) -> np.ndarray:
    """Which pairs of predicates (as numbers, the smaller first) have fewer than ``least`` gated bars: no combination that holds one has so many trades. ``pairs``: those of ``evaluate_pairs``, which leaves out pairs that no bar meets."""
    number, out = {x: i for i, x in enumerate(names)}, np.triu(np.ones((len(names), len(names)), bool), 1)
    for r in pairs.where(F.col("gated") >= least).select("name_a", "name_b").collect():  # a row for each live pair of the catalog
        a, b = sorted((number[r.name_a], number[r.name_b]))
        out[a, b] = False
    return out


def dead_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs with too few gated rows; a deeper combination that holds one can be skipped when stacking."""
    return pairs.where(F.col("gated") < least).select("name_a", "name_b")


def without_dead(combos: DataFrame, dead: DataFrame) -> DataFrame:
    """Combinations (with ``names``, an array) that hold no dead pair; ``dead`` has a row for each pair of predicates at most."""
    pairs = F.flatten(F.transform("names", lambda a: F.transform(F.filter("names", lambda b: F.array_position("names", b) > F.array_position("names", a)), lambda b: F.struct(a.alias("name_a"), b.alias("name_b")))))
    bad = combos.select("combo_id", F.explode(pairs).alias("p")).select("combo_id", "p.*").join(dead, ["name_a", "name_b"]).select("combo_id").distinct()
    return combos.join(bad, "combo_id", "left_anti")
