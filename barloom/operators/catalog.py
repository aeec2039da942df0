"""The catalog of predicates: flags, scalar thresholds and feature pairs, in a fixed order.

Data are touched in two aggregates: percentiles of all range features at once, and support with a hash of each mask. Everything else is a list of
predicates on the driver, whose length depends on the configuration only.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import yes
from . import order
from .features import ANCHORS, BOOLEANS, PAIRED
from .targets import drop_targets

OPERATORS = (">", "<", ">=", "<=")
# Range features, their comparisons, least and greatest threshold, increment, and whether they are on.
RANGE_TABLE = """
rsi_14                    >=,<=   auto auto auto on
rsi_7                     >       auto auto auto on
rsi_21                    >       auto auto auto on
adx                       >=,<=   auto auto auto on
kf_adx                    >=,<=   auto auto auto on
atr_pct                   >       auto auto auto on
volatility_20_cv          >       auto auto auto on
momentum_14               >,<     auto auto auto on
roc_5                     >,<     auto auto auto on
roc_10                    >,<     auto auto auto on
body_size_pct             >       auto auto auto on
consecutive_green         >=      auto auto auto on
bb_position               >=,<=   auto auto auto on
kf_vs_200sma              >=,<=   auto auto auto on
kf_vs_9ema                >=,<=   auto auto auto on
price_vs_9ema_dev         >=,<=   auto auto auto on
price_vs_200sma_dev       >=,<=   auto auto auto on
9ema_to_200sma            >=,<=   auto auto auto on
kf_trend_momentum         >,<     auto auto auto on
kf_atr_momentum_5         >,<     auto auto auto on
kf_atr_c2c_momentum_5     >,<     auto auto auto on
kf_adx_momentum_5         >,<     auto auto auto on
kf_atr_pct                >       auto auto auto on
kf_atr_c2c_pct            >       auto auto auto on
kf_innovation_abs         >       auto auto auto on
kf_adx_innovation_abs     >       auto auto auto on
kf_price_deviation        >=,<=   auto auto auto on
kf_atr_deviation          >,<     auto auto auto on
kf_adx_deviation          >,<     auto auto auto on
kf_atr_vs_c2c             >,<     auto auto auto on
kf_trend_volatility_ratio >,<     auto auto auto on
atr_c2c_pct               >       auto auto auto on
bb_std                    >,<     auto auto auto on
macd                      >=,<=   auto auto auto on
macd_hist                 >=,<=   auto auto auto on
macd_signal               >=,<=   auto auto auto on
stoch_k                   >=,<=   auto auto auto on
stoch_d                   >=,<=   auto auto auto on
ext                       >       auto auto auto on
ext_sma14                 >       auto auto auto on
momentum_score            >=,<=   auto auto auto on
wicks_diff                >       auto auto auto on
wicks_diff_sma14          >       auto auto auto on
kf_wicks_smooth           >       auto auto auto off
bar_range_pct             >       auto auto auto on
body_to_total_wick        >,<     auto auto auto on
body_atr_ratio            >,<     auto auto auto on
trend_strength            >=,<=   auto auto auto on
adx_sma                   >=,<=   auto auto auto on
lower_shadow_ratio        >       auto auto auto on
upper_shadow_ratio        >       auto auto auto on
atr_pct_mean50            >       auto auto auto on
atr_c2c_mean50            >       auto auto auto on
kf_atr                    >       auto auto auto on
kf_atr_c2c                >       auto auto auto on
"""
# The increments to choose from.
INCREMENTS = [m * 10.0**e for e in range(-5, 4) for m in (1, 2, 5)]


@dataclass(frozen=True)
class Range:
    """Comparisons of a feature with thresholds from ``low`` to ``high`` by ``step``; None: found in the data."""

    operators: tuple[str, ...]
    low: float | None = None
    high: float | None = None
    step: float | None = None
    on: bool = True

    def __post_init__(self) -> None:
        wrong = [o for o in self.operators if o not in OPERATORS]
        if wrong:
            raise ValueError(f"unknown operator {', '.join(wrong)}; known are {', '.join(OPERATORS)}")


def _own(value: str | float | None) -> float | None:
    return None if value in (None, "auto") else float(value)


def parse_ranges(table: str) -> dict[str, Range]:
    """Ranges by feature from lines of feature, operators, low, high, step (numbers or ``auto``), on or off."""
    out = {}
    for line in table.strip().splitlines():
        name, ops, low, high, step, on = line.split()
        out[name] = Range(tuple(ops.split(",")), _own(low), _own(high), _own(step), on == "on")
    return out


def ranges_of(text: str) -> dict[str, Range]:
    """Ranges from JSON: an object for each feature with ``operators``, ``min``, ``max``, ``increment`` (numbers or "auto") and perhaps ``enabled``."""
    return {name: Range(tuple(r["operators"]), _own(r["min"]), _own(r["max"]), _own(r["increment"]), r.get("enabled") is not False) for name, r in json.loads(text).items()}


RANGES = parse_ranges(RANGE_TABLE)


@dataclass(frozen=True)
class Predicate:
    """A flag (no operator), a comparison with a constant, or one with another feature."""

    name: str
    base: str
    op: str = ""
    threshold: float | None = None
    rhs: str | None = None

    def column(self) -> Column:
        a = F.col(f"`{self.base}`")
        if not self.op:
            return yes(a.cast("boolean"))
        b = F.lit(self.threshold) if self.rhs is None else F.col(f"`{self.rhs}`")
        fine = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
        test = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[self.op]
        return yes(test & fine(a.cast("double")) & fine(b.cast("double")))

    @property
    def bound(self) -> tuple[str, str] | None:
        """The base and side that a scalar threshold bounds."""
        return (self.base, self.op[0]) if self.op and self.rhs is None else None


def nice(value: float, down: bool) -> float:
    """A bound next to a percentile: 1, 2, 5 or 10 times a power of ten, on the side that ``down`` names; below zero the nearer to zero for the lower and the farther for the upper."""
    if value == 0.0:
        return 0.0
    unit = 10.0 ** math.floor(math.log10(abs(value)))
    steps = [unit, 2 * unit, 5 * unit, 10 * unit]
    under, over = [s for s in steps if s <= abs(value)], [s for s in steps if s >= abs(value)]
    if down:
        return max(under, default=0.0) if value > 0 else -min(under, default=10 * unit)
    return min(over, default=steps[-1]) if value > 0 else -max(over, default=0.0)


def increment(low: float, high: float, operators: int, target: int = 10) -> float:
    """The step that gives next to ``target`` conditions between 5 and 15, else the one next to the ideal."""
    steps = [round(x, 5) for x in INCREMENTS]
    fit = [(abs((math.floor((high - low) / s) + 1) * operators - operators - target), k) for k, s in enumerate(steps) if 5 <= (math.floor((high - low) / s) + 1) * operators - operators <= 15]
    if fit:
        return steps[min(fit)[1]]
    ideal = (high - low) / ((target + operators) / operators)
    return min(steps, key=lambda s: abs(s - ideal))


def thresholds(low: float, high: float, step: float, op: str, exact: bool = False) -> list[float]:
    """low, low + step, ... by adding up, or each as low + i * step (``exact``), without values that can't be met."""
    out, x, i = [], low, 0
    while x <= high + 2.220446049250313e-16:
        if not (op == ">" and x >= high or op == "<" and x <= low):
            out.append(x)
        i += 1
        x = low + step * i if exact else x + step
    return out


def label(value: float, digits: int = 2) -> str:
    """Two decimals, or ``digits``, without trailing zeros but one."""
    text = f"{value:.{digits}f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


#: rows up to which all values of a column may meet in one aggregate
MOST_ROWS = 1_000_000


def percentiles(df: DataFrame, columns: list[str], most: int = MOST_ROWS) -> dict[str, tuple[int, float, float]]:
    """Count, 1st and 99th percentile (linear) of the finite values of all columns: one aggregate over at most ``most`` rows, of more rows by brackets (``order.column_quantiles``). Both are exact."""
    exprs, values = [], {}
    for i, x in enumerate(columns):
        v = F.col(f"`{x}`").cast("double")
        values[x] = v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        exprs += [F.count(v).alias(f"n{i}"), F.percentile(v, F.array(F.lit(0.01), F.lit(0.99))).alias(f"p{i}")]
    if df.count() > most:
        return {x: (n, *q) for x, (n, q) in order.column_quantiles(df, values, [0.01, 0.99]).items()}
    r = df.agg(*exprs).first()
    return {x: (r[f"n{i}"], r[f"p{i}"][0], r[f"p{i}"][1]) for i, x in enumerate(columns) if r[f"p{i}"] is not None}


def threshold_predicates(df: DataFrame, ranges: dict[str, Range] = RANGES, every: bool = False) -> list[Predicate]:
    """Scalar thresholds of the range features; labels that coincide keep the first value, unless ``every`` threshold is wanted: then each is low + i * step, and labels have as many decimals
    as keep them apart. Ranges that are off, of targets or of columns that are no numbers give none."""
    kinds = dict(df.dtypes)
    columns = drop_targets([x for x, r in ranges.items() if r.on and kinds.get(x, "string") not in ("boolean", "string", "timestamp", "date")])
    found = percentiles(df, columns) if columns else {}
    out: dict[str, Predicate] = {}
    for x in sorted(found):
        n, p1, p99 = found[x]
        own = ranges[x]
        low = nice(p1, True) if own.low is None else own.low
        high = nice(p99, False) if own.high is None else own.high
        if n < 2 or low >= high:
            continue
        step = increment(low, high, len(own.operators)) if own.step is None else own.step
        if step <= 0:
            continue
        for op in own.operators:
            values = thresholds(low, high, step, op, every)
            digits = next((k for k in range(2, 13) if len({label(v, k) for v in values}) == len(values)), 13) if every else 2
            for v in values:
                out.setdefault(f"{x}{op}{label(v, digits)}", Predicate(f"{x}{op}{label(v, digits)}", x, op, v))
    if not out:
        floats = [x for x in drop_targets([n for n, t in df.dtypes if t in ("double", "float")])]
        if floats:
            x = floats[0]
            r = df.agg(F.count(F.col(f"`{x}`")).alias("n"), F.min(F.col(f"`{x}`")).alias("a"), F.max(F.col(f"`{x}`")).alias("b")).first()
            if r["n"] >= 2:
                v = (r["a"] + r["b"]) / 2.0
                return [Predicate(f"{x}>{label(v)}", x, ">", v)]
    return list(out.values())


def pair_predicates(columns: list[str], anchors: list[str] = ANCHORS) -> list[Predicate]:
    """Unordered pairs of declared columns, one of them an anchor, each by > and <."""
    known = sorted(x for x in {*ANCHORS, *PAIRED} if x in columns)
    return [Predicate(f"{a}{op}{b}", a, op, None, b) for a, b in itertools.combinations(known, 2) if a in anchors or b in anchors for op in (">", "<")]


def ordered_pairs(columns: list[str], ops: tuple[str, ...] = (">", "<")) -> list[Predicate]:
    """All ordered pairs of different columns."""
    return [Predicate(f"{a}{op}{b}", a, op, None, b) for a, b in itertools.permutations(columns, 2) for op in ops]


def supports(df: DataFrame, predicates: list[Predicate], gate: Column | None = None) -> dict[str, tuple[int, int, int]]:
    """For each predicate the rows that meet it, those that also pass the gate, and an order-free hash of which rows they are: one aggregate, whatever the number of predicates."""
    key = F.xxhash64("series_id", "bar_idx")
    gate = F.lit(True) if gate is None else yes(gate)
    out: dict[str, tuple[int, int, int]] = {}
    for at in range(0, len(predicates), 400):  # so many expressions stay within one generated class each
        part = predicates[at : at + 400]
        exprs = []
        for i, p in enumerate(part):
            m = p.column()
            exprs += [F.count_if(m).alias(f"n{i}"), F.count_if(m & gate).alias(f"g{i}"), F.bit_xor(F.when(m, key)).alias(f"h{i}")]
        r = df.agg(*exprs).first()
        out |= {p.name: (r[f"n{i}"], r[f"g{i}"], r[f"h{i}"] or 0) for i, p in enumerate(part)}
    return out


def duplicates(df: DataFrame, groups: list[list[Predicate]]) -> set[str]:
    """Names of the predicates that hold on just the rows of an earlier one of their group. Groups come by a hash; here rows are compared, so that unlike masks with one hash both stay."""
    out: set[str] = set()
    groups = [g for g in groups if len(g) > 1]
    while groups:
        pairs = [(g[0], p) for g in groups for p in g[1:]]
        differ: list[int] = []
        for at in range(0, len(pairs), 400):
            part = pairs[at : at + 400]
            r = df.agg(*[F.count_if(a.column() != b.column()).alias(f"d{i}") for i, (a, b) in enumerate(part)]).first()
            differ += list(r)
        unlike = iter(differ)
        rest = []
        for g in groups:  # what differs from the first of its group is compared with the first of those
            left = []
            for p in g[1:]:
                if next(unlike):
                    left.append(p)
                else:
                    out.add(p.name)
            rest.append(left)
        groups = [g for g in rest if len(g) > 1]
    return out


def prune(df: DataFrame, predicates: list[Predicate], least: int = 0, gate: Column | None = None, found: dict[str, tuple[int, int, int]] | None = None) -> list[Predicate]:
    """Without predicates that are always or never true, fall below ``least`` gated rows, or equal an earlier one of their kind (flags or comparisons) row by row; first names win. ``found``: supports that are known."""
    n, found = df.count(), found or supports(df, predicates, gate)
    kept: dict[str, Predicate] = {}
    for p in predicates:
        hits, gated, _ = found[p.name]
        if p.name not in kept and hits not in (0, n) and gated >= least:
            kept[p.name] = p
    alike: dict[tuple[bool, int, int], list[Predicate]] = {}
    for p in kept.values():
        alike.setdefault((bool(p.op), found[p.name][0], found[p.name][2]), []).append(p)
    gone = duplicates(df, list(alike.values()))
    return [p for p in kept.values() if p.name not in gone]


def sampling(predicates: list[Predicate], found: dict[str, tuple[int, int, int]], least: int) -> list[tuple[str, int, int, int]]:
    """(kind, total, dropped, eligible) of flags, thresholds and pairs: those with fewer than ``least`` gated rows (by ``supports``) are dropped."""
    kinds = {"flag": [], "threshold": [], "pair": []}
    for p in predicates:
        kinds["flag" if not p.op else "threshold" if p.rhs is None else "pair"].append(found[p.name][1] < least)
    return [(k, len(v), sum(v), len(v) - sum(v)) for k, v in kinds.items()]


def build(df: DataFrame, with_pairs: bool = True, ranges: dict[str, Range] = RANGES) -> list[Predicate]:
    """Flags (constant and duplicate ones dropped), thresholds, pairs; the order is fixed."""
    flags = prune(df, [Predicate(x, x) for x in BOOLEANS if x in df.columns])
    parts = [*flags, *threshold_predicates(df, ranges), *(pair_predicates(df.columns) if with_pairs else [])]
    return list({p.name: p for p in reversed(parts)}.values())[::-1]


def catalog_hash(predicates: list[Predicate]) -> str:
    lines = sorted([f"F|{p.name}" for p in predicates] + [f"S|{p.name}|{p.base}|{p.op}|{'' if p.threshold is None else f'{p.threshold:.10f}'}|{p.rhs or ''}" for p in predicates if p.op])
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def as_table(spark, predicates: list[Predicate]) -> DataFrame:
    schema = "feature_idx int, name string, base string, op string, threshold double, rhs string"
    return spark.createDataFrame([(i, p.name, p.base, p.op, p.threshold, p.rhs) for i, p in enumerate(predicates)], schema)


def to_json(predicates: list[Predicate]) -> str:
    return json.dumps([p.__dict__ for p in predicates])


def from_json(text: str) -> list[Predicate]:
    return [Predicate(**x) for x in json.loads(text)]
