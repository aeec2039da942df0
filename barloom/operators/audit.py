"""Whether a frame and the catalog's lists of features agree: columns that no list names, and names that no column bears out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order
from .catalog import RANGES, Range
from .features import BOOLEANS, CONTINUOUS
from .targets import drop_targets

FINDINGS = "finding string, name string, kind string, p1 double, p99 double, low double, high double"
_WHOLE, _REAL = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
_KEYS = ("series_id", "bar_idx")


def audit(df: DataFrame, flags: list[str] = BOOLEANS, numbers: list[str] = CONTINUOUS, ranges: dict[str, Range] = RANGES) -> DataFrame:
    """A row for each disagreement, ordered by finding and name.

    ``flag not listed``: a boolean column, or an integer one of only 0 and 1, that ``flags`` lacks; ``number not listed``: a float column with at least two finite values that ``numbers`` lacks, with its 1st and 99th percentile (at the place
    below) and its ends; targets and the frame's keys are left out. ``flag missing``, ``number missing``: a listed name without a column; ``flag unfit``: neither boolean nor 0 and 1; ``number unfit``: no float, or one of only 0 and 1.
    ``range off``, ``range of a target``, ``range without number``, ``number without range``: where ranges and ``numbers`` part. An empty frame has no unlisted integers or numbers. All columns share one aggregate, and percentiles three passes."""
    kinds = dict(df.dtypes)
    free = [x for x in drop_targets(df.columns) if x not in _KEYS]
    asked = {x for x in free if x not in flags and kinds[x] in _WHOLE} | {x for x in flags if kinds.get(x) in _WHOLE} | {x for x in numbers if kinds.get(x) in _REAL}
    loose = [x for x in free if x not in numbers and kinds[x] in _REAL]
    finite = {x: F.when(~F.isnan(F.col(f"`{x}`")) & (F.abs(F.col(f"`{x}`")) != float("inf")), F.col(f"`{x}`").cast("double")) for x in loose}
    checks, order_of = [F.count(F.lit(1)).alias("rows")], sorted(asked)
    for i, x in enumerate(order_of):
        v = F.col(f"`{x}`")
        checks += [F.count(v).alias(f"n{i}"), F.count_if(v.isNotNull() & ~v.isin(0, 1)).alias(f"o{i}")]
    for i, x in enumerate(loose):
        checks += [F.count(finite[x]).alias(f"c{i}"), F.min(finite[x]).alias(f"a{i}"), F.max(finite[x]).alias(f"b{i}")]
    r = df.agg(*checks).first()
    binary = {x: r[f"n{i}"] > 0 and r[f"o{i}"] == 0 for i, x in enumerate(order_of)}
    out: list[tuple] = [("flag not listed", x, kinds[x]) for x in free if x not in flags and (kinds[x] == "boolean" or binary.get(x, False) and kinds[x] in _WHOLE)]
    held = {x: (r[f"a{i}"], r[f"b{i}"]) for i, x in enumerate(loose) if r[f"c{i}"] >= 2}
    places = order.column_quantiles(df, {x: finite[x] for x in held}, [0.01, 0.99], truncated=True) if held else {}
    out += [("number not listed", x, kinds[x], *places[x][1], *held[x]) for x in held]
    out += [("flag missing", x, None) for x in flags if x not in kinds]
    out += [("flag unfit", x, kinds[x]) for x in flags if x in kinds and kinds[x] != "boolean" and not binary.get(x, False)]
    out += [("number missing", x, None) for x in numbers if x not in kinds]
    out += [("number unfit", x, kinds[x]) for x in numbers if x in kinds and (kinds[x] not in _REAL or binary[x])]
    off = {x for x, own in ranges.items() if not own.on}
    of_target = set(ranges) - set(drop_targets(list(ranges)))
    out += [("range off", x, None) for x in off] + [("range of a target", x, None) for x in of_target]
    out += [("range without number", x, None) for x in ranges if x not in off | of_target and x not in numbers]
    out += [("number without range", x, None) for x in numbers if x not in ranges]
    return df.sparkSession.createDataFrame([(*x, *[None] * (7 - len(x))) for x in sorted(out, key=lambda x: x[:2])], FINDINGS)
