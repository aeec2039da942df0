"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a text (trimmed; windows of blank lines aside) are one window, known by 128 bits of hash.
The first occurrence of a window in the order of (doc_id, text key, position) stays; each later occurrence covers its
three lines, covered positions are merged, and covered lines go.

Defined results: a null text stays null and an empty one empty. A text of fewer than three lines has no window and stays
whole. Rows with the same doc_id and text are one document and get the same result; a null doc_id sorts first.
Extra columns pass through unchanged. All steps are DataFrame functions; a window that holds a large share of all rows is summed before
the shuffle and met again in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_prefix, text_key

SPAN = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, pos, h1, h2: a row for each window."""
    keyed = docs.select("doc_id", *text_key(), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= SPAN)
    keyed = keyed.select("doc_id", "k1", "k2", F.transform("lines", F.trim).alias("lines"))
    three = F.transform(
        F.sequence(F.lit(0), F.size("lines") - SPAN),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get("lines", i + k) for k in range(SPAN)]).alias("h1"),
            F.xxhash64(F.lit(7), *[F.get("lines", i + k) for k in reversed(range(SPAN))]).alias("h2"),
            (F.concat(*[F.get("lines", i + k) for k in range(SPAN)]) != "").alias("said"),
        ),
    )
    return keyed.select("doc_id", "k1", "k2", F.inline(three)).where("said").drop("said")


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, gone: the merged positions that later occurrences cover; a row for each document that loses lines."""
    w = windows(docs)
    at = F.struct("doc_id", "k1", "k2", "pos")
    first = cut(w.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = w.join(first, ["h1", "h2"]).where(at != F.col("first"))
    lines = F.array_distinct(F.flatten(F.collect_set(F.array(*[F.col("pos") + k for k in range(SPAN)]))))
    return later.groupBy("doc_id", "k1", "k2").agg(lines.alias("gone"))


def _cleaned(docs: DataFrame, p: str) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and {p}lines, {p}removed: how many lines there were, and how many went."""
    gone = covered(docs).select(*[F.col(c).alias(f"{p}{c}") for c in ("doc_id", "k1", "k2", "gone")])
    keyed = docs.select(*[F.col(c) for c in docs.columns], *[k.alias(f"{p}{n}") for k, n in zip(text_key(), ("h1", "h2"))])
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(f"{p}doc_id")) & (F.col(f"{p}h1") == F.col(f"{p}k1")) & (F.col(f"{p}h2") == F.col(f"{p}k2")), "left")
    lines, out = F.split("text", "\n", -1), F.col(f"{p}gone")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i))
    clean = F.when(out.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        *[clean.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("int").alias(f"{p}lines"),
        F.coalesce(F.size(out), F.lit(0)).cast("int").alias(f"{p}removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_lines``, ``n_removed`` (which replace columns of these names)."""
    p = own_prefix(docs)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _cleaned(docs, p).select(*own, F.col(f"{p}lines").alias("n_lines"), F.col(f"{p}removed").alias("n_removed"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``: texts without repeated windows, n_chars renewed where lines went; a document all of whose lines are later occurrences goes."""
    p = own_prefix(docs)
    went = F.col(f"{p}removed")
    out = _cleaned(docs, p).where((went == 0) | (went < F.col(f"{p}lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(went > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, text, unnest(range(1, len(lines) - 1)) AS pos, lines FROM d WHERE len(lines) >= 3),
x AS (SELECT doc_id, text, pos, trim(lines[pos]) AS a, trim(lines[pos + 1]) AS b, trim(lines[pos + 2]) AS c FROM w),
y AS (SELECT * FROM x WHERE a || b || c <> ''),
r AS (SELECT doc_id, text, pos, dense_rank() OVER (PARTITION BY a, b, c ORDER BY doc_id, md5(text), pos) AS rn FROM y),
g AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS gone FROM r WHERE rn > 1),
s AS (SELECT doc_id, text, list(gone) AS gone FROM g GROUP BY doc_id, text)
SELECT d.doc_id,
       CASE WHEN s.gone IS NULL THEN d.text
            ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(s.gone, i)], chr(10)) END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(lines) END AS INTEGER) AS n_lines,
       CAST(coalesce(len(s.gone), 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN s ON d.doc_id = s.doc_id AND d.text = s.text
"""
