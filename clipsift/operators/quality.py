"""Checks of labels, keys, intervals and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def label_report(labels: DataFrame, documents: DataFrame, key: str, scores: Sequence[str], low: float, high: float) -> DataFrame:
    """(check_name, violations): repeated ids, ids without a document, scores out of range, a constant first score."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    outside = F.lit(False)
    for s in scores:
        outside = outside | ~F.col(s).between(low, high)
    flat = labels.agg((F.count_distinct(scores[0]) <= 1).cast("long").alias("violations")).select(F.lit("no_variance").alias("check_name"), "violations")
    parts = [one("duplicate_id", repeated_keys(labels, [key])), one("unknown_document", labels.join(documents.select(key), key, "left_anti")), one("score_range", labels.where(outside)), flat]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_interval_ok(proposed: Column, start: Column, end: Column, reach: float = 15.0, shortest: float = 5.0, longest: float = 90.0) -> Column:
    """Whether an edited interval stays near its proposal and within the lengths that can be exported."""
    return (F.abs(start - proposed) <= reach) & (end - start).between(shortest, longest)


def report_ok(counts: Sequence[str], percentages: Sequence[str]) -> Column:
    """Counts not negative, percentages from 0 to 100, at least one value; missing values are allowed."""
    ok = F.coalesce(*[F.col(c).cast("double") for c in (*counts, *percentages)]).isNotNull()
    for c in counts:
        ok = ok & F.coalesce(F.col(c) >= 0, F.lit(True))
    for c in percentages:
        ok = ok & F.coalesce(F.col(c).between(0, 100), F.lit(True))
    return ok
