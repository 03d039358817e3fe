"""Ranks, percentiles, top-k and diverse selection within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import iou


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """1-based rank, ties sharing their mean. Peers are a range of the window that ranks, so both take one sort."""
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (peers - 1) / 2.0


def mid_percentile(x: str, keys: Sequence[str]) -> Column:
    """Share of the others below, ties counting half; 0.5 where all are equal."""
    group = Window.partitionBy(*keys)
    n = F.count(F.col(x)).over(group)
    flat = (n < 2) | (F.max(x).over(group) == F.min(x).over(group))
    return F.when(flat, F.lit(0.5)).otherwise((average_rank(x, keys) - 1) / F.when(flat, F.lit(1)).otherwise(n - 1))


def centred_percentile(x: str, keys: Sequence[str]) -> Column:
    """``mid_percentile`` on -1 to 1; 0 where all are equal or there is one."""
    return 2 * mid_percentile(x, keys) - 1


def strict_percentile(x: str, keys: Sequence[str]) -> Column:
    """Share of the others strictly below; 0 for a single row."""
    return F.percent_rank().over(Window.partitionBy(*keys).orderBy(x))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps no more than k of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def positions(df: DataFrame, keys: Sequence[str], order: str, name: str = "position", width: int = 1 << 16) -> DataFrame:
    """``df`` with its place in each group, from 1, by the whole-number column ``order`` (ties in no fixed order; nulls first).

    A group is dealt to blocks of ``width`` values of ``order``, numbered apart and moved on by the rows of the blocks before, so that
    a group with a third of all rows spreads over tasks; only counts of blocks meet in one window.
    """
    dealt = df.withColumn("_block", F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))))
    on = [*keys, "_block"]
    counts = dealt.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_at_{c}") for c in on], ahead.alias("_ahead"))
    met = dealt.join(starts, [dealt[c].eqNullSafe(starts[f"_at_{c}"]) for c in on])
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy(*on).orderBy(order))
    return met.withColumn(name, place).select(*df.columns, name)


def greedy_diverse(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], k: int, limit: float, rank: str = "rank") -> DataFrame:
    """The k best rows of each group of which no two overlap by more than ``limit``, best first; ``rank`` counts from 1.

    ``order`` is (column, descending), and must tell all rows of a group apart. Each round finds the best row left and strikes
    what overlaps it: k unordered windows on one partitioning, so one shuffle serves all rounds, nothing is gathered into an
    array, and struck rows leave at once. Columns ``start`` and ``end`` are the interval.
    """
    group = Window.partitionBy(*keys)
    # a row's place in the order, as one comparable value
    out = df.withColumn("_place", F.row_number().over(group.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]))).withColumn(rank, F.lit(None).cast("int"))
    for round_ in range(1, k + 1):
        live = F.when(F.col(rank).isNull(), F.struct("_place", "start", "end"))
        out = out.withColumn("_best", F.min(live).over(group))
        own = F.col("_place") == F.col("_best._place")
        apart = iou(F.col("start"), F.col("end"), F.col("_best.start"), F.col("_best.end")) <= limit
        out = out.where(F.col(rank).isNotNull() | own | apart).withColumn(rank, F.when(F.col(rank).isNull() & own, F.lit(round_)).otherwise(F.col(rank)))
    return out.where(F.col(rank).isNotNull()).drop("_place", "_best")


def latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The row of each key with the largest ``by``; a maximum, so partial results meet and not rows."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
