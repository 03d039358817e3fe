"""Joins on intervals and times, without comparing all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_iv: tuple[str, str], right_iv: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows of a key whose half-open intervals overlap.

    Both sides are dealt to time buckets of ``width`` and meet by (key, bucket), so a long video spreads over many tasks; a pair that
    shares several buckets is kept in the first of them. ``width`` should be about the longer side's usual length.
    """
    l = left.withColumn("_lb", F.floor(F.col(left_iv[0]) / width)).withColumn("_b", F.explode(_buckets(F.col(left_iv[0]), F.col(left_iv[1]), width)))
    r = right.withColumn("_rb", F.floor(F.col(right_iv[0]) / width)).withColumn("_b", F.explode(_buckets(F.col(right_iv[0]), F.col(right_iv[1]), width)))
    met = l.join(r, [*keys, "_b"]).where((F.col(left_iv[1]) > F.col(right_iv[0])) & (F.col(left_iv[0]) < F.col(right_iv[1])) & (F.col("_b") == F.greatest("_lb", "_rb")))
    return met.drop("_b", "_lb", "_rb")


def distance_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, low: float, high: float) -> DataFrame:
    """Pairs of rows of a key with ``low`` <= right - left <= ``high``; the right side lies in one bucket, the left looks into those it can reach."""
    width = max(high - low, 1e-9)
    l = left.withColumn("_b", F.explode(_buckets(F.col(left_at) + low, F.col(left_at) + high, width)))
    r = right.withColumn("_b", F.floor(F.col(right_at) / width))
    gap = F.col(right_at) - F.col(left_at)
    return l.join(r, [*keys, "_b"]).where((gap >= low) & (gap <= high)).drop("_b")


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, name: str, slack: float = 0.0) -> DataFrame:
    """Each left row with the largest ``value`` among right rows of its key at or before its time plus ``slack``.

    An as-of join: both sides are sorted by time once and a running maximum passes over them; no pairs are made. Left rows must
    be distinct. ``value`` must not fall as time goes on (a time itself, or a running number).
    """
    return _asof(left, right, keys, left_at, right_at, value, name, slack, True)


def earliest_after(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, name: str, slack: float = 0.0) -> DataFrame:
    """The mirror image: the smallest ``value`` at or after the left row's time less ``slack``."""
    return _asof(left, right, keys, left_at, right_at, value, name, -slack, False)


def _asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, name: str, shift: float, back: bool) -> DataFrame:
    own = F.struct(*[F.col(c) for c in left.columns])
    kind = {f.name: f.dataType for f in right.schema}[value]
    l = left.select(*keys, (F.col(left_at) + shift).alias("_t"), F.lit(1 if back else 0).alias("_side"), own.alias("_row"), F.lit(None).cast(kind).alias("_v"))
    r = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0 if back else 1).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    time = [F.col("_t"), F.col("_side")] if back else [F.desc("_t"), F.desc("_side")]
    running = Window.partitionBy(*keys).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    found = F.max("_v").over(running) if back else F.min("_v").over(running)
    return l.unionByName(r).withColumn(name, found).where(F.col("_row").isNotNull()).select("_row.*", name)


def greedy_matches(pairs: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """(group, left, right, score): best pairs first, each left and right id once; ties go to larger ids.

    A group's pairs (predictions by revealed clips of one experiment) are folded in order as an array.
    """
    ordered = F.sort_array(F.collect_list(F.struct(score, left, right)), asc=False)
    empty = F.array().cast(f"array<struct<{score}:double,{left}:{dict(pairs.dtypes)[left]},{right}:{dict(pairs.dtypes)[right]}>>")

    def step(taken: Column, x: Column) -> Column:
        free = F.forall(taken, lambda y: (y[left] != x[left]) & (y[right] != x[right]))
        return F.when(free, F.array_append(taken, x)).otherwise(taken)

    taken = pairs.groupBy(group).agg(F.aggregate(ordered, empty, step).alias("m"))
    return taken.select(group, F.explode("m").alias("m")).select(group, f"m.{left}", f"m.{right}", f"m.{score}")
