"""Ranks, quantiles and ordered pairs of groups of any size, without a group in one task.

Distinct values are counted first. The values of a large group are dealt to ranges between quantiles of them; ranges are counted, and
a value's place is what lies in the ranges before its own and before it within. Cuts only say how the work is dealt: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a group from which it is dealt to ranges, and their number.
LIMIT, RANGES = 1 << 16, 256
#: Cells of a group from which its pairs are counted by ranges and not by joining them.
CELLS = 1024


def _cuts(x: str, ranges: int) -> Column:
    return F.percentile_approx(F.col(x).cast("double"), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]))


def _same(a: DataFrame, b: DataFrame, names: Iterable[str], prefix: str = "_k_") -> list[Column]:
    return [a[c].eqNullSafe(b[prefix + c]) for c in names]


def _as(df: DataFrame, names: Iterable[str], *more: str | Column, prefix: str = "_k_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in names], *more)


def value_ranks(df: DataFrame, keys: Sequence[str], x: str, limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """(*keys, x, peers, below, rows, n, distinct) of each distinct value: rows that have it and that have less (nulls are least),
    all rows of the group and those that aren't null, and how many values differ."""
    values = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("peers"))
    large = values.groupBy(*keys).agg(F.count(x).alias("_d"), _cuts(x, ranges).alias("_cuts")).where(F.col("_d") > limit)
    large = _as(large, keys, "_cuts")
    cut = values.join(large, _same(values, large, keys), "left") if keys else values.join(large, F.lit(True), "left")  # one row without keys
    place = F.size(F.filter("_cuts", lambda c: c < F.col(x).cast("double")))
    cut = cut.select(*keys, x, "peers", F.when(F.col("_cuts").isNotNull() & F.col(x).isNotNull(), place).otherwise(0).alias("_range"))
    known = F.col(x).isNotNull()
    totals = cut.groupBy(*keys, "_range").agg(F.sum("peers").alias("_t"), F.sum(F.when(known, F.col("peers")).otherwise(0)).alias("_n"), F.count(x).alias("_d"))
    group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_range", ahead.alias("_ahead"), F.sum("_t").over(group).alias("rows"), F.sum("_n").over(group).alias("n"), F.sum("_d").over(group).alias("distinct"))
    totals = _as(totals, [*keys, "_range"], "_ahead", "rows", "n", "distinct")
    inside = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.withColumn("_inside", F.coalesce(F.sum("peers").over(inside), F.lit(0)))
    met = counted.join(totals, _same(counted, totals, [*keys, "_range"]))
    return met.select(*keys, x, "peers", (F.col("_ahead") + F.col("_inside")).alias("below"), "rows", "n", "distinct")


def with_ranks(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """``df`` with a struct (below, peers, rows, n, distinct) of the place of column ``columns[name]`` in its group as each ``name``."""
    for name, x in columns.items():
        found = value_ranks(df, keys, x, limit, ranges)
        found = found.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, x)], F.struct("below", "peers", "rows", "n", "distinct").alias(f"_r_{name}"))
        df = df.join(found, _same(df, found, [*keys, x])).select(*df.columns, F.col(f"_r_{name}").alias(name))
    return df


def average_rank(place: str) -> Column:
    """1-based rank, ties sharing their mean."""
    return F.col(f"{place}.below") + 1 + (F.col(f"{place}.peers") - 1) / 2.0


def mid_percentile(place: str) -> Column:
    """Share of the others below, ties counting half; 0.5 where all are equal."""
    n, flat = F.col(f"{place}.n"), (F.col(f"{place}.n") < 2) | (F.col(f"{place}.distinct") < 2)
    return F.when(flat, F.lit(0.5)).otherwise((average_rank(place) - 1) / F.when(flat, F.lit(1)).otherwise(n - 1))


def centred_percentile(place: str) -> Column:
    """``mid_percentile`` on -1 to 1; 0 where all are equal or there is one."""
    return 2 * mid_percentile(place) - 1


def strict_percentile(place: str) -> Column:
    """Share of the others strictly below; 0 for a single row."""
    rows = F.col(f"{place}.rows")
    return F.when(rows < 2, F.lit(0.0)).otherwise(F.col(f"{place}.below") / F.greatest(rows - 1, F.lit(1)))


def quantiles(df: DataFrame, keys: Sequence[str], x: str, probabilities: Sequence[float], limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """(*keys, q): exact quantiles of the values that aren't null, interpolated between neighbours; null where there are none."""
    v = value_ranks(df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x")), keys, "_x", limit, ranges)
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("peers")), F.col("_x")))
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    found = v.groupBy(*keys).agg(F.max("n").alias("n"), *[at(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(places)], *[at(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(places)])
    mixed = [F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}")) for i, p in enumerate(places)]
    return found.select(*keys, F.array(*mixed).alias("q"))


# --- ordered pairs


def weighted_pairs(a: np.ndarray, p: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Over pairs with a lower and a higher ``a``: the summed products of weights where ``p`` is higher too, and where it is equal.

    Two values of a differ first in one bit of their ranks; a pass for each bit sorts by what is above it and by p, and running
    sums over rows with the bit clear serve those with it set.
    """
    if len(a) < 2:
        return 0.0, 0.0
    rank, p = np.unique(a, return_inverse=True)[1], np.unique(p, return_inverse=True)[1]
    by_p = np.argsort(p, kind="stable")
    rank, p, w = rank[by_p], p[by_p], w[by_p].astype(np.float64)
    right = tied = 0.0
    for bit in range(int(rank.max()).bit_length()):
        above = rank >> (bit + 1)
        order = np.argsort(above, kind="stable")
        group, q, upper = above[order], p[order], (rank[order] >> bit & 1).astype(bool)
        lower = np.concatenate([[0.0], np.cumsum(np.where(upper, 0.0, w[order]))])
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (q[1:] != q[:-1])]))
        which = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (q[1:] != q[:-1])])) - 1
        ends = np.append(new[1:], len(group))
        base = lower[np.searchsorted(group, group)]  # where the row's group begins
        less, upto = lower[new][which] - base, lower[ends][which] - base
        right += float((w[order] * less)[upper].sum())
        tied += float((w[order] * (upto - less))[upper].sum())
    return right, tied


def pair_counts(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, cells_limit: int = CELLS, ranges: int = RANGES) -> DataFrame:
    """(*keys, pairs, right): pairs of rows with different ``actual``, and how many ``predicted`` orders the same way, ties counting half.

    Rows are counted by their two values. Groups of few such cells (rating scales) join them. The cells of others are dealt to
    ranges of both values, a value that is a cut being a range of its own: pairs in different ranges of both are counted from the
    numbers in the ranges, pairs that share a range of ``actual`` or only one of ``predicted`` in tasks that hold that range. Work
    grows with the cells times the logarithm of a range. Rows without keys or ``actual`` take no part; without ``predicted`` their
    pairs are never right.
    """
    cells = df.select(*keys, F.col(actual).cast("double").alias("_a"), F.col(predicted).cast("double").alias("_p")).where(F.col("_a").isNotNull()).dropna(subset=list(keys)).groupBy(*keys, "_a", "_p").agg(F.count(F.lit(1)).alias("_n"))
    marks = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"), _cuts("_a", ranges).alias("_ca"), _cuts("_p", ranges).alias("_cp")).where(F.col("_cells") > cells_limit)
    marks = marks.select(*keys, F.array_distinct("_ca").alias("_ca"), F.array_distinct("_cp").alias("_cp"))
    # two values by value
    few = cells.join(marks.select(*keys), list(keys), "left_anti")
    other = _as(few, keys, F.col("_a").alias("_b"), F.col("_p").alias("_q"), F.col("_n").alias("_m"))
    weight = F.col("_n") * F.col("_m")
    fits = F.when(F.col("_p") > F.col("_q"), 1.0).when(F.col("_p") == F.col("_q"), 0.5).otherwise(0.0)
    joined = few.join(other, [few[k] == other[f"_k_{k}"] for k in keys] + [F.col("_b") < F.col("_a")])
    small = joined.groupBy(*keys).agg(F.sum(weight).cast("long").alias("pairs"), F.sum(weight * fits).alias("right"))
    # by ranges
    place = lambda cuts, x: 2 * F.size(F.filter(cuts, lambda c: c < F.col(x))) + F.array_contains(cuts, F.col(x)).cast("int")
    many = cells.join(marks, list(keys)).select(*keys, "_a", "_p", "_n", place("_ca", "_a").alias("_ra"), place("_cp", "_p").alias("_rp"))
    each = many.groupBy(*keys, "_a").agg(F.sum("_n").cast("decimal(19,0)").alias("_m")).groupBy(*keys)
    totals = each.agg(((F.sum("_m") * F.sum("_m") - F.sum((F.col("_m") * F.col("_m")).cast("decimal(38,0)"))) / 2).cast("long").alias("pairs"))
    rated = many.where(F.col("_p").isNotNull())
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "right double"])

    def sums(of: str, by: str) -> DataFrame:
        def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            right, tied = weighted_pairs(rows[of].to_numpy(), rows["_p"].to_numpy(), rows["_n"].to_numpy())
            return pd.DataFrame([[*key[: len(keys)], right + tied / 2]], columns=[*keys, "right"])

        return rated.where(F.col(by) % 2 == 0).groupBy(*keys, by).applyInPandas(count, schema)

    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs in different ranges of both, and ties in ranges of ``predicted`` that are one value."""
        right, tied = weighted_pairs(rows["_ra"].to_numpy(), rows["_rp"].to_numpy(), rows["_m"].to_numpy())
        for _, some in rows[rows["_rp"] % 2 == 0].groupby("_rp"):
            tied -= weighted_pairs(some["_ra"].to_numpy(), some["_rp"].to_numpy(), some["_m"].to_numpy())[1]
        return pd.DataFrame([[*key, right + tied / 2]], columns=[*keys, "right"])

    grid = rated.groupBy(*keys, "_ra", "_rp").agg(F.sum("_n").alias("_m")).groupBy(*keys).applyInPandas(across, schema)
    found = sums("_a", "_ra").unionByName(sums("_ra", "_rp")).unionByName(grid).groupBy(*keys).agg(F.sum("right").alias("right"))
    large = totals.join(found, list(keys), "left").where("pairs > 0").select(*keys, "pairs", F.coalesce("right", F.lit(0.0)).alias("right"))
    return small.unionByName(large)
