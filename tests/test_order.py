"""Ranks, quantiles, pairs and bootstraps of large groups against loops and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.operators import models, order, ranking

ROWS = "g string, id long, x double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group of real values with one heavy value, a scale, a flat and a single group; nulls and values that aren't finite."""
    r = random.Random(4)
    data = [("hot", i, r.choice([r.gauss(0, 1), 0.25, None if i % 40 == 0 else r.gauss(0, 1)]), r.choice([r.gauss(0, 1), 0.5])) for i in range(900)]
    data += [("scale", i, float(r.randrange(5)), float(r.randrange(4))) for i in range(300)] + [("flat", i, 2.0, 1.0) for i in range(5)] + [("one", 0, 1.0, None)]
    data += [("odd", 0, math.inf, 1.0), ("odd", 1, -math.inf, math.nan), ("odd", 2, -0.0, 0.0), ("odd", 3, 0.0, 2.0), ("odd", 4, None, 3.0)]
    return spark.createDataFrame(data, ROWS).repartition(6).cache()


@pytest.mark.parametrize(("limit", "ranges"), [(1 << 16, 256), (20, 7)])
def test_ranks_equal_windows(rows, limit, ranges):
    df = rows.withColumns({"a": ranking.average_rank("x", ["g"]), "m": ranking.mid_percentile("x", ["g"]), "c": ranking.centred_percentile("x", ["g"]), "s": ranking.strict_percentile("x", ["g"])})
    got = order.with_ranks(df, ["g"], {"at": "x"}, limit, ranges)
    apart = got.where(~(order.average_rank("at").eqNullSafe(F.col("a"))) | (F.abs(order.mid_percentile("at") - F.col("m")) > 1e-12) | (F.abs(order.centred_percentile("at") - F.col("c")) > 1e-12) | (F.abs(order.strict_percentile("at") - F.col("s")) > 1e-12))
    assert got.count() == rows.count() and apart.count() == 0


@pytest.mark.parametrize(("limit", "ranges"), [(1 << 16, 256), (20, 7)])
def test_quantiles_equal_numpy(rows, limit, ranges):
    got = {r.g: r.q for r in order.quantiles(rows.where("g <> 'odd'"), ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0], limit, ranges).collect()}
    for g, q in got.items():
        values = [r.x for r in rows.where(F.col("g") == g).collect() if r.x is not None]
        assert np.allclose(q, np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-12)
    assert set(got) == {"hot", "scale", "flat", "one"}
    alone = order.quantiles(rows.where("g = 'hot'"), [], "x", [0.5], limit, ranges).collect()
    assert len(alone) == 1 and alone[0].q == [got["hot"][2]]


def slow_pairs(values):
    pairs = right = 0
    for a, p in values:
        for b, q in values:
            if a is not None and b is not None and a > b:
                pairs += 1
                right += 0 if p is None or q is None else 1 if p > q else 0.5 if p == q else 0
    return pairs, right


@pytest.mark.parametrize(("cells", "ranges"), [(1024, 256), (10, 5), (0, 3)])
def test_pairs_equal_a_loop(rows, cells, ranges):
    data = rows.where("g <> 'odd'").withColumn("y", F.when(F.col("id") % 31 != 0, F.col("y")))
    got = {r.g: (r.pairs, r.right) for r in order.pair_counts(data, ["g"], "x", "y", cells, ranges).collect()}
    by = {}
    for r in data.collect():
        by.setdefault(r.g, []).append((r.x, r.y))
    assert got == {g: slow_pairs(v) for g, v in by.items() if slow_pairs(v)[0]}


def test_weighted_pairs():
    r = random.Random(6)
    for _ in range(60):
        n = r.randrange(0, 25)
        a, p, w = [r.randrange(6) for _ in range(n)], [r.randrange(5) for _ in range(n)], [r.randrange(1, 4) for _ in range(n)]
        right = sum(w[i] * w[j] for i in range(n) for j in range(n) if a[i] < a[j] and p[i] < p[j])
        tied = sum(w[i] * w[j] for i in range(n) for j in range(n) if a[i] < a[j] and p[i] == p[j])
        assert order.weighted_pairs(np.array(a), np.array(p), np.array(w)) == (right, tied)


def test_bootstrap_intervals(spark):
    """Against numpy's own draws; margins are exact, however groups are dealt."""
    rng = np.random.default_rng(5)
    n = 60
    ref, cha = rng.normal(10, 2, n), rng.normal(10.6, 2, n)
    df = spark.createDataFrame([(f"g{i}", float(ref[i]), float(cha[i]), 1.0) for i in range(n)], "grp string, ref double, cha double, one double").repartition(4)
    wanted = {"up": ("ref", "cha", "one", False), "down": ("ref", "cha", "one", True), "margin": ("one", "ref", "one", False)}
    got = {r.measure: r for r in models.cluster_bootstrap(df, "grp", wanted, iterations=2000, seed=1, block=16).collect()}
    draws = rng.integers(0, n, (20_000, n))
    deltas = (cha - ref)[draws].mean(axis=1)
    assert math.isclose(got["up"].estimate, (cha - ref).mean(), abs_tol=1e-6)
    assert np.allclose([got["up"].low, got["up"].high], np.quantile(deltas, [0.025, 0.975]), atol=0.08) and abs(got["up"].improved - (deltas > 0).mean()) < 0.04
    assert abs(got["down"].improved + got["up"].improved - 1) < 1e-9
    again = {r.measure: r for r in models.cluster_bootstrap(df.repartition(2), "grp", wanted, iterations=2000, seed=1, block=16).collect()}
    assert again == got


def test_draws_come_to_the_number_of_groups(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("grp"), F.lit(1.0).alias("one"), F.lit(50.0 / 50).alias("same"))
    (r,) = models.cluster_bootstrap(df.withColumn("zero", F.lit(0.0)).withColumn("fixed", F.when(F.col("grp") == "0", 50.0).otherwise(0.0)), "grp", {"m": ("zero", "one", "same", False)}, iterations=200, seed=3, block=7).collect()
    assert (r.estimate, r.low, r.high) == (1.0, 1.0, 1.0)
