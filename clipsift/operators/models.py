"""Linear models whose sufficient statistics Spark sums; only p x p matrices reach the driver."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.operators.ranking import positions, top_k
from clipsift.operators.vectors import block_products


def gram(df: DataFrame, x: str, size: int) -> DataFrame:
    """(i, j, s): sums of products of vector components, from one aggregation pass without exploding rows."""
    sums = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.get(x, F.lit(i)) * F.get(x, F.lit(j))).alias("s")) for i in range(size) for j in range(size)]
    return df.agg(F.array(*sums).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def _moments(df: DataFrame, x: str, targets: Sequence[str], keys: Sequence[str] = ()) -> dict[tuple, tuple[int, np.ndarray]]:
    """Of each key the number of rows and the Gram matrix of (1, x, targets)."""
    width = len(df.select(x).where(F.col(x).isNotNull()).head()[0])
    every = [F.lit(1.0), *[F.get(x, F.lit(i)) for i in range(width)], *[F.col(t) for t in targets]]
    sums = [F.sum(every[i] * every[j]) for i in range(len(every)) for j in range(i + 1)]
    out = {}
    for row in df.groupBy(*keys).agg(F.array(*sums).alias("m")).collect():  # one row for each fold or group of a model
        m = np.zeros((len(every), len(every)))
        m[np.tril_indices(len(every))] = row["m"]
        m += np.tril(m, -1).T
        out[tuple(row[k] for k in keys)] = (int(m[0, 0]), m)
    return out


def solve_ridge(m: np.ndarray, n_targets: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales, coefficients (standardised features) and intercepts from a Gram matrix; alpha 0 takes the pseudo-inverse."""
    n, p = m[0, 0], len(m) - 1 - n_targets
    means = m[0, 1 : p + 1] / n
    centred = m[1 : p + 1, 1 : p + 1] - n * np.outer(means, means)
    scales = np.sqrt(np.maximum(np.diag(centred), 0) / n)
    scales[scales < 1e-12] = 1.0
    y = m[0, p + 1 :] / n
    cross = (m[1 : p + 1, p + 1 :] - n * np.outer(means, y)) / scales[:, None]
    a = centred / np.outer(scales, scales)
    w = np.linalg.pinv(a) @ cross if alpha == 0 else np.linalg.solve(a + alpha * np.eye(p), cross)
    return means, scales, w, y


def ridge_coefficients(df: DataFrame, x: str, targets: Sequence[str], alpha: float) -> DataFrame:
    """(target, feature, coefficient); feature -1 is the intercept."""
    ((_, m),) = _moments(df, x, targets).values()
    _, _, w, y = solve_ridge(m, len(targets), alpha)
    rows = [(t, -1, float(y[k])) for k, t in enumerate(targets)] + [(t, i, float(w[i, k])) for k, t in enumerate(targets) for i in range(len(w))]
    return df.sparkSession.createDataFrame(rows, "target string, feature int, coefficient double")


def group_folds(groups: Sequence[str], folds: int, seed: int) -> dict[str, int]:
    """Whole groups dealt to folds: sorted, shuffled by the seed, every k-th to a fold."""
    order = sorted(groups)
    random.Random(seed).shuffle(order)
    return {g: k % folds for k, g in enumerate(order)}


def cross_validated(df: DataFrame, group: str, key: str, x: str, target: str, folds: int, alpha: float, seed: int) -> DataFrame:
    """(group, key, fold, actual, predicted): out-of-fold predictions on 1 to 5. A fold's model comes from the other folds' sums."""
    spark = df.sparkSession
    fold = group_folds([r[0] for r in df.select(group).distinct().collect()], folds, seed)
    dealt = df.join(spark.createDataFrame(list(fold.items()), f"{group} string, fold int"), group)
    parts = _moments(dealt, x, [target], ["fold"])
    total = sum(m for _, m in parts.values())
    models = []
    for (k,), (_, own) in parts.items():
        means, scales, w, y = solve_ridge(total - own if len(parts) > 1 else own, 1, alpha)
        slope = w[:, 0] / scales
        models.append((k, float(y[0] - means @ slope), [float(v) for v in slope]))
    known = spark.createDataFrame(models, "fold int, intercept double, slope array<double>")
    dot = F.aggregate(F.zip_with(x, "slope", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
    predicted = F.greatest(F.lit(1.0), F.least(F.lit(5.0), dot))
    return dealt.join(F.broadcast(known), "fold").select(group, key, "fold", F.col(target).alias("actual"), F.round(predicted, 6).alias("predicted"))  # a row for each fold


def _scaled(df: DataFrame, x: str) -> DataFrame:
    """``df`` with ``x`` at mean 0 and deviation 1 a component; one that doesn't vary stays as wide as it is."""
    width = len(df.select(x).head()[0])
    row = df.agg(*[F.avg(F.get(x, F.lit(i))) for i in range(width)], *[F.stddev_pop(F.get(x, F.lit(i))) for i in range(width)]).head()
    scales = [s if s >= 1e-12 else 1.0 for s in row[width:]]
    return df.withColumn(x, F.array(*[(F.get(x, F.lit(i)) - row[i]) / scales[i] for i in range(width)]))


def _newton(measure: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], width: int, l2: float, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Weights that minimise a mean loss of which ``measure`` gives value, gradient and Hessian, plus the L2 term; steps are halved until it falls."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, hessian = measure(w)
        return loss + 0.5 * l2 * w @ w, gradient + l2 * w, hessian + l2 * np.eye(width)

    w = np.zeros(width)
    here = at(w)
    for _ in range(steps):
        step, part = np.linalg.solve(here[2], here[1]), 1.0
        there = at(w - step)
        while there[0] >= here[0] and part >= 1e-8 and np.linalg.norm(part * step) > tolerance * (1.0 + np.linalg.norm(w)):
            part *= 0.5
            there = at(w - part * step)
        if there[0] >= here[0]:
            break
        w, here = w - part * step, there
        if np.linalg.norm(part * step) <= tolerance * (1.0 + np.linalg.norm(w)):
            break
    return w


#: Rows of a block of preferences, pairs of which a task holds at once, and ratings up to which rows with the same features are merged.
PREFERRED, PAIRS, LEVELS = 1 << 13, 1 << 18, 64


def _pairs(rows: pd.DataFrame, near: pd.DataFrame, x: str, target: str) -> tuple[np.ndarray, np.ndarray, Callable[[slice], np.ndarray]]:
    """Features of both sides, and of a slice of the left ones the number of pairs with each of the right in which the left is rated higher."""
    a, b, y, z, n, m = np.stack(rows[x]), np.stack(near[x]), rows[target].to_numpy(), near[target].to_numpy(), rows["n"].to_numpy(float), near["n"].to_numpy(float)
    levels = np.unique(np.concatenate([y, z]))
    if len(levels) > LEVELS:
        return a, b, lambda part: np.outer(n[part], m) * (y[part][:, None] > z[None, :])
    (a, i), (b, j) = (np.unique(v, axis=0, return_inverse=True) for v in (a, b))
    above, below = np.zeros((len(a), len(levels))), np.zeros((len(b), len(levels)))
    np.add.at(above, (i.ravel(), np.searchsorted(levels, y)), n)
    np.add.at(below, (j.ravel(), np.searchsorted(levels, z)), m)
    below = np.cumsum(below, axis=1) - below
    return a, b, lambda part: above[part] @ below.T


def preference_sums(rows: pd.DataFrame, near: pd.DataFrame, x: str, target: str, models: Sequence[tuple[np.ndarray, np.ndarray] | None], width: int) -> np.ndarray:
    """Of each model (scales, weights) the pairs in which one of ``rows`` is rated higher than one of ``near``, their loss, gradient and Hessian.

    Rows of few ratings meet once for all rows with their features; no more than about ``PAIRS`` pairs are held at once.
    """
    out = np.zeros((len(models), 2 + width + width * width))
    rows, near = rows[rows[target].notna()], near[near[target].notna()]
    if rows.empty or near.empty:
        return out
    every, others, counted = _pairs(rows, near, x, target)
    step = max(1, PAIRS // len(others))
    for part in (slice(i, i + step) for i in range(0, len(every), step)):
        pairs = counted(part)
        for s, model in zip(out, models):
            if model is None:
                continue
            scale, w = model
            a, b = every[part] / scale, others / scale
            z = (a @ w)[:, None] - (b @ w)[None, :]
            p = np.exp(-np.logaddexp(0.0, z))  # of being mistaken
            g, c = pairs * p, pairs * p * (1.0 - p)
            across = a.T @ c @ b
            h = (a * c.sum(1)[:, None]).T @ a + (b * c.sum(0)[:, None]).T @ b - across - across.T
            s += [pairs.sum(), (pairs * np.logaddexp(0.0, -z)).sum(), *(g.sum(0) @ b - g.sum(1) @ a), *h.ravel()]
    return out


def pairwise_logistic(df: DataFrame, group: str, x: str, target: str, l2: float) -> DataFrame:
    """(feature, coefficient) of a model of which of two rows of a group is rated higher, on standardised features.

    Rows are counted by their features and rating, and blocks of a group's distinct rows meet blocks of the same group in tasks that
    give sums: of each pair of blocks one loss, gradient and Hessian leaves a task, never a pair. Rows without a group take no part.
    """
    cells = _scaled(df, x).groupBy(group, x, target).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.xxhash64(group, x, target)).persist()
    width = len(df.head()[x])

    def measure(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def judge(_: None, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [preference_sums(rows, near, x, target, [(np.ones(width), w)], width)[0]]})

        parts = block_products(cells, cells, "cell", None, group, judge, "s array<double>", PREFERRED)
        s = np.array(parts.agg(*[F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0.0)) for i in range(2 + width + width * width)]).head())
        n = s[0] or 1.0
        return s[1] / n, s[2 : 2 + width] / n, s[2 + width :].reshape(width, width) / n

    weights = _newton(measure, width, l2)
    cells.unpersist()
    return df.sparkSession.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(weights)], "feature int, coefficient double")


def choice_ranker(options: DataFrame, query: str, option: str, x: str, distance: str, l2: float, seed: int = 42, margin: float = 0.1, most: int = 64) -> DataFrame:
    """(feature, coefficient) of a model that prefers each query's option nearest to the truth, on standardised features.

    The best option (ties to the smaller ``option``) is paired with those more than ``margin`` farther away; of more than ``most``
    such options a query gives the ``most`` with the smallest hash of seed, query and option, so no query outweighs the others.
    """
    o = _scaled(options.select(query, option, x, distance), x)
    best = o.groupBy(query).agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(distance).alias("d")), F.struct(distance, option)).alias("_best"))
    worse = o.join(best, query).where(F.col(distance) > F.col("_best.d") + margin)
    drawn = top_k(worse, [query], [F.xxhash64(F.lit(seed), query, option), F.col(option)], most, "_i")
    pairs = drawn.select(F.zip_with("_best.x", x, lambda p, q: p - q).alias("d")).persist()
    width = len(options.head()[x])

    def measure(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = [F.get("d", F.lit(i)) for i in range(width)]
        z = sum((d[i] * float(w[i]) for i in range(width)), F.lit(0.0))
        loss = F.when(z > 0, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)) - z)
        p = 1.0 / (1.0 + F.exp(z))
        row = np.array(pairs.agg(F.avg(loss), *[F.avg(-p * x) for x in d], *[F.avg(p * (1.0 - p) * a * b) for a in d for b in d]).head(), dtype=float)
        row = np.nan_to_num(row)  # no pairs
        return row[0], row[1 : 1 + width], row[1 + width :].reshape(width, width)

    weights = _newton(measure, width, l2)
    pairs.unpersist()
    return options.sparkSession.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(weights)], "feature int, coefficient double")


#: Groups of a block of draws.
DRAWN = 1024


def cluster_bootstrap(stats: DataFrame, group: str, measures: Mapping[str, tuple[str, str, str, bool]], iterations: int = 10_000, seed: int = 42, block: int = DRAWN) -> DataFrame:
    """(measure, estimate, low, high, improved): two models' difference in each measure, with a 95 % interval from groups drawn with replacement.

    ``measures`` maps a name to columns of ``stats`` (a row for each group): sums for the reference and for the challenger, the sum
    that both are divided by, and whether lower is better. ``improved`` is the share of draws in which the challenger is better.

    As many groups are drawn in each iteration as there are, as one multinomial draw that is split: groups are numbered and dealt to
    blocks, every task draws the same numbers for the blocks from the iteration's seed, and a block deals its own number out to its
    groups. So no draw and no group leaves its task but as sums, and every iteration's draws come to the number of groups exactly.
    """
    columns = sorted({c for m in measures.values() for c in m[:3]})
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(1 << 61))
    rows = positions(stats.select(hashed.alias("_h"), *[F.col(c).cast("double").alias(c) for c in columns]), [], "_h", "_place", width=1 << 49)
    dealt = rows.withColumn("_block", F.floor((F.col("_place") - 1) / block)).drop("_h").persist()
    groups = dealt.count()
    sizes = np.full(-(-groups // block), block)
    if groups:
        sizes[-1] = groups - block * (len(sizes) - 1)
    share = sizes / max(groups, 1)

    def draw(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        k, x = int(key[0]), some.sort_values("_place")[columns].to_numpy()
        out = np.zeros((iterations + 1, len(columns)))
        out[0] = x.sum(axis=0)  # iteration 0 takes every group once
        for i in range(1, iterations + 1):
            own = np.random.default_rng([seed, i]).multinomial(groups, share)[k]
            out[i] = np.random.default_rng([seed, i, k]).multinomial(own, np.full(len(x), 1 / len(x))) @ x
        return pd.DataFrame({"iteration": np.arange(iterations + 1), **{c: out[:, j] for j, c in enumerate(columns)}})

    schema = ", ".join(["iteration int", *[f"`{c}` double" for c in columns]])
    per = dealt.groupBy("_block").applyInPandas(draw, schema).groupBy("iteration").agg(*[F.sum(c).alias(c) for c in columns])
    deltas = [F.struct(F.lit(name).alias("measure"), F.try_divide(F.col(cha) - F.col(ref), F.col(by)).alias("d"), F.lit(low).alias("low")) for name, (ref, cha, by, low) in measures.items()]
    each = per.select("iteration", F.explode(F.array(*deltas)).alias("m")).select("iteration", "m.*").where(F.col("d").isNotNull())
    own = F.when(F.col("iteration") > 0, F.col("d"))
    better = F.when(F.col("low"), own < 0).otherwise(own > 0).cast("int")
    # a row an iteration and measure: their exact quantiles are of one bounded list
    found = each.groupBy("measure").agg(F.max(F.when(F.col("iteration") == 0, F.col("d"))).alias("estimate"), F.percentile(own, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(better).alias("improved"))
    return found.select("measure", F.round("estimate", 6).alias("estimate"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"), F.round("improved", 6).alias("improved"))


def balanced_ridge(df: DataFrame, source: str, x: str, target: str, prior: float) -> DataFrame:
    """(feature, coefficient): a ridge in which every source weighs the same, on features standardised without weights."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    width = len(df.select(x).head()[0])
    shape = df.agg(F.count(F.lit(1)), *[F.avg(F.get(x, F.lit(i))) for i in range(width)], *[F.stddev_pop(F.get(x, F.lit(i))) for i in range(width)]).first()
    n, means, scales = shape[0], shape[1 : width + 1], [s if s >= 1e-6 else 1.0 for s in shape[width + 1 :]]
    weight = F.lit(float(n)) / (F.lit(float(counts.count())) * F.col("_n"))
    z = [(F.get(x, F.lit(i)) - means[i]) / scales[i] for i in range(width)]
    sums = [F.sum(weight * z[i] * z[j]) for i in range(width) for j in range(width)] + [F.sum(weight * z[i] * F.col(target)) for i in range(width)]
    row = np.array(df.join(counts, source).agg(*sums).first(), dtype=float)
    w = np.linalg.solve(row[: width * width].reshape(width, width) + prior * np.eye(width), row[width * width :])
    return df.sparkSession.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(w)], "feature int, coefficient double")


def logistic_gate(df: DataFrame, x: str, label: str, l2: float, steps: int = 25) -> DataFrame:
    """(feature, coefficient) of a logistic model whose classes weigh the same; feature -1 is the intercept, which is not shrunk."""
    width = len(df.head()[x])
    n, positive = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    weight = F.when(F.col(label) > 0.5, n / (2.0 * max(positive, 1))).otherwise(n / (2.0 * max(n - positive, 1)))
    every = [F.lit(1.0), *[F.get(x, F.lit(i)) for i in range(width)]]
    shrink = l2 * np.diag([0.0, *[1.0] * width])
    beta = np.zeros(width + 1)
    for _ in range(steps):
        z = sum((every[i] * float(beta[i]) for i in range(width + 1)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-z))
        g = [F.sum(weight * (F.col(label) - p) * e) for e in every]
        h = [F.sum(weight * p * (1.0 - p) * a * b) for a in every for b in every]
        row = np.array(df.agg(*g, *h).first(), dtype=float) / n
        step = np.linalg.solve(row[width + 1 :].reshape(width + 1, width + 1) + shrink, row[: width + 1] - shrink @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return df.sparkSession.createDataFrame([(i - 1, round(float(v), 6)) for i, v in enumerate(beta)], "feature int, coefficient double")
