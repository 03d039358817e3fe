"""Cross-validation whose folds share every pass: sums over all rows less a fold's own are the sums of its training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.functions.scalars import six
from clipsift.operators.metrics import pair_counts, top_choice
from clipsift.operators.models import PREFERRED, preference_sums, solve_ridge
from clipsift.operators.ranking import positions, top_k
from clipsift.operators.vectors import block_products
from clipsift.sources.snapshots import written


def dealt_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: whole groups in the order of a seeded hash, every ``folds``-th to one fold.

    Groups are numbered in blocks of the hash, so neither they nor their order pass through the driver or one task.
    """
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(1 << 61))
    placed = positions(df.select(group).distinct().withColumn("_h", hashed), [], "_h", "_place", width=1 << 49)
    known = placed.select(F.col(group).alias("_group"), ((F.col("_place") - 1) % folds).cast("int").alias("fold"))
    return df.join(known, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)


def fold_sums(df: DataFrame, measure: Callable[[int, list[np.ndarray]], np.ndarray], columns: Sequence[str]) -> dict[int, np.ndarray]:
    """Fold -> sum over its rows of ``measure(fold, columns of a batch)``, an array of one shape; ``columns`` are arrays or numbers.

    Tasks add up their batches, at most ``FAN`` tasks' sums meet in one, and one array a fold reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            for k in np.unique(fold).tolist():
                some = batch.filter(pa.array(fold == k))
                parts = [_matrix(c) if pa.types.is_list(c.type) else np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in some.columns[1:]]
                held[k] = held.get(k, 0) + measure(k, parts)
        part = TaskContext.get().partitionId()
        for k, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([np.ravel(s)], pa.list_(pa.float64()))], names=["fold", "part", "s"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "part": [0], "s": [np.sum(np.stack(rows["s"]), axis=0)]})

    schema = "fold int, part long, s array<double>"
    sums = df.select("fold", *columns).mapInArrow(run, schema)
    sums = sums.groupBy("fold", F.floor(F.col("part") / FAN)).applyInPandas(add, schema).groupBy("fold").applyInPandas(add, schema)
    return {r.fold: np.array(r.s) for r in sums.collect()}


#: Tasks whose sums meet in one task.
FAN = 64


# --- representations on the same folds


def ablation(df: DataFrame, group: str, key: str, blocks: Sequence[str], variants: Mapping[str, Sequence[str]], targets: Sequence[str], folds: int, alpha: float, seed: int) -> DataFrame:
    """(group, key, fold, variant, actual, predicted): out-of-fold ridge predictions of every variant, the mean of its targets'.

    ``blocks`` are array columns of features; a variant names those that it takes. One pass sums the products of all features and
    targets by fold; each variant of each fold is solved from a principal submatrix of the total less the fold's own, and one more
    pass predicts them all. The variant ``fold_train_mean`` predicts the training mean.
    """
    rows = dealt_folds(df, group, folds, seed).select(group, key, "fold", *blocks, F.array(*[F.col(t).cast("double") for t in targets]).alias("_y"))
    rows = written(rows)  # whatever the features cost, they are found once
    widths = {b: len(rows.select(b).where(F.col(b).isNotNull()).head()[0]) for b in blocks}
    starts = dict(zip(blocks, np.cumsum([0, *widths.values()])[:-1].tolist()))
    places = {name: np.concatenate([np.arange(starts[b], starts[b] + widths[b]) for b in wanted]) for name, wanted in variants.items()}
    width, full = sum(widths.values()), rows.withColumn("_x", F.concat(*blocks))

    def products(_: int, parts: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate([np.ones((len(parts[0]), 1)), *parts], axis=1)
        return every.T @ every

    size = 1 + width + len(targets)
    own = {k: s.reshape(size, size) for k, s in fold_sums(full, products, ["_x", "_y"]).items()}
    total = sum(own.values())
    models: dict[int, list[tuple[np.ndarray, np.ndarray, float]]] = {}
    for k, s in own.items():
        train = total - s if len(own) > 1 else s
        models[k] = [(np.zeros(0, int), np.zeros(0), float((train[0, 1 + width :] / train[0, 0]).mean()))]
        for name in variants:
            at = places[name]
            keep = np.concatenate([[0], 1 + at, np.arange(1 + width, size)])
            means, scales, w, y = solve_ridge(train[np.ix_(keep, keep)], len(targets), alpha)
            slope = (w / scales[:, None]).mean(axis=1)
            models[k].append((at, slope, float(y.mean() - means @ slope)))
    names = ["fold_train_mean", *variants]
    kinds = dict(df.dtypes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x, y = batch.column(2).to_numpy(), _matrix(batch.column(3)), _matrix(batch.column(4))
            out = np.zeros((batch.num_rows, len(names)))
            for k in np.unique(fold).tolist():
                rows = fold == k
                for v, (at, slope, intercept) in enumerate(models[k]):
                    out[rows, v] = x[rows][:, at] @ slope + intercept
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(y.mean(axis=1)), pa.array(list(out), pa.list_(pa.float64()))], names=[group, key, "fold", "actual", "predicted"])

    found = full.select(group, key, "fold", "_x", "_y").mapInArrow(predict, f"{group} {kinds[group]}, {key} {kinds[key]}, fold int, actual double, predicted array<double>")
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("variant"), F.col("predicted").alias("predicted")))
    return found.select(group, key, "fold", "actual", each.alias("v")).select(group, key, "fold", "v.variant", "actual", "v.predicted")


def ablation_report(predictions: DataFrame, group: str, key: str, contest: Sequence[str]) -> DataFrame:
    """(variant, n, mae, hit_rate, regret, pairwise, selected) of ``ablation``; of the variants in ``contest`` one is selected.

    The rule: most groups whose best row is found, then least regret, then most pairs ordered rightly, then the first named.
    """
    predictions = written(predictions.select("variant", group, key, "actual", "predicted"))
    by = ["variant", group]
    tops = top_choice(predictions, by, key, "actual", "predicted").groupBy("variant").agg(F.avg("hit").alias("hit_rate"), F.avg("regret").alias("regret"))
    pairs = pair_counts(predictions, by, "actual", "predicted").groupBy("variant").agg(F.try_divide(F.sum("right"), F.sum("pairs")).alias("pairwise"))
    errors = predictions.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    found = written(errors.join(tops, "variant").join(pairs, "variant", "left").select("variant", "n", *[six(F.col(c)).alias(c) for c in ("mae", "hit_rate", "regret", "pairwise")]))
    place = F.struct("hit_rate", -F.col("regret"), F.coalesce("pairwise", F.lit(0.0)), -F.array_position(F.array(*map(F.lit, contest)), F.col("variant")))
    winner = found.where(F.col("variant").isin(*contest)).agg(F.max_by("variant", place).alias("winner"))
    return found.join(F.broadcast(winner)).withColumn("selected", F.col("variant") == F.col("winner")).drop("winner")  # one row


# --- models that are stepped


Measure = Callable[[np.ndarray], list[tuple[float, np.ndarray, np.ndarray]]]


def newton_folds(measure: Measure, folds: int, width: int, shrink: np.ndarray, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Weights of each fold's model (folds x width), all stepped at once; ``measure`` gives each one's mean loss, gradient and Hessian.

    A model whose loss doesn't fall takes half its step in the next pass while the others go on; each ends where it would alone.
    """

    def at(w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        return [(loss + 0.5 * (shrink * v * v).sum(), g + shrink * v, h + np.diag(shrink)) for v, (loss, g, h) in zip(w, measure(w))]

    w = np.zeros((folds, width))
    here, part = at(w), np.ones(folds)
    step = np.array([np.linalg.lstsq(h, g, rcond=None)[0] for _, g, h in here])
    live = np.ones(folds, bool)
    for _ in range(40 * steps):
        if not live.any():
            break
        there = at(np.where(live[:, None], w - part[:, None] * step, w))
        for k in np.flatnonzero(live):
            small = np.linalg.norm(part[k] * step[k]) <= tolerance * (1.0 + np.linalg.norm(w[k]))
            if there[k][0] >= here[k][0]:
                live[k] = part[k] >= 1e-8 and not small
                part[k] *= 0.5
                continue
            w[k], here[k] = w[k] - part[k] * step[k], there[k]
            live[k], part[k] = not small, 1.0
            step[k] = np.linalg.lstsq(here[k][2], here[k][1], rcond=None)[0]
    return w


def _scales(rows: DataFrame, x: str, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (folds x width) of each fold's training rows; a component that doesn't vary stays as wide as it is."""
    sums = fold_sums(rows, lambda _, p: np.stack([np.full(p[0].shape[1], len(p[0])), p[0].sum(0), (p[0] ** 2).sum(0)]), [x])
    width = len(next(iter(sums.values()))) // 3
    total = sum(sums.values())
    n, s, q = np.moveaxis(np.array([(total - sums.get(k, 0.0)).reshape(3, width) for k in range(folds)]), 1, 0)
    n = np.maximum(n, 1.0)
    deviation = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
    return s / n, np.where(deviation < 1e-12, 1.0, deviation)


def _logistic(w: np.ndarray, fold: int, x: Callable[[int], np.ndarray], sign: np.ndarray, weight: Callable[[int], np.ndarray]) -> np.ndarray:
    """Of each model but ``fold``'s: weight, loss, gradient and Hessian of rows x that should score on the side of ``sign``."""
    out = np.zeros((len(w), 2 + w.shape[1] + w.shape[1] ** 2))
    for k in range(len(w)):
        if k != fold:
            rows, c = x(k), weight(k)
            z = rows @ w[k]
            p = np.exp(-np.logaddexp(0.0, sign * z))  # of being mistaken
            out[k] = np.concatenate([[c.sum(), (c * np.logaddexp(0.0, -sign * z)).sum()], -(c * p * sign) @ rows, ((rows * (c * p * (1 - p))[:, None]).T @ rows).ravel()])
    return out


def _split(total: np.ndarray, folds: int, width: int, counts: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    s = np.reshape(total, (folds, -1))
    n = s[:, 0] if counts is None else counts
    n = np.where(n == 0, 1.0, n)[:, None]
    s = s / n
    return [(r[1], r[2 : 2 + width], r[2 + width :].reshape(width, width)) for r in s]


def _weights(spark_rows: DataFrame, w: np.ndarray) -> DataFrame:
    return spark_rows.sparkSession.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(w)], "fold int, weights array<double>")


def gate_folds(df: DataFrame, group: str, key: str, x: str, label: str, folds: int, l2: float, seed: int) -> DataFrame:
    """(group, key, fold, actual, predicted): out-of-fold probabilities of logistic models whose classes weigh the same in training.

    Every pass over the rows gives loss, gradient and Hessian of all models at their own weights: a row counts in each but its fold's.
    """
    rows = dealt_folds(df, group, folds, seed).withColumn("_y", F.col(label).cast("double")).select(group, key, "fold", x, "_y").persist()
    n, positive = np.zeros(folds), np.zeros(folds)
    for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).collect():
        n[r.fold], positive[r.fold] = r.n, r.p
    n, positive = n.sum() - n, positive.sum() - positive
    width = 1 + len(rows.head()[x])

    def measure(w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def judge(fold: int, parts: list[np.ndarray]) -> np.ndarray:
            every, y = np.concatenate([np.ones((len(parts[0]), 1)), parts[0]], axis=1), parts[1]
            return _logistic(w, fold, lambda _: every, 2.0 * y - 1.0, lambda k: np.where(y > 0.5, n[k] / (2 * max(positive[k], 1)), n[k] / (2 * max(n[k] - positive[k], 1))))

        return _split(sum(fold_sums(rows, judge, [x, "_y"]).values()), folds, width, n)

    w = newton_folds(measure, folds, width, l2 * np.array([0.0, *[1.0] * (width - 1)]), tolerance=1e-10)
    z = F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), x), "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.join(F.broadcast(_weights(df, w)), "fold").select(group, key, "fold", F.col("_y").alias("actual"), six(1.0 / (1.0 + F.exp(-z))).alias("predicted"))  # a row for each fold


def preference_folds(df: DataFrame, group: str, key: str, x: str, target: str, folds: int, l2: float, seed: int) -> DataFrame:
    """(group, key, fold, actual, predicted): out-of-fold scores of models of which of two rows of a group is rated higher.

    As a group lies in one fold, so do its pairs: blocks of a group's distinct rows meet in tasks that give, for every other fold's
    model, one loss, gradient and Hessian. Features are standardised by each model's training rows.
    """
    rows = dealt_folds(df, group, folds, seed)
    rows = rows.select(group, key, "fold", F.col(x).alias("_x"), F.col(target).cast("double").alias("_y")).persist()
    means, scales = _scales(rows, "_x", folds)
    width = scales.shape[1]
    cells = rows.groupBy(group, "fold", "_x", "_y").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.xxhash64(group, "_x", "_y")).persist()
    size = folds * (2 + width + width * width)

    def measure(w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def judge(_: None, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            fold = int(left["fold"].iloc[0])
            return pd.DataFrame({"s": [preference_sums(left, right, "_x", "_y", [None if k == fold else (scales[k], w[k]) for k in range(folds)], width).ravel()]})

        parts = block_products(cells, cells, "cell", None, group, judge, "s array<double>", PREFERRED)
        total = np.zeros(size)
        for s in fold_sums(parts.withColumn("fold", F.lit(0)), lambda _, p: p[0].sum(axis=0), ["s"]).values():
            total = total + s
        return _split(total, folds, width)

    w = newton_folds(measure, folds, width, np.full(width, l2))
    cells.unpersist()
    known = _weights(df, w / scales).join(_weights(df, means).withColumnRenamed("weights", "means"), "fold")
    z = F.aggregate(F.zip_with(F.zip_with("_x", "means", lambda a, m: a - m), "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.join(F.broadcast(known), "fold").select(group, key, "fold", F.col("_y").alias("actual"), six(z).alias("predicted"))  # a row for each fold


def choice_folds(options: DataFrame, group: str, query: str, option: str, x: str, distance: str, folds: int, l2: float, seed: int, margin: float = 0.1, most: int = 64) -> DataFrame:
    """(group, query, option, fold, distance, predicted): out-of-fold scores of models that prefer each query's option nearest to the truth.

    Pairs are drawn as ``models.choice_ranker`` draws them; whole groups of queries (videos) are dealt to folds.
    """
    rows = dealt_folds(options, group, folds, seed)
    rows = rows.select(group, F.col(query).alias("_query"), F.col(option).alias("_option"), "fold", F.col(x).alias("_x"), F.col(distance).cast("double").alias("_d")).persist()
    means, scales = _scales(rows, "_x", folds)
    width = scales.shape[1]
    best = rows.groupBy("_query").agg(F.min_by(F.struct(F.col("_x").alias("x"), F.col("_d").alias("d")), F.struct("_d", "_option")).alias("_best"))
    worse = rows.join(best, "_query").where(F.col("_d") > F.col("_best.d") + margin)
    drawn = top_k(worse, ["_query"], [F.xxhash64(F.lit(seed), "_query", "_option"), F.col("_option")], most, "_i")
    pairs = drawn.select("fold", F.zip_with("_best.x", "_x", lambda p, q: p - q).alias("d")).persist()

    def measure(w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def judge(fold: int, parts: list[np.ndarray]) -> np.ndarray:
            return _logistic(w, fold, lambda k: parts[0] / scales[k], np.ones(len(parts[0])), lambda _: np.ones(len(parts[0])))

        return _split(sum(fold_sums(pairs, judge, ["d"]).values(), np.zeros(folds * (2 + width + width * width))), folds, width)

    w = newton_folds(measure, folds, width, np.full(width, l2))
    pairs.unpersist()
    known = _weights(options, w / scales).join(_weights(options, means).withColumnRenamed("weights", "means"), "fold")
    z = F.aggregate(F.zip_with(F.zip_with("_x", "means", lambda a, m: a - m), "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.join(F.broadcast(known), "fold").select(group, F.col("_query").alias(query), F.col("_option").alias(option), "fold", F.col("_d").alias("distance"), six(z).alias("predicted"))  # a row for each fold
