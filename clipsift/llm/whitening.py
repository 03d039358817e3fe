"""Embedding whitening by a one-sided Jacobi singular value decomposition of what TSQR leaves.

The fit list is each distinct vector once. Its rows are centred exactly (``n * x - S`` in whole numbers) and compressed to a
triangular R: each task reduces its rows block by block, and R's of tasks are reduced ``FAN`` at a time until one is left for each
dimension. Plane rotations then make R's columns orthogonal; the accumulated rotations are the components, and the columns' lengths
the standard deviations, accurate also for small ones, as no product of R with itself is formed.

What reaches the driver is, for each dimension d of vectors that occurs, d sums and d * d numbers of R, whatever the number of rows.

Defined results: vectors that are null or hold a null or non-finite entry take no part; empty vectors have no components, so no
rows; vectors of different dimensions are spaces of their own, with models of their own; repeated rows and ids, null ids too, each
give their own rows; fewer than four dimensions give as many components. A component without variance (fewer distinct vectors than
dimensions, or equal ones) has ``whitened`` and ``explained`` 0 and no part in ``identity_error``. Entries whose whole number is
beyond a long become its ends; sums stay exact in whole numbers of any size, and a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm._common import cut, drop_cut, stacked, whole_vectors

#: Rows of a block that one QR step takes, and R's that one task reduces to one.
BLOCK, FAN = 4096, 64
_SAFE = 1 << 62
MOMENTS = pa.schema([("dimension", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("s", pa.string())])
TRIANGLES = pa.schema([("dimension", pa.int32()), ("part", pa.int64()), ("r", pa.binary())])
PRODUCTS = pa.schema([("dimension", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, matrix, rows) for each dimension among the vectors of a batch of (..., x)."""
    x = batch.column(batch.num_columns - 1)
    sizes = pa.compute.binary_length(x).to_numpy(zero_copy_only=False) // 8
    for d in np.unique(sizes[sizes > 0]).tolist():
        some = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
        yield d, stacked(some.column(batch.num_columns - 1)), some


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit numbers where they fit, else Python's."""
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1024, -(-max(map(abs, sums)) // n))
    if 2 * n * most < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def reduced(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the rows under those that ``r`` stands for."""
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of ``r``: rotations of pairs of columns until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs that rotate together.
    """
    d = r.shape[1]
    first = np.argsort(-(r * r).sum(axis=0), kind="stable")
    u, v = r[:, first].astype(np.float64), np.eye(d)[:, first]
    ring = np.arange(d + d % 2)  # with an odd number of columns, one rests in each round
    eps = np.finfo(np.float64).eps
    floor = (eps * np.sqrt((u * u).sum())) ** 2
    for _ in range(sweeps):
        still = True
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (i < d) & (j < d)
            i, j = np.minimum(i, j)[real], np.maximum(i, j)[real]
            p, q, c = (u[:, i] ** 2).sum(axis=0), (u[:, j] ** 2).sum(axis=0), (u[:, i] * u[:, j]).sum(axis=0)
            turn = (np.abs(c) > eps * np.sqrt(p * q)) & (p > floor) & (q > floor)
            if turn.any():
                still = False
                i, j, p, q, c = i[turn], j[turn], p[turn], q[turn], c[turn]
                zeta = (q - p) / (2 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cs = 1 / np.hypot(1, t)
                sn = cs * t
                for m in (u, v):
                    m[:, i], m[:, j] = cs * m[:, i] - sn * m[:, j], sn * m[:, i] + cs * m[:, j]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if still:
            break
    lengths = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


@dataclass
class Model:
    """The fit of one dimension: rows and sums of the fit list, directions scaled to whiten, shares of variance."""

    n: int
    sums: list[int]
    scaled: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def whitened(self, deviation: np.ndarray) -> np.ndarray:
        return (deviation / self.n).astype(np.float64) @ self.scaled


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Dimension -> (rows, sums of each entry), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, x, _ in by_dimension(batch):
                wide = len(x) * (int(np.abs(x.astype(np.float64)).max()) + 1024) >= _SAFE
                n, s = held.get(d, (0, 0))
                held[d] = (n + len(x), s + (x.astype(object) if wide else x).sum(axis=0).astype(object))
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_pylist([{"dimension": d, "place": k, "n": n, "s": str(v)} for k, v in enumerate(s)], MOMENTS)

    parts = fit.mapInArrow(run, "dimension int, place int, n long, s string")
    got = parts.groupBy("dimension", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(got, key=lambda r: (r.dimension, r.place)):
        out.setdefault(r.dimension, (r.n, []))[1].append(int(r.s))
    return out


def triangles(fit: DataFrame, stats: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Dimension -> R of the centred fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x, _ in by_dimension(batch):
                n, sums = stats[d]
                for a in range(0, len(x), max(BLOCK, d)):
                    rows = (deviations(x[a : a + max(BLOCK, d)], n, sums) / n).astype(np.float64)
                    held[d] = reduced(held.get(d), rows)
        part = TaskContext.get().partitionId()
        for d, r in held.items():
            yield pa.RecordBatch.from_pylist([{"dimension": d, "part": part, "r": r.tobytes()}], TRIANGLES)

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d, part = key
        r = None
        for one in rows.sort_values("part")["r"]:
            r = reduced(r, np.frombuffer(one).reshape(-1, d))
        return pd.DataFrame({"dimension": [d], "part": [part], "r": [r.tobytes()]})

    left = cut(fit.mapInArrow(run, "dimension int, part long, r binary"), "triangles")
    while left.groupBy("dimension").count().where("count > 1").take(1):
        fewer = cut(left.groupBy("dimension", F.floor(F.col("part") / FAN).alias("to")).applyInPandas(together, left.schema), "triangles")
        drop_cut(left)
        left = fewer
    out = {row.dimension: np.frombuffer(row.r).reshape(-1, row.dimension) for row in left.collect()}
    drop_cut(left)
    return out


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Dimension -> largest absolute entry of the whitened fit list's covariance less the identity, over components with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x, _ in by_dimension(batch):
                m = models[d]
                w = m.whitened(deviations(x, m.n, m.sums))
                w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                held[d] = held.get(d, 0) + w.T @ w
        for d, s in held.items():
            yield pa.RecordBatch.from_pylist([{"dimension": d, "i": i, "j": j, "s": float(s[i, j])} for i in range(len(s)) for j in range(len(s))], PRODUCTS)

    found: dict[int, dict] = {}
    for r in fit.mapInArrow(run, "dimension int, i int, j int, s double").groupBy("dimension", "i", "j").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r.dimension, {})[r.i, r.j] = r.s
    out = {}
    for d, s in found.items():
        m = models[d]
        k = [i for i in range(m.scaled.shape[1]) if m.explained[i] > 0]
        mean = {i: s[i, m.scaled.shape[1]] / m.n for i in k}  # of centred rows: nothing but rounding
        out[d] = max((abs(s[i, j] / m.n - mean[i] * mean[j] - (i == j)) for i in k for j in k), default=0.0)
    return out


def fit_models(fit: DataFrame, components: int) -> dict[int, Model]:
    """Dimension -> model of the distinct vectors ``fit`` (x)."""
    stats = moments(fit)
    models = {}
    for d, r in triangles(fit, stats).items():
        n, sums = stats[d]
        lengths, v = jacobi(r)
        lengths = np.where(lengths > max(n, d) ** 0.5 * d * np.finfo(np.float64).eps * lengths[0], lengths, 0.0)
        k = min(components, d)
        share = lengths**2 / max((lengths**2).sum(), np.finfo(np.float64).tiny)
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(lengths[:k] > 0, v[:, :k] / (lengths[:k] / np.sqrt(n)), 0.0)
        models[d] = Model(n, sums, scaled, share[:k].tolist())
    for d, error in identity_errors(fit, models).items():
        models[d].identity_error = error
    return models


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that takes part."""
    vectors = whole_vectors(rows, id_col, vector_col)
    fit = cut(vectors.select("x").distinct(), "fit")
    models = fit_models(fit, components)
    drop_cut(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, x, some in by_dimension(batch):
                m = models[d]
                dev = deviations(x, m.n, m.sums)
                if d * (int(np.abs(dev.astype(np.float64)).max()) + 1024) ** 2 < _SAFE:
                    total = pa.array((dev * dev).sum(axis=1).astype(np.int64))
                else:
                    exact = (dev.astype(object) ** 2).sum(axis=1)
                    total = pa.array([int(t) if t < 1 << 63 else None for t in exact], pa.int64())
                w = m.whitened(dev)
                k = w.shape[1]
                each = np.repeat(np.arange(len(x)), k)
                columns = [some.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)), total.take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(each), m.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
