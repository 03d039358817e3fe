"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard.

Vectors are dealt to bands of length (a band's longest is at most ``RATIO`` times its shortest), and a band by hash to shards of
about ``SHARD_ROWS`` nodes, so that within a shard the inner product with a query ranks nearly as the angle does. A shard's graph is
built on directions: greedy searches from the medoid propose neighbours for each node; pruning keeps the nearest and drops what a
kept one is closer to by the relaxed factor ``alpha``, which leaves edges in diverse directions; kept edges are also added the
other way. Beam searches by inner product query every shard, and what they return is scored again in double precision on the
original vectors.

A task holds one shard, and the queries stream past it. The work is queries times shards: with a fixed share of the rows as queries
it grows with the square of the rows, less so the larger ``shard_rows`` is.

Equal vectors are one node that keeps its smallest ids, as many as an answer can use: thousands of copies cost one node, and ties
go to smaller ids.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part; vectors of different
dimensions are in spaces of their own and never each other's answer; of a repeated id the smallest vector counts; fewer candidates
than asked for are all returned if found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.llm._common import cut, drop_cut

#: Nodes of a shard, about, and the ratio of lengths within one.
SHARD_ROWS, RATIO = 8192, 1.25
#: Edges of a node, nodes of a beam while building and while querying, relaxed pruning factor (on squared distances).
DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 32, 64, 96, 1.44
#: Nodes of a beam that are expanded at once, nodes searched at once.
EXPANDED, BATCH = 4, 256


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and inner products, best first, of the beams that searches from ``start`` end with; -1 where a beam is short.

    ``graph`` holds each node's edges, -1 where there are fewer.
    """
    n, b = len(x), len(queries)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1)
    value = np.full((b, beam), -np.inf, dtype=np.float32)
    ids[:, 0], value[:, 0] = start, queries @ x[start]
    open_ = ids >= 0
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, start] = seen[:, n] = True
    while open_.any():
        rank = np.where(open_, np.arange(beam), beam)
        at = np.argsort(rank, axis=1, kind="stable")[:, :EXPANDED]
        live = np.take_along_axis(open_, at, axis=1)
        open_[rows, at] = False
        step = graph[np.where(live, np.take_along_axis(ids, at, axis=1), -1)]
        step = np.where(live[:, :, None], step, -1).reshape(b, -1)
        step = np.where(step < 0, n, step)
        step = np.where(seen[rows, step], n, step)
        step.sort(axis=1)
        step[:, 1:][step[:, 1:] == step[:, :-1]] = n
        seen[rows, step] = True
        keep = int((step < n).sum(axis=1).max(initial=0))
        if not keep:
            continue
        step = np.sort(step, axis=1)[:, :keep]
        real = step < n
        new = np.full(step.shape, -np.inf, dtype=np.float32)
        r, c = np.nonzero(real)
        new[r, c] = np.einsum("ij,ij->i", x[step[r, c]], queries[r])
        all_ids = np.concatenate([ids, np.where(real, step, -1)], axis=1)
        all_value = np.concatenate([value, new], axis=1)
        all_open = np.concatenate([open_, real], axis=1)
        order = np.argsort(-all_value, axis=1, kind="stable")[:, :beam]
        ids, value, open_ = (np.take_along_axis(v, order, axis=1) for v in (all_ids, all_value, all_open))
    return ids, value


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Edges of each node out of its candidates (-1: none): nearest first, unless a kept one is ``alpha`` times nearer to it.

    ``x`` holds unit vectors, so that 1 minus the inner product is half the squared distance.
    """
    n = len(x)
    c = np.sort(np.where((candidates < 0) | (candidates == nodes[:, None]), n, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    c = np.sort(c, axis=1)[:, : max(1, int((c < n).sum(axis=1).max(initial=0)))]
    real = c < n
    vectors = x[np.where(real, c, 0)]
    far = np.where(real, 1 - np.matmul(vectors, x[nodes][:, :, None])[:, :, 0], np.inf)
    apart = alpha * (1 - np.matmul(vectors, vectors.transpose(0, 2, 1)))
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for k in range(min(degree, c.shape[1])):
        best = far.argmin(axis=1)
        found = np.isfinite(far[rows, best])
        if not found.any():
            break
        out[found, k] = c[rows, best][found]
        far[(apart[rows, best] <= far) & found[:, None]] = np.inf
        far[rows, best] = np.inf
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions; scaled by the largest component first, so that no square overflows or vanishes."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The edges of each node (-1: none) and the node that searches start from; ``x`` holds unit vectors.

    A node has room for twice ``degree`` edges while others add theirs, and is pruned when that is full.
    """
    n, width = len(x), 2 * degree
    start = int((x @ x.mean(axis=0)).argmax())
    rng = np.random.default_rng(n)
    graph = np.full((n, width), -1)
    if n > 1:
        graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))

    def pruned(nodes: np.ndarray, more: np.ndarray, factor: float) -> None:
        graph[nodes, :degree] = robust_prune(x, nodes, np.concatenate([more, graph[nodes]], axis=1), factor, degree)
        graph[nodes, degree:] = -1

    order = rng.permutation(n)
    for factor in (1.0, alpha):
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            pruned(nodes, beam_search(x, graph, start, x[nodes], beam)[0], factor)
            ends, sources = graph[nodes, :degree].ravel(), np.repeat(nodes, degree)
            ends, sources = ends[ends >= 0], sources[ends >= 0]
            by_end = np.argsort(ends, kind="stable")
            ends, sources = ends[by_end], sources[by_end]
            hit, first, count = np.unique(ends, return_index=True, return_counts=True)
            used = (graph[hit] >= 0).sum(axis=1)
            fits = used + count <= width
            place, room = np.repeat(used - first, count) + np.arange(len(ends)), np.repeat(fits, count)
            graph[ends[room], place[room]] = sources[room]
            full = np.flatnonzero(~fits)
            for a in range(0, len(full), BATCH):
                some = full[a : a + BATCH]
                more = np.full((len(some), int(count[some].max())), -1)
                inside = np.arange(more.shape[1]) < count[some][:, None]
                more[inside] = sources[(first[some][:, None] + np.arange(more.shape[1]))[inside]]
                pruned(hit[some], more, factor)
    over = np.flatnonzero(graph[:, degree] >= 0)
    for a in range(0, len(over), BATCH):
        pruned(over[a : a + BATCH], graph[over[a : a + BATCH], :0], alpha)
    return graph[:, :degree], start


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, each id once."""
    v = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("embedding", lambda c: c != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


INDEX = "shard int, kind int, node long, embedding array<double>, ids array<long>, edges array<int>, start int"


def _stacked(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(vectors: DataFrame, answers: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """The index, a row for each distinct vector; (dimension, first, last) of the shards of each band; and the number of shards.

    Each node keeps its ``answers + 1`` smallest ids; further copies can't be among that many nearest. Only numbers of nodes by
    dimension and band reach the driver: doubles have no more than 6,400 bands.
    """
    spark = vectors.sparkSession
    copy = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = vectors.withColumn("n", F.row_number().over(copy)).where(F.col("n") <= answers + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    top = F.array_max(F.transform("embedding", F.abs))
    length = F.log(top) + F.log(F.aggregate("embedding", F.lit(0.0), lambda a, c: a + (c / top) * (c / top))) / 2
    nodes = cut(nodes.withColumns({"dimension": F.size("embedding"), "band": F.floor(length / float(np.log(RATIO)))}), "nodes")
    bands, total = [], 0
    for r in sorted(nodes.groupBy("dimension", "band").count().collect()):
        shards = -(-r["count"] // shard_rows)
        bands.append((r["dimension"], r["band"], total, total + shards - 1))
        total += shards
    held = F.broadcast(spark.createDataFrame(bands, "dimension int, band long, first int, last int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        vectors = table.column("embedding").combine_chunks()
        graph, start = build(unit(_stacked(vectors)))
        for a in range(0, table.num_rows, BATCH):
            part = table.slice(a, BATCH).combine_chunks()
            n = part.num_rows
            edges = pa.array([g[g >= 0] for g in graph[a : a + n]], pa.list_(pa.int32()))
            columns = [part.column("shard"), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(a, a + n)), part.column("embedding"), part.column("ids"), edges, pa.array(np.full(n, start, np.int32))]
            yield from pa.table(columns, names=[c.split()[0] for c in INDEX.split(", ")]).to_batches()

    dealt = nodes.join(held, ["dimension", "band"]).select((F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("last") - F.col("first") + 1)).cast("int").alias("shard"), "embedding", "ids")
    index = dealt.repartitionById(max(total, 1), F.col("shard")).sortWithinPartitions(F.col("ids")[0]).mapInArrow(run, INDEX)
    index = cut(index, "index")
    drop_cut(nodes)
    return index, held, max(total, 1)


def search(index: DataFrame, bands: DataFrame, shards: int, queries: DataFrame, answers: int, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``answers`` nearest found; ``queries`` has (vec_id, embedding), and a query isn't its own answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[pa.RecordBatch] = []
        ready = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            k = int(np.searchsorted(kinds, 1))  # nodes come before queries
            if k:
                nodes.append(batch.slice(0, k))
            if k == batch.num_rows:
                continue
            if not nodes:
                return
            if ready is None:
                table = pa.Table.from_batches(nodes).combine_chunks()
                nodes = nodes[:1]
                exact = _stacked(table.column("embedding").combine_chunks())
                x = (exact / np.abs(exact).max()).astype(np.float32)  # a scale changes no order
                graph, wide = np.full((len(x), DEGREE), -1), np.full((len(x), answers + 1), -1)
                for target, name in ((graph, "edges"), (wide, "ids")):
                    lists = table.column(name).combine_chunks()
                    size = np.diff(lists.offsets.to_numpy())
                    target[np.arange(target.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                ready = (exact, x, graph, wide, table.column("start")[0].as_py())
            exact, x, graph, wide, start = ready
            asked = batch.slice(k)
            every, names = _stacked(asked.column("embedding")), asked.column("node").to_numpy(zero_copy_only=False)
            for a in range(0, len(every), BATCH):
                q, q_ids = every[a : a + BATCH], names[a : a + BATCH]
                found, _ = beam_search(x, graph, start, unit(q), beam)
                score = np.where(found >= 0, (exact[np.maximum(found, 0)] * q[:, None, :]).sum(axis=2), -np.inf)
                low = np.where(found >= 0, wide[np.maximum(found, 0), 0], np.iinfo(np.int64).max)
                best = np.lexsort((low, -score), axis=1)[:, : answers + 1]
                keep, kept = np.take_along_axis(found, best, axis=1), np.take_along_axis(score, best, axis=1)
                vec = np.where(keep[:, :, None] >= 0, wide[np.maximum(keep, 0)], -1)
                fit = (vec >= 0) & (vec != q_ids[:, None, None])
                r, c, _ = np.nonzero(fit)
                ids, values = vec[fit], kept[r, c]
                order = np.lexsort((ids, -values, r))
                r, ids, values = r[order], ids[order], values[order]
                first = np.searchsorted(r, r)
                inside = np.arange(len(r)) - first < answers
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r[inside]]), pa.array(ids[inside]), pa.array(values[inside])], names=["query_id", "vec_id", "score"])

    own = bands.groupBy("dimension").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    asked = queries.withColumn("dimension", F.size("embedding")).join(F.broadcast(own), "dimension")
    asked = asked.select(F.explode(F.sequence("first", "last")).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("node"), "embedding", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("edges"), F.lit(None).cast("int").alias("start"))
    met = index.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "node")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= answers).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, asks: Column, answers: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nearest of all rows to each row where ``asks`` (of vec_id) holds."""
    vectors = cut(valid_vectors(rows, id_col, vector_col), "vectors")
    index, bands, shards = build_index(vectors, answers, shard_rows)
    return search(index, bands, shards, vectors.where(asks), answers)
