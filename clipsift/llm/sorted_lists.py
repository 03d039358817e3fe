"""Exact top-k by inner product of whole-number vectors: no-random-access aggregation over sorted lists.

Distinct vectors are dealt to shards by falling length, about ``SHARD_ROWS`` to one. A shard has a sorted list for each entry of its
vectors. A query reads the lists of its non-zero entries from their better ends, all to the same depth, round by round. What it has
read of a vector gives a lower bound of its score (unread entries are their lists' worst) and an upper one (unread entries are as
good as where their lists stand). The bar is the score that the k-th best surely reaches: the k-th lower bound, or the k-th of the
scores resolved so far, as the vectors with the highest upper bounds are resolved after each round. When few vectors can still
reach the bar, seen or not, reading stops, and their scores are resolved by the product itself.

A query first visits one shard. What it finds there is its bar everywhere else: the heads of a shard's lists bound every score in
it, so a query isn't even sent to shards whose heads fall short. Heads meet queries in blocks of both; no pair of a query and a
vector is ever a row. In vectors without structure no bound saves much, and the work is queries times vectors.

Equal vectors are one node that keeps as many of its smallest ids as an answer can use, and equal queries are one search: a group of
copies, however large, costs one of each.

Defined results: vectors that are null, empty, or hold a null or non-finite entry take no part, neither do null ids; zero vectors
do; vectors of different dimensions are in spaces of their own and never each other's answer; of a repeated id one vector counts,
always the same (the least as bytes); fewer candidates than asked for are all returned. Entries whose whole number is beyond a long
become its ends; scores are exact in whole numbers of any size for ranking and are returned as a long's ends beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.llm._common import cut, drop_cut, stacked, whole_vectors

#: Distinct vectors of a shard, about; queries of a block; shards of a block of heads.
SHARD_ROWS, QUERY_BLOCK, HEAD_BLOCK = 8192, 256, 512
#: Rounds in which a list is read to its end (the first takes a quarter), and the share of vectors at which reading stops.
ROUNDS, FEW = 12, 1 / 64
_EXACT = 1 << 53
_MOST = (1 << 63) - 1
BLOCK = "shard int, dimension int, ids binary, x binary, bar binary"
_BLOCK = pa.schema([("shard", pa.int32()), ("dimension", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("bar", pa.binary())])
_HEADS = pa.schema([("slot", pa.int32()), ("shard", pa.int32()), ("dimension", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row of at least k values."""
    at = values.shape[1] - k
    return (np.sort(values, axis=1) if values.dtype == object else np.partition(values, at, axis=1))[:, at]


class Lists:
    """A shard's vectors (n x d whole numbers) and, for each entry, their sorted list."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32).copy()
        self.largest = _largest(x)
        self._as: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, largest: int, bars: int) -> tuple[type, np.ndarray, np.ndarray]:
        """Numbers in which no sum of products is rounded, and in them the vectors and the lists' values (both d x n)."""
        most = max(self.x.shape[1] * max(self.largest, 1) * max(largest, 1), bars)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < _EXACT else object
        if kind not in self._as:
            x = self.x.T.astype(kind).copy()
            self._as[kind] = (x, np.take_along_axis(x, self.order, axis=1))
        return kind, *self._as[kind]

    def search(self, queries: np.ndarray, k: int, bars: list[int | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, nodes, scores): of each query the k best, and all that equal the last of them; none below its bar.

        The queries read together: what a list has shown is the same for all that read it from the same end, so that bounds of all
        are one product of what was read (else where a list stands, or its worst) with the queries' positive and negative parts.
        """
        known = [abs(b) for b in bars if b is not None]
        kind, x, values = self.numbers(_largest(queries), max(known, default=0))
        d, n = x.shape
        asked = queries.astype(kind)
        parts = np.concatenate([np.maximum(asked, 0), np.minimum(asked, 0)], axis=1)  # lists read from the top, from the bottom
        bar = np.array([-np.inf if b is None else b for b in bars], dtype=kind)
        seen = np.zeros((2 * d, n), bool)
        both = np.concatenate([x, x])
        worst = np.concatenate([values[:, 0], values[:, -1]])[:, None]
        live = np.flatnonzero(parts @ np.concatenate([values[:, -1], values[:, 0]]) >= bar)  # else the heads already fall short
        read = 0
        while len(live):
            stop = min(n, max(n // 4, read + -(-n // ROUNDS), 1))
            np.put_along_axis(seen[:d], self.order[:, n - stop : n - read], True, axis=1)
            np.put_along_axis(seen[d:], self.order[:, read:stop], True, axis=1)
            read = stop
            stand = np.concatenate([values[:, n - read], values[:, read - 1]])[:, None]
            upper, lower = parts[live] @ np.where(seen, both, stand), parts[live] @ np.where(seen, both, worst)
            if n >= k:
                bar[live] = np.maximum(bar[live], _kth(lower, k))
                likely = np.argpartition(upper, n - min(2 * k, n), axis=1)[:, n - min(2 * k, n) :] if kind != object else np.argsort(upper, axis=1)[:, -2 * k :]
                sure = np.stack([asked[q] @ x[:, some] for q, some in zip(live, likely)])
                bar[live] = np.maximum(bar[live], _kth(sure, k))
            left = upper >= bar[live][:, None]
            done = (left.sum(axis=1) <= max(4 * k, n * FEW)) | (read == n)
            for row in np.flatnonzero(done):
                q = live[row]
                nodes = np.flatnonzero(left[row])
                score = asked[q] @ x[:, nodes]
                if len(nodes) >= k:
                    fit = score >= max(bar[q], _kth(score[None, :], k)[0])
                    nodes, score = nodes[fit], score[fit]
                else:
                    nodes, score = nodes[score >= bar[q]], score[score >= bar[q]]
                yield int(q), nodes, score
            live = live[~done]


def nodes_of(vectors: DataFrame, ids: int) -> DataFrame:
    """(x, ids, dimension, length) of each distinct vector with its smallest ids."""
    copy = Window.partitionBy("x").orderBy("vec_id")
    nodes = vectors.withColumn("n", F.row_number().over(copy)).where(F.col("n") <= ids).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(v, "<i8").astype(np.float64) for v in batch.column(0).to_pylist()]
            lengths = [float(np.sqrt((v * v).sum())) for v in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) for v in each], pa.int32()), pa.array(lengths, pa.float64())], names=["x", "ids", "dimension", "length"])

    return nodes.mapInArrow(run, "x binary, ids array<long>, dimension int, length double")


def build_lists(vectors: DataFrame, ids: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, dict[int, list[int]]]:
    """Shards (shard, dimension, x, ids); heads of their lists; and the shards of each dimension, the only numbers for the driver."""
    nodes = cut(nodes_of(vectors, ids), "nodes")
    shards = max(-(-nodes.count() // shard_rows), 1)
    dealt = nodes.repartitionByRange(shards, F.col("dimension"), F.desc("length"), F.xxhash64("x"))
    index = cut(dealt.select(F.spark_partition_id().alias("shard"), "dimension", "x", "ids"), "shards")
    drop_cut(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[:2]])
            for s, d in np.unique(keys, axis=1).T.tolist():
                x = stacked(batch.filter(pa.array((keys == [[s], [d]]).all(axis=0))).column(2))
                high, low = held.get((s, d), (x[0], x[0]))
                held[s, d] = (np.maximum(high, x.max(axis=0)), np.minimum(low, x.min(axis=0)))
        rows = [{"slot": s // HEAD_BLOCK, "shard": s, "dimension": d, "high": high.tobytes(), "low": low.tobytes()} for (s, d), (high, low) in held.items()]
        yield pa.RecordBatch.from_pylist(rows, _HEADS)

    heads = cut(index.select("shard", "dimension", "x").mapInArrow(run, "slot int, shard int, dimension int, high binary, low binary"), "heads")
    places: dict[int, list[int]] = {}
    for r in heads.select("dimension", "shard").distinct().collect():
        places.setdefault(r.dimension, []).append(r.shard)
    return index, heads, {d: sorted(s) for d, s in places.items()}


def _blocks(rows: dict[int, list], send: Callable[[int, np.ndarray, np.ndarray, list], Iterator[tuple[int, np.ndarray]]], full: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the gathered queries of each dimension with at least ``full`` of them, for each shard that ``send`` names."""
    for d in list(rows):
        if len(rows[d]) < full:
            continue
        got = rows.pop(d)
        ids, x, bars = np.array([g[0] for g in got], np.int64), np.stack([np.frombuffer(g[1], "<i8") for g in got]), [g[2] for g in got]
        bar = np.array([-_MOST - 1 if b is None else b for b in bars], np.int64)
        for shard, some in send(d, ids, x, bars):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "dimension": d, "ids": ids[some].tobytes(), "x": x[some].tobytes(), "bar": bar[some].tobytes()}], _BLOCK)


def search(index: DataFrame, blocks: DataFrame, shards: int, answers: int) -> DataFrame:
    """(qid, vec_id, score): what each query of a block finds in the block's shard, its ``answers`` best or none below its bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, list[pa.RecordBatch]] = {}
        ready: dict[int, tuple[Lists, pa.Array]] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            k = int(np.searchsorted(kinds, 1))  # vectors come before queries
            part = batch.slice(0, k)
            for d in part.column("dimension").unique().to_pylist():
                nodes.setdefault(d, []).append(part.filter(pa.compute.equal(part.column("dimension"), d)).select(["x", "ids_of"]))
            for row in batch.slice(k).select(["dimension", "ids", "x", "bar"]).to_pylist():
                d = row["dimension"]
                if d not in ready:
                    table = pa.Table.from_batches(nodes.pop(d)).combine_chunks()
                    ready[d] = (Lists(stacked(table.column("x").combine_chunks())), table.column("ids_of").combine_chunks())
                lists, ids = ready[d]
                out: list[tuple[int, int, int]] = []
                names, bars = np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["bar"], np.int64).tolist()
                for q, found, score in lists.search(np.frombuffer(row["x"], "<i8").reshape(-1, d), answers, [None if b == -_MOST - 1 else b for b in bars]):
                    each = [(-int(s), i) for s, some in zip(score.tolist(), ids.take(pa.array(found)).to_pylist()) for i in some]
                    out += [(names[q], i, s) for s, i in sorted(each)[:answers]]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([max(min(-s, _MOST), -_MOST - 1) for s in columns[2]], pa.int64())], names=["qid", "vec_id", "score"])

    vectors = index.select("shard", F.lit(0).alias("kind"), "dimension", "x", F.col("ids").alias("ids_of"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("bar"))
    asked = blocks.select("shard", F.lit(1).alias("kind"), "dimension", "x", F.lit(None).cast("array<long>").alias("ids_of"), "ids", "bar")
    met = vectors.join(blocks.select("shard").distinct(), "shard", "left_semi").unionByName(asked)
    return met.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(run, "qid long, vec_id long, score long")


def top_k(rows: DataFrame, asks: Column, answers: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the highest scores of all rows against each row where ``asks`` (of vec_id) holds, itself left out."""
    k = answers + 1  # a query may find itself
    vectors = whole_vectors(rows, id_col, vector_col, scale).where(F.col("vec_id").isNotNull() & (F.length("x") > 0))
    vectors = cut(vectors.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    index, heads, places = build_lists(vectors, k, shard_rows)
    shards = max((s[-1] for s in places.values()), default=0) + 1
    asked = vectors.where(asks)
    searches = cut(asked.select("x").distinct().select(F.monotonically_increasing_id().alias("qid"), "x"), "searches")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        turn = TaskContext.get().partitionId()

        def send(d: int, ids: np.ndarray, x: np.ndarray, bars: list) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal turn
            turn += 1
            yield places[d][turn % len(places[d])], np.arange(len(ids))

        for batch in batches:
            for q, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(x) // 8, []).append((q, x, None))
                if len(held[len(x) // 8]) == QUERY_BLOCK:
                    yield from _blocks(held, send, QUERY_BLOCK)
        yield from _blocks(held, send, 1)

    first = cut(searches.mapInArrow(home, BLOCK), "blocks")
    here = cut(search(index, first, shards, k), "found")
    homes = cut(first.mapInArrow(_homes, "qid long, home int"), "homes")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dimension"]
                x = np.stack([np.frombuffer(q["x"], "<i8") for q in row["queries"]]).astype(object if row["wide"] else np.float64)
                for head in row["heads"]:
                    high, low = (np.frombuffer(head[c], "<i8").astype(x.dtype) for c in ("high", "low"))
                    bound = (np.maximum(x * high, x * low)).sum(axis=1)
                    some = [q for q, b in zip(row["queries"], bound.tolist()) if q["home"] != head["shard"] and (q["bar"] is None or b >= q["bar"])]
                    if some:
                        bar = np.array([-_MOST - 1 if q["bar"] is None else q["bar"] for q in some], np.int64)
                        yield pa.RecordBatch.from_pylist([{"shard": head["shard"], "dimension": d, "ids": np.array([q["qid"] for q in some], np.int64).tobytes(), "x": b"".join(q["x"] for q in some), "bar": bar.tobytes()}], _BLOCK)

    best = here.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    known = searches.join(homes, "qid").join(best, "qid", "left").withColumn("dimension", (F.length("x") / 8).cast("int"))
    block = F.floor(F.row_number().over(Window.partitionBy("home", "dimension").orderBy("qid")) / QUERY_BLOCK)  # one task's queries at most
    blocks = known.withColumn("block", block).groupBy("home", "dimension", "block").agg(F.collect_list(F.struct("qid", "x", "home", "bar")).alias("queries"))
    # heads that can't be summed exactly as doubles are compared in whole numbers of any size
    groups = heads.groupBy("dimension", "slot").agg(F.collect_list(F.struct("shard", "high", "low")).alias("heads"))
    met = blocks.join(groups, "dimension").withColumn("wide", F.lit(_wide(vectors)))
    second = cut(met.select("dimension", "queries", "heads", "wide").mapInArrow(elsewhere, BLOCK), "blocks")
    there = search(index, second, shards, k)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = here.unionByName(there).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    named = asked.join(searches, "x").select("qid", F.col("vec_id").alias("query_id")).join(lists, "qid")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, answers)
    out = named.select("query_id", F.posexplode(others).alias("place", "f"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, shard) of the queries of blocks."""
    for batch in batches:
        for row in batch.select(["shard", "ids"]).to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["shard"], np.int32))], names=["qid", "home"])


def _wide(vectors: DataFrame) -> bool:
    """Whether products of these vectors may not be sums of exact doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = size = 0
        for batch in batches:
            for v in batch.column(0).to_pylist():
                x = np.frombuffer(v, "<i8")
                most, size = max(most, _largest(x)), max(size, len(x))
        yield pa.RecordBatch.from_arrays([pa.array([size * most * most >= _EXACT])], names=["wide"])

    return bool(vectors.select("x").mapInArrow(run, "wide boolean").agg(F.max("wide")).collect()[0][0])
