"""Guarded updates: each event of a log is accepted or refused by the state that the accepted ones before it leave."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """States, the first one being the start, and (kind, state) -> state for the updates whose precondition holds."""

    states: tuple[str, ...]
    moves: Mapping[tuple[str, str], str]

    def table(self) -> dict[str, list[int]]:
        """Kind -> the state after it for each state before it; a refused update leaves it."""
        at = {s: i for i, s in enumerate(self.states)}
        return {kind: [at[self.moves.get((kind, s), s)] for s in self.states] for kind in sorted({k for k, _ in self.moves})}


#: A revealed clip: uploaded once, aligned while that is pending, corrected by hand at any time after the upload.
ACTUAL_CLIP = Machine(
    ("awaiting_upload", "uploaded", "needs_review", "aligned", "manually_aligned"),
    {("upload", "awaiting_upload"): "uploaded"}
    | {("align", s): "aligned" for s in ("uploaded", "needs_review")}
    | {("doubt", s): "needs_review" for s in ("uploaded", "needs_review")}
    | {("correct", s): "manually_aligned" for s in ("uploaded", "needs_review", "aligned", "manually_aligned")},
)
#: A source video: attached once, finished or failed while processing, reset after a failure, frozen when it is ready.
SOURCE = Machine(
    ("awaiting_upload", "processing", "ready", "failed", "recommendations_frozen"),
    {("attach", "awaiting_upload"): "processing", ("finish", "processing"): "ready", ("fail", "processing"): "failed", ("reset", "failed"): "awaiting_upload", ("freeze", "ready"): "recommendations_frozen"},
)
#: States of revealed clips that wait for alignment.
PENDING = ("uploaded", "needs_review")


def replay(events: DataFrame, key: str, order: str, kind: str, machine: Machine, width: int = 1 << 16) -> DataFrame:
    """(key, order, kind, accepted, state): what each event of a log does; ``order`` is a whole number, unique in a key.

    A log is dealt to blocks of ``width`` values of ``order``. A block doesn't know its starting state, so it first gives the map
    from every state before it to the one after it; the maps of a key are composed in order, one row a block, and each block then
    passes its events once more from its own start. A key with a third of all events so spreads over tasks, and nothing is gathered.
    Events without key or order take no part; unknown kinds are refused.
    """
    names, table, size = machine.states, machine.table(), len(machine.states)
    kinds = dict(events.dtypes)
    rows = events.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.col(kind).cast("string").alias("kind")).where("key is not null and at is not null")
    rows = rows.withColumn("block", F.floor(F.col("at") / width))
    own = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block", F.asc_nulls_first("at"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, list(range(size))
        for batch in batches:
            out = []
            for k, block, move in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (k, block):
                    if place is not None:
                        out.append((*place, held))
                    place, held = (k, block), list(range(size))
                if after := table.get(move):
                    held = [after[s] for s in held]
            yield _batch(out, ("key", "block", "m"), batch.schema, pa.list_(pa.int32()))
        if place is not None:
            yield _batch([(*place, held)], ("key", "block", "m"), batch.schema, pa.list_(pa.int32()))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, state = None, 0
        for batch in batches:
            out = []
            for key_, block, m in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key_:
                    k, state = key_, 0
                out.append((key_, block, names[state]))
                state = m[state]
            yield _batch(out, ("key", "block", "kind"), batch.schema, pa.string())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at_state = 0, {s: i for i, s in enumerate(names)}
        for batch in batches:
            kept, accepted, after = [], [], []
            for i, (at, move) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if at is None:  # a block's start
                    state = at_state[move]
                    continue
                fits = (move, names[state]) in machine.moves
                state = table[move][state] if fits else state
                kept.append(i)
                accepted.append(fits)
                after.append(names[state])
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array(accepted, pa.bool_()), pa.array(after, pa.string())], names=["key", "at", "kind", "accepted", "state"])

    type_ = kinds[key]
    blocks = own(rows).select("key", "block", "kind").mapInArrow(maps, f"key {type_}, block long, m array<int>")
    begun = blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(starts, f"key {type_}, block long, kind string")
    both = rows.select("key", "block", "at", "kind").unionByName(begun.select("key", "block", F.lit(None).cast("long").alias("at"), "kind"))
    out = own(both).mapInArrow(judged, f"key {type_}, at long, kind string, accepted boolean, state string")
    return out.select(F.col("key").alias(key), F.col("at").alias(order), F.col("kind").alias(kind), "accepted", "state")


def _batch(rows: list[tuple], names: tuple[str, ...], like: pa.Schema, last: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    types = [like.field(0).type, like.field(1).type, last]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def final_states(log: DataFrame, key: str, order: str) -> DataFrame:
    """(key, state, refused): the state that each key's log leaves, and how many events it refused."""
    return log.groupBy(key).agg(F.max_by("state", order).alias("state"), F.count_if(~F.col("accepted")).alias("refused"))


def pending(state: Column) -> Column:
    """Whether a revealed clip waits for alignment."""
    return state.isin(list(PENDING))
