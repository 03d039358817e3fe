"""Prefix trie of conversations: the Cartesian tree over the longest common prefixes (LCP) of conversations in sorted order.

Conversations are sequences of turns (a 128-bit digest of role and text each). Sorted, all that share their first d turns are
neighbours, so a node of depth d is an interval: it starts where the LCP with the row before is below d and ends before the next
row whose LCP is below d. The sorted rows are dealt to blocks. Within a block a stack finds each row's nearest smaller values on
both sides: rows of equal LCP meet in one node, and depths between an LCP and the one above it are expanded into single nodes. What
a block's border cuts is matched across blocks by block minima (the least LCP in a sorted block is that of its first and last row):
the block where an open node starts is the nearest one to the left with a smaller minimum. Every count is a sum over a node's
interval, so pieces of a node from several blocks add up.

A sorted row, an item, holds at most ``CHUNK`` turns: a longer conversation is several items, each sorted under a hash of all turns
before it, so that one conversation with a large share of all turns spreads over tasks. What such items save below them is added to
the conversation's earlier items before these are summed. Only first and last items of blocks reach the driver (2 KB a block of
about ``BLOCK_ITEMS`` items), and no list of a node's members is built: conversations that end in one node are hashed as a stream.

Defined results: null roles and texts are empty; rows without conv_id take no part; rows of one conversation with equal turns are
ordered by the digest of role and text, repeated rows are turns of their own; ``%`` keeps the sign of a negative conv_id; an empty
table has no nodes; a table whose rebuilt conversations are all turnless has the root alone, a leaf.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.llm._common import cut, drop_cut

#: Turns of an item, items of a block (about), bytes of a turn's digest, ids in a piece of an end list, turn numbers counted together.
CHUNK, BLOCK_ITEMS, WIDTH, PIECE, SPAN = 64, 1 << 17, 16, 4096, 4096
ITEM = "conv_id long, j long, key binary, sizes array<long>, total long"
ORDER = ("j", "prefix", "key", "cont", "conv_id")


def numbered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, digest, size): each conversation's turns from 0. A conversation is numbered in spans, which only counts join."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * WIDTH))
    turns = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("size"))
    turns = turns.where(F.col("conv_id").isNotNull()).withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = turns.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", ahead).drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.asc_nulls_first("turn"), "digest"))
    return turns.join(spans, ["conv_id", "span"]).select("conv_id", (F.col("ahead") + place - 1).alias("pos"), "digest", "size")


def rebuilt_turns(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, size, total) of conversations that begin with their base's first h turns; and the turnless ids.

    The base of c is ``c - c % every``; h is ``crc32(decimal c) % most``.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(bases, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = plan.select(F.col("conv_id").alias("c"), "base", "h", "k", "total")
    own = turns.join(plan, turns.conv_id == plan.c).where(F.col("pos") >= F.col("h")).select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "digest", "size", "total")
    lent = turns.where(F.col("pos") < most).join(plan.where("k > 0"), turns.conv_id == plan.base).where(F.col("pos") < F.col("k")).select("c", "pos", "digest", "size", "total")
    return own.unionByName(lent).withColumnRenamed("c", "conv_id"), plan.where("total = 0").select(F.col("c").alias("conv_id"))


def items_of(turns: DataFrame, turnless: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The items of sequences of turns (conv_id, pos, digest, size, total), and of conversations without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_pylist()
            digests, sizes = lists.values.field(1).to_pylist(), lists.values.field(2).to_pylist()
            keys = pa.array([b"".join(digests[a:b]) for a, b in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, pa.array([sizes[a:b] for a, b in zip(at, at[1:])], pa.list_(pa.int64())), batch.column(3)], names=["conv_id", "j", "key", "sizes", "total"])

    groups = turns.groupBy("conv_id", F.floor(F.col("pos") / chunk).alias("j"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("turns"))
    items = groups.select("conv_id", "j", "turns", "total").mapInArrow(run, ITEM)
    none = turnless.select("conv_id", F.lit(0).cast("long").alias("j"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("sizes"), F.lit(0).cast("long").alias("total"))
    items = items.unionByName(none).withColumn("cont", F.col("total") > (F.col("j") + 1) * chunk)
    short = items.where(F.col("total") <= chunk).withColumns({"prefix": F.lit(0).cast("decimal(38,0)"), "next": F.lit(None).cast("decimal(38,0)")})
    # a hash of all items before this one: a sum of 96-bit hashes of place and content
    code = F.sha2(F.concat(F.col("j").cast("string").cast("binary"), F.lit(b":"), F.col("key")), 256)
    value = F.conv(F.substring(code, 1, 12), 16, 10).cast("decimal(38,0)") * F.lit(Decimal(1 << 48)).cast("decimal(16,0)") + F.conv(F.substring(code, 13, 12), 16, 10).cast("decimal(38,0)")
    so_far = F.sum(F.col("code")).over(Window.partitionBy("conv_id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)")
    long = items.where(F.col("total") > chunk).withColumn("code", value.cast("decimal(38,0)")).withColumn("next", so_far)
    long = long.withColumns({"prefix": (F.col("next") - F.col("code")).cast("decimal(38,0)"), "next": F.when(F.col("cont"), F.col("next"))}).drop("code")
    return short.unionByName(long)


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    k = 0
    while a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


@dataclass
class Borders:
    """What blocks know of each other: LCP of the first item with the one before and of the last with the next, and where open nodes start."""

    left: dict[int, int] = field(default_factory=dict)
    right: dict[int, int] = field(default_factory=dict)
    starts: dict[int, list[int]] = field(default_factory=dict)
    chunk: int = CHUNK
    deep: bool = False


def nearest_smaller(minima: list[tuple[int, int, int]]) -> dict[int, list[int]]:
    """Block -> for each depth up to its ``left``, the nearest block before it whose minimum is smaller. ``minima`` has (block, left, minimum)."""
    values, places, out = [], [], {}  # minima that rise from bottom to top
    for block, left, low in minima:
        out[block] = [places[bisect.bisect_left(values, d) - 1] for d in range(left + 1)]
        while values and values[-1] >= low:
            values.pop()
            places.pop()
        values.append(low)
        places.append(block)
    return out


def sorted_blocks(items: DataFrame, name: str, block_items: int, chunk: int = CHUNK) -> tuple[DataFrame, Borders]:
    """The items as a table with their block and place, sorted; and the blocks' borders."""
    spark = items.sparkSession
    held = cut(items, f"{name}-items")
    blocks = max(-(-held.count() // block_items), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = held.repartitionByRange(blocks, *ORDER).sortWithinPartitions(*ORDER)
    table = cut(dealt.withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    drop_cut(held)
    item = F.struct("j", "prefix", "key")
    rows = sorted(table.groupBy("block").agg(F.min_by(item, "place").alias("first"), F.max_by(item, "place").alias("last"), F.count(F.lit(1)).alias("n")).collect())

    def common(a, b) -> int:
        return lcp(a.key, b.key) if (a.j, a.prefix) == (b.j, b.prefix) else -1

    out, minima = Borders(chunk=chunk, deep=any(r.last.j > 0 for r in rows)), []
    for k, r in enumerate(rows):
        out.left[r.block] = left = common(rows[k - 1].last, r.first) if k else -1
        out.right[r.block] = common(r.last, rows[k + 1].first) if k + 1 < len(rows) else -1
        minima.append((r.block, left, min(left, common(r.first, r.last)) if r.n > 1 else left))
    out.starts = nearest_smaller(minima)
    return table, out


def in_blocks(table: DataFrame) -> DataFrame:
    """The table of ``sorted_blocks`` again, a block to a task, in order."""
    blocks = table.agg(F.max("block")).collect()[0][0]
    return table.repartitionById((blocks or 0) + 1, F.col("block")).sortWithinPartitions("block", "place")


def saved_below(table: DataFrame, borders: Borders) -> DataFrame:
    """(conv_id, j, saved_below, leaves_below): what items after j of a conversation stand for in the sums of j's nodes.

    ``table`` holds the items after the first ones. Of a conversation's turns in an item all bytes count, less those of nodes that
    start there; a leaf counts where the last item of its conversations ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("j", pa.int64()), ("saved", pa.int64()), ("leaves", pa.int64())]))
            rows.clear()
            return out

        for batch in batches:
            for item in batch.to_pylist():
                if before is None:
                    same = borders.left[item["block"]]
                else:
                    same = lcp(before["key"], item["key"]) if (before["j"], before["prefix"]) == (item["j"], item["prefix"]) else -1
                    rows[-1]["leaves"] = int(not before["cont"] and same < len(before["sizes"]))
                    if len(rows) > 10_000:
                        last = rows.pop()
                        yield flush()
                        rows.append(last)
                rows.append({"conv_id": item["conv_id"], "j": item["j"], "saved": sum(item["sizes"][: max(same, 0)]), "leaves": 0})
                before = item
        if before is not None:
            rows[-1]["leaves"] = int(not before["cont"] and borders.right[before["block"]] < len(before["sizes"]))
            yield flush()

    each = in_blocks(table).mapInArrow(run, "conv_id long, j long, saved long, leaves long")
    first = each.select("conv_id").distinct().withColumns({"j": F.lit(0).cast("long"), "saved": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})
    later = Window.partitionBy("conv_id").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)
    below = {f"{c}_below": F.coalesce(F.sum(c).over(later), F.lit(0)) for c in ("saved", "leaves")}
    return each.unionByName(first).withColumns(below).drop("saved", "leaves")


PART = pa.schema(
    [(c, pa.int64()) for c in ("kind", "block", "local", "start", "depth", "conv_id", "n", "children", "leaves", "saved", "parent_conv", "parent_local", "parent_start", "piece")]
    + [("ends", pa.string()), ("joint", pa.decimal128(38, 0)), ("parent_joint", pa.decimal128(38, 0))]
)
_SQL = {f.name: "long" if f.type == pa.int64() else "string" if f.type == pa.string() else "decimal(38,0)" for f in PART}


def _ddl(names: Iterable[str]) -> str:
    return ", ".join(f"{c} {_SQL[c]}" for c in names)


#: Kinds of rows: a node that its block holds whole, a piece of one that a border cuts, the root of later items under one hash.
WHOLE, CUT, ROOT = 0, 1, 2


@dataclass
class Open:
    """A node on the stack."""

    local: int
    size: int
    fresh: bool
    n: int = 0
    conv_id: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    below: list[dict] = field(default_factory=list)
    joint: Decimal | None = None


class Stack:
    """A block's Cartesian tree as its items come in order; rows of ``PART`` collect in ``rows``."""

    def __init__(self, block: int, borders: Borders):
        self.block, self.left, self.right, self.starts = block, borders.left[block], borders.right[block], borders.starts[block]
        self.chunk = borders.chunk
        self.open: list[Open] = []
        self.rows: list[dict] = []
        self.before: dict | None = None

    def add(self, item: dict) -> None:
        key, sizes = item["key"], item["sizes"]
        if self.before is None:
            same = self.left
            self.open = [Open(d, sizes[d - 1] if d else 0, False) for d in range(same + 1)]
        else:
            same = lcp(self.before["key"], key) if (self.before["j"], self.before["prefix"]) == (item["j"], item["prefix"]) else -1
            self.close(same)
        self.before = item
        if not self.open:
            self.open.append(Open(0, 0, True))
        for d in range(max(same, 0) + 1, len(sizes) + 1):
            self.open[-1].children += 1
            self.open.append(Open(d, sizes[d - 1], True, saved=-sizes[d - 1]))
        top = self.open[-1]
        top.n += 1
        top.conv_id = item["conv_id"] if top.conv_id is None else min(top.conv_id, item["conv_id"])
        top.saved += item["saved_below"]
        top.leaves += item["leaves_below"]
        if item["cont"]:
            top.joint = item["next"]
        else:
            top.ends.append(item["conv_id"])

    def close(self, same: int, cut_off: bool = False) -> None:
        """End the nodes deeper than ``same``: here, or (``cut_off``) at the block's border."""
        last = self.before
        if not cut_off and not last["cont"] and same < len(last["sizes"]):
            self.open[-1].leaves += 1
        while self.open and self.open[-1].local > same:
            node = self.open.pop()
            node.saved += node.n * node.size
            under = self.open[-1] if self.open else None
            if under:
                under.n += node.n
                under.leaves += node.leaves
                under.saved += node.saved
                under.conv_id = node.conv_id if under.conv_id is None else min(under.conv_id, node.conv_id)
            self.out(node, under, cut_off)

    def start(self, node: Open) -> int:
        """The block where a node starts that a border cuts."""
        return self.block if node.fresh else self.starts[node.local]

    def out(self, node: Open, under: Open | None, cut_off: bool) -> None:
        j, prefix = self.before["j"], self.before["prefix"]
        whole = node.fresh and not cut_off
        row = {"kind": WHOLE if whole else CUT, "block": self.block, "local": node.local, "depth": j * self.chunk + node.local, "conv_id": node.conv_id, "n": node.n, "children": node.children, "leaves": node.leaves, "saved": node.saved, "joint": node.joint, "piece": 0}
        for child in node.below:
            self.rows.append(child | ({"parent_conv": node.conv_id} if whole else {"parent_local": node.local, "parent_start": self.start(node)}))
        if node.local == 0 and j > 0:
            self.rows.append({"kind": ROOT, "joint": prefix, "children": node.children})
            return
        parent: dict = {}
        if node.local == 1 and j > 0:
            parent = {"parent_joint": prefix}
        elif under is not None and not (whole and under.fresh):
            parent = {"parent_local": under.local, "parent_start": self.start(under)}
        if whole:
            row |= parent | {"ends": hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()}
            if under is not None and under.fresh and not parent:
                under.below.append(row)
            else:
                self.rows.append(row)
            return
        row["start"] = self.start(node)
        if node.fresh:  # the piece that the node starts with names its parent
            row |= parent
        pieces = [node.ends[a : a + PIECE] for a in range(0, len(node.ends), PIECE)] or [[]]
        for k, ids in enumerate(pieces):
            extra = {} if k == 0 else {c: 0 for c in ("n", "children", "leaves", "saved")}
            self.rows.append(row | extra | {"piece": k, "ends": ",".join(map(str, ids))})

    def finish(self) -> None:
        if self.before is not None:
            self.close(self.right)
            self.close(-1, cut_off=True)


def tree_rows(table: DataFrame, borders: Borders) -> DataFrame:
    """Rows of ``PART`` for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if stack is not None and len(stack.rows) >= least:
                yield pa.RecordBatch.from_pylist(stack.rows, PART)
                stack.rows = []

        for batch in batches:
            for item in batch.to_pylist():
                if stack is not None and stack.block != item["block"]:
                    stack.finish()
                    yield from flush(1)
                    stack = None
                stack = stack or Stack(item["block"], borders)
                stack.add(item)
                yield from flush(5_000)
        if stack is not None:
            stack.finish()
            yield from flush(1)

    return in_blocks(table).mapInArrow(run, _ddl(_SQL))


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """One row for each node that borders cut; its end list is hashed as its pieces stream by."""
    names = ["start", "local", "depth", "conv_id", "n", "children", "leaves", "saved", "ends", "joint", "block", "parent_local", "parent_start", "parent_joint"]
    schema = pa.schema([PART.field(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, code, some = None, None, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([held | {"ends": code.hexdigest()}], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or (held["start"], held["local"]) != (r["start"], r["local"]):
                    if held is not None:
                        yield done()
                    held, code, some = r, hashlib.sha256(), False  # sorted by block: the first piece is the one that names the parent
                else:
                    for c in ("n", "children", "leaves", "saved"):
                        held[c] += r[c]
                    held["conv_id"] = min(held["conv_id"], r["conv_id"])
                    held["joint"] = held["joint"] if r["joint"] is None else r["joint"]
                if r["ends"]:
                    code.update(("," if some else "").encode() + r["ends"].encode())
                    some = True
        if held is not None:
            yield done()

    dealt = pieces.select(*names, "piece").repartition("start", "local").sortWithinPartitions("start", "local", "block", "piece").select(*names)
    return dealt.mapInArrow(run, _ddl(names))


def trie_of_items(items: DataFrame, block_items: int = BLOCK_ITEMS, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie of ``items_of``."""
    items = cut(items, "sequences")
    zero = {"saved_below": F.lit(0).cast("long"), "leaves_below": F.lit(0).cast("long")}
    if items.where("total > 0 and cont").take(1):
        later, borders = sorted_blocks(items.where("j > 0"), "later", block_items, chunk)
        below = saved_below(later, borders)
        weighted = items.where(F.col("total") > chunk).join(below, ["conv_id", "j"])
        weighted = items.where(F.col("total") <= chunk).withColumns(zero).unionByName(weighted)
    else:
        weighted = items.withColumns(zero)
    table, borders = sorted_blocks(weighted, "sorted", block_items, chunk)
    rows = cut(tree_rows(table, borders), "tree")
    pieces = rows.where(F.col("kind") == CUT)
    across = cut(joined_pieces(pieces), "across")
    drop_cut(items, table)
    columns = ["block", "depth", "conv_id", "n", "children", "leaves", "saved", "ends", "joint", "parent_conv", "parent_local", "parent_start", "parent_joint"]
    nodes = rows.where(F.col("kind") == WHOLE).select(columns).unionByName(across.withColumn("parent_conv", F.lit(None).cast("long")).select(columns))
    if borders.deep:
        roots = rows.where(F.col("kind") == ROOT).groupBy("joint").agg(F.sum("children").alias("more"))
        joints = nodes.where("joint is not null")
        named = joints.select(F.col("joint").alias("parent_joint"), F.col("conv_id").alias("found"))
        grown = joints.join(roots, "joint").withColumn("children", F.col("children") + F.col("more")).select(columns)
        nodes = nodes.where("joint is null").unionByName(grown)
        under = nodes.where("parent_joint is not null").join(named, "parent_joint").withColumn("parent_conv", F.col("found")).select(columns)
        nodes = nodes.where("parent_joint is null").unionByName(under)
    # of a node that borders cut, each block has a piece: its children there find it by block, depth and start
    key = [F.col("start").alias("parent_start"), F.col("local").alias("parent_local")]
    places = pieces.where("piece = 0").select("block", *key).join(across.select(*key, F.col("conv_id").alias("found")), ["parent_start", "parent_local"])
    met = nodes.where("parent_local is not null").join(places, ["block", "parent_start", "parent_local"]).withColumn("parent_conv", F.col("found")).select(columns)
    nodes = nodes.where("parent_local is null").unionByName(met)
    return nodes.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def rebuilt_trie(rows: DataFrame, every: int = 5, most: int = 9, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_items: int = BLOCK_ITEMS, chunk: int = CHUNK) -> DataFrame:
    """The trie of conversations that begin as their bases do (``rebuilt_turns``)."""
    turns = cut(numbered_turns(rows, conv, turn, role, text), "turns")
    return trie_of_items(items_of(*rebuilt_turns(turns, every, most), chunk), block_items, chunk)


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_items: int = BLOCK_ITEMS, chunk: int = CHUNK) -> DataFrame:
    """The trie of conversations as they are."""
    turns = cut(numbered_turns(rows, conv, turn, role, text), "turns")
    totals = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    return trie_of_items(items_of(turns.join(totals, "conv_id"), totals.where("total = 0").select("conv_id"), chunk), block_items, chunk)
