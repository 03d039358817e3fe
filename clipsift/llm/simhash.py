"""SimHash fingerprints, links within a Hamming radius, and the groups that the links join.

Links are found by the generalised pigeonhole principle. The 64 bits are dealt into m partitions,
correlated bits together. A fingerprint gets one threshold for each partition, -1 (skip it) to
``radius``, that sum to ``radius - m + 1``: whatever differs from it in at most ``radius`` bits
differs in at most the threshold in some partition. Dynamic programming picks the thresholds whose
probes and estimated candidates cost least; the estimates come from counts over all fingerprints.
Candidates meet by key (partition, value), are verified in blocks, and leave a task as a spanning
set of links, so that a group of n near copies gives at most n rows a block and not n * n.

Defined results: a null text counts as empty; an empty text has fingerprint zero and is linked like
any other; repeated rows share a fingerprint; no rows give no rows. Only distinct fingerprints are
compared, so copies cost nothing here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm._common import cut, drop_cut, ids_and_texts, slices

BITS = 64
SEED = 42
#: Cost of a shuffled probe row, in candidate comparisons.
PROBE_COST = 100.0
#: Rows of one key that a task compares; keys with more are split into pairs of blocks.
BLOCK = 4096
#: Keys with more than one in so many rows are joined apart; fewer than this many can be.
SHARE = 1000
#: Rows of a run of one key beyond which it is compared by itself.
LONG_RUN = 64
#: Fingerprints by which near copies are proposed, and bits of 128 in which those proposed differ at most.
PRINTS, NEAR = 8, 32
#: Rows and shingles of a cell in which near copies are compared.
CELL, CELL_SHINGLES = 2048, 2_000_000
#: Bits of the widest value that is counted exactly: the counts of a block are at most 2 ** 16 numbers.
COUNTED_BITS = 16


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, separated by ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; fewer words are one run, none give none."""
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    digests = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(SEED))
    return np.fromiter(digests, dtype="<u8", count=len(words) - shingle + 1)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text, as a signed 64-bit number; see ``simhash_table``."""
    return fingerprint(shingle_hashes(words_of(text), shingle))


def fingerprint(hashed: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashed)
    if n == 1:
        return int(hashed.view("<i8")[0])
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashed[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): XXH64 (seed 42) of each word shingle votes for each bit; a bit is set by more than half.

    A-Z is lower-cased, words are separated by ASCII white space, repeated shingles count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = [simhash(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, of each pair of bits, how many have both: 64 x 64 sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            n += len(values)
            for at in range(0, len(values), 1 << 14):
                x = _bits(values[at : at + (1 << 14)]).astype(np.float32)
                both += x.T @ x
        flat = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["pos", "total"])

    rows = fps.select("fp").mapInArrow(run, "pos long, total double").groupBy("pos").agg(F.sum("total").alias("total")).toPandas()
    flat = np.zeros(BITS * BITS + 1)
    flat[rows["pos"].to_numpy(dtype=int)] = rows["total"].to_numpy(dtype=float)
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m groups of nearly equal width; each grows by the bit most correlated with what it holds."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        order = sorted(left)
        group = [max(order, key=lambda b: (strength[b, order].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            order = sorted(left)
            best = order[int(np.argmax(strength[np.ix_(group, order)].sum(axis=0)))]
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def number_of_groups(n: int, radius: int) -> int:
    """The m with the least cost for n evenly spread fingerprints."""

    def cost(m: int) -> float:
        w, total, rows, candidates = BITS / m, radius - m + 1, 0.0, 0.0
        for k in range(m):  # thresholds as even as can be
            t = total // m + (k < total % m)
            balls = sum(math.comb(math.floor(w), e) for e in range(t + 1))
            rows += max(balls, 1)
            candidates += balls * n / 2**w
        return PROBE_COST * rows + candidates

    return min(range(1, radius + 2), key=lambda m: (cost(m), m))


def _blocks(group: list[int]) -> list[list[int]]:
    k = math.ceil(len(group) / COUNTED_BITS)
    return [list(x) for x in np.array_split(np.array(group), k)]


def _value(bits: np.ndarray, block: list[int]) -> np.ndarray:
    return bits[:, block].astype(np.int64) @ (1 << np.arange(len(block), dtype=np.int64))


def distance_layers(counts: np.ndarray, radius: int) -> np.ndarray:
    """layers[e, v]: how many of the counted values differ from v in exactly e bits."""
    width = int(math.log2(len(counts)))
    layers = np.zeros((radius + 1, len(counts)))
    layers[0] = counts
    at = np.arange(len(counts))
    for b in range(width):
        flipped = layers[:, at ^ (1 << b)]
        layers[1:] = layers[1:] + flipped[:-1]
    return layers


def candidate_layers(fps: DataFrame, groups: list[list[int]], radius: int) -> list[list[np.ndarray]]:
    """Distance layers of each block of each group, from counts over all fingerprints (at most 2 ** 16 numbers a block)."""
    blocks = [b for g in groups for b in _blocks(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(b), dtype=np.int64) for b in blocks]
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 16):
                bits = _bits(values[at : at + (1 << 16)])
                for c, b in zip(counts, blocks):
                    c += np.bincount(_value(bits, b), minlength=len(c))
        for k, c in enumerate(counts):
            seen = np.flatnonzero(c)
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k)), pa.array(seen), pa.array(c[seen])], names=["block", "value", "n"])

    rows = fps.select("fp").mapInArrow(run, "block long, value long, n long").groupBy("block", "value").agg(F.sum("n").alias("n")).toPandas()
    out, k = [], 0
    for g in groups:
        own = []
        for b in _blocks(g):
            counts = np.zeros(1 << len(b))
            mine = rows[rows["block"] == k]
            counts[mine["value"].to_numpy(dtype=int)] = mine["n"].to_numpy(dtype=float)
            own.append(distance_layers(counts, radius).astype(np.float32))
            k += 1
        out.append(own)
    return out


def estimated_candidates(bits: np.ndarray, group: list[int], layers: list[np.ndarray], n: int, radius: int) -> np.ndarray:
    """cn[e, i]: estimated fingerprints within e bits of the i-th in this group; blocks of a group count as independent."""
    total = None
    for block, layer in zip(_blocks(group), layers):
        own = layer[:, _value(bits, block)].astype(np.float64) / max(n, 1)
        if total is None:
            total = own
        else:
            total = np.stack([sum(total[a] * own[e - a] for a in range(e + 1)) for e in range(radius + 1)])
    return np.cumsum(total * n, axis=0)


def thresholds(cost: np.ndarray, radius: int) -> np.ndarray:
    """cost[group, 1 + threshold, i], threshold -1 to radius: the cheapest thresholds of each i that sum to radius - m + 1."""
    m, _, n = cost.shape
    top = radius + 1  # of the sum of (threshold + 1)
    best = np.full((top + 1, n), np.inf)
    best[0] = 0
    picks = []
    for g in range(m):
        new, pick = np.full((top + 1, n), np.inf), np.zeros((top + 1, n), dtype=np.int8)
        for s in range(top + 1):
            for t in range(s + 1):
                c = best[s - t] + cost[g, t]
                better = c < new[s]
                new[s][better], pick[s][better] = c[better], t
        best = new
        picks.append(pick)
    out, left = np.zeros((m, n), dtype=np.int64), np.full(n, top)
    for g in reversed(range(m)):
        out[g] = picks[g][left, np.arange(n)]
        left = left - out[g]
    return out - 1


def _masks(group: list[int], e: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(group, e)], dtype=np.uint64).view(np.int64)


def probes(fps: DataFrame, groups: list[list[int]], layers: list[list[np.ndarray]], n: int, radius: int) -> DataFrame:
    """(part, val, role) and the columns of ``fps``: role 1 can be found under the key, 2 looks for others under it, 3 does both."""
    shared = fps.sparkSession.sparkContext.broadcast(layers)  # at most 64 / 16 + m blocks of 2 ** 16 * (radius + 1) numbers
    keep = np.array([sum(1 << b for b in g) for g in groups], dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [[_masks(g, e) for e in range(radius + 1)] for g in groups]

        def rows(k: int, val: np.ndarray, at: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(val), k, dtype=np.int32)), pa.array(val), pa.array(role.astype(np.int32)), *(pa.array(c[at]) for c in every)], names=["part", "val", "role", *names])

        for batch in batches:
            every = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for begin in range(0, batch.num_rows, 1 << 13):
                fp = every[0][begin : begin + (1 << 13)]
                bits, all_ = _bits(fp), np.arange(begin, begin + len(fp))
                cost = np.zeros((len(groups), radius + 2, len(fp)))
                for k, g in enumerate(groups):
                    cn = estimated_candidates(bits, g, shared.value[k], n, radius)
                    balls = np.cumsum([math.comb(len(g), e) for e in range(radius + 1)])
                    cost[k, 1:] = PROBE_COST * (balls[:, None] - 1) + cn
                t = thresholds(cost, radius)
                for k in range(len(groups)):
                    yield rows(k, fp & keep[k], all_, np.where(t[k] >= 0, 3, 1))
                    for e in range(1, radius + 1):
                        own = all_[t[k] >= e]
                        step = max(1, (1 << 18) // max(1, len(masks[k][e])))
                        for a in range(0, len(own), step):
                            some = own[a : a + step]
                            if len(masks[k][e]):
                                val = ((every[0][some] & keep[k])[:, None] ^ masks[k][e][None, :]).ravel()
                                yield rows(k, val, np.repeat(some, len(masks[k][e])), np.full(len(val), 2))

    names = ["fp", *(c for c in fps.columns if c != "fp")]
    return fps.select(names).mapInArrow(run, "part int, val long, role int, " + ", ".join(f"{c} long" for c in names))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join what the pairs (a, b) join: each value and the smallest that it is joined to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of words differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _run_links(node: np.ndarray, words: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one long run: each of the fewer of those found and those looking is compared with all of the others at once."""
    label = np.arange(len(node))
    found, looking = np.flatnonzero(role & 1), np.flatnonzero(role >> 1)
    few, many = (found, looking) if len(found) <= len(looking) else (looking, found)
    a, b = [], []
    for i in few.tolist():
        near = many[(_apart(words[many], words[i]) <= radius) & (label[many] != label[i])]
        if len(near):
            joined, one = np.unique(label[near], return_index=True)  # one link to each set that it joins
            a.append(np.full(len(one), node[i]))
            b.append(node[near[one]])
            label[np.isin(label, joined)] = label[i]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def verified(key: np.ndarray, node: np.ndarray, words: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by ``key`` (the number of their run): pairs of one run, one found and one looking, whose words (a row each) differ in ``radius`` bits at most."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    for start, n in zip(first[size > LONG_RUN].tolist(), size[size > LONG_RUN].tolist()):
        x, y = _run_links(node[start : start + n], words[start : start + n], role[start : start + n], radius)
        a.append(x)
        b.append(y)
    held, at = sum(map(len, a)), np.flatnonzero(np.repeat(size <= LONG_RUN, size))
    for step in range(1, len(key)):
        if step >= LONG_RUN:
            break
        at = at[: np.searchsorted(at, len(key) - step)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        other = at + step
        hit = (_apart(words[at], words[other]) <= radius) & (((role[at] & 1) & (role[other] >> 1)) | ((role[at] >> 1) & (role[other] & 1))).astype(bool) & (node[at] != node[other])
        if hit.any():
            a.append(node[at[hit]])
            b.append(node[other[hit]])
            held += int(hit.sum())
            if held > 500_000:
                x, y = spanning(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
    if not held:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return spanning(np.concatenate(a), np.concatenate(b))


def hamming_links(fps: DataFrame, radius: int = 3, node: str = "fp", words: Sequence[str] = ("fp",), within: int | None = None) -> DataFrame:
    """(a, b): links that join exactly what the pairs of distinct ``fp`` within ``radius`` bits join.

    ``fps`` holds each fingerprint once. No pair is lost: every fingerprint looks for all others within the radius.
    A key with more than ``BLOCK`` rows is dealt into blocks, and each pair of blocks is compared apart.

    With other ``words`` (columns of ``fps``), rows of a key are linked where those differ in ``within`` bits at most, and links are
    of ``node``, a column that tells rows apart; ``fp`` and ``radius`` then only say which rows meet.
    """
    spark = fps.sparkSession
    n, both = bit_moments(fps)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    bits, columns = radius if within is None else within, list(dict.fromkeys([node, *words]))
    groups = correlated_groups(n, both, number_of_groups(n, radius))
    rows = cut(probes(fps.select(*dict.fromkeys(["fp", *columns])), groups, candidate_layers(fps, groups, radius), n, radius), "probes")
    many = rows.groupBy("part", "val").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).select("part", "val", F.ceil(F.col("rows") / BLOCK).cast("int").alias("k"))
    many = cut(many, "hotkeys")
    if many.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0))
    else:
        own = F.pmod(F.xxhash64(node), F.col("k")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.least(own, o) * F.col("k") + F.greatest(own, o))
        dealt = rows.join(many, ["part", "val"], "left").withColumn("cell", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(cells))).drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[np.ndarray]) -> pa.RecordBatch:
            part, val, cell, role = held[:4]
            own = dict(zip(columns, held[4:]))
            new = np.ones(len(part), dtype=bool)
            new[1:] = (part[1:] != part[:-1]) | (val[1:] != val[:-1]) | (cell[1:] != cell[:-1])
            a, b = verified(np.cumsum(new), own[node], np.stack([own[w].view(np.uint64) for w in words], axis=1), role, bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
            same = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(same):  # the last run may go on in the next batch
                end = same[-1] + 1
                yield links([x[:end] for x in held])
                held = [x[end:] for x in held]
        if held is not None:
            yield links(held)

    keys = ["part", "val", "cell"]
    found = dealt.select(*keys, "role", *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
    found = cut(found.distinct(), "links")
    drop_cut(rows, many)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links reaches; alternating large and small stars.

    A round joins each node's links with its smallest neighbour, found by a partial aggregate: no list of neighbours is gathered.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        pairs = large.join(least, "u")
        small = pairs.select("u", F.col("low").alias("v")).unionByName(pairs.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct()
        new = cut(small, "edges")
        sums = [(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) for x in (edges, new)]
        drop_cut(edges)
        edges = new
        if sums[0] == sums[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def join_by_share(many: DataFrame, one: DataFrame, key: str, total: int, keep: bool = False) -> DataFrame:
    """``many`` with the row of ``one`` that has its key; ``one`` holds in ``n`` how many rows of ``many`` have each key.

    Keys with more than a thousandth of the ``total`` rows are broadcast, as fewer than a thousand can have so many; the others, none
    of them large, meet in a shuffle.
    """
    hot = F.col("n") * SHARE > total
    keys = F.broadcast(one.where(hot))
    rest = many.join(keys.select(key), key, "left_anti").join(one.where(~hot), key)
    met = many.join(keys, key).unionByName(rest)
    return met if keep else met.drop("n")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``; component_id is the smallest id reachable over links.

    Fingerprints that differ in at most ``radius`` bits are linked. A null id comes after all others: component_id is null only where
    all rows of a group have null ids.
    """
    fps = cut(simhash_table(docs, id_col, text_col, shingle), "simhash")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    rows, different = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = components(hamming_links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    named = cut(join_by_share(rooted, least, "root", different).select("fp", F.col("rows").alias("n"), "component_id"), "named")
    drop_cut(distinct, rooted, least)
    return join_by_share(fps, named, "fp", rows).select("doc_id", "fp", "component_id")


def mixed(hashed: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent hashes made of one; the first is the hash itself."""
    if k == 0:
        return hashed
    z = hashed + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _prints(rows: DataFrame, key: str, id_col: str, text_col: str, shingle: int, prints: int) -> DataFrame:
    """(row, id, p0 ..., digest, size): of each row its fingerprints, a digest of its words in order, and the number of its shingles."""
    names = [f"p{k}" for k in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for t in part.column(1).to_pylist():
                    words = words_of(t)
                    hashed = shingle_hashes(words, shingle)
                    found.append((xxhash.xxh3_128_digest(b" ".join(words)), len(hashed), *(fingerprint(mixed(hashed, k)) if len(hashed) else 0 for k in range(prints))))
                digests, sizes, *fps = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(f, pa.int64()) for f in fps), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["row", "id", *names, "digest", "size"])

    return ids_and_texts(rows, key, text_col, F.col(f"`{id_col}`").cast("long").alias("id")).mapInArrow(run, f"row long, id long, {', '.join(f'{c} long' for c in names)}, digest binary, size long")


def alike_sets(words: np.ndarray, sets: list[np.ndarray], similarity: float, within: int) -> np.ndarray:
    """For each row the first row that it is joined to by pairs whose words differ in ``within`` bits at most and whose Jaccard similarity is ``similarity`` or more."""
    n = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    ends = np.cumsum(size)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else size
    own = [number[e - k : e] for e, k in zip(ends.tolist(), size.tolist())]
    mark, label = np.zeros(int(number.max(initial=-1)) + 1, dtype=bool), np.arange(n)
    for a in range(n - 1):
        rest = slice(a + 1, None)
        near = (label[rest] != label[a]) & (np.minimum(size[rest], size[a]) >= similarity * np.maximum(size[rest], size[a]))
        near = np.flatnonzero(near) + a + 1
        near = near[_apart(words[near], words[a]) <= within]
        if len(near):
            mark[own[a]] = True
            for b in near.tolist():
                if label[b] != label[a]:
                    shared = int(mark[own[b]].sum())
                    if shared >= similarity * (size[a] + size[b] - shared):
                        low, high = sorted((label[a], label[b]))
                        label[label == high] = low
            mark[own[a]] = False
    return label


def _alike_links(members: DataFrame, shingle: int, similarity: float, within: int) -> DataFrame:
    """(a, b): links that join the rows of ``members`` (text, component, cells, cell, row, w0, w1) that are alike and of one component."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(words_of(t), shingle)).view("<i8") for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.list_(pa.int64()))], names=["component", "cells", "cell", "row", "w0", "w1", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("shingles").combine_chunks()
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            words = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("w0", "w1")], axis=1)
            label = alike_sets(words, [flat[a:b] for a, b in zip(at - at[0], at[1:] - at[0])], similarity, within)
            row, joined = table.column("row").to_numpy(), np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(row[joined]), pa.array(row[label[joined]])], names=["a", "b"])

        keys = None
        for batch in batches:
            while batch.num_rows:
                component, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("component", "pair"))
                other = np.flatnonzero((component != component[0]) | (cell != cell[0]))
                end = int(other[0]) if len(other) else batch.num_rows
                if keys not in (None, (component[0], cell[0])):
                    yield judged()
                    held = []
                keys = (component[0], cell[0])
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
        if held:
            yield judged()

    sets = members.mapInArrow(hashed, "component long, cells int, cell int, row long, w0 long, w1 long, shingles array<long>")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.least("cell", o) * F.col("cells") + F.greatest("cell", o))
    dealt = sets.select("component", F.explode(pairs).alias("pair"), "row", "w0", "w1", "shingles")
    return dealt.repartition("component", "pair").sortWithinPartitions("component", "pair", "row").mapInArrow(run, "a long, b long")


def _joined_by(links: list[DataFrame]) -> DataFrame:
    """(node, root) of what all ``links`` join. The first join most of a group; of the others only those go on whose ends these leave apart,
    so that a large group isn't carried through the rounds once for each of them."""
    first = cut(components(links[0]), "roots")
    if len(links) == 1:
        return first
    rest = links[1]
    for more in links[2:]:
        rest = rest.unionByName(more)
    for end in ("a", "b"):
        known = first.select(F.col("node").alias(end), "root")
        rest = rest.join(known, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    over = cut(components(rest.where("a <> b").distinct()), "roots")
    again = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = first.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = cut(moved.unionByName(over), "roots")
    drop_cut(first, over)
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, prints: int = PRINTS) -> DataFrame:
    """One row of each group of near copies, all columns as they are: the one with the smallest id (null after all others).

    Rows with the same words in order are copies. Two texts are alike where their sets of shingles have a Jaccard similarity of
    ``similarity`` or more, and a group is what alike texts join: of a chain whose neighbours are alike, one row stays.

    One 64-bit fingerprint says too little of a similarity of 0.8 (its texts differ in about 10 bits). So there are several, of
    independent hashes. Under each, rows meet that share a partition of its bits (radius 3), and are proposed where two other
    fingerprints together differ in ``NEAR`` of 128 bits at most, which holds for 999 of 1000 pairs at 0.8 and for unrelated texts
    about once in a hundred million pairs: proposals join no unrelated rows, however many rows there are. Exact shingle sets decide.
    A pair at 0.8 meets under one of eight fingerprints with a chance of 0.91, at 0.85 of 0.98, at 0.9 of 0.999.

    What proposals join is dealt by hash into cells of at most about ``CELL`` rows and ``CELL_SHINGLES`` shingles, and each pair of
    cells is compared in one task that gives spanning links. Rows are told apart by a key that is written with them, as ids may be
    null or repeated.
    """
    key = "_row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    rows = cut(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = cut(_prints(rows, key, id_col, text_col, shingle, prints), "prints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    every = [f"p{k}" for k in range(prints)]
    texts = cut(found.groupBy("digest").agg(F.min(order).alias("first"), *[F.min(c).alias(c) for c in (*every, "size")]).drop("digest").withColumn("row", F.col("first")["row"]), "texts")
    drop_cut(found)
    met = []
    for k in range(prints):
        w0, w1 = every[(k + 1) % prints], every[(k + 2) % prints]
        met.append(hamming_links(texts.select(F.col(every[k]).alias("fp"), F.col("row").alias("node"), F.col(w0).alias("w0"), F.col(w1).alias("w1")), 3, "node", ("w0", "w1"), NEAR))
    roots = _joined_by(met)
    drop_cut(*met)
    grouped = texts.join(roots, texts["row"] == roots["node"], "left").select("row", "size", F.col(every[0]).alias("w0"), F.col(every[1 % prints]).alias("w1"), F.coalesce("root", "row").alias("component"))
    grouped = cut(grouped, "grouped")
    sizes = cut(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1"), "sizes")
    cells = F.ceil(F.greatest(F.col("n") / CELL, F.col("total") / CELL_SHINGLES)).cast("int")
    members = join_by_share(grouped, sizes, "component", grouped.count(), keep=True).withColumn("cells", cells)
    members = members.select(F.col("row").alias(key), "component", "cells", F.pmod(F.xxhash64("row"), F.col("cells")).cast("int").alias("cell"), "w0", "w1")
    words = rows.select(key, F.col(f"`{text_col}`").cast("string").alias("text")).join(members, key).select("text", "component", "cells", "cell", F.col(key).alias("row"), "w0", "w1")
    alike = cut(_alike_links(words, shingle, similarity, NEAR + 8).distinct(), "alike")
    drop_cut(grouped, sizes, roots)
    joined = components(alike)
    joined = cut(joined.unionByName(joined.select(F.col("root").alias("node"), "root")).distinct(), "joined")
    least = texts.join(joined, texts["row"] == joined["node"]).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first")["row"].alias(key))
    stay = texts.join(joined, texts["row"] == joined["node"], "left_anti").select(F.col("row").alias(key)).unionByName(least)
    return rows.join(stay, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
