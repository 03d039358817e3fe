"""Prefix tries, whitening and exact top-k against brute force, DuckDB and numpy; and on the inputs that break things."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.llm import queries, sorted_lists, trie, whitening

TURNS = "conv_id long, turn long, role string, text string"
CLASH = ("pos", "block", "place", "j", "key", "x", "n", "shard", "qid", "rank", "score", "component", "depth", "total", "size", "digest")


def oracle(sf, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(queries.ORACLE_SQL[name])


@pytest.mark.parametrize(("name", "table"), [("op11_trie", "conversations"), ("op13_sorted_lists", "embeddings")])
def test_same_rows_as_sql(spark, sf, name, table):
    found = oracle(sf, name, table)
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))


# --- prefix trie


def slow_trie(rows, every=5, most=9):
    """Every prefix of every conversation in a table."""
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], (r, x)))
    turns = {c: [v[3] for v in sorted(found)] for c, found in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most if every else 0
        whole[c] = tuple((turns.get(c - int(math.fmod(c, every)), [])[:h] if every else []) + own[h:])
    members, below = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    totals, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        under = [totals[b] for b in below.get(node, [])]
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        totals[node] = (sum(u[0] for u in under) or 1, own + sum(u[1] for u in under))
        ends = ",".join(map(str, sorted(c for c in members[node] if whole[c] == node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(under), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 3), (2, 3), (3, 64)])
def test_tries_over_many_blocks(spark, seed, chunk):
    """Nulls, ties, copies, common first turns, conversations of many items, nodes that span blocks."""
    r, rows = random.Random(seed), []
    for c in [*range(-12, 60), None]:
        n = r.choice([0, 1, 1, 2, 3, 4, 7, 12, 30])
        some = [(r.choice([None, *range(-3, 40)]), r.choice(["u", "a", None]), r.choice(["x", "y", "", None, "é"]) if r.random() < 0.4 else "same") for _ in range(n)]
        rows += [(c, *t) for t in (some if r.random() < 0.7 else [(k, "u", "same") for k in range(n)])]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(5)
    assert plain(trie.rebuilt_trie(df, block_items=6, chunk=chunk)) == slow_trie(rows)
    if seed == 2:
        assert plain(trie.prefix_trie(df, block_items=6, chunk=chunk)) == slow_trie(rows, every=0)


def test_tries_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.rebuilt_trie(empty).count() == 0
    assert trie.rebuilt_trie(spark.createDataFrame([(None, 0, "u", "x")], TURNS)).count() == 0
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 50) if c % 5}
    alone = next(c for c in h if h[c] > 1)  # its base is absent, so its only turn goes
    rows = [(alone, 0, "u", "gone")]
    nothing = hashlib.sha256(str(alone).encode()).hexdigest()
    assert plain(trie.rebuilt_trie(spark.createDataFrame(rows, TURNS))) == [(alone, 0, None, 1, 0, 1, 0, nothing)] == slow_trie(rows)
    long = "word " * 100_000
    rows = [(5 * k, t, "u", long if t == 0 else f"{k % 2}") for k in range(30) for t in range(4)]  # copies, a very long text
    assert plain(trie.rebuilt_trie(spark.createDataFrame(rows, TURNS), block_items=5)) == slow_trie(rows)


def test_one_conversation_with_most_turns(spark):
    rows = [(0, k, "u", f"{k // 7}") for k in range(3000)] + [(c, k, "u", f"{k // 7 if k != c * 40 else 'x'}") for c in (5, 10, 15) for k in range(900)]
    df = spark.createDataFrame(rows, TURNS)
    assert plain(trie.rebuilt_trie(df, block_items=4)) == slow_trie(rows)


def test_nearest_smaller_blocks():
    r = random.Random(4)
    minima = [(3 * b, r.randrange(-1, 6), 0) for b in range(200)]
    minima = [(b, -1 if k == 0 else left, min(-1 if k == 0 else left, r.randrange(-1, 6))) for k, (b, left, _) in enumerate(minima)]
    got = trie.nearest_smaller(minima)
    for k, (block, left, _) in enumerate(minima):
        assert got[block] == [next(b for b, _, low in reversed(minima[:k]) if low < d) for d in range(left + 1)]


# --- whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def slow_whitening(vectors):
    """(vec_id, n, deviation, |whitened|, explained) by the covariance's eigenvectors, of vectors of one dimension."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def check_whitening(got, vectors, tolerance=1e-9):
    n, deviation, whitened, explained = slow_whitening(vectors)
    k = len(explained)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    order = np.argsort([i for i, _ in vectors], kind="stable")
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert [r.deviation for r in got[::k]] == deviation[order].tolist()
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    signs = np.sign((w * whitened[order]).sum(axis=0))
    assert np.abs(w - signs * whitened[order]).max() < tolerance
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(queries.op12_whitening(spark, sf).collect(), [tuple(r) for r in rows])


def test_whitening_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fine = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * (100, 10, 1, 1, 0.1)]) for i in range(300)]
    fine += [(i, fine[0][1]) for i in range(300, 500)] + [(7, fine[7][1]), (500, [0.0] * 5)]  # copies, a repeated row, zeros
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan] * 5), (903, [math.inf] + [0.0] * 4), (904, [])]
    other = [(700 + i, [float(i), float(i * i % 7)]) for i in range(20)]  # a space of its own, with two components
    df = spark.createDataFrame([(*r, 0) for r in fine + bad + other], VECTORS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(7)
    got = whitening.whiten(df).collect()
    inside = [r for r in got if r.vec_id < 700]
    twice = sorted([r for r in inside if r.vec_id == 7], key=lambda r: r.component)
    assert len(twice) == 8 and twice[0] == twice[1] and {r.vec_id for r in got} == {i for i, _ in fine + other}
    check_whitening([r for r in inside if r.vec_id != 7] + twice[::2], list(dict((i, v) for i, v in fine).items()))
    check_whitening([r for r in got if r.vec_id >= 700], other)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 0.5, 0.25], 0), (None, [0.5, 0.5, 0.25], 0)], VECTORS)
    got = whitening.whiten(same).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r.whitened for r in got if r.component > 1} == {0.0} and {round(r.explained, 9) for r in got if r.component == 1} == {1.0}
    assert got[0].identity_error < 1e-9


def test_whitening_of_huge_entries(spark):
    rows = [(i, [1e15 * i, -3e15 * (i % 3), 1e300], 0) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 18 and {r.deviation for r in got if r.vec_id == 0} == {None} and got[0].identity_error < 1e-6


@pytest.mark.parametrize("shape", [(40, 7), (12, 12), (5, 9), (1, 3)])
def test_rotations_give_the_decomposition(shape):
    rng = np.random.default_rng(6)
    a = rng.normal(size=shape) * np.logspace(0, -9, shape[1])  # graded: small values must be as accurate as large ones
    r = whitening.reduced(whitening.reduced(None, a[: len(a) // 2]), a[len(a) // 2 :]) if len(a) > 1 else whitening.reduced(None, a)
    lengths, v = whitening.jacobi(r)
    real = min(shape)
    exact = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(lengths[:real], exact[:real], rtol=1e-6, atol=0) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
    assert np.allclose(np.sqrt(((a @ v) ** 2).sum(axis=0))[:real], lengths[:real], rtol=1e-6)


# --- exact top-k


def slow_top(vectors, asks, k):
    """By comparing everything, in whole numbers."""
    whole = {i: [max(min(math.floor(256 * float(c)), (1 << 63) - 1024), -(1 << 63)) if abs(c) < 1e300 else (1 << 63) - 1024 if c > 0 else -(1 << 63) for c in v] for i, v in vectors}
    out = []
    for q in sorted(whole):
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))
            out += [(q, n + 1, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "lengths", "copies"])
def test_top_k_over_shards(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 6))
    if kind == "ties":
        x = rng.integers(-1, 2, (700, 6)) / 64
    elif kind == "lengths":
        x *= np.exp(3 * rng.normal(size=(700, 1)))
    elif kind == "copies":
        x[rng.random(700) < 0.5] = x[0]
    vectors = [(int(i) - 50, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<double>, label int").repartition(6)
    got = sorted_lists.top_k(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, answers=5, shard_rows=90).collect()
    assert sorted(map(tuple, got)) == slow_top(vectors, lambda i: i % 20 == 0, 5)


def test_top_k_of_odd_vectors(spark):
    vectors = [(0, [0.0, 0.0]), (50, [1.0, -1.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (100, [2.0]), (150, [1.0, 1.0, 1.0]), (3, [-1.0]), (200, [1e18, 1e300]), (4, [-1e18, 1e18])]
    bad = [(250, None), (300, [None, 1.0]), (350, [math.nan, 1.0]), (400, [math.inf, 1.0]), (450, []), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*v, 0) for v in vectors + bad + vectors[:1]], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in CLASH})
    got = sorted_lists.top_k(df, F.col("vec_id") % 50 == 0, answers=3).collect()
    assert sorted(map(tuple, got)) == slow_top(vectors, lambda i: i % 50 == 0, 3)
    assert sorted_lists.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert sorted_lists.top_k(df.where("vec_id = 150"), F.col("vec_id") % 50 == 0).count() == 0


def test_lists_stop_early_and_keep_ties():
    rng = np.random.default_rng(9)
    x = rng.integers(-40, 40, (3000, 8))
    lists = sorted_lists.Lists(x)
    asked = rng.integers(-40, 40, (40, 8))
    asked[7] = 0
    scores = asked @ x.T
    least = np.sort(scores, axis=1)[:, -6].tolist()
    for by in (None, 0, 50):
        got = {q: (found, score) for q, found, score in lists.search(asked, 6, [None if by is None else s - by for s in least])}
        assert len(got) == 40 and len(got[7][0]) == 3000
        for q, (found, score) in got.items():
            assert found.tolist() == np.flatnonzero(scores[q] >= least[q]).tolist() and (score == scores[q][found]).all()
    assert not list(lists.search(asked, 6, [int(s.max()) + 1 for s in scores])) or all(len(f) == 0 for _, f, _ in lists.search(asked, 6, [int(s.max()) + 1 for s in scores]))
