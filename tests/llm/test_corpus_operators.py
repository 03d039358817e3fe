"""Corpus operators against brute force, libraries, round trips and held-out rows; and on the inputs that break things."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from clipsift.llm import bpe_counts, chunkprint, langid, maxent, nbest, packing, quality, queries, simhash, vamana, warc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{k % 977}x{k % 31}" for k in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "one two", None, "s", 7), (6, long, "en", "s", len(long)), (7, long, "fr", "s", len(long)), (None, "no id here at all", "en", None, None), (9, "x" * 200_000, "de", "s", 200_000), (10, "a  b c ▁ \U0001f389 <|endoftext|> <s>", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "component_id", "fingerprint", "score", "range", "key", "word", "n", "value", "block")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def held(ids, n, k):
    return [zlib.crc32(str(i).encode()) % n == k for i in ids]


# --- fingerprints and near copies


def slow_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def slow_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min(x for x in groups[root(i)] if x is not None) for i in range(len(ids))]


def test_simhash_groups(spark, sf, local):
    got = queries.op1_simhash(spark, sf).toPandas().sort_values("doc_id")
    fps = [slow_simhash(t) for t in local.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == slow_components(local.doc_id.tolist(), fps, 3)


def test_simhash_on_odd_rows(odd, empty):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicate_groups(odd).collect()}
    by_id = {d: (f, c) for d, f, c in got}
    assert {by_id[k] for k in (1, 2, 3)} == {(0, 1)} and by_id[7] == (by_id[6][0], 6) and by_id[None] is not None
    assert simhash.near_duplicate_groups(odd).count() == odd.count()
    assert simhash.near_duplicate_groups(empty).count() == 0
    kept = simhash.representatives(odd.where("doc_id is not null"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 9, 10] and kept.columns == odd.columns


def test_representatives_with_null_and_repeated_ids(spark):
    """Ids say nothing of which rows are copies: each group keeps one row, whatever ids its rows and those of other groups have."""
    text = {k: " ".join(f"{k}{i * i}" for i in range(30)) for k in "abcdef"}
    rows = [(1, "a"), (None, "a"), (None, "b"), (None, "c"), (None, "c"), (5, "d"), (4, "d"), (5, "e"), (7, "e"), (3, "f"), (3, "a"), (3, "f")]
    docs = spark.createDataFrame([(i, text[k], k) for i, k in rows], "doc_id long, text string, _row string").repartition(5)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r._row, r.doc_id) for r in kept.collect()) == [("a", 1), ("b", None), ("c", None), ("d", 4), ("e", 5), ("f", 3)]


def slow_representatives(docs, similarity):
    """Row numbers that stay, of (id, text) rows: one of each group that alike texts join."""
    order = lambda k: (docs[k][0] is None, docs[k][0] or 0, k)
    words = [tuple((t or "").lower().split()) for _, t in docs]
    owners = {}
    for k in sorted(range(len(docs)), key=order):
        owners.setdefault(words[k], k)
    own = sorted(owners.values(), key=order)
    shingles = {k: {words[k][a : a + 5] for a in range(max(1, len(words[k]) - 4))} for k in own}
    root = {k: k for k in own}
    for b, y in enumerate(own):
        for x in own[:b]:
            if len(shingles[x] & shingles[y]) >= similarity * len(shingles[x] | shingles[y]):
                low, high = sorted((root[x], root[y]), key=order)
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_representatives_against_brute_force(spark, local):
    """Real texts, their near copies with single words changed, copies of these, null and repeated ids."""
    rng = np.random.default_rng(8)
    rows = list(zip(local.doc_id.tolist(), local.text))[:150]
    for doc, text in rows[:60]:
        words = text.split(" ")
        for changes in (1, 3, 8):
            new = list(words)
            for at in rng.integers(0, len(words), changes):
                new[at] = f"changed{at}"
            rows.append((None if changes == 3 else int(doc) + 5000 * (changes == 8), " ".join(new)))
    rows = [(None if i is None else int(i), t, k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").coalesce(1)
    kept = {r.place for r in simhash.representatives(docs).collect()}
    expected = set(slow_representatives([(i, t) for i, t, _ in rows], 0.8))
    assert len(expected) < 200 and len(expected - kept) <= 1 and len(kept - expected) <= 0.05 * (len(rows) - len(expected))


def test_recall_of_near_copies(spark):
    """Pairs whose exact similarity is spread over 0.8 to 1 are found in 0.9 of all cases or more; pairs below 0.8 are left alone."""
    rng = np.random.default_rng(21)
    rows, alike, apart = [], [], []
    for k in range(500):
        words = [f"w{v}" for v in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        start, share = int(rng.integers(0, len(words) // 2)), rng.uniform(0.62, 1.0)
        lost = max(1, round(len(words) * (1 - share) / (1 + share)))  # a run that is replaced costs its words and the shingles around it
        new = [*words[:start], *(f"n{k}x{v}" for v in range(lost)), *words[start + lost :]]
        x, y = ({tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (words, new))
        similarity = len(x & y) / len(x | y)
        (alike if similarity >= 0.8 else apart).append(2 * k + 1)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(new))]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept >= {2 * k for k in range(500)} | set(apart) and len(alike) > 200 and len(apart) > 100
    assert np.mean([i not in kept for i in alike]) >= 0.95


def test_a_chain_is_one_group(spark):
    """First and last are alike to the middle one only; one row stays, whichever ids they have."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[k * 14 :], *(f"e{i}" for i in range(k * 14))]) for k in range(3)]
    for ids in itertools.permutations((1, 2, 3)):
        docs = spark.createDataFrame([*zip(ids, texts), (9, "a text of its own with some words")], "doc_id long, text string")
        assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [1, 9]


def test_alike_sets():
    sets = [np.arange(a, a + 20) for a in (0, 1, 2, 3, 100, 101, 500)] + [np.zeros(0, np.int64)]
    words = np.zeros((8, 2), np.uint64)
    assert simhash.alike_sets(words, sets, 0.8, 0).tolist() == [0, 0, 0, 0, 4, 4, 6, 7]
    words[4] = 7
    assert simhash.alike_sets(words, sets, 0.8, 5).tolist() == [0, 0, 0, 0, 4, 5, 6, 7]


def test_a_hot_group_of_near_copies(spark, monkeypatch):
    """Hundreds of near copies of one text, and as many exact ones: cells stay small, one row stays."""
    monkeypatch.setattr(simhash, "CELL", 50)
    base = [f"w{k * 7919 % 1000}" for k in range(300)]
    rows = [(k, " ".join([*base[: k % 200], f"x{k}", *base[k % 200 + 1 :]])) for k in range(600)] + [(k, " ".join(base)) for k in range(1000, 1600)] + [(k, f"other text {k} of its own " * 3) for k in range(2000, 2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [0, *range(2000, 2100)]


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_links_lose_none_in_a_dense_ball(spark, radius, monkeypatch):
    """Thousands of fingerprints within a few bits of each other share every key: blocks are compared, links stay few."""
    monkeypatch.setattr(simhash, "BLOCK", 200)
    rng = np.random.default_rng(radius)
    near = {int(np.bitwise_xor.reduce([1 << int(b) for b in rng.choice(60, rng.integers(0, 4), replace=False)] or [0])) for _ in range(900)}
    values = np.array(sorted(near | {int(x) for x in rng.integers(0, 2**62, 100)}), dtype=np.int64)
    links = simhash.hamming_links(spark.createDataFrame([(int(v),) for v in values], "fp long"), radius)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    close = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= radius
    label = np.arange(len(values))
    while True:
        new = np.where(close, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [roots.get(int(v), int(v)) for v in values] == values[label].tolist()
    assert links.count() < 20 * len(values)


def test_thresholds_are_the_cheapest_of_all():
    rng = np.random.default_rng(0)
    cost = np.concatenate([np.zeros((3, 1, 50)), np.cumsum(rng.uniform(0, 9, (3, 4, 50)), axis=1)], axis=1)
    got = simhash.thresholds(cost, 3)
    ways = [t for t in itertools.product(range(-1, 4), repeat=3) if sum(t) == 1]
    for i in range(50):
        assert sum(got[:, i]) == 1
        total = lambda t: sum(cost[g, t[g] + 1, i] for g in range(3))  # noqa: E731, B023
        assert total(got[:, i]) == pytest.approx(min(map(total, ways)))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {901: 900}


# --- segmentations


def test_segmentations_are_the_best_of_all():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = {m.id_to_piece(i): (m.get_score(i), i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    s = nbest.Segmenter(PIECES, 4)

    def every(w, at=0, score=0.0, ids=()):
        if at == len(w):
            yield score, ids
        for end in range(at + 1, len(w) + 1):
            if w[at:end] in known:
                yield from every(w, end, score + known[w[at:end]][0], (*ids, known[w[at:end]][1]))
        if at < len(w) and w[at] not in known:
            yield from every(w, at + 1, score + s.pieces.unknown, (*ids, *(m.piece_to_id(f"<0x{b:02X}>") for b in w[at].encode())))

    for text in ["hello", "a cat", "  x", "日本 é", "aaaaaa", "\U0001f389", "x▁y"]:
        ways = sorted(every("▁" + text.replace(" ", "▁")), key=lambda x: -x[0])
        got = s.segment([text])[0]
        assert [x for x, _ in got] == [x for x, _ in ways[:4]]
        assert len({tuple(i.tolist()) for _, i in got}) == len(got) and all((x, tuple(i.tolist())) in ways for x, i in got)
        assert all(s.pieces.decode(i) == m.decode(i.tolist()) == text.replace("▁", " ") for _, i in got)


def test_segmentations_on_odd_rows(odd, empty):
    got = nbest.segmentations(odd, PIECES, 2).collect()
    assert all(r.decoded for r in got)
    assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    assert [(r.rank, r.n_pieces, r.score) for r in got if r.doc_id == 1] == [(1, 0, 0.0)]
    assert nbest.segmentations(empty, PIECES).count() == 0


# --- chunk fingerprints


def test_chunkprints(spark, sf, local):
    got = queries.op3_chunkprint(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = local.text.tolist()
    edited = [chunkprint.edited_text(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    assert got.doc_id.tolist() == local.doc_id.tolist() and got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert got.fingerprint.tolist() == [chunkprint.written(chunkprint.fingerprints([t.encode()])[0]) for t in texts]
    assert got.edited_fingerprint.tolist() == [chunkprint.written(chunkprint.fingerprints([t.encode()])[0]) for t in edited]
    big = got[got.n_chars > 1000]
    assert big.near_edited.between(0.35, 0.6).mean() > 0.98 and big.near_next.median() < 0.05


def test_chunks_shift_with_the_text():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    a, b = chunkprint.fingerprints([data, b"inserted at the front " + data])
    assert chunkprint.likeness(a, b) > 0.97 and chunkprint.likeness(a, a) == 1
    ends = chunkprint.chunk_ends(0, len(data), *chunkprint.boundaries(np.frombuffer(data, dtype=np.uint8)))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunkprint.MOST and sizes[:-1].min() >= chunkprint.MIN


def slow_chunks(data):
    """Chunks by a hash rolled byte by byte: of each, its end."""
    ends, start = [], 0
    while start < len(data):
        end = min(start + chunkprint.MOST, len(data))
        for at in range(start + chunkprint.MIN, end):
            h = 0
            for back in range(16):
                if at - 1 - back >= 0:
                    h += xxhash.xxh32_intdigest(data[at - 1 - back : at - back], 1) << back
            mask = 0x3F << 20 if at - start <= chunkprint.NORMAL else 0xF << 20
            if not h & 0xFFFFFFFF & mask:
                end = at
                break
        ends.append(end)
        start = end
    return ends


def test_chunkprints_by_a_sequential_chunker(spark, sf, local):
    """Fingerprints and likeness of the query's rows, recomputed chunk by chunk."""
    import base64

    def printed(text):
        data, out, start = text.encode(), Counter(), 0
        for end in slow_chunks(data):
            out[xxhash.xxh3_64_digest(data[start:end])[: chunkprint.DIGEST]] += end - start
            start = end
        return out

    def alike(a, b):
        return sum(min(n, b[k]) for k, n in a.items()) / sum(a.values()) if a and b else float(bool(a) == bool(b))

    got = queries.op3_chunkprint(spark, sf).toPandas().set_index("doc_id")
    texts, ids = local.text.tolist(), local.doc_id.tolist()
    for k in [k for k in range(len(texts)) if len(texts[k]) < 1500][:40]:
        following = texts[(k + 1) % len(texts)]
        half = len(texts[k]) // 2
        own, edited, other = printed(texts[k]), printed(texts[k][: len(texts[k]) - half] + following[:half]), printed(following[:20_000])
        row = got.loc[ids[k]]
        for field, expected in (("fingerprint", own), ("edited_fingerprint", edited)):
            raw = base64.b64decode(row[field])
            entries = {raw[a : a + 5]: int.from_bytes(raw[a + 5 : a + 9], "big") for a in range(0, len(raw), 9)}
            assert entries == dict(expected) and list(entries) == sorted(entries)
        assert row.near_edited == pytest.approx(alike(own, edited))
        if len(following) < 5000:
            assert row.near_next == pytest.approx(alike(own, other))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_ring_order(spark, ranges):
    """Every row is followed by the next id's, across ranges and around the end, with ids null, repeated and far apart."""
    ids = [None, -(2**62), -5, 0, 3, 3, 3, 9, 2**40, *range(100, 140)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    rows = [(r.range, r.tail, r.doc_id) for r in chunkprint.in_ring_order(docs, ranges).collect()]
    order = sorted(ids, key=lambda i: (i is not None, i))
    by_range = [[i for n, tail, i in rows if n == k and not tail] for k in sorted({n for n, _, _ in rows})]
    assert [i for part in by_range for i in part] == order
    for k, part in enumerate(by_range):
        assert [i for n, tail, i in rows if n == k and tail][0] == by_range[(k + 1) % len(by_range)][0]


def test_chunkprints_on_odd_rows(odd, empty, spark):
    got = chunkprint.edit_resistance(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].fingerprint, by_id[1].near_next, by_id[6].near_next) == ("", 1.0, 1.0)
    assert chunkprint.edit_resistance(empty).count() == 0
    alone = chunkprint.edit_resistance(spark.createDataFrame([(5, "just one text of some length to cut", None, None, None)], DOCS)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# --- packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    expected = Counter()
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        expected.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= 2048
    return len(at)


def test_packing(spark, sf, local):
    rows = queries.op4_packing(spark, sf).collect()
    used = check_packing(rows, zip(local.doc_id, local.text))
    assert used <= 1.05 * sum(r.length for r in rows) / 2048 + 1


def test_packing_on_odd_rows(odd, empty):
    check_packing(packing.pack_documents(odd, BPE).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(empty, BPE).count() == 0


def test_sum_of_squares_takes_the_least_change():
    bins, offsets, n = packing.sum_of_squares([6, 5, 4, 5, 3, 7], 10)
    assert (bins, offsets, n) == ([0, 1, 0, 1, 2, 2], [0, 0, 6, 5, 0, 3], 3)


def test_sum_of_squares_against_trying_every_place():
    rng = np.random.default_rng(2)
    for capacity in (7, 20, 64):
        lengths = rng.integers(1, capacity + 1, 300).tolist()
        bins, offsets, n = packing.sum_of_squares(lengths, capacity)
        level = {}
        for size, at, offset in zip(lengths, bins, offsets):
            total = lambda change: sum(c * c for g, c in (Counter(capacity - x for x in level.values() if x < capacity) + Counter()).items() if g) if change is None else sum(c * c for c in Counter(capacity - x for x in {**level, **change}.values() if x < capacity).values())  # noqa: E731, B023
            open_gaps = {capacity - x: b for b, x in level.items() if capacity - x >= size}
            ways = [total({b: level[b] + size}) for b in open_gaps.values()] + [total({-1: size})]
            assert total({at: level.get(at, 0) + size}) == min(ways) and offset == level.get(at, 0)
            level[at] = offset + size
        assert len(level) == n


def test_copies_spread_over_packing_groups(spark, monkeypatch):
    """Thousands of equal rows are dealt like any others: no group is larger than twice the rest."""
    pieces = spark.createDataFrame([(None, 0, 0, 700, 5)] * 4000, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = packing.pack(packing.cut(pieces, "test-pieces"), 2048, 500).toPandas()
    number = -1 - got.sequence_id
    assert len(got) == 4000 and (number % 8).value_counts().between(350, 650).all()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all() and got.sequence_id.nunique() <= 2004


# --- archives


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = warc.response_records(pages, "2024-01-01T00:00:00Z")
    source = {r.page_id: r.record for r in responses.collect()}
    got = queries.op5_warc(spark, sf).collect()
    assert len(got) == 2 * len(source)
    for r in got:
        headers, block, end = warc.read_record(r.record)
        theirs, theirs_block, _ = warc.read_record(source[r.page_id])
        assert end == len(r.record) and warc.header(headers, "WARC-Refers-To") == warc.header(theirs, "WARC-Record-ID") == r.refers_to
        assert warc.header(headers, "WARC-Payload-Digest") == warc.header(theirs, "WARC-Payload-Digest") == warc.digest(warc.read_http(theirs_block)[2])
        assert warc.header(headers, "WARC-Block-Digest") == warc.digest(block) and r.content_length == len(block)
    assert len({r.record_id for r in got}) == len(got)
    written = warc.write_warc(responses, f"file://{tmp_path}/out").agg(F.sum("records")).first()[0]
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert written == len(back) and sorted(bytes(r.record) for r in back) == sorted(bytes(r) for r in source.values())


def test_warc_on_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/\r\nEvil: 1", "", "x"), (3, "http://a/b", "<p>A &amp; B<br>C<script>no</script><a href='../c?d=1&amp;e'>l</a>", "x"), (3, "http://a/b", "<p>A", "x"), (None, "u", "<!-- open <b>t", "x")], "page_id long, url string, html string, record string")
    got = warc.derive(warc.response_records(pages, "2024-01-01T00:00:00Z"))
    assert got.groupBy("kind").count().orderBy("kind").collect() == [("conversion", 5), ("metadata", 5)]
    text = {r.page_id: warc.read_record(r.record)[1] for r in got.where("kind = 'conversion'").collect() if r.content_length > 4}
    assert text[3] == b"A & B\nCl"
    meta = [warc.read_record(r.record)[1] for r in got.where("page_id = 3 and kind = 'metadata'").collect()]
    assert any(b'"url":"http://a/c?d=1&e"' in m for m in meta)
    bad = warc.derive(spark.createDataFrame([(1, b"junk"), (2, None)], "page_id long, record binary")).collect()
    assert [r.kind for r in bad] == ["invalid", "invalid"]


def test_hostile_pages_take_linear_time():
    import time

    for piece in ("<!--", "<a ", "<a href=", '<a href="', "<a '", "<script", "<title>", "</", "<a b=c ", "<x>" * 2, "=" * 4, "<a =", "&", "<script>x</scrip", "<a href='x\">"):
        for tail in ("", ">", '">', "-->"):
            page = piece * (1_000_000 // len(piece)) + tail
            began = time.perf_counter()
            warc.scan(page)
            assert time.perf_counter() - began < 8, piece


def test_pages_against_a_parser():
    """Text and links as the standard library's parser gives them, on random well-formed pages."""
    import random
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Shown(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.links, self.hidden = [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag in warc.BLOCKS:
                self.out.append("\n")
            self.hidden += tag in warc.HIDDEN
            link = next(((k, v) for k, v in attrs if k in ("href", "src")), None)
            if tag in warc.LINKED and link:
                self.links.append((tag, link[0], urljoin("http://h/p/", link[1].strip())))

        def handle_endtag(self, tag):
            if tag in warc.BLOCKS:
                self.out.append("\n")
            self.hidden -= tag in warc.HIDDEN

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    rng = random.Random(3)

    def node(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.35:
            return rng.choice(["plain words ", "a &amp; b ", "3 &lt; 4 ", "caf\u00e9\n", " x &#233; ", "don't ", ""])
        inner = "".join(node(depth + 1) for _ in range(rng.randint(0, 4)))
        if kind < 0.6:
            tag = rng.choice(["p", "div", "li", "h2", "section", "td"])
            return f"<{tag} class='a > b' data-x=1>{inner}</{tag}>"
        if kind < 0.8:
            return rng.choice([f'<a title="x>y" href="../c?d={depth}&amp;e=1">{inner}</a>', f"<b>{inner}</b>", f"<A HREF = 'http://o/z'>{inner}</A>", f"<span>{inner}</span>"])
        return rng.choice(["<!-- hidden > <p>no</p> -->", "<script src=s.js>var x = '<p>';</script>", "<style>p > a {}</style>", "<br>", "<img src='i.png' alt='>'>", "<hr/>"])

    for _ in range(300):
        page = "".join(node(0) for _ in range(5))
        text, _, links = warc.scan(page, "http://h/p/")
        parser = Shown()
        parser.feed(page)
        parser.close()
        lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
        assert text == "\n".join(x for x in lines if x)
        assert [(x["path"], x["url"]) for x in links] == [(f"{t.upper()}@/{a}", u) for t, a, u in parser.links]


def test_coded_payloads():
    import gzip
    import json

    page = "<title>Caf\u00e9</title><p>one</p>".encode()

    def made(payload, *headers):
        block = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *headers, "", ""]).encode() + payload
        return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "d"), ("WARC-Target-URI", "http://a/")], block)

    packed = gzip.compress(page)
    chunked = b"".join(b"%x;a=b\r\n%b\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    cases = [(page, ()), (packed, ("Content-Encoding: gzip",)), (zlib.compress(page), ("Content-Encoding: deflate",)), (chunked, ("Transfer-Encoding: chunked", "Content-Encoding: gzip")), (page, ("Transfer-Encoding: chunked", "Content-Encoding: gzip")), (packed[:-6], ("Content-Encoding: gzip",))]
    for payload, headers in cases:
        (_, _, meta), (_, _, text) = warc.derivatives(made(payload, *headers))
        assert text.decode() == "Caf\u00e9\none" and json.loads(meta)["title"] == "Caf\u00e9", headers


def test_damaged_archives_give_invalid_rows(spark, tmp_path):
    import gzip

    good = [warc.response(f"http://a/{k}", f"<p>{k}" * 50, str(k), "2024-01-01T00:00:00Z") for k in range(4)]
    (tmp_path / "a.warc").write_bytes(good[0] + b"junk\r\nmore junk\r\n" + good[1] + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" + good[2] + good[3][:-90])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in good[:2]) + gzip.compress(good[2])[:-30])
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    kinds = lambda end: [(r.kind, bytes(r.record)) if r.kind != "invalid" else ("invalid",) for r in sorted(rows, key=lambda r: r.position) if r.file.endswith(end)]
    whole = [("response", r) for r in good]
    assert kinds("a.warc") == [whole[0], ("invalid",), whole[1], ("invalid",), whole[2], ("invalid",)]
    assert kinds("b.warc.gz") == [whole[0], whole[1], ("invalid",)]


# --- language, quality


def test_languages(spark, sf, local):
    got = queries.op6_langid(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.held_out.tolist() == held(local.doc_id, 4, 2)
    assert (got.lang_pred == local.lang)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()


SCRIPTS = {  # frequent words; languages without spaces are written without
    "ru": "и в не на что он был это как она по но они к из у за то все так его же от для мы вы если когда только ещё был были",
    "uk": "і в не на що він був це як вона по але вони до з у за то всі так його ж від для ми ви якщо коли тільки ще було були",
    "bg": "и в не на че той беше това как тя по но те към от у за то всички така неговия също за нас вие ако когато само още бяха съм",
    "el": "και το να του η της με που την από για είναι στο των σε ο οι στην θα τα δεν τον τη τις αυτό ένα μας μου ότι αν",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 中 大 来 上 国 个 到 说 们 为 子 和 你 地 出 道 也 时 年 学生 老师 中国 今天 天气 很好 我们 他们 喜欢 电影",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その 学生 先生 日本 今日 天気 です ます 私たち 好き 映画",
    "ko": "이 그 저 것 수 등 들 및 에서 하는 있는 그리고 하지만 나는 너는 우리는 학생 선생님 한국 오늘 날씨 좋다 좋아한다 영화 있다 없다 했다 한다 에게 으로",
    "ar": "في من على إلى أن هذا التي الذي كان عن مع هو هي ما لا كل بعد قد بين أو حتى إذا عند منذ ذلك هذه لم كما أي غير",
    "fa": "در از به که این را با است برای آن یک خود تا کرد بر هم نیز گفت می شود شد اما باید دارد هر پس چه اگر همه ما شما",
    "hi": "के है में की से को और का यह पर हैं नहीं ने एक कि था लिए भी कर हो तो जो इस हम वह या गया दिया साथ कुछ",
    "th": "ที่ และ ใน เป็น ของ ได้ มี การ ไม่ จะ ให้ ว่า ไป มา กับ ความ จาก คน นี้ แต่ ก็ อยู่ แล้ว หรือ เขา เรา ประเทศ วันนี้ อากาศ ดี",
    "en": "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all",
}


def test_languages_of_all_scripts():
    """Neighbours in script are told apart: Cyrillic, Greek, Han with kana or alone, Hangul, Arabic letters, Devanagari, Thai."""
    rng = np.random.default_rng(12)
    grams = langid.Grams()

    def text(lang):
        return ("" if lang in ("zh", "ja", "th") else " ").join(rng.choice(SCRIPTS[lang].split(), rng.integers(6, 14)))

    names, weights, cut = langid.fit([(lang, grams(text(lang))) for lang in SCRIPTS for _ in range(60)], landmarks=30)
    for lang in SCRIPTS:
        best, _ = langid.score([grams(text(lang)) for _ in range(60)], weights, cut)
        assert np.mean([names[b] == lang for b in best]) > 0.95, lang


def test_grams_of_scripts_differ():
    grams = langid.Grams()
    one = ["中国", "日本", "한국", "ไทย", "عرب", "рус", "укр", "ελλ", "abc", "é", "हिन्दी"]
    assert len({tuple(grams(t)) for t in one}) == len(one) and all(len(grams(t)) for t in one)
    assert grams("ABC Ж").tolist() == grams("abc  ж").tolist() and len(grams("\u0301 12 ! \u093f")) == 0
    assert len(grams("ab1cd2ef ")) > len(grams("ab1"))


def test_kernel_weights_fold_exactly():
    """Scores are those of ridge regression on Nystr\u00f6m features, formed from kernel values between texts and landmarks alone."""
    grams = langid.Grams()
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "the end of the day", "la fin de la rue", "das ende der welt"]
    sample = [(x, grams(t)) for x, t in zip(("en", "fr", "de") * 2, texts)]
    names, weights, cut = langid.fit(sample, landmarks=2)
    assert names == ["de", "en", "fr"]
    marks = [g for name in names for lang, g in sample if lang == name]
    known = set(np.concatenate(marks).tolist())

    def kernel(a, b):
        return len(set(a.tolist()) & set(b.tolist()) & known) / math.sqrt(len(a) * len(b))

    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    root = np.linalg.inv(np.linalg.cholesky(gram)).T
    features = np.array([[kernel(g, m) for m in marks] for _, g in sample]) @ root
    target = np.array([[float(lang == n) for n in names] for lang, _ in sample])
    centred = features - features.mean(axis=0)
    solved = np.linalg.solve(centred.T @ centred + langid.RIDGE * len(sample) / len(marks) * np.eye(len(marks)), centred.T @ (target - target.mean(axis=0)))
    for probe in ("the hund de", "katze", "\u00c7a va", "the dog"):
        g = grams(probe)
        expected = (np.array([kernel(g, m) for m in marks]) @ root - features.mean(axis=0)) @ solved + target.mean(axis=0)
        got = weights[g].sum(axis=0) / np.sqrt(len(g)) + cut
        assert np.allclose(got, expected, atol=2e-3)
        best, share = langid.score([g], weights, cut)
        positive = np.maximum(got, 0)
        assert best[0] == expected.argmax() and share[0] == pytest.approx(positive.max() / positive.sum(), abs=1e-5)


def test_languages_with_repeated_ids_and_dirty_labels(spark, docs, monkeypatch):
    """One id with different rows gives one model whatever the order of rows; rare labels beyond the bound aren't learned."""
    monkeypatch.setattr(langid, "LANGUAGES", 4)
    dirty = docs.where("doc_id = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("lang", F.concat(F.lit("dirty"), F.col("k").cast("string"))).drop("k")
    more = docs.unionByName(docs.where("doc_id < 40").withColumns({"text": F.concat("text", F.lit(" zz")), "lang": F.lit("xx")})).unionByName(dirty)
    models = [langid.learn(more.repartition(n), F.lit(True)) for n in (1, 7)]
    assert models[0][0] == models[1][0] and len(models[0][0]) <= 4 and np.array_equal(models[0][1], models[1][1])


def test_languages_on_odd_rows(odd, empty, docs):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3)) and langid.identify(odd).count() == odd.count()
    assert langid.identify(empty).count() == 0
    model = langid.learn(docs, F.lit(True))
    kept = langid.keep(odd, model, 0.0)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3})


def test_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    got = queries.op9_quality(spark, sf).toPandas().set_index("doc_id")
    assert got.held_out.tolist() == held(got.index, 4, 2) and (got.predicted == (got.score >= 0.7)).all()
    test = got[got.held_out].join(labels, how="inner")
    assert (test.predicted == test.quality).mean() > 0.9


def test_votes_are_those_of_the_nearest():
    rng = np.random.default_rng(3)
    rows, labels = rng.uniform(0, 1, (40, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 40)
    m = quality.Latent(rows, labels, dimensions=8)
    probe = [rng.uniform(0, 1, quality.TERMS).astype(np.float32) for _ in range(5)]
    for p, s in zip(probe, m.scores(probe, neighbours=7)):
        v = p * m.idf
        v = v / np.linalg.norm(v) @ m.directions
        cosines = m.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cosines)[:7]
        w = np.maximum(cosines[near], 1e-6) ** quality.POWER
        assert s == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)


def test_quality_on_odd_rows(odd, empty, docs, spark, sf):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (7, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(odd, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


# --- token counts


def test_token_counts(spark, sf, local):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = queries.op7_token_counts(spark, sf).toPandas().sort_values("doc_id")
    assert got.n_tokens.tolist() == [len(x) for x in m.encode(local.text.tolist())]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in local.text]
    assert (got.over_limit == (got.n_tokens > 4096)).all()


def test_merges_of_awkward_strings():
    import random

    import sentencepiece

    m, c, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), bpe_counts.Counter(PIECES), random.Random(9)
    texts = ["", " ", "  a", "a ", "\n", "▁", "a▁ b", "a" * 999, "=" * 333, " " * 50] + ["".join(rng.choice("ab  e\n▁é日\U0001f3891=-<>") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    assert c.count(texts) == [len(x) for x in m.encode(texts)]


@pytest.mark.parametrize("long, stops", [(512, 500), (2, 500), (2, 0)])
def test_merges_of_long_rows(monkeypatch, long, stops):
    """Short strings through the path of long rows, and a million characters without spaces."""
    import random
    import time

    import sentencepiece

    monkeypatch.setattr(bpe_counts, "LONG", long)
    monkeypatch.setattr(bpe_counts, "STOPS", stops)
    m, c, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), bpe_counts.Counter(PIECES), random.Random(10)
    texts = ["".join(rng.choice(["th", "he", "e", "in", "ing", "the", "a", "t", "h", "s", "st", "▁", "é", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    assert c.count(texts) == [len(x) for x in m.encode(texts)]
    if long == 512:
        whole = ["th" * 500_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "=" * 1_000_000, " " * 1_000_000]
        began = time.perf_counter()
        got = c.count(whole)
        assert time.perf_counter() - began < 60 and got == [len(x) for x in m.encode(whole)]


def test_token_counts_on_odd_rows(odd, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in bpe_counts.token_counts(odd, PIECES).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(m.encode(r.text or ""))) for r in odd.collect())
    assert bpe_counts.token_counts(empty, PIECES).count() == 0


# --- language model


def base_scores(texts, train):
    counts = Counter(w for t in train for w in [*maxent.tokens(t), b"\n"])
    total, types = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        ws = [*maxent.tokens(t), b"\n"]
        out.append((len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)))
    return total, out


def test_language_model(spark, sf, local):
    got = queries.op8_maxent(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    flags = held(local.doc_id, 5, 1)
    total, expected = base_scores(local.text, [t for t, f in zip(local.text, flags) if not f])
    assert got.held_out.tolist() == flags and set(got.train_tokens) == {total}
    assert list(zip(got.n_tokens, got.n_known)) == [x[:2] for x in expected]
    assert np.allclose(got.base_score, [x[2] for x in expected], rtol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_probabilities_sum_to_one():
    words = [b"the", b"cat", b"le", b"chat", b"der"]
    m = maxent.start_model(words, np.array([9.0, 4, 7, 3, 2]), 5, 6)
    t = maxent.Trainer(m)
    for _ in range(30):
        t.texts([[b"the", b"cat", b"zzz"], [b"le", b"chat"], [b"the", b"cat"]])
    t.word_step()
    m = t.model
    before, features = m.history(*m.ids([[b"the", b"zzz"], [b"le"]]))
    p_class, within = np.exp(m.class_logs(features)), np.exp(m.word_logs())
    for k in range(len(before)):
        assert sum(p_class[k, c] * within[before[k], w] for w, c in enumerate(m.classes)) + p_class[k, [c for c in range(maxent.CLASSES) if c not in set(m.classes)]].sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_sums_of_word_probabilities(spark, sf, monkeypatch):
    """The query's scores, word by word from the model's weights: feature rows hashed one at a time, plain softmax, counts of rare words."""
    made = []
    monkeypatch.setattr(maxent, "VOCABULARY", 300)
    train_round = maxent.train_round
    monkeypatch.setattr(maxent, "train_round", lambda *a: made.append(train_round(*a)) or made[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 600")
    got = maxent.score_documents(docs, fold(docs), vocabulary=300).toPandas().set_index("doc_id")
    m, local = made[-1], docs.toPandas()
    train = [t for t, i in zip(local.text, local.doc_id) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in maxent.tokens(t))
    rare = {w: c for w, c in counts.items() if w not in m.number}
    rare_total = sum(rare.values()) + 0.5 * (len(rare) + 1)
    first = len(m.number) + 2
    row = lambda v, salt: (((v + salt) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - int(math.log2(maxent.ROWS)))
    assert len(m.number) == 300 and int(got.train_tokens.iloc[0]) == sum(counts.values()) + len(train)
    for text, doc in list(zip(local.text, local.doc_id))[:25]:
        total, one, two = 0.0, first, first
        for w in [*maxent.tokens(text), None]:
            k = m.end if w is None else m.number.get(w, m.rare)
            z = m.bias.astype(np.float64) + m.rows[row(one, 1)] + m.rows[row(two, 1 << 20)] + m.rows[row(one * (first + 1) + two, 1 << 40)]
            before = m.classes[m.end] if one == first else m.classes[one]
            own = m.words[before].astype(np.float64)
            within = own[m.classes == m.classes[k]]
            total += z[m.classes[k]] - np.log(np.exp(z).sum()) + own[k] - np.log(np.exp(within).sum())
            if k == m.rare:
                total += math.log((rare.get(w, 0) + 0.5) / rare_total)
            one, two = k, one
        assert got.score[doc] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def fold(docs):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1


def test_vocabulary_is_filled_and_ties_go_by_word(spark):
    counts = spark.createDataFrame([(f"w{k:03d}".encode(), 5 if k < 10 else 2) for k in range(100)], "word binary, n long")
    assert [w for w, _ in maxent.frequent(counts, 25)] == [f"w{k:03d}".encode() for k in range(25)]
    assert len(maxent.frequent(counts, 1000)) == 100 and maxent.frequent(counts, 0) == []


def test_spelling_counts_every_pair_and_triple():
    words = [b"a", b"banana", b"x" * 5000, "\u00e9t\u00e9".encode()]
    classes = maxent.spelling_classes(words, np.ones(4), 4)
    assert len(set(classes.tolist())) == 4
    assert maxent.spelling_classes([], np.zeros(0), 3).tolist() == []


def test_language_model_on_odd_rows(odd, empty, spark):
    got = maxent.score_folds(odd)
    assert got.count() == odd.count() and got.where("score is null or base_score is null or isnan(score) or score > 0").isEmpty()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].n_tokens == 1 and rows[1].base_score == pytest.approx(rows[2].base_score)
    assert maxent.score_folds(empty).count() == 0
    untrained = maxent.score_documents(odd, F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.n_known == 0 for r in untrained)


# --- vectors


def exact_nearest(ids, x, q, k):
    s = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_nearest_vectors(spark, sf):
    p = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id").reset_index(drop=True)
    x, ids = np.stack(p.embedding).astype(np.float64), p.vec_id.to_numpy()
    got = queries.op10_vamana(spark, sf).toPandas().sort_values(["query_id", "rank"])
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert sorted(set(got.query_id)) == ids[asked].tolist()
    hits = 0
    for q in asked:
        mine = got[got.query_id == ids[q]]
        expected = exact_nearest(ids, x, q, 20)
        hits += len(set(mine.vec_id) & {i for i, _ in expected})
        at = {int(i): k for k, i in enumerate(ids)}
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1)) and np.allclose(mine.score, [(x[at[i]] * x[q]).sum() for i in mine.vec_id], rtol=1e-12)
        assert all(a >= b for a, b in zip(mine.score, mine.score[1:]))
    assert hits / (20 * len(asked)) >= 0.9


def test_nearest_on_odd_vectors(spark):
    """Copies of one vector are a third of all; ties go to smaller ids; unfit vectors take no part."""
    rng = np.random.default_rng(8)
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(0, 300)] + [(k, rng.normal(size=3).tolist()) for k in range(300, 900)]
    rows += [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 0.0]), (1060, [float("nan"), 1.0, 0.0]), (1080, [float("inf"), 1.0, 0.0]), (1100, [1.0, 2.0]), (1120, []), (None, [1.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    got = vamana.nearest(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20).toPandas().sort_values(["query_id", "rank"])
    fit = rows[:900]
    x, ids = np.array([v for _, v in fit]), np.array([k for k, _ in fit])
    assert sorted(set(got.query_id)) == list(range(0, 900, 20))
    for q in range(0, 900, 20):
        assert got[got.query_id == q].vec_id.tolist() == [i for i, _ in exact_nearest(ids, x, q, 20)]
    assert vamana.nearest(df.where("false"), F.lit(True)).count() == 0
    other = vamana.nearest(df.unionByName(spark.createDataFrame([(2000, [3.0, 1.0]), (2001, [1e308, 1e308]), (2002, [1e-300, 0.0])], "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))), F.col("vec_id").isin(1100, 2002))
    assert [(r.query_id, r.vec_id) for r in other.orderBy("query_id", "rank").collect()] == [(1100, 2001), (1100, 2000), (1100, 2002), (2002, 2001), (2002, 2000), (2002, 1100)]
    ties = spark.createDataFrame([(k, [1.0, float(k * 37 % 101)]) for k in range(1, 101)] + [(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vamana.nearest(ties, F.col("vec_id") == 0).orderBy("rank").collect()] == list(range(1, 21))
    few = vamana.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r.vec_id, r.score) for r in few.orderBy("rank").collect()] == [(1, 0.5), (2, 0.0)]


@pytest.mark.parametrize("kind", ["unit", "gauss", "lognormal"])
def test_recall_in_shards_far_larger_than_the_beam(kind):
    """Vectors of equal and of very unequal length, as they are dealt to bands and shards; no shard is searched whole."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 48))
    if kind != "gauss":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, (len(x), 1))
    asked = rng.choice(len(x), 150, replace=False)
    band = np.floor(np.log(np.linalg.norm(x, axis=1)) / np.log(vamana.RATIO))
    found = [set() for _ in asked]
    for b in np.unique(band):
        at = np.flatnonzero(band == b)
        graph, start = vamana.build(vamana.unit(x[at]))
        for own, ids in zip(found, vamana.beam_search(x[at].astype(np.float32), graph, start, vamana.unit(x[asked]), vamana.QUERY_BEAM)[0]):
            own.update(at[ids[ids >= 0]])
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    recall = np.mean([len(own & set(np.argsort(-s)[:20])) / 20 for own, s in zip(found, score)])
    assert recall >= 0.9


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 24)) * rng.lognormal(0, 0.3, (4000, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vamana.nearest(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20, shard_rows=1500).toPandas()
    hits = [len(set(own.vec_id) & {i for i, _ in exact_nearest(np.arange(len(x)), x, q, 20)}) for q, own in got.groupby("query_id")]
    assert len(hits) == 200 and sum(hits) / (20 * len(hits)) >= 0.95
