"""Document fingerprints of content-defined chunks, and how much of one document another contains.

Boundaries come from a gear hash over the last ``MIN`` bytes, by normalised chunking: a strict mask up to the normal size, a loose
one after it, a forced cut at the largest size. As the hash sees no further back than the smallest chunk, boundaries fall where
the content says and soon agree again after an insertion. A fingerprint is the set of chunk digests, each weighted by the bytes
that it stands for; likeness is the share of a document's bytes that the other document has in the same chunks (of a chunk that
both have, the smaller of its two weights). A fingerprint takes 12 characters for each 32 or so bytes of text.

Documents are sorted into ranges of ids, as many as the input has partitions or shuffles have (whichever is more), so a range holds
no more than a fixed amount of text at any size; rows of one id stay in one range, where they stream.

Defined results: a null text is empty, its fingerprint the empty string; two empty fingerprints are alike (1), an empty and
another are not (0); equal texts have equal fingerprints. Rows are ordered by id (null first), rows of one id by text.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.llm._common import ids_and_texts, slices

#: Bytes of a chunk: least (the window of the hash), where the loose mask takes over, most.
MIN, NORMAL, MOST = 16, 32, 128
#: One boundary in 64 places before the normal size, in 16 after it.
STRICT, LOOSE = np.uint32(0x3F << 20), np.uint32(0xF << 20)
ENTRY = np.dtype([("digest", ">u8"), ("weight", ">u4")])
#: Bytes of a digest that are kept.
DIGEST = 5
#: Sampled ids of a range, from which its bounds are taken.
SAMPLED = 32
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)


def boundaries(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of chunks that the strict and the loose mask allow, in ascending order."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0]
    return (strict + 1).tolist(), (loose + 1).tolist()


def chunk_ends(start: int, end: int, strict: list[int], loose: list[int]) -> list[int]:
    out = []
    while start < end:
        i = bisect_left(strict, start + MIN)
        cut = min(start + MOST, end)
        if i < len(strict) and strict[i] <= start + NORMAL:
            cut = min(cut, strict[i])
        else:
            i = bisect_left(loose, start + NORMAL + 1)
            if i < len(loose):
                cut = min(cut, loose[i])
        out.append(cut)
        start = cut
    return out


def fingerprints(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(digests in ascending order, bytes that each stands for) of each text."""
    buffer = b"".join(texts)
    strict, loose = boundaries(np.frombuffer(buffer, dtype=np.uint8)) if buffer else ([], [])
    out, start = [], 0
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        end = start + len(text)
        ends = chunk_ends(start, end, strict, loose)
        starts = [start, *ends[:-1]]
        if not ends:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        digests = np.fromiter((digest(buffer[a:b]) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(ends)) >> np.uint64(8 * (8 - DIGEST))
        kept, at = np.unique(digests, return_inverse=True)
        out.append((kept, np.bincount(at, weights=np.subtract(ends, starts)).astype(np.int64)))
        start = end
    return out


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: of each chunk five bytes of digest and four of weight, in base64."""
    rows = np.zeros(len(print_[0]), dtype=ENTRY)
    rows["digest"], rows["weight"] = print_
    return base64.b64encode(rows.view(np.uint8).reshape(-1, ENTRY.itemsize)[:, 8 - DIGEST :].tobytes()).decode()


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the first one's bytes whose chunks the other has as well."""
    if not len(one[0]) or not len(other[0]):
        return float(len(one[0]) == len(other[0]))
    at = np.minimum(np.searchsorted(other[0], one[0]), len(other[0]) - 1)
    shared = np.minimum(one[1], other[1][at])[other[0][at] == one[0]].sum()
    return float(shared / one[1].sum())


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` ascending bounds are at most ``key``, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def range_bounds(keys: DataFrame, ranges: int) -> tuple[int | None, list[int]]:
    """The least ``key`` and keys that begin further ranges (fewer than ``ranges``), from a sample of distinct keys by their hash."""
    n, least = keys.agg(F.count(F.lit(1)), F.min("key")).first()
    if not n:
        return None, []
    share = min(1.0, SAMPLED * ranges / n)
    sample = keys.where((F.pmod(F.xxhash64("key"), F.lit(1 << 31)) < int(share * (1 << 31))) & (F.col("key") > least)).distinct()
    found = sorted(r["key"] for r in sample.collect())
    return least, sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def in_ring_order(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, range, tail): each range's rows in order, ended by a row with tail 1 that begins the next range.

    A range begins with its bound, which is the key of a row; texts are shuffled once. After the last range comes the first.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    least, found = range_bounds(docs.select(key.alias("key")), ranges)
    bounds, number = F.split(F.lit(",".join(map(str, found))), ",").cast("array<long>"), len(found) + 1
    keyed = docs.withColumn("key", key)
    keyed = keyed.withColumn("range", _range_of(F.col("key"), bounds, len(found)) if found else F.lit(0))
    begins = F.col("key") == F.coalesce(F.get(bounds, F.col("range") - 1), F.lit(least)) if found else F.col("key") == F.lit(least)
    here, ahead = F.struct(F.col("range"), F.lit(0).alias("tail")), F.struct(F.pmod(F.col("range") - 1, F.lit(number)).alias("range"), F.lit(1).alias("tail"))
    dealt = keyed.withColumn("to", F.explode(F.when(begins, F.array(here, ahead)).otherwise(F.array(here)))).select("doc_id", "text", "key", "to.range", "to.tail")
    return dealt.repartitionById(number, F.col("range")).sortWithinPartitions("range", "tail", "key", "text").select("doc_id", "text", "range", "tail")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_resistance(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document its fingerprint, that of the text edited with the next document's, and how alike they and the next one's are."""
    spark = docs.sparkSession
    own = ids_and_texts(docs, id_col, text_col)
    ranges = max(own.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        """Of each text but the last, which only follows."""
        own = fingerprints([t.encode() for t in texts])
        edited = [edited_text(a, b).encode() for a, b in zip(texts, texts[1:])]
        changed = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([written(f) for f in own[:-1]], pa.string()),
                pa.array([written(f) for f in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        done = None  # the range whose tail has come
        for batch in batches:
            for part in slices(batch):
                for doc_id, text, number, tail in zip(*(c.to_pylist() for c in part.columns)):
                    if number == done:
                        continue
                    ids.append(doc_id)
                    texts.append(text or "")
                    if tail:
                        yield rows(ids, texts)
                        ids, texts, done = [], [], number
                if len(texts) > 1:
                    yield rows(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return in_ring_order(own, ranges).mapInArrow(run, SCHEMA)
