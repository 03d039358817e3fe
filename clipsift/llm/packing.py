"""Tokenised documents packed into sequences of a fixed length by the sum-of-squares rule.

Each document becomes its token ids and one end id. Longer documents are cut into full pieces; what is left over, at most one
short piece a document, is the first piece. Full pieces are sequences of their own. Short pieces are dealt by the hash of their row
number (so copies spread like any other rows) into groups of about ``GROUP`` pieces, longest first; each is placed where the sum, over residual gaps, of the squared number of open sequences
with that gap becomes smallest (ties: the smallest gap, an open sequence before a new one). Sequences of a group that fit into one
another are joined at the end.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed each on their own; no rows give none.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm._chunks import WordStore
from clipsift.llm._common import cut, ids_and_texts, slices

#: Short pieces of a group: a group's sequences that stay open waste about a three-hundredth of it.
GROUP = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How byte-level tokenizers split a text before merging; a fixed value of that family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rank_encoder(spec: dict):  # noqa: ANN201
    """A faster encoder for the same ids, where they number the merges in their order; None where they don't."""
    import tiktoken

    vocab, added = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens") or []}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merged = [vocab.get(a + b, -1) for a, b in pairs]
    to_byte = byte_symbols()
    words = {w: i for w, i in vocab.items() if w not in added}
    if merged != list(range(256, 256 + len(merged))) or len(words) != 256 + len(merged) or any(c not in to_byte for w in words for c in w):
        return None
    ranks = {bytes(to_byte[c] for c in w): i for w, i in words.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids as the tokenizers library gives them for a vocabulary file, with nothing added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t["content"] for t in spec.get("added_tokens") or []]
        split = spec.get("pre_tokenizer") or {}
        self._by_word = not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self._fast = rank_encoder(spec) if self._by_word else None
        self._store = WordStore(self._word_ids)

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words that hold no added token."""
        return self._ids(words) if self._fast is None else [self._fast(w) for w in words]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that hold an added token's string, and all texts of a tokenizer that doesn't split them at spaces, go through whole."""
        whole = [i for i, t in enumerate(texts) if not self._by_word or any(a in t for a in self._added)]
        out = self._store.sequences(["" if i in set(whole) else t for i, t in enumerate(texts)] if whole else texts)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]) if whole else []):
            out[i] = np.array(ids, dtype=np.uint32)
        return out


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document; only the first may be shorter than ``capacity`` in a longer document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows: list[tuple[int, int, int, int]] = []
                counts = np.zeros(len(texts), dtype=np.int64)
                for k, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    ends = range(first, len(ids) + 1, capacity)
                    counts[k] = len(ends)
                    at = 0
                    for piece, end in enumerate(ends):
                        rows.append((piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                        at = end
                cols = list(zip(*rows))
                ids_out = pa.compute.take(part.column(0), pa.array(np.repeat(np.arange(len(texts)), counts)))
                yield pa.RecordBatch.from_arrays([ids_out, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each length, in the order given, and the number of bins."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = [], [], 0
    for s in lengths:
        best, gap = (2 * open_bins[capacity - s] + 1 if s < capacity else 0), capacity
        if s + 1 < capacity:
            wider = open_bins[s + 1 : capacity]
            change = np.where(wider > 0, 2 * (open_bins[1 : capacity - s] - wider + 1), np.iinfo(np.int64).max)
            k = int(change.argmin())
            if change[k] <= best:
                best, gap = change[k], s + 1 + k
        if s < capacity and open_bins[s] and 1 - 2 * open_bins[s] <= best:
            gap = s
        if gap == capacity:
            at, n = n, n + 1
        else:
            at = by_gap[gap].pop()
            open_bins[gap] -= 1
        bins.append(at)
        offsets.append(capacity - gap)
        if gap > s:
            by_gap[gap - s].append(at)
            open_bins[gap - s] += 1
    return bins, offsets, n


def joined_bins(lengths: list[int], bins: list[int], offsets: list[int], n: int, capacity: int) -> tuple[list[int], list[int], int]:
    """The same placing with whole bins put together where they fit: fullest first, each into the smallest gap that takes it.

    The sum-of-squares rule keeps bins open for lengths to come; where these don't come, as among copies, it leaves bins half empty.
    """
    level = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    into, shift, held = np.arange(n), np.zeros(n, dtype=np.int64), level.copy()
    for b in np.argsort(-level, kind="stable").tolist():
        size = int(level[b])
        wide = np.flatnonzero(open_bins[size:])
        if len(wide):
            gap = size + int(wide[0])
            at = by_gap[gap].pop()
            open_bins[gap] -= 1
            into[b], shift[b] = at, held[at]
            held[at] += size
            b, gap = at, gap - size
        else:
            gap = capacity - size
        by_gap[gap].append(b)
        open_bins[gap] += 1
    left, number = np.unique(into, return_inverse=True)
    at = np.asarray(bins, dtype=np.int64)
    return number[at].tolist(), (np.asarray(offsets, dtype=np.int64) + shift[at]).tolist(), len(left)


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``pieces`` is read three times and its rows are numbered as read: pass a table."""
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            number = table.column("bucket")[0].as_py()
            lengths = table.column("length").to_pylist()
            bins, offsets, _ = joined_bins(lengths, *sum_of_squares(lengths, capacity), capacity)
            out = table.drop_columns(["bucket"]).append_column("sequence_id", pa.array(-1 - (np.array(bins, dtype=np.int64) * groups + number))).append_column("offset", pa.array(offsets, pa.int64()))
            return out.to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
                if held and held[0].column("bucket")[0].as_py() != bucket[0]:
                    yield packed()
                    held = []
                end = int(np.searchsorted(bucket, bucket[0], side="right"))
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
        if held:
            yield packed()

    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    dealt = short.withColumn("bucket", bucket).repartitionById(groups, F.col("bucket")).sortWithinPartitions("bucket", F.desc("length"), "doc_id", "piece")
    return full.unionByName(dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces"), capacity)
