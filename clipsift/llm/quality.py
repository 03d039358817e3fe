"""Quality scores by votes of the most similar labelled texts in a latent-semantic space.

A text becomes term weights: its words (lower-cased, hashed to ``WORDS`` terms), n-grams of ``ORDER`` character classes (letters,
capitals, digits, kinds of punctuation, white space) and measures of the whole text (share of distinct words, of distinct lines, of capitals, of symbols, length of words, length),
each spread over its two nearest steps. Weights are log frequency times inverse document frequency, of unit length. The leading
eigenvectors of the labelled sample's term products span the latent space. The labelled vectors, a bounded number, are broadcast;
every document's cosines with all of them are exact, computed in blocks, and its ``NEIGHBOURS`` nearest vote by similarity.

Defined results: a null text is empty; an empty text has no neighbours and scores the labelled mean; with no labels every score
is 0.5. Repeated rows get equal scores; of a repeated id the smallest label and the smallest text count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.llm._common import fold_of, ids_and_texts, slices, where_text

ORDER, CLASSES, STEPS = 3, 16, 16
MEASURES, WORDS = 6, 2048
#: Terms in the order of their numbers: n-grams, measures, words.
FIRST_WORD = CLASSES**ORDER + MEASURES * STEPS
TERMS = FIRST_WORD + WORDS
#: Weight of a measure among the logs of n-gram counts.
MEASURE_WEIGHT = 6.0
#: Weight of a word's log count among those of n-grams.
WORD_WEIGHT = 0.5
#: Labelled texts that are learned from and vote, latent dimensions, voters, and the power of similarity that weighs a vote.
SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 6000, 48, 15, 8
#: Documents of a block of cosines.
BLOCK = 1024


def _byte_classes() -> np.ndarray:
    out = np.full(256, 15, dtype=np.int64)
    out[128:] = 1
    for chars, c in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" ", 4), ("\n\r", 5), ("\t\v\f", 6), (".,", 7), (";:", 8), ("!?", 9), ("'\"", 10), ("()[]{}<>", 11), ("@#$%^&*+=~`_", 12), ("|/\\", 13), ("-", 14)):
        for ch in chars:
            out[ord(ch)] = c
    return out


_CLASS = _byte_classes()


def term_counts(text: str) -> np.ndarray | None:
    """Term weights of one text before inverse document frequencies; None where it has no characters."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return None
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    kinds = np.bincount(c, minlength=CLASSES)
    out = np.zeros(TERMS, dtype=np.float32)
    if len(c) >= ORDER:
        code = c[: len(c) - ORDER + 1].copy()
        for k in range(1, ORDER):
            code *= CLASSES
            code += c[k : len(c) - ORDER + 1 + k]
        n = CLASSES**ORDER
        out[:n] = np.log1p(np.bincount(code, minlength=n) * (256.0 / len(code)))
    words, lines = raw.lower().split(), raw.split(b"\n")
    if words:
        distinct = Counter(words)
        at = np.fromiter(map(xxhash.xxh32_intdigest, distinct), dtype=np.int64, count=len(distinct)) % WORDS
        times = np.bincount(at, weights=np.fromiter(distinct.values(), dtype=np.float64, count=len(distinct)), minlength=WORDS)
        out[FIRST_WORD:] = WORD_WEIGHT * np.log1p(times * (256.0 / len(words)))
    letters = int(kinds[1] + kinds[2])
    measures = (
        len(distinct) / len(words) if words else 0.0,
        len(set(lines)) / len(lines),
        kinds[2] / max(1, letters),
        (kinds[9] + kinds[11:15].sum()) / len(c) * 3,
        len(c) / max(1, len(words)) / 16,
        np.log2(len(c)) / 20,
    )
    base = CLASSES**ORDER
    for m in measures:
        at = min(max(float(m), 0.0), 1.0) * (STEPS - 1)
        low = int(at)
        out[base + low] += MEASURE_WEIGHT * (1 - (at - low))
        if low + 1 < STEPS:
            out[base + low + 1] += MEASURE_WEIGHT * (at - low)
        base += STEPS
    return out


class Latent:
    """Latent vectors of texts: inverse document frequencies and the leading directions of a labelled sample, whose ``rows`` are overwritten."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if not len(labels):
            self.vectors = np.zeros((0, 1), np.float32)
            return
        self.idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
        self.idf[CLASSES**ORDER : FIRST_WORD] = 1
        rows *= self.idf  # in place: the sample's largest array is held once
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-30)[:, None]
        x = rows
        self.directions = self._leading(x, min(dimensions, len(rows)))
        self.vectors = self._unit(x @ self.directions)

    @staticmethod
    def _leading(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a fixed start."""
        basis = np.random.default_rng(1).standard_normal((x.shape[1], k + 16)).astype(np.float32)
        for _ in range(rounds):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        return np.ascontiguousarray(basis @ turn[:k].T)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(size > 0, size, 1)

    def scores(self, rows: list[np.ndarray | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        some = [i for i, r in enumerate(rows) if r is not None] if len(self.vectors) else []
        for a in range(0, len(some), BLOCK):
            at = some[a : a + BLOCK]
            mine = self._unit(self._unit(np.stack([rows[i] for i in at]) * self.idf) @ self.directions)
            cosines = mine @ self.vectors.T
            k = min(neighbours, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6) ** POWER
            out[at] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Latent:
    """The latent space and the voters, from the ``sample`` labelled rows whose ids hash lowest and where ``learnable`` (of the label rows) holds."""
    known = labels.where(learnable).select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = {r["doc_id"]: r["label"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [term_counts(t or "") for t in part.column(1).to_pylist()]
                at = [None if f is None else np.flatnonzero(f).astype(np.int32) for f in found]
                values = [None if f is None else f[i] for f, i in zip(found, at)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "at", "value"])

    rows = ids_and_texts(docs, id_col, text_col).where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, at array<int>, value array<float>").where("at is not null").toPandas().sort_values("doc_id")
    dense = np.zeros((len(found), TERMS), dtype=np.float32)
    for k, (at, value) in enumerate(zip(found["at"], found["value"])):
        dense[k, np.asarray(at, dtype=np.int64)] = value
    return Latent(dense, np.array([chosen[i] for i in found["doc_id"]], dtype=np.float32))


def predict(docs: DataFrame, model: Latent, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS + SAMPLE vectors of DIMENSIONS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                score = np.concatenate([shared.value.scores([term_counts(t or "") for t in texts[a : a + BLOCK]]) for a in range(0, len(texts), BLOCK)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labels of all folds of the ids but one, predicted for every row."""
    model = learn(docs, labels, fold_of(F.col("doc_id"), folds) != held_out, id_col, text_col)
    return predict(docs, model, threshold, id_col, text_col).select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Latent, score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge() -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.concatenate([shared.value.scores([term_counts(t) for t in texts[a : a + BLOCK]]) for a in range(0, len(texts), BLOCK)]) >= score

    return where_text(docs, text_col, judge)
