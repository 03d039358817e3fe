"""Language identification with a string kernel.

Texts are compared by the blended-spectrum presence kernel: the number of n-grams (1 to ``ORDER`` characters) that both contain,
over the root of the product of the numbers that each contains. Landmarks, a bounded number of texts of each language, give the
Nyström approximation of that kernel; ridge regression on it separates each language from the rest. As the kernel is linear in
the presence vector, landmarks and coefficients fold into one weight for each n-gram and language, and a batch of texts is scored
by a product of its sparse presence matrix with these weights.

Characters are lower-cased. Every letter, and every mark that goes with letters (vowel signs, accents), stands for itself whatever
its script; all others are one character, and a run of them counts once. An n-gram is hashed to one of ``CODES`` numbers: two that
share a number count as one, which the few thousand of a text seldom do.

Defined results: ``und`` with score 0 for a null text and for one without a letter, and for all texts if nothing was learned.
Ties go to the language that sorts first. Repeated rows get equal results. Null ids and languages teach nothing.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.llm._common import fold_of, ids_and_texts, slices, where_text

ORDER = 3
#: Numbers that n-grams of one, two and three characters are hashed to.
BITS = 18
CODES = 1 << BITS
#: Labelled texts of a language that are learned from, and how many of them are landmarks: the bounds of the sample.
PER_LANGUAGE, LANDMARKS = 400, 64
#: Languages that are learned, the most frequent first: the bound of the model where labels are dirty.
LANGUAGES = 64
RIDGE = 1e-2
UNKNOWN = "und"


#: Odd multipliers that mix a character's code point, the characters of an n-gram, and an n-gram's length.
_MIX, _STEP, _SPREAD = 0x9E3779B1, 0x85EBCA6B, (0xC2B2AE35, 0x27D4EB2F, 0x165667B1)


@functools.cache
def _character_codes() -> np.ndarray:
    """A 32-bit number for each letter (odd) and mark (even, not 0), 0 for all other characters."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            mixed = (c * _MIX ^ (c * _MIX & 0xFFFFFFFF) >> 15) & 0xFFFFFFFE
            out[c] = mixed | 1 if kind == "L" else mixed or 2
    return out


class Grams:
    """The distinct n-grams of a text, as ascending numbers; none for a text without a letter."""

    def __init__(self) -> None:
        self._codes = _character_codes()
        self._seen = np.zeros(CODES, dtype=bool)

    def __call__(self, text: str) -> np.ndarray:
        c = self._codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
        if not (c & 1).any():
            return np.zeros(0, dtype=np.int64)
        c = c[(c != 0) | np.append(True, c[:-1] != 0)]
        seen, code = self._seen, c
        for n in range(1, ORDER + 1):
            if n > 1:
                code = (code[:-1] ^ code[:-1] >> np.uint32(13)) * np.uint32(_STEP) + c[n - 1 :]
            mixed = (code + np.uint32(n)) * np.uint32(_SPREAD[n - 1])
            seen[(mixed ^ mixed >> np.uint32(16)) * np.uint32(_MIX) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights[n-gram, language] and intercepts, from (language, n-grams) of the sample."""
    names = sorted({lang for lang, _ in samples})
    if not names:
        return [], np.zeros((CODES, 0), np.float32), np.zeros(0, np.float32)
    chosen: list[int] = []
    for name in names:
        chosen += [i for i, (lang, _) in enumerate(samples) if lang == name][:landmarks]
    vocabulary = np.unique(np.concatenate([samples[i][1] for i in chosen]))
    place = np.full(CODES, -1)
    place[vocabulary] = np.arange(len(vocabulary))

    def presence(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for k, i in enumerate(rows):
            at = place[samples[i][1]]
            out[k, at[at >= 0]] = 1 / np.sqrt(len(samples[i][1]))
        return out

    marks = presence(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > values.max() * 1e-6
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.concatenate([presence(list(range(a, min(a + 256, len(samples))))) @ marks.T for a in range(0, len(samples), 256)]) @ whiten
    target = np.array([[float(lang == name) for name in names] for lang, _ in samples])
    mean, prior = mapped.mean(axis=0), target.mean(axis=0)
    centred = mapped - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(samples) * np.eye(centred.shape[1]) / centred.shape[1], centred.T @ (target - prior))
    weights = np.zeros((CODES, len(names)), dtype=np.float32)
    weights[vocabulary] = marks.T @ (whiten @ solved)
    return names, weights, (prior - mean @ solved).astype(np.float32)


def score(grams: list[np.ndarray], weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language's number and its share of the non-negative outputs, of each text; -1 and 0 where there is no n-gram."""
    sizes = np.array([len(g) for g in grams])
    best, share = np.full(len(grams), -1), np.zeros(len(grams))
    some = np.flatnonzero(sizes)
    if not len(some) or not weights.shape[1]:
        return best, share
    starts = np.cumsum(sizes[some]) - sizes[some]
    out = np.add.reduceat(weights[np.concatenate([grams[i] for i in some])], starts, axis=0) / np.sqrt(sizes[some])[:, None] + intercepts
    positive = np.maximum(out, 0)
    total = positive.sum(axis=1)
    best[some] = out.argmax(axis=1)
    share[some] = np.where(total > 0, positive.max(axis=1) / np.where(total > 0, total, 1), 1 / weights.shape[1])
    return best, np.clip(share, 0, 1)


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A model of the rows where ``learnable`` holds; of each language the ``per_language`` whose ids hash lowest.

    Of a repeated id the row with the smallest language and text counts.
    """
    rows = ids_and_texts(docs, id_col, text_col, F.col(f"`{lang_col}`").cast("string").alias("lang"), learnable.alias("learnable"))
    rows = rows.where("learnable and lang is not null and text is not null").drop("learnable")
    keyed = rows.select("doc_id", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)).alias("h"))
    sizes = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return fit([])
    # four times as many as are needed lie below a language's share: only these are ranked, so a language of any size ranks a fixed number
    share = rows.sparkSession.createDataFrame([(r["lang"], 4.0 * per_language / r["ids"]) for r in sizes], "lang string, share double")
    low = keyed.join(F.broadcast(share), "lang").where("h <= share").groupBy("doc_id", "h").agg(F.min("lang").alias("lang"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = low.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("doc_id", "lang").collect()  # per_language of LANGUAGES
    ids = F.broadcast(rows.sparkSession.createDataFrame(chosen, "doc_id long, lang string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for part in slices(batch):
                found = [grams(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "lang", "grams"])

    texts = rows.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")
    sampled = texts.mapInArrow(run, "doc_id long, lang string, grams array<long>").toPandas().sort_values(["lang", "doc_id"])
    return fit([(lang, np.asarray(g)) for lang, g in zip(sampled["lang"], sampled["grams"]) if len(g)])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its whole text alone."""
    names = [*model[0], UNKNOWN]
    used = np.flatnonzero(model[1].any(axis=1)) if len(model[0]) else np.zeros(0, dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((used, model[1][used], model[2]))  # at most CODES rows of as many numbers as languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        at, own, intercepts = shared.value
        weights = np.zeros((CODES, own.shape[1]), dtype=np.float32)
        weights[at] = own
        for batch in batches:
            for part in slices(batch):
                best, share = score([grams(t or "") for t in part.column(1).to_pylist()], weights, intercepts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[b] for b in best]), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from all folds of the ids but one, predicted for every row."""
    fold = fold_of(F.col(f"`{id_col}`"), folds)
    model = learn(docs, fold != held_out, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is predicted to be in a learned language with at least ``share``."""
    names, own, intercepts = model
    used = np.flatnonzero(own.any(axis=1)) if len(names) else np.zeros(0, dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((used, own[used], intercepts))

    def judge() -> Callable[[list[str]], np.ndarray]:
        grams = Grams()
        at, rows, cut_off = shared.value
        weights = np.zeros((CODES, rows.shape[1]), dtype=np.float32)
        weights[at] = rows

        def decide(texts: list[str]) -> np.ndarray:
            best, found = score([grams(t) for t in texts], weights, cut_off)
            return (best >= 0) & (found >= share)

        return decide

    return where_text(docs, text_col, judge)
