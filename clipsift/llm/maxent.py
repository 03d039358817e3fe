"""Language-model scores of documents from a hashed maximum-entropy model with class-factored softmax.

p(word | history) = p(class | history) * p(word | class, history). The class factor has a hashed feature row for the last word, for
the one before it (skip), and for the pair; the word factor has a feature for each word with the class of the last word. The most
frequent words (at most ``VOCABULARY``) are outcomes of their own, clustered into classes by their spelling; the end of a
text is one too, and all other words share the outcome *rare*, within which a word has the probability of its smoothed count, one
unseen word included, so that the probabilities of all texts sum to 1.

Training is by rounds over disjoint parts of the training texts: every task starts from the shared weights, takes AdaGrad steps
over its texts, and the weights are averaged by the tokens behind them. Tasks are of about the same size whatever the input. Counts are exact and cover all training texts. Words beyond
the vocabulary meet their counts in a join by word; only the bounded vocabulary and weights are broadcast.

Defined results: a null text is empty and has the end token alone; without training texts the counts are zero and the model is
that of one unseen word. Repeated rows count and are scored each on their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.llm._common import cut, fold_of, ids_and_texts, slices

VOCABULARY, CLASSES, ROWS = 32_768, 32, 1 << 14
#: Rounds of training, tokens of a step on the class factor and on the word factor, step sizes.
ROUNDS, STEP, WORD_STEP, RATE, WORD_RATE = 2, 4096, 1 << 16, 0.3, 0.2
#: Words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Numbers in a row of weights on their way to be averaged.
BLOCK = 4096
#: Hashed n-grams of spelling (the leading eight bits of a product).
SPELLING = 256
#: Bytes of text that a task trains on, about: tasks grow in number and not in size, and each hands on one set of weights.
TASK_BYTES = 32_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, separated by ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def spelling_classes(words: list[bytes], counts: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Cluster words by their character n-grams: k-means on unit vectors, from evenly spread starts by frequency."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    marked = np.frombuffer(b"".join(b"^%b$" % w for w in words), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2)
    x = np.zeros(len(words) * SPELLING, dtype=np.float32)
    code = marked
    for n in (2, 3):
        code = code[:-1] * 257 + marked[n - 1 :]
        inside = owner[: len(code)] == owner[n - 1 :]
        hashed = ((code * 0x9E3779B1 + n) & 0xFFFFFFFF) >> 24
        x += np.bincount(owner[: len(code)][inside] * SPELLING + hashed[inside], minlength=len(x)).astype(np.float32)
    x = x.reshape(len(words), SPELLING)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    centres = x[np.linspace(0, len(words) - 1, k).astype(int)]
    weight = np.sqrt(counts).astype(np.float32)[:, None]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x * weight)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return (x @ centres.T).argmax(axis=1)


@dataclass
class Model:
    """Weights and what they refer to; ``end`` and ``rare`` follow the vocabulary's words, the start of a text after them."""

    number: dict[bytes, int]
    classes: np.ndarray
    bias: np.ndarray
    rows: np.ndarray
    words: np.ndarray

    @property
    def end(self) -> int:
        return len(self.number)

    @property
    def rare(self) -> int:
        return len(self.number) + 1

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Outcomes of all texts in a row, each text ended, and the place where each begins."""
        get, rare = self.number.get, self.rare
        flat: list[int] = []
        starts = []
        for ws in texts:
            starts.append(len(flat))
            flat += [get(w, rare) for w in ws]
            flat.append(self.end)
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)

    def history(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each outcome the class of the word before it and its three feature rows."""
        first, begin = len(self.number) + 2, np.zeros(len(ids), dtype=bool)
        begin[starts] = True
        one = np.where(begin, first, np.roll(ids, 1)).astype(np.uint64)
        two = np.where(begin | np.roll(begin, 1), first, np.roll(ids, 2)).astype(np.uint64)
        if len(ids):
            one[0] = two[0] = first
        mix = lambda v, salt: (((v + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(ROWS)))).astype(np.uint16)
        features = np.stack([mix(one, 1), mix(two, 1 << 20), mix(one * np.uint64(first + 1) + two, 1 << 40)])
        return np.append(self.classes, self.classes[self.end])[one.astype(np.int64)], features

    def class_logs(self, features: np.ndarray) -> np.ndarray:
        """log p(class | history), a row for each outcome."""
        z = self.rows[features[0]]
        z += self.rows[features[1]]
        z += self.rows[features[2]]
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def word_logs(self) -> np.ndarray:
        """log p(word | its class, class of the word before), by that class and word."""
        order = np.argsort(self.classes, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(self.classes[order]) != 0))
        top = self.words.max()
        total = np.log(np.add.reduceat(np.exp(self.words[:, order] - top), starts, axis=1)) + top
        out = np.empty_like(self.words)
        out[:, order] = self.words[:, order] - np.repeat(total, np.diff(np.append(starts, len(order))), axis=1)
        return out


class Trainer:
    """AdaGrad steps from a model's weights."""

    def __init__(self, model: Model):
        self.model = Model(model.number, model.classes, model.bias.copy(), model.rows.copy(), model.words.copy())
        self._rows, self._bias, self._words = np.full_like(model.rows, 1.0), np.full_like(model.bias, 1.0), np.full_like(model.words, 1.0)
        self.tokens = 0
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def texts(self, texts: list[list[bytes]]) -> None:
        m = self.model
        ids, starts = m.ids(texts)
        before, features = m.history(ids, starts)
        target = m.classes[ids]
        for a in range(0, len(ids), STEP):
            f, t = features[:, a : a + STEP], target[a : a + STEP]
            g = np.exp(m.class_logs(f))
            g[np.arange(len(t)), t] -= 1
            total = g.sum(axis=0)
            self._bias += total * total
            m.bias -= RATE * total / np.sqrt(self._bias)
            for k in range(3):
                order = np.argsort(f[k], kind="stable")
                rows = f[k][order]
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                hit, sums = rows[first], np.add.reduceat(g[order], first, axis=0)
                past = self._rows[hit] + sums * sums
                self._rows[hit] = past
                m.rows[hit] -= RATE * sums / np.sqrt(past)
        self.tokens += len(ids)
        self._held.append((before, ids))
        self._n += len(ids)
        if self._n >= WORD_STEP:
            self.word_step()

    def word_step(self) -> None:
        if not self._n:
            return
        m = self.model
        before, ids = (np.concatenate(x) for x in zip(*self._held))
        self._held, self._n = [], 0
        n_words = m.words.shape[1]
        seen = np.bincount(before * n_words + ids, minlength=CLASSES * n_words).reshape(CLASSES, n_words)
        pairs = np.bincount(before * CLASSES + m.classes[ids], minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        gap = (seen - np.exp(m.word_logs()) * pairs[:, m.classes]).astype(np.float32)
        self._words += gap * gap
        m.words += WORD_RATE * gap / np.sqrt(self._words)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; tasks count first and hand on their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in slices(batch):
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    held.update(tokens(text))
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words, ties by word.

    Only numbers of words by count (by sixty-fourths of a doubling beyond 1024) and the words themselves reach the driver, however
    many tasks hold the counts.
    """
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 1024).cast("long")
    sizes = sorted(((r["step"], r["w"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("w")).collect()), reverse=True)
    found, held = [], 0
    for at, words in sizes:
        if held + words > most:
            found = counts.where(step > at).collect() + counts.where(step == at).orderBy(F.desc("n"), "word").limit(most - held).collect()
            break
        held += words
    else:
        found = counts.collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def start_model(words: list[bytes], counts: np.ndarray, ends: int, rare: int) -> Model:
    """No features yet: class bias and words by their counts."""
    k = CLASSES - 2
    classes = np.append(spelling_classes(words, counts, min(k, max(1, len(words)))), [k, k + 1]).astype(np.int64)
    weight = np.append(counts, [ends, rare]) + 0.5
    bias = np.log(np.bincount(classes, weights=weight, minlength=CLASSES) + 1e-3).astype(np.float32)
    own = np.tile(np.log(weight).astype(np.float32), (CLASSES, 1))
    return Model({w: i for i, w in enumerate(words)}, classes, bias - bias.max(), np.zeros((ROWS, CLASSES), np.float32), own)


def train_round(docs: DataFrame, model: Model, tasks: int) -> Model:
    """One round over ``docs``: the weights of each of at most ``tasks`` tasks, averaged by its tokens. Weights travel in rows of ``BLOCK`` numbers."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    sizes = [model.bias.size, model.rows.size, model.words.size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value)
        for batch in batches:
            for part in slices(batch, limit=1_000_000):
                trainer.texts([tokens(t) for t in part.column(0).to_pylist()])
        trainer.word_step()
        if not trainer.tokens:
            return
        m = trainer.model
        flat = np.concatenate([m.bias.ravel(), m.rows.ravel(), m.words.ravel()]).astype(np.float32)
        blocks = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([trainer.tokens] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "tokens", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, n = None, None, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["block", "weights"])
        for batch in batches:
            for block, k, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    if at is not None:
                        yield out()
                    at, total, n = block, 0.0, 0
                total = total + np.frombuffer(raw, dtype=np.float32).astype(np.float64) * k
                n += k
        if at is not None:
            yield out()

    learned = docs.select("text").coalesce(tasks).mapInArrow(run, "block int, tokens long, weights binary")
    merged = learned.repartition("block").sortWithinPartitions("block", "tokens", "weights").mapInArrow(average, "block int, weights binary")
    got = sorted((r["block"], r["weights"]) for r in merged.collect())  # the weights of one model, whatever the corpus
    shared.unpersist()
    if not got:
        return model
    flat = np.frombuffer(b"".join(bytes(w) for _, w in got), dtype=np.float32)
    bias, rows, words = np.split(flat, np.cumsum(sizes)[:-1])
    return Model(model.number, model.classes, bias.copy(), rows.reshape(model.rows.shape).copy(), words.reshape(model.words.shape).copy())


def score_documents(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row; learned from those where ``learnable`` holds."""
    sc = docs.sparkSession.sparkContext
    train = ids_and_texts(docs.where(learnable), id_col, text_col)
    counts = cut(count_words(train), "words")
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends, size = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    top = frequent(counts, vocabulary)
    kept = sum(n for _, n in top)
    model = start_model([w for w, _ in top], np.array([n for _, n in top], dtype=np.float64), ends, n_words - kept)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for k in range(rounds):
        model = train_round(train.where(part == k), model, 1 + size // TASK_BYTES)
    total, types = n_words + ends, distinct + (ends > 0)
    log_base = math.log10(total + 0.5 * (types + 1))
    log_rare = math.log10(n_words - kept + 0.5 * (distinct - len(top) + 1))
    known = np.append([n for _, n in top], [ends]).astype(np.float64)
    shared = sc.broadcast((model, np.log10(known + 0.5)))  # a fixed number of words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_known = shared.value
        within = m.word_logs()
        row = TaskContext.get().partitionId() << 33
        number = m.number
        for batch in batches:
            for piece in slices(batch, limit=1_000_000):
                texts = [tokens(t) for t in piece.column(1).to_pylist()]
                ids, starts = m.ids(texts)
                before, features = m.history(ids, starts)
                logs = np.empty(len(ids))
                for a in range(0, len(ids), STEP):
                    own = m.class_logs(features[:, a : a + STEP])
                    logs[a : a + STEP] = own[np.arange(len(own)), m.classes[ids[a : a + STEP]]]
                logs += within[before, ids]
                common = ids != m.rare
                base = np.where(common, log_known[np.minimum(ids, m.end)], 0.0)
                per = lambda v: np.add.reduceat(v, starts)
                n = np.diff(np.append(starts, len(ids)))
                uid = row + np.arange(len(texts))
                row += len(texts)
                seen = per((common & ((ids != m.end) | (ends > 0))).astype(np.int64))
                nulls = lambda kind: pa.nulls(len(texts), kind)
                yield pa.RecordBatch.from_arrays([pa.array(uid), nulls(pa.binary()), nulls(pa.int64()), piece.column(0), pa.array(n), pa.array(seen), pa.array(per(base)), pa.array(per(logs) / math.log(10))], names=NAMES)
                words: list[bytes] = []
                times: list[int] = []
                owners = np.zeros(len(texts), dtype=np.int64)
                for i, ws in enumerate(texts):
                    rare = Counter([w for w in ws if w not in number])
                    words += rare
                    times += rare.values()
                    owners[i] = len(rare)
                blank = lambda kind: pa.nulls(len(words), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid, owners)), pa.array(words, pa.binary()), pa.array(times, pa.int64()), blank(pa.int64()), blank(pa.int64()), blank(pa.int64()), blank(pa.float64()), blank(pa.float64())], names=NAMES)

    NAMES = ["uid", "word", "times", "doc_id", "n_tokens", "n_known", "base", "score"]
    found = cut(ids_and_texts(docs, id_col, text_col).mapInArrow(run, "uid long, word binary, times long, doc_id long, n_tokens long, n_known long, base double, score double"), "scored")
    rare = found.where(F.col("word").isNotNull()).select("uid", "word", "times").join(counts.select("word", "n"), "word", "left")
    log_count = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * log_count).alias("rare_log"), F.sum("times").alias("rare_n"))
    main = found.where(F.col("word").isNull()).drop("word", "times").join(rare, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return main.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_log") - F.col("n_tokens") * F.lit(log_base)).alias("base_score"),
        (F.col("score") + zero("rare_log") - zero("rare_n") * F.lit(log_rare)).alias("score"),
    )


def score_folds(docs: DataFrame, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores, learned from all folds of the ids but one, with ``held_out`` for the rows of that fold."""
    scored = score_documents(docs, fold_of(F.col(f"`{id_col}`"), folds) != held_out, id_col, text_col)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
