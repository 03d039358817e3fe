"""N-best segmentations of texts into a SentencePiece model's pieces, and decoding.

The lattice of a text has an edge for each piece that matches (its score is the model's), and for a character without a piece one
of its bytes. A forward Viterbi pass scores the best way to every position; a backward A-star search takes that score as its
heuristic. As the heuristic is exact, an entry of the agenda is worth exactly its best completion, so complete paths leave best
first and an agenda never needs more than n entries. No piece spans words (a space and what follows it up to the next), so the
search runs once for each distinct word, over many words at once in arrays; words' alternatives then combine into the text's.

Entries of equal worth leave in the order they came; edges into a place are met longest first. Defined results: a null text is
empty and has one segmentation, of no pieces and score 0; a text with fewer segmentations than asked for returns all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clipsift.llm._chunks import WordStore
from clipsift.llm._common import ids_and_texts, slices

SPACE = "▁"
#: Added to the lowest score for a character without a piece, as the library does.
UNKNOWN_PENALTY = 10.0
#: Characters of the words that are searched at once.
CHARACTERS = 400_000


class Pieces:
    """A model's pieces as a trie in sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = {m.id_to_piece(i): (m.get_score(i), i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans words")
        self.longest = max(map(len, pieces))
        self.unknown = min(s for s, _ in pieces.values()) - UNKNOWN_PENALTY
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        chars = sorted({c for p in pieces for c in p})
        self.width = len(chars) + 1
        self.by_char = np.full(0x110000, len(chars), dtype=np.int64)
        self.by_char[[ord(c) for c in chars]] = np.arange(len(chars))
        nodes: dict[str, int] = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        steps = sorted((nodes[p[:-1]] * self.width + int(self.by_char[ord(p[-1])]), n) for p, n in nodes.items() if p)
        self.keys = np.array([k for k, _ in steps])
        self.children = np.array([n for _, n in steps])
        self.score = np.full(len(nodes), -np.inf)
        self.id = np.full(len(nodes), -1)
        for p, (s, i) in pieces.items():
            self.score[nodes[p]], self.id[nodes[p]] = s, i
        #: What an id stands for; the space mark is a space.
        self.bytes = {i: p.replace(SPACE, " ").encode() for p, (_, i) in pieces.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node * self.width + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation: the pieces' characters without the space that stands before the first."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def best_paths(pieces: Pieces, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores[word, rank] (-inf where there are fewer), lengths[word, rank], and the ids of all of these one after another."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(lens) - lens
    own = pieces.by_char[chars]
    word_of = np.repeat(np.arange(len(words)), lens)
    left = (begin + lens)[word_of] - np.arange(len(chars))  # characters from here to the end of the word
    # edges: every piece that matches at a place
    at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
    starts, ends, scores, ids = [], [], [], []
    single = np.zeros(len(chars), dtype=bool)
    for k in range(1, pieces.longest + 1):
        live = left[at] >= k
        at, node = at[live], node[live]
        node = pieces.child(node, own[at + k - 1])
        live = node >= 0
        at, node = at[live], node[live]
        if not len(at):
            break
        hit = pieces.id[node] >= 0
        if k == 1:
            single[at[hit]] = True
        starts.append(at[hit])
        ends.append(at[hit] + k)
        scores.append(pieces.score[node[hit]])
        ids.append(pieces.id[node[hit]])
    bare = np.flatnonzero(~single)
    starts.append(bare)
    ends.append(bare + 1)
    scores.append(np.full(len(bare), pieces.unknown))
    ids.append(-1 - chars[bare].astype(np.int64))  # the character itself, spelled in bytes at the end
    start, end, score, name = (np.concatenate(x) for x in (starts, ends, scores, ids))
    shift = word_of[start]  # a word has one more place than characters
    start, end = start + shift, end + shift
    order = np.lexsort((start, end))
    start, end, score, name = start[order], end[order], score[order], name[order]
    places = len(chars) + len(words)
    first = np.searchsorted(end, np.arange(places + 1))
    origin = begin + np.arange(len(words))
    # forward: the best score to every place, by distance from the word's beginning
    best = np.full(places, -np.inf)
    best[origin] = 0
    depth = end - origin[word_of[np.minimum(end - 1 - shift[order], len(chars) - 1)]] if len(end) else end
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, (int(lens.max()) if len(lens) else 0) + 2))
    for a, b in zip(cuts, cuts[1:]):
        own_edges = by_depth[a:b]
        if len(own_edges):
            value = best[start[own_edges]] + score[own_edges]
            to = end[own_edges]
            head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            best[to[head]] = np.maximum.reduceat(value, head)
    # backward: agendas of n entries, all words in step
    last = origin + lens
    worth = np.full((len(words), n), -np.inf)
    worth[:, 0] = best[last]
    place, done, record = np.full((len(words), n), -1), np.zeros((len(words), n)), np.full((len(words), n), -1)
    place[:, 0] = last
    edge_of, parent_of, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    rows = np.arange(len(words))
    while len(rows):
        waiting = (place[rows] >= 0) & (place[rows] != origin[rows, None])
        rows, waiting = rows[waiting.any(axis=1)], waiting[waiting.any(axis=1)]
        if not len(rows):
            break
        slot = waiting.argmax(axis=1)
        p, d, r = place[rows, slot], done[rows, slot], record[rows, slot]
        worth[rows, slot], place[rows, slot] = -np.inf, -1
        count = first[p + 1] - first[p]
        grid = np.arange(int(count.max()))
        real = grid < count[:, None]
        edge = np.where(real, first[p][:, None] + grid, 0)
        total = d[:, None] + score[edge]
        value = np.where(real, best[start[edge]] + total, -np.inf)
        number = held + np.arange(edge.size).reshape(edge.shape)
        edge_of.append(edge.ravel())
        parent_of.append(np.repeat(r, edge.shape[1]))
        held += edge.size
        all_worth = np.concatenate([worth[rows], value], axis=1)
        pick = np.argsort(-all_worth, axis=1, kind="stable")[:, :n]
        take = lambda a, b: np.take_along_axis(np.concatenate([a[rows], b], axis=1), pick, axis=1)
        new = take(place, np.where(real, start[edge], -1)), take(done, total), take(record, number)
        worth[rows] = np.take_along_axis(all_worth, pick, axis=1)
        place[rows], done[rows], record[rows] = new
    edges, parents = np.concatenate(edge_of), np.concatenate(parent_of)
    found = place >= 0
    current = record[found]
    paths, names, alive = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.flatnonzero(current >= 0)
    while len(alive):  # a record's parents are the pieces to its right
        paths.append(alive)
        names.append(name[edges[current[alive]]])
        current[alive] = parents[current[alive]]
        alive = alive[current[alive] >= 0]
    path, flat = np.concatenate(paths), np.concatenate(names)
    order = np.argsort(path, kind="stable")
    path, flat = path[order], flat[order]
    if (bare := flat < 0).any():
        points = -1 - flat[bare]
        times = np.ones(len(flat), dtype=np.int64)
        times[bare] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        path, flat = np.repeat(path, times), np.repeat(flat, times)
        flat[np.repeat(bare, times)] = pieces.byte_ids[np.frombuffer("".join(map(chr, points.tolist())).encode(), dtype=np.uint8)]
    lengths = np.zeros(found.shape, dtype=np.int64)
    lengths[found] = np.bincount(path, minlength=int(found.sum()))
    return np.where(found, done, -np.inf), lengths, flat


class _Store(WordStore):
    """The best segmentations of each word: ``starts`` and ``lengths`` of each rank in the ids held."""

    def __init__(self, pieces: Pieces, n: int):
        self._pieces, self._n = pieces, n
        super().__init__(lambda words: [], prefix=" ")

    def _clear(self) -> None:
        super()._clear()
        self.scores, self.lengths, self.starts = np.zeros((0, self._n)), np.zeros((0, self._n), np.int64), np.zeros((0, self._n), np.int64)

    def _store(self, words: list[str]) -> None:
        marked = [w.replace(" ", SPACE) for w in words]
        sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        order = np.argsort(sizes, kind="stable")  # words of like length search in step
        scores, lengths, starts = np.empty((len(words), self._n)), np.empty((len(words), self._n), np.int64), np.empty((len(words), self._n), np.int64)
        total, flats, held = np.cumsum(sizes[order]), [self._flat], len(self._flat)
        a = 0
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHARACTERS, side="right")))
            some = order[a:b]
            own_scores, own, flat = best_paths(self._pieces, [marked[i] for i in some.tolist()], self._n)
            scores[some], lengths[some] = own_scores, own
            starts[some] = held + (np.cumsum(own.ravel()) - own.ravel()).reshape(own.shape)
            flats.append(flat.astype(np.uint32))
            held += len(flat)
            a = b
        self._flat = np.concatenate(flats)
        self.scores, self.lengths, self.starts = (np.concatenate(x) for x in ((self.scores, scores), (self.lengths, lengths), (self.starts, starts)))
        self._len, self._start = self.lengths[:, 0], self.starts[:, 0]

    def other(self, word: int, rank: int) -> np.ndarray:
        start = self.starts[word, rank]
        return self._flat[start : start + self.lengths[word, rank]]

    def first(self, at: np.ndarray) -> np.ndarray:
        lens = self._len[at]
        ends = np.cumsum(lens)
        return self._flat[np.arange(int(lens.sum())) + np.repeat(self._start[at] - (ends - lens), lens)]

    def offset(self, at: np.ndarray, k: int) -> tuple[int, int]:
        """Where the k-th word's ids stand in ``first``."""
        before = int(self._len[at[:k]].sum())
        return before, before + int(self._len[at[k]])


class Segmenter:
    """The ``n`` best segmentations of texts."""

    def __init__(self, model: str, n: int):
        self.pieces, self.n = Pieces(model), n
        self._store = _Store(self.pieces, n)

    def segment(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """Of each text (score, ids), best first."""
        found = self._store.words([t.replace(SPACE, " ") for t in texts])
        return [self._combine(at) for at in found]

    def _combine(self, at: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The n best leave the best choice in all but at most n - 1 words, those that lose least by it."""
        if not len(at):
            return [(0.0, np.zeros(0, dtype=np.uint32))]
        s = self._store
        scores = s.scores[at]
        best, total = s.first(at), float(scores[:, 0].sum())
        if self.n == 1:
            return [(total, best)]
        loss = scores[:, 0] - scores[:, 1]
        free = np.sort(np.argsort(loss, kind="stable")[: self.n - 1])
        picks: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for i in free.tolist():
            own = scores[i]
            longer = [(lost + own[0] - own[j], (*pick, j)) for lost, pick in picks for j in range(self.n) if own[j] > -np.inf]
            picks = sorted(longer, key=lambda x: x[0])[: self.n]
        out = []
        for lost, pick in picks:
            ids = best
            for i, j in reversed(list(zip(free.tolist(), pick))):
                if j:
                    a, b = s.offset(at, i)
                    ids = np.concatenate([ids[:a], s.other(at[i], j), ids[b:]])
            out.append((float(total - lost), ids))
        return out


SCHEMA = "doc_id long, rank int, n_pieces long, score double, ids_crc32 long, decoded boolean"


def segmentations(docs: DataFrame, model: str, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, n_pieces, score, ids_crc32, decoded): the ``n`` best of each row, rank from 1.

    The checksum is that of the ids as little-endian unsigned 32-bit numbers; ``decoded`` says whether the pieces give the text back
    (the space mark itself reads as a space).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model, n)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for doc, text, found in zip(part.column(0).to_pylist(), texts, segmenter.segment(texts)):
                    plain = text.replace(SPACE, " ")
                    for rank, (score, ids) in enumerate(found, 1):
                        rows.append((doc, rank, len(ids), score, zlib.crc32(ids.astype("<u4").tobytes()), segmenter.pieces.decode(ids) == plain))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
