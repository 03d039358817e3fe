"""Token counts of a SentencePiece BPE model, by merging the symbols of many words at once.

A word (a space and what follows it up to the next) is a row of symbols in ragged numpy arrays. In each round every row applies
its pair of lowest rank: all its occurrences from the left where no longer piece of lower rank can arise beside the merged one,
else the first alone, so that the result is that of merging one pair at a time. Rows without a pair left are counted: one token a
symbol, or its UTF-8 bytes where the model has no such piece.

A row of more than ``LONG`` symbols (a text without spaces) is merged in rounds of its own that touch only the places which a round
changes: places wait in one list for each rank, and all occurrences of the lowest rank merge at once up to the first beside which a
pair of lower rank really arises. Where that happens too often the rest is merged pair by pair. Either way time grows about in
proportion to the row: a million characters take a few seconds.

Defined results: a null text is empty and has 0 tokens; control pieces' strings inside texts are ordinary text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clipsift.llm._chunks import WordStore
from clipsift.llm._common import ids_and_texts, slices

SPACE = "▁"
_NONE = np.int64(2**31)
#: Symbols of a row beyond which it is merged in rounds of its own.
LONG = 512
#: Rounds in which pairs of lower rank arise, after which a long row is merged pair by pair.
STOPS = 500
_ROW = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class MergeTable:
    """Ranks of the pairs that a model merges, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ａ  ½ b "
        if model.decode(model.encode(probe)) != probe or model.encode("a", out_type=str)[0][:1] != SPACE:
            raise ValueError("only models that change no character and begin a text with a space are counted here")
        n = model.get_piece_size()
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece spans words")
        known = {p: i for i, (p, _) in enumerate(pieces)}
        #: Symbols are pieces, then characters that only occur inside pieces, then one that stands for all others.
        number = dict(known)
        for p, _ in pieces:
            for c in p:
                number.setdefault(c, len(number))
        self.other = len(number)
        order = np.argsort([-s for _, s in pieces], kind="stable")
        rank = np.empty(len(pieces), dtype=np.int64)
        rank[order] = np.arange(len(pieces))
        self.size = len(number) + 1
        pairs = [(number[p[:k]] * self.size + number[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.merged = np.array([i for _, i in pairs], dtype=np.int64)
        self.ranks = rank[self.merged]
        #: The lowest rank of a pair that has the piece on one side: below the piece's own, and only one pair may merge at a time.
        beside = np.full(self.size, _NONE)
        np.minimum.at(beside, self.keys // self.size, self.ranks)
        np.minimum.at(beside, self.keys % self.size, self.ranks)
        self.alone = beside[: len(pieces)] < rank
        self.piece_of_rank = order
        self.n_pieces = len(pieces)
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self._by_key: dict[int, tuple[int, int]] | None = None
        self.by_char = np.full(0x110000, self.other, dtype=np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.by_char[ord(c)] = i

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word is a row of its own."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            total = self.counts(["" if len(w) > LONG else w for w in words])
            total[long] = [self.long_count(words[i]) for i in long]
            return total
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.by_char[chars].astype(np.int64)
        weight = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        row = np.repeat(np.arange(len(words)), lens)
        total = np.zeros(len(words), dtype=np.int64)

        def ranks(at: np.ndarray) -> np.ndarray:
            """Of the pairs that begin at the places ``at``."""
            out = np.full(len(at), _NONE)
            ok = at + 1 < len(sym)
            ok[ok] = row[at[ok]] == row[at[ok] + 1]
            out[ok] = self.rank(sym[at[ok]], sym[at[ok] + 1])
            return out

        rank = ranks(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            ended = low == _NONE
            if ended.any():
                np.add.at(total, row[ended], np.where(sym[ended] < self.n_pieces, 1, weight[ended]))
                sym, weight, row, rank, low = (x[~ended] for x in (sym, weight, row, rank, low))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            new_row = np.append(True, row[at[1:]] != row[at[:-1]])
            new_run = new_row | np.append(True, at[1:] != at[:-1] + 1)
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            every_other = (np.arange(len(at)) - run_start) % 2 == 0
            at = at[np.where(self.alone[self.piece_of_rank[low[at]]], new_row, every_other)]
            sym[at] = self.piece_of_rank[low[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, weight, row, rank = (x[keep] for x in (sym, weight, row, rank))
            at = place[at]
            stale = np.zeros(len(sym), dtype=bool)
            stale[at] = stale[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(stale)
            rank[changed] = ranks(changed)
        return total

    def long_count(self, word: str) -> int:
        """Tokens of one long row. Symbols keep the places of their first characters; a place merged into the one before it is dead."""
        chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
        n = len(chars)
        sym = self.by_char[chars].astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: no symbol
        rank = np.append(self.rank(sym[:-1], sym[1:]), _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Put places into the lists of their ranks."""
            at = at[rank[at] < _NONE]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            own = rank[at]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            for r, part in zip(own[first].tolist(), np.split(at, first[1:]) if len(own) else ()):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        wait(np.arange(n))
        alive, apart, stops = np.ones(n, dtype=bool), 3 * self.longest, 0
        while heap and stops < STOPS:
            low = heapq.heappop(heap)
            every = np.unique(np.concatenate(waiting.pop(low)))
            every = every[rank[every] == low]  # others have changed since
            if not len(every):
                continue
            new_run = np.append(True, after[every[:-1]] != every[1:])  # of pairs that overlap every other merges
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(every)), 0))
            at = every[(np.arange(len(every)) - run_start) % 2 == 0]
            merged = int(self.piece_of_rank[low])
            right, left = after[after[at]], before[at]
            again = every[:0]
            if self.alone[merged]:
                # what each meets when it merges: the one before it has merged by then, the one after it has not
                follows = np.append(False, right[:-1] == at[1:])
                lower = (left >= 0) & (self.rank(np.where(follows, merged, sym[left]), np.full(len(at), merged)) < low)
                inside = right < n
                lower[inside] |= self.rank(np.full(int(inside.sum()), merged), sym[right[inside]]) < low
                if lower.any():
                    # what arises there merges first and reaches no farther than pieces are long: later places of its chain wait
                    stops += 1
                    again = every
                    chain = np.cumsum(np.append(True, np.diff(at) > apart))
                    last = np.append(-1, np.maximum.accumulate(np.where(lower, np.arange(len(at)), -1))[:-1])
                    goes = (last < 0) | (chain[last] != chain)
                    at, right = at[goes], right[goes]
            sym[at] = merged
            gone = after[at]
            alive[gone], rank[gone] = False, _NONE
            after[at] = right
            inside = right < n
            before[right[inside]] = at[inside]
            changed = np.concatenate([at, before[at]])
            changed = np.unique(changed[changed >= 0])
            rank[changed] = _NONE
            ends = after[changed]
            inside = ends < n
            rank[changed[inside]] = self.rank(sym[changed[inside]], sym[ends[inside]])
            wait(np.union1d(changed, again))
        if heap:
            self._finish(sym, alive)
        kept = np.flatnonzero(alive)
        weight = 1 + (chars[kept] >= 0x80).astype(np.int64) + (chars[kept] >= 0x800) + (chars[kept] >= 0x10000)
        return int(np.where(sym[kept] < self.n_pieces, 1, weight).sum())

    def _finish(self, sym: np.ndarray, alive: np.ndarray) -> None:
        """Merge what is left one pair at a time: for rows in which lower pairs arise at every step."""
        if self._by_key is None:
            self._by_key = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        get, size, places = self._by_key.get, self.size, np.flatnonzero(alive)
        s, n = sym[places].tolist(), len(places)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(p[0], k) for k in range(n - 1) if (p := get(s[k] * size + s[k + 1]))]
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            b = after[k]
            if s[k] < 0 or b < 0 or not (p := get(s[k] * size + s[b])) or p[0] != low:
                continue
            s[k], s[b] = p[1], -1
            after[k] = after[b]
            if after[b] >= 0:
                before[after[b]] = k
                if q := get(s[k] * size + s[after[k]]):
                    heapq.heappush(heap, (q[0], k))
            if before[k] >= 0 and (q := get(s[before[k]] * size + s[k])):
                heapq.heappush(heap, (q[0], before[k]))
        left = np.array(s)
        sym[places] = left
        alive[places[left < 0]] = False


class Counter:
    """Token counts of texts; each distinct word is merged once."""

    def __init__(self, path: str):
        self._table = MergeTable(path)
        self._store = WordStore(self._counts, prefix=" ")

    def _counts(self, words: list[str]) -> list[list[int]]:
        rows: list[str] = []
        owner: list[int] = []
        for i, w in enumerate(words):
            found = _ROW.findall(w.replace(" ", SPACE))
            rows += found
            owner += [i] * len(found)
        out = np.zeros(len(words), dtype=np.int64)
        step = 1 << 16
        for a in range(0, len(rows), step):
            np.add.at(out, owner[a : a + step], self._table.counts(rows[a : a + step]))
        return out[:, None].tolist()

    def count(self, texts: list[str]) -> list[int]:
        return self._store.sums([t.replace(SPACE, " ") for t in texts])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in batches:
            for part in slices(batch):
                n = np.array(counter.count([t or "" for t in part.column(1).to_pylist()]), dtype=np.int64)
                size = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
