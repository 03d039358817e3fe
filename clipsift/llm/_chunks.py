"""Texts as words that a tokenizer can treat one by one, each distinct word only once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Words held by a task; beyond it the store starts anew, which changes no result.
HELD_WORDS = 300_000
#: Begins the key of a text's first word; other words begin with something that is not white space.
FIRST = " "


class WordStore:
    """Ids (or whatever ``encode`` gives) of every distinct word seen.

    A text is cut where exactly one space stands between characters that are not white space; no token of the tokenizers
    used here spans such a place. ``encode`` gets texts of words, with the space that stands before them; before a text's
    first word stands ``prefix``.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], prefix: str = "", held: int = HELD_WORDS):
        self._encode, self._prefix, self._held = encode, prefix, held
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._flat, self._len, self._start, self._odd = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, texts: list[list[str]]) -> None:
        fresh = list(set().union(*texts) - self._at.keys())
        if not fresh:
            return
        self._store([self._prefix + w[1:] if w[:1] == FIRST else f" {w}" for w in fresh])
        odd = [not w or w[-1].isspace() or (w[0].isspace() and w[0] != FIRST) or (w[0] == FIRST and w[1:2].isspace()) for w in fresh]
        self._at.update(zip(fresh, range(len(self._at), len(self._at) + len(fresh))))
        self._odd = np.concatenate([self._odd, np.array(odd, dtype=bool)])

    def _store(self, words: list[str]) -> None:
        """Keep what the words encode to: ``_len`` ids from ``_start`` on in ``_flat`` for each."""
        got = self._encode(words)
        lens = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        self._flat = np.concatenate([self._flat, np.fromiter((i for g in got for i in g), dtype=np.uint32, count=int(lens.sum()))])
        self._len = np.concatenate([self._len, lens])
        self._start = np.cumsum(self._len) - self._len

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's words in the store."""
        if len(self._at) > self._held:
            self._clear()
        words = [t.split(" ") if t else [] for t in texts]
        for ws in words:
            if ws:
                ws[0] = FIRST + ws[0]
        self._learn(words)
        out = [np.fromiter(map(self._at.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in words]
        again = [i for i, at in enumerate(out) if self._odd[at].any()]
        if again:  # white space beside a space
            cut = [_SAFE.split(texts[i]) for i in again]
            for ws in cut:
                ws[0] = FIRST + ws[0]
            self._learn(cut)
            for i, ws in zip(again, cut):
                out[i] = np.fromiter(map(self._at.__getitem__, ws), dtype=np.int64, count=len(ws))
        return out

    def sequences(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for at in self.words(texts):
            lens = self._len[at]
            ends = np.cumsum(lens)
            out.append(self._flat[np.arange(int(lens.sum())) + np.repeat(self._start[at] - (ends - lens), lens)])
        return out

    def sums(self, texts: list[str]) -> list[int]:
        """The sum over each text's words, where ``encode`` gives one number a word."""
        return [int(self._flat[at].sum(dtype=np.int64)) for at in self.words(texts)]
