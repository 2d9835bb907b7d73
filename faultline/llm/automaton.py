"""Operator 2: substring dedup with suffix automata of reference shards.

The reference is the corpus itself. Documents and reference meet in shards (see
``passages``): each shard's suffix automaton holds the shard's pieces, its states know the first
document in which their strings occur, and the pieces stream through it for matching
statistics; the state of the last ``window`` words gives the first document of each window.
Maximal spans of windows that an earlier document has are removed. An automaton of
the whole reference has no size bound, so it isn't broadcast: pieces go to the
automaton of their shard, whose size is bounded instead.

Defined cases: null and empty texts have no words; texts shorter than a window stay whole; a null
id comes after all others; rows with one id are never earlier than each other; white space between kept
words becomes one space; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame

from .passages import LAST, Frame, remove_repeats

WINDOW_WORDS = 50
GRAM_WORDS = 10
HOT = 1_000             # documents that may share a ten-word run before its windows travel singly


class SuffixAutomaton:
    """Suffix automaton of several sequences; each state knows the smallest id of a sequence with its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [LAST]

    def _state(self, length: int, edges: dict, link: int, first: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _copy(self, p: int, q: int, symbol) -> int:
        """Split off the part of state ``q`` that is one symbol longer than ``p``."""
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], LAST)
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, symbols: Sequence, doc: int) -> None:
        last = 0
        edges, link, length, first = self.next, self.link, self.length, self.first
        for s in symbols:
            q = edges[last].get(s)
            if q is not None:                           # the string is known from an earlier sequence
                last = q if length[q] == length[last] + 1 else self._copy(last, q, s)
            else:
                new = self._state(length[last] + 1, {}, 0, LAST)
                p = last
                while p >= 0 and s not in edges[p]:
                    edges[p][s] = new
                    p = link[p]
                if p >= 0:
                    q = edges[p][s]
                    link[new] = q if length[q] == length[p] + 1 else self._copy(p, q, s)
                last = new
            if doc < first[last]:
                first[last] = doc

    def finish(self) -> None:
        """Pass the smallest ids on to the suffixes, longest strings first."""
        first, link = self.first, self.link
        for v in sorted(range(1, len(first)), key=self.length.__getitem__, reverse=True):
            if link[v] > 0 and first[v] < first[link[v]]:
                first[link[v]] = first[v]

    def matching(self, symbols: Sequence, cap: int) -> Iterator[tuple[int, int]]:
        """At each symbol: the length (``cap`` at most) of the longest match that ends here, and its state."""
        edges, link, length = self.next, self.link, self.length
        v = n = 0
        for s in symbols:
            while v and s not in edges[v]:
                v = link[v]
                n = length[v]
            if s in edges[v]:
                v = edges[v][s]
                n += 1
            if n >= cap:
                n = cap
                while length[link[v]] >= cap:
                    v = link[v]
            yield n, v


def first_documents(window: int):
    """For the pieces of a shard: the first document of each of their windows."""
    def solver(bodies: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[bytes, int] = {}
        pieces = [[numbers.setdefault(w, len(numbers)) for w in body.split(b" ")] for body in bodies]
        automaton = SuffixAutomaton()
        for piece, i in zip(pieces, ids.tolist(), strict=True):
            automaton.add(piece, i)
        automaton.finish()
        first = automaton.first
        found = [first[v] for piece in pieces for n, v in automaton.matching(piece, window) if n == window]
        return np.array(found, np.int64), np.array([max(0, len(piece) - window + 1) for piece in pieces])
    return solver


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS,
                    gram: int = GRAM_WORDS, hot: int = HOT) -> DataFrame:
    """(id, size, removed, spans, kept): words of each document, removed word spans and the kept words."""
    frame = Frame(words=True, window=window, gram=min(gram, window), hot=hot)
    return remove_repeats(docs, frame, first_documents(window), id_col, text_col)
