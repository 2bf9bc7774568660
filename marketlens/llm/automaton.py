"""Generalised suffix automaton over sequences of word numbers."""

from __future__ import annotations

import numpy as np

ROOT = 0
NEVER = 1 << 60


class SuffixAutomaton:
    """All substrings of the added items; ``match`` streams tokens through it.

    A window is ``window`` consecutive words of an item; an item with fewer words is one window
    as a whole. States carry which windows end in them.
    """

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, list[int]] = {}  # state of a short item's whole text -> items
        self.long: dict[int, list[int]] = {}  # state of a window -> items

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the longest string that ends p's strings with ``word``, cut from q if need be."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, ROOT)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def build(self, items: list[list[int]]) -> SuffixAutomaton:
        """Add all items (lists of word numbers), then mark the states where their windows end."""
        for words in items:
            last = ROOT
            for word in words:
                last = self._extend(last, word)
        for item, words in enumerate(items):
            state = ROOT
            for word in words:
                state = self.next[state][word]
                at = state
                while self.length[at] >= self.window and self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                if self.length[at] >= self.window:
                    owners = self.long.setdefault(at, [])
                    if not owners or owners[-1] != item:
                        owners.append(item)
            if 0 < len(words) < self.window:
                self.short.setdefault(state, []).append(item)
        self._finish()
        return self

    def _finish(self) -> None:
        """Per state: the window its long strings end with, the short item its suffixes end with, and
        the least match that holds either."""
        n = len(self.length)
        self.ending, self.within, self.least = [ROOT] * n, [ROOT] * n, [NEVER] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.within[v] = up if up in self.short else self.within[up]
            if self.length[v] >= self.window:
                self.ending[v] = v if self.length[up] < self.window else self.ending[up]
            if self.within[v]:
                self.least[v] = self.length[self.within[v]]  # any match in v holds it
            elif v in self.short:
                self.least[v] = self.length[v]
            elif self.length[v] >= self.window:
                self.least[v] = self.window
        self.step = {(state, word): to for state, following in enumerate(self.next) for word, to in following.items()}
        self.next = []

    def shortest(self) -> int:
        """Words of the shortest window there is."""
        return min((k for k in self.least if k < NEVER), default=NEVER)

    def items_of(self, states: set[int]) -> set[int]:
        return {i for s in states for i in (*self.long.get(s, ()), *self.short.get(s, ()))}

    def match(self, places: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, set[int]]]:
        """Spans (start, end, longest match, states of windows) of the places inside any window.

        ``places`` ascend; where they jump, a word that no item holds lies between. Spans do not overlap.
        """
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        spans: list[tuple[int, int, int, set[int]]] = []
        state, matched, before = ROOT, 0, -2
        for place, word in zip(places.tolist(), words.tolist(), strict=True):
            if place != before + 1:
                state, matched = ROOT, 0
            before = place
            while (to := step.get((state, word))) is None and state != ROOT:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched < least[state]:
                continue
            met, covered = set(), 0
            if matched >= window:
                met.add(self.ending[state])
                covered = window
            if state in self.short and matched == length[state]:
                met.add(state)
                covered = max(covered, matched)
            below = self.within[state]
            while below:
                met.add(below)
                covered = max(covered, length[below])
                below = self.within[below]
            start, end, longest = place + 1 - covered, place + 1, matched
            while spans and spans[-1][1] >= start and spans[-1][1] <= end:
                low, _, reach, states = spans.pop()
                start, longest = min(start, low), max(longest, reach)
                met |= states
            spans.append((start, end, longest, met))
        return spans
