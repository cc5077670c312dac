"""Byte-pair merges as a table of valid neighbours.

A sequence of tokens is the encoding of its text exactly if each two neighbours are: their own merges, undone from the
border outwards, never leave a pair that would have merged across it first. So the last token of every beginning of a
text follows from those of shorter beginnings, in one pass from left to right.
"""

from __future__ import annotations

from collections.abc import Iterable


class Merges:
    """Tokens (bytes or str) by rank, the earliest merge first; ``cut[i]`` are the two parts of token i, None for a single symbol or for a
    token that no merge makes."""

    def __init__(self, tokens: Iterable):
        self.tokens = list(tokens)
        self.index = {t: i for i, t in enumerate(self.tokens)}
        self.cut: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.joined: dict[tuple[int, int], int] = {}
        self.dead: set[int] = set()
        self._valid: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                continue
            for k in range(1, len(t)):
                a, b = self.index.get(t[:k], -1), self.index.get(t[k:], -1)
                if self._made(a, i) and self._made(b, i) and self._check(a, b):
                    self.cut[i] = (a, b)
                    self.joined[a, b] = i
                    break
            else:
                self.dead.add(i)
        self.longest = max(map(len, self.tokens), default=1)

    def _made(self, a: int, before: int) -> bool:
        """Single symbols are there from the start, whatever their rank."""
        return a >= 0 and (len(self.tokens[a]) == 1 or (a < before and a not in self.dead))

    def _rank(self, a: int) -> int:
        return a if self.cut[a] else -1

    def _check(self, a: int, b: int) -> bool:
        limit = len(self.tokens)
        while True:
            m = self.joined.get((a, b))
            if m is not None and m < limit:
                return False
            ra, rb = self._rank(a), self._rank(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later merge is undone first
                limit, a = ra, self.cut[a][1]
            else:  # of equal ones the right one is later; a merge across the border stands left of it
                limit, b = rb + 1, self.cut[b][0]

    def valid(self, a: int, b: int) -> bool:
        """May token b follow token a?"""
        key = (a, b)
        found = self._valid.get(key)
        if found is None:
            found = self._valid[key] = self._check(a, b)
        return found

    def encode(self, word) -> list[int]:
        """Token numbers of one word, -1 for each symbol that is no token."""
        n = len(word)
        last, back = [-2] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                t = self.index.get(word[s:e])
                if t is None or t in self.dead:
                    continue
                if last[s] < 0 or self.valid(last[s], t):
                    last[e], back[e] = t, s
                    break
            else:
                last[e], back[e] = -1, e - 1
        out, e = [], n
        while e:
            out.append(last[e])
            e = back[e]
        return out[::-1]
