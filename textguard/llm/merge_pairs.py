"""Byte-pair tokens of words by prefix dynamic programming over a trie.

A segmentation into tokens is the one that merging gives exactly if every token merges to itself and
every two neighbours, merged as one string, give the same two again. So the last token of each
prefix of a word follows from the last tokens of its shorter prefixes alone: it is the one token that
ends there and goes with the last token of what precedes it. Sorted words are walked like a trie, depth
first: what a word has in common with the word before it is not computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from math import inf

Rank = Callable[[str, str], float | None]

#: Remembered pairs of tokens; when they are more, the memory starts anew.
PAIRS = 1_000_000
#: Tokens longer than this are looked up by their last units first.
SHORT = 3
ALWAYS = (3, 2, 1)


class PairTokens:
    """Tokens over strings of units, merged in the order of ``rank(left, right)``, smallest first (None: never)."""

    def __init__(self, tokens: Iterable[str], rank: Rank):
        self.names = list(dict.fromkeys(tokens))
        self.ids = {t: i for i, t in enumerate(self.names)}
        self.rank = rank
        self.goes: dict[int, bool] = {}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, float, float]]] = {}

    @cached_property
    def lengths(self) -> dict[str, tuple[int, ...]]:
        """The lengths to try by the last units, longest first."""
        found: dict[str, set[int]] = {}
        for t in self.names:
            if len(t) > SHORT:
                found.setdefault(t[-SHORT - 1 :], set()).add(len(t))
        return {k: (*sorted(v, reverse=True), *ALWAYS) for k, v in found.items()}

    def merged(self, word: str, least: int = 1) -> list[str]:
        """The tokens by plain merging, down to ``least`` of them: of all neighbours the pair with the smallest rank, then the first, is merged."""
        parts: list[str | None] = list(word)
        after, before, left = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)], len(parts)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(word, word[1:])) if (r := self.rank(a, b)) is not None]
        heapify(heap)
        while heap and left > least:
            _, i, a, b = heappop(heap)
            j = after[i]
            # a part may have been merged since
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i], left = a + b, None, after[j], left - 1
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank(parts[x], parts[y])) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def _split(self, token: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the token; None for a unit and for a token that merging never makes."""
        if token not in self.splits:
            parts = self.merged(token, 2)
            self.splits[token] = tuple(parts) if len(parts) == 2 and self.rank(*parts) is not None else None
        return self.splits[token]

    def _stands(self, token: str) -> bool:
        return len(token) == 1 or self._split(token) is not None

    def _spine(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """The parts that lie at one edge of the token while it is made, with the ranks at which each comes and goes."""
        found = self.spines.get((token, side))
        if found is None:
            found, part, until = [], token, inf
            while part:
                pair = self._split(part)
                since = self.rank(*pair) if pair else -inf
                found.append((part, since, until))
                part, until = (pair[side], since) if pair else ("", until)
            self.spines[token, side] = found
        return found

    def fits(self, before: str, token: str) -> bool:
        """Whether the two stay apart when they are merged as one string.

        They do unless some part at the right edge of the first and some part at the left edge of the
        second are there at the same time and merge before either is used up. Of equal ranks the left one goes first.
        """
        if not self._stands(token):
            return False
        for x, x_since, x_until in self._spine(before, 1):
            for y, y_since, y_until in self._spine(token, 0):
                if x_since <= y_until and y_since < x_until:
                    m = self.rank(x, y)
                    if m is not None and m < x_until and m <= y_until:
                        return False
        return True

    def _learn(self, before: int, token: int) -> bool:
        if len(self.goes) > PAIRS:
            self.goes.clear()
        first = self._stands(self.names[token])
        found = self.goes[before << 20 | token] = first and (before < 0 or self.fits(self.names[before], self.names[token]))
        return found

    def sweep(self, words: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """For each of the sorted words: the last token and the token count of every prefix, from the empty one on.

        The lists are used again for the next word; copy what is to be kept. A unit outside the
        vocabulary is a token of its own, -1.
        """
        ids, goes, lengths = self.ids.get, self.goes, self.lengths.get
        last, count, before = [-1], [0], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in lengths(word[end - SHORT - 1 : end], ALWAYS) if end > SHORT else range(end, 0, -1):
                    start = end - size
                    if start < 0:
                        continue
                    token = ids(word[start:end])
                    if token is not None:
                        known = goes.get(last[start] << 20 | token)
                        if known or known is None and self._learn(last[start], token):
                            last.append(token)
                            count.append(count[start] + 1)
                            break
                else:
                    last.append(-1)
                    count.append(count[end - 1] + 1)
            yield word, last, count
            before = word
