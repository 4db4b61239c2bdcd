"""A multi-pattern automaton (a trie with failure links): all patterns that a text contains, in one pass over its characters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator


class Automaton:
    """Built once from distinct, not empty patterns. ``longest[state]`` is the longest pattern that ends in a state (an index), or -1;
    ``shorter[pattern]`` the next one that ends wherever that pattern does, or -1."""

    def __init__(self, patterns: list[str]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        own = [-1]
        for i, p in enumerate(patterns):
            at = 0
            for c in p:
                to = self.steps[at].get(c)
                if to is None:
                    to = self.steps[at][c] = len(own)
                    self.steps.append({})
                    own.append(-1)
                at = to
            own[at] = i
        self.back = [0] * len(own)
        self.longest, self.shorter = own, [-1] * len(patterns)
        queue = deque(self.steps[0].values())
        while queue:  # by depth: a state's failure link leads to a shallower one, which is done
            at = queue.popleft()
            below = self.longest[self.back[at]] if self.back[at] != at else -1
            if own[at] >= 0:
                self.shorter[own[at]] = below
            else:
                self.longest[at] = below
            for c, to in self.steps[at].items():
                self.back[to] = self._step(self.back[at], c) if at else 0
                queue.append(to)

    def _step(self, at: int, c: str) -> int:
        steps, back = self.steps, self.back
        while at and c not in steps[at]:
            at = back[at]
        return steps[at].get(c, 0)

    def ends(self, text: str) -> Iterator[int]:
        """The longest pattern that ends at each character, where one does."""
        at, steps, back, longest = 0, self.steps, self.back, self.longest
        for c in text:
            while at and c not in steps[at]:
                at = back[at]
            at = steps[at].get(c, 0)
            if longest[at] >= 0:
                yield longest[at]

    def found(self, text: str) -> set[int]:
        """All patterns that the text contains."""
        out: set[int] = set()
        for i in self.ends(text):
            while i >= 0 and i not in out:
                out.add(i)
                i = self.shorter[i]
        return out

    def first_texts(self, texts: Iterable[str]) -> list[int]:
        """For each pattern the first of ``texts`` that contains it, or -1. A pattern that has its text is passed over from then on."""
        first = [-1] * len(self.shorter)
        next_open = list(self.shorter)
        for k, text in enumerate(texts):
            for i in self.ends(text):
                while i >= 0:
                    if first[i] < 0:
                        first[i] = k
                    after = next_open[i]
                    while after >= 0 and first[after] >= 0:
                        after = next_open[after]
                    next_open[i] = after
                    i = after
        return first
