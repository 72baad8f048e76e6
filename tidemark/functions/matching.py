"""Which of many values a text holds, found in one walk over the text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence


class ValueFinder:
    """An automaton over all values at once: a tree of their characters with failure links to the longest proper suffix.

    Built once per set of values and walked once per text, however many values there are.
    """

    def __init__(self, values: Sequence[str]):
        self.values = sorted({v for v in values if v}, key=lambda v: (-len(v), v))
        self.steps: list[dict[str, int]] = [{}]
        self.fail, self.ends, self.shorter = [0], [-1], [0]
        for i, value in enumerate(self.values):
            at = 0
            for c in value:
                if c not in self.steps[at]:
                    self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.fail.append(0)
                    self.ends.append(-1)
                    self.shorter.append(0)
                at = self.steps[at][c]
            self.ends[at] = i
        queue = deque(self.steps[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.steps[at].items():
                back = self.fail[at]
                while back and c not in self.steps[back]:
                    back = self.fail[back]
                self.fail[to] = self.steps[back].get(c, 0)
                queue.append(to)
            # the nearest state behind this one at which a shorter value ends
            back = self.fail[at]
            self.shorter[at] = back if self.ends[back] >= 0 else self.shorter[back]

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        """(number of the value, where it starts), by where it ends."""
        steps, fail, ends, shorter, at = self.steps, self.fail, self.ends, self.shorter, 0
        for i, c in enumerate(text):
            while at and c not in steps[at]:
                at = fail[at]
            at = steps[at].get(c, 0)
            hit = at if ends[at] >= 0 else shorter[at]
            while hit:
                value = ends[hit]
                yield value, i + 1 - len(self.values[value])
                hit = shorter[hit]

    def consumed(self, text: str) -> int:
        """How many values count: from the longest on (ties in order), one still in the text counts and all its places become a blank."""
        places: dict[int, list[int]] = {}
        for value, start in self.occurrences(text):
            places.setdefault(value, []).append(start)
        blank = [i for i, v in enumerate(self.values) if " " in v] if places else []
        if blank:  # a blank put in may complete a value that has one
            n = 0
            for i in sorted({*places, *blank}):
                if self.values[i] in text:
                    n, text = n + 1, text.replace(self.values[i], " ")
            return n
        gone, n = bytearray(len(text)), 0
        for value in sorted(places):
            size, free, counted = len(self.values[value]), 0, False
            for start in places[value]:
                # taken from left to right, clear of longer values and of each other
                if start >= free and not any(gone[start : start + size]):
                    gone[start : start + size] = b"\1" * size
                    free, counted = start + size, True
            n += counted
        return n
