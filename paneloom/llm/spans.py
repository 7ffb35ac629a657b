"""Covered stretches of a text: overlap is one bisection, however many spans a text has."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable


class Covered:
    """Disjoint stretches in order; `add` takes many at once, so a sweep tests against what earlier sweeps have kept."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.add(spans)

    def add(self, spans: Iterable[tuple[int, int]]) -> None:
        every = sorted([*zip(self.starts, self.ends), *spans])
        self.starts, self.ends = [], []
        for start, end in every:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.ends) and self.starts[at] < end
