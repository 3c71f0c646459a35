"""A generalised suffix automaton over sequences of word ids."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Sequence


class _Walk:
    """Matching by ``length``, ``link`` and ``step(state, symbol)``, which is -1 without a transition."""

    def matches(self, sequence: Sequence[int]) -> Iterable[tuple[int, int]]:
        """For each position, the state and length of the longest match that ends there."""
        at, size = 0, 0
        for symbol in sequence:
            there = self.step(at, symbol)
            while at and there < 0:
                at = self.link[at]
                size = self.length[at]
                there = self.step(at, symbol)
            if there >= 0:
                at, size = there, size + 1
            yield at, size

    def suffix(self, at: int, size: int) -> int:
        """The state of the suffix of this size of the current match."""
        while self.link[at] >= 0 and self.length[self.link[at]] >= size:
            at = self.link[at]
        return at


class SuffixAutomaton(_Walk):
    """All substrings of a set of sequences, with the items that hold each.

    States have ``length`` (their longest substring), ``link`` (the state of the
    longest suffix that occurs elsewhere too), ``next`` (transitions) and
    ``items`` (items in which the state's substrings occur).
    """

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.items: list[set] = [set()]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        self.items.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        there = self.next[last].get(symbol)
        if there is not None:  # the prefix is known from another item
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, symbol, there)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at != -1 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at != -1:
            there = self.next[at][symbol]
            self.link[new] = there if self.length[at] + 1 == self.length[there] else self._split(at, symbol, there)
        return new

    def _split(self, at: int, symbol: int, there: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while at != -1 and self.next[at].get(symbol) == there:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    @classmethod
    def of(cls, sequences: Iterable[tuple[object, Sequence[int]]], least: int = 1) -> SuffixAutomaton:
        """Of (item, sequence) pairs; items are kept for states that have substrings of ``least`` or more."""
        self, read = cls(), []
        for item, sequence in sequences:
            last, path = 0, []
            for symbol in sequence:
                last = self._extend(last, symbol)
            read.append((item, sequence))
        for item, sequence in read:  # only now are the states final
            at, seen = 0, set()
            for symbol in sequence:
                at = self.next[at][symbol]
                up = at
                while up > 0 and up not in seen and self.length[up] >= least:
                    seen.add(up)
                    self.items[up].add(item)
                    up = self.link[up]
        return self

    def step(self, at: int, symbol: int) -> int:
        return self.next[at].get(symbol, -1)

    def frozen(self) -> Frozen:
        return Frozen(self)


class _Holders:
    """Items by state, as one array of numbers."""

    def __init__(self, items: list[set]) -> None:
        self.names = list({i for held in items for i in held})
        number = {name: k for k, name in enumerate(self.names)}
        self.begin, self.held = array("i", [0]), array("i")
        for held in items:
            self.held.extend(number[i] for i in held)
            self.begin.append(len(self.held))

    def __getitem__(self, state: int) -> set:
        return {self.names[k] for k in self.held[self.begin[state] : self.begin[state + 1]]}


class Frozen(_Walk):
    """A finished automaton in flat arrays, about 20 bytes for each transition and state: what is sent to tasks."""

    def __init__(self, whole: SuffixAutomaton) -> None:
        self.width = max((c for step in whole.next for c in step), default=0) + 2
        pairs = sorted((at * self.width + c + 1, there) for at, step in enumerate(whole.next) for c, there in step.items())
        self.keys, self.targets = array("q", [k for k, _ in pairs]), array("i", [t for _, t in pairs])
        self.length, self.link, self.items = array("i", whole.length), array("i", whole.link), _Holders(whole.items)

    def step(self, at: int, symbol: int) -> int:
        key = at * self.width + symbol + 1
        k = bisect_left(self.keys, key)
        return self.targets[k] if k < len(self.keys) and self.keys[k] == key else -1
