"""Weighted acyclic automata that map keys (sequences of labels) to counts.

A transducer is built incrementally from keys in rising order: as soon as a
state can get no further arcs it is frozen, and states with equal futures are one. The
count of a key is the sum of the outputs along its path; outputs sit as close to
the start as they can (the least count of all keys that share an arc), so that
equal futures are found. ``union`` merges transducers and sums their counts,
``compose`` walks two of them together and gives the counts of the keys that both
accept.

Labels are bytes; keys are ordered as tuples of them. Counts are positive.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np

Key = tuple[bytes, ...]


@dataclass
class Automaton:
    """State s has the arcs first[s] to first[s + 1]; its own count, if a key
    ends there, is final[s], else final[s] is -1. State 0 is the empty set's;
    the start is ``start``."""

    labels: list[bytes]
    first: list[int]
    label: list[int]
    target: list[int]
    out: list[int]
    final: list[int]
    start: int

    def items(self) -> Iterator[tuple[Key, int]]:
        """Keys in rising order with their counts."""
        labels, first, label, target, out, final = self.labels, self.first, self.label, self.target, self.out, self.final

        def walk(state: int, key: Key, count: int) -> Iterator[tuple[Key, int]]:
            if final[state] >= 0:
                yield key, count + final[state]
            for a in range(first[state], first[state + 1]):
                to, below = target[a], key + (labels[label[a]],)
                if first[to] == first[to + 1]:  # a key's end, and no further one
                    yield below, count + out[a] + final[to]
                else:
                    yield from walk(to, below, count + out[a])

        return walk(self.start, (), 0)

    def pack(self) -> tuple[list[bytes], bytes, bytes]:
        """(labels, states and arcs, counts), for a row of a table."""
        shape = np.array([len(self.first), len(self.label), self.start, *self.first, *self.label, *self.target], np.int32)
        return self.labels, shape.tobytes(), np.array([*self.out, *self.final], np.int64).tobytes()

    @classmethod
    def unpack(cls, labels: list[bytes], shape: bytes, counts: bytes) -> Automaton:
        ints, big = np.frombuffer(shape, np.int32).tolist(), np.frombuffer(counts, np.int64).tolist()
        states, arcs, start = ints[:3]
        a, b = 3 + states, 3 + states + arcs
        return cls(labels, ints[3:a], ints[a:b], ints[b:], big[:arcs], big[arcs:], start)


class Builder:
    """Builds a transducer from keys that are added in rising order."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.first, self.label, self.target, self.out, self.final = [0, 0], [], [], [], [-1]
        self.frozen: dict[tuple, int] = {}
        # the path of the last key: (labels, targets, outputs) and final count of each state on it
        self.path: list[list] = [[[], [], [], -1]]
        self.last: Key | None = None

    def _freeze(self, state: list) -> int:
        labels, targets, outs, final = state
        mark = (final, *labels, *targets, *outs)
        at = self.frozen.get(mark)
        if at is None:
            at = self.frozen[mark] = len(self.final)
            self.label += labels
            self.target += targets
            self.out += outs
            self.final.append(final)
            self.first.append(len(self.label))
        return at

    def _close(self, depth: int) -> None:
        path = self.path
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][1][-1] = self._freeze(done)

    def add(self, key: Key, count: int) -> None:
        last, path = self.last, self.path
        same = 0
        if last is not None:
            if key <= last:
                raise ValueError("keys must rise")
            for a, b in zip(key, last):  # noqa: B905  keys differ in length
                if a != b:
                    break
                same += 1
            self._close(same)
        for i in range(same):  # an arc's output is the least count of the keys on it
            outs = path[i][2]
            rest = outs[-1] - count
            if rest > 0:
                outs[-1] = count
                below = path[i + 1]
                below[2] = [x + rest for x in below[2]]
                if below[3] >= 0:
                    below[3] += rest
                count = 0
            else:
                count -= outs[-1]
        ids = self.ids
        for word in key[same:]:
            state = path[-1]
            state[0].append(ids.setdefault(word, len(ids)))
            state[1].append(0)
            state[2].append(count)
            count = 0
            path.append([[], [], [], -1])
        path[-1][3] = count
        self.last = key

    def done(self) -> Automaton:
        self._close(0)
        start = self._freeze(self.path[0])
        return Automaton(list(self.ids), self.first, self.label, self.target, self.out, self.final, start)


def build(items: Iterable[tuple[Key, int]]) -> Automaton:
    b = Builder()
    for key, count in items:
        b.add(key, count)
    return b.done()


def union(parts: list[Automaton], least: int = 1) -> Automaton:
    """All keys of ``parts`` with the sum of their counts, where that is ``least``
    or more."""
    merged = heapq.merge(*[p.items() for p in parts])
    summed = ((key, sum(c for _, c in same)) for key, same in groupby(merged, key=itemgetter(0)))
    return build((key, count) for key, count in summed if count >= least)


def compose(asked: Automaton, counts: Automaton) -> Iterator[tuple[Key, int]]:
    """The keys that ``asked`` accepts with their counts in ``counts``, in order;
    keys that ``counts`` lacks do not occur."""

    def walk(s: int, t: int, key: Key, count: int) -> Iterator[tuple[Key, int]]:
        if asked.final[s] >= 0 and counts.final[t] >= 0:
            yield key, count + counts.final[t]
        a, a_end, b, b_end = asked.first[s], asked.first[s + 1], counts.first[t], counts.first[t + 1]
        while a < a_end and b < b_end:
            x, y = asked.labels[asked.label[a]], counts.labels[counts.label[b]]
            if x == y:
                yield from walk(asked.target[a], counts.target[b], key + (x,), count + counts.out[b])
            a, b = a + (x <= y), b + (y <= x)

    return walk(asked.start, counts.start, (), 0)
