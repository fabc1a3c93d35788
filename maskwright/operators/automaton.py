"""Many names at once: a trie with failure links in flat arrays, which all texts of a batch walk together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Stands between texts; no code point, so no name goes across.
BETWEEN = 0x110000
_CODE_BITS = 21
#: Characters that one lane walks, as texts are cut to be walked side by side.
LANE = 512


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


@dataclass(frozen=True)
class Automaton:
    """States are numbered by depth, the root is 0.

    edges: sorted state << 21 | code point, with the states they lead to (targets) and, for the root, by code point
    (root); fail: the longest proper ending that is a state too; out: the name that ends here, or -1; link: the next
    state down the failures where one ends, or 0.
    """

    edges: np.ndarray
    targets: np.ndarray
    root: np.ndarray
    fail: np.ndarray
    out: np.ndarray
    link: np.ndarray
    lengths: np.ndarray

    def goto(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where edges lead, -1 where there is none."""
        to = self.root[codes]
        inner = np.flatnonzero(states)
        if len(inner):
            key = states[inner] << _CODE_BITS | codes[inner]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            to[inner] = np.where(self.edges[at] == key, self.targets[at], -1)
        return to

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states: along an edge, or along that of the longest ending that has one, or the root."""
        states = states.copy()
        open_ = np.arange(len(states))
        out = np.zeros_like(states)
        while len(open_):
            to = self.goto(states[open_], codes[open_])
            done = to >= 0
            out[open_[done]] = to[done]
            left = open_[~done]
            open_ = left[states[left] > 0]
            states[open_] = self.fail[states[open_]]
        return out

    def ends(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, names) of all names in codes, overlapping ones too; the places are behind their last characters."""
        warm = int(self.lengths.max(initial=1)) - 1
        lanes = max(1, len(codes) // LANE)
        first = np.arange(lanes) * len(codes) // lanes
        last = np.r_[first[1:], len(codes)]
        padded = np.concatenate([np.full(warm, BETWEEN), codes, [BETWEEN]])
        states, places, found = np.zeros(lanes, dtype=np.int64), [], []
        for t in range(-warm, int((last - first).max(initial=0))):
            at = first + t
            states = self.step(states, padded[np.minimum(at + warm, len(padded) - 1)])
            if t >= 0:
                some = np.flatnonzero(((self.out[states] >= 0) | (self.link[states] > 0)) & (at < last))
                places.append(at[some] + 1)
                found.append(states[some])
        none = np.zeros(0, dtype=np.int64)
        place, state = np.concatenate([none, *places]), np.concatenate([none, *found])
        all_places, all_names = [], []
        while len(state):
            ending = self.out[state] >= 0
            all_places.append(place[ending])
            all_names.append(self.out[state[ending]])
            state = self.link[state]
            place, state = place[state > 0], state[state > 0]
        return np.concatenate([none, *all_places]), np.concatenate([none, *all_names])


def build(names: Sequence[str]) -> Automaton:
    """Level by level: all names that are long enough take their next character together. Names differ and aren't empty."""
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    codes, starts = code_points("".join(names)), np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    state, count = np.zeros(len(names), dtype=np.int64), 1
    edges, targets, out, parents, chars, levels = [], [], [np.full(1, -1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [1]
    alive, depth = np.arange(len(names)), 0
    while len(alive):
        key, place = np.unique(state[alive] << _CODE_BITS | codes[starts[alive] + depth], return_inverse=True)
        state[alive] = count + place
        edges.append(key)
        targets.append(count + np.arange(len(key)))
        parents.append(key >> _CODE_BITS)
        chars.append(key & (1 << _CODE_BITS) - 1)
        here = np.full(len(key), -1)
        over = alive[lengths[alive] == depth + 1]
        here[state[over] - count] = over
        out.append(here)
        count += len(key)
        levels.append(count)
        depth += 1
        alive = alive[lengths[alive] > depth]
    none = np.zeros(0, dtype=np.int64)
    root = np.full(BETWEEN + 1, -1, dtype=np.int64)
    if edges:
        root[edges[0]] = targets[0]
    fail, link = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    machine = Automaton(np.concatenate([none, *edges]), np.concatenate([none, *targets]), root, fail, np.concatenate(out), link, lengths)
    parent, char = np.concatenate(parents), np.concatenate(chars)
    for a, b in zip(levels[1:], levels[2:], strict=False):  # below the first level, whose failures are the root
        fail[a:b] = machine.step(fail[parent[a:b]], char[a:b])
    for a, b in zip(levels, levels[1:], strict=False):
        link[a:b] = np.where(machine.out[fail[a:b]] >= 0, fail[a:b], link[fail[a:b]])
    return machine


def _in_words(codes: np.ndarray) -> np.ndarray:
    """Which of the code points are letters, digits or underscores."""
    kinds, place = np.unique(codes, return_inverse=True)
    return np.array([c != BETWEEN and (chr(c).isalnum() or c == 95) for c in kinds.tolist()], dtype=bool)[place]


def whole_names(machine: Automaton, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
    """(name, start, end) in each text: from left to right the longest name that begins and ends at word edges, without overlaps."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    codes = code_points("\n".join(texts) + "\n") if len(texts) else np.zeros(0, dtype=np.int64)
    codes[begin + sizes - 1] = BETWEEN
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    end, name = machine.ends(codes)
    start = end - machine.lengths[name]
    word = np.r_[_in_words(codes), False] if len(codes) else np.zeros(1, dtype=bool)
    edge = ~word[start - 1] & ~word[end]  # before the first text is the place behind the last
    start, end, name = start[edge], end[edge], name[edge]
    order = np.lexsort((-end, start))
    text_of, free = np.searchsorted(begin, start, "right") - 1, 0
    for i in order.tolist():
        if start[i] >= free:
            free = int(end[i])
            t = int(text_of[i])
            out[t].append((int(name[i]), int(start[i] - begin[t]), int(end[i] - begin[t])))
    return out
