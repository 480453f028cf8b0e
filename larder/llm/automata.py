"""Weighted acyclic automata over word sequences of bounded length, in numpy arrays.

An automaton accepts sequences of one to ``DEPTH`` words and gives each a count. It is
built from sorted sequences, level by level: an arc stands for one more word of a prefix
and its weight is the count of all sequences through it; what the arcs out of its target
do not carry on is the count of the sequence that ends there. States with equal arcs
(same words, weights and targets) are one state, from the last level up.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import zstandard

from larder.llm.columns import mix

DEPTH = 4


def summed(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``paths`` in order, and the sum of each one's counts."""
    if not len(paths):
        return paths, counts
    width = int(paths.max()).bit_length()
    if width * DEPTH <= 64:
        key = np.zeros(len(paths), np.uint64)
        for k in range(DEPTH):
            key = (key << np.uint64(width)) | paths[:, k].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    else:
        order = np.lexsort(paths.T[::-1])
        ranked = paths[order]
        first = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)])
    return paths[order[first]], np.add.reduceat(counts[order], first)


def labels(words: Sequence[bytes], sequences: Sequence[Sequence[bytes]]) -> np.ndarray:
    """Sequences of words as rows of labels of a sorted vocabulary, 0 after the last word; a
    word that it lacks gets a label that no arc has."""
    label = {w: k + 1 for k, w in enumerate(words)}
    none = len(words) + 1
    out = np.zeros((len(sequences), DEPTH), np.int64)
    for i, own in enumerate(sequences):
        out[i, :len(own)] = [label.get(w, none) for w in own]
    return out


def _narrow(values: np.ndarray) -> tuple:
    """Small numbers in a byte each; the few others apart."""
    large = np.flatnonzero(values >= 255)
    small = values.astype(np.uint8)
    small[large] = 255
    return small, large, values[large]


def _wide(small: np.ndarray, large: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[large] = values
    return out


def _steps(begin: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs out of ``states``, one state after another, and which of the given states each leaves."""
    size = begin[states + 1] - begin[states]
    of = np.repeat(np.arange(len(states)), size)
    start = np.cumsum(size) - size
    return begin[states][of] + np.arange(len(of)) - start[of], of


class Automaton:
    """``words`` is the sorted vocabulary; word ``k`` has the label ``k + 1``. ``arcs[d]``
    holds labels, weights and targets of the arcs of level d, ``begin[d]`` where the arcs
    of each state of that level begin. Level 0 has one state, the start."""

    def __init__(self, words: list[bytes], begin: list[np.ndarray], arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.begin, self.arcs = words, begin, arcs

    @classmethod
    def from_sorted(cls, words: list[bytes], paths: np.ndarray, counts: np.ndarray, share: bool = True) -> Automaton:
        """From different sequences in order: rows of labels, 0 after the last word.
        Without ``share`` equal states stay apart (one that is read once and not sent)."""
        changed = np.zeros(len(paths), bool)
        if len(paths):
            changed[0] = True
        above = np.zeros(len(paths), np.int64)  # the state of the level that each row's prefix leads to
        n_states, levels = 1, []
        for d in range(DEPTH):
            changed[1:] |= paths[1:, d] != paths[:-1, d]
            groups = np.flatnonzero(changed)
            weight = np.add.reduceat(counts, groups) if len(groups) else np.zeros(0, np.int64)
            full = paths[groups, d] > 0
            first = groups[full]
            begin = np.concatenate([[0], np.cumsum(np.bincount(above[first], minlength=n_states))])
            levels.append((begin, paths[first, d].astype(np.int64), weight[full].astype(np.int64)))
            opens = np.zeros(len(paths), np.int64)
            opens[first] = 1
            above, n_states = np.cumsum(opens) - 1, len(first)
        begin, arcs = [], []
        target = np.zeros(n_states, np.int64)  # nothing follows the last level
        for start, label, weight in reversed(levels):
            if share:
                kept, start, state = _shared(start, label, weight, target)
                label, weight, target = label[kept], weight[kept], target[kept]
            else:
                state = np.arange(len(start) - 1)
            begin.insert(0, start)
            arcs.insert(0, (label, weight, target))
            target = state
        return cls(words, begin, arcs)

    def carried_on(self, level: int) -> np.ndarray:
        """For each arc of a level, the weight that the arcs out of its target carry on."""
        if level == DEPTH - 1:
            return np.zeros(len(self.arcs[level][0]), np.int64)
        begin = self.begin[level + 1]
        total = np.concatenate([[0], np.cumsum(self.arcs[level + 1][1])])
        return (total[begin[1:]] - total[begin[:-1]])[self.arcs[level][2]]

    def prefixes(self):
        """For each level: the labels of every prefix of that many words, its weight, and
        the count of the sequence that ends with it."""
        arc = np.arange(len(self.arcs[0][0]))
        paths = np.zeros((len(arc), DEPTH), np.int64)
        for d in range(DEPTH):
            label, weight, target = self.arcs[d]
            paths[:, d] = label[arc]
            yield d, paths, weight[arc], weight[arc] - self.carried_on(d)[arc]
            if d < DEPTH - 1:
                arc, of = _steps(self.begin[d + 1], target[arc])
                paths = paths[of]

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Every accepted sequence and its count."""
        paths, counts = [], []
        for _, path, _, ended in self.prefixes():
            paths.append(path[ended > 0].copy())
            counts.append(ended[ended > 0])
        return np.concatenate(paths), np.concatenate(counts)

    def compose(self, paths: np.ndarray) -> np.ndarray:
        """The count of each of the given sequences (rows of labels, 0 after the last
        word; 0 if it isn't accepted): all of them walk the automaton at once."""
        state, counts = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        width = len(self.words) + 2
        alive = np.ones(len(paths), bool)
        for d in range(DEPTH):
            label, weight, target = self.arcs[d]
            step = np.flatnonzero(alive & (paths[:, d] > 0))
            if not len(step) or not len(label):
                counts[step] = 0
                break
            owner = np.repeat(np.arange(len(self.begin[d]) - 1), np.diff(self.begin[d]))
            keys = owner * width + label
            wanted = state[step] * width + paths[step, d]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            alive[:] = False
            alive[step[found]] = True
            counts[step] = np.where(found, weight[at] - self.carried_on(d)[at], 0)
            state[step] = target[at]
        return counts

    def dumps(self) -> bytes:
        compact = [(_narrow(np.diff(b)), label.astype(np.min_scalar_type(len(self.words))), _narrow(weight),
                    target.astype(np.min_scalar_type(int(target.max(initial=0)))))
                   for b, (label, weight, target) in zip(self.begin, self.arcs)]
        return zstandard.compress(pickle.dumps((b"\xff".join(self.words), compact), protocol=5))

    @classmethod
    def loads(cls, data: bytes) -> Automaton:
        words, compact = pickle.loads(zstandard.decompress(data))
        begin = [np.concatenate([[0], np.cumsum(_wide(*b))]) for b, *_ in compact]
        arcs = [(label.astype(np.int64), _wide(*weight), target.astype(np.int64)) for _, label, weight, target in compact]
        return cls(words.split(b"\xff") if words else [], begin, arcs)


def _shared(begin: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal states become one: which arcs stay, where the arcs of the states that stay
    begin, and the state that each old one has become. Hashes find states that may be
    equal, a comparison of all their arcs decides."""
    n_states, degree = len(begin) - 1, np.diff(begin)
    owner = np.repeat(np.arange(n_states), degree)
    place = (np.arange(len(label)) - begin[owner]).astype(np.uint64)
    arc = mix(mix(mix(label.astype(np.uint64)) + weight.astype(np.uint64)) + target.astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(arc + place))])
    seen = total[begin[1:]] - total[begin[:-1]]
    _, first, inverse = np.unique(seen, return_index=True, return_inverse=True)
    like = first[inverse]
    # every arc beside the arc at the same place of the state that its own may equal
    same = degree == degree[like]
    twin = np.minimum(begin[like[owner]] + place.astype(np.int64), max(len(label) - 1, 0))
    differs = (label != label[twin]) | (weight != weight[twin]) | (target != target[twin])
    same &= np.bincount(owner[differs], minlength=n_states) == 0
    like = np.where(same, like, np.arange(n_states))
    stays = like == np.arange(n_states)
    number = np.cumsum(stays) - 1
    return stays[owner], np.concatenate([[0], np.cumsum(degree[stays])]), number[like]


def union(automata: Sequence[Automaton]) -> Automaton:
    """One automaton of all sequences; counts of equal ones add up. Its equal states stay apart."""
    words = sorted(set().union(*(a.words for a in automata)))
    at = {w: k + 1 for k, w in enumerate(words)}
    paths, counts = [], []
    for a in automata:
        to = np.array([0, *(at[w] for w in a.words)], np.int32)
        own, n = a.sequences()
        paths.append(to[own])
        counts.append(n)
    return Automaton.from_sorted(words, *summed(np.concatenate(paths), np.concatenate(counts)), share=False)


def cut(words: list[bytes], paths: np.ndarray, splitters: Sequence[tuple[bytes, ...]]) -> list[int]:
    """Where each splitter would stand among the sorted sequences (before an equal one)."""
    out = []
    for splitter in splitters:
        key = []
        for w in splitter:
            k = bisect_left(words, w)
            key.append(k + 1)
            if k == len(words) or words[k] != w:  # it stands before every sequence that goes on with a later word
                break
        key += [0] * (DEPTH - len(key))
        out.append(bisect_left(range(len(paths)), key, key=lambda i: paths[i].tolist()))
    return out
