"""An Aho-Corasick automaton over pieces of text that walks many words at once.

The automaton is held in arrays: transitions in a hash table of (state, code
point), failure links, and for each state the pieces that end there. Words come
sorted and make a trie, depth by depth: a word has nodes of its own from the
depth on where it differs from the word before it, and shares those above. All
nodes of a depth take their step at once, and each node only once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points worked on at one time, and the longest word that is worked on with others.
BLOCK_CODES, LONGEST = 100_000, 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def blocks(words: list[str]) -> Iterator[list[str]]:
    """The words in order, in lists of bounded size."""
    if not words:
        return
    upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    cuts = np.flatnonzero(np.diff(upto // BLOCK_CODES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)], strict=True):
        yield words[a:b]


class Nodes:
    """The trie of sorted distinct words: codes (depth, word), 0 behind the end; node: the word whose own the node is."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = len(words)
        line = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        word = np.repeat(np.arange(n), self.lengths)
        depth = np.arange(len(line)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.codes = np.zeros((int(self.lengths.max(initial=0)), n), np.int64)
        self.codes[depth, word] = line.astype(np.int64) + 1
        own = np.ones(self.codes.shape, bool)
        own[:, 1:] = np.logical_or.accumulate(self.codes[:, 1:] != self.codes[:, :-1], axis=0)
        self.node = np.maximum.accumulate(np.where(own, np.arange(n, dtype=np.int32), 0), axis=1)
        self.own = own & (self.codes > 0)


class Automaton:
    """Over pieces numbered by their place in the list; size and ends are arrays over pieces and states."""

    def __init__(self, pieces: list[str]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        children: list[dict[int, int]] = [{}]
        named: list[int] = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for c in piece:
                code = ord(c) + 1
                if code not in children[at]:
                    children[at][code] = len(children)
                    children.append({})
                    named.append(-1)
                at = children[at][code]
            named[at] = k
        fail = [0] * len(children)
        ends: list[list[int]] = [[] for _ in children]
        level = [0]
        while level:
            below = []
            for s in level:
                for code, to in children[s].items():
                    f = fail[s]
                    while s and f and code not in children[f]:
                        f = fail[f]
                    fail[to] = children[f].get(code, 0) if s else 0
                    ends[to] = ([named[to]] if named[to] >= 0 else []) + ends[fail[to]]
                    below.append(to)
            level = below
        self.fail = np.array(fail, np.int32)
        self.n_ends = np.fromiter(map(len, ends), np.int32, len(ends))
        self.at_ends = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array([k for e in ends for k in e], np.int32)  # longest first
        self._hashed([(s << 21 | code, to) for s, c in enumerate(children) for code, to in c.items()])

    def _hashed(self, pairs: list[tuple[int, int]]) -> None:
        bits = max(8, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys, tos = [-1] * (1 << bits), [0] * (1 << bits)
        slots = self._slots(np.array([k for k, _ in pairs], np.int64)).tolist()
        for (key, to), slot in zip(pairs, slots, strict=True):
            while keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            keys[slot], tos[slot] = key, to
        self.keys, self.tos = np.array(keys, np.int64), np.array(tos, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def _child(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each state by its code, 0 where there is none."""
        keys = (states.astype(np.int64) << 21) | codes
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.tos[slots], 0)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.tos[slots[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after each state and code, by way of failure links."""
        out = self._child(states, codes)
        open_ = np.flatnonzero((out == 0) & (states > 0))
        left = states[open_]
        while len(open_):
            left = self.fail[left]
            found = self._child(left, codes[open_])
            out[open_] = found
            more = (found == 0) & (left > 0)
            left, open_ = left[more], open_[more]
        return out

    def walk(self, trie: Nodes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth: the depth, the words that have a node of their own, the states of those, and the states of all words."""
        now = np.zeros(len(trie.lengths), np.int32)
        for d in range(len(trie.codes)):
            own = np.flatnonzero(trie.own[d])
            there = self.step(now[own], trie.codes[d, own])
            now = now.copy()
            now[own] = there
            now = now[trie.node[d]]
            yield d, own, there, now

    def matches(self, trie: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each match in each word: the word, the depth behind it, and the piece."""
        words, depths, pieces = [], [], []
        for d, _, _, now in self.walk(trie):
            here = np.flatnonzero((self.n_ends[now] > 0) & (trie.lengths > d))
            states = now[here]
            n = self.n_ends[states].astype(np.int64)
            words.append(np.repeat(here, n))
            depths.append(np.full(len(words[-1]), d + 1))
            pieces.append(self.ends[np.repeat(self.at_ends[states] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        if not words:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(words), np.concatenate(depths), np.concatenate(pieces)
