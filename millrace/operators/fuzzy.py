"""Fuzzy alias scores: a trie and a bigram index name every alias that can reach a score, bit-parallel LCS scores those.

The score of two strings is the best indel similarity (0-100) of the shorter one with any equally long window of the longer one, windows
over its edges included. A score of t needs at most (1 - t/100) * 2n edits for a shorter string of n characters: bounds that lose nothing.

- Aliases no longer than the text go through a trie, so names that begin alike are compared once as far as they do: a node keeps the
  fewest edits between what leads to it and any part of the text, and is left when these are more than any alias below it may have.
- Longer ones: an edit breaks at most two bigrams, so n - 1 - 2 * floor(...) bigrams of the text stand in the alias.

The best alias is looked for at a score of 100 first, then in STEPS down to the threshold; the first step that finds one has them all.
"""

from __future__ import annotations

import numpy as np


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def partial_ratio(a: str, b: str) -> float:
    x, y = _codes(a), _codes(b)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    n = len(x)
    if not n:
        return 0.0
    pad = np.zeros(n - 1, np.uint32)  # no string holds a zero
    win = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y, pad]), n)
    size = (win != 0).sum(1)
    length = np.zeros(len(win), np.int64)
    if n <= 64:
        length = _lcs_bits(x, win)
    else:
        row = np.zeros((len(win), n + 1), np.int32)
        for c in x:
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, 1:], row[:, :-1] + (win == c))
            row = np.maximum.accumulate(new, 1)
        length = row[:, -1]
    return float((200.0 * length / (n + size)).max())


def _lcs_bits(x: np.ndarray, win: np.ndarray) -> np.ndarray:
    """Longest common subsequence of x (64 characters at most) with every row of win: one machine word a window, a zero bit a match."""
    kinds, which = np.unique(x, return_inverse=True)
    mask = np.zeros(len(kinds) + 1, np.uint64)
    for i, k in enumerate(which):
        mask[k] |= np.uint64(1 << i)
    at = np.minimum(np.searchsorted(kinds, win), len(kinds) - 1)
    hits = np.where(kinds[at] == win, mask[at], np.uint64(0))
    s = np.full(len(win), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for j in range(win.shape[1]):
            u = s & hits[:, j]
            s = (s + u) | (s - u)
    return np.bitwise_count(~s & np.uint64((1 << len(x)) - 1)).astype(np.int64)


def least_shared(n: np.ndarray, threshold: float) -> np.ndarray:
    """Bigrams of a string of n characters that survive in whatever scores `threshold` with it."""
    return n - 1 - 2 * np.floor((1 - threshold / 100) * 2 * n + 1e-9).astype(np.int64)


STEPS = 4
CELLS = 1 << 21  # entries of the nodes that are compared at once


class Trie:
    """Lowered aliases by common beginnings, a level of nodes for each character; the children of a node stand side by side."""

    def __init__(self, aliases: list[str]):
        order = np.array(sorted(range(len(aliases)), key=aliases.__getitem__), np.int64)
        codes = [_codes(aliases[i]) for i in order]
        size = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.zeros(0, np.uint32)])
        at = np.cumsum(size) - size
        self.depth = int(size.max(initial=0))
        self.order, self.chars, self.most, self.kids, self.ends = order, [], [], [], []
        rows = np.flatnonzero(size > 0)
        node = np.zeros(len(rows), np.int64)  # the parent of each alias that goes on
        parents = 1
        for d in range(self.depth):
            c = flat[at[rows] + d]
            new = np.append(True, (c[1:] != c[:-1]) | (node[1:] != node[:-1]))
            first = np.flatnonzero(new)
            self.chars.append(c[first])
            self.most.append(np.maximum.reduceat(size[rows], first))
            self.kids.append(np.searchsorted(node[first], np.arange(parents + 1)))
            node, parents = np.cumsum(new) - 1, len(first)
            last = size[rows] == d + 1
            self.ends.append((np.searchsorted(node[last], np.arange(parents + 1)), rows[last]))
            rows, node = rows[~last], node[~last]

    def near(self, text: str, score: float) -> np.ndarray:
        """Numbers of the aliases, none longer than the text, that may reach the score."""
        y = _codes(text)
        place = np.arange(len(y) + 1, dtype=np.int32)
        edits = lambda n: np.floor((1 - score / 100) * 2 * np.minimum(n, len(y)) + 1e-9)
        found = [np.zeros(0, np.int64)]
        todo = [(0, np.zeros(1, np.int64), np.zeros((1, len(y) + 1), np.int32))]
        while todo:
            d, nodes, cost = todo.pop()
            if d == min(self.depth, len(y)):
                continue
            kids = self.kids[d]
            count = kids[nodes + 1] - kids[nodes]
            of = np.repeat(np.arange(len(nodes)), count)
            below = np.arange(len(of)) - np.repeat(np.cumsum(count) - count - kids[nodes], count)
            held = max(1, CELLS // len(place))
            for lo in range(0, len(below), held):
                n, was = below[lo : lo + held], cost[of[lo : lo + held]]
                now = was + 1
                now[:, 1:] = np.where(y[None, :] == self.chars[d][n][:, None], np.minimum(now[:, 1:], was[:, :-1]), now[:, 1:])
                now = np.minimum.accumulate(now - place, 1) + place
                least = now.min(1)
                on = least <= edits(self.most[d][n])
                first, rows = self.ends[d]
                done = n[least <= edits(d + 1)]
                count = first[done + 1] - first[done]
                found.append(rows[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first[done], count)])
                if on.any():
                    todo.append((d + 1, n[on], now[on]))
        return self.order[np.concatenate(found)]


class Index:
    """Lowered aliases in a trie, and their bigrams -> the aliases that hold them."""

    def __init__(self, aliases: list[str], threshold: float):
        self.aliases, self.threshold = [a.lower() for a in aliases], threshold
        self.size = np.array([len(a) for a in self.aliases], np.int64)
        keys = [self._bigrams(a) for a in self.aliases]
        key = np.concatenate([*keys, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        self.key, place = np.unique(key, return_inverse=True)
        pair = np.unique(place * max(1, len(keys)) + owner)
        self.owner = pair % max(1, len(keys))
        self.at = np.searchsorted(pair // max(1, len(keys)), np.arange(len(self.key) + 1))
        self.trie = Trie(self.aliases)

    @staticmethod
    def _bigrams(s: str) -> np.ndarray:
        c = _codes(s).astype(np.uint64)
        return (c[:-1] << np.uint64(32)) | c[1:]

    def _longer(self, text: str, score: float) -> np.ndarray:
        """Numbers of the aliases longer than the text that may reach the score."""
        if self.trie.depth <= len(text):
            return np.zeros(0, np.int64)
        mine, copies = np.unique(self._bigrams(text), return_counts=True)  # the text's bigrams are counted, with repeats
        place = np.searchsorted(self.key, mine)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == mine[known]
        first, size = self.at[place[known]], self.at[place[known] + 1] - self.at[place[known]]
        rows = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        count = np.bincount(self.owner[rows], np.repeat(copies[known], size), len(self.size)).astype(np.int64)
        return np.flatnonzero((self.size > len(text)) & (count >= least_shared(np.array(len(text)), score)))

    def candidates(self, text: str, score: float | None = None) -> np.ndarray:
        """Numbers of the aliases that may reach the score (the threshold), in catalogue order."""
        if not text or not len(self.size):
            return np.zeros(0, np.int64)
        score = self.threshold if score is None else score
        return np.sort(np.concatenate([self.trie.near(text, score), self._longer(text, score)]))

    def best(self, text: str) -> tuple[int, float] | None:
        """The first alias in catalogue order of the highest score, if that reaches the threshold."""
        text, known = text.lower(), {}
        for score in np.linspace(100.0, self.threshold, STEPS + 1).tolist():
            top = None
            for i in self.candidates(text, score).tolist():
                if (alias := self.aliases[i]) not in known:
                    known[alias] = partial_ratio(alias, text)
                if known[alias] >= score and (top is None or known[alias] > top[1]):
                    top = (i, known[alias])
            if top:
                return top
        return None
