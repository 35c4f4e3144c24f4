"""A trie of globally ordered token sets, searched for sets that overlap one enough.

Sets that share a beginning share its path, so their partial overlap with a query is counted once. A
subtree is left out when its set sizes cannot fit, when what remains on both sides cannot make up the
overlap still missing, or when the caller already knows all of it (its sets carry the query's label).
"""

from __future__ import annotations

import numpy as np


def overlap_needed(a: int, b: int, part: int, whole: int) -> int:
    """The least intersection of sets of these sizes with whole * intersection >= part * union."""
    return -(-part * (a + b) // (whole + part))


class Trie:
    """Compressed: one node per branching; sets are held in lexicographic order, so a subtree is a range of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        bounds = np.cumsum([0] + [len(s) for s in sets])
        coded = [codes[a:b] for a, b in zip(bounds, bounds[1:])]
        self.order = sorted(range(len(sets)), key=lambda i: coded[i].astype(">i4").tobytes())
        self.sets = [coded[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.width = int(codes.max()) + 1 if len(codes) else 0
        # (first set, end set, depth at which the run begins, depth at which it ends, children)
        self.roots: list[tuple] = []
        shared = [self._common(a, b) for a, b in zip(self.sets, self.sets[1:])]
        self.root = self._node(0, len(sets), 0, shared)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, low: int, high: int, depth: int, shared: list[int]) -> tuple:
        """The subtree of sets low to high, all alike up to `depth`; built with a stack, as paths may be long."""
        top: list = []
        todo = [(low, high, depth, top)]
        while todo:
            low, high, depth, into = todo.pop()
            end = min(shared[low:high - 1]) if high - low > 1 else len(self.sets[low])
            children: list = []
            sizes = self.sizes[low:high]
            into.append((low, high, depth, end, int(sizes.min()), int(sizes.max()), children))
            if high - low > 1:
                start = low
                for i in range(low, high):
                    if i == high - 1 or shared[i] == end:
                        todo.append((start, i + 1, end, children))
                        start = i + 1
        return top[0]

    def near(self, query: int, part: int, whole: int, labels: np.ndarray | None = None, after: bool = True) -> list[int]:
        """Positions (in lexicographic order) of the sets that overlap the query's set enough.

        With `after`, only of later positions. With labels, sets labelled as the query is are left out; the
        caller may change labels between calls.
        """
        x = self.sets[query]
        size = len(x)
        member = np.zeros(self.width, dtype=bool)
        member[x] = True
        found, stack = [], [(self.root, 0)]
        while stack:
            (low, high, depth, end, least, most, children), overlap = stack.pop()
            if after and high <= query + 1 or whole * most < part * size or part * least > whole * size:
                continue
            if labels is not None and (labels[low:high] == labels[query]).all():
                continue
            run = self.sets[low][depth:end]
            overlap += int(member[run].sum())
            left = size - int(np.searchsorted(x, run[-1], "right")) if len(run) else size - overlap
            if overlap + min(left, most - end) < overlap_needed(size, max(least, -(-part * size // whole)), part, whole):
                continue
            if high - low == 1:
                if low != query and (not after or low > query) and overlap >= overlap_needed(size, least, part, whole):
                    found.append(low)
            else:
                stack += [(child, overlap) for child in children]
        return found


def classes(sets: list[np.ndarray], part: int, whole: int) -> np.ndarray:
    """For each set the smallest index of the class that links lead to; known classes are not searched again."""
    trie = Trie(sets)
    labels = np.array(trie.order)
    for query in range(len(sets)):
        for other in trie.near(query, part, whole, labels):
            a, b = labels[query], labels[other]
            if a != b:
                labels[labels == max(a, b)] = min(a, b)
    out = np.empty(len(sets), dtype=np.int64)
    out[trie.order] = labels
    return out
