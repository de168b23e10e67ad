"""Jaccard join of a block of n-gram sets by a prefix tree over globally ordered sets."""
from __future__ import annotations

import numpy as np


class PrefixTree:
    """Sets as sequences in one order (most frequent n-grams of the block first), sorted, so that a run is a subtree.

    N-grams of one set alone cannot be shared and only count in the set's size.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        shared = count[item] > 1
        item, owner = rank[item[shared]], owner[shared]
        by_item = np.lexsort((owner, item))
        self.posted = owner[by_item]
        self.post_at = np.searchsorted(item[by_item], np.arange(int((count > 1).sum()) + 1))
        by_owner = np.lexsort((item, owner))
        at = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
        self.paths = [item[by_owner[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.lengths = np.diff(at)
        self.order = np.array(sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes()))

    def common(self, lo: int, hi: int, depth: int) -> int:
        """Depth to which the paths of a run agree, from ``depth`` on."""
        a, b = self.paths[self.order[lo]][depth:], self.paths[self.order[hi - 1]][depth:]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return depth + (int(differ[0]) if len(differ) else n)

    def overlaps(self, segment: np.ndarray) -> np.ndarray:
        """How many n-grams of a path segment each set holds."""
        start, n = self.post_at[segment], self.post_at[segment + 1] - self.post_at[segment]
        total = int(n.sum())
        places = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(self.posted[places], minlength=len(self.sizes))


def links(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the block's sets as all links with den * intersection >= num * union would, at most one less than sets.

    The tree is walked once for all sets together: a node's overlaps serve everything below it. A set leaves a
    subtree when its overlap so far and what can still be shared (by the longest path below, and by the set's own rest)
    fall short of the least overlap for the smallest size below, or when sizes are too far apart; a subtree is left
    when it and all sets still in it are one component already. At a path's end the overlaps are whole.
    """
    tree = PrefixTree(sets)
    sizes, lengths, label = tree.sizes, tree.lengths, np.arange(len(sets))
    out: list[tuple[int, int]] = []
    stack = [(0, len(sets), 0, np.zeros(len(sets), np.int64), np.ones(len(sets), bool))]
    while stack:
        lo, hi, depth, overlap, active = stack.pop()
        run = tree.order[lo:hi]
        end = tree.common(lo, hi, depth)
        if end > depth:
            overlap = overlap + tree.overlaps(tree.paths[run[0]][depth:end])
        least, most = sizes[run].min(), sizes[run].max()
        rest = np.minimum(lengths[run].max() - end, lengths - overlap)
        active = active & ((overlap + rest) * (num + den) >= num * (sizes + least)) & (den * most >= num * sizes) & (den * sizes >= num * least)
        live = np.flatnonzero(active)
        if not len(live) or (label[live] == label[run[0]]).all() and (label[run] == label[run[0]]).all():
            continue
        while lo < hi and lengths[tree.order[lo]] == end:
            member = tree.order[lo]
            hits = live[(den + num) * overlap[live] >= num * (sizes[live] + sizes[member])]
            for other in hits[np.unique(label[hits], return_index=True)[1]]:
                if label[other] != label[member]:
                    out.append((int(ids[member]), int(ids[other])))
                    label[label == label[other]] = label[member]
            lo += 1
        while lo < hi:
            first = tree.paths[tree.order[lo]][end]
            stop = lo + 1
            while stop < hi and tree.paths[tree.order[stop]][end] == first:
                stop += 1
            stack.append((lo, stop, end, overlap, active))
            lo = stop
    return [(a, b) for a, b in out if a != b]
