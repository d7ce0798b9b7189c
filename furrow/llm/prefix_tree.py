"""A compressed prefix tree over ordered sets, and the similarity join that traverses it.

Sets are written in one order (most frequent member first, so that similar sets share long paths) and stored in a
trie whose chains are single nodes. A probe walks the tree once, level by level: the overlap of a path is counted once
for all sets below it, and a subtree is cut when the overlap so far and what remains, on either side, cannot reach the
bound for the smallest set below.
"""

from __future__ import annotations

import numpy as np

#: So few sets form a tree of hardly more than leaves; they are compared one by one.
FEW = 4


class PrefixTree:
    def __init__(self, sets: list[np.ndarray]):
        count = len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        members, which = np.unique(np.concatenate(sets), return_inverse=True)
        self.members = len(members)
        rank = np.empty(len(members), np.int64)
        rank[np.argsort(-np.bincount(which), kind="stable")] = np.arange(len(members))
        ranks = np.split(rank[which], np.cumsum(self.size)[:-1])
        ranks = [np.sort(r) for r in ranks]
        self.order = sorted(range(count), key=lambda i: ranks[i].astype(">i4").tobytes())  # row -> set
        rows = [ranks[i] for i in self.order]
        self.row_size = self.size[self.order]
        self.flat = np.concatenate(rows)
        self.begin = np.concatenate([[0], np.cumsum(self.row_size)])
        self._build(rows)

    def _build(self, rows: list[np.ndarray]) -> None:
        parent, end, row, low = [-1], [0], [0], [0]
        high = [len(rows)]
        ends_at: list[list[int]] = [[]]
        stack = [0]
        for i, own in enumerate(rows):
            shared = 0
            if i:
                n = min(len(own), len(rows[i - 1]))
                differ = np.flatnonzero(own[:n] != rows[i - 1][:n])
                shared = int(differ[0]) if len(differ) else n
            below = -1
            while end[stack[-1]] > shared:
                below = stack.pop()
                high[below] = i
            if end[stack[-1]] < shared:  # the chain of ``below`` forks here
                parent.append(stack[-1])
                end.append(shared)
                row.append(row[below])
                low.append(low[below])
                high.append(-1)
                ends_at.append([])
                parent[below] = len(parent) - 1
                stack.append(len(parent) - 1)
            if end[stack[-1]] == len(own):  # equal sets end at one node
                ends_at[stack[-1]].append(i)
                continue
            parent.append(stack[-1])
            end.append(len(own))
            row.append(i)
            low.append(i)
            high.append(-1)
            ends_at.append([i])
            stack.append(len(parent) - 1)
        for node in stack:
            high[node] = len(rows)
        self.parent, self.end, self.row, self.low, self.high = (np.array(x, np.int64) for x in (parent, end, row, low, high))
        start = np.where(self.parent >= 0, self.end[self.parent], 0)
        size = self.end - start
        self.cuts = np.concatenate([[0], np.cumsum(size)])  # of each node's own members among all of the tree's
        at = np.repeat(self.begin[self.row] + start - self.cuts[:-1], size) + np.arange(self.cuts[-1])
        self.chain = self.flat[at]
        self.last = self.flat[np.maximum(self.begin[self.row] + self.end - 1, 0)]
        self.levels, nodes = [], np.array([0])
        order = np.argsort(self.parent, kind="stable")
        first = np.searchsorted(self.parent[order], np.arange(len(parent) + 1))
        while True:
            count = first[nodes + 1] - first[nodes]
            if not count.sum():
                break
            nodes = order[np.repeat(first[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            self.levels.append(nodes)
        self.least = np.array([self.row_size[a:b].min() for a, b in zip(self.low, self.high, strict=True)])
        self.most = np.array([self.row_size[a:b].max() for a, b in zip(self.low, self.high, strict=True)])
        self.node_of = np.empty(len(rows), np.int64)  # where each row ends
        for node, own in enumerate(ends_at):
            self.node_of[own] = node

    def similar(self, probe: int, num: int, den: int, component: np.ndarray) -> np.ndarray:
        """Rows outside ``probe``'s component with den * |both| >= num * |either|. ``component`` is by row."""
        own = self.flat[self.begin[probe] : self.begin[probe + 1]]
        size = len(own)
        changes = np.concatenate([[0], np.cumsum(component[1:] != component[:-1])])
        alive = (component[self.low] != component[probe]) | (changes[self.high - 1] != changes[self.low])
        alive &= (self.most * den >= num * size) & (size * den >= num * self.least)
        least, most = np.maximum(self.least, -(-num * size // den)), np.minimum(self.most, size * den // num)
        has = np.zeros(self.members, np.int64)
        has[own] = 1
        gain = np.diff(np.concatenate([[0], np.cumsum(has[self.chain])])[self.cuts])
        left = np.minimum(size - np.searchsorted(own, self.last, "right"), most - self.end)
        # |both| must reach num * (|probe| + |other|) / (num + den)
        need = num * (size + least) - left * (num + den)
        overlap, kept = np.zeros(len(gain), np.int64), np.zeros(len(gain), bool)
        kept[0] = True
        for level in self.levels:
            nodes = level[kept[self.parent[level]] & alive[level]]
            if not len(nodes):
                break
            overlap[nodes] = overlap[self.parent[nodes]] + gain[nodes]
            kept[nodes] = overlap[nodes] * (num + den) >= need[nodes]
        rows = np.flatnonzero(kept[self.node_of] & (component != component[probe]))
        return rows[overlap[self.node_of[rows]] * (num + den) >= num * (size + self.row_size[rows])]


def link_sets(sets: list[np.ndarray], num: int, den: int, component: np.ndarray | None = None, probes: list[int] | None = None) -> np.ndarray:
    """Component labels after linking all pairs of ``sets`` whose Jaccard similarity is num/den or more.

    ``component`` gives labels to start from; ``probes`` the sets to compare with all others (all sets if None).
    Pairs within a component are not compared: they cannot change it.
    """
    component = np.arange(len(sets)) if component is None else component.copy()
    if len(sets) <= FEW:
        for i in range(len(sets)) if probes is None else probes:
            for j in range(len(sets)):
                sizes = len(sets[i]) + len(sets[j])
                if component[i] != component[j] and min(len(sets[i]), len(sets[j])) * (num + den) >= num * sizes:
                    if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) * (num + den) >= num * sizes:
                        component[component == component[j]] = component[i]
        return component
    tree = PrefixTree(sets)
    order = np.array(tree.order)
    row_of = np.argsort(order)
    labels = component[order]
    for i in range(len(sets)) if probes is None else probes:
        if (labels == labels[0]).all():
            break
        row = int(row_of[i])
        for other in tree.similar(row, num, den, labels).tolist():
            if labels[other] != labels[row]:
                labels[labels == labels[other]] = labels[row]
    component[order] = labels
    return component
