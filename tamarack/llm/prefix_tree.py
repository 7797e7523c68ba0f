"""A prefix tree of ordered token sets, and the traversal that finds the similar ones. Runs inside one task, on numpy arrays.

Sets are written as sequences in one order for all, the most frequent token first, so that alike sets share their path
from the root. Chains of the tree are one edge. A set that asks walks down from the root with its overlap so far, which
all sets below a node share. A subtree is left as soon as the tokens that remain, of the asking set or of the longest set
below, cannot bring the overlap to what its smallest set needs, or when it holds nothing but the asker's component.
"""

from __future__ import annotations

import numpy as np

# Asking sets that walk together, cells of their membership table, and tokens looked up at once: bounds on memory.
TOGETHER = 64
CELLS = 8_000_000
LOOKUPS = 4_000_000


class PrefixTree:
    """The tree over rows of sequences (``values`` parted at ``offsets``), whose sets have ``sizes`` tokens in all."""

    def __init__(self, rows: np.ndarray, values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray):
        keys = {r: values[offsets[r]:offsets[r + 1]].astype(">u4").tobytes() for r in rows.tolist()}
        self.rows = np.array(sorted(keys, key=lambda r: (keys[r], sizes[r])), np.int64)
        seqs = [values[offsets[r]:offsets[r + 1]] for r in self.rows]
        lengths = [len(s) for s in seqs]
        n_sets = len(seqs)
        shared = [0] * (n_sets + 1)  # tokens that a sequence shares with the one before
        for i in range(1, n_sets):
            k = min(lengths[i - 1], lengths[i])
            differs = np.flatnonzero(seqs[i - 1][:k] != seqs[i][:k])
            shared[i] = int(differs[0]) if len(differs) else k
        own_sizes = sizes[self.rows].tolist()
        # nodes: range of sets below, depth of the lower end of the edge, parent, smallest size and longest sequence below
        low, high, bottom, parent, least, longest = [], [], [], [], [], []

        def node(lo: int, hi: int, depth: int) -> int:
            low.append(lo), high.append(hi), bottom.append(depth), parent.append(-1), least.append(1 << 62), longest.append(0)
            return len(low) - 1

        def hang(child: int, over: int) -> None:
            parent[child] = over
            least[over], longest[over] = min(least[over], least[child]), max(longest[over], longest[child])

        open_nodes = [node(0, n_sets, 0)]
        leaves = []
        for i in range(n_sets):
            onward = shared[i + 1]
            if onward > bottom[open_nodes[-1]]:
                open_nodes.append(node(i, i, onward))
            leaf = node(i, i + 1, lengths[i])
            least[leaf], longest[leaf] = own_sizes[i], lengths[i]
            leaves.append(leaf)
            hang(leaf, open_nodes[-1])
            while bottom[open_nodes[-1]] > onward:  # the next set leaves these chains
                child = open_nodes.pop()
                high[child] = i + 1
                if bottom[open_nodes[-1]] < onward:
                    open_nodes.append(node(low[child], low[child], onward))
                hang(child, open_nodes[-1])
        self.low, self.high, self.bottom = np.array(low), np.array(high), np.array(bottom)
        self.parent, self.least, self.longest = np.array(parent), np.array(least), np.array(longest)
        self.start = np.where(self.parent < 0, 0, self.bottom[self.parent])
        self.is_leaf = np.zeros(len(low), bool)
        self.is_leaf[leaves] = True
        inner = np.argsort(self.parent, kind="stable")
        self.children = inner
        self.first_child = np.searchsorted(self.parent[inner], np.arange(len(low)), "left")
        self.n_children = np.searchsorted(self.parent[inner], np.arange(len(low)), "right") - self.first_child
        # the tokens of an edge stand in the sequence of the first set below it
        self.values = values
        self.edge = offsets[self.rows[self.low]] + self.start if n_sets else np.zeros(len(low), np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): owners 0 0 2 2 2 and places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of linked sets of a and b tokens."""
    return -(-(percent * (a + b)) // (100 + percent))


def tree_links(node: np.ndarray, size: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, at: np.ndarray,
               asks: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets whose Jaccard similarity reaches ``percent``, as many as join all components that links join.

    Set i is ``tokens[offsets[i]:offsets[i + 1]]``, distinct, of ``size[i]`` tokens in all; those left out are in no
    other set. ``at`` names the components known so far. If ``asks`` is given, the sets that it marks are compared
    with the others only, else all sets with each other.
    """
    owner = np.repeat(np.arange(len(node)), np.diff(offsets))
    distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    order = np.lexsort((distinct, -counts))
    rank[order] = np.arange(len(order))
    held = counts[inverse] > 1
    owner, ranks = owner[held], rank[inverse[held]]
    inside = np.lexsort((ranks, owner))
    owner, ranks = owner[inside], ranks[inside]
    offsets = np.searchsorted(owner, np.arange(len(node) + 1))
    width = int((counts > 1).sum())

    labels = np.unique(at, return_inverse=True)[1]
    every = np.arange(len(node))
    tree = PrefixTree(every if asks is None else every[~asks], ranks, offsets, size)
    place = np.full(len(node), -1)
    if asks is None:
        place[tree.rows] = np.arange(len(node))
    askers = tree.rows if asks is None else every[asks]
    if not len(tree.rows) or not len(askers):
        return []
    links: list[tuple[int, int]] = []
    step = max(1, min(TOGETHER, CELLS // max(1, width)))
    for begin in range(0, len(askers), step):
        batch = askers[begin:begin + step]
        below = labels[tree.rows]
        changes = np.concatenate([[0], np.cumsum(below[1:] != below[:-1])])
        uniform = changes[tree.high - 1] == changes[tree.low]
        single = np.where(uniform, below[tree.low], -1)
        member = np.zeros((len(batch), width), bool)
        lengths = offsets[batch + 1] - offsets[batch]
        who, along = _spread(lengths)
        sequence = ranks[offsets[batch][who] + along]
        member[who, sequence] = True
        keys, starts = who * width + sequence, np.cumsum(lengths) - lengths
        walkers = np.arange(len(batch))
        p, v = walkers, np.zeros(len(batch), np.int64)
        overlap, rest = np.zeros(len(batch), np.int64), lengths
        found_p, found_row = [], []
        while len(p):
            # the children of the nodes reached
            owner_at, k = _spread(tree.n_children[v])
            p, overlap, rest, v = p[owner_at], overlap[owner_at], rest[owner_at], tree.children[tree.first_child[v][owner_at] + k]
            need = _needed(size[batch[p]], tree.least[v], percent)
            go = (single[v] != labels[batch[p]]) & (tree.high[v] > place[batch[p]] + 1)
            go &= overlap + np.minimum(rest, tree.longest[v] - tree.start[v]) >= need
            p, v, overlap, rest, need = p[go], v[go], overlap[go], rest[go], need[go]
            length = tree.bottom[v] - tree.start[v]
            common = np.zeros(len(p), np.int64)
            parts = np.concatenate([[0], np.cumsum(length)])
            first = 0
            while first < len(p):  # as many edges at once as the bound allows, one at least
                last = max(first + 1, int(np.searchsorted(parts, parts[first] + LOOKUPS, "right")) - 1)
                own, along = _spread(length[first:last])
                hits = member[p[first:last][own], tree.values[tree.edge[v[first:last]][own] + along]]
                total = np.concatenate([[0], np.cumsum(hits)])
                ends = parts[first:last + 1] - parts[first]
                common[first:last] = total[ends[1:]] - total[ends[:-1]]
                first = last
            overlap = overlap + common
            some = length > 0
            tail = tree.values[np.where(some, tree.edge[v] + length - 1, 0)] if len(p) else np.zeros(0, np.int64)
            passed = np.searchsorted(keys, p * width + tail, "right") - starts[p]
            rest = np.where(some, lengths[p] - passed, rest)
            go = overlap + np.minimum(rest, tree.longest[v] - tree.bottom[v]) >= need
            leaf = tree.is_leaf[v]
            done = go & leaf
            found_p.append(p[done])
            found_row.append(tree.rows[tree.low[v[done]]])
            go &= ~leaf
            p, v, overlap, rest = p[go], v[go], overlap[go], rest[go]
        left, right = batch[np.concatenate(found_p)], np.concatenate(found_row)
        labels = _united(labels, left, right, node, links)
    return links


def _united(labels: np.ndarray, left: np.ndarray, right: np.ndarray, node: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Labels after joining the components of each pair; a link is noted for each union that joins two."""
    pairs = np.stack([labels[left], labels[right]], axis=1)
    _, once = np.unique(pairs, axis=0, return_index=True)
    if not len(once):
        return labels
    root = np.arange(int(labels.max()) + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in once.tolist():
        a, b = find(int(pairs[i, 0])), find(int(pairs[i, 1]))
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(node[left[i]]), int(node[right[i]])))
    while True:
        up = root[root]
        if (up == root).all():
            return up[labels]
        root = up
