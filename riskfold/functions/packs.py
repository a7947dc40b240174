"""Bin codes of several features in one small number.

A feature takes only some bins (one more than it has distinct cuts), and of
the dummies of one categorical column at most one differs from the bin of
zero in a row.  A column is a feature's place among its bins, or, for such
dummies, the one that differs and its bin; columns are multiplied together
while their product stays below ``PACK``.  A histogram is then counted by the
packed code, once a pack instead of once a feature, and taken apart by sums of
its cells: sums of whole numbers, so nothing is lost or approximated.
"""

from __future__ import annotations

import numpy as np

#: Codes of one pack.
PACK = 4096


def bin_codes(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin index = number of cuts strictly below the value."""
    return np.searchsorted(cuts, x, side="left")


def leaf_bits(tree: tuple, bins: int) -> tuple:
    """A tree's arrays as (values of its leaves from left to right, features
    tested, bits (features, bins)).  The leaves are the bits of a number: a
    test that sends a row to the right clears the leaves on its left, so the
    row's leaf is the lowest bit that none of its features clears.  A tree of
    more than 64 leaves stays as it is."""
    feat, thr, left, right, value = (a.tolist() for a in tree)
    leaves, below, open_ = [], {}, [(0, False)]
    while open_:
        node, passed = open_.pop()
        if feat[node] < 0:
            leaves.append(value[node])
        elif passed:   # its left side is done
            below[node] = (below[node], len(leaves))
        else:
            below[node] = len(leaves)
            open_ += [(right[node], False), (node, True), (left[node], False)]
    if len(leaves) > 64:
        return tree
    kind = np.uint32 if len(leaves) <= 32 else np.uint64
    every = int(np.iinfo(kind).max)
    features = sorted({feat[node] for node in below})
    bits = np.full((len(features), bins), every, kind)
    for node, (first, last) in below.items():
        bits[features.index(feat[node]), thr[node] + 1:] &= kind(every ^ ((1 << last) - (1 << first)))
    return np.array(leaves), features, bits


class Packs:
    """Layout of one group's packs; ``blocks`` are the features of which at
    most one is not zero in a row."""

    def __init__(self, cuts: np.ndarray, bins: int, blocks=(), most: int = PACK) -> None:
        self.cuts, self.bins, self.p = cuts, bins, len(cuts)
        self.spots = [np.unique(np.append(0, np.searchsorted(c, c, side="right"))) for c in cuts]   # bins that can occur
        self.zero = np.array([bin_codes(np.zeros(1), c)[0] for c in cuts], dtype=np.int64)
        inside = {j for block in blocks for j in block}
        self.columns = [list(block) for block in blocks if len(block)] + [[j] for j in range(self.p) if j not in inside]
        self.start: dict[int, int] = {}   # a dummy's first code in its column
        sizes = []
        for column in self.columns:
            size = len(self.spots[column[0]])
            if len(column) > 1:
                size = 1
                for j in column:
                    self.start[j] = size
                    size += len(self.others(j))
            sizes.append(size)
        self.sizes, self.members, self.place = [], [], {}
        for c in sorted(range(len(sizes)), key=lambda c: (-sizes[c], c)):   # first fit, widest first
            k = next((k for k, size in enumerate(self.sizes) if size * sizes[c] <= most), len(self.sizes))
            if k == len(self.sizes):
                self.sizes.append(1)
                self.members.append([])
            self.members[k].append((c, self.sizes[k], sizes[c]))
            for j in self.columns[c]:
                self.place[j] = (k, c, self.sizes[k], sizes[c])
            self.sizes[k] *= sizes[c]
        self.kind = np.uint16 if max(self.sizes, default=1) <= 1 << 16 else np.uint32
        self._tables: dict[int, np.ndarray] = {}
        self._apart = [[(stride, size, *self._cells(self.columns[c])) for c, stride, size in members] for members in self.members]

    def others(self, j: int) -> np.ndarray:
        return self.spots[j][self.spots[j] != self.zero[j]]

    def _cells(self, column: list) -> tuple:
        """Where a column's codes lie in (features x bins): places of the
        codes; for a block the places of the bins of zero and each feature's
        first and last code."""
        if len(column) == 1:
            return column[0] * self.bins + self.spots[column[0]], None, None, None
        first = np.array([self.start[j] for j in column])
        return (np.concatenate([j * self.bins + self.others(j) for j in column]), np.array(column) * self.bins + self.zero[column],
                first, first + [len(self.others(j)) for j in column])

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(packs, rows) codes of a (rows, features) block."""
        out = np.zeros((len(self.sizes), len(x)), dtype=np.int64)
        for k, members in enumerate(self.members):
            for c, stride, _ in members:
                column = self.columns[c]
                if len(column) == 1:
                    own = np.searchsorted(self.spots[column[0]], bin_codes(x[:, column[0]], self.cuts[column[0]]))
                else:
                    own = np.zeros(len(x), dtype=np.int64)
                    for j in column:
                        bins = bin_codes(x[:, j], self.cuts[j])
                        at = np.flatnonzero(bins != self.zero[j])
                        if own[at].any():
                            raise ValueError("features of one block differ from zero in the same row")
                        own[at] = self.start[j] + np.searchsorted(self.others(j), bins[at])
                out[k] += own * stride
        return out.astype(self.kind)

    def table(self, j: int) -> np.ndarray:
        """The bin of feature ``j`` by its pack's code."""
        if j not in self._tables:
            if len(self._tables) > 256:
                self._tables.clear()
            k, c, stride, size = self.place[j]
            if len(self.columns[c]) == 1:
                own = self.spots[j]
            else:
                own = np.full(size, self.zero[j])
                own[self.start[j]:self.start[j] + len(self.others(j))] = self.others(j)
            self._tables[j] = own[(np.arange(self.sizes[k]) // stride) % size].astype(np.uint8)
        return self._tables[j]

    def left(self, codes: np.ndarray, j: int, b: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Whether the rows' bin of feature ``j`` is at most ``b``."""
        own = codes[self.place[j][0]]
        return (self.table(j) <= b)[own if rows is None else own[rows]]

    def value(self, codes: np.ndarray, one: tuple) -> np.ndarray:
        """What a stump (feature, bin, left sign, weight) or the arrays of a tree give each row."""
        if len(one) == 4:
            j, b, sign, weight = one
            return (weight * np.where(self.table(j) <= b, sign, -sign))[codes[self.place[j][0]]]
        out = np.empty(codes.shape[1])
        for node, rows in self.nodes(codes, one):
            out[rows] = one[4][node]
        return out

    def nodes(self, codes: np.ndarray, tree: tuple, depth: int | None = None) -> list:
        """[(node, its rows)]: leaves, or nodes at ``depth``."""
        feat, thr, left, right = tree[:4]
        out, open_ = [], [(0, np.arange(codes.shape[1], dtype=np.int32), 0)]
        while open_:
            node, rows, level = open_.pop()
            if feat[node] < 0 or level == depth:
                out.append((node, rows))
                continue
            go = self.left(codes, feat[node], thr[node], rows)
            open_ += [(left[node], rows[go], level + 1), (right[node], rows[~go], level + 1)]
        return out

    def margin(self, codes: np.ndarray, trees: list) -> np.ndarray:
        """What the trees (``leaf_bits``, or arrays) give each row, added in their order."""
        out = np.zeros(codes.shape[1])
        for tree in trees:
            if len(tree) == 5:
                out += self.value(codes, tree)
                continue
            leaves, features, bits = tree
            tables: dict[int, np.ndarray] = {}
            for j, own in zip(features, bits):
                k, table = self.place[j][0], own[self.table(j)]
                tables[k] = tables[k] & table if k in tables else table
            open_ = None
            for k, table in tables.items():
                part = table[codes[k]]
                open_ = part if open_ is None else open_ & part
            out += leaves[0] if open_ is None else leaves[np.bitwise_count(~open_ & (open_ - open_.dtype.type(1)))]
        return out

    def count(self, k: int, code: np.ndarray, weights: tuple, slots: int = 1) -> np.ndarray:
        """(weights, slots, codes) sums of pack ``k``; a weight of None counts
        the rows.  ``code`` already holds slot x size + code."""
        size = slots * self.sizes[k]
        code = code.astype(np.intp)
        return np.array([np.bincount(code, w, size) for w in weights]).reshape(len(weights), slots, self.sizes[k])

    def apart(self, sums: list) -> np.ndarray:
        """(..., features, bins) whole numbers from the packs' sums (..., codes)."""
        shape = sums[0].shape[:-1]
        out = np.zeros((int(np.prod(shape, dtype=np.int64)), self.p * self.bins), dtype=np.int64)
        for k in range(len(self.sizes)):
            flat = sums[k].reshape(len(out), -1)
            for stride, size, cells, base, first, last in self._apart[k]:
                own = flat.reshape(len(out), -1, size, stride).sum(axis=(1, 3))
                if base is None:
                    out[:, cells] = own
                    continue
                run = np.concatenate([np.zeros((len(out), 1)), own.cumsum(axis=1)], axis=1)   # run[i]: codes below i
                out[:, cells] = own[:, 1:]
                out[:, base] = run[:, -1:] - (run[:, last] - run[:, first])
        return out.reshape(*shape, self.p, self.bins)
