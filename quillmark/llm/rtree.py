"""A count-vector R-tree for overlap joins of sets.

A set's tokens are hashed into groups and the group counts are its point.  The overlap of two sets is at most the sum of
the coordinate minima of their points, and that of any sets below two nodes at most the sum of the minima of the nodes'
upper corners.  A search walks down from the top with one set's point; the self-join walks pairs of nodes from the top and drops a pair if its bound, or the sizes, rule out
``100 * overlap >= 75 * union``, or if all that is below both has one label.
"""

from __future__ import annotations

import numpy as np
import zstandard

FAN = 16
#: Pairs times coordinates of which minima are summed at once.
BLOCK = 1 << 21


def groups_of(n: int) -> int:
    """Number of groups for a set of ``n`` tokens: the power of two from 2n on, 16 to 8192.  Counts are then mostly 0 and 1, and
    the summed minima exceed the true overlap by a few hundredths."""
    return min(8192, max(16, 1 << (2 * n - 1).bit_length())) if n else 16


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def point(tokens: np.ndarray) -> bytes:
    """The counts of the hashed tokens by group, compressed; a leading byte states the width of a count."""
    counts = np.bincount((tokens & np.uint64(groups_of(len(tokens)) - 1)).astype(np.int64), minlength=groups_of(len(tokens)))
    wide = int(counts.max(initial=0)) > 255
    return (b"\2" if wide else b"\1") + _PACK.compress(counts.astype("<u4" if wide else np.uint8).tobytes())


def counts_of(data: bytes) -> np.ndarray:
    counts = np.frombuffer(_UNPACK.decompress(data[1:]), "<u4" if data[0] == 2 else np.uint8)
    return counts.astype(np.uint32 if data[0] == 2 else np.uint16)


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups (groups are the hash's low bits, so halves add up)."""
    return counts.reshape(-1, groups).sum(0) if len(counts) > groups else counts


def _reach(small: np.ndarray, total: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether an overlap of ``bound`` could link: overlap >= 75/175 of the sizes' sum, and at most the smaller size."""
    return 175 * np.minimum(bound, small) >= 75 * total


def minima(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of rows i and j of x."""
    out = np.empty(len(i), np.int64)
    step = max(1, BLOCK // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.minimum(x[i[k : k + step]], x[j[k : k + step]]).sum(1, dtype=np.int64)
    return out


class Level:
    def __init__(self, corner: np.ndarray, least: np.ndarray, most: np.ndarray, label: np.ndarray):
        self.corner, self.least, self.most, self.label = corner, least, most, label

    def above(self) -> Level:
        cuts = np.arange(0, len(self.least), FAN)
        low, high = np.minimum.reduceat(self.label, cuts), np.maximum.reduceat(self.label, cuts)
        one = np.where(low == high, low, -1)
        return Level(np.maximum.reduceat(self.corner, cuts, axis=0), np.minimum.reduceat(self.least, cuts), np.maximum.reduceat(self.most, cuts), one)

    def open(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs can hold a link between different labels."""
        keep = (100 * self.most[i] >= 75 * self.least[j]) & (100 * self.most[j] >= 75 * self.least[i]) & ((self.label[i] != self.label[j]) | (self.label[i] < 0))
        at = np.flatnonzero(keep)
        keep[at] = _reach(np.minimum(self.most[i[at]], self.most[j[at]]), self.least[i[at]] + self.least[j[at]], minima(self.corner, i[at], j[at]))
        return keep


def _levels(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> list[Level]:
    """The tree over packed points, leaves first."""
    levels = [Level(x, sizes, sizes, labels)]
    while len(levels[-1].least) > FAN:
        levels.append(levels[-1].above())
    return levels


def search(points: list[np.ndarray], sizes: np.ndarray, point: np.ndarray, size: int) -> np.ndarray:
    """Indices of the points whose bound with a query's ``point`` admits a link: from the top, nodes whose corner or sizes rule
    one out are skipped.  Points of each number of groups make one tree, folded to the query's number or the query to theirs."""
    fit = (100 * np.minimum(sizes, size) >= 75 * np.maximum(sizes, size)).nonzero()[0]
    wide = np.array([len(points[k]) for k in fit], int)
    found = []
    for groups in np.unique(wide):
        own, common = fit[wide == groups], min(int(groups), len(point))
        if len(own) > FAN:
            own = own[np.argsort(sizes[own], kind="stable")]
        levels = _levels(np.stack([fold(points[k], common) for k in own]), sizes[own], np.zeros(len(own), int))
        asked, at = fold(point, common), np.arange(len(levels[-1].least))
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            some = (100 * level.most[at] >= 75 * size) & (100 * size >= 75 * level.least[at])
            at = at[some]
            bound = np.minimum(level.corner[at], asked).sum(1, dtype=np.int64)
            at = at[_reach(np.minimum(level.most[at], size), level.least[at] + size, bound)]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(levels[depth - 1].least)]
        found.append(own[at])
    return np.sort(np.concatenate(found)) if found else np.empty(0, int)


def join(points: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) whose bound admits a link and whose labels (0 or more) differ; with ``best`` only the pair of the
    greatest bound (relative to the sizes) of any two labels.

    Points have groups by ``groups_of``; linked sets' sizes differ by a third at most, so for each number of groups the
    points of it and of the next number, folded, make one tree.
    """
    wide = np.array([len(p) for p in points])
    found = []
    for groups in np.unique(wide):
        own = np.flatnonzero((wide == groups) | (wide == 2 * groups))
        if len(own) < 2:
            continue
        x = np.stack([fold(points[k], groups) for k in own])
        # packing: by size class, then label, then the heaviest group, so that near points share nodes
        order = np.lexsort((x.argmax(1), labels[own], np.log2(sizes[own]).round(1)))
        own, x = own[order], x[order]
        levels = _levels(x, sizes[own], labels[own])
        i, j = np.triu_indices(len(levels[-1].least), 0 if len(levels) > 1 else 1)
        keep = levels[-1].open(i, j)
        i, j = i[keep], j[keep]
        for level in levels[-2::-1]:
            parts = []
            for k in range(0, len(i), 4096):
                a = (i[k : k + 4096, None] * FAN + np.arange(FAN))[:, :, None] + np.zeros((1, 1, FAN), int)
                b = (j[k : k + 4096, None] * FAN + np.arange(FAN))[:, None, :] + np.zeros((1, FAN, 1), int)
                a, b = a.ravel(), b.ravel()
                fit = (a < len(level.least)) & (b < len(level.least)) & ((a < b) | (a == b) & (level is not levels[0]))
                a, b = a[fit], b[fit]
                keep = level.open(a, b)
                parts.append((a[keep], b[keep]))
            i, j = (np.concatenate([p[s] for p in parts]) if parts else np.empty(0, int) for s in (0, 1))
        fine = (wide[own[i]] == groups) | (wide[own[j]] == groups)
        i, j = i[fine], j[fine]
        if best and len(i) > 1:
            a, b = labels[own[i]], labels[own[j]]
            pair = np.minimum(a, b) * (labels.max() + 1) + np.maximum(a, b)
            share = minima(x, i, j) / (sizes[own[i]] + sizes[own[j]])
            order = np.lexsort((-share, pair))
            first = order[np.flatnonzero(np.diff(pair[order], prepend=-1))]
            i, j = i[first], j[first]
        found.append((own[i], own[j]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
