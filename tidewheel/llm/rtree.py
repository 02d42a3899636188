"""An R-tree over count vectors, for overlap search between sets.

A set's tokens are hashed into groups; the counts of the groups are its point. Two sets can share at most
the sum of their coordinate minima, and a set and anything below a node at most the sum of the minima
with the node's upper corner. Nodes whose bound is under what the similarity asks are left out.
"""

from __future__ import annotations

import numpy as np

DIMENSIONS = 64
FANOUT = 16


def point(tokens: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.bincount((tokens >> np.uint64(17)).astype(np.int64) % dimensions, minlength=dimensions).astype(np.int32)


def packed(tokens: np.ndarray) -> bytes:
    """A finer point with about a group for each token: a byte for the width of a count, then the counts.

    The number of groups is a power of two, so points of sets of other sizes fold to the same groups.
    """
    dimensions = max(DIMENSIONS, 1 << max(0, len(tokens) - 1).bit_length())
    counts = point(tokens, dimensions)
    width = 1 if counts.max(initial=0) < 256 else 4
    return bytes([width]) + counts.astype(np.uint8 if width == 1 else np.int32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else np.int32, offset=1).astype(np.int32)


def folded(counts: np.ndarray, dimensions: int) -> np.ndarray:
    """The point over fewer groups, a power of two of them as well."""
    return counts.reshape(-1, dimensions).sum(0, dtype=np.int32)


def overlap_needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two sets with ``sizes`` tokens together: 100 i >= percent (sizes - i)."""
    return -(-sizes * percent // (100 + percent))


class CountRTree:
    """Bulk-loaded: points sorted by size, then by their heaviest varying coordinates, packed in runs."""

    def __init__(self, points: np.ndarray):
        size = points.sum(1)
        spread = np.argsort(-points.var(0)) if len(points) else np.arange(points.shape[1])
        tile = size // np.maximum(1, size // 16 + 1)
        self.order = np.lexsort([points[:, spread[1]], points[:, spread[0]], tile]) if len(points) else np.arange(0)
        self.points = points[self.order]
        upper, least = [self.points], [self.points.sum(1)]
        while len(upper[-1]) > 1:
            cut = np.arange(0, len(upper[-1]), FANOUT)
            upper.append(np.maximum.reduceat(upper[-1], cut, 0))
            least.append(np.minimum.reduceat(least[-1], cut))
        self.upper, self.least = upper, least

    def search(self, queries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) that the bounds allow."""
        if not len(self.points) or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = queries.sum(1)
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        for level in range(len(self.upper) - 1, -1, -1):
            if level < len(self.upper) - 1:  # down to the children
                children = np.minimum(FANOUT, len(self.upper[level]) - node * FANOUT)
                q = np.repeat(q, children)
                first = np.repeat(node * FANOUT - np.concatenate([[0], np.cumsum(children)[:-1]]), children)
                node = first + np.arange(len(q))
            keep = np.zeros(len(q), bool)
            for a in range(0, len(q), 1 << 15):
                s = slice(a, a + (1 << 15))
                shared = np.minimum(queries[q[s]], self.upper[level][node[s]]).sum(1)
                keep[s] = shared >= overlap_needed(size[q[s]] + self.least[level][node[s]], percent)
            q, node = q[keep], node[keep]
        return q, self.order[node]
