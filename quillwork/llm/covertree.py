"""Cover trees over the rows of a matrix, flattened, and the dual-tree search for largest inner products.

A node covers a run of rows (in the tree's own order) around its first row. Its children lie at half
its scale: greedily, a row farther than that from all earlier children starts the next one. Children
of few rows, which far-apart rows would give, are gathered into leaves around the parent's centre.
"""

from __future__ import annotations

import numpy as np

LEAF = 48


class CoverTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        n = len(points)
        order = np.arange(n)
        center, radius, low, high, kids = [], [], [], [], []
        todo = [(0, n, 0, None)]  # rows, the row that is the centre, parent
        while todo:
            a, b, c, parent = todo.pop()
            gaps = np.sqrt(((points[order[a:b]] - points[c]) ** 2).sum(axis=1))
            node = len(center)
            center.append(c)
            radius.append(float(gaps.max()) * (1 + 1e-12))
            low.append(a)
            high.append(b)
            kids.append([])
            if parent is not None:
                kids[parent].append(node)
            if b - a <= leaf or radius[node] == 0:
                continue
            half = 2.0 ** (np.ceil(np.log2(radius[node])) - 1)
            rest, groups, near = order[a:b], [], gaps <= half
            first = c
            while True:
                groups.append((first, rest[near]))
                rest = rest[~near]
                if not len(rest):
                    break
                first = rest[0]
                near = ((points[rest] - points[first]) ** 2).sum(axis=1) <= half * half
            large = [g for g in groups if len(g[1]) > leaf // 4]
            small = np.concatenate([g[1] for g in groups if len(g[1]) <= leaf // 4] or [np.empty(0, dtype=np.int64)])
            parts = large + [(c, small[i : i + leaf]) for i in range(0, len(small), leaf)]
            if len(parts) == 1:  # all rows are near one another: the run is cut in two
                rows = parts[0][1]
                parts = [(rows[0], rows[: len(rows) // 2]), (rows[len(rows) // 2], rows[len(rows) // 2 :])]
            at = a
            for first, rows in parts:
                order[at : at + len(rows)] = rows
                todo.append((at, at + len(rows), first, node))
                at += len(rows)
        self.points, self.ids = points[order], ids[order]
        self.centers = points[np.array(center)]
        self.radius, self.low, self.high, self.kids = np.array(radius), low, high, [np.array(k, dtype=np.int64) for k in kids]
        self.length = np.sqrt((self.centers**2).sum(axis=1))
        self.largest = float(np.abs(points).max(initial=0.0))


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly; as whole numbers of any size where doubles would round."""
    if largest * a.shape[1] < 2.0**52:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(a) @ whole(b).T


class Best:
    """The k best (score, id) of each query row: larger scores first, ties to the smaller id."""

    def __init__(self, rows: int, k: int, worst: np.ndarray | None = None):
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(rows)]
        #: a score below this cannot enter
        self.worst = np.full(rows, -np.inf) if worst is None else worst.astype(np.float64).copy()

    def offer(self, row: int, scores, ids) -> None:
        merged = sorted({*self.found[row], *((-s, i) for s, i in zip(scores, ids))})[: self.k]
        self.found[row] = merged
        if len(merged) == self.k:
            self.worst[row] = max(self.worst[row], float(-merged[-1][0]))


def search(queries: CoverTree, data: CoverTree, k: int, worst: np.ndarray | None = None) -> Best:
    """Best k inner products of each query row with data rows of another id.

    ``worst`` gives for each query row (in the tree's order) a score that k other rows already reach. A
    pair of nodes is left out when even its centres' product, widened by both radii, stays below the
    worst kth score of all queries in the node; half a unit absorbs rounding, as scores are whole.
    """
    best = Best(len(queries.ids), k, worst)
    largest = queries.largest * data.largest
    exact = largest * queries.points.shape[1] < 2.0**52

    def bounds(q: int, rs: np.ndarray) -> np.ndarray:
        inner = data.centers[rs] @ queries.centers[q]
        return inner + queries.radius[q] * data.length[rs] + data.radius[rs] * queries.length[q] + queries.radius[q] * data.radius[rs]

    todo = [(0, 0, float(bounds(0, np.array([0]))[0]))]
    while todo:
        q, r, bound = todo.pop()
        a, b = queries.low[q], queries.high[q]
        if exact and bound < best.worst[a:b].min() - 0.5:
            continue
        if not len(queries.kids[q]) and not len(data.kids[r]):
            c, d = data.low[r], data.high[r]
            scores = products(queries.points[a:b], data.points[c:d], largest)
            enter = (scores >= best.worst[a:b, None]) & (queries.ids[a:b, None] != data.ids[None, c:d])
            for row in np.flatnonzero(enter.any(axis=1)).tolist():
                hit = np.flatnonzero(enter[row])
                if len(hit) > 4 * k:  # the kth score of this run is enough to leave most out
                    part = np.sort(scores[row, hit])[-k]
                    hit = hit[scores[row, hit] >= part]
                best.offer(a + row, [int(s) for s in scores[row, hit]], data.ids[c + hit].tolist())
            continue
        if len(queries.kids[q]) and (not len(data.kids[r]) or queries.radius[q] >= data.radius[r]):
            one = np.array([r])
            pairs = [(int(x), r, float(bounds(int(x), one)[0])) for x in queries.kids[q]]
        else:
            pairs = [(q, int(x), float(u)) for x, u in zip(data.kids[r], bounds(q, data.kids[r]))]
        todo += sorted(pairs, key=lambda p: p[2])  # the most promising is taken next
    return best
