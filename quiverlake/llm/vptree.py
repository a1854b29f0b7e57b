"""Vantage-point trees: one that routes vectors to shards, and one in each shard that answers queries.

A node splits its rows at the median distance from a vantage point. A query with the best distance ``t``
so far needs a side only if its own distance from the vantage point lies within ``t`` of the side's range
(triangle inequality). Pruning is relaxed by a factor: a side is kept within ``relax * t``. Factor 1 is
exact. Below 1 it loses a neighbour only if the difference of two distances to a vantage point, which is
at most the distance of the two vectors, comes to more than ``relax`` times it; in many dimensions such
differences are mostly a small part of the distance.
"""

from __future__ import annotations

import numpy as np

from quiverlake.functions.vectors import squared_distances

ROUND = 1e-9  # relative; distances from matrix products are this exact at least, in double precision


def principal_axis(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The direction in which the rows spread most, by power iteration."""
    c = x - x.mean(0)
    axis = c[np.argmax(np.einsum("ij,ij->i", c, c))]
    for _ in range(rounds):
        axis = (c @ axis) @ c
        length = np.linalg.norm(axis)
        if length == 0:
            return np.eye(x.shape[1])[0]
        axis = axis / length
    return axis


def pick_vantage(x: np.ndarray, rng: np.random.Generator, tries: int = 6, against: int = 256) -> np.ndarray:
    """Of a few rows and a far point on the rows' principal axis the one whose distances to other rows spread most.

    In many dimensions the distances from a row are nearly equal, so a border between them is near to most
    queries; from far along the widest direction they spread more, and the triangle inequality prunes more.
    """
    others = x[rng.choice(len(x), min(against, len(x)), replace=False)]
    centre = others.mean(0)
    reach = 16 * np.sqrt(squared_distances(centre[None], others).max())
    some = np.concatenate([x[rng.choice(len(x), min(tries, len(x)), replace=False)], (centre + reach * principal_axis(others))[None]])
    return some[np.argmax(np.sqrt(squared_distances(some, others)).std(1))]


class Router:
    """The top of the tree, fitted on a bounded sample; its leaves are the shards. A few kilobytes a shard."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage point, median, inner, outer) or (shard,)
        self.weights: list[int] = []  # sample rows by shard
        sample = sample.astype(np.float64)

        def build(x: np.ndarray, n: int) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            if n > 1 and len(x) >= 4:
                vp = pick_vantage(x, rng)
                d = np.sqrt(squared_distances(vp[None], x))[0]
                cut = float(np.quantile(d, (n // 2) / n))
                inner = d <= cut
                if 0 < inner.sum() < len(x):
                    self.nodes[at] = (vp, cut, build(x[inner], n // 2), build(x[~inner], n - n // 2))
                    return at
            self.nodes[at] = (len(self.weights),)
            self.weights.append(len(x))
            return at

        build(sample if len(sample) else np.zeros((1, 1)), max(1, shards))

    @property
    def shards(self) -> int:
        return len(self.weights)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The shard of each row."""
        out = np.zeros(len(x), np.int32)
        rows, shards = self.route(x, np.zeros(len(x)))
        out[rows] = shards
        return out

    def route(self, x: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) pairs: each row's own shard, and those within ``width`` of it along the tree."""
        rows, shards = [], []
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, active = stack.pop()
            if not len(active):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                rows.append(active)
                shards.append(np.full(len(active), node[0], np.int32))
                continue
            vp, cut, inner, outer = node
            d = np.sqrt(squared_distances(x[active], vp[None]))[:, 0]
            w = width[active] + np.where(width[active] > 0, ROUND * (1 + d), 0.0)
            stack.append((inner, active[(d <= cut) | (d - w <= cut)]))
            stack.append((outer, active[(d > cut) | (d + w > cut)]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(rows), np.concatenate(shards)


class VpTree:
    """The tree of one shard over rows ``x`` with ids; answers many queries at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 128, seed: int = 0):
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64, copy=False)
        self.nodes: list[tuple] = []  # (vantage point, cut, inner, its range, outer, its range) or (begin, end)
        order: list[np.ndarray] = []
        filled = 0

        def build(rows: np.ndarray) -> int:
            nonlocal filled
            at = len(self.nodes)
            self.nodes.append(())
            if len(rows) > leaf:
                part = x[rows]
                vp = pick_vantage(part, rng)
                d = np.sqrt(squared_distances(vp[None], part))[0]
                cut = float(np.median(d))
                inner = d <= cut
                if 0 < inner.sum() < len(rows):
                    di, do = d[inner], d[~inner]
                    a, b = build(rows[inner]), build(rows[~inner])
                    self.nodes[at] = (vp, cut, a, (di.min(), di.max()), b, (do.min(), do.max()))
                    return at
            order.append(rows)
            self.nodes[at] = (filled, filled + len(rows))
            filled += len(rows)
            return at

        if len(x):
            build(np.arange(len(x)))
        rows = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.x, self.ids = np.ascontiguousarray(x[rows]), ids[rows]
        self.centre = self.x.mean(0) if len(x) else 0.0
        self.near = self.x - self.centre  # centred, so that rounding goes by the spread and not by the offset
        self.norms = np.einsum("ij,ij->i", self.near, self.near)
        inner = [i for i, node in enumerate(self.nodes) if len(node) > 2]
        self.vantage = np.stack([self.nodes[i][0] for i in inner]) if inner else np.zeros((0, x.shape[1]))
        self.place = {i: j for j, i in enumerate(inner)}

    def knn(self, q: np.ndarray, q_ids: np.ndarray, k: int, relax: float, bound: np.ndarray, shrink: bool = True, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, squared distance) of the at most ``k`` nearest rows within each query's ``bound`` (a squared distance, inclusive); never the query's own id; ties by the smaller id. Pruning goes by the best so far, or with ``shrink`` false by the bound alone, which loses less at small factors."""
        parts = [self._knn(q[i : i + block], q_ids[i : i + block], k, relax, bound[i : i + block], shrink, i) for i in range(0, len(q), block) if self.nodes]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _knn(self, q: np.ndarray, q_ids: np.ndarray, k: int, relax: float, bound: np.ndarray, shrink: bool, first: int):
        q = q.astype(np.float64, copy=False)
        n = len(q)
        p = q - self.centre
        size = np.einsum("ij,ij->i", p, p) + self.norms.max()
        single = bool((1e-5 * size < 0.01 * bound).all())  # else single precision would be too coarse
        slack = (1e-5 if single else ROUND) * (1 + size)  # more than the rounding of a squared distance below
        kind = np.float32 if single else np.float64
        # a squared distance is one product of rows with their norms: |p|^2 - 2 p.b + |b|^2
        p = np.column_stack([-2 * p, np.einsum("ij,ij->i", p, p), np.ones(n)]).astype(kind)
        base = np.column_stack([self.near, np.ones(len(self.near)), self.norms]).astype(kind).T
        away = np.sqrt(squared_distances(self.vantage, q))  # (inner nodes, queries)
        best = np.full((n, k), np.inf)  # squared distances found so far
        limit = bound.astype(np.float64).copy()  # what a row must reach to count
        reach = limit if shrink else bound
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = np.full(n, -1, np.int64)  # the leaf of the first pass

        def scan(at: int, active: np.ndarray) -> None:
            if not len(active):
                return
            begin, end = self.nodes[at]
            d = p[active] @ base[:, begin:end]
            some = d.min(1) <= limit[active] + 2 * slack[active]
            if not some.any():
                return
            rows, d = active[some], d[some].astype(np.float64)
            d[q_ids[rows][:, None] == self.ids[None, begin:end]] = np.inf
            best[rows] = np.partition(np.concatenate([best[rows], d], 1), k - 1, 1)[:, :k]
            limit[rows] = np.minimum(limit[rows], best[rows].max(1))
            r, c = np.nonzero((d <= (limit[rows] + 2 * slack[rows])[:, None]) & np.isfinite(d))
            found.append((rows[r], begin + c, d[r, c]))

        stack = [(0, np.arange(n))]
        while stack:  # first pass: every query down to its own leaf
            at, active = stack.pop()
            if not len(active):
                continue
            node = self.nodes[at]
            if len(node) == 2:
                done[active] = at
                scan(at, active)
                continue
            inner = away[self.place[at], active] <= node[1]
            stack += [(node[2], active[inner]), (node[4], active[~inner])]
        stack = [(0, np.arange(n))]
        while stack:  # second pass: all that the relaxed bound leaves
            at, active = stack.pop()
            if not len(active):
                continue
            node = self.nodes[at]
            if len(node) == 2:
                scan(at, active[done[active] != at])
                continue
            d = away[self.place[at], active]
            w = relax * np.sqrt(reach[active] + 2 * slack[active]) + ROUND * (1 + d)
            for child, (low, high) in ((node[2], node[3]), (node[4], node[5])):
                stack.append((child, active[(d >= low - w) & (d <= high + w)]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, at, d = (np.concatenate(f) for f in zip(*found))
        near = d <= limit[rows] + 2 * slack[rows]
        rows, at = rows[near], at[near]
        exact = np.empty(len(rows))
        for i in range(0, len(rows), 65536):  # distances again, term by term
            diff = q[rows[i : i + 65536]] - self.x[at[i : i + 65536]]
            exact[i : i + 65536] = np.einsum("ij,ij->i", diff, diff)
        near = exact <= bound[rows]
        rows, ids, exact = rows[near], self.ids[at[near]], exact[near]
        order = np.lexsort((ids, exact, rows))
        rows, ids, exact = rows[order], ids[order], exact[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1]) if len(rows) else np.zeros(0, np.int64)
        take = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) < k
        return rows[take] + first, ids[take], exact[take]
