"""Similarity clusters by grid density: quantise, join near cells, propagate minimum labels.

Vectors are turned into their principal directions, which changes no distance. A grid of equally filled cells
quantises them: the rows are halved along the direction in which they spread most, again and again, until a
cell has about ``cell_rows`` rows. (Cells of one fixed width don't work here: at a width of the radius or more
a few directions put half of all rows into adjacent cells, and many directions give each row hundreds of them.)
Every row belongs to one cell and is written once, by ``cells``. Of two cells one meets the rows of the other that
lie within the radius of its box: no link is lost, whatever the number of rows, cells or directions. In every
cell the links are found exactly, and each of its components is named by its smallest index. An item's names in
different cells join the components; the minimum is propagated over them until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions.vectors import lists, matrix, usable
from quiverlake.llm.cells import Blocks, alike, run_units, write
from quiverlake.session import cut, drop_cut

SLACK = 1e-9  # relative; more than the rounding of a turned coordinate


@dataclass(frozen=True)
class Settings:
    """The grid's directions and borders are fitted on a sample of about ``sample_rows`` rows, at least
    ``rows_a_cell`` a cell; cells and links cover all rows. None of the figures changes the result."""

    cell_rows: int = 48_000
    sample_rows: int = 20_000
    rows_a_cell: int = 16
    directions: int = 16  # that borders may cut
    most_rows: int = 250_000  # rows of a unit; a cell with more has several
    piece_rows: int = 60_000  # not used any more, as pivots
    pivots: int = 256
    leaf: int = 512  # rows of a block within a cell
    fine_width: float = 0.6  # cells for the most typical members
    fine_directions: int = 6
    seed: int = 11


def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre and all principal directions, the widest first."""
    dim = x.shape[1]
    cov = np.cov(x.T) if len(x) > 1 else np.eye(dim)
    return x.mean(0) if len(x) else np.zeros(dim), np.linalg.eigh(np.atleast_2d(cov))[1][:, ::-1]


class Quantiser:
    """Principal directions and the borders of the cells."""

    def __init__(self, sample: np.ndarray, n: int, s: Settings):
        sample = sample.astype(np.float64)
        self.s = s
        self.centre, turn = self.frame = principal(sample)
        self.turn = turn[:, : s.directions]
        self.nodes: list[tuple] = []  # (direction, border, lower, upper) or (cell,)
        self.cells = 0

        def halve(p: np.ndarray, parts: int) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            if parts > 1 and len(p) >= 4:
                j = int(np.argmax(p.std(0)))
                border = float(np.quantile(p[:, j], (parts // 2) / parts))
                lower = p[:, j] <= border
                if 0 < lower.sum() < len(p):
                    self.nodes[at] = (j, border, halve(p[lower], parts // 2), halve(p[~lower], parts - parts // 2))
                    return at
            self.nodes[at] = (self.cells,)
            self.cells += 1
            return at

        halve((sample - self.centre) @ self.turn, max(1, -(-n // s.cell_rows)))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.turn

    def place(self, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(home, rows, cells)``: each row's cell, and the pairs of a row and another cell within ``radius`` of it where it is a guest.

        Of two cells with an even sum of their numbers the smaller has the guests, else the larger, so all have about as many.
        """
        home = np.zeros(len(p), np.int64)
        most = (radius + SLACK * (1 + radius + np.abs(p).max(1, initial=0.0))) ** 2
        rows, cells = [], []
        stack = [(0, np.arange(len(p)), np.zeros_like(p), np.ones(len(p), bool))]
        while stack:
            at, active, gap, own = stack.pop()
            if not len(active):
                continue
            if len(self.nodes[at]) == 1:
                home[active[own]] = self.nodes[at][0]
                rows.append(active[~own])
                cells.append(np.full(len(rows[-1]), self.nodes[at][0], np.int64))
                continue
            j, border, lower, upper = self.nodes[at]
            d = p[active, j] - border
            for child, across, side in ((lower, d, d <= 0), (upper, -d, d > 0)):
                far = gap.copy()
                far[:, j] = np.maximum(far[:, j], across)
                keep = np.einsum("ij,ij->i", far, far) <= most[active]
                mine = own & side
                keep |= mine
                stack.append((child, active[keep], far[keep], mine[keep]))
        rows, cells = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(cells or [np.zeros(0, np.int64)])
        met = (cells < home[rows]) == ((cells + home[rows]) % 2 == 0)
        return home, rows[met], cells[met]

    def home(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell."""
        return self.place(self.project(x), 0.0)[0]

    def near(self, cell: int, radius: float) -> np.ndarray:
        """The cells that may have rows within ``radius`` of rows of a cell."""
        if not hasattr(self, "low"):
            self.low, self.high = np.full((2, self.cells, self.turn.shape[1]), -np.inf)
            self.high = -self.high
            stack = [(0, self.low[0].copy(), self.high[0].copy())]
            while stack:
                at, lo, hi = stack.pop()
                if len(self.nodes[at]) == 1:
                    self.low[self.nodes[at][0]], self.high[self.nodes[at][0]] = lo, hi
                    continue
                j, border, lower, upper = self.nodes[at]
                below, above = hi.copy(), lo.copy()
                below[j] = above[j] = border
                stack += [(lower, lo, below), (upper, above, hi)]
        gap = np.maximum(0, np.maximum(self.low - self.high[cell], self.low[cell] - self.high))
        edge = max((abs(n[1]) for n in self.nodes if len(n) > 1), default=0.0)
        return np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", gap, gap)) <= radius + 1e-6 * (1 + radius + edge))

    def fine(self, p: np.ndarray) -> np.ndarray:
        """A 64-bit name of each row's fine cell, of fixed width, for the most typical members."""
        h = np.zeros(len(p), np.uint64)
        with np.errstate(over="ignore"):
            for c in np.floor(p[:, : self.s.fine_directions] / self.s.fine_width).T.astype(np.int64).view(np.uint64):
                h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h.view(np.int64)


class Links:
    """The components of rows ``x`` under links of at most ``radius``, and of other rows that are linked to them; exact.

    A block of rows that are one component already meets only rows outside it, so a crowd of like rows costs little.
    """

    def __init__(self, x: np.ndarray, radius: float, leaf: int, frame: tuple[np.ndarray, np.ndarray]):
        self.blocks, self.r2 = Blocks(x, radius, leaf, frame), radius * radius
        self.parent = np.arange(len(x))
        self._meet(None)

    def _root(self, of: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[of]
            if np.array_equal(up, of):
                return of
            of = up

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of rows ``a[i]`` and ``b[i]``."""
        while len(a):
            a, b = self._root(a), self._root(b)
            a, b = np.minimum(a, b), np.maximum(a, b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, b, a)

    def _meet(self, other: np.ndarray | None) -> None:
        n = len(self.blocks.x)
        first = 0 if other is None else n
        raw = self.blocks.x if other is None else other

        def apart(begin: int, end: int, rows: np.ndarray) -> np.ndarray:
            mine = self._root(np.arange(begin, end))
            return self._root(first + rows) != mine[0] if (mine == mine[0]).all() else np.ones(len(rows), bool)

        for begin, end, rows, d, error in self.blocks.meet(other, apart):
            hit = d <= self.r2 - error
            a, b = np.nonzero((d <= self.r2 + error) & ~hit)
            if len(a):
                hit[a, b] = ((self.blocks.x[begin + a].astype(np.float64) - raw[rows[b]]) ** 2).sum(1) <= self.r2
            mine = self._root(np.arange(begin, end))
            if (mine == mine[0]).all():
                new = first + rows[hit.any(0)]
                self._join(np.full(len(new), begin), new)
            else:
                a, b = np.nonzero(hit)
                most = len(self.parent)
                pairs = np.unique(mine[a] * most + self._root(first + rows[b]))
                self._join(pairs // most, pairs % most)

    def roots(self) -> np.ndarray:
        """For each row the number of a row of its component, the same for all of them."""
        out = np.empty(len(self.parent), np.int64)
        out[self.blocks.order] = self.blocks.order[self._root(np.arange(len(self.parent)))]
        return out

    def meet(self, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the linked rows of ``other``, a row of the component of each); the rows' components are joined by them."""
        n = len(self.parent)
        self.parent = np.concatenate([self.parent, np.arange(n, n + len(other))])
        self._meet(other)
        root = self._root(np.arange(n, n + len(other)))
        self.parent = self._root(np.arange(n))
        linked = np.flatnonzero(root < n)
        return linked, self.blocks.order[root[linked]]


def components(x: np.ndarray, ids: np.ndarray, radius: float, leaf: int = 256) -> np.ndarray:
    """For each row the smallest id of its component under links of at most ``radius``; exact."""
    if len(x) < 2:
        return ids.copy()
    root = Links(x, radius, leaf, principal(x.astype(np.float64))).roots()
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return least[root]


def link_units(radius: float, leaf: int, frame: tuple[np.ndarray, np.ndarray]):
    """The work of one unit of ``cells.run_units``: edges ``(id, root)`` of its rows, and of the others it meets."""

    def work(own: Iterator[tuple], others: Iterator[tuple]) -> Iterator[tuple]:
        ids, x = (np.concatenate(c) for c in zip(*own))
        ids, first = np.unique(ids, return_index=True)
        x = x[first]
        main, group = alike(x)
        copy = np.flatnonzero(main[group] != np.arange(len(ids)))
        yield ids[copy], ids[main[group[copy]]]
        links, ids = Links(x[main], radius, leaf, frame), ids[main]
        for more, v in others:
            more, first = np.unique(more, return_index=True)
            linked, to = links.meet(v[first])
            if len(linked):
                yield more[linked], ids[to]
        root = links.roots()
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        keep = least[root] != ids
        yield ids[keep], least[root][keep]

    return work


def propagate(edges: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id reachable, from edges ``(id, root)``; every id and root gets a label.

    Each round takes the minimum over an edge's both ends and then that minimum's own label (pointer jumping),
    so chains shorten geometrically. Aggregates combine before the shuffle, so a root with many ids is no hot
    task; rounds end at written tables.
    """
    edges = cut(edges.where("id <> root").distinct(), "edges")
    both = edges.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(edges.select(F.col("root").alias("a"), F.col("id").alias("b")))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("id").alias("at"), F.col("label").alias("jump"))
        step = step.join(of, step.label == of["at"], "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        after = cut(step, "labels")
        changed = after.where("label <> old").limit(1).count()
        drop_cut(labels)
        labels = after.select("id", "label")
        labels._ql_path = after._ql_path
        if not changed:
            return labels


def fit_quantiser(items: DataFrame, dim: int, s: Settings, index: str, vector: str) -> Quantiser:
    """The grid for the usable items."""
    n = pick(items, dim, index, vector).count()
    want = max(s.sample_rows, -(-n // s.cell_rows) * s.rows_a_cell)
    some = items.where(F.pmod(F.xxhash64(F.col(index).cast("bigint")), F.lit(max(1, n // want))) == 0)
    sample = pick(some, dim, index, vector).limit(2 * want).toArrow().sort_by("id")
    return Quantiser(matrix(sample.column("v"), dim) if sample.num_rows else np.zeros((0, dim)), n, s)


def pick(items: DataFrame, dim: int, index: str, vector: str) -> DataFrame:
    """``(id, v)`` of the usable items."""
    return items.where(F.col(index).isNotNull() & usable(vector, dim)).select(F.col(index).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))


def cluster(items: DataFrame, radius: float, dim: int, min_size: int = 5, settings: Settings = Settings(), index: str = "vec_index", vector: str = "v") -> DataFrame:
    """``(index, cluster_id)`` of the items in sets of at least ``min_size`` that links of at most ``radius`` connect.

    ``cluster_id`` is the smallest index of the set. Items without an index or a usable vector don't take
    part, items loaded twice count once, equal vectors are linked, other columns aren't read, and an empty
    table has no clusters.
    """
    fit = pick(items, dim, index, vector)
    return _members(fit, fit_quantiser(items, dim, settings, index, vector), radius, dim, min_size, settings).select(F.col("id").alias(index), F.col("label").alias("cluster_id"))


def _members(fit: DataFrame, q: Quantiser, radius: float, dim: int, min_size: int, s: Settings) -> DataFrame:
    segments = write(fit, dim, q.cells, q.home)
    labels = propagate(run_units(segments, lambda c: q.near(c, radius), s.most_rows, link_units(radius, s.leaf, q.frame), "id bigint, root bigint", ["id", "root"], fit.sparkSession))
    segments.drop()
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return labels.join(sizes, "label").select("id", "label", "size")


def describe(items: DataFrame, radius: float, dim: int, min_size: int = 5, typical: int = 3, settings: Settings = Settings(), index: str = "vec_index", vector: str = "v") -> DataFrame:
    """``(cluster_id, size, cell_size, rank, index)``: of each cluster its size and its most typical members.

    These are the ``typical`` members of its densest fine cell nearest to that cell's mean, ties by the smaller index.
    """
    from pyspark.sql import Window

    fit = pick(items, dim, index, vector)
    q = fit_quantiser(items, dim, settings, index, vector)
    members = cut(_members(fit, q, radius, dim, min_size, settings), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = q.project(matrix(batch.column(1), dim).astype(np.float64) + 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q.fine(p)), lists(p.astype(np.float32))], ["id", "fine", "p"])

    place = fit.mapInArrow(run, "id bigint, fine bigint, p array<float>").dropDuplicates(["id"])
    placed = cut(members.join(place, "id"), "placed")
    m = min(len(placed.select("p").head()[0]) if placed.limit(1).count() else 0, settings.directions)
    means = [F.avg(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(m)]
    dense = placed.groupBy("label", "fine").agg(F.count("*").alias("cell_size"), *means)
    dense = dense.groupBy("label").agg(F.max_by(F.struct("fine", "cell_size", *(f"m{i}" for i in range(m))), F.struct("cell_size", "fine")).alias("c"))
    inside = placed.join(dense, "label").where("fine = c.fine")
    far = sum((F.pow(F.get("p", F.lit(i)) - F.col(f"c.m{i}"), 2) for i in range(m)), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.round(far, 9), "id"))
    out = inside.select(F.col("label").alias("cluster_id"), "size", F.col("c.cell_size").alias("cell_size"), rank.alias("rank"), F.col("id").alias(index))
    return out.where(F.col("rank") <= typical)
