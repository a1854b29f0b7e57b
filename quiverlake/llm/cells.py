"""Exact radius joins of a table of vectors with itself, cell by cell, without moving vectors between tasks.

Every row is written once, to segment files in the shared folder, in the order of the cells of a
``Quantiser``. A unit, a cell or a piece of one, holds its own rows in blocks and reads, a
part at a time, the rows of the other cells that it meets; of two cells one meets the other. So disk is one copy
of the vectors at any number of cells, and memory a unit's rows and one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from quiverlake.functions.vectors import matrix
from quiverlake.session import shared_dir

FLUSH_ROWS = 250_000  # of a segment
PART_ROWS = 65_536  # of other cells held at a time
FIRST, ACROSS = 16, 2048  # directions that are cut and tested first, columns of a product


class Segments:
    """The written rows: in each file all ids, then all vectors, by cell; ``ends`` are the rows up to each cell's end."""

    def __init__(self, uri: str, dim: int, files: list[tuple[str, np.ndarray]]):
        self.uri, self.dim, self.names = uri, dim, [f for f, _ in files]
        self.starts = np.stack([np.concatenate([[0], e]) for _, e in files]) if files else np.zeros((0, 1), np.int64)

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, axis=1).sum(0)

    def read(self, cell: int, first: int = 0, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, vectors) of a cell's rows ``first`` to ``last``, counted over all files."""
        files, path = pafs.FileSystem.from_uri(self.uri)
        seen = 0
        for name, starts in zip(self.names, self.starts):
            a, b = int(starts[cell]), int(starts[cell + 1])
            begin, end = max(a, a + first - seen), b if last is None else min(b, a + last - seen)
            seen += b - a
            if begin >= end:
                continue
            with files.open_input_file(f"{path}/{name}") as f:
                for at in range(begin, end, PART_ROWS):
                    n, width = min(PART_ROWS, end - at), 4 * self.dim
                    ids = np.frombuffer(f.read_at(8 * n, 8 * at), np.int64)
                    yield ids, np.frombuffer(f.read_at(width * n, 8 * int(starts[-1]) + width * at), np.float32).reshape(n, self.dim)

    def drop(self) -> None:
        if self.names:
            files, path = pafs.FileSystem.from_uri(self.uri)
            files.delete_dir(path)


def write(rows: DataFrame, dim: int, cells: int, home: Callable[[np.ndarray], np.ndarray]) -> Segments:
    """Write the rows ``(id, v)``, each in the cell that ``home`` gives it."""
    root = shared_dir(rows.sparkSession)
    uri = (root if "://" in root else f"file://{root}") + f"/ql-segments-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(uri)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, x, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(at, kind="stable")
            name = uuid.uuid4().hex  # of tasks that ran twice only one's names are returned
            files.create_dir(path, recursive=True)
            with files.open_output_stream(f"{path}/{name}") as f:
                f.write(np.ascontiguousarray(ids[order]).tobytes())
                f.write(np.ascontiguousarray(x[order]).tobytes())
            ends = np.cumsum(np.bincount(at, minlength=cells)).tolist()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ends], pa.list_(pa.int64()))], ["name", "ends"])

        for batch in batches:
            x = matrix(batch.column(1), dim, np.float32) + np.float32(0.0)  # -0.0 becomes 0.0
            if len(x):
                held.append((batch.column(0).to_numpy(), x, home(x.astype(np.float64))))
            if sum(len(h[0]) for h in held) >= FLUSH_ROWS:
                yield flush()
        if held:
            yield flush()

    said = rows.select("id", "v").mapInArrow(run, "name string, ends array<bigint>").toArrow().sort_by("name")
    return Segments(uri, dim, [(n, np.array(e, np.int64)) for n, e in zip(said.column("name").to_pylist(), said.column("ends").to_pylist())])


def meets(cell: int, other: int) -> bool:
    """Whether the one cell meets the rows of the other, not the other way round; all meet about as many."""
    return (cell < other) == ((cell + other) % 2 == 0)


def run_units(segments: Segments, near: Callable[[int], np.ndarray], piece_rows: int, work: Callable, kinds: str, names: list[str], spark: SparkSession) -> DataFrame:
    """``work(own, others)`` for every unit, one a task: ``own`` and ``others`` iterate over (ids, vectors), and it yields tuples of columns.

    ``near(c)`` are the cells whose rows can be linked with those of cell c. A cell of more than ``piece_rows`` rows has several units.
    """
    sizes = segments.sizes()
    units = [(c, a) for c in range(len(sizes)) for a in range(0, int(sizes[c]), piece_rows)]

    def of(c: int, a: int) -> Iterator[tuple]:
        def others() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from segments.read(c, a + piece_rows)
            for d in near(c).tolist():
                if d != c and meets(c, d):
                    yield from segments.read(d)

        yield from work(segments.read(c, a, a + piece_rows), gathered(others()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for columns in of(*units[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return spark.range(0, len(units), 1, max(1, len(units))).mapInArrow(run, kinds)


def alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each group of equal vectors, each row's group)."""
    rows = np.ascontiguousarray(x)
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, group


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small parts put together to about ``PART_ROWS`` rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(ids) for ids, _ in held) >= PART_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


class Blocks:
    """Rows halved again and again into blocks along the directions ``frame`` (a centre and a turn), in the order ``order``."""

    def __init__(self, x: np.ndarray, radius: float, leaf: int, frame: tuple[np.ndarray, np.ndarray]):
        self.r2 = radius * radius
        self.centre, self.turn = frame
        p = (x.astype(np.float64) - self.centre) @ self.turn
        order: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # of inner nodes their first row, the direction and its range, and for each child its number and its range
        filled = 0

        def halve(rows: np.ndarray) -> int:
            nonlocal filled
            at = len(self.nodes)
            self.nodes.append(())
            if len(rows) > leaf:
                j = int(np.argmax(p[rows, :FIRST].std(0)))
                c = p[rows, j]
                lower = c <= np.median(c)
                if 0 < lower.sum() < len(rows):
                    begin, below, above = filled, c[lower], c[~lower]
                    self.nodes[at] = (begin, j, below.min(), above.max(), (halve(rows[lower]), below.min(), below.max()), (halve(rows[~lower]), above.min(), above.max()))
                    return at
            order.append(rows)
            self.nodes[at] = (filled, filled + len(rows))
            filled += len(rows)
            return at

        halve(np.arange(len(x)))
        self.order = np.concatenate(order)
        self.x, p = x[self.order], p[self.order]
        self.low, self.high = p.min(0), p.max(0)
        self.p, self.size = p, float(np.einsum("ij,ij->i", p, p).max())
        self.made: dict = {}

    def _sides(self, p: np.ndarray, kind) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows with their norms, such that a squared distance is one product; by the first directions and by all."""
        out = []
        for m in (FIRST, p.shape[1]):
            q = p[:, :m]
            norms, ones = np.einsum("ij,ij->i", q, q)[:, None], np.ones((len(q), 1))
            out.append((np.hstack([-2 * q, norms, ones]).astype(kind), np.hstack([q, ones, norms]).astype(kind)))
        return out

    def meet(self, other: np.ndarray | None = None, wanted: Callable | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, float]]:
        """(begin, end, rows of ``other``, squared distances, their error) of blocks and the rows that may lie within the radius of them.

        Without ``other``, each block and its own rows, and those after it. ``wanted(begin, end, rows)`` may leave rows out.
        """
        own = other is None
        if own:
            p, size, away = self.p, self.size, np.zeros(len(self.p))
        else:
            where = self._close(other)
            p = (other[where].astype(np.float64) - self.centre) @ self.turn
            gap = np.maximum(0, np.maximum(p - self.high, self.low - p))
            away = np.einsum("ij,ij->i", gap, gap)
            size = max(self.size, float(np.einsum("ij,ij->i", p, p).max(initial=0.0)))
        single = 2e-5 * (1 + size) < 0.01 * self.r2  # else single precision would be too coarse
        error = (2e-5 if single else 1e-9) * (1 + size)
        kind = np.float32 if single else np.float64
        if kind not in self.made:
            self.made[kind] = self._sides(self.p, kind)
        sides = self.made[kind]
        (_, base_first), (_, base_all) = sides if own else self._sides(p, kind)
        (ask_first, _), (ask_all, _) = sides
        most = self.r2 + error
        along = np.ascontiguousarray(p[:, :FIRST].T.astype(kind))
        stack = [(0, np.flatnonzero(away <= most), away[away <= most].astype(kind))]
        while stack:  # each row goes to all blocks within the radius by the directions cut above them
            at, rows, away = stack.pop()
            node = self.nodes[at]
            if own:
                rows, away = rows[rows >= node[0]], away[rows >= node[0]]  # the others have met these
            if not len(rows):
                continue
            if len(node) > 2:
                _, j, low, high, *children = node
                c = along[j][rows]
                gap = np.maximum(c - kind(high), kind(low) - c)
                np.maximum(gap, 0, out=gap)
                away = away - gap * gap
                for child, low, high in children:
                    gap = np.maximum(c - kind(high), kind(low) - c)
                    np.maximum(gap, 0, out=gap)
                    gap *= gap
                    gap += away
                    keep = np.flatnonzero(gap <= most)
                    stack.append((child, rows[keep], gap[keep]))
                continue
            begin, end = node
            for rows in (np.arange(begin, end), rows[rows >= end]) if own else (rows,):  # noqa: B020
                for i in range(0, len(rows), ACROSS):
                    some = rows[i : i + ACROSS]
                    if wanted is not None:
                        some = some[wanted(begin, end, some if own else where[some])]
                    if len(some):
                        some = some[(ask_first[begin:end] @ base_first[some].T).min(0) <= most]
                    if len(some):
                        d = ask_all[begin:end] @ base_all[some].T
                        yield begin, end, some if own else where[some], d, error

    def _close(self, other: np.ndarray) -> np.ndarray:
        """Numbers of the rows within the radius of the box around all blocks, or little more, by the first directions."""
        kind = np.float32 if max(self.size, float(np.abs(other).max(initial=0.0)) ** 2) < 1e12 else np.float64
        p = np.ascontiguousarray(((other - self.centre.astype(kind)) @ self.turn[:, :FIRST].astype(kind)).T)
        error = (2e-5 if kind == np.float32 else 1e-9) * (1 + self.size + p.shape[0] * float(np.abs(p).max(initial=0.0)) ** 2 + float(np.abs(self.centre).max()) ** 2)
        rows, away = np.arange(len(other)), np.zeros(len(other), kind)
        for j in range(len(p)):
            c = p[j][rows]
            gap = np.maximum(c - kind(self.high[j]), kind(self.low[j]) - c)
            np.maximum(gap, 0, out=gap)
            away += gap * gap
            if j % 2:
                keep = np.flatnonzero(away <= self.r2 + error)
                rows, away = rows[keep], away[keep]
        return rows
